"""URL filters: listed rules first, then association rules mined from labelled URLs.

Listed rules (host and path, longest first) decide the URLs they fit. Those decisions are the labels of the training URLs: each
is a transaction of URL tokens and its label, and Spark's FP-growth mines the token combinations. Rules with a label as consequent
are pruned by support and confidence, and by each other: a rule goes if part of its tokens tells the same at least as surely. The
rest decide the other URLs through an inverted index: each rule is posted under its rarest token, a URL's tokens look their
postings up, and of the rules that hold in full the surest decides. URLs that no rule reaches are allowed.

Work is done on distinct token sets, counted first, so a host with a third of all pages is a few rows.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.llm.common import ascii_lower, stored

# The listed rules, host and path as one string, and whether they allow.
LISTED = (
    ("org/", "allow"), ("example.org/es/", "block"), ("example.org/en/1", "block"), ("com/fr/", "allow"), ("com/de/", "block"),
)
SUPPORT, CONFIDENCE = 0.005, 0.8
LEAST_COUNT = 20  # URLs that a rule rests on at least
ALLOW, BLOCK = "allow", "block"


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased; empty where there is none."""
    return ascii_lower(F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), F.lit("")))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def listed_rule(host: Column, path: Column, rules: tuple[tuple[str, str], ...] = LISTED) -> tuple[Column, Column]:
    """The longest listed rule that fits and its verdict; nulls where none does. A rule fits its host and all subdomains."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        domain, _, rest = text.partition("/")
        fits = ((host == domain) | F.endswith(host, F.lit("." + domain))) & F.startswith(path, F.lit("/" + rest))
        rule, verdict = F.when(fits, text).otherwise(rule), F.when(fits, says).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column, host: Column, path: Column) -> Column:
    """Sorted distinct tokens: host labels, path segments by place (digits as #), file ending, names of query keys."""
    digits = lambda c: F.regexp_replace(c, "[0-9]+", "#")
    labels = F.transform(F.filter(F.split(host, r"\."), lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    places = F.transform(parts, lambda x, i: F.concat(F.lit("p"), F.least(i, F.lit(2)).cast("string"), F.lit(":"), digits(x)))
    ending = F.regexp_extract(path, r"\.([A-Za-z]{1,5})$", 1)
    query = F.coalesce(F.regexp_extract(url, r"(?s)^[^?#]*\?([^#]*)", 1), F.lit(""))
    keys = F.transform(F.filter(F.split(query, "&"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.split(x, "=", 2)[0]))
    return F.array_sort(F.array_distinct(F.concat(labels, places, F.when(ending != "", F.array(F.concat(F.lit("e:"), ending))).otherwise(F.array().cast("array<string>")), keys)))


def mine_rules(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """Pruned rules (antecedent, verdict, confidence, support, anchor) from rows (tokens, verdict).

    ``anchor`` is the rarest token of the antecedent. Fewer than ``LEAST_COUNT`` labelled rows give no rule.
    """
    spark = labelled.sparkSession
    known = labelled.filter("verdict IS NOT NULL AND size(tokens) > 0")
    schema = "antecedent array<string>, verdict string, confidence double, support double, anchor string"
    n = known.count()
    support = max(support, LEAST_COUNT / max(n, 1))
    if support > 1:
        return spark.createDataFrame([], schema)
    baskets = known.select(F.concat("tokens", F.array(F.concat(F.lit("="), "verdict"))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=support, minConfidence=confidence).fit(baskets)
    found = model.associationRules.filter(F.startswith(F.col("consequent")[0], F.lit("=")) & ~F.exists("antecedent", lambda x: F.startswith(x, F.lit("="))))
    rules = stored(
        found.select(F.array_sort("antecedent").alias("antecedent"), F.substring(F.col("consequent")[0], 2, 100).alias("verdict"), "confidence", "support"),
        "url-rules",
    )
    common = model.freqItemsets.filter(F.size("items") == 1).select(F.col("items")[0].alias("token"), "freq")
    exploded = rules.withColumn("token", F.explode("antecedent"))
    anchored = exploded.join(common, "token").groupBy("antecedent", "verdict").agg(
        F.first("confidence").alias("confidence"), F.first("support").alias("support"), F.min_by("token", F.struct("freq", "token")).alias("anchor")
    )
    anchored = stored(anchored, "url-rules")
    part = anchored.select(
        F.col("antecedent").alias("less"), F.col("verdict").alias("says"), F.col("confidence").alias("sure"), F.col("anchor").alias("token")
    )
    weaker = (
        anchored.withColumn("token", F.explode("antecedent")).join(part, "token")
        .filter((F.col("says") == F.col("verdict")) & (F.size("less") < F.size("antecedent")) & (F.col("sure") >= F.col("confidence")))
        .filter(F.size(F.array_except("less", "antecedent")) == 0).select("antecedent", "verdict").distinct()
    )
    return stored(anchored.join(weaker, ["antecedent", "verdict"], "left_anti").select(*[c.split()[0] for c in schema.split(", ")]), "url-rules")


def match_rules(token_sets: DataFrame, rules: DataFrame) -> DataFrame:
    """(tokens, verdict) of the distinct ``tokens`` that some rule holds for: the surest rule's, then the best supported one's."""
    posted = token_sets.withColumn("anchor", F.explode("tokens")).join(rules, "anchor")
    held = posted.filter(F.size(F.array_except("antecedent", "tokens")) == 0)
    rank = F.struct("confidence", "support", -F.size("antecedent"), "verdict")
    return held.groupBy("tokens").agg(F.max_by("verdict", rank).alias("mined"))


def judge(
    pages: DataFrame, rules: tuple[tuple[str, str], ...] = LISTED, support: float = SUPPORT, confidence: float = CONFIDENCE
) -> DataFrame:
    """Every row of ``pages`` (page_id, url; more columns are ignored) with host, path, rule and verdict (allow or block).

    ``rule`` is the listed rule that decided, else null and the verdict is the mined rules'. A null url, or one without
    ``://``, has an empty host and path, no rule, and is allowed. Ids may be null or repeated; an empty table gives an
    empty result.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), host_of(url).alias("host"), path_of(url).alias("path"), url.alias("url"))
    rule, verdict = listed_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("listed"), tokens_of(F.col("url"), F.col("host"), F.col("path")).alias("tokens"))
    mined = mine_rules(rows.select("tokens", F.col("listed").alias("verdict")), support, confidence)
    # Two keys here and one in the join: the rows of a hot token set can then be split.
    open_sets = rows.filter("listed IS NULL").groupBy("tokens", F.size("tokens")).agg(F.lit(1)).select("tokens")
    told = match_rules(open_sets, mined)
    joined = rows.withColumn("asked", F.when(F.col("listed").isNull(), F.col("tokens"))).join(told.withColumnRenamed("tokens", "asked"), "asked", "left")
    return joined.select("page_id", "host", "path", "rule", F.coalesce("listed", "mined", F.lit(ALLOW)).alias("verdict"))
