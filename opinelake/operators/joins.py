"""Joins of the review model."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.functions import text as tx
from opinelake.functions.values import let
from opinelake.operators.projections import one_row_each
from opinelake.session import shared_dir
from opinelake.sources.readers import materialise


def reviews_with_sentiment(reviews: DataFrame, sentiment: DataFrame, how: str = "inner") -> DataFrame:
    """1:1 join on the unique review id, so no key can be hot.

    Store both tables bucketed by ``review_id`` to make this join free of shuffles.
    """
    return reviews.join(sentiment, "review_id", how)


def salted_join(
    big: DataFrame, small: DataFrame, key: str, spread_by: str, how: str = "inner", salts: int = 16
) -> DataFrame:
    """Join for a ``key`` that may be very frequent in ``big`` and is unique in ``small``.

    Rows of ``big`` are spread over ``salts`` sub-keys by the hash of ``spread_by``; ``small`` is
    replicated once per sub-key. Every row of ``big`` meets exactly one copy, so the result of an
    inner, left, left_semi or left_anti join equals the plain join. The copies come from a cross join with the few
    sub-keys, because Spark counts its rows when it decides on a broadcast; an exploded array passes for one row.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted join cannot keep unmatched rows of the replicated side: {how}")
    salt = F.pmod(F.xxhash64(spread_by), F.lit(salts)).cast("int")
    left = big.withColumn("_salt", salt)
    subkeys = big.sparkSession.range(salts, numPartitions=1).select(F.col("id").cast("int").alias("_salt"))
    right = small.crossJoin(F.broadcast(subkeys))
    return left.join(right, [key, "_salt"], how).drop("_salt")


def full_records(
    products: DataFrame, reviews: DataFrame, sentiment: DataFrame, salts: int = 16
) -> DataFrame:
    """products ⋈ reviews ⋈ sentiment, inner. A hot product is spread over ``salts`` tasks."""
    scored = reviews_with_sentiment(reviews, sentiment)
    return salted_join(scored, products, "product_id", "review_id", salts=salts)


def all_products_records(
    products: DataFrame, reviews: DataFrame, sentiment: DataFrame, salts: int = 16
) -> DataFrame:
    """products ⟕ reviews ⟕ sentiment: products without a review are kept once, with nulls.

    Written as salted inner join plus the unmatched products, because a salted outer join
    would report a product as unmatched for every empty salt.
    """
    scored = reviews_with_sentiment(reviews, sentiment, "left")
    matched = salted_join(scored, products, "product_id", "review_id", salts=salts)
    reviewed = reviews.select("product_id").distinct()
    lonely = products.join(reviewed, "product_id", "left_anti")
    return matched.unionByName(lonely, allowMissingColumns=True)


def competitors_of(products: DataFrame, product_id: str) -> DataFrame:
    """Competitor products in the category of one product, without the product itself.

    The target is at most one row (primary key), hence the join emits at most one row per product.
    """
    target = products.filter(F.col("product_id") == product_id).select(
        F.col("category"), F.col("product_id").alias("target_id")
    )
    rivals = products.filter(F.col("is_competitor"))
    return rivals.join(F.broadcast(target.limit(1)), "category").filter(F.col("product_id") != F.col("target_id"))


def keyword_matches(texts: DataFrame, text: str, keywords: DataFrame, keyword: str = "keyword") -> DataFrame:
    """One row per (text, keyword contained in it as a substring).

    The keyword frame must be a short top-n report: it enters the scan of the texts as one array
    (scalar subquery), so there is neither a cross join nor a shuffle of the texts.
    """
    words = keywords.agg(F.collect_set(keyword)).scalar()
    found = let(F.lower(F.col(text)), lambda low: F.filter("_words", lambda k: F.contains(low, k)))
    return one_row_each(texts.withColumn("_words", words), found, keyword, *texts.columns)


def _windows(low: DataFrame, reach: int) -> DataFrame:
    """(_key, _window): consecutive pieces of the text, each followed by the first ``reach`` characters of the next one.

    Pieces are cut by a pattern, in one walk through the text: a substring at a position counts from the start of the text. A piece is
    at least as long as ``reach``, so every string of up to ``reach + 1`` characters lies whole in one window.
    """
    pieces = F.regexp_extract_all("_low", F.lit(f"(?s).{{1,{max(64, reach)}}}"), 0)
    ends = F.concat(F.slice("_pieces", 2, F.greatest(F.size("_pieces"), F.lit(1))), F.array(F.lit("")))
    joined = F.zip_with("_pieces", "_ends", lambda a, b: F.concat(a, F.substring(b, 1, reach) if reach else F.lit("")))
    cut = low.select("_key", pieces.alias("_pieces")).withColumn("_ends", ends)
    return one_row_each(cut, joined, "_window", "_key")


def keyword_index_matches(texts: DataFrame, key: str, text: str, keywords: DataFrame, keyword: str = "keyword", gram: int = 4) -> DataFrame:
    """The (key, keyword) pairs of ``keyword_matches`` for keyword lists of any length.

    A keyword without white space lies inside one word of a text. So these are looked up in the different words of all texts
    (``_substring_matches``), and a text takes the keywords of its words: what is shuffled is each word of a text once, never its
    substrings. Keywords with white space are looked up in the texts themselves.

    ``key`` is unique. Null texts and null keywords match nothing, repeated keywords count once, the empty keyword is in every text.
    Keywords are compared with the lower-cased text as they are.
    """
    words = keywords.select(F.col(keyword).alias("_kw")).filter(F.col("_kw").isNotNull()).distinct()
    spaced = F.rlike("_kw", F.lit(tx.SPACES))
    low = texts.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low")).filter(F.col("_low").isNotNull())
    own = one_row_each(low, F.array_distinct(F.split("_low", tx.SPACES)), "_word", "_key").filter(F.col("_word") != "")
    # Long words travel as digests; the blank keeps these apart from words.
    name = F.when(F.length("_word") <= 64, F.col("_word")).otherwise(F.concat(F.lit(" "), F.sha2("_word", 256)))
    different = own.select(name.alias("_name"), "_word").groupBy("_name").agg(F.first("_word").alias("_word"))
    different = materialise(different, shared_dir(texts.sparkSession, "different"))  # read twice
    inside = _substring_matches(different, "_name", "_word", words.filter(~spaced & (F.length("_kw") > 0)), "_kw", gram)
    lists = inside.groupBy("_name").agg(F.collect_set("_kw").alias("_kws"))
    hits = own.select("_key", name.alias("_name")).join(lists, "_name")
    found = hits.select("_key", F.explode("_kws").alias("_kw")).distinct().select(F.col("_key").alias(key), F.col("_kw").alias(keyword))
    others = words.filter(spaced | (F.length("_kw") == 0))
    if others.isEmpty():
        return found
    return found.unionByName(_substring_matches(texts, key, text, others.withColumnRenamed("_kw", keyword), keyword, gram))


def _substring_matches(texts: DataFrame, key: str, text: str, keywords: DataFrame, keyword: str, gram: int) -> DataFrame:
    """The pairs of ``keyword_index_matches``, by the substrings of the texts.

    Each keyword is posted under the one of its substrings of ``gram`` characters that is rarest in the texts (shorter keywords under
    themselves). Texts look up their substrings and compare only the keywords posted there, inside a window of the text, so the work
    hardly grows with the list and linearly with the text. No keyword is collected (only the greatest length and the substring
    lengths in use); the postings are broadcast only where Spark finds them small.
    """
    words = keywords.select(F.col(keyword).alias("_kw")).filter(F.col("_kw").isNotNull()).distinct()
    size = F.least(F.length("_kw"), F.lit(gram))
    bounds = words.agg(F.max(F.length("_kw")).alias("longest"), F.sort_array(F.collect_set(size)).alias("sizes")).first()
    sizes = [n for n in bounds["sizes"] if n]
    low = texts.select(F.col(key).alias("_key"), F.lower(F.col(text)).alias("_low")).filter(F.col("_low").isNotNull())
    everywhere = low.filter(F.lit(0 in bounds["sizes"])).select("_key", F.lit("").alias("_kw"))
    if not sizes:
        return everywhere.select(F.col("_key").alias(key), F.col("_kw").alias(keyword))
    spots = F.transform(
        F.sequence(F.lit(1), F.length("_kw") - size + 1), lambda p: F.struct(F.substring(F.col("_kw"), p, size).alias("gram"), p.alias("off"))
    )
    posts = words.filter(F.length("_kw") > 0).select("_kw", F.inline(spots))

    def grams(n: int) -> Column:
        count = F.length("_window") - n + 1
        here = F.transform(F.sequence(F.lit(1), count), lambda p: F.struct(F.substring(F.col("_window"), p, F.lit(n)).alias("gram"), p.alias("at")))
        return F.when(count > 0, here).otherwise(F.array().cast("array<struct<gram: string, at: int>>"))

    windows = _windows(low, bounds["longest"] - 1)
    found = windows.select("_key", "_window", F.inline(F.concat(*[grams(n) for n in sizes])))
    used = found.select("gram").join(posts.select("gram").distinct(), "gram").groupBy("gram").agg(F.count("*").alias("n"))
    # A substring that no text holds has no row: its keywords cannot occur.
    rarest = (
        posts.join(used, "gram", "left").groupBy("_kw")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "off", "gram")).alias("_best"))
        .filter(F.col("_best.n") > 0).select("_kw", "_best.gram", "_best.off")
    )
    start = F.col("at") - F.col("off") + 1
    hits = found.join(rarest, "gram").filter((start > 0) & (F.substring("_window", start, F.length("_kw")) == F.col("_kw")))
    return hits.select("_key", "_kw").distinct().unionByName(everywhere).select(F.col("_key").alias(key), F.col("_kw").alias(keyword))


def get_or_create_products(
    incoming: DataFrame, products: DataFrame, name: Column, category: str = "general", order: str | None = None
) -> DataFrame:
    """Existing products plus one record per new product id.

    The first incoming row of a new product by ``order`` may bring ``product_name`` and ``category``; else
    ``name`` (computed from ``product_id``) and the default category are used.
    """
    given = [c for c in ("product_name", "category") if order and c in incoming.columns]
    if given:
        wanted = incoming.groupBy("product_id").agg(*[F.min_by(c, order).alias(f"_{c}") for c in given])
    else:
        wanted = incoming.select("product_id").distinct()
    defaults = {"product_name": name, "category": F.lit(category)}
    # Spark takes one column of a large compressed table for small enough to be broadcast; the ids are shuffled instead.
    created = wanted.join(products.select("product_id").hint("merge"), "product_id", "left_anti").select(
        "product_id",
        *[(F.coalesce(f"_{c}", default) if c in given else default).alias(c) for c, default in defaults.items()],
        F.lit(False).alias("is_competitor"),
    )
    return products.unionByName(created, allowMissingColumns=True)


def orphans(children: DataFrame, parents: DataFrame, key: str, child_id: str) -> DataFrame:
    """Rows whose parent does not exist (quarantine side of a foreign key)."""
    return salted_join(children, parents.select(key), key, child_id, "left_anti")


def with_parent(children: DataFrame, parents: DataFrame, key: str, child_id: str) -> DataFrame:
    """Rows whose parent exists (accepted side of a foreign key)."""
    return salted_join(children, parents.select(key), key, child_id, "left_semi")


def cascade_delete(
    products: DataFrame, reviews: DataFrame, sentiment: DataFrame, deleted: DataFrame
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The three tables after deleting the given product ids and everything below them."""
    gone = deleted.select("product_id").distinct()
    gone_reviews = with_parent(reviews.select("review_id", "product_id"), gone, "product_id", "review_id")
    return (
        products.join(gone, "product_id", "left_anti"),
        orphans(reviews, gone, "product_id", "review_id"),
        sentiment.join(gone_reviews.select("review_id"), "review_id", "left_anti"),
    )


def id_list(spark, ids: Sequence[str], column: str = "product_id") -> DataFrame:
    """Request list as a frame with its 0-based position."""
    return spark.createDataFrame([(i, v) for i, v in enumerate(ids)], f"pos int, {column} string")


def lookup_in_order(df: DataFrame, ids: Sequence[str], column: str = "product_id") -> DataFrame:
    """Rows of the requested ids in request order; unknown ids are skipped.

    The list is a call parameter of known length, so broadcasting it is safe.
    """
    wanted = id_list(df.sparkSession, ids, column)
    return df.join(F.broadcast(wanted), column).orderBy("pos")
