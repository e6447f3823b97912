"""The registered queries of this subpackage: each applies an operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from opinelake.llm import ann, conversation_repair, decontaminate, language, line_dedup, near_dedup, packing, phrases, quality, secrets, sharding, url_rules, warc
from opinelake.llm.common import ASCII_LOWER, ASCII_UPPER, id_crc, table
from opinelake.session import shared_dir

SHARDS = 16


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.Model:
    """The ranking learned from the labels of documents that are not held out."""
    labels = table(spark, sf_dir, "labels").filter(F.pmod(id_crc("doc_id"), F.lit(5)) != 0)
    return quality.fit(docs, labels)


def op1_bradley_terry_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality.score(docs, quality_model(spark, docs, sf_dir))
    held_out = F.pmod(id_crc("doc_id"), F.lit(5)) == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= quality.CUT, 1).otherwise(0).alias("predicted"))


def op2_spaced_seed_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op3_odd_sketch_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), 85, 100)


def op4_association_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(spark, sf_dir, "pages"))


def op5_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.pmod(id_crc("doc_id"), F.lit(4)) == 2
    model = language.fit(docs.filter(~held_out))
    return language.detect(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_virtual_slot_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_bytes(table(spark, sf_dir, "documents"), SHARDS)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot"
    )


def op7_warc_boundary_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared_dir(spark, "warc")
    warc.write(table(spark, sf_dir, "pages"), path, least_bytes=0)
    records = warc.read(spark, path)
    return records.select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        warc.page_of(F.col("refers_to")).alias("refers_to"),
    )


def op8_order_preserving_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path(), 1024)


def op9_permutation_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return ann.nearest(rows, rows.filter("vec_id % 20 = 0"), 20)


def op10_zstd_novelty_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_novel"
    )


def damaged_conversations(rows: DataFrame) -> DataFrame:
    """The conversations with faults planted by the checksum of ``conv_id:turn``; nulls are one space."""
    written = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn")]
    role, text = (F.coalesce(F.col(c), F.lit(" ")) for c in ("role", "text"))
    kind = F.col("kind")
    return (
        rows.withColumn("kind", F.crc32(F.concat_ws(":", *written).cast("binary")) % 20).filter("kind <> 0")
        .withColumn("role", F.when(kind == 4, F.lit("user")).otherwise(role))
        .withColumn("text", F.when(kind == 1, F.lit("")).when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text))
        .withColumn("copy", F.explode(F.when(kind == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))))
        .select("conv_id", "turn", "role", "text")
    )


def op11_glr_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    damaged = damaged_conversations(rows)
    return conversation_repair.repaired_digests(damaged, conversation_repair.repair(damaged, rows.select("conv_id")))


def op12_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_mphf_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.without_common_lines(table(spark, sf_dir, "documents"), min_docs=10, least=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


_DIGEST32 = (
    "array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', "
    "1 + CAST((CAST('0x' || substr(h, CAST(1 + 5 * (i // 4) AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31 AS BIGINT), 1)), '')"
)

ORACLE: dict[str, str] = {
    "op7_warc_boundary_chain": f"""
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM (SELECT page_id, CAST(strlen(x) AS BIGINT) AS payload_bytes, {_DIGEST32} AS payload_digest, min(page_id) OVER (PARTITION BY h) AS first
      FROM (SELECT page_id, coalesce(html, '') AS x, sha1(coalesce(html, '')) AS h FROM pages))""",
    "op12_toivonen_collocations": f"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), '{ASCII_UPPER}', '{ASCII_LOWER}'), '[.,;:!?\\x0A-\\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[ \\x09]+'), lambda x: x <> '') AS w FROM p),
g AS (SELECT lang, unnest(list_concat(list_transform(w, lambda x: [x]), list_transform(range(1, len(w)), lambda i: w[i : i + 1]),
                                      list_transform(range(1, len(w) - 1), lambda i: w[i : i + 2]))) AS g FROM w),
f AS (SELECT lang, g, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE len(g) = 1 GROUP BY 1),
c AS (SELECT lang, g, f AS a, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1 AND f >= 10),
s AS (SELECT c.lang, c.g, c.a, k, x.f AS l, y.f AS r, CAST((1000000::HUGEINT * c.a * c.a) // (x.f::HUGEINT * y.f) AS BIGINT) AS score
      FROM c JOIN f x ON x.lang = c.lang AND x.g = c.g[1 : k] JOIN f y ON y.lang = c.lang AND y.g = c.g[k + 1 :]),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
o AS (SELECT lang, p, max(a) AS o FROM (SELECT lang, a, unnest([g[1:2], g[2:3]]) AS p FROM b WHERE len(g) = 3) GROUP BY 1, 2)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM (SELECT b.*, array_to_string(g, ' ') AS phrase FROM b LEFT JOIN o ON o.lang = b.lang AND o.p = b.g WHERE o.o IS NULL OR 100 * o.o < 50 * a) JOIN n USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000""",
    "op13_mphf_line_dedup": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, generate_subscripts(lines, 1) AS i FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{ASCII_UPPER}', '{ASCII_LOWER}') AS key FROM l),
common AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT r) >= 10)
SELECT doc_id, count(*) AS n_lines, count(c.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE c.key IS NULL), '')) AS kept_sha256
FROM k LEFT JOIN common c ON k.key = c.key GROUP BY r, doc_id""",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [v for k, v in globals().items() if k.startswith("op") and k[2:3].isdigit()]
    return {f.__name__: f for f in found}
