"""WARC archives: written by Spark's text sink, read back by boundary-chain verification.

Writing. A record is a text value (header, blank line, block) and the sink's line separator is the record separator, so the
files are WARC files, gzipped. Pages with equal payloads are one response and otherwise revisits that refer to it.

Reading. Tasks look for the record magic anywhere in their files and emit, for each place found, the offset where its record
would end: an edge from a candidate to its successor. Magic inside a payload yields candidates too. Only what is reachable from
the start of the file is a record: within a block of ``BLOCK`` bytes the task itself follows the edges, so each candidate knows
where its chain leaves the block; across blocks the exits are doubled by joins (pointer jumping), as many rounds as the logarithm
of the blocks of a file. The blocks' reached entries then pick the records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from opinelake.llm.common import stored

BLOCK = 4 << 20
RECORDS_PER_FILE = 10_000
DATE = "2024-01-01T00:00:00Z"
END = "\r\n\r\n"
_MAGIC = re.compile(rb"WARC/1\.[01]\r\n")


def base32_sha1(data: Column) -> Column:
    """Bare upper-case base32 of the SHA-1 of a binary column: 160 bits as 32 digits of 5 bits."""
    hexed = F.sha1(data)
    parts = [F.lpad(F.conv(F.substring(hexed, 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def _lines(*parts: object) -> Column:
    return F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])


def deduplicated(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, html with payload_bytes, payload_digest, record_type and refers_to (see ``write``)."""
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    seen = rows.withColumn("payload_bytes", F.octet_length("html").cast("long")).withColumn("payload_digest", base32_sha1(F.col("html").cast("binary")))
    # Grouping by two keys keeps this partitioning apart from the join's, so that rows of a hot payload can be split.
    first = (
        seen.filter(F.col("payload_bytes") >= least_bytes).groupBy("payload_digest", "payload_bytes")
        .agg(F.min("page_id").alias("first")).select("payload_digest", "first")
    )
    again = F.col("first").isNotNull() & (F.col("page_id").isNull() | (F.col("page_id") != F.col("first")))
    return seen.join(first, "payload_digest", "left").select(
        "page_id", "url", "html", "payload_bytes", "payload_digest",
        F.when(again, "revisit").otherwise("response").alias("record_type"), F.when(again, F.col("first")).alias("refers_to"),
    )


def record_text(date: str = DATE) -> Column:
    """The WARC record of a row of ``deduplicated`` without the record separator."""
    http = _lines("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: ", F.col("payload_bytes").cast("string"), "\r\n\r\n")
    block = F.when(F.col("record_type") == "response", F.concat(http, F.col("html"))).otherwise(http)
    length = F.octet_length(http) + F.when(F.col("record_type") == "response", F.col("payload_bytes")).otherwise(0)
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("none"))
    url = F.regexp_replace(F.coalesce("url", F.lit("")), r"[\x00-\x20\x7f]", "%20")
    return _lines(
        "WARC/1.1\r\nWARC-Type: ", F.col("record_type"), "\r\nWARC-Record-ID: <urn:page:", name("page_id"), ">\r\nWARC-Date: ", date,
        "\r\nWARC-Target-URI: ", url, "\r\nWARC-Payload-Digest: sha1:", F.col("payload_digest"),
        F.when(
            F.col("record_type") == "revisit",
            _lines("\r\nWARC-Refers-To: <urn:page:", name("refers_to"), ">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        ).otherwise(""),
        "\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: ", length.cast("string"), END, block,
    )


def write(pages: DataFrame, path: str, least_bytes: int = 0, records_per_file: int = RECORDS_PER_FILE) -> None:
    """One record per row of ``pages`` (page_id, url, html; more columns are ignored) in gzipped WARC files under ``path``.

    Of rows with equal payloads of at least ``least_bytes`` bytes, that with the smallest page_id is a response, the others
    are revisits of it; smaller payloads are all responses. A null html is an empty payload, a null url an empty target. Rows
    without a page_id are revisits where a row with one has their payload, else responses. Control characters of urls are
    written as %20. No rows give no records.
    """
    rows = deduplicated(pages, least_bytes).select(record_text().alias("value"))
    rows.write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", records_per_file).text(path)


_FIELDS = "record_type string, record_id string, target_uri string, refers_to string, payload_bytes long, payload_digest string, intact boolean"
_EDGE = f"file string, size long, block long, offset long, next long, leaves long, {_FIELDS}"
_HEADER = {b"warc-type": "record_type", b"warc-record-id": "record_id", b"warc-target-uri": "target_uri", b"warc-refers-to": "refers_to"}


def _parse(data: bytes, at: int) -> dict:
    """The record that would start at ``at``; ``next`` is null if there is no whole header with a length."""
    out: dict = {"offset": at, "next": None}
    head = data.find(b"\r\n\r\n", at)
    if head < 0:
        return out
    fields = {}
    for line in data[at:head].split(b"\r\n")[1:]:
        k, _, v = line.partition(b":")
        fields.setdefault(k.strip().lower(), v.strip())
    length = fields.get(b"content-length", b"")
    if not length.isdigit():
        return out
    start, end = head + 4, head + 4 + int(length)
    out |= {"next": end + 4} | {name: fields[k].decode("utf-8", "replace") for k, name in _HEADER.items() if k in fields}
    payload_at = data.find(b"\r\n\r\n", start, end)
    declared = fields.get(b"warc-payload-digest", b"").removeprefix(b"sha1:").decode("ascii", "replace")
    http = fields.get(b"content-type", b"").startswith(b"application/http") and payload_at >= 0
    if fields.get(b"warc-type") == b"revisit":
        size = re.search(rb"(?i)\r\ncontent-length:[ \t]*(\d+)", data[start:payload_at]) if http else None
        out |= {"payload_bytes": int(size[1]) if size else None, "payload_digest": declared or None, "intact": end <= len(data)}
    else:
        payload = memoryview(data)[payload_at + 4 if http else start : end]
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        out |= {"payload_bytes": len(payload), "payload_digest": digest, "intact": end <= len(data) and declared in ("", digest)}
    return out


def _candidates(block: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = [f.split()[0] for f in _EDGE.split(", ")]
        for batch in batches:
            for path, data in zip(batch["path"], batch["content"], strict=True):
                data = gzip.decompress(data) if data[:2] == b"\x1f\x8b" else bytes(data)
                found = [_parse(data, m.start()) for m in _MAGIC.finditer(data)]
                leaves: dict[int, int | None] = {}
                for x in reversed(found):  # successors lie behind, so they are known already
                    to = x["next"]
                    x["leaves"] = leaves[x["offset"]] = leaves[to] if to is not None and to // block == x["offset"] // block and to in leaves else to
                    x |= {"file": path, "size": len(data), "block": x["offset"] // block}
                frame = pd.DataFrame(found, columns=names, dtype=object)
                whole = ("size", "block", "offset", "next", "leaves", "payload_bytes")
                yield frame.astype({c: "Int64" for c in whole} | {"intact": "boolean"})

    return run


def edges(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """Every candidate record of the files under ``path`` (plain or gzipped), with its successor's offset; true or not."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "content")
    return files.mapInPandas(_candidates(block), _EDGE)


def _walk(keys: tuple, frame: pd.DataFrame) -> pd.DataFrame:
    """The records of one block that its entry reaches."""
    row = dict(zip(frame["offset"].tolist(), range(len(frame)), strict=True))
    to = [None if pd.isna(x) else int(x) for x in frame["next"]]
    at, kept = int(frame["entry"].iloc[0]), []
    while at in row:
        kept.append(row[at])
        at = to[row[at]]
    return frame.iloc[kept].drop(columns=["entry", "next", "leaves"]).astype({f.split()[0]: object for f in _FIELDS.split(", ")})


def read(spark: SparkSession, path: str, block: int = BLOCK) -> DataFrame:
    """The records of the WARC files under ``path``, in no order: file, size, block, offset and what the header and payload say.

    payload_bytes and payload_digest are measured on the payload; those of revisits, whose payload is elsewhere, are declared by
    the record. ``intact`` tells whether the record is whole and its digest is the declared one. A file whose start is no
    record gives none.
    """
    seen = stored(edges(spark, path, block), "warc-edges")
    jumps = seen.select("file", "offset", F.col("leaves").alias("to")).filter("to IS NOT NULL")
    reached = seen.filter("offset = 0").select("file", "offset")
    blocks = seen.agg(F.max(F.floor(F.col("size") / block))).first()[0] or 0
    for _ in range(int(blocks).bit_length()):
        more = reached.join(jumps, ["file", "offset"]).select("file", F.col("to").alias("offset"))
        reached = stored(reached.unionByName(more).distinct(), "warc-reached")
        onward = jumps.select("file", F.col("offset").alias("to"), F.col("to").alias("then"))
        jumps = stored(jumps.join(onward, ["file", "to"]).select("file", "offset", F.col("then").alias("to")), "warc-jumps")
    # A chain's end, or a place without a record, is reached too but is no entry.
    reached = reached.join(seen.select("file", "offset"), ["file", "offset"], "left_semi")
    entry = reached.select("file", F.floor(F.col("offset") / block).alias("block"), F.col("offset").alias("entry"))
    kept = [f for f in seen.schema.fieldNames() if f not in ("next", "leaves")]
    schema = ", ".join(f"{n} {t}" for n, t in (f.split() for f in _EDGE.split(", ")) if n in kept)
    return seen.join(entry, ["file", "block"]).groupBy("file", "block").applyInPandas(_walk, schema)


def page_of(record_id: Column) -> Column:
    """The page_id in a record id of ``write``; null for rows that had none."""
    return F.regexp_extract(record_id, r"^<urn:page:(-?\d+)>$", 1).try_cast("long")
