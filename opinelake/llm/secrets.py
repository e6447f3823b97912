"""Secret scans: three base patterns and dictionary-primed zstandard novelty.

The base patterns (assignments to a sensitive name, access keys, hexadecimal runs) are exact and always reported. The novelty
method adds what they miss: a string of 16 or more key characters near a sensitive word is compressed with zstandard, primed with
the text around it and a dictionary of common identifiers. Its marginal cost is the compressed size of context and candidate
less that of the context alone. Names, paths and repeated words cost little; a random key costs about its entropy. Strings whose
marginal cost per character reaches ``NOVELTY`` (two thirds of it for hexadecimal digits) and that mix letters with digits are
reported, also where a base pattern has found them.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.llm.common import releasing

# The base patterns, with the least length of what they must have found.
ASSIGN = re.compile(r"""(?ai:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")  # a run of fewer characters is dropped, so the run may as well ask for them
KINDS = ("assign", "access", "hex", "novel")

SENSITIVE = re.compile(
    r"(?ai:password|passwd|passphrase|secret|token|credential|auth|bearer|private[_ -]?key|api[_ -]?key|access[_ -]?key|client[_-]?id|session[_-]?id)"
)
CANDIDATE = re.compile(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{16,}={0,2}(?![A-Za-z0-9+/_=-])")
KEY_CHARS = re.compile(r"[A-Za-z0-9+/_=-]*")
REACH, NOVELTY = 80, 0.6
HEX_ONLY = re.compile(r"[0-9a-f]+|[0-9A-F]+")
IDENTIFIERS = (
    "password passwd secret token api_key apikey access_key client_secret client_id session_id authorization bearer private_key "
    "public_key username user_name database connection_string hostname localhost import return function class public static void "
    "const string number boolean undefined config settings environment variable export default https http www example com org net "
    "BEGIN RSA PRIVATE KEY END CERTIFICATE ssh-rsa sha256 sha512 base64 utf-8 content-type application json header "
    "abcdefghijklmnopqrstuvwxyz ABCDEFGHIJKLMNOPQRSTUVWXYZ 0123456789 0000000000000000 xxxxxxxxxxxxxxxx"
)

Span = tuple[int, int, int]  # start, kind, end


class Novelty:
    """Marginal compressed size of a string after a context."""

    def __init__(self, identifiers: str = IDENTIFIERS):
        import zstandard

        words = zstandard.ZstdCompressionDict(identifiers.encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        self.compress = zstandard.ZstdCompressor(level=9, dict_data=words, write_content_size=False, write_checksum=False).compress

    def per_char(self, before: str, candidate: str, after: str) -> float:
        context = f"{before}{after}\n".replace(candidate, "").encode("utf-8", "replace")  # a key is as new where it stands twice
        whole = len(self.compress(context + candidate.encode()))
        return (whole - len(self.compress(context))) / len(candidate)


def base_spans(text: str) -> list[Span]:
    """Spans of the base patterns, leftmost and not overlapping within a kind, in code points."""
    found: list[Span] = []
    # An assignment needs one of its signs; looking for them is cheaper than the pattern.
    if ":" in text or "=" in text:
        found += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 6]
    if "AKIA" in text:
        found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(found)


def threshold(value: str, least: float = NOVELTY) -> float:
    """The marginal bytes a character from which a string is a key: of the 6 bits that a character of a key holds, hex digits hold 4."""
    return least * 4 / 6 if HEX_ONLY.fullmatch(value) else least


def novel_spans(text: str, novelty: Novelty, least: float = NOVELTY) -> list[Span]:
    """Incompressible strings near a sensitive word, whether or not a base pattern finds them too.

    Only the ``REACH`` characters around a word are read, and the rest of a run of key characters that reaches into them.
    """
    found: list[Span] = []
    done = 0  # all before it is searched; never within a run
    for word in SENSITIVE.finditer(text):
        lo, hi = max(0, word.start() - REACH), word.end() + REACH
        if done >= hi:
            continue
        if lo <= done:
            lo = done
        elif KEY_CHARS.fullmatch(text, lo, lo + 1):
            while lo > done and KEY_CHARS.fullmatch(text, lo - 1, lo):
                lo -= 1
        if hi < len(text) and KEY_CHARS.fullmatch(text, hi - 1, hi):
            hi = KEY_CHARS.match(text, hi).end()
        done = hi
        for m in CANDIDATE.finditer(text, lo, hi):
            start, end = m.span()
            value = m.group()
            if not (any(c.isdigit() for c in value) and any(c.isalpha() for c in value)):
                continue
            if novelty.per_char(text[max(0, start - 256) : start], value, text[end : end + 256]) >= threshold(value, least):
                found.append((start, 3, end))
    return found


def scan_text(text: str | None, novelty: Novelty) -> list[Span]:
    text = text or ""
    return sorted(base_spans(text) + novel_spans(text, novelty))


def _written(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def _scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    novelty = Novelty()
    for batch in batches:
        found = [scan_text(t, novelty) for t in batch["text"]]
        base = [[s for s in spans if s[1] < 3] for spans in found]
        yield pd.DataFrame({
            "doc_id": batch["doc_id"].astype("Int64"),
            **{f"n_{KINDS[k]}": [sum(s[1] == k for s in spans) for spans in found] for k in range(4)},
            "base_sha256": [hashlib.sha256(_written(spans).encode()).hexdigest() for spans in base],
            "spans": [_written(spans) for spans in found],
        })


def scan(docs: DataFrame) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text; more columns are ignored), without a shuffle.

    Columns: doc_id, the number of spans of each kind, base_sha256 (of the base spans), spans (``kind:start:end`` by start, then
    kind, joined by commas; code points, end exclusive). Null and empty texts have no spans; null ids stay null; repeated rows
    are returned as often as they come; an empty table gives an empty result.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInPandas(releasing(_scan), "doc_id long, n_assign long, n_access long, n_hex long, n_novel long, base_sha256 string, spans string")


def redacted_text(text: str | None, novelty: Novelty, mark: str = "[secret]") -> str | None:
    """The text with every span replaced by ``mark``; overlapping spans are one."""
    spans = scan_text(text, novelty)
    if not spans:
        return text
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join(out) + text[at:]


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the secrets of its text column replaced by a mark; all other columns and all rows stay."""

    @F.pandas_udf("string")
    def clean(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        novelty = Novelty()
        for batch in batches:
            yield batch.map(lambda t: redacted_text(t, novelty), na_action="ignore")

    return docs.withColumn(text, clean(F.col(f"`{text}`")))
