"""Subword encoding of texts with a given vocabulary, by longest match.

The vocabulary is a tokenizer file (JSON) whose pieces end in ``</w>`` where a word ends. Words are cut on the JVM; in each Arrow batch
every different word is matched once against a trie of the pieces, and its ids are laid out for all places where it stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterator, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.functions import text as tx

# The length of an encoded text, and the mark of a piece that ends a word.
MAX_LENGTH = 256
WORD_END = "</w>"
PAD = 0
LARGEST = 1 << 18  # pieces that are sent to the executors, some 10 MB
CACHED_WORDS = 100_000
ROWS = 512  # rows that are laid out at a time, whatever an Arrow batch holds

# The characters that stand for the 256 bytes in byte-level vocabularies.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_CHARS = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in _PLAIN)}
_BYTES = {c: b for b, c in _CHARS.items()}


class Pieces:
    """A vocabulary of word pieces: piece to id, and the ids that open and close a text."""

    def __init__(self, ids: Mapping[str, int], start: int, end: int):
        if len(ids) > LARGEST:
            raise ValueError(f"{len(ids)} pieces; at most {LARGEST} can be sent to every executor")
        self.ids, self.start, self.end = dict(ids), start, end
        self._trie: dict | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_trie": None}

    @classmethod
    def load(cls, path: str) -> Pieces:
        """From a tokenizer file; its first two added tokens open and close a text and are no pieces."""
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        (start, opens), (end, closes) = [(t["content"], t["id"]) for t in model["added_tokens"]][:2]
        return cls({p: i for p, i in model["model"]["vocab"].items() if p not in (start, end)}, opens, closes)

    @property
    def trie(self) -> dict:
        """Nested dicts by character; the key "" holds the id of a piece, "end" that of one which ends a word."""
        if self._trie is None:
            self._trie = {}
            for piece, i in self.ids.items():
                last = piece.endswith(WORD_END)
                node = self._trie
                for c in piece.removesuffix(WORD_END):
                    node = node.setdefault(c, {})
                node["end" if last else ""] = i
        return self._trie

    def cut(self, word: str) -> list[int]:
        """The ids of a word's pieces: at each place the longest that fits, a piece that reaches the end being one that ends words.

        Bytes outside the vocabulary are left out.
        """
        chars = "".join([_CHARS[b] for b in word.encode("utf-8", "surrogatepass")])
        out, at = [], 0
        while at < len(chars):
            node, found, to = self.trie, None, at
            for place in range(at, len(chars)):
                node = node.get(chars[place])
                if node is None:
                    break
                i = node.get("end") if place + 1 == len(chars) else node.get("")
                if i is not None:
                    found, to = i, place + 1
            if found is None:
                at += 1
                continue
            out.append(found)
            at = to
        return out

    def decode(self, ids: list[int]) -> str:
        """The text of encoded ids, one space between words; padding and what opens and closes it are left out."""
        if not hasattr(self, "_pieces"):
            self._pieces = {i: p for p, i in self.ids.items()}
        body = ids[ids.index(self.start) + 1 : ids.index(self.end)] if self.end in ids else ids
        words = "".join(self._pieces[i] for i in body).replace(WORD_END, " ").rstrip(" ")
        return " ".join(bytes(_BYTES[c] for c in w).decode("utf-8", "replace") for w in words.split(" ")) if words else ""


def _laid_out(tokens: pd.Series, pieces: Pieces, known: dict[str, np.ndarray], max_length: int) -> pd.DataFrame:
    """Ids and number of used places of each row's words."""
    n = len(tokens)
    lengths = tokens.str.len().to_numpy(np.int64, na_value=0)
    out = np.full((n, max_length), PAD, np.int32)
    out[:, 0] = pieces.start
    used = np.zeros(n, np.int64)
    if lengths.sum():
        codes, words = pd.factorize(np.concatenate(tokens.to_list()))
        if len(known) > CACHED_WORDS:
            known.clear()
        for w in words:
            if w not in known:
                known[w] = np.array(pieces.cut(w), np.int32)
        own = [known[w] for w in words]
        size = np.array([len(x) for x in own], np.int64)
        flat, begin = np.concatenate(own), np.cumsum(size) - size
        # Every word's ids in the order of the words; a row's place of an id counts from the row's first.
        count = size[codes]
        source = np.repeat(begin[codes] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        row = np.repeat(np.repeat(np.arange(n), lengths), count)
        total = np.bincount(row, minlength=n)
        place = np.arange(len(row)) - np.repeat(np.cumsum(total) - total, total)
        keep = place < max_length - 2
        out[row[keep], place[keep] + 1] = flat[source[keep]]
        used = np.minimum(total, max_length - 2)
    out[np.arange(n), used + 1] = pieces.end
    return pd.DataFrame({"input_ids": list(out), "used": (used + 2).astype(np.int32)})


def _in_parts(lines: pd.Series, pieces: Pieces, known: dict[str, np.ndarray], max_length: int) -> Iterator[pd.DataFrame]:
    """``_laid_out`` for ``ROWS`` rows at a time; a line is a row's words, joined by spaces."""
    for at in range(0, len(lines), ROWS):
        words = [np.array(line.split(" ") if line else [], object) for line in lines.iloc[at : at + ROWS]]
        yield _laid_out(pd.Series(words, dtype=object), pieces, known, max_length)


def encode_subwords(df: DataFrame, text: str, pieces: Pieces, max_length: int = MAX_LENGTH) -> DataFrame:
    """Adds ``input_ids`` and ``attention_mask``: opening id, ids of the words' pieces, closing id, padding to ``max_length``.

    What does not fit is cut off at the end. Null and empty texts are the opening and the closing id alone.
    """

    @F.pandas_udf("struct<input_ids: array<int>, used: int>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known: dict[str, np.ndarray] = {}
        for lines in batches:
            yield from _in_parts(lines, pieces, known, max_length)

    # A word has one piece at least, so more words than places cannot count. They travel as one string a row.
    tokens = F.array_join(F.slice(tx.tokens(F.coalesce(F.col(text), F.lit(""))), 1, max_length - 2), " ")
    mask = F.concat(F.array_repeat(F.lit(1), F.col("_e.used")), F.array_repeat(F.lit(0), F.lit(max_length) - F.col("_e.used")))
    return (
        df.withColumn("_e", ids(tokens))
        .withColumn("input_ids", F.col("_e.input_ids"))
        .withColumn("attention_mask", mask)
        .drop("_e")
    )
