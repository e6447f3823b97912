"""Order-preserving packing of documents into sequences by dynamic programming.

The tokens of a task's documents, in doc_id order, form one stream. Cuts lie at document ends (free), sentence ends (small
penalty) or inside a sentence (larger penalty, for truncating it), and a window costs its padding. A cut inside a sentence only
ever pays when it fills a window, so the program walks over document and sentence ends alone: a step from end i to end j is a
chain of any number of full windows and one last window. With q and r the quotient and remainder of a place by 1024, such a chain
has q(j - 1) - q(i) full windows, one less where r(i) > r(j - 1). So the best i is the cheapest end before j or the cheapest one with
a remainder above r(j - 1); both are read from a list of those ends that no other end of an equal or larger remainder undercuts.
Every sentence end is an end, and chains have no bound.
Windows are padded to ``max_tokens`` except where their length is a power of two, so the last window of a stream is written in
powers of two.

A stream is cut into blocks of ``BLOCK_TOKENS`` tokens, each solved on its own, so memory does not grow with the task. Nothing is
shuffled: a task packs the documents of its input split.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from opinelake.llm.common import releasing

MAX_TOKENS = 1024
SENTENCE_PENALTY, WORD_PENALTY = 1, 4
BLOCK_TOKENS = 1 << 19
RUN = 1 << 18  # characters encoded at once, or up to the end of a longer word

_WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"  # white space of the split pattern
_SPACE = re.compile(f"(?<=[^{_WHITE}])[{_WHITE}]")
_GAP = re.compile(f"[{_WHITE}]{{2,}}")


class Words:
    """Token ids (little-endian bytes) of texts.

    White space after another character always starts a token, and of several in a row the last one does if a word follows. So a
    text is encoded in runs that end before such places, and the split pattern needs no look-ahead. ``ranks`` come from the
    tokenizer file itself: in a byte-level vocabulary in merge order an id is its merge's rank, which the constructor checks.
    Texts with a special token's string are encoded whole by the tokenizer.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self.path, self.whole = path, None
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(plain)))}
        special = {t["content"] for t in model["added_tokens"]}
        vocab = {t: i for t, i in model["model"]["vocab"].items() if t not in special}
        merged = [vocab["".join(m)] for m in model["model"]["merges"]]
        if merged != sorted(merged):
            raise ValueError("the ids of this vocabulary do not follow its merges")
        ranks = {bytes(chars[c] for c in t): i for t, i in vocab.items()}
        # Fixed value: the split pattern of byte-level encoders for one of the runs.
        pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+"""
        self.encode = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.special = sorted(special)
        self.stop = np.zeros(max(vocab.values()) + 2 + len(special), bool)
        self.opens = self.stop.copy()
        for t, i in ranks.items():
            self.stop[i] = t[-1:] in (b".", b"!", b"?", b"\n")
            self.opens[i] = t[:1] in (b" ", b"\n") or t[-1:] == b"\n"

    def irregular(self, text: str) -> bytes:
        """The ids of a text that is encoded whole; its encoder is made at the first such text."""
        if self.whole is None:
            from tokenizers import Tokenizer

            self.whole = Tokenizer.from_file(self.path)
        return _code(self.whole.encode(text, add_special_tokens=False).ids)

    def regular(self, text: str) -> bool:
        """Are all white spaces single ones between words, each a space or line break?"""
        words = text.split()
        n = text.count(" ") + text.count("\n")
        return n == len(words) - 1 and n + sum(map(len, words)) == len(text)

    def ids(self, text: str) -> bytes:
        if any(t in text for t in self.special):
            return self.irregular(text)
        stops = [] if self.regular(text) else [gap.end() - 1 for gap in _GAP.finditer(text) if gap.end() < len(text)]
        runs, at = [], 0
        for stop in [*stops, len(text)]:
            while at < stop:
                space = _SPACE.search(text, at + RUN, stop) if stop - at > RUN else None
                end = space.start() if space else stop
                runs.append(_code(self.encode(text[at:end])))
                at = end
        return b"".join(runs)


def _code(ids: list[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


@lru_cache(maxsize=1)
def _words(path: str) -> Words:
    return Words(path)


def tokenize(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Ids of a text with a final 0, and the places after sentence ends (in tokens, ascending, the last is the length)."""
    ids = np.frombuffer((words.ids(text) if text else b"") + b"\0\0\0\0", "<u4")
    own = ids[:-1]
    after = np.flatnonzero(words.stop.take(own[:-1])) + 1
    return ids, np.append(after[words.opens[own[after]]], len(ids)).astype(np.int64)


def cuts(ends: np.ndarray, penalty: np.ndarray, width: int = MAX_TOKENS, chain: int | None = None) -> list[int]:
    """The window ends of least padding plus penalties over a stream whose allowed ends (ascending, the last one final) are given.

    Windows between two of these ends are full but for the last one. How many they are is not bounded; ``chain``, once a bound, has
    no effect.
    """
    ends = np.asarray(ends, np.int64)
    at, n = [0, *ends.tolist()], len(ends) + 1
    back = [0] * n
    full = width + WORD_PENALTY
    step = full * n
    # key: the least cost up to an end plus its place, less ``full`` for each whole width before it, joined with the end's number.
    rests, keys = [0], [0]  # of the ends that are not undercut, both ascending
    before, after = divmod(ends - 1, width), divmod(ends, width)
    add = (before[0] - after[0]) * full + width + np.asarray(penalty, np.int64)
    for j, (rest, own, extra) in enumerate(zip(before[1].tolist(), after[1].tolist(), add.tolist(), strict=True), 1):
        best = keys[0]
        i = bisect_right(rests, rest)
        if i < len(rests) and keys[i] - step < best:
            best = keys[i] - step
        best, back[j] = divmod(best, n)
        key = (best + extra) * n + j
        hi = bisect_left(rests, own)
        if hi == len(rests) or keys[hi] > key:
            lo = hi
            while lo and keys[lo - 1] >= key:
                lo -= 1
            if hi < len(rests) and rests[hi] == own:
                hi += 1
            rests[lo:hi], keys[lo:hi] = [own], [key]
    out, j = [], n - 1
    while j:
        i = back[j]
        out.append(at[j])
        out += [at[i] + width * x for x in range((at[j] - at[i] - 1) // width, 0, -1)]
        j = i
    return out[::-1]


def _block(docs: list[tuple[object, np.ndarray, int, int]], ends: list[np.ndarray], width: int, sequence: int) -> tuple[dict[str, list], int]:
    """Pieces of one block; docs: (doc_id, ids, start in the document, tokens of the document)."""
    total = sum(len(d[1]) for d in docs)
    doc_end = np.cumsum([len(d[1]) for d in docs])
    allowed = np.unique(np.concatenate([*ends, doc_end]))
    penalty = np.where(np.isin(allowed, doc_end), 0, SENTENCE_PENALTY)
    at = cuts(allowed, penalty, width)
    # The last window as powers of two: no padding.
    left = total - (at[-2] if len(at) > 1 else 0)
    at = at[:-1]
    for bit in range(width.bit_length() - 1, -1, -1):
        if left >> bit & 1:
            at.append((at[-1] if at else 0) + (1 << bit))
    out: dict[str, list] = {k: [] for k in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")}
    base, w = 0, 0
    low = 0
    for doc_id, ids, start, tokens in docs:
        done = 0
        while done < len(ids):
            length = min(len(ids) - done, at[w] - base - done)
            for k, v in zip(out, (doc_id, start + done, length, zlib.crc32(ids[done : done + length].tobytes()), tokens, sequence + w, base + done - low), strict=True):
                out[k].append(v)
            done += length
            if base + done == at[w]:
                low, w = at[w], w + 1
        base += len(ids)
    return out, len(at)


def _pack(path: str, width: int):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyspark import TaskContext

        words = _words(path)
        sequence = TaskContext.get().partitionId() << 40
        docs: list = []
        ends: list = []
        held = 0

        def flush():
            nonlocal docs, ends, held, sequence
            out, used = _block(docs, ends, width, sequence)
            sequence += used
            docs, ends, held = [], [], 0
            return pd.DataFrame(out).astype({"doc_id": "Int64"})

        for batch in batches:
            for doc_id, text in zip(batch["doc_id"], batch["text"], strict=True):
                ids, stops = tokenize(text or "", words)
                named = None if pd.isna(doc_id) else int(doc_id)
                for at in range(0, len(ids), BLOCK_TOKENS):
                    part = ids[at : at + BLOCK_TOKENS]
                    own = stops[(stops > at) & (stops <= at + len(part))] - at
                    docs.append((named, part, at, len(ids)))
                    ends.append(own + held)
                    held += len(part)
                    if held >= BLOCK_TOKENS:
                        yield flush()
        if docs:
            yield flush()

    return run


def pack(docs: DataFrame, tokenizer_path: str, max_tokens: int = MAX_TOKENS, cache: int | None = None) -> DataFrame:
    """Pieces of ``docs`` (doc_id, text; more columns are ignored) in sequences of at most ``max_tokens`` tokens, in doc_id order.

    One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. Every document ends with id 0; a null
    or empty text is that id alone. A null doc_id stays null; repeated rows are packed as often as they come. sequence_id is
    unique, with the task's number in its upper bits. An empty table gives no pieces.
    ``cache``, once the number of words whose ids a worker kept, has no effect.
    """
    if max_tokens & (max_tokens - 1):
        raise ValueError("max_tokens must be a power of two")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.sortWithinPartitions("doc_id").mapInPandas(
        releasing(_pack(tokenizer_path, max_tokens)),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long",
    )
