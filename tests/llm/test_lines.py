"""Line dedup against a brute-force version."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pytest

from opinelake.llm import line_dedup as ld

SPACE = " \t\n\x0b\x0c\r"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(texts, min_docs, least):
    lines = [(t or "").split("\n") for t in texts]
    keys = [[x.strip(SPACE).translate(UPPER) for x in row] for row in lines]
    n = Counter(k for row in keys for k in set(row) if len(k) >= least)
    out = []
    for row, own in zip(lines, keys, strict=True):
        kept = [x for x, k in zip(row, own, strict=True) if n[k] < min_docs]
        out.append((len(row), len(row) - len(kept), "\n".join(kept)))
    return out


def _texts(rng):
    common = ["All rights reserved.", "  ALL rights reserved.\t", "é", "É", "x", "", "\x1fterms", "terms", "日本語の行", "  "]
    texts = []
    for i in range(400):
        own = [f"line {rng.integers(0, 300)}" for _ in range(rng.integers(0, 6))]
        texts.append("\n".join(rng.permutation(own + list(rng.choice(common, rng.integers(0, 4))))))
    return texts + [None, "", "\n", "\n\n", " \r\n ", "one\n" * 3000, "All rights reserved."] + ["copy\ncopy\nother"] * 150


@pytest.mark.parametrize(("least", "small", "shard_keys"), [(1, 1 << 20, 1 << 18), (1, 1 << 20, 7), (3, 0, 7)])
def test_common_lines_against_brute_force(spark, least, small, shard_keys):
    texts = _texts(np.random.default_rng(5))
    rows = [(None if i % 50 == 7 else i // 2, t, "clash", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, first string, n long").repartition(5)
    got = ld.without_common_lines(docs, 10, least, small, shard_keys).collect()
    want = [(r[0], *b) for r, b in zip(rows, brute(texts, 10, least), strict=True)]
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    assert sorted([tuple(r) for r in got], key=key) == sorted(want, key=key)
    assert any(r[2] for r in want) and any(r[1] > r[2] for r in want)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert ld.without_common_lines(docs).collect() == []


def test_perfect_hash_is_minimal():
    keys = np.unique(np.random.default_rng(1).integers(0, 2**63, 50_000, dtype=np.uint64))
    perfect = ld.PerfectHash.build(keys)
    assert sorted(perfect.index(keys).tolist()) == list(range(len(keys)))
    assert len(perfect.bits) * 64 < 5 * len(keys)
    other = ld.Shard(*ld.Shard.row(keys[::2], keys[::2] ^ np.uint64(9), np.ones(len(keys[::2]), np.int64)))
    assert other.count(keys[::2], keys[::2] ^ np.uint64(9)).all() and not other.count(keys[1::2], keys[1::2] ^ np.uint64(9)).any()
