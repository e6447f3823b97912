"""Collocations against a brute-force count."""

from __future__ import annotations

import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from opinelake.llm import phrases as ph

UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute(rows, least, kept, top):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(UPPER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        found = []
        for g, a in c.items():
            if len(g) < 2 or a < least:
                continue
            score, _, x, y = min((1000000 * a * a // (c[g[:k]] * c[g[k:]]), k, c[g[:k]], c[g[k:]]) for k in range(1, len(g)))
            if len(g) == 2 and any(len(h) == 3 and b >= least and g in (h[:2], h[1:]) and 100 * b >= kept * a for h, b in c.items()):
                continue
            found.append((-score, -a, " ".join(g).encode(), x, y))
        for rank, (score, a, p, x, y) in enumerate(sorted(found)[:top], 1):
            out.append((lang, rank, p.decode(), -a, x, y, n[lang], -score))
    return sorted(out)


def _docs(rng):
    words = [f"w{i}" for i in range(25)] + ["New", "YORK", "city", "é", "É", "日本", "\x1fodd", "it's"]
    rows = []
    for i in range(220):
        parts = []
        for _ in range(rng.integers(0, 12)):
            parts.append(" ".join(rng.choice(words, rng.integers(1, 7))))
            if rng.random() < 0.4:
                parts.append(str(rng.choice(["new york city", "New  York\tCity", "in new york", "it's it's it's it's"])))
        text = "".join(p + str(rng.choice([".", ", ", "!\n", " ", "\x0b", " "])) for p in parts)
        rows.append((text, [None, "en", "fr", "en"][i % 4]))
    return rows + [(None, "en"), ("", "xx"), (" . ,", "yy"), ("ab ab ab ab ab ab", None)] + [("same text of copies here", "en")] * 60


@pytest.mark.parametrize(("least", "top", "sample"), [(4, 2000, 2), (3, 9, 1000), (5, 40, 6)])
def test_collocations_against_brute_force(spark, least, top, sample):
    """A high sample threshold proposes nothing: everything is found by expansion passes."""
    rows = _docs(np.random.default_rng(3))
    docs = spark.createDataFrame([(*r, 1, "clash") for r in rows], "text string, lang string, k int, phrase string").repartition(5)
    got = ph.collocations(docs, least, 50, top, sample)
    assert sorted(tuple(r) for r in got.collect()) == brute(rows, least, 50, top)
    _, passes = ph.frequent_phrases(ph._texts(docs), least, sample)
    assert passes == 3 if sample == 1000 else passes in (1, 2, 3)


def test_long_texts_count_the_same_in_parts(monkeypatch):
    rng = np.random.default_rng(8)
    text = " ".join(rng.choice(["a", "bb", "ccc.", "d\nd", "x" * 90, "e,"], 4000))
    whole = Counter()
    for piece in re.split(r"[.,\n]", text):
        w = piece.split()
        for k in (1, 2, 3):
            whole.update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for piece, tail in ((100, 40), (70, 1 << 16), (1000, 300)):
        monkeypatch.setattr(ph, "PIECE", piece)
        monkeypatch.setattr(ph, "TAIL", tail)
        got = Counter()
        for buffer, counted in ph._buffers([text.encode()]):
            p = ph.Phrases(buffer, counted, "en")
            for k in range(3):
                for row, n in zip(zip(*(w.tolist() for w in p.parts[k])), p.counts[k].tolist()):
                    got[tuple(p.words[i].as_py().decode() for i in row)] += n
        assert got == whole


def test_rows_are_shuffled_by_part_not_by_phrase(spark, monkeypatch):
    """Few rows carry the phrases of a piece; many parts, over 65,536 too, give the same sums."""
    rows = _docs(np.random.default_rng(4))
    texts = ph._texts(spark.createDataFrame(rows, "text string, lang string").repartition(3)).cache()
    size = sum(len((t or "").encode()) for t, _ in rows)
    assert ph._parts(texts) == 1
    monkeypatch.setattr(ph, "PART", 400)
    assert ph._parts(texts) == 1 + size // 400
    found = [sorted(map(tuple, ph.sampled(texts, 2, parts).collect())) for parts in (1, 37, 70_001)]
    assert found[0] == found[1] == found[2] and len(found[0]) > 100
    p = ph.Phrases(" ".join(f"w{i % 97} x{i % 89}" for i in range(5000)).encode(), 0, "en")
    for k, n in ((1, 186), (2, 5000), (3, 5000)):
        out = list(p.rows("en", k, 7))
        assert sum(b.num_rows for b in out) == 7 and sum(len(x.split(b"\n")) for b in out for x in b["phrases"].to_pylist()) == len(p.counts[k - 1]) >= n


def test_exact_beyond_64_bits(spark):
    a, l, r = 9_000_000_000_007, 9_100_000_000_013, 9_300_000_000_001
    df = spark.createDataFrame([(a, l, r)], "a long, l long, r long")
    expr = "(CAST(1000000 AS DECIMAL(7,0)) * CAST(a AS DECIMAL(15,0)) * CAST(a AS DECIMAL(15,0))) div (CAST(l AS DECIMAL(19,0)) * CAST(r AS DECIMAL(19,0)))"
    assert df.selectExpr(expr).first()[0] == 1000000 * a * a // (l * r)


def test_hashes_are_those_of_sql(spark):
    p = ph.Phrases("ab é ab x".encode(), 0, "en")
    words = [w.decode() for w in p.words.to_pylist()]
    rows = [(a, b, int(h)) for (a, b), h in zip([(0, 1), (1, 2)], p.pair_hashes(np.array([0, 1]), np.array([1, 2])).view(np.int64))]
    df = spark.createDataFrame([(words[a], words[b], h, int(p.hashes[a].view(np.int64))) for a, b, h in rows], "a string, b string, h long, g long")
    for r in df.selectExpr("xxhash64(xxhash64('en', a), xxhash64('en', b)) = h AS pair", "xxhash64('en', a) = g AS word").collect():
        assert r["pair"] and r["word"]


def test_empty_table(spark):
    assert ph.collocations(spark.createDataFrame([], "text string, lang string")).collect() == []
