"""Shingle sets of long texts are those of the whole text, however they are cut."""

from __future__ import annotations

import numpy as np

from opinelake.llm import near_dedup as nd


def test_sets_do_not_depend_on_the_slices(monkeypatch):
    rng = np.random.default_rng(9)
    words = np.array([f"w{i}" for i in range(500)] + ["É", "x" * 300])
    texts = [" ".join(rng.choice(words, n)) + s for n, s in ((5, ""), (4, ""), (3000, " \n"), (9000, ""), (1, " "), (0, ""))] + [None, " \t" * 5000, "a\x0bb " * 4000]
    whole = nd.shingle_sets(texts)
    for size in (500, 5000, 40_000):
        monkeypatch.setattr(nd, "SLICE", size)
        assert all((a == b).all() for a, b in zip(whole, nd.shingle_sets(texts), strict=True))


def test_huge_words_stand_as_digests():
    a, b = ("y" * 70_000 + c for c in "12")
    one, two, again = nd.shingle_sets([f"p q r s {a}", f"p q r s {b}", f"P q r s {a.upper()}"])
    assert (one == again).all() and not (one == two).any()
