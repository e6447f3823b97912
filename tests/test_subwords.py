"""Longest-match encoding: literal cases, round trips and a brute-force cut."""

import os

import numpy as np
import pandas as pd
import pytest

from opinelake.operators import subwords as sw

FILE = "/opt/tokenizers/word_bpe_49k.json"
SMALL = sw.Pieces({"un": 1, "able</w>": 2, "do": 3, "a": 4, "b": 5, "a</w>": 6, "b</w>": 7, "ab": 8, "ab</w>": 9, "able": 10, "Ã": 11, "©</w>": 12}, 90, 91)


def cut(word, ids):
    """By trying every length at every place."""
    chars = "".join(sw._CHARS[b] for b in word.encode())
    out, at = [], 0
    while at < len(chars):
        for n in range(len(chars) - at, 0, -1):
            piece = chars[at : at + n] + (sw.WORD_END if at + n == len(chars) else "")
            if piece in ids:
                out.append(ids[piece])
                at += n
                break
        else:
            at += 1
    return out


def test_longest_match():
    assert SMALL.cut("undoable") == [1, 3, 2]
    assert SMALL.cut("ab") == [9] and SMALL.cut("aab") == [4, 9] and SMALL.cut("able") == [2]
    assert SMALL.cut("xab?") == [8]  # bytes that no piece holds are left out
    assert SMALL.cut("é") == [11, 12] and SMALL.cut("") == []
    rng = np.random.default_rng(1)
    for _ in range(300):
        word = "".join(rng.choice(list("abledoun"), rng.integers(1, 12)))
        assert SMALL.cut(word) == cut(word, SMALL.ids)


def test_layout(spark):
    rows = [(0, "undoable  ab"), (1, None), (2, ""), (3, "a " * 50), (4, " ".join(["undoable"] * 4)), (5, "ab"), (6, "ab")]
    df = spark.createDataFrame(rows, "id int, text string").repartition(2)
    got = {r["id"]: (r["input_ids"], sum(r["attention_mask"]), len(r["attention_mask"])) for r in sw.encode_subwords(df, "text", SMALL, 8).collect()}
    assert got[0] == ([90, 1, 3, 2, 9, 91, 0, 0], 6, 8)
    assert got[1] == got[2] == ([90, 91, 0, 0, 0, 0, 0, 0], 2, 8)
    assert got[3] == ([90, 4 + 2, 6, 6, 6, 6, 6, 91], 8, 8)
    assert got[4] == ([90, 1, 3, 2, 1, 3, 2, 91], 8, 8)
    assert got[5] == got[6] == ([90, 9, 91, 0, 0, 0, 0, 0], 3, 8)
    assert sw.encode_subwords(df.limit(0), "text", SMALL, 8).collect() == []


@pytest.mark.skipif(not os.path.exists(FILE), reason="no tokenizer file here")
def test_ids_decode_to_the_text(spark):
    pieces = sw.Pieces.load(FILE)
    texts = ["the quality of this product is wonderful", "don't buy  it", "zzxqj 12345 naïve 日本", "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for r in sw.encode_subwords(df, "text", pieces).collect():
        assert len(r["input_ids"]) == sw.MAX_LENGTH and r["input_ids"][0] == pieces.start
        assert pieces.decode(r["input_ids"]) == " ".join(texts[r["id"]].split())
    for word in ["wonderful", "thstinthe", "naïve", "q1"]:
        assert pieces.cut(word) == cut(word, pieces.ids)


def test_vocabulary_is_bounded():
    with pytest.raises(ValueError, match="at most"):
        sw.Pieces({str(i): i for i in range(sw.LARGEST + 1)}, 0, 1)


def test_a_batch_is_laid_out_in_parts():
    """Before, all rows of an Arrow batch were laid out at once, so memory grew with the batch."""
    lines = pd.Series(["ab doable", "", "a", None] * sw.ROWS)
    parts = list(sw._in_parts(lines, SMALL, {}, 8))
    assert [len(p) for p in parts] == [sw.ROWS] * 4
    whole = pd.concat(parts)
    words = pd.Series([np.array(t.split(" ") if t else [], object) for t in lines], dtype=object)
    plain = sw._laid_out(words, SMALL, {}, 8)
    assert np.array_equal(np.stack(whole["input_ids"]), np.stack(plain["input_ids"])) and list(whole["used"]) == list(plain["used"])
