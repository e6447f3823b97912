"""The novelty method by itself: planted keys are found, names, paths and plain texts are not; spans against independent rules."""

from __future__ import annotations

import random
import re
import string

from opinelake.llm import secrets


def test_planted_keys_are_recalled_by_the_method_alone():
    rng = random.Random(5)
    novelty = secrets.Novelty()
    kinds = {"hex": "0123456789abcdef", "HEX": "0123456789ABCDEF", "base64": string.ascii_letters + string.digits + "+/"}
    found = total = 0
    for i in range(600):
        kind = list(kinds)[i % 3]
        key = "".join(rng.choice(kinds[kind]) for _ in range(rng.choice([20, 24, 32, 40, 64])))
        if key.isalpha() or key.isdigit():
            continue
        words = lambda n: " ".join("".join(rng.choice("aeioulnrst") for _ in range(rng.randint(2, 8))) for _ in range(n))
        sense = rng.choice(["secret", "token", "api key", "password", "private key", "auth"])
        text = f"{words(30)} {sense} {rng.choice(['is', '=', ':', 'was set to'])} {key} {words(20)} {key if i % 5 == 0 else ''}"
        at = text.index(key)
        total += 1
        found += any(s <= at and e >= at + len(key) for s, _, e in secrets.novel_spans(text, novelty))
    assert found >= 0.9 * total


def test_ordinary_strings_near_sensitive_words_are_left_alone():
    novelty = secrets.Novelty()
    for text in [
        "the password is my_password_is_password_1", "token: aaaaaaaaaaaaaaaaaaaaaaaa1", "set secret in connection_string_username1",
        "auth via session_id_session_id_session_id1", "see token_token_token_token_2 in config", "password 1234567890123456",
    ]:
        assert secrets.novel_spans(text, novelty) == []


def test_base_spans_stay_and_novel_ones_may_overlap(spark):
    key = "9f86d081884c7d659a2feaa0c55ad015a3bf4f1b2b0b822c"
    row = secrets.scan(spark.createDataFrame([(1, f"token={key}")], "doc_id long, text string")).first()
    assert row["spans"] == f"assign:0:{6 + len(key)},hex:6:{6 + len(key)},novel:6:{6 + len(key)}"
    assert (row["n_assign"], row["n_hex"], row["n_novel"]) == (1, 1, 1)
    assert secrets.redacted_text(f"a token={key} b", secrets.Novelty()) == "a [secret] b"


def test_base_spans_against_plain_search(spark):
    sign = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
    for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("text").collect():
        text = r["text"] or ""
        want = [(m.start(), 0, m.end()) for m in sign.finditer(text) if len(m[2]) >= 6]
        want += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
        want += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
        assert secrets.base_spans(text) == sorted(want)
