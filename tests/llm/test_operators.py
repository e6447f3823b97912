"""Each operator against a brute-force version on small data, and its defined results for odd input."""

import base64
import hashlib
import os
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from opinelake.llm import ann, common, decontaminate, language, near_dedup, packing, quality, secrets, sharding, url_rules, warc
from opinelake.llm.queries import ORACLE, queries, tokenizer_path
from opinelake.session import shared_dir

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i % 997} x{i}." for i in range(30_000))
ODD = [
    (1, None, "en", "a", None), (2, "", None, None, 0), (3, " \n\t ", "en", "a", 4), (4, LONG, "en", "a", len(LONG)),
    (5, "one two three four five six", "en", "a", 5), (5, "one two three four five six", "en", "a", 5), (None, "no id here", "en", "a", 1),
    (None, None, None, None, None), (6, "ONE two three four five six", "en", "b", 5), (7, "12 34 !!", "en", "b", 5),
]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls in any column, empty and long texts, repeated rows, and further columns named like results."""
    clash = {c: F.lit("x") for c in ("score", "kept", "slot", "bucket", "words", "label", "id", "block", "a", "lang_pred", "digest", "at", "size")}
    return spark.createDataFrame(ODD, DOCS).withColumns(clash).repartition(3)


def no_rows(spark):
    return spark.createDataFrame([], DOCS)


# --- near duplicates -------------------------------------------------------------------------

def groups(texts, part=85):
    sets = {}
    for i, t in texts.items():
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    top = {i: i for i in texts}

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in texts:
        for b in texts:
            if a < b and sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= part * (len(sets[a]) + len(sets[b]) - both):
                    x, y = root(a), root(b)
                    top[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i)) for i in texts}


@pytest.mark.parametrize("block", [1024, 4])
def test_near_duplicates_against_all_pairs(spark, block):
    rng = np.random.default_rng(3)
    base = [" ".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 3)) for _ in range(150)]
    texts = {}
    for i in range(60):  # chains of edits around one text, others on their own, copies, short ones
        w = list(base if i % 3 else rng.permutation(base))
        for k in rng.choice(150, i % 9, replace=False):
            w[k] = f"edit{rng.integers(40)}"
        texts[i] = " ".join(w)
    texts |= {60: texts[1], 61: texts[1].upper(), 62: "", 63: None, 64: "a b", 65: "A  b", 66: "a b c d e"}
    rows = near_dedup.near_duplicates(spark.createDataFrame(list(texts.items()), "doc_id long, text string"), block=block).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in rows} == groups(texts)
    assert all(r.kept == (r.doc_id == r.component_id) for r in rows) and len(rows) == len(texts)


def test_near_duplicates_odd_input(spark, odd):
    rows = near_dedup.near_duplicates(odd).collect()
    assert len(rows) == len(ODD)
    assert {r.component_id for r in rows if r.doc_id in (5, 6)} == {5}
    assert all(r.component_id is None and r.kept for r in rows if r.doc_id is None)
    assert near_dedup.near_duplicates(no_rows(spark)).count() == 0


def test_odd_sketches_estimate_similarity():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 400, dtype=np.uint64)
    b = np.concatenate([a[40:], rng.integers(0, 2**63, 40, dtype=np.uint64)])
    x, y = near_dedup.odd_sketches(np.array([near_dedup.minhashes(s) for s in (a, b)]))
    assert np.bitwise_count(x ^ y).sum() <= near_dedup.sketch_bound(0.70)
    z = near_dedup.odd_sketches(near_dedup.minhashes(rng.integers(0, 2**63, 400, dtype=np.uint64))[None])[0]
    assert np.bitwise_count(x ^ z).sum() > near_dedup.sketch_bound(0.70)


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    assert {(r.id, r.label) for r in common.components(edges).collect()} == {(i, 0) for i in range(41)} | {(100, 100), (101, 100)}


# --- quality, language ---------------------------------------------------------------------

def test_quality_learns_held_out_labels(spark):
    rows = queries()["op1_bradley_terry_quality"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.predicted == r.quality for r in held) >= 0.9 * len(held)


def test_preference_weights_order_pairs():
    rng = np.random.default_rng(0)
    better, worse = rng.normal(1, 1, (500, 2)), rng.normal(0, 1, (500, 2))
    w = quality.preference_weights(better, worse)
    assert ((better - worse) @ w > 0).mean() > 0.75
    model = quality.fit_rows(np.vstack([better, worse])[:, [0, 1] * 7], np.repeat([1, 0], 500))
    assert 0 < model.quantile < 1 and abs(model.score(np.zeros((1, 14)))[0] - 0.3) < 0.7


def test_quality_odd_input(spark, odd):
    labels = spark.createDataFrame([(5, 1), (4, 0), (5, 0), (None, 1), (6, None)], "doc_id long, quality int")
    rows = quality.score(odd.drop("score"), quality.fit(odd, labels)).collect()
    assert len(rows) == len(ODD) and all(0 <= r.score <= 1 for r in rows)
    nothing = quality.fit(no_rows(spark), labels)
    assert quality.score(no_rows(spark), nothing).count() == 0
    assert {round(r.score, 6) for r in quality.score(odd.drop("score"), nothing).collect()} == {0.3}


def test_language_on_held_out_rows(spark):
    rows = queries()["op5_hyperdimensional_language"](spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    assert sum(r.lang_pred == r.lang for r in held) >= 0.9 * len(held)


def test_language_vector_is_the_bundle_of_bound_letters():
    letters = np.random.default_rng(11).choice(np.array([-1, 1], np.int8), (language.SYMBOLS, language.SIZE)).astype(int)
    codes = [0, *[ord(c) - 96 for c in "ab"], 0, 3, 0]
    expected = sum(np.roll(np.roll(letters[a], 1) * letters[b], 1) * letters[c] for a, b, c in zip(codes, codes[1:], codes[2:]))
    assert (language.vector("Ab, C") == expected).all()


def test_language_odd_input(spark, odd):
    rows = language.detect(odd, language.fit(odd)).collect()
    by = {(r.doc_id, r.text): r.lang_pred for r in rows}
    assert len(rows) == len(ODD) and by[(1, None)] == by[(2, "")] == by[(7, "12 34 !!")] == "und" and by[(4, LONG)] == "en"
    assert {r.lang_pred for r in language.detect(odd, language.fit(no_rows(spark))).collect()} == {"und"}


def test_language_of_letters_from_the_third_plane_on(spark):
    text = "".join(chr(0x30000 + i) for i in range(20)) + chr(0x31350)
    docs = spark.createDataFrame([(1, text, "zh"), (2, "plain words here", "en")], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in language.detect(docs, language.fit(docs)).orderBy("doc_id").collect()] == ["zh", "en"]


# --- decontamination ------------------------------------------------------------------------

def test_leaks_tolerate_substitutions(spark):
    item = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon"
    w = item.split()
    changed = " ".join("other" if i in (3, 9, 15) else x for i, x in enumerate(w))
    half = " ".join("other" if i % 2 else x for i, x in enumerate(w))
    docs = [
        (1, f"before it {item.upper()}. after"), (2, f"{changed} tail"), (3, half), (4, " ".join(reversed(w))), (5, None), (6, ""),
        (7, "alpha beta " * 50), (8, " ".join(w[:12])), (None, item), (1, f"before it {item.upper()}. after"),
    ]
    bench = [(10, item), (11, "too short"), (12, None), (13, "")]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in found) == [(-1, 10), (1, 10), (2, 10), (8, 10)]
    assert {r.doc_id: round(r.matched_share, 2) for r in found}[2] == 0.85
    kept = decontaminate.without_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string"))
    assert sorted(r.doc_id or -1 for r in kept.collect()) == [-1, 3, 4, 5, 6, 7]


@pytest.mark.parametrize("limit", [decontaminate.BROADCAST_SEEDS, 1])
def test_leaks_find_short_excerpts_in_long_texts(spark, monkeypatch, limit):
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", limit)
    w = [f"item{i}" for i in range(30)]
    around = lambda i, *parts: " ".join([*(f"a{i}x{k}" for k in range(40)), *parts, *(f"b{i}x{k}" for k in range(40))])
    docs = [
        (1, around(1, *w[9:21])), (2, around(2, *w[4:12])), (3, around(3, *w[4:11])), (4, around(4, *w[:10], "more", *w[10:20])),
        (5, around(5, *w[:9], *w[10:19])), (6, around(6, *w[:5], "x", *w[6:11], "y", *w[12:17])),
    ]
    found = decontaminate.leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, " ".join(w))], "item_id long, text string"))
    assert sorted((r.doc_id, r.matched_share) for r in found.collect()) == [(1, 1.0), (2, 1.0), (4, 1.0), (5, 1.0)]


def test_leaks_find_every_verbatim_passage(spark):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    words = lambda t: re.findall(r"[^\W_]+", t.lower())
    texts = {r.doc_id: " ".join(words(r.text)) for r in docs.collect()}
    verbatim = {(d, r.item_id) for r in bench.collect() for d, t in texts.items() if " ".join(words(r.text)) in t}
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(docs, bench).collect()} >= verbatim and verbatim


def test_leaks_of_a_benchmark_too_large_to_broadcast(spark, monkeypatch):
    docs, bench = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "benchmark"))
    small = sorted(map(tuple, decontaminate.leaks(docs, bench).collect()))
    monkeypatch.setattr(decontaminate, "BROADCAST_SEEDS", 1)
    assert sorted(map(tuple, decontaminate.leaks(docs, bench).collect())) == small


def test_leaks_odd_input(spark, odd):
    bench = spark.createDataFrame([(1, LONG), (None, "one two three four five six seven eight")], "item_id long, text string")
    assert {(r.doc_id, r.item_id) for r in decontaminate.leaks(odd, bench).collect()} == {(4, 1)}
    assert decontaminate.leaks(no_rows(spark), bench).count() == 0
    assert decontaminate.leaks(odd, bench.limit(0)).count() == 0


# --- URLs --------------------------------------------------------------------------------------

def test_listed_rules(spark):
    urls = [
        "http://a.ORG/x", "https://www.example.org/es/1", "https://example.org/en/12", "http://example.org/en/2", "http://x.com/fr/1",
        "http://com/de/", "http://notorg/", "http://a.org?x", "a.org/x", None, "", "x://y://org/",
    ]
    rows = url_rules.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")).orderBy("page_id").collect()
    assert [r.rule for r in rows] == [
        "org/", "example.org/es/", "example.org/en/1", "org/", "com/fr/", "com/de/", None, None, None, None, None, None,
    ]
    assert [r.verdict for r in rows][:6] == ["allow", "block", "block", "allow", "allow", "block"] and {r.verdict for r in rows[6:]} == {"allow"}
    assert (rows[0].host, rows[0].path) == ("a.org", "/x") and (rows[8].host, rows[9].path) == ("", "") and rows[11].host == "y:"


def test_mined_rules_against_counting(spark):
    sets = [(["h:bad", "h:com"], "block")] * 30 + [(["h:com", "h:fine"], "allow")] * 70 + [(["h:com", "h:mixed"], v) for v in ("allow", "block") for _ in range(25)]
    labelled = spark.createDataFrame(sets, "tokens array<string>, verdict string")
    rules = {tuple(r.antecedent): (r.verdict, round(r.confidence, 3)) for r in url_rules.mine_rules(labelled, 0.05, 0.8).collect()}
    assert rules == {("h:bad",): ("block", 1.0), ("h:fine",): ("allow", 1.0)}
    told = url_rules.match_rules(spark.createDataFrame([(["h:bad", "p0:x"],), (["h:com"],)], "tokens array<string>"), url_rules.mine_rules(labelled, 0.05, 0.8)).collect()
    assert [(r.tokens, r.mined) for r in told] == [(["h:bad", "p0:x"], "block")]


def test_urls_empty_table(spark):
    assert url_rules.judge(spark.createDataFrame([], "page_id long, url string, tokens string")).count() == 0


# --- shards ------------------------------------------------------------------------------------

def test_shards_are_even_and_gapless(spark):
    rows = queries()["op6_virtual_slot_sharding"](spark, SF).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    load, places = {}, {}
    for r in rows:
        raw = (texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))
        load[r.shard] = load.get(r.shard, 0) + r["size"]
        places.setdefault(r.shard, []).append(r.slot)
    assert len(rows) == len(texts) and set(load) == set(range(16)) and max(load.values()) < 1.05 * min(load.values())
    assert all(sorted(p) == list(range(len(p))) for p in places.values())


def test_rebalancing_moves_little_and_versions_are_stored(spark, tmp_path):
    weight = [5, 1, 1, 1, 1, 1, 1, 1]
    first = sharding.SlotMap.first(2, 8)
    second = first.rebalanced(weight, 2)
    assert (first.version, second.version) == (1, 2) and sum(a != b for a, b in zip(first.shard, second.shard)) <= 2
    assert abs(sum(w if s else -w for w, s in zip(weight, second.shard))) <= 1
    grown = second.rebalanced(weight, 3)
    assert all(b == 2 for a, b in zip(second.shard, grown.shard) if a != b) or grown.version == 3
    sharding.store_map(spark, second, weight, [1] * 8, str(tmp_path))
    assert sharding.load_map(spark, str(tmp_path), 2, 8) == second


def test_shards_odd_input(spark, odd):
    rows = sharding.shard_by_bytes(odd, 3, 64).collect()
    assert len(rows) == len(ODD) and sorted((r.shard, r.slot) for r in rows) == sorted({(r.shard, r.slot) for r in rows})
    assert sharding.shard_by_bytes(no_rows(spark)).count() == 0


# --- WARC ----------------------------------------------------------------------------------------

def pages(spark):
    trap = "x WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n"
    rows = [(i, f"http://h/{i}", ("é" * (i % 7) + trap * (i % 3)) or None) for i in range(60)]
    return spark.createDataFrame([*rows, (None, None, trap), (None, "a b\r\nc", "only here")], "page_id long, url string, html string").repartition(3)


@pytest.mark.parametrize("block", [64, 997, 4 << 20])
def test_archives_round_trip(spark, block):
    path = shared_dir(spark, "warc")
    warc.write(pages(spark), path, records_per_file=9)
    found = warc.read(spark, path, block).select(
        warc.page_of(F.col("record_id")).alias("page_id"), "payload_bytes", "payload_digest", "record_type", warc.page_of(F.col("refers_to")).alias("refers_to"), "intact"
    ).collect()
    first, expected = {}, []
    for r in sorted(pages(spark).collect(), key=lambda r: (r.page_id is None, r.page_id)):
        raw = (r.html or "").encode()
        digest = base64.b32encode(hashlib.sha1(raw).digest()).decode()
        f = first.setdefault(digest, r.page_id)
        expected.append((r.page_id, len(raw), digest, "response" if f == r.page_id else "revisit", None if f == r.page_id else f, True))
    assert sorted(map(str, map(tuple, found))) == sorted(map(str, expected))


def test_archives_of_small_payloads_and_no_rows(spark):
    path = shared_dir(spark, "warc")
    warc.write(pages(spark), path, least_bytes=10_000)
    assert {r.record_type for r in warc.read(spark, path).select("record_type").collect()} == {"response"}
    path = shared_dir(spark, "warc")
    warc.write(pages(spark).limit(0), path)
    assert warc.read(spark, path).count() == 0


# --- packing -------------------------------------------------------------------------------------

def test_packing_is_whole_and_ordered(spark):
    from tokenizers import Tokenizer

    encoder = Tokenizer.from_file(tokenizer_path())
    odd_texts = ["a  b", " lead and trail ", "x \n y. z\n\nq", "tab\t a", "é è  b", "don't 'll's, 12 3.5 4!?", "<|endoftext|> a <|endoftext|>  b", "\u3000x y\x85 z"]
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()} | dict(enumerate([*odd_texts, None, "", LONG], 10_000))
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(2)
    rows = sorted(packing.pack(docs, tokenizer_path()).collect(), key=lambda r: (r.doc_id, r.start))
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for d, text in texts.items():
        ids = np.array([*encoder.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        at = 0
        for r in by[d]:
            assert (r.start, r.doc_tokens) == (at, len(ids)) and r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    pad = total = 0
    for part in seq.values():
        part.sort(key=lambda r: r.offset)
        assert [r.offset for r in part] == np.cumsum([0, *[r.length for r in part]])[:-1].tolist()
        n = sum(r.length for r in part)
        assert n <= 1024
        total, pad = total + n, pad + (0 if n & (n - 1) == 0 else 1024 - n)
        assert [r.doc_id for r in part] == sorted(r.doc_id for r in part)
    assert pad <= 0.02 * total


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(5)
    for _ in range(30):
        width = 16
        ends = np.cumsum(rng.integers(1, width + 1, 14))
        penalty = rng.integers(0, 4, 14)
        best = {0: 0}
        for j, p in enumerate(ends):  # every chain of windows, tried one by one
            options = [
                best[i] + width * (k + 1) - (p - i) + k * packing.WORD_PENALTY + penalty[j]
                for i in best for k in range(3) if width * k < p - i <= width * (k + 1)
            ]
            best[int(p)] = min(options)
        got = packing.cuts(ends, penalty, width, 3)
        cost, last = 0, 0
        for c in got:
            at = np.flatnonzero(ends == c)
            cost += width - (c - last) + (penalty[at[0]] if len(at) else packing.WORD_PENALTY)
            last = c
        assert cost <= best[int(ends[-1])] and last == ends[-1] and max(np.diff([0, *got])) <= width


def test_chains_of_windows_have_no_bound():
    rng, width = np.random.default_rng(6), 8
    for _ in range(60):
        ends = np.cumsum(rng.integers(1, 9 * width, 10))
        penalty = rng.integers(0, 4, 10)
        best = {0: 0}
        for j, p in enumerate(ends.tolist()):
            best[p] = min(best[i] + width * (k + 1) - (p - i) + k * packing.WORD_PENALTY + penalty[j] for i in best for k in [(p - i - 1) // width])
        cost, last = 0, 0
        for c in packing.cuts(ends, penalty, width):
            at = np.flatnonzero(ends == c)
            cost += width - (c - last) + (penalty[at[0]] if len(at) else packing.WORD_PENALTY)
            assert 0 < c - last <= width
            last = c
        assert last == ends[-1] and cost <= best[int(last)]


def test_every_sentence_end_may_be_cut():
    words = packing.Words(tokenizer_path())
    ids, ends = packing.tokenize("one two. three! four five? six seven", words)
    assert len(ends) == 4 and ends[-1] == len(ids)
    assert [words.stop[ids[e - 1]] for e in ends[:-1]] == [True] * 3


def test_texts_are_encoded_once_and_in_runs(monkeypatch):
    from tokenizers import Tokenizer

    encoder, words = Tokenizer.from_file(tokenizer_path()), packing.Words(tokenizer_path())
    plain, given = words.encode, []
    monkeypatch.setattr(words, "encode", lambda text: given.append(text) or plain(text))
    # New words each time, as in a text with many rare ones.
    texts = [" ".join(f"w{k}q{i}x don't\nIt's {i}! éß.\nA-b" for i in range(40)) for k in range(5)]
    for text in texts:
        assert words.ids(text) == np.array(encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
    assert given == texts
    for run in (1, 7, 50):
        monkeypatch.setattr(packing, "RUN", run)
        given.clear()
        assert words.ids(texts[0]) == np.array(encoder.encode(texts[0], add_special_tokens=False).ids, "<u4").tobytes()
        assert "".join(given) == texts[0] and len(given) > 1 and max(map(len, given)) <= run + 12


def test_white_space_of_any_kind_is_encoded_in_runs(monkeypatch):
    from tokenizers import Tokenizer

    encoder, words = Tokenizer.from_file(tokenizer_path()), packing.Words(tokenizer_path())
    monkeypatch.setattr(words, "irregular", None)  # these texts do not need the slower encoder
    rng = np.random.default_rng(8)
    parts = ["a", "one", "'s", "1", "!.", "é", "\u65e5", "\x1c", *"  \n\n\t\r\x0b\x85\xa0\u2003\u2028\u3000"]
    texts = ["p q.\n\nr  s", " \n", "  a", "a\t\t", "a\r\n\r\n b"] + ["".join(rng.choice(parts, 12)) for _ in range(1500)]
    for run in (packing.RUN, 2):
        monkeypatch.setattr(packing, "RUN", run)
        for text in texts:
            assert words.ids(text) == np.array(encoder.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_packing_odd_input(spark, odd):
    rows = packing.pack(odd, tokenizer_path()).collect()
    assert sum(r.start == 0 for r in rows) == len(ODD) and {r.doc_tokens for r in rows if r.doc_id in (1, 2)} == {1}
    assert packing.pack(no_rows(spark), tokenizer_path()).count() == 0
    assert packing.pack(odd, tokenizer_path(), cache=3).collect() == rows  # words forgotten and learned again


# --- nearest neighbours --------------------------------------------------------------------------

def test_nearest_recall_and_exact_scores(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1500, 24)) * rng.uniform(0.5, 2, (1500, 1))
    x[500:900] = x[500]  # equal vectors: ties go to the smaller ids
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>").repartition(3)
    rows = ann.nearest(df, df.filter("vec_id % 50 = 0"), 20, block=600).collect()
    hit = 0
    for q in range(0, 1500, 50):
        got = sorted((r for r in rows if r.query_id == q), key=lambda r: r.rank)
        score = x @ x[q]
        want = sorted((i for i in range(1500) if i != q), key=lambda i: (-round(score[i], 9), i))[:20]
        hit += len({r.vec_id for r in got} & set(want))
        assert [r.rank for r in got] == list(range(1, 21)) and all(abs(r.score - score[r.vec_id]) < 1e-9 for r in got)
        assert [(-r.score, r.vec_id) for r in got] == sorted((-r.score, r.vec_id) for r in got)
    assert hit >= 0.9 * 600


def test_nearest_odd_input(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [0.9, 0.1]), (2, None), (3, [0.0, 0.0]), (4, [nan, 1.0]), (5, [inf, 1.0]), (6, [None, 1.0]), (7, [1.0, 2.0, 3.0][:2]), (7, [1.0, 2.0]), (None, [1.0, 1.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit("x")).withColumn("block", F.lit(1))
    got = ann.nearest(df, df.filter("vec_id IN (0, 2, 3)"), 20).orderBy("rank").collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in got] == [(0, 1, 7), (0, 2, 1)]
    assert ann.nearest(df.limit(0), df, 5).count() == 0 and ann.nearest(df, df.limit(0), 5).count() == 0


# --- secrets ---------------------------------------------------------------------------------------

def test_secret_spans(spark):
    key = "kJ8sQ2mX7vL4pR9tW1zB6nC3"
    texts = [
        "password = 'hunter22' and Token:abc", "AKIA" + "A1" * 10 + " AKIASHORT", "é " + "0123456789abcdef" * 2, f"the api key is {key} here",
        f"plain {key} text", "secret=token:abcdefgh", "my auth uses configuration_settings_default", None, "",
    ]
    rows = secrets.scan(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").withColumn("spans", F.lit(1))).orderBy("doc_id").collect()
    assert [(r.n_assign, r.n_access, r.n_hex, r.n_novel) for r in rows] == [
        (1, 0, 0, 0), (0, 1, 0, 0), (0, 0, 1, 0), (0, 0, 0, 1), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0), (0, 0, 0, 0),
    ]
    assert rows[0].spans == "assign:0:20" and rows[2].spans == "hex:2:34" and rows[3].spans == f"novel:15:{15 + len(key)}"
    assert rows[0].base_sha256 == hashlib.sha256(b"assign:0:20").hexdigest() and rows[8].base_sha256 == hashlib.sha256(b"").hexdigest()


def test_secrets_that_begin_or_end_beyond_the_reach():
    key = base64.b64encode(hashlib.sha512(b"k").digest()).decode()
    tail = "w " * 36
    texts = [f"{key} is the api key", f"{'x ' * 9}{key} is the api key", f"the api key {tail}{key} end", f"api key {key} and {'w ' * 30}token"]
    found = [secrets.scan_text(t, secrets.Novelty()) for t in texts]
    assert len(key) == 88
    assert found == [[(at, 3, at + 88)] for at in (t.index(key) for t in texts)]
    assert secrets.scan_text(f"{key} {'w ' * 45}api key {'w ' * 45}{key}", secrets.Novelty()) == []


def test_redaction_and_odd_input(spark, odd):
    df = spark.createDataFrame([(1, "password=abcdef123 x"), (2, None)], "doc_id long, text string")
    assert [r.text for r in secrets.redact(df).orderBy("doc_id").collect()] == ["[secret] x", None]
    assert secrets.scan(odd).count() == len(ODD) and secrets.scan(no_rows(spark)).count() == 0
    assert secrets.redact(odd).columns == odd.columns


# --- queries and pipeline ----------------------------------------------------------------------------

@pytest.mark.parametrize("name", sorted(ORACLE))
def test_queries_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    df = queries()[name](spark, SF)
    columns = sorted(df.columns)
    rel = con.sql(ORACLE[name])
    at = [rel.columns.index(c) for c in columns]
    assert sorted(map(str, (tuple(r) for r in df.select(*columns).collect()))) == sorted(str(tuple(r[i] for i in at)) for r in rel.fetchall())


def test_every_query_is_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in queries()) == list(range(1, 11))


@pytest.fixture(scope="module")
def pipeline():
    import importlib.util
    import sys

    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    spec = importlib.util.spec_from_file_location("corpus_pipeline", os.path.join(root, "corpus_pipeline.py"))
    module = sys.modules.setdefault("corpus_pipeline", importlib.util.module_from_spec(spec))
    spec.loader.exec_module(module)
    return module


def test_pipeline_stages_against_brute_force(spark, pipeline):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = [" ".join(re.findall(r"[^\W_]+", r.text.lower())) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    bad = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 0").collect()}
    good = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("quality = 1").collect()}
    for name, stage in pipeline.STAGES[:-1]:
        before = {r.doc_id: r.text for r in docs.collect()}
        docs = common.stored(stage(spark, docs, SF), "stage")
        after = {r.doc_id: r.text for r in docs.collect()}
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"] and set(after) <= set(before)
        gone = set(before) - set(after)
        if name == "quality classifier":
            assert len(gone & good) <= 0.05 * len(good) and len(gone & bad) >= 0.9 * len(bad)
        elif name == "minhash near-dedup":
            assert gone == {i for i, (_, c) in groups(before, 80).items() if c != i}
        elif name == "benchmark decontamination":
            clean = {i: " ".join(re.findall(r"[^\W_]+", t.lower())) for i, t in before.items()}
            assert gone == {i for i, t in clean.items() if any(b in t for b in bench)}
        else:
            novelty = secrets.Novelty()
            assert after == {i: secrets.redacted_text(t, novelty) for i, t in before.items()}
    pieces = pipeline.STAGES[-1][1](spark, docs, SF)
    assert {r.doc_id for r in pieces.select("doc_id").collect()} == set(after)
    assert pieces.count() == pipeline.run(spark, SF).count()


def test_pipeline_odd_input(spark, odd, pipeline):
    docs = odd
    for _, stage in pipeline.STAGES[:-1]:
        docs = stage(spark, docs, SF)
        assert docs.columns == odd.columns
    assert pipeline.STAGES[-1][1](spark, docs, SF).count() > 0
    empty = no_rows(spark)
    for _, stage in pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_pipeline_judges_rows_without_a_name(spark, pipeline):
    stages = dict(pipeline.STAGES)
    text = lambda a, *end: " ".join([*(f"{a}{i}" for i in range(60)), *end])
    rows = [
        (None, text("p")), (None, text("p")), (None, text("p", "near")), (3, text("q")), (3, text("q")), (3, text("q", "near")), (9, text("q", "far")),
        (None, text("q", "copy")), (4, text("r")), (4, text("s")), (None, ""), (None, ""), (None, None), (None, text("t")),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = [tuple(r) for r in stages["minhash near-dedup"](spark, docs, SF).collect()]
    group = lambda r: (r[0] or 0, (r[1] or "")[:1])
    assert sorted(map(group, kept)) == [(0, ""), (0, ""), (0, ""), (0, "p"), (0, "t"), (3, "q"), (4, "r"), (4, "s")]
    passage = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    docs = spark.createDataFrame([(None, passage), (1, passage), (None, text("u")), (2, text("u"))], "doc_id long, text string")
    assert sorted(map(group, stages["benchmark decontamination"](spark, docs, SF).collect())) == [(0, "u"), (2, "u")]
