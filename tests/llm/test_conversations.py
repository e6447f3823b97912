"""Conversation repair against exhaustive search and a plain shortest path."""

from __future__ import annotations

import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from opinelake.llm import conversation_repair as cr
from opinelake.llm import queries

SPACE = " \t\n\x0b\x0c\r"
ROLE = {"u": "user", "a": "assistant"}


def facts(rows):
    """Faults of rows (turn, role, text) in order, and symbols (initial, must go, truncated)."""
    seen, out, n = set(), [], {"blank": 0, "duplicate": 0, "truncated": 0}
    for _, role, text in rows:
        body = text.strip(SPACE)
        fault = "blank" if not body else "duplicate" if (role, text) in seen else "truncated" if body[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            n[fault] += 1
        out.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    turns = [t for t, _, _ in rows if t is not None]
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows, rows[1:])]
    n["illegal"] = sum(p not in ("su", "ua", "au") for p in pairs)
    n["gaps"] = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return n, out


def legal(length):
    """The one sequence of initials of a length, or None."""
    if length == 0:
        return ""
    if length % 2:
        return "s" + "ua" * (length // 2) if length > 1 else None
    return "ua" * (length // 2)


def brute(rows):
    """(cost, audit, repaired rows): for each length of the result, the cheapest path over (row, place)."""
    n, symbols = facts(rows)
    best = None
    for length in range(len(rows) + 4):
        goal = legal(length)
        if goal is None:
            continue
        at = {(0, 0): (0, "")}
        for i in range(len(rows) + 1):
            for j in range(length + 1):
                if (i, j) not in at:
                    continue
                cost, audit = at[i, j]
                steps = []
                if j < length and goal[j] in ROLE:
                    steps.append((i, j + 1, 2, "I"))
                if i < len(rows):
                    initial, must, late = symbols[i]
                    steps.append((i + 1, j, 3, "D"))
                    if j < length and not must:
                        if initial == goal[j]:
                            steps.append((i + 1, j + 1, late, "K"))
                        if goal[j] in ROLE:
                            steps.append((i + 1, j + 1, 2 + late, "R"))
                for x, y, c, e in steps:
                    way = (cost + c, audit + e)
                    if (x, y) not in at or way < at[x, y]:
                        at[x, y] = way
        way = at.get((len(rows), length))
        if way and (best is None or way < best):
            best = way
    cost, audit = best
    goal = legal(len(audit) - audit.count("D"))
    out, i, j = [], 0, 0
    for e in audit:
        if e == "I":
            out.append(f"{ROLE[goal[j]]}:")
        elif e != "D":
            out.append(f"{rows[i][1] if e == 'K' else ROLE[goal[j]]}:{rows[i][2]}")
        j += e != "D"
        i += e != "I"
    return n | {"cost": cost, "audit": audit, "repaired_sha256": hashlib.sha256("\n".join(out).encode()).hexdigest()}


def order(row):
    turn, role, text = row
    return (turn is not None, turn or 0, role, hashlib.sha256(text.encode()).digest()[:16])


def check(rows, ids, got):
    groups = defaultdict(list)
    for c, t, r, x in rows:
        groups[c].append((t, " " if r is None else r, " " if x is None else x))
    empty = {**dict.fromkeys(("blank", "duplicate", "truncated", "illegal", "gaps", "cost"), 0), "audit": "", "repaired_sha256": hashlib.sha256().hexdigest()}
    want = {c: brute(sorted(groups[c], key=order)) if groups[c] else empty for c in set(ids)}
    assert len(got) == len(want)
    for r in got:
        assert {k: r[k] for k in empty} == want[r["conv_id"]], r["conv_id"]


def _rows(rng, n, longest):
    roles = ["user", "assistant", "system", "user", "assistant", "tool", "", None, "underling"]
    texts = ["Yes.", "No", " ", "", None, "Why?\n", "end. then", "So!", "x.\x0b ", "\x1f", "a.", "b.", "c."]
    out = []
    for c in range(n):
        for t in range(rng.integers(1, longest)):
            alike = t % 2 if rng.random() < 0.6 else None
            role = roles[rng.integers(0, 9)] if alike is None else ("user", "assistant")[alike]
            text = texts[rng.integers(0, 13)] if rng.random() < 0.5 else f"text {t} of {c}."
            turn = None if rng.random() < 0.05 else int(t + (rng.random() < 0.1) * rng.integers(-2, 3))
            out.append((None if c == 3 else c, turn, role, text))
            if rng.random() < 0.1:
                out.append(out[-1])
    return out


@pytest.mark.parametrize("longest", [7, 60])
def test_repair_against_shortest_path(spark, longest):
    rows = _rows(np.random.default_rng(longest), 150 if longest < 10 else 25, longest)
    ids = [r[0] for r in rows] + [900, 901]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, piece int").repartition(5)
    named = spark.createDataFrame([(i,) for i in ids], "conv_id long")
    result = cr.repair(df, named)
    check(rows, ids, cr.repaired_digests(df, result).collect())
    out = cr.repaired_rows(df, result).collect()
    assert {r["edit"] for r in out} == {"K", "R", "I"}
    initials = defaultdict(str)
    for r in sorted(out, key=lambda r: (r["conv_id"] or -1, r["position"])):
        initials[r["conv_id"]] += r["role"][:1]
    assert all(v == legal(len(v)) for v in initials.values())


def test_one_conversation_over_many_partitions(spark):
    """A hot conversation is parsed in pieces; the result is that of one run."""
    rng = np.random.default_rng(4)
    rows = [(1, t, ["user", "assistant", "system"][rng.choice(3, p=[0.48, 0.48, 0.04])], f"t {rng.integers(0, 60)}" + "." * int(rng.integers(0, 2))) for t in range(90)]
    rows += [(c, t, "user", "hm.") for c in (0, 2, 3) for t in range(2)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(6)
    result = cr.repair(df)
    check(rows, [r[0] for r in rows], cr.repaired_digests(df, result).collect())


def test_summaries_chain():
    repair, rng = cr._repair(), np.random.default_rng(2)
    for _ in range(30):
        s = "".join(rng.choice(list("suaxdSUAX"), 40))
        whole = repair.best(repair.advance(repair.start, s))
        parts = repair.start
        for at in range(0, 40, 7):
            parts = repair.chained(parts, repair.read(repair.written(repair.summary(s[at : at + 7]))))
        assert repair.best(parts) == whole
    assert len(repair.stacks) == 8


def test_long_texts_and_empty_table(spark):
    rows = [(1, 0, "user", "word " * 400_000 + "."), (1, 1, "assistant", "x" * 1_000_000)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    check(rows, [1], cr.repaired_digests(df, cr.repair(df)).collect())
    none = df.limit(0)
    assert cr.repaired_digests(none, cr.repair(none)).collect() == []


def test_query_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    out = []
    for c, t, r, x in rows:
        r, x = " " if r is None else r, " " if x is None else x
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if kind == 1 else "".join(k for k in x if k not in ".!?") if kind == 2 else x
        out += [(c, t, "user" if kind == 4 else r, x)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    check(out, [r[0] for r in rows], queries.op11_glr_conversation_repair(spark, sf).collect())
