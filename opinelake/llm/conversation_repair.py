"""Conversation structure repair by generalised LR parsing with weighted edits.

The role initials of a conversation shall read ``(s?(ua)+)?``. ``Automaton`` builds the LR states of a role grammar; a parse keeps a
graph-structured stack, whose nodes are shared by all stacks that end alike, and its frontier maps each stack to the cheapest way to
get there: (cost, audit), the audit being the initials of the edits so far. Each row is kept, given another role or deleted, and
rows may be inserted anywhere; stacks that come out equal are merged by the smaller (cost, audit). Two audits of one cost that
consume the same rows are never one the beginning of the other, so merging loses nothing that a later row could prefer.

Because there are few different stacks, a run of rows is summed up by the best way from each stack to each. So a conversation is
parsed in as many pieces as it happens to be cut into: rows are dealt by ranges of (conversation, turn), a task parses what is
whole in it, and sums up its first and its last conversation, whose pieces are chained afterwards. No task holds more than its
range and the audit of one conversation, and the texts are moved once, to be walked through in order next to the audit.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from opinelake.llm.common import releasing, scan_tasks, stored

#: The grammar of role initials, the roles that edits may give, and what edits cost.
GRAMMAR = (("S", ""), ("S", "sT"), ("S", "T"), ("T", "Tua"), ("T", "ua"))
ROLES = {"u": "user", "a": "assistant"}
REROLE, DELETE, INSERT, TRUNCATED = 2, 3, 2, 1
LEGAL = {"su", "ua", "au"}
#: Symbols of rows: s, u, a or x for another initial, in upper case if the text is truncated; d must be deleted.
MUST_GO = "d"
SHORT = 64

Stack = tuple  # (state, stack below), the lowest has no stack below
Way = tuple[int, str]  # cost, audit


class Automaton:
    """LR(0) states of a grammar with single-character symbols, and the moves of its stacks."""

    def __init__(self, grammar: tuple[tuple[str, str], ...] = GRAMMAR, start: str = "S"):
        self.rules = (("", start), *grammar)
        self.start = start
        states, self.goto = {self._closure({(0, 0)}): 0}, {}
        todo = list(states)
        while todo:
            items = todo.pop()
            for symbol in sorted({self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}):
                to = self._closure({(r, d + 1) for r, d in items if self.rules[r][1][d : d + 1] == symbol})
                if to not in states:
                    states[to] = len(states)
                    todo.append(to)
                self.goto[states[items], symbol] = states[to]
        self.complete = {n: [r for r, d in sorted(items) if d == len(self.rules[r][1]) and r] for items, n in states.items()}
        # States in which nothing is left but one reduction: it is made at once, so that equal futures are equal stacks.
        shifting = {state for state, _ in self.goto}
        self.forced = {n: r[0] for n, r in self.complete.items() if len(r) == 1 and n not in shifting and self.rules[r[0]][0] != start}

    def _closure(self, items: set[tuple[int, int]]) -> frozenset:
        items = set(items)
        while True:
            ahead = {self.rules[r][1][d] for r, d in items if d < len(self.rules[r][1])}
            more = {(r, 0) for r, (left, _) in enumerate(self.rules) if left in ahead and left} - items
            if not more:
                return frozenset(items)
            items |= more

    def _reduced(self, stack: Stack, rule: int) -> Stack:
        left, right = self.rules[rule]
        for _ in right:
            stack = stack[1]
        return (self.goto[stack[0], left], stack)

    def _readings(self, stack: Stack) -> list[Stack]:
        """The stack and all that reductions make of it."""
        found = [stack]
        for s in found:
            found += [self._reduced(s, rule) for rule in self.complete[s[0]]]
        return found

    def shifted(self, stack: Stack, symbol: str) -> set[Stack]:
        out = set()
        for s in self._readings(stack):
            if (s[0], symbol) in self.goto:
                s = (self.goto[s[0], symbol], s)
                while s[0] in self.forced:
                    s = self._reduced(s, self.forced[s[0]])
                out.add(s)
        return out

    def accepts(self, stack: Stack) -> bool:
        return any(s[0] == self.goto[0, self.start] for s in self._readings(stack))


class Repair:
    """Cheapest edits over the stacks of an automaton."""

    def __init__(self, automaton: Automaton | None = None):
        self.lr = automaton or Automaton()
        self.root: Stack = (0, None)
        self.start = self._inserted({self.root: (0, "")})
        self.stacks = list(self.start)
        self.moves: dict[tuple[Stack, str], dict[Stack, Way]] = {}
        for stack in self.stacks:  # grows until no row leads to a new stack
            for symbol in ("s", "u", "a", "x", MUST_GO, "S", "U", "A", "X"):
                self.moves[stack, symbol] = made = self._moved(stack, symbol)
                self.stacks += [s for s in made if s not in self.stacks]
        self.number = {s: i for i, s in enumerate(self.stacks)}
        self.short = lru_cache(maxsize=1 << 15)(lambda symbols: self._whole(symbols))

    def _inserted(self, ways: dict[Stack, Way]) -> dict[Stack, Way]:
        """The frontier after any number of insertions."""
        best, todo = dict(ways), list(ways)
        while todo:
            stack = todo.pop()
            cost, audit = best[stack]
            for role in ROLES:
                for to in self.lr.shifted(stack, role):
                    way = (cost + INSERT, audit + "I")
                    if to not in best or way < best[to]:
                        best[to] = way
                        todo.append(to)
        return best

    def _moved(self, stack: Stack, symbol: str) -> dict[Stack, Way]:
        ways = [(stack, (DELETE, "D"))]
        if symbol != MUST_GO:
            late = TRUNCATED if symbol.isupper() else 0
            ways += [(to, (late, "K")) for to in self.lr.shifted(stack, symbol.lower())]
            ways += [(to, (late + REROLE, "R")) for role in ROLES for to in self.lr.shifted(stack, role)]
        best: dict[Stack, Way] = {}
        for to, way in ways:
            best[to] = min(best.get(to, way), way)
        return self._inserted(best)

    def advance(self, frontier: dict[Stack, Way], symbols: str) -> dict[Stack, Way]:
        for symbol in symbols:
            after: dict[Stack, Way] = {}
            for stack, (cost, audit) in frontier.items():
                for to, (more, edits) in self.moves[stack, symbol].items():
                    way = (cost + more, audit + edits)
                    if to not in after or way < after[to]:
                        after[to] = way
            frontier = after
        return frontier

    def summary(self, symbols: str) -> dict[Stack, dict[Stack, Way]]:
        """The best way over a run of rows from each stack to each."""
        if len(symbols) <= SHORT:
            return {s: self.advance({s: (0, "")}, symbols) for s in self.stacks}
        half = len(symbols) // 2
        left, right = self.summary(symbols[:half]), self.summary(symbols[half:])
        return {s: self.chained(ways, right) for s, ways in left.items()}

    @staticmethod
    def chained(frontier: dict[Stack, Way], over: dict[Stack, dict[Stack, Way]]) -> dict[Stack, Way]:
        after: dict[Stack, Way] = {}
        for stack, (cost, audit) in frontier.items():
            for to, (more, edits) in over[stack].items():
                way = (cost + more, audit + edits)
                if to not in after or way < after[to]:
                    after[to] = way
        return after

    def best(self, frontier: dict[Stack, Way]) -> Way:
        return min(way for stack, way in frontier.items() if self.lr.accepts(stack))

    def _whole(self, symbols: str) -> Way:
        if len(symbols) <= SHORT:
            return self.best(self.advance(self.start, symbols))
        return self.best(self.chained(self.start, self.summary(symbols)))

    def __call__(self, symbols: str) -> Way:
        """(cost, audit) of the cheapest repair of a conversation's rows."""
        return self.short(symbols) if len(symbols) <= SHORT else self._whole(symbols)

    def written(self, over: dict[Stack, dict[Stack, Way]]) -> str:
        n = self.number
        return json.dumps({n[a]: {n[b]: way for b, way in ways.items()} for a, ways in over.items()})

    def read(self, text: str) -> dict[Stack, dict[Stack, Way]]:
        s = self.stacks
        return {s[int(a)]: {s[int(b)]: tuple(way) for b, way in ways.items()} for a, ways in json.loads(text).items()}


@lru_cache(maxsize=1)
def _repair() -> Repair:
    return Repair()


# --- one row per conversation -------------------------------------------------------------------------

_SPACE = r"[\x20\x09-\x0D]"
_COUNTS = ("blank", "duplicate", "truncated", "illegal", "turns")
_ENDS = ("first_turn", "last_turn", "first_role", "last_role")
_PIECE = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int32()), *[(c, pa.int64()) for c in _COUNTS], *[(c, pa.int64()) for c in _ENDS[:2]],
    *[(c, pa.string()) for c in _ENDS[2:]], ("cost", pa.int64()), ("audit", pa.string()), ("ways", pa.string()),
])
_PIECE_SQL = (
    "conv_id long, piece int, " + ", ".join(f"{c} long" for c in (*_COUNTS, *_ENDS[:2])) + ", first_role string, last_role string, "
    "cost long, audit string, ways string"
)


class _Run:
    """Counts and symbols of consecutive rows of one conversation."""

    def __init__(self, conv_id: int | None):
        self.values = {"conv_id": conv_id, **dict.fromkeys(_COUNTS, 0), **dict.fromkeys(_ENDS)}
        self.symbols: list[str] = []

    def add(self, turn: int | None, initial: str, blank: bool, truncated: bool, later: bool, copies: int) -> None:
        v = self.values
        if not copies:
            return  # stands for a conversation without rows
        if turn is not None and turn != v["last_turn"]:
            v["turns"] += 1
            v["first_turn"] = turn if v["first_turn"] is None else v["first_turn"]
            v["last_turn"] = turn
        if v["first_role"] is None:
            v["first_role"] = initial
        else:
            v["illegal"] += v["last_role"] + initial not in LEGAL
        v["illegal"] += (copies - 1) * (initial + initial not in LEGAL)
        v["last_role"] = initial
        if blank:
            v["blank"] += copies
            self.symbols.append(MUST_GO * copies)
            return
        v["duplicate"] += copies - (not later)
        if later:
            self.symbols.append(MUST_GO * copies)
            return
        v["truncated"] += truncated
        symbol = initial if initial in ("s", "u", "a") else "x"
        self.symbols.append((symbol.upper() if truncated else symbol) + MUST_GO * (copies - 1))


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, _PIECE)


def _parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows (no piece) of the conversations inside this range, a piece for its first and its last."""
    from pyspark import TaskContext

    repair, piece = _repair(), TaskContext.get().partitionId()
    run: _Run | None = None
    first = True
    out: list[dict] = []

    def edge(run: _Run) -> dict:
        return run.values | {"piece": piece, "ways": repair.written(repair.summary("".join(run.symbols)))}

    for batch in batches:
        for conv_id, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if run is None or conv_id != run.values["conv_id"]:
                if run is not None:
                    if first:
                        out.append(edge(run))
                    else:
                        cost, audit = repair("".join(run.symbols))
                        out.append(run.values | {"cost": cost, "audit": audit})
                    first = False
                    if len(out) >= 4096:
                        yield _batch(out)
                        out = []
                run = _Run(conv_id)
            run.add(*row)
    if run is not None:
        out.append(edge(run))
        yield _batch(out)


def _chained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Finished rows from pieces sorted by conversation and place."""
    repair = _repair()
    now: dict | None = None
    frontier: dict[Stack, Way] = {}

    def done() -> dict:
        cost, audit = repair.best(frontier)
        return now | {"piece": None, "ways": None, "cost": cost, "audit": audit}

    for batch in batches:
        out: list[dict] = []
        for i in range(batch.num_rows):
            (row,) = batch.slice(i, 1).to_pylist()
            if now is None or row["conv_id"] != now["conv_id"]:
                if now is not None:
                    out.append(done())
                now, frontier = row, repair.chained(repair.start, repair.read(row["ways"]))
                continue
            frontier = repair.chained(frontier, repair.read(row["ways"]))
            for c in _COUNTS:
                now[c] += row[c]
            if row["first_role"] is not None:
                if now["last_role"] is not None:
                    now["illegal"] += now["last_role"] + row["first_role"] not in LEGAL
                else:
                    now["first_role"] = row["first_role"]
                now["last_role"] = row["last_role"]
            if row["first_turn"] is not None:
                now["turns"] -= row["first_turn"] == now["last_turn"]
                now["first_turn"] = row["first_turn"] if now["first_turn"] is None else now["first_turn"]
                now["last_turn"] = row["last_turn"]
        yield _batch(out)
    if now is not None:
        yield _batch([done()])


def _clean(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, digest; a null role or text is one space."""
    one = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), one("role").alias("role"), one("text").alias("text"))
    return rows.withColumn("digest", F.substring(F.unhex(F.sha2("text", 256)), 1, 16))


def _rank(turn: Column) -> Column:
    """Orders turns with null first, in a struct that is never null."""
    return F.struct(turn.isNotNull().alias("known"), turn.alias("turn"))


def repair(conversations: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """One row per conversation: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit.

    conversations: conv_id, turn, role, text; more columns are ignored. ids: conv_id of conversations to report also without rows:
    all counts zero and an empty audit. Rows are taken by turn, nulls first; rows of one turn by role and then by a digest of the
    text. A null role or text is one space; rows with a null conv_id are a conversation of their own. A row's first fault counts:
    blank, duplicate (role and text seen earlier), truncated (no end of sentence). gaps are the turns missing between the least
    and the greatest. Repeated rows are duplicates. An empty table gives an empty result.
    """
    spark = conversations.sparkSession
    rows = _clean(conversations).select(
        "conv_id", "turn", "role", "digest", F.lit(1).alias("copies"),
        (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), (~F.col("text").rlike(rf"[.!?]{_SPACE}*\z")).alias("truncated"),
    )
    if ids is not None:
        absent = ids.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
        rows = rows.unionByName(absent.select(
            "conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit(None).cast("binary").alias("digest"),
            F.lit(0).alias("copies"), F.lit(True).alias("blank"), F.lit(False).alias("truncated"),
        ))
    slim = stored(
        rows.groupBy("conv_id", "turn", "role", "digest").agg(F.sum("copies").alias("copies"), F.max("blank").alias("blank"), F.max("truncated").alias("truncated")),
        "turns",
    )
    again = slim.filter("NOT blank").groupBy("conv_id", "role", "digest").agg(F.min(_rank(F.col("turn"))).alias("first"), F.count("*").alias("n")).filter("n > 1")
    again = again.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d"), "first")
    same = slim["conv_id"].eqNullSafe(again["c"]) & (slim["role"] == again["r"]) & (slim["digest"] == again["d"])
    flagged = slim.join(again, same, "left").select(
        "conv_id", "turn", "role", "digest", "blank", "truncated", F.coalesce(_rank(F.col("turn")) > F.col("first"), F.lit(False)).alias("later"), "copies"
    )
    order = ("conv_id", "turn", "role", "digest")
    dealt = flagged.repartitionByRange(scan_tasks(spark), *order).sortWithinPartitions(*order)
    slimmer = dealt.select("conv_id", "turn", F.substring("role", 1, 1).alias("initial"), "blank", "truncated", "later", "copies")
    pieces = stored(slimmer.mapInArrow(releasing(_parsed), _PIECE_SQL), "pieces")
    edges = pieces.filter("piece IS NOT NULL").repartition(scan_tasks(spark), "conv_id").sortWithinPartitions("conv_id", "piece")
    whole = pieces.filter("piece IS NULL").unionByName(edges.mapInArrow(releasing(_chained), _PIECE_SQL))
    gaps = F.when(F.col("turns") > 0, F.col("last_turn") - F.col("first_turn") + 1 - F.col("turns")).otherwise(F.lit(0))
    return whole.select("conv_id", gaps.cast("long").alias("gaps"), "blank", "duplicate", "truncated", "illegal", "cost", "audit")


# --- repaired rows -------------------------------------------------------------------------------------

_FACTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """("begin", conversation's row), then ("row", edit, role, text) for each repaired row, then ("end",), for each conversation."""
    facts: dict | None = None
    audit, at, left, place = "", 0, 0, 0

    def put(role: str | None, text: str) -> tuple:
        nonlocal place
        edit = audit[at]
        if edit == "I" or edit == "R":  # the initials read (s?(ua)+)?, so the place tells the role
            role = ROLES["ua"[(place - left % 2) % 2]]
        place += 1
        return ("row", edit, role, text)

    def inserted() -> Iterator[tuple]:
        nonlocal at
        while at < len(audit) and audit[at] == "I":
            yield put(None, "")
            at += 1

    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            for r in batch.slice(start, 1024).to_pylist():
                if r["audit"] is not None:
                    if facts is not None:
                        yield from inserted()
                        yield ("end",)
                    facts, audit, at, place = r, r["audit"], 0, 0
                    left = len(audit) - audit.count("D")
                    yield ("begin", r)
                    continue
                yield from inserted()
                if audit[at] != "D":
                    yield put(r["role"], r["text"])
                at += 1
    if facts is not None:
        yield from inserted()
        yield ("end",)


def _walked(conversations: DataFrame, result: DataFrame) -> DataFrame:
    """Each conversation's row of ``result``, then its rows in order, in one partition."""
    rows = _clean(conversations)
    heads = result.select("conv_id", *_FACTS, "audit")
    both = heads.unionByName(rows, allowMissingColumns=True).withColumn("body", F.col("audit").isNull())
    order = ("conv_id", "body", "turn", "role", "digest")
    dealt = both.repartition(scan_tasks(conversations.sparkSession), "conv_id").sortWithinPartitions(*order)
    return dealt.select("conv_id", *_FACTS, "audit", "role", "text")


def repaired_rows(conversations: DataFrame, result: DataFrame) -> DataFrame:
    """conv_id, position (from 1), edit (K, R or I), role and text of the repaired conversations; ``result`` is that of ``repair``.

    The rows of a conversation are in order in one partition. Its texts are walked through one by one, never held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("position", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        out: list[tuple] = []
        conv_id, position, size = None, 0, 0
        for what, *x in _walk(batches):
            if what == "begin":
                conv_id, position = x[0]["conv_id"], 0
            elif what == "row":
                position += 1
                out.append((conv_id, position, *x))
                size += len(x[2])
                if len(out) >= 4096 or size > 1 << 22:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
                    out, size = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)

    return _walked(conversations, result).mapInArrow(releasing(run), "conv_id long, position long, edit string, role string, text string")


def repaired_digests(conversations: DataFrame, result: DataFrame) -> DataFrame:
    """``result`` with repaired_sha256: of the repaired rows as ``role:text``, joined by line breaks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), *[(c, pa.int64()) for c in _FACTS], ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out: list[dict] = []
        facts, digest, first = {}, None, True
        for what, *x in _walk(batches):
            if what == "begin":
                facts, digest, first = x[0], hashlib.sha256(), True
            elif what == "row":
                digest.update(f"{'' if first else chr(10)}{x[1]}:{x[2]}".encode("utf-8", "surrogatepass"))
                first = False
            else:
                out.append({**facts, "repaired_sha256": digest.hexdigest()})
                if len(out) >= 4096:
                    yield pa.RecordBatch.from_pylist(out, schema)
                    out = []
        if out:
            yield pa.RecordBatch.from_pylist(out, schema)

    facts = ", ".join(f"{c} long" for c in _FACTS)
    return _walked(conversations, result).mapInArrow(releasing(run), f"conv_id long, {facts}, audit string, repaired_sha256 string")
