"""Repair of conversations as lightest derivations, found with Knuth's agenda.

A repaired conversation has role initials ``(s?(ua)+)?``. An item (i, p) says that the
first i rows are edited and the initials so far lead to state p; the deductions are
Keep, Rerole, Delete of row i with its axiom, and Insert. Items have values (cost,
audit), and every deduction is a superior function of them: it never lowers a value and
keeps their order, as audits of one item that cost the same differ before either ends.
So items leave the agenda with their final value, until a goal item does.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from heapq import heappop, heappush

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from trackloom.llm.words import SPACES

# States: nothing yet, after s, after u, after a. A conversation may end in GOALS.
STATES = range(4)
NEXT = {(0, "s"): 1, (0, "u"): 2, (1, "u"): 2, (3, "u"): 2, (2, "a"): 3}
GOALS = (0, 3)
REROLE = INSERT = 2
DELETE = 3
# Steps that are solved together, and blocks of them that are joined to a longer one.
FRAGMENT, FAN = 256, 8
MISSING = " "

# Fields that describe a fragment of a conversation besides its steps.
_SUMS = ("blank", "duplicate", "truncated", "illegal")
_STEP = pa.struct({"initial": pa.string(), "kind": pa.string(), "n": pa.int64()})
_SPAN = pa.struct({"p": pa.int32(), "q": pa.int32(), "cost": pa.int64(), "audit": pa.string()})
FRAGMENTS = pa.schema({
    **dict.fromkeys(("conv", "part", "piece", "low", "high", "turns"), pa.int64()), "first": pa.string(),
    "last": pa.string(), **dict.fromkeys(_SUMS, pa.int64()), "steps": pa.list_(_STEP), "spans": pa.list_(_SPAN)})
REPAIRS = pa.schema({"conv": pa.int64(), "gaps": pa.int64(), **dict.fromkeys(_SUMS, pa.int64()),
                     "cost": pa.int64(), "audit": pa.string()})
HASHES = pa.schema({"conv": pa.int64(), "repaired_sha256": pa.string()})


def inserted(state: int) -> str:
    """The initial that may follow a state and be inserted or given to a row."""
    return "a" if state == 2 else "u"


def step(initial: str, kind: str, n: int) -> dict[int, list[tuple[int, int, str]]]:
    """The deductions over one row from every state: (state, cost, edits).

    ``kind`` is D for a run of n rows that have to go, T for a truncated row, K for any
    other. Between rows of a run nothing need be inserted: deletions come first in ASCII.
    """
    if kind == "D":
        return {p: [(p, DELETE * n, "D" * n)] for p in STATES}
    late = int(kind == "T")
    ways: dict[int, list[tuple[int, int, str]]] = {}
    for p in STATES:
        ways[p] = [(p, DELETE, "D"), (NEXT[p, inserted(p)], REROLE + late, "R")]
        if (p, initial) in NEXT:
            ways[p].append((NEXT[p, initial], late, "K"))
    return ways


def lightest(steps: list, start: int, goals: tuple[int, ...] = ()) -> dict[int, tuple[int, str]]:
    """Least (cost, audit) to get over all steps from a state, for each state at the end;
    with ``goals`` only that of the first goal that becomes final."""
    agenda, final, found = [(0, "", 0, start)], set(), {}
    while agenda:
        cost, audit, i, p = heappop(agenda)
        if (i, p) in final:
            continue
        final.add((i, p))
        if i == len(steps):
            if not goals:
                found[p] = (cost, audit)
            elif p in goals:
                return {p: (cost, audit)}
        else:
            for q, weight, edits in steps[i][p]:
                if (i + 1, q) not in final:
                    heappush(agenda, (cost + weight, audit + edits, i + 1, q))
        q = NEXT[p, inserted(p)]
        if (i, q) not in final:
            heappush(agenda, (cost + INSERT, audit + "I", i, q))
    return found


def block(steps: list) -> dict[int, list[tuple[int, int, str]]]:
    """All steps as one, from every state to every state."""
    return {p: [(q, *value) for q, value in lightest(steps, p).items()] for p in STATES}


class Folding:
    """Blocks of one conversation in order, joined FAN at a time on each level, so that a
    conversation of n rows takes O(n log n) time and a few copies of its audit."""

    def __init__(self):
        self.levels: list[list] = [[]]

    def add(self, one: dict) -> None:
        for level in range(len(self.levels) + 1):
            if level == len(self.levels):
                self.levels.append([])
            self.levels[level].append(one)
            if len(self.levels[level]) < FAN:
                return
            one, self.levels[level] = block(self.levels[level]), []

    def best(self) -> tuple[int, str]:
        steps = [one for level in reversed(self.levels) for one in level]
        (value,) = lightest(steps, 0, GOALS).values()
        return value


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for begin in range(0, batch.num_rows, 1024):
            yield from zip(*(c.to_pylist() for c in batch.slice(begin, 1024).columns))


def _batches(rows: Iterator[dict], schema: pa.Schema, size: int = 256) -> Iterator[pa.RecordBatch]:
    held = []
    for row in rows:
        held.append(row)
        if len(held) == size:
            yield pa.RecordBatch.from_pylist(held, schema)
            held = []
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


def _fragments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted lines (conv, turn, initial, kind, n, blanks, duplicates) to fragments."""

    def pieces():
        from pyspark import TaskContext

        part, piece, now = TaskContext.get().partitionId(), 0, None

        def closed() -> dict:
            # A full fragment is solved here, wherever its conversation goes on.
            if len(now["steps"]) >= FRAGMENT:
                solved = block([step(*s.values()) for s in now["steps"]])
                now["spans"] = [dict(p=p, q=q, cost=c, audit=a) for p in solved for q, c, a in solved[p]]
                now["steps"] = []
            return now

        for conv, turn, initial, kind, n, blanks, duplicates in _rows(batches):
            if now is None or now["conv"] != conv or len(now["steps"]) >= FRAGMENT:
                if now is not None:
                    yield closed()
                piece += 1
                now = dict(conv=conv, part=part, piece=piece, low=None, high=None, turns=0, first=None,
                           last=None, steps=[], spans=[], **dict.fromkeys(_SUMS, 0))
            if not n:
                continue
            if turn is not None and turn != now["high"]:
                now["low"] = turn if now["low"] is None else now["low"]
                now["high"] = turn
                now["turns"] += 1
            if now["first"] is None:
                now["first"] = initial
            else:
                now["illegal"] += now["last"] + initial not in ("su", "ua", "au")
            now["illegal"] += (n - 1) * (initial * 2 not in ("su", "ua", "au"))
            now["last"] = initial
            now["blank"] += blanks
            now["duplicate"] += duplicates
            now["truncated"] += kind == "T"
            if kind != "D":
                now["steps"].append(dict(initial=initial, kind=kind, n=1))
                n -= 1
            if n:
                now["steps"].append(dict(initial=initial, kind="D", n=n))
        if now is not None:
            yield closed()

    return _batches(pieces(), FRAGMENTS)


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From sorted fragments to one row for each conversation."""

    def repaired():
        now, steps, folding = None, [], None

        def closed() -> dict:
            if folding is None:
                (value,) = lightest(steps, 0, GOALS).values()
            else:
                value = folding.best()
            gaps = now["high"] - now["low"] + 1 - now["turns"] if now["turns"] else 0
            return dict(conv=now["conv"], gaps=gaps, cost=value[0], audit=value[1], **{s: now[s] for s in _SUMS})

        for row in _rows(batches):
            piece = dict(zip(FRAGMENTS.names, row))
            known = [step(*s.values()) for s in piece["steps"]]
            if now is None or now["conv"] != piece["conv"]:
                if now is not None:
                    yield closed()
                now, steps, folding = piece, known, None
                if piece["spans"]:
                    folding = Folding()
            else:
                if folding is None:
                    folding = Folding()
                    folding.add(block(steps))
                for s in _SUMS:
                    now[s] += piece[s]
                if piece["first"] is not None:
                    if now["last"] is not None:
                        now["illegal"] += now["last"] + piece["first"] not in ("su", "ua", "au")
                    now["last"] = piece["last"]
                if piece["turns"]:
                    now["turns"] += piece["turns"] - (now["high"] == piece["low"])
                    now["low"] = piece["low"] if now["low"] is None else now["low"]
                    now["high"] = piece["high"]
                if not piece["spans"]:
                    folding.add(block(known))
            if piece["spans"]:
                solved = {p: [] for p in STATES}
                for span in piece["spans"]:
                    solved[span["p"]].append((span["q"], span["cost"], span["audit"]))
                folding.add(solved)
        if now is not None:
            yield closed()

    return _batches(repaired(), REPAIRS)


class Writer:
    """Follows the audit of one conversation and digests what its edits leave."""

    def __init__(self, conv, audit):
        self.conv, self.audit, self.at, self.state = conv, audit, 0, 0
        self.digest, self.lines = hashlib.sha256(), 0

    def line(self, role: str, text: str, initial: str) -> None:
        self.digest.update(("\n" if self.lines else "").encode() + f"{role}:{text}".encode())
        self.lines += 1
        self.state = NEXT[self.state, initial]

    def new(self, text: str = "") -> None:
        initial = inserted(self.state)
        self.line({"u": "user", "a": "assistant"}[initial], text, initial)

    def inserts(self) -> None:
        while self.audit[self.at:self.at + 1] == "I":
            self.at += 1
            self.new()

    def row(self, role: str, text: str) -> None:
        self.inserts()
        edit = self.audit[self.at]
        self.at += 1
        if edit == "K":
            self.line(role, text, role[:1])
        elif edit == "R":
            self.new(text)

    def closed(self) -> dict:
        self.inserts()
        return dict(conv=self.conv, repaired_sha256=self.digest.hexdigest())


def _hashes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """From rows (conv, audit, role, text, n), sorted with the audit of each conversation
    first, to (conv, digest of the repaired rows)."""

    def hashed():
        now = None
        for conv, audit, role, text, n in _rows(batches):
            if audit is not None:
                if now is not None:
                    yield now.closed()
                now = Writer(conv, audit)
            else:
                for _ in range(n):
                    now.row(role, text)
        if now is not None:
            yield now.closed()

    return _batches(hashed(), HASHES)


def damaged(rows: DataFrame) -> DataFrame:
    """Rows (conv, turn, role, text, n) of a table (conv_id, turn, role, text) after damage
    drawn by crc32 of ``conv_id:turn``: dropped (n = 0), emptied, stripped of sentence
    ends, repeated (n = 2) or given to the user. Nulls are one space, but for conv and turn themselves."""
    conv, turn = F.col("conv_id").cast("long"), F.col("turn").cast("long")
    name = F.concat(*[F.coalesce(c.cast("string"), F.lit(MISSING)) for c in (conv, F.lit(":"), turn)])
    role, text = F.coalesce("role", F.lit(MISSING)), F.coalesce("text", F.lit(MISSING))
    drawn = rows.select(conv.alias("conv"), turn.alias("turn"), role.alias("role"), text.alias("text"),
                        F.pmod(F.crc32(name), F.lit(20)).alias("draw"))
    draw = F.col("draw")
    text = F.when(draw.isin(0, 1), "").when(draw == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    return drawn.select(
        "conv", "turn", F.when(draw == 0, "").when(draw == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), F.when(draw == 0, 0).when(draw == 3, 2).otherwise(1).cast("long").alias("n"))


def _digest(text: str) -> Column:
    return F.unhex(F.sha2(F.col(text), 256))


def repair_conversations(rows: DataFrame) -> DataFrame:
    """Least-cost repair of rows (conv, turn, role, text, n): conv, gaps, blank, duplicate,
    truncated, illegal, cost, audit, repaired_sha256; one row per conv, null included.

    Rows of a conversation follow each other by turn, nulls first, then by role and
    digest of the text; n says how often a row stands there, 0 only names the conv. A
    row's first fault counts: no character but white space; role and text seen before; a
    last character other than ``.!?``. A row without an initial, or with another than s,
    u, a, can be kept in no place. An empty table gives an empty result; other columns
    are ignored.

    Texts take no part in the search: digests of equal rows are combined, found again by
    a join that can be split, and dealt in ranges, so one conversation may fill many
    tasks. Each solves fragments of FRAGMENT steps; only those are brought together. The
    last pass reads texts once, in order: SHA-256 of one conversation is a chain, which
    its task streams without holding it.
    """
    trimmed = F.rtrim(F.col("text"), F.lit(SPACES.decode()))
    lines = rows.select(
        "conv", "turn", "role", _digest("text").alias("digest"), "n", (trimmed == "").alias("empty"),
        (~F.right(trimmed, F.lit(1)).isin(".", "!", "?")).alias("cut"))
    lines = lines.groupBy("conv", "turn", "role", "digest").agg(
        F.sum("n").alias("n"), F.first("empty").alias("empty"), F.first("cut").alias("cut"))
    place = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    seen = lines.filter("n > 0 AND NOT empty").groupBy(
        F.col("conv").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(F.min(place).alias("seen"))
    found = lines.join(seen, F.col("conv").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r"))
                       & (F.col("digest") == F.col("d")), "left")
    again = (F.col("seen") != place)
    kind = F.when(F.col("empty") | again, "D").when(F.col("cut"), "T").otherwise("K")
    repeats = F.when(F.col("empty"), 0).otherwise(F.when(again, F.col("n")).otherwise(F.greatest(F.col("n") - 1, F.lit(0))))
    order = ("conv", "turn", "role", "digest")
    found = found.select(*order, F.left("role", F.lit(1)).alias("initial"), kind.alias("kind"), "n",
                         F.when(F.col("empty"), F.col("n")).otherwise(0).alias("blanks"), repeats.alias("repeats"))
    ranged = found.repartitionByRange(*order).sortWithinPartitions(*order)
    pieces = ranged.select("conv", "turn", "initial", "kind", "n", "blanks", "repeats").mapInArrow(
        _fragments, from_arrow_schema(FRAGMENTS))
    gathered = pieces.repartition("conv").sortWithinPartitions("conv", "part", "piece")
    repairs = gathered.mapInArrow(_repairs, from_arrow_schema(REPAIRS))

    nothing = F.lit(None).cast("string")
    texts = rows.filter("n > 0").select("conv", nothing.alias("audit"), "turn", "role", _digest("text").alias("digest"),
                                        "text", "n")
    heads = repairs.select("conv", "audit", F.lit(None).cast("long").alias("turn"), nothing.alias("role"),
                           F.lit(None).cast("binary").alias("digest"), nothing.alias("text"), F.lit(0).cast("long").alias("n"))
    both = texts.unionByName(heads).repartition("conv").sortWithinPartitions(
        "conv", F.col("audit").isNull(), "turn", "role", "digest")
    hashes = both.select("conv", "audit", "role", "text", "n").mapInArrow(
        _hashes, from_arrow_schema(HASHES))
    hashes = hashes.withColumnRenamed("conv", "c")
    return repairs.join(hashes, F.col("conv").eqNullSafe(F.col("c"))).drop("c")

