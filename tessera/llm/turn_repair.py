"""Cheapest repair of conversations by A* on the edit lattice.

A conversation's rows are read by turn.  A row's first fault is ``blank`` (no
character but white space), ``duplicate`` (role and text seen earlier) or
``truncated`` (no end mark last).  Edits: keep a row (0), give it the role user or
assistant (1), delete it (2; blank and duplicate rows must go), insert an empty
turn (5); a truncated row that stays costs 5 more.  The roles must then read
``(s?(ua)+)?`` by their initials.

The lattice's nodes are (rows read, state of that pattern).  The search takes
nodes from a heap keyed (cost so far + least cost of the rest, audit so far): the
rest costs at least 2 for each row that must go and for each truncated row (the
cheaper of deleting and keeping it), as suffix sums.  That bound never falls by
more than an edge costs, and no audit of one node and cost is the start of
another, so the first path that reaches the end is the cheapest and, among
those, the one whose audit is least.

A conversation of up to ``MOST_ROWS`` rows (rows are counted first) is repaired
by the task that has it.  A longer one is never gathered: its rows are sorted over
range partitions, repeated rows are found by grouping, every piece of 2**``PIECE_BITS``
rows becomes a table of its cheapest paths between the pattern's four states, and
tables of neighbouring pieces are joined in pairs.  Only its audit, one character
a row, and the running hash of its text (which SHA-256 allows in order alone) go
through one task, as a stream.

Rows: a null conv_id is a conversation of its own; null turns come first; null
role and text are one space.  Rows of one turn are ordered by role, then text;
rows alike in all are each other's duplicates.  Roles beyond system, user and
assistant go by their first character.  Extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
from functools import lru_cache
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch, lean, small_batches

BLANK, DUPLICATE, TRUNCATED, FINE = "b", "d", "t", "f"
#: States of the pattern, and what each initial leads to.
START, SYSTEM, USER, ASSISTANT = range(4)
NEXT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
WHOLE = (START, ASSISTANT)
ROLES = {"u": "user", "a": "assistant"}
RE_ROLE, DELETE, INSERT, CUT = 1, 2, 5, 5
LEGAL = {"su", "ua", "au"}
#: Rows of a conversation that one task reads whole, and of a piece of a longer one.
MOST_ROWS = 10_000
PIECE_BITS = 10

WHITE = " \t\n\v\f\r"
_NOT_WHITE = r"[^\x20\x09-\x0D]"


# The search ---------------------------------------------------------------


def search(rows: tuple[tuple[str, str, int], ...], entry: int, exits: tuple[int, ...], every: bool = False) -> dict[int, tuple[int, str]]:
    """(cost, audit) of the cheapest path over all rows (fault, initial, times) from a state to an exit.

    ``every``: one path for each exit; else the best alone.
    """
    n = len(rows)
    rest = [0] * (n + 1)
    for i in range(n - 1, -1, -1):
        fault, _, times = rows[i]
        rest[i] = rest[i + 1] + (DELETE * times if fault in (BLANK, DUPLICATE) else min(DELETE, CUT) if fault == TRUNCATED else 0)
    heap, done, found = [(rest[0], "", 0, entry)], set(), {}
    while heap:
        bound, audit, i, state = heapq.heappop(heap)
        if (i, state) in done:
            continue
        done.add((i, state))
        cost = bound - rest[i]
        if i == n and state in exits:
            found[state] = cost, audit
            if not every or len(found) == len(exits):
                return found
        edits = [(INSERT, "I", i, NEXT[state][x]) for x in ROLES if x in NEXT[state]]
        if i < n:
            fault, initial, times = rows[i]
            edits.append((DELETE * times, "D" * times, i + 1, state))
            if fault not in (BLANK, DUPLICATE):
                extra = CUT if fault == TRUNCATED else 0
                if initial in NEXT[state]:
                    edits.append((extra, "K", i + 1, NEXT[state][initial]))
                edits += [(extra + RE_ROLE, "R", i + 1, NEXT[state][x]) for x in ROLES if x in NEXT[state]]
        for price, letter, j, to in edits:
            if (j, to) not in done:
                heapq.heappush(heap, (cost + price + rest[j], audit + letter, j, to))
    return found


@lru_cache(100_000)
def cheapest(rows: tuple[tuple[str, str, int], ...]) -> tuple[int, str]:
    """Cost and audit of a whole conversation; deleting everything is always possible."""
    return min(search(rows, START, WHOLE).values())


Paths = dict[tuple[int, int], tuple[int, str]]


def paths(rows) -> Paths:
    """The cheapest path of a piece between any two states."""
    return {(a, b): p for a in range(4) for b, p in search(rows, a, (START, SYSTEM, USER, ASSISTANT), True).items()}


def joined(left: Paths, right: Paths) -> Paths:
    out: Paths = {}
    for (a, m), (cost, audit) in left.items():
        for (k, b), (more, end) in right.items():
            if k == m and ((a, b) not in out or (cost + more) <= out[a, b][0]):
                both = cost + more, audit + end
                if (a, b) not in out or both < out[a, b]:
                    out[a, b] = both
    return out


class Editor:
    """Applies an audit to rows as they come."""

    def __init__(self, audit: str):
        self.audit, self.at, self.state = audit, 0, START

    def _inserted(self):
        while self.audit[self.at : self.at + 1] == "I":
            x = next(x for x in ROLES if x in NEXT[self.state])
            self.at, self.state = self.at + 1, NEXT[self.state][x]
            yield "insert", ROLES[x], ""

    def row(self, role: str, text: str):
        """(edit, role, text) of the inserted turns before a row and of the row itself."""
        yield from self._inserted()
        letter, self.at = self.audit[self.at], self.at + 1
        if letter == "K":
            self.state = NEXT[self.state][role[:1]]
            yield "keep", role, text
        elif letter == "R":
            x = next(x for x in ROLES if x in NEXT[self.state])
            self.state = NEXT[self.state][x]
            yield "rerole", ROLES[x], text
        else:
            yield "delete", role, text

    end = _inserted


class Turns:
    """SHA-256 of the repaired ``role:text`` lines, as they come."""

    def __init__(self):
        self.hash, self.none = hashlib.sha256(), True

    def add(self, edits) -> None:
        for edit, role, text in edits:
            if edit != "delete":
                self.hash.update(f"{'' if self.none else chr(10)}{role}:{text}".encode("utf-8", "surrogatepass"))
                self.none = False


# Conversations of a bounded number of rows ---------------------------------

COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
SUMMARY = "conv_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", audit string, repaired_sha256 string"
REPAIRED = "conv_id long, place long, edit string, role string, text string"


def fault_of(role: str, text: str, seen: set) -> str:
    solid = text.strip(WHITE)
    if not solid:
        return BLANK
    if (role, text) in seen:
        return DUPLICATE
    seen.add((role, text))
    return FINE if solid[-1] in ".!?" else TRUNCATED


def _conversations(batches):
    """(conv_id, [(turn, role, text)]) of rows that are sorted by conversation."""
    rows = (r for b in batches for r in zip(*(b.column(k).to_pylist() for k in range(4))))
    for conv_id, group in groupby(rows, key=lambda r: r[0]):
        yield conv_id, [r[1:] for r in group]


def _gaps(turns) -> int:
    known = {t for t in turns if t is not None}
    return max(known) - min(known) + 1 - len(known) if known else 0


def _record(rows) -> tuple[tuple, list[str]]:
    """The search's rows and each one's fault."""
    seen: set = set()
    faults = [fault_of(role, text, seen) for _, role, text in rows]
    return tuple((f, role[:1], 1) for f, (_, role, _) in zip(faults, rows)), faults


def _summaries(batches):
    schema = pa.schema([("conv_id", pa.int64()), *((c, pa.int64()) for c in COUNTS), ("audit", pa.string()), ("repaired_sha256", pa.string())])
    out = []
    for conv_id, rows in _conversations(batches):
        record, faults = _record(rows)
        cost, audit = cheapest(record)
        turns, editor = Turns(), Editor(audit)
        for _, role, text in rows:
            turns.add(editor.row(role, text))
        turns.add(editor.end())
        illegal = sum(a[1] + b[1] not in LEGAL for a, b in zip(record, record[1:]))
        out.append((conv_id, _gaps(r[0] for r in rows), faults.count(BLANK), faults.count(DUPLICATE), faults.count(TRUNCATED), illegal, cost, audit, turns.hash.hexdigest()))
        if len(out) == 2000:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)
            out = []
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out), schema)], schema=schema)


def _edits(batches):
    schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    for conv_id, rows in _conversations(batches):
        editor = Editor(cheapest(_record(rows)[0])[1])
        edits = [e for _, role, text in rows for e in editor.row(role, text)] + list(editor.end())
        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "place": i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(edits)], schema=schema)


# Longer conversations -------------------------------------------------------

def _order() -> list[Column]:
    return [F.asc_nulls_first("conv_id"), F.asc_nulls_first("turn"), F.asc("role")]



def _sorted(turns: DataFrame, scratch: Scratch) -> DataFrame:
    """part and seq order all rows; rows alike in everything are one row with ``times``."""
    n = int(turns.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    same = turns.groupBy("conv_id", "turn", "role", "text").agg(F.count("*").alias("times"))
    dealt = same.repartitionByRange(n, *_order(), F.substring("text", 1, 256)).sortWithinPartitions(*_order(), "text")
    return scratch.table(dealt.withColumns({"part": F.spark_partition_id(), "seq": F.monotonically_increasing_id()}), "sorted")


def _labelled(rows: DataFrame) -> DataFrame:
    """conv_id, part, seq, turn, times, initial, and the fault of a row's first copy."""
    what = F.md5(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"))
    marked = rows.select("conv_id", "part", "seq", "turn", "times", F.substring("role", 1, 1).alias("initial"), what.alias("what"), F.col("text").rlike(_NOT_WHITE).alias("solid"), F.col("text").rlike(rf"[.!?][\x20\x09-\x0D]*\z").alias("ended"))
    # The first of equal rows: in each partition, then over partitions (at most one row of each).
    first = marked.where("solid").groupBy("conv_id", "what", "part").agg(F.min("seq").alias("seq")).groupBy("conv_id", "what").agg(F.min("seq").alias("seq")).select("seq", F.lit(True).alias("new"))
    fault = F.when(~F.col("solid"), BLANK).when(F.col("new").isNull(), DUPLICATE).when(~F.col("ended"), TRUNCATED).otherwise(FINE)
    return marked.join(first, "seq", "left").select("conv_id", "part", "seq", "turn", "times", "initial", fault.alias("fault"))


def _pieces(labelled: DataFrame) -> DataFrame:
    """One row for each piece: its paths, its illegal neighbours and the initials at its ends."""

    def run(batches):
        for b in batches:
            for conv_id, part, piece, rows in zip(*(c.to_pylist() for c in b.columns)):
                steps, initials = [], []
                for r in rows:
                    steps.append((r["fault"], r["initial"], r["times"] if r["fault"] == BLANK else 1))
                    if r["times"] > 1 and r["fault"] != BLANK:
                        steps.append((DUPLICATE, r["initial"], r["times"] - 1))
                    initials.append((r["initial"], r["times"]))
                illegal = sum(t - 1 for _, t in initials) + sum(a[0] + z[0] not in LEGAL for a, z in zip(initials, initials[1:]))
                found = [{"a": a, "b": z, "cost": c, "audit": s} for (a, z), (c, s) in paths(tuple(steps)).items()]
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "part": part, "piece": piece, "illegal": illegal, "first": initials[0][0], "last": initials[-1][0], "paths": found}], schema=schema)

    path = pa.struct([("a", pa.int32()), ("b", pa.int32()), ("cost", pa.int64()), ("audit", pa.string())])
    schema = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("piece", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string()), ("paths", pa.list_(path))])
    cut = labelled.withColumn("piece", F.shiftright("seq", PIECE_BITS))
    rows = cut.groupBy("conv_id", "part", "piece").agg(F.sort_array(F.collect_list(F.struct("seq", "fault", "initial", "times"))).alias("rows"))
    return rows.mapInArrow(lean(run), "conv_id long, part int, piece long, illegal long, first string, last string, paths array<struct<a: int, b: int, cost: bigint, audit: string>>")


def _audits(pieces: DataFrame) -> DataFrame:
    """conv_id, illegal, cost, audit: pieces joined like the digits of a binary number, so no text is copied often."""

    def run(batches):
        rows = (r for b in batches for r in b.to_pylist())
        for conv_id, group in groupby(rows, key=lambda r: r["conv_id"]):
            held, illegal, last = [], 0, None
            for r in group:
                illegal += r["illegal"] + (last is not None and last + r["first"] not in LEGAL)
                last, size, table = r["last"], 1, {(p["a"], p["b"]): (p["cost"], p["audit"]) for p in r["paths"]}
                while held and held[-1][0] == size:
                    table, size = joined(held.pop()[1], table), 2 * size
                held.append((size, table))
            table = held.pop()[1]
            while held:
                table = joined(held.pop()[1], table)
            cost, audit = min(table[START, x] for x in WHOLE if (START, x) in table)
            yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "illegal": illegal, "cost": cost, "audit": audit}], schema=schema)

    schema = pa.schema([("conv_id", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())])
    return pieces.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "piece").mapInArrow(lean(run), "conv_id long, illegal long, cost long, audit string")


def _streamed(rows: DataFrame, audits: DataFrame, summary: bool) -> DataFrame:
    """The rows of each long conversation in order, its audit ahead of them."""

    def run(batches):
        stream = (r for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        for conv_id, group in groupby(stream, key=lambda r: r[0]):
            turns, editor, place = Turns(), None, 0
            for _, seq, role, text, times in group:
                if seq < 0:
                    editor = Editor(text)
                    continue
                for _ in range(times):
                    edits = list(editor.row(role, text))
                    turns.add(edits)
                    if not summary:
                        yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "place": place + i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(edits)], schema=rows_schema)
                        place += len(edits)
            edits = list(editor.end())
            turns.add(edits)
            if summary:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "repaired_sha256": turns.hash.hexdigest()}], schema=pa.schema([("conv_id", pa.int64()), ("repaired_sha256", pa.string())]))
            elif edits:
                yield pa.RecordBatch.from_pylist([{"conv_id": conv_id, "place": place + i, "edit": e, "role": r, "text": t} for i, (e, r, t) in enumerate(edits)], schema=rows_schema)

    rows_schema = pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
    both = rows.select("conv_id", "seq", "role", "text", "times").unionByName(audits.select("conv_id", F.lit(-1).cast("long").alias("seq"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit(1).cast("long").alias("times")))
    return both.repartition("conv_id").sortWithinPartitions(F.asc_nulls_first("conv_id"), "seq").mapInArrow(lean(run), "conv_id long, repaired_sha256 string" if summary else REPAIRED)


def _long_summaries(turns: DataFrame, scratch: Scratch) -> DataFrame:
    rows = _sorted(turns, scratch)
    labelled = scratch.table(_labelled(rows), "labelled")
    audits = scratch.table(_audits(_pieces(labelled)), "audits")
    of = lambda fault, n: F.sum(F.when(F.col("fault") == fault, F.col("times") if n else F.lit(1)).otherwise(0))
    copies = F.sum(F.when(F.col("fault") != BLANK, F.col("times") - 1).otherwise(0))
    counts = labelled.groupBy("conv_id").agg(of(BLANK, True).alias("blank"), (of(DUPLICATE, False) + copies).alias("duplicate"), of(TRUNCATED, False).alias("truncated"))
    known = labelled.where("turn is not null").groupBy("conv_id", "turn").count().groupBy("conv_id").agg((F.max("turn") - F.min("turn") + 1 - F.count("*")).alias("gaps"))
    out, names = audits, ["conv_id", *COUNTS, "audit", "repaired_sha256"]
    for df in (counts, known, _streamed(rows, audits, True)):
        df = df.withColumnRenamed("conv_id", "other")
        out = out.join(df, F.col("conv_id").eqNullSafe(F.col("other")), "left").drop("other")
    return out.withColumn("gaps", F.coalesce("gaps", F.lit(0).cast("long"))).select(names)


# The operator ---------------------------------------------------------------


def _plain(turns: DataFrame) -> DataFrame:
    """The four columns, with one space for a null role or text."""
    return turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")))


def _by_length(turns: DataFrame, scratch: Scratch, most: int) -> tuple[DataFrame, DataFrame | None]:
    """Rows of short conversations, sorted by conversation, and rows of long ones (None: there are none)."""
    spark = turns.sparkSession
    small_batches(spark)
    sizes = scratch.table(turns.groupBy("conv_id").agg(F.count("*").alias("n")).where(F.col("n") > most).select(F.col("conv_id").alias("long_id")), "long")
    short, long = turns, None
    if n := sizes.count():
        sizes = F.broadcast(sizes) if n <= 100_000 else sizes
        same = F.col("conv_id").eqNullSafe(F.col("long_id"))
        short, long = turns.join(sizes, same, "left_anti"), turns.join(sizes, same, "left_semi")
    return short.repartition("conv_id").sortWithinPartitions(*_order(), "text"), long


def summaries(turns: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """One row for each conversation: gaps, faults, illegal neighbours, cost, audit and the hash of its repaired text."""
    scratch = Scratch(turns.sparkSession, "repair")
    short, long = _by_length(_plain(turns), scratch, most)
    out = short.mapInArrow(lean(_summaries), SUMMARY)
    return out if long is None else out.unionByName(_long_summaries(long, scratch))


def repaired(turns: DataFrame, most: int = MOST_ROWS) -> DataFrame:
    """conv_id, place, edit (keep, rerole, insert, delete), role, text of every turn, deleted ones included."""
    scratch = Scratch(turns.sparkSession, "repair")
    short, long = _by_length(_plain(turns), scratch, most)
    out = short.mapInArrow(lean(_edits), REPAIRED)
    if long is None:
        return out
    rows = _sorted(long, scratch)
    audits = scratch.table(_audits(_pieces(scratch.table(_labelled(rows), "labelled"))), "audits")
    return out.unionByName(_streamed(rows, audits, False))


def damaged(turns: DataFrame) -> DataFrame:
    """One row in four with a fault, chosen by a checksum of conv_id and turn: dropped, emptied, without end marks, repeated, or said by the user."""
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit(" ")).alias(c) for c in ("role", "text")), (F.crc32(F.concat(name("conv_id"), F.lit(":"), name("turn"))) % 20).alias("hit"))
    hit = lambda k: F.col("hit") == k
    text: Column = F.when(hit(1), "").when(hit(2), F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    changed = rows.where(~hit(0)).select("conv_id", "turn", F.when(hit(4), "user").otherwise(F.col("role")).alias("role"), text.alias("text"), "hit")
    return changed.withColumn("copy", F.explode(F.when(hit(3), F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("copy", "hit")
