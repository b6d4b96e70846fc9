"""Sharding by balanced label propagation over Spark joins.

Documents are linked when their texts are equal.  Every document starts in a
shard given by a hash of its id.  In each round the linked documents look at how
many of their neighbours every shard holds and ask to move to the shard with
most of them that has room for the others; a shard admits movers up to the room
left under its quota, largest groups first.  A group that no shard has room for
asks for as many shards as it needs at once, its documents dealt over their room.
Rounds end when nothing moves.  Documents without links cost
nothing to move and are then used, with whatever linked documents stand over a
quota, to make the counts exact: law ``rows``, counts at most one apart.

A group of equal texts is never expanded into its links.  Its documents are
pre-aggregated into at most ``UNITS`` * shards units (documents of one group
that started in one shard and share a hash bucket), and units move; a group with
a third of all rows is a few thousand rows, spread over all tasks.  A group
larger than a quota is left on as many shards as must hold it, or one or two more
where the room left is less than a few units; more where other linked documents,
which do not give way, take the room.

Only built-in functions run on the executors.  The driver sees one number per
shard and histogram thresholds.

Rows: a null text has no bytes, size 16, and no links (an empty text does);
repeated rows are documents of their own; an empty table gives an empty result;
with fewer documents than shards, some shards stay empty.  Other columns are
ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import Scratch

#: Hash buckets of a group's documents per starting shard.
UNITS = 64
#: Movers of like gain are admitted in this many parts.
PARTS = 128
#: Documents of one ranking task.
RANKED = 50_000


def _pick(values: list[int], index) -> F.Column:
    return F.get(F.array(*[F.lit(v).cast("long") for v in values]), index)


def _per_shard(df: DataFrame, label: str, amount: F.Column, shards: int) -> list[int]:
    found = {r[0]: r[1] for r in df.groupBy(label).agg(amount.alias("n")).collect()}
    return [found.get(t, 0) for t in range(shards)]


def _propagate(units: DataFrame, quotas: list[int], shards: int, s: Scratch) -> DataFrame:
    """units: key, bucket, start, n, label.  The same with labels that have moved towards neighbours."""
    turn, held = 0, 0
    while True:
        room = [q - n for q, n in zip(quotas, _per_shard(units, "label", F.sum("n"), shards))]
        at = units.groupBy("key", "label").agg(F.sum("n").alias("here"), F.max("n").alias("unit"))
        # Every round must leave groups more together than they were, so that rounds come to an end.
        before, held = held, at.agg(F.sum(F.col("here").cast("decimal(38,0)") * F.col("here"))).first()[0] or 0
        if held <= before:
            return units
        at = at.drop("unit").join(at.groupBy("key").agg(F.count("*").alias("parts"), F.sum("here").alias("all"), F.max("unit").alias("unit")).where("parts > 1"), "key")
        at = at.withColumns({"space": F.greatest(_pick(room, F.col("label")), F.lit(0)), "tie": F.xxhash64("key", "label")})
        # Best is the shard with most of the group that has room for the rest of it.
        fits = F.col("space") >= F.col("all") - F.col("here")
        best = at.groupBy("key", "all").agg(F.max(F.when(fits, F.struct("here", F.xxhash64(F.lit(turn), "key", "label"), "label"))).alias("best"))
        # A group that no shard can hold goes to as many as it needs, those that hold and could hold most of it first.
        by = Window.partitionBy("key").orderBy(F.desc(2 * F.col("here") + F.col("space")), "tie")
        wide = at.join(best.where("best IS NULL").select("key"), "key").withColumn("open", F.when(F.col("space") >= 4 * F.col("unit"), F.col("space")).otherwise(0))
        wide = wide.withColumns({"upto": F.sum("open").over(by), "held": F.sum(F.col("here") + F.col("open")).over(by)}).where(F.col("held") - F.col("here") - F.col("open") < F.col("all"))
        wide = wide.groupBy("key").agg(F.collect_list("label").alias("stay"), F.array_sort(F.collect_list(F.when(F.col("open") > 0, F.struct("upto", "label")))).alias("spots"), F.max("upto").alias("total"))
        asks = units.join(best.join(wide, "key", "left"), "key")
        # Its units elsewhere are dealt over the room of those shards in proportion.
        spot = F.floor(F.pmod(F.xxhash64(F.lit(turn), "key", "bucket", "start"), F.lit(1 << 20)) / (1 << 20) * F.col("total"))
        spot = F.get(F.filter("spots", lambda x: x["upto"] > spot), F.lit(0))["label"]
        asks = asks.withColumn("to", F.when(F.col("best").isNotNull(), F.col("best.label")).when(~F.array_contains("stay", F.col("label")), spot)).where(F.col("to") != F.col("label"))
        # A small group asks as one; a large one in parts, so that some of it can be admitted.
        part = F.when(F.col("best").isNotNull(), F.xxhash64("key")).otherwise(F.xxhash64("key", "bucket", "start"))
        asks = asks.select("key", "bucket", "start", "n", "to", ((F.lit(63) - F.floor(F.log2(F.col("all")))) * PARTS + F.pmod(part, F.lit(PARTS))).cast("int").alias("turn"))
        asks = s.table(asks, f"asks{turn}")
        bins = asks.groupBy("to", "turn").agg(F.sum("n").alias("n")).withColumn("sum", F.sum("n").over(Window.partitionBy("to").orderBy("turn")))
        last = _per_shard(bins.where(F.col("sum") <= _pick(room, F.col("to"))), "to", F.max("turn") + 1, shards)
        if not any(last):
            return units
        admitted = asks.where(F.col("turn") < _pick(last, F.col("to"))).select("key", "bucket", "start", "to")
        units = units.join(admitted, ["key", "bucket", "start"], "left").withColumn("label", F.coalesce("to", "label")).drop("to")
        turn += 1
        units = s.table(units, f"units{turn}")


def shard(docs: DataFrame, shards: int = 40) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard for every document."""
    s = Scratch(docs.sparkSession, "shards")
    key = F.unhex(F.coalesce(F.md5("text"), F.md5(F.concat(F.lit("null\x00"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))))
    base = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32("text"), F.lit(0)).cast("long").alias("text_crc32"),
        key.alias("key"),
        F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int").alias("start"),
        F.pmod(F.xxhash64(F.lit(1), "doc_id"), F.lit(UNITS)).cast("int").alias("bucket"),
    )
    base = s.table(base, "base")
    total = base.count()
    quotas = [total // shards + (t < total % shards) for t in range(shards)]

    groups = base.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select("key")
    units = base.groupBy("key", "bucket", "start").agg(F.count("*").alias("n")).join(groups, "key").withColumn("label", F.col("start"))
    units = _propagate(s.table(units, "units0"), quotas, shards, s)

    # Linked documents come first in a shard, so that others are the first to give way.
    placed = base.join(units.select("key", "bucket", "start", "label"), ["key", "bucket", "start"], "left")
    buckets = max(8, -(-total // (shards * RANKED)))
    placed = placed.select("doc_id", "size", "text_crc32", F.coalesce("label", "start").alias("label"), F.col("label").isNull().cast("int").alias("free"), F.pmod(F.xxhash64(F.lit(2), "doc_id"), F.lit(buckets)).cast("int").alias("part"))
    placed = s.table(placed, "placed")
    load = _per_shard(placed, "label", F.count("*"), shards)
    over, short = [max(0, n - q) for n, q in zip(load, quotas)], [max(0, q - n) for n, q in zip(load, quotas)]
    over_before, short_before = ([sum(x[:t]) for t in range(shards)] for x in (over, short))
    short_after = [b + n for b, n in zip(short_before, short)]

    parts = placed.groupBy("label", "free", "part").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("label").orderBy("free", "part")) - F.col("n")
    parts = parts.select("label", "free", "part", before.alias("before"))
    rank = F.row_number().over(Window.partitionBy("label", "free", "part").orderBy("doc_id", "size", "text_crc32")) - 1
    ranked = placed.withColumn("rank", rank).join(parts, ["label", "free", "part"]).withColumn("rank", F.col("rank") + F.col("before"))
    spare = F.col("rank") - _pick(quotas, F.col("label"))
    queue = F.when(spare >= 0, _pick(over_before, F.col("label")) + spare)
    to = F.size(F.filter(F.array(*[F.lit(v).cast("long") for v in short_after]), lambda x: x <= F.col("queue")))
    ranked = ranked.withColumn("queue", queue).withColumn("to", F.when(F.col("queue").isNotNull(), to))
    moved = F.col("to").isNotNull()
    out = ranked.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"),
        F.when(moved, F.col("to")).otherwise(F.col("label")).cast("int").alias("shard"),
        F.when(moved, _pick(load, F.col("to")) + F.col("queue") - _pick(short_before, F.col("to"))).otherwise(F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
    out = s.table(out, "result")
    s.drop(keep=("result",))
    return out
