"""Typed, expiring state: order of arrival does not matter, and state goes when its time is over."""

import itertools
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tessera.streaming import stateful

START = datetime(2024, 1, 1)


def ran(spark, folder, rows, schema, number, key, processor, late, end=None):
    """The processor's rows, and the state's size after each batch."""
    progress: list = []
    stream = stateful.filed(spark.createDataFrame(rows, schema), f"{folder}/in", number, end)
    out = stateful.written(stateful.stateful(stream, key, processor, late), str(folder), progress)
    return [tuple(r) for r in out.collect()], progress


def brute_limit(rows, minutes, most):
    out = []
    for key, mine in itertools.groupby(sorted(rows), key=lambda r: r[0]):
        count, start = 0, None
        for _, at, ok in mine:
            if count == 0 or at - start >= timedelta(minutes=minutes):
                count, start = 0, at
            blocked = count >= most
            if not blocked:
                count = 0 if ok else count + 1
            out.append((key, at, blocked))
    return sorted(out)


@pytest.mark.parametrize("seed", [1])
def test_limiter_in_any_order(spark, tmp_path, seed):
    rng = random.Random(seed)
    rows = [(rng.choice("abc"), START + timedelta(seconds=rng.randrange(0, 3 * 3600)), rng.random() < 0.2) for _ in range(120)]
    got, progress = ran(spark, tmp_path, rows, "key string, at timestamp, ok boolean", F.floor(F.rand(seed) * 3), "key", stateful.Limiter(15, 3), "4 hours", START + timedelta(days=2))
    times = sorted((k, START + timedelta(microseconds=us - int((START - datetime(1970, 1, 1)).total_seconds() * 1e6)), b) for k, us, b in got)
    assert times == brute_limit(rows, 15, 3)
    assert progress[-1] < max(progress)


def test_quota_counts_over_files(spark, tmp_path):
    rows = [(f"g{i % 4}",) for i in range(30)]
    got, _ = ran(spark, tmp_path, rows, "guest string", F.floor(F.rand(1) * 4), "guest", stateful.Quota(5), None)
    want = [(f"g{g}", n, n <= 5) for g in range(4) for n in range(1, sum(i % 4 == g for i in range(30)) + 1)]
    assert sorted(got) == sorted(want)


def test_quota_forgets_who_is_idle(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("g", at(0)), ("g", at(1)), ("h", at(100)), ("g", at(200)), ("h", at(201))]
    got, progress = ran(spark, tmp_path, rows, "guest string, at timestamp", F.floor(F.minute("at") + 60 * F.hour("at")), "guest", stateful.Quota(1, 60), "1 minute", at(10_000))
    assert sorted(got) == sorted([("g", 1, True), ("g", 2, False), ("g", 1, True), ("h", 1, True), ("h", 1, True)])
    assert progress[-1] == 0


def test_sessions_close_when_idle_and_keep_the_last_of_a_turn(spark, tmp_path):
    at = lambda m: START + timedelta(minutes=m)
    rows = [("s", 1, "assistant", "B", at(1)), ("s", 0, "user", "A", at(0)), ("s", 1, "assistant", "B2", at(2)), ("t", 0, "user", None, at(0)), ("u", 5, "user", "late", at(90))]
    schema = "id string, turn long, role string, content string, at timestamp"
    number = F.when(F.col("content") == "B2", 1).when(F.col("id") == "u", 2).otherwise(0)
    got, progress = ran(spark, tmp_path, rows, schema, number, "id", stateful.Sessions(30), "5 minutes", at(10_000))
    told = {k: [(m.turn, m.role, m.content) for m in messages] for k, _, messages in got}
    assert told == {"s": [(0, "user", "A"), (1, "assistant", "B2")], "t": [(0, "user", None)], "u": [(5, "user", "late")]}
    assert len(got) == 3 and {k: n for k, n, _ in got} == {"s": 2, "t": 1, "u": 1}
    assert progress[-1] < max(progress)


def test_retention_removes_whole_days(spark, tmp_path):
    rows = [("k" if i % 3 else "l", START + timedelta(hours=5 * i)) for i in range(60)]
    end = START + timedelta(days=14)
    got, progress = ran(spark, tmp_path, rows, "kind string, at timestamp", F.floor(F.dayofmonth("at") / 4), "kind", stateful.Retention(3), "1 day", end)
    want = {}
    for kind, at in rows:
        if at.date() + timedelta(days=4) <= (end - timedelta(days=1)).date():
            want[kind, at.date()] = want.get((kind, at.date()), 0) + 1
    assert {(k, d): n for k, d, n in got} == want and len(got) == len(want)


def test_setting_of_the_store_comes_back(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    with stateful.state_store(spark):
        assert "RocksDB" in spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    assert spark.conf.get("spark.sql.streaming.stateStore.providerClass") == before


def test_limiter_keeps_many_keys_in_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 8)
    monkeypatch.setattr(stateful, "_CHUNK", 100)
    rng = random.Random(2)
    rows = [(f"k{rng.randrange(300)}", START + timedelta(seconds=rng.randrange(0, 3 * 3600)), rng.random() < 0.2) for _ in range(2000)] + [(None, START, True), ("k1", None, True)]
    got, progress = ran(spark, tmp_path, rows, "key string, at timestamp, ok boolean", F.floor(F.rand(2) * 3), "key", stateful.Limiter(60, 2), "4 hours", START + timedelta(days=2))
    times = sorted((k, START + timedelta(microseconds=us - int((START - datetime(1970, 1, 1)).total_seconds() * 1e6)), b) for k, us, b in got)
    assert times == brute_limit([r for r in rows if None not in r], 60, 2)
    # Of each bucket, a few entries in two lists; a state of its own for each key would be 300 at least.
    assert 0 < max(progress) < 150 and progress[-1] < max(progress)


def test_quota_keeps_many_keys_in_few_buckets(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "BUCKETS", 8)
    rows = [(f"g{i % 300}",) for i in range(1000)] + [(None,)]
    got, progress = ran(spark, tmp_path, rows, "guest string", F.floor(F.rand(1) * 4), "guest", stateful.Quota(2), None)
    want = [(f"g{g}", n, n <= 2) for g in range(300) for n in range(1, sum(i % 300 == g for i in range(1000)) + 1)]
    assert sorted(got) == sorted(want)
    assert 0 < max(progress) <= 8


def test_quota_takes_a_batch_in_order_of_time(spark, tmp_path):
    """A batch comes in parts of so many rows; an ask of a later part may be an earlier one."""
    at = [START + timedelta(minutes=m) for m in (0, 1, 2, 200, 201, 400)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1")
    try:
        got, _ = ran(spark, tmp_path, [("g", t) for t in at], "guest string, at timestamp", F.lit(0), "guest", stateful.Quota(2, 60), "1 day", START + timedelta(days=9))
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(n for _, n, _ in got) == [1, 1, 1, 2, 2, 3]


def test_a_large_batch_is_several_files_and_no_batch_takes_rows_of_the_next(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(stateful, "_FILE", 50)
    sizes = {0: 200, 1: 3, 2: 120, None: 7}
    rows = [(n, i) for n, size in sizes.items() for i in range(size)]
    stream = stateful.filed(spark.createDataFrame(rows, "n int, i int"), f"{tmp_path}/in", F.col("n"))
    files = spark.read.schema("n int, i int").parquet(f"{tmp_path}/in").groupBy(F.input_file_name()).count().collect()
    assert max(r[1] for r in files) <= 60 and len(files) >= 8
    query = stream.writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/checkpoint").trigger(availableNow=True).start()
    query.awaitTermination()
    assert [p.numInputRows for p in query.recentProgress if p.numInputRows] == [7, 200, 3, 120]


def test_state_has_no_more_partitions_than_cores_can_use(spark):
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "600")
    try:
        with stateful.state_store(spark):
            assert int(spark.conf.get("spark.sql.shuffle.partitions")) <= 2 * spark.sparkContext.defaultParallelism
        assert spark.conf.get("spark.sql.shuffle.partitions") == "600"
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
