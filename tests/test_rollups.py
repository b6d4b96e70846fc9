"""Sketch rollups: exact figures are exact, estimates keep their bounds, days merge in any way."""

from datetime import datetime

from pyspark.sql import functions as F

from tessera.operators import analytics
from tessera.sources import tables
from tessera.streaming import rollups


def log(spark, n, distinct):
    """Rows over 20 days; query i // 10 % distinct, and every third row the same."""
    start = datetime(2024, 1, 1)
    text = F.when(F.col("id") % 3 == 0, "often").otherwise(F.concat(F.lit("q"), F.xxhash64("id") % distinct))
    return spark.range(n).select(text.alias("query_text"), (F.col("id") % 4).cast("int").alias("num_results"), (F.col("id") % 7).cast("double").alias("search_time_ms"), (F.lit(start) + F.make_dt_interval((F.col("id") % 20).cast("int"))).alias("created_at"))


def test_small_logs_are_exact(spark, sf, tmp_path):
    logs = tables.query_logs(spark, sf)
    rolled = rollups.Rollups(spark, str(tmp_path))
    for i in range(3):
        rolled.add(logs.where(F.pmod("id", F.lit(3)) == i), i)
    rolled.add(logs.where(F.pmod("id", F.lit(3)) == 2), 2)  # a batch that is run again
    assert rolled.summary().collect() == analytics.summary(logs).select(rolled.summary().columns).collect()
    assert [tuple(r) for r in rolled.top(20).collect()] == [tuple(r) for r in analytics.top_queries(logs).select("query_text", "n").collect()]
    some = logs.where("to_date(created_at) between '2024-01-03' and '2024-01-09'")
    assert rolled.summary("2024-01-03", "2024-01-09").first().total == some.count()


def test_bounds_on_many_queries(spark, tmp_path):
    logs, n = log(spark, 200_000, 60_000), 200_000
    rolled = rollups.Rollups(spark, str(tmp_path / "a"))
    for i in range(4):
        rolled.add(logs.where(F.pmod(F.xxhash64("query_text", "created_at"), F.lit(4)) == i), i)
    got = rolled.summary().first()
    exact = analytics.summary(logs).first()
    assert (got.total, got.avg_results, got.zero_results) == (exact.total, exact.avg_results, exact.zero_results)
    assert abs(got.distinct_queries / exact.distinct_queries - 1) < 4 * 0.83 / 2 ** (rollups.LOG_BUCKETS / 2)
    counts = {r.query_text: r.n for r in logs.groupBy("query_text").agg(F.count("*").alias("n")).collect()}
    top = rolled.top(5).collect()
    assert top[0].query_text == "often"
    assert all(0 <= r.n - counts[r.query_text] <= 3.5 * n / rollups.TRACKED for r in top)
    rolled.compact(str(tmp_path / "b"))
    merged = rollups.Rollups(spark, str(tmp_path / "b"))
    assert merged.rows().count() == 20 < rolled.rows().count()
    assert merged.summary().collect() == rolled.summary().collect()


def test_old_days_are_not_read(spark, tmp_path):
    rolled = rollups.Rollups(spark, str(tmp_path))
    rolled.add(log(spark, 1_000, 50), 0)
    plan = rolled.summary("2024-01-19")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(day,2024-01-19)" in plan.replace(" ", "")
    assert rolled.summary("2024-01-19").first().total == 100 and rolled.summary("2030-01-01").first().total == 0
    assert rolled.top(3, "2030-01-01").collect() == []
