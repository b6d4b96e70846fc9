"""Connected components of a link table by repeated Spark joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .scratch import Scratch

#: Enough for paths of any length: a round doubles how far a label has come.
ROUNDS = 100


def components(links: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, comp) for every node of ``links`` (a, b): comp is the smallest node reachable.

    Each round every node takes the smallest label among itself and its
    neighbours and then that label's own label, so the rounds grow with the
    logarithm of the longest shortest path.  Labels are written each round.
    """
    both = links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct()
    both = scratch.table(both, f"{name}-edges")
    labels = scratch.table(both.groupBy("node").agg(F.least("node", F.min("other")).alias("comp")), f"{name}-0")
    for turn in range(1, ROUNDS + 1):
        seen = both.join(labels.select(F.col("node").alias("other"), F.col("comp").alias("theirs")), "other")
        best = seen.groupBy("node").agg(F.min("theirs").alias("theirs"))
        step = labels.join(best, "node").select("node", F.least("comp", "theirs").alias("comp"), F.col("comp").alias("was"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("further"))
        step = step.join(jump, "comp", "left").select("node", F.least("comp", F.coalesce("further", "comp")).alias("comp"), "was")
        step = scratch.table(step, f"{name}-{turn}")
        labels = step.select("node", "comp")
        if step.where("comp != was").isEmpty():
            return labels
    raise RuntimeError(f"components have not come to rest in {ROUNDS} rounds")
