"""Connected components of an edge table, all in DataFrames: least labels with pointer jumping, each round a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keelson.llm.common import stored


def components(edges: DataFrame, what: str = "components") -> DataFrame:
    """(node, comp) for every node of ``edges`` (a, b): comp is the smallest node that is reachable. Labels only fall, so it ends.

    A hub's edges meet in joins on their own, which skew handling may split, and in minima that are combined before the shuffle.
    """
    both = stored(edges.select("a", "b").union(edges.select("b", "a")).distinct(), f"{what}-edges")
    labels = stored(both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("comp")).withColumnRenamed("a", "node"), f"{what}-0")
    k = 0
    while True:
        k += 1
        heard = both.join(labels.select(F.col("node").alias("b"), "comp"), "b").groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("heard"))
        lower = labels.join(heard, "node").select("node", F.col("comp").alias("was"), F.least("comp", "heard").alias("comp"))
        jump = labels.select(F.col("node").alias("comp"), F.col("comp").alias("far"))
        now = stored(lower.join(jump, "comp").select("node", "was", F.least("comp", "far").alias("comp")), f"{what}-{k}")
        labels = now.select("node", "comp")
        if now.filter("was <> comp").isEmpty():
            return labels
