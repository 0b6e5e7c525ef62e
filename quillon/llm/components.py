"""Connected components of a graph by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stage_table


def components(spark: SparkSession, edges: DataFrame) -> DataFrame:
    """(node, root) for each node of edges (a long, b long) that isn't a root; root is the smallest node reachable.

    A step groups and joins by node; a node's neighbours are only reduced to their minimum, never gathered. Loops and
    repeated edges do no harm. No edges give no rows.
    """
    now = edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct()
    now, before = stage_table(spark, now, "edges"), None
    while True:
        at = now.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("s")).first()
        if at == before or not at["n"]:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = at
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = stage_table(spark, small.unionByName(least.withColumnRenamed("m", "v")).distinct(), "edges", done=(now,))
