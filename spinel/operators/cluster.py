"""Clusters of models by similarity."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def assert_square(sim: DataFrame) -> DataFrame:
    """(m1, m2) pairs that a complete matrix lacks."""
    names = sim.select(F.col("m1").alias("m")).union(sim.select("m2")).distinct()
    every = names.select(F.col("m").alias("m1")).crossJoin(names.select(F.col("m").alias("m2")))  # the matrix itself has this size
    return every.join(sim, ["m1", "m2"], "left_anti")


def cluster(sim: DataFrame, min_score: float = 0.7) -> DataFrame:
    """(m, label): density clustering with two members at least, on a symmetric matrix.

    That is connected components of score >= min_score; the label is the least member, -1 for a model on its own. Labels spread to
    neighbours and jump to their label's label, so rounds grow with the logarithm of a chain; the driver sees one count a round, and a
    checkpoint in the shared folder cuts the lineage.
    """
    spark = sim.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None):
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spinel-checkpoint-"))
    both = sim.select(F.col("m1").alias("a"), F.col("m2").alias("b"), "score")
    near = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "score")).filter((F.col("score") >= min_score) & (F.col("a") != F.col("b"))).select("a", "b").distinct().checkpoint()
    label = near.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("l")).checkpoint()
    while True:
        other = label.select(F.col("a").alias("b"), F.col("l").alias("lb"))
        spread = near.join(other, "b").groupBy("a").agg(F.min("lb").alias("lb")).join(label, "a").select("a", F.least("l", "lb").alias("l"))
        jump = label.select(F.col("a").alias("l"), F.col("l").alias("ll"))
        new = spread.join(jump, "l", "left").select("a", F.least("l", F.coalesce("ll", "l")).alias("l")).checkpoint()
        changed = new.join(label.withColumnRenamed("l", "old"), "a").filter("l <> old").limit(1).count()
        label = new
        if not changed:
            break
    every = sim.select(F.col("m1").alias("m")).union(sim.select("m2")).distinct()
    return every.join(label.withColumnRenamed("a", "m"), "m", "left").select("m", F.coalesce("l", F.lit(-1)).alias("label"))


def cluster_summary(sim: DataFrame, labels: DataFrame) -> DataFrame:
    """(label, size, mean, centre): mean similarity of different members, and the member with the largest row sum (least name of equals)."""
    a = labels.filter("label <> -1").select(F.col("m").alias("m1"), F.col("label").alias("la"))
    b = labels.filter("label <> -1").select(F.col("m").alias("m2"), F.col("label").alias("lb"))
    inner = sim.join(a, "m1").join(b, "m2").filter("la = lb")
    rows = inner.groupBy("la", "m1").agg(F.sum("score").alias("row"), F.sum(F.when(F.col("m1") != F.col("m2"), F.col("score"))).alias("s"), F.sum((F.col("m1") != F.col("m2")).cast("int")).alias("n"))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("la").orderBy(F.desc(F.round("row", 6)), "m1")))
    centre = F.max(F.when(F.col("_r") == 1, F.col("m1")))
    return rows.groupBy(F.col("la").alias("label")).agg(F.count("*").alias("size"), F.try_divide(F.sum("s"), F.sum("n")).alias("mean"), centre.alias("centre"))


def cluster_table(summary_rows: DataFrame) -> DataFrame:
    """(m1, m2, score) from lines of 11 fields; other lines and comments, which start with #, are skipped. A file with several
    first models is an error."""
    f = F.split(F.rtrim("line"), r"\s+")
    rows = summary_rows.select("file", f.alias("f")).filter((F.size("f") == 11) & ~F.col("f")[0].startswith("#"))
    rows = rows.select("file", F.col("f")[0].alias("m1"), F.col("f")[1].alias("m2"), F.col("f")[2].try_cast("double").alias("score"))
    w = Window.partitionBy("file")
    one = F.when(F.min("m1").over(w) == F.max("m1").over(w), F.col("m1")).otherwise(F.raise_error(F.lit("one first model a file")).cast("string"))
    return rows.withColumn("m1", one).select("m1", "m2", "score")
