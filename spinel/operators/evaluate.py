"""Evaluation: distance errors, rank errors, classification measures, tensor statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.probs import bind, total


def distance_errors(cells: DataFrame, keys: list[str], dst: float = 20.0, near: float = 8.0) -> DataFrame:
    """(…, variant, mae, sd) for four selections of cells (dst predicted, md true), in one pass over the data."""
    e, p, g = F.abs(F.col("md") - F.col("dst")), F.col("dst"), F.col("md")
    picks = {"full": F.lit(True), "dst": (p <= dst) | (g <= dst), "near": p <= near, "recall": g <= near}
    aggs = [f(F.when(c, e)).alias(f"{n}_{v}") for v, c in picks.items() for n, f in (("mae", F.avg), ("sd", F.stddev_pop))]
    rows = cells.groupBy(*keys).agg(*aggs)
    long = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), F.col(f"mae_{v}").alias("mae"), F.col(f"sd_{v}").alias("sd")) for v in picks]))
    return rows.select(*keys, long.alias("_v")).select(*keys, "_v.*")


def macro_errors(errors: DataFrame) -> DataFrame:
    """A10: means over proteins; those without cells don't count."""
    return errors.groupBy("variant").agg(F.avg("mae").alias("mae"), F.avg("sd").alias("sd"))


def join_truth(ranked: DataFrame, gt: DataFrame, keys: list[str], missing: str = "drop") -> DataFrame:
    """Ranked models with their true rank; without one they drop out, or count as rank 0."""
    rows = ranked.join(gt, [*keys, "name"], "inner" if missing == "drop" else "left")
    return rows.withColumn("gt_rank", F.coalesce("gt_rank", F.lit(0)))


def rank_error(scores: DataFrame, gt: DataFrame, keys: list[str], config: list[str] | None = None, top: int = 50, missing: str = "drop") -> DataFrame:
    """Mean and population SD of |true rank - rank| over the best ``top`` models."""
    by = [*(config or []), *keys]
    w = Window.partitionBy(*by).orderBy(F.desc("global"), "name")
    best = scores.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= top)
    err = F.abs(F.col("gt_rank") - F.col("rank"))
    return join_truth(best, gt, keys, missing).groupBy(*by).agg(F.avg(err).alias("mean"), F.stddev_pop(err).alias("sd"))


def rank_error_summary(errors: DataFrame, config: list[str]) -> DataFrame:
    """Mean and population SD over targets."""
    return errors.groupBy(*config).agg(F.avg("mean").alias("mean"), F.stddev_pop("mean").alias("sd"))


def class_histogram(mask: DataFrame) -> DataFrame:
    """(cls, n, fraction)."""
    return class_fractions(mask.groupBy("cls").agg(F.count("*").alias("n")))


def class_fractions(counts: DataFrame) -> DataFrame:
    """A13, W09 from (cls, n)."""
    return counts.withColumn("fraction", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row for each class


def class_weights(labels: DataFrame) -> DataFrame:
    """Inverse frequencies that sum to 1."""
    counts = labels.groupBy("label").agg(F.count("*").alias("n"))
    w = F.sum("n").over(Window.partitionBy()) / F.col("n")
    return counts.withColumn("w", w).withColumn("weight", F.col("w") / F.sum("w").over(Window.partitionBy())).select("label", "weight")


def accuracy(df: DataFrame) -> DataFrame:
    """A15."""
    return df.agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("accuracy"))


def per_class_accuracy(df: DataFrame, classes: int) -> DataFrame:
    """Share of a class's labels predicted right; 1 for a class without labels."""
    got = df.groupBy(F.col("label").alias("cls")).agg(F.avg((F.col("pred") == F.col("label")).cast("int")).alias("a"))
    every = df.sparkSession.range(classes).select(F.col("id").cast("int").alias("cls"))
    return every.join(got, "cls", "left").select("cls", F.coalesce("a", F.lit(1.0)).alias("accuracy"))


def _by_class(df: DataFrame) -> DataFrame:
    """(cls, tp, n_pred, n_label) from one aggregation of the confusion matrix."""
    cells = df.groupBy("pred", "label").agg(F.count("*").alias("n"))
    ends = F.explode(F.array(F.struct(F.col("pred").alias("cls"), F.col("n").alias("p"), F.lit(0).cast("long").alias("l")), F.struct(F.col("label").alias("cls"), F.lit(0).cast("long").alias("p"), F.col("n").alias("l"))))
    hit = F.when(F.col("pred") == F.col("label"), F.col("n")).otherwise(0)
    return cells.select(hit.alias("hit"), ends.alias("_e")).select("hit", "_e.*").groupBy("cls").agg((F.sum("hit") / 2).alias("tp"), F.sum("p").alias("n_pred"), F.sum("l").alias("n_label"))


def prf_weighted(df: DataFrame, swapped: bool = True) -> DataFrame:
    """Weighted precision, recall and F1; ``swapped`` lets the predictions play the labels, as the original call does."""
    true, guess = (F.col("n_pred"), F.col("n_label")) if swapped else (F.col("n_label"), F.col("n_pred"))
    rows = _by_class(df).select("tp", true.alias("t"), guess.alias("g"))
    p, r = F.coalesce(F.try_divide("tp", "g"), F.lit(0.0)), F.coalesce(F.try_divide("tp", "t"), F.lit(0.0))
    f = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    mean = lambda x: F.sum(x * F.col("t")) / F.sum("t")
    return rows.agg(mean(p).alias("precision"), mean(r).alias("recall"), mean(f).alias("f1"))


def mean_iou(df: DataFrame) -> DataFrame:
    """Over the classes that occur among the labels."""
    rows = _by_class(df).filter("n_label > 0")
    return rows.agg(F.avg(F.col("tp") / (F.col("n_pred") + F.col("n_label") - F.col("tp"))).alias("miou"))


def tensor_stats(tensors: DataFrame) -> DataFrame:
    """(tensor, lo, hi, sd) of (tensor, value array)."""
    mean = total(F.col("value")) / F.size("value")
    var = bind(mean, lambda m: total(F.transform("value", lambda x: (x - m) * (x - m)))) / F.size("value")
    return tensors.select("tensor", F.array_min("value").alias("lo"), F.array_max("value").alias("hi"), F.sqrt(var).alias("sd"))


def distinct_classes(pairs: DataFrame, cls: Column) -> DataFrame:
    """The sorted distinct classes of each chain; a task keeps a row for each class it saw, and only those are gathered."""
    seen = pairs.select("chain", cls.alias("cls")).distinct()
    return seen.groupBy("chain").agg(F.array_sort(F.collect_list("cls")).alias("classes"))  # a set would let the optimizer drop distinct


def mean_metrics(df: DataFrame, columns: list[str]) -> DataFrame:
    """A28."""
    return df.agg(*[F.avg(c).alias(c) for c in columns])
