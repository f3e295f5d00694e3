"""Ensembles of predictors: means with background filling, weighted distances, quality averages."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .pairs import seq_sep


def union_predictors(*pred: DataFrame) -> DataFrame:
    """The bag of all predictors' rows."""
    out = pred[0]
    for p in pred[1:]:
        out = out.unionByName(p)
    return out


def ensemble_mean(pred: DataFrame, n: int, sep: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """(…, r1, r2, p, contact): mean bins over n predictors; one that lacks a pair counts as background (last bin).

    ``keys`` (a target, say) keep pairs apart. Where chains are to be located, ``sep`` is 0 here and chain_sep's afterwards.

    The bins are summed as columns, so one hash aggregation with map-side sums does it.
    """
    bins = [F.coalesce(F.sum(F.try_element_at("p", F.lit(k + 1))), F.lit(0.0)).alias(f"b{k}") for k in range(10)]
    checked = pred.withColumn("p", F.when(F.size("p") == 10, F.col("p")).otherwise(F.raise_error(F.lit("pair predictions need ten bins")).cast("array<double>")))
    sums = seq_sep(checked, sep).groupBy(*keys, "r1", "r2").agg(F.count("*").alias("c"), *bins)
    full = F.greatest(F.lit(n), F.col("c"))
    p = F.array(*[(F.col(f"b{k}") + (F.greatest(F.lit(n) - F.col("c"), F.lit(0)) if k == 9 else 0)) / full for k in range(10)])
    return sums.select(*keys, "r1", "r2", p.alias("p")).withColumn("contact", F.col("p")[0] + F.col("p")[1] + F.col("p")[2])


def weighted_distance(pred: DataFrame, n: int) -> DataFrame:
    """(r1, r2, dst, prob) of pairs that all n predictors have; sum(d p) / sum(p), dropped where sum(p) is 0."""
    rows = pred.groupBy("r1", "r2").agg(F.count("*").alias("c"), F.sum(F.col("dst") * F.col("prob")).alias("dp"), F.sum("prob").alias("p"))
    return rows.filter((F.col("c") == n) & (F.col("p") != 0)).select("r1", "r2", (F.col("dp") / F.col("p")).alias("dst"), (F.col("p") / n).alias("prob"))


def complete_pairs(pred: DataFrame, n: int) -> DataFrame:
    """Pairs that n predictors have."""
    return pred.groupBy("r1", "r2").agg(F.count_distinct("predictor").alias("c")).filter(F.col("c") == n).drop("c")


def pivot_predictors(pred: DataFrame, n: int, sep: int = 6, keys: tuple[str, ...] = ()) -> DataFrame:
    """(…, r1, r2, dst_k, prob_k …), null where predictor k lacks the pair; the number of predictors is known, so no extra pass."""
    pick = lambda k, c: F.max(F.when(F.col("predictor") == k, F.col(c))).alias(f"{c}_{k}")
    return seq_sep(pred, sep).groupBy(*keys, "r1", "r2").agg(*[pick(k, c) for k in range(n) for c in ("dst", "prob")])


def ensemble_quality(qa: DataFrame) -> DataFrame:
    """Mean local error over predictors without nulls; null if all are."""
    return qa.groupBy("name", "k").agg(F.avg("local").alias("local"))


def ensemble_global(scores: DataFrame) -> DataFrame:
    """A04."""
    return scores.groupBy("name").agg(F.avg("global").alias("global"))


def require_all(qa: DataFrame, n: int) -> DataFrame:
    """Models by the number of predictors that have them, with whether that is all of them."""
    return qa.groupBy("name").agg(F.count_distinct("predictor").alias("have")).withColumn("complete", F.col("have") == n)


def common_names(qa: DataFrame, n: int) -> DataFrame:
    """U04."""
    return require_all(qa, n).filter("complete").select("name")
