"""From logits to an ensemble of pair predictions, as one lazy chain."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import probs as pr
from ..operators import ensemble, pairs


def predict_pairs(logits: DataFrame, n: int, sep: int = 6) -> DataFrame:
    """(r1, r2, p, contact) from (predictor, i, j, logits): softmax, mean of both directions, background dropped, ten bins, mean.

    The 64 probabilities stay an array: each direction pair is at most two rows, averaged class by class.
    """
    soft = logits.select("predictor", F.least("i", "j").alias("r1"), F.greatest("i", "j").alias("r2"), pr.softmax(F.col("logits")).alias("p")).filter("r1 < r2")
    mean = F.transform(F.sequence(F.lit(1), F.lit(64)), lambda k: F.aggregate("ps", F.lit(0.0), lambda s, p: s + F.element_at(p, k)) / F.size("ps"))
    both = soft.groupBy("predictor", "r1", "r2").agg(F.collect_list("p").alias("ps")).select("predictor", "r1", "r2", mean.alias("q"))
    q = F.col("q")
    kept = pairs.drop_background(both.select("predictor", "r1", "r2", "q", pr.argmax(q).alias("cls"), F.array_max(q).alias("prob"), q[0].alias("p0")))
    return ensemble.ensemble_mean(kept.select("predictor", "r1", "r2", pr.bin10(q).alias("p")), n, sep)
