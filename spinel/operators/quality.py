"""Local and global model quality, and its blend with energy terms."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.probs import blend, capped_exp, subset_sum
from ..session import staged
from . import prefix


def local_error(cells: DataFrame, keys: list[str], prb: float = 0.0, dst: float = 67.0, part: str = "full", width: int = 3) -> DataFrame:
    """(…, k, local): mean |model - predicted| over the cells in row k or column k, halved.

    Cells are (…, i, j, dst, prob, md). Cells of the diagonal band, below the probability floor or beyond the distance don't count.
    """
    use = (F.abs(F.col("i") - F.col("j")) > width) & (F.col("prob") >= prb) & (F.col("dst") > 0) & (F.col("dst") <= dst)
    use = {"full": use, "upper": use & (F.col("i") < F.col("j")), "lower": use & (F.col("i") > F.col("j"))}[part]
    err = F.abs(F.col("md") - F.col("dst")).alias("err")
    ends = cells.filter(use).select(*keys, err, F.explode(F.array("i", "j")).alias("k"))
    return ends.groupBy(*keys, "k").agg((F.avg("err") / 2.0).alias("local"))


def global_score(local: DataFrame, keys: list[str]) -> DataFrame:
    """1 - mean(local) / 8 within [0, 1]; 0 without any local error."""
    mean = F.avg("local")  # greatest and least skip nulls, so an empty mean is asked for first
    g = F.when(mean.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean / 8)))
    return local.groupBy(*keys).agg(g.alias("global"))


def energy_sum(en: DataFrame, indexes: list[int]) -> DataFrame:
    """(name, k, s)."""
    return en.select("name", "k", subset_sum(F.col("terms"), F.array(*[F.lit(i) for i in indexes])).alias("s"))


def join_energy(qa: DataFrame, en: DataFrame, lengths: DataFrame | None = None) -> DataFrame:
    """Local errors with their residue's energy terms, null where there are none; with lengths (name, length) an energy of a residue beyond
    its model's length is an error."""
    if lengths is not None:
        beyond = F.raise_error(F.concat_ws(" ", F.lit("an energy beyond the length of"), F.col("name").cast("string"), F.col("k").cast("string"))).cast("int")
        en = en.join(lengths, "name").withColumn("k", F.when(F.col("k") <= F.col("length"), F.col("k")).otherwise(beyond)).drop("length")
    return qa.join(en, ["name", "k"], "left")


def blend_energy(qa: DataFrame, sums: DataFrame, w: float = 0.2) -> DataFrame:
    """(name, k, local): errors blended with the capped exponential of the energy where both exist."""
    joined = qa.join(sums, ["name", "k"], "left")
    local = F.when(F.col("local").isNotNull() & F.col("s").isNotNull(), blend(F.col("local"), capped_exp(F.col("s"), F.col("local")), w)).otherwise(F.col("local"))
    return joined.select("name", "k", local.alias("local"))


def model_energy(sums: DataFrame) -> DataFrame:
    """Total energy of a model and its residues' energies in order."""
    errors = F.transform(F.array_sort(F.collect_list(F.struct("k", "s"))), lambda x: x["s"])
    return sums.groupBy("name").agg(F.sum("s").alias("total"), errors.alias("by_residue"))


def rank_models(scores: DataFrame, keys: list[str] | None = None, parts: int | None = None) -> DataFrame:
    """Rank by score, largest first, null last, names decide ties; within ``keys``.

    No task orders all models, whatever their scores: parts of the order are ranked apart, and names split equal scores. The scores, a row for
    each model, are written once, as ranking reads them more than once.
    """
    scores = staged(scores, "scores")
    worst = F.when(F.col("global").isNull(), 1).otherwise(0)
    ranked = prefix.ranks(scores, keys or [], [worst, -F.col("global"), F.col("name")], parts=parts)
    return ranked.withColumn("rank", F.col("rank").cast("int"))


def ranked_list(scores: DataFrame) -> DataFrame:
    """Identical lines collapse, numbers sort as numbers, names decide ties."""
    return scores.dropDuplicates().orderBy(F.desc("global"), "name")


def legacy_rounding(qa: DataFrame) -> DataFrame:
    """Local errors as they come back from text with one decimal."""
    return qa.withColumn("local", F.bround("local", 1))
