"""Losses over class probabilities that need an order of all cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import prefix


def _jaccard(total: Column, seen: Column, cells: Column) -> Column:
    """1 - |intersection| / |union| once the ``cells`` with the largest errors, ``seen`` of them of the class, are wrong."""
    return F.when(cells == 0, 0.0).otherwise(1 - (total - seen) / (total + cells - seen))


def lovasz_softmax(cells: DataFrame, keys: list[str] | None = None, classes: list[int] | None = None, ignore: int | None = None, only_present: bool = True, parts: int | None = None) -> DataFrame:
    """(…, cls, loss) of cells (…, label, p), p being the probabilities of classes 0, 1, …; a loss for each of ``keys`` (an image, say) or for all cells.

    A class's errors, sorted from the largest, are weighted by what each adds to the Jaccard loss. Equal errors are one row, as their order makes
    no difference and saturated probabilities make many of them; errors of 0 add nothing and are left out. The sums before each error
    are running sums by parts, so that no task holds a class. Cells whose label is null or ``ignore``, and null probabilities, don't count.
    """
    keys = keys or []
    rows = cells.filter(F.col("label").isNotNull() & F.col("p").isNotNull())
    if ignore is not None:
        rows = rows.filter(F.col("label") != ignore)
    sizes = rows.groupBy(*keys, F.col("label").cast("int").alias("cls")).agg(F.count("*").alias("_g"))
    long = rows.select(*keys, "label", F.posexplode("p").alias("cls", "_p"))
    if classes is not None:
        long = long.filter(F.col("cls").isin(classes))
    # a row for each class of a key, far fewer than cells; the planner sees whether they can be broadcast
    long = long.join(sizes, [*keys, "cls"], "inner" if only_present else "left").withColumn("_g", F.coalesce("_g", F.lit(0)))
    own = (F.col("label") == F.col("cls")).cast("long")
    errors = long.select(*keys, "cls", "_g", own.alias("_own"), F.abs(own - F.col("_p").cast("double")).alias("_e")).filter("_e > 0")
    levels = errors.groupBy(*keys, "cls", "_g", "_e").agg(F.sum("_own").alias("_f"), F.count("*").alias("_c"))
    summed = prefix.running_sums(levels, [*keys, "cls"], [-F.col("_e")], {"_seen": F.col("_f"), "_n": F.col("_c")}, parts)
    step = _jaccard(F.col("_g"), F.col("_seen"), F.col("_n")) - _jaccard(F.col("_g"), F.col("_seen") - F.col("_f"), F.col("_n") - F.col("_c"))
    losses = summed.groupBy(*keys, "cls").agg(F.sum(F.col("_e") * step).alias("loss"))
    # a class without any error has a loss of 0
    every = long.select(*keys, "cls").distinct() if not only_present else sizes.select(*keys, "cls")
    if classes is not None:
        every = every.filter(F.col("cls").isin(classes))
    return every.join(losses, [*keys, "cls"], "left").withColumn("loss", F.coalesce("loss", F.lit(0.0)))


def mean_loss(losses: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """The mean over classes."""
    return losses.groupBy(*(keys or [])).agg(F.avg("loss").alias("loss"))
