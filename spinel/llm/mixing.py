"""Mixing sources to target weights by capped water-filling, with DataFrame functions only.

Each source gets a share of the total size in proportion to its weight. A source whose share is above ``max_epochs`` times its
own size is clamped there and the excess is redistributed over the others by weight, until no source is above its cap. A source
with target t and size s is then repeated floor(t / s) times as a whole, and the rest is a seeded sample: documents in the order
of a hash, up to the one whose middle lies beyond the rest.

The order is never sorted as a whole: the hash is refined digit by digit (a radix select on per-source sums), and only documents
that share the last prefix with the boundary are ordered, so a source that holds a third of all rows costs no long task.

Defined cases: null text has size 0; a null source is a source of its own, last in order; rows with equal id and text share a hash, and of
those at the boundary as many are taken as fit, whichever they are; a table without words has all targets 0; an empty table gives no rows; texts
of any length count whole; columns named size, source_size, target or copies are replaced in ``mix`` and kept in ``mixed_rows``, other extra columns
pass through.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .staging import private, staged, word_count

#: Documents that may share the last hash prefix with a source's boundary before the prefix is made longer.
BOUNDARY_ROWS = 100_000
#: Equal rows that one task writes again.
REPEATED = 10_000


def cycling_weights(sources: DataFrame, cycle: tuple[int, ...] = (1, 2, 3)) -> DataFrame:
    """Weights that repeat ``cycle`` over the sources in code point order, null last. One row per source is ordered."""
    w = Window.orderBy(F.col("source").asc_nulls_last())
    at = (F.row_number().over(w) - 1) % len(cycle) + 1
    return sources.withColumn("weight", F.element_at(F.array(*[F.lit(c) for c in cycle]), at.cast("int")).cast("long"))


def water_fill(sources: DataFrame, max_epochs: int) -> DataFrame:
    """Adds ``target`` to (source, source_size, weight): each round redistributes what the clamped sources leave."""
    total, weight = sources.agg(F.sum("source_size"), F.sum("weight")).first()
    cap = F.col("source_size") * max_epochs
    level = 0.0
    if total and weight:
        level, last = total / weight, -1.0
        while level > last:
            clamped = cap < F.lit(level) * F.col("weight")
            held, free = sources.agg(F.sum(F.when(clamped, cap).otherwise(0)), F.sum(F.when(clamped, 0).otherwise(F.col("weight")))).first()
            last, level = level, ((total - held) / free if free else level)
    return sources.withColumn("target", F.round(F.least(cap.cast("double"), F.lit(level) * F.col("weight")), 6))


def _boundary(units: DataFrame, sources: DataFrame) -> DataFrame:
    """(source, cutoff, part, taken): the last hash of each source whose documents all get one repetition more, and the next one if only ``taken`` of
    the rows that share it do."""
    per_source = sources.select("source", "rest").filter("rest > 0").withColumns({"base": F.lit(0).cast("long"), "prefix": F.lit("")})
    digits = 0
    while True:
        digits += 2
        inside = units.join(per_source, units["source"].eqNullSafe(per_source["source"]) & F.col("h").startswith(F.col("prefix"))).select(units["source"], "h", "size", "rest", "base")
        one = F.min("h") == F.max("h")  # equal rows need no order
        sums = inside.groupBy("source", "rest", "base", F.substring("h", 1, digits).alias("prefix")).agg(F.sum("size").alias("s"), F.when(one, 1).otherwise(F.count("*")).alias("n"))
        upto = F.sum("s").over(Window.partitionBy("source").orderBy("prefix"))
        sums = sums.withColumn("upto", F.col("base") + upto).filter((F.col("upto") - F.col("s") < F.col("rest")) & (F.col("rest") <= F.col("upto")))
        # a rest that rounding put above the whole size has no boundary: the missing row means that all documents are taken
        per_source = staged(sums.select("source", "rest", (F.col("upto") - F.col("s")).alias("base"), "prefix", "n"), "mix-boundary")
        most = per_source.agg(F.max("n")).first()[0]
        if not most or most <= BOUNDARY_ROWS or digits >= 32:
            break
    last = units.join(per_source, units["source"].eqNullSafe(per_source["source"]) & F.col("h").startswith(F.col("prefix"))).select(units["source"], "h", "size", "rest", "base")
    last = last.groupBy("source", "h", "rest", "base").agg(F.sum("size").alias("size"), F.count("*").alias("n"))
    before = F.col("base") + F.sum("size").over(Window.partitionBy("source").orderBy("h")) - F.col("size")
    each = F.col("size") / F.col("n")
    # of equal rows those are taken whose middle lies before the rest
    fit = F.when(each == 0, F.when(before < F.col("rest"), F.col("n")).otherwise(0)).otherwise(F.greatest(F.lit(0), F.least(F.col("n"), F.ceil((F.col("rest") - before) / F.when(each == 0, 1).otherwise(each) - 0.5))))
    last = last.withColumn("k", fit.cast("long"))
    some = F.when((F.col("k") > 0) & (F.col("k") < F.col("n")), F.struct("h", "k"))
    found = last.groupBy("source").agg(F.max(F.when(F.col("k") == F.col("n"), F.col("h"))).alias("cutoff"), F.max(some).alias("some"))
    kept = per_source.select(F.col("source").alias("s2"), "prefix")
    return kept.join(found, F.col("source").eqNullSafe(F.col("s2")), "left").select(F.col("s2").alias("source"), F.coalesce("cutoff", "prefix").alias("cutoff"), F.col("some.h").alias("part"), F.col("some.k").alias("taken"))


def _some_of_equal(rows: DataFrame, own: str) -> DataFrame:
    """``rows`` that share their source's ``part``, of which the first ``taken`` get a repetition: counted, numbered as counts, and written out again."""
    cols = [c for c in rows.columns if c != f"{own}extra"]
    counts = rows.groupBy(*cols).agg(F.count("*").alias(f"{own}n"))
    w = Window.partitionBy(f"{own}source").orderBy(F.xxhash64(*cols), *[c for c in cols if c in ("doc_id", "text")])
    counts = counts.withColumn(f"{own}at", F.sum(f"{own}n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col(f"{own}n"))
    blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col(f"{own}n") - 1) / REPEATED))).alias(f"{own}b")
    rows = counts.select("*", blocks).repartition(f"{own}b")
    first = F.col(f"{own}b") * REPEATED
    rows = rows.select("*", F.explode(F.sequence(first, F.least(first + REPEATED, F.col(f"{own}n")) - 1)).alias(f"{own}i"))
    return rows.withColumn(f"{own}extra", F.when(F.col(f"{own}at") + F.col(f"{own}i") < F.col(f"{own}taken"), 1).otherwise(0)).drop(f"{own}n", f"{own}at", f"{own}b", f"{own}i")


def mix(docs: DataFrame, weights: DataFrame | None = None, max_epochs: int = 3, seed: str = "mix-0") -> DataFrame:
    """``docs`` with size, source_size, target and copies (how often the mix takes the document) beside its own columns.

    ``weights`` has (source, weight); without it, weights 1, 2, 3 repeat over the sources. Sources missing there get weight 0.
    """
    own = private(docs.columns, "mix_")
    keyed = docs.withColumns({f"{own}size": word_count(F.col("text")), f"{own}h": F.md5(F.concat_ws(":", F.lit(seed), F.col("doc_id").cast("string"), F.col("text")))})
    units = staged(keyed.select("source", F.col(f"{own}size").alias("size"), F.col(f"{own}h").alias("h")), "mix-units")
    sources = units.groupBy("source").agg(F.sum("size").alias("source_size"))
    if weights is None:
        sources = cycling_weights(sources)
    else:
        w = weights.select(F.col("source").alias("ws"), F.col("weight").cast("double"))
        sources = sources.join(w, F.col("source").eqNullSafe(F.col("ws")), "left").select("source", "source_size", F.coalesce("weight", F.lit(0.0)).alias("weight"))
    sources = water_fill(staged(sources, "mix-sources"), max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    cut = _boundary(units, sources)
    plan = staged(
        sources.join(cut.withColumnRenamed("source", "cs"), F.col("source").eqNullSafe(F.col("cs")), "left").select(
            F.col("source").alias(f"{own}source"), F.col("source_size").alias(f"{own}all"), F.col("target").alias(f"{own}target"), F.col("whole").alias(f"{own}whole"), F.col("cutoff").alias(f"{own}cut"), F.col("part").alias(f"{own}part"), F.col("taken").alias(f"{own}taken")
        ),
        "mix-plan",
    )
    joined = keyed.join(plan, keyed["source"].eqNullSafe(plan[f"{own}source"])).withColumn(f"{own}extra", F.when(F.col(f"{own}h") <= F.col(f"{own}cut"), 1).otherwise(0))
    if not plan.filter(F.col(f"{own}part").isNotNull()).isEmpty():
        shared = F.coalesce(F.col(f"{own}h") == F.col(f"{own}part"), F.lit(False))
        joined = joined.filter(~shared).unionByName(_some_of_equal(joined.filter(shared), own))
    added = {"size": F.col(f"{own}size"), "source_size": F.col(f"{own}all"), "target": F.col(f"{own}target"), "copies": (F.col(f"{own}whole") + F.col(f"{own}extra")).cast("long")}
    kept = [F.col(c) for c in docs.columns if c not in added]
    return joined.select(*kept, *[c.alias(n) for n, c in added.items()])


def mixed_rows(docs: DataFrame, **options) -> DataFrame:
    """The mix itself: each document as often as it is taken, with the columns of ``docs``."""
    own = private(docs.columns, "mixed_")
    spare = {c: f"{own}{c}" for c in docs.columns if c in ("size", "source_size", "target", "copies")}
    taken = mix(docs.withColumnsRenamed(spare), **options).filter("copies > 0")
    again = taken.withColumn(f"{own}copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))))
    return again.select(*[F.col(spare.get(c, c)).alias(c) for c in docs.columns])
