"""Parameter sweeps: every configuration in one job.

Configurations are columns of one aggregation, never rows: a residue is read once, each task keeps one row of sums for a model, and only these
rows are shuffled, models times partitions of them. Configurations come as small parameter tables, and ``COLUMNS`` of them share a pass.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.probs import capped_exp
from .evaluate import rank_error, rank_error_summary

#: Configurations of one aggregation.
COLUMNS = 256


def grid(spark: SparkSession, distances: list[float], probabilities: list[float]) -> DataFrame:
    """(dst_max, prb): the threshold grid, a few rows."""
    return spark.createDataFrame([(float(d), float(p)) for d in distances for p in probabilities], "dst_max double, prb double")


def _global(mean: Column) -> Column:
    """A07 of a mean local error: 0 without any."""
    return F.when(mean.isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - mean / 8)))


def _long(wide: DataFrame, keys: list[str], configs: list[tuple], names: list[str], value) -> DataFrame:
    """A row for each model and configuration, from a model's row: ``value(at)`` is the global score of the one numbered ``at``."""
    cells = F.array(*[F.struct(*[F.lit(v).alias(n) for n, v in zip(names, c, strict=True)], value(at).alias("global")) for at, c in enumerate(configs)])
    return wide.select(*keys, F.explode(cells).alias("_c")).select(*[f"_c.{n}" for n in names], *keys, "_c.global")


def sweep_thresholds(cells: DataFrame, grid: DataFrame, keys: list[str]) -> DataFrame:
    """(dst_max, prb, …, global) for every configuration, of cells (…, i, j, dst, prob, md) that are read once.

    A residue's errors are summed for all configurations at once, and then a model's residues.
    """
    configs = [(r["dst_max"], r["prb"]) for r in grid.distinct().collect()]  # a parameter table
    use = (F.abs(F.col("i") - F.col("j")) > 3) & (F.col("dst") > 0)
    ends = cells.filter(use).select(*keys, "dst", "prob", F.abs(F.col("md") - F.col("dst")).alias("err"), F.explode(F.array("i", "j")).alias("k"))
    out = None
    for at in range(0, len(configs), COLUMNS):
        some = configs[at : at + COLUMNS]
        passing = [F.when((F.col("prob") >= p) & (F.col("dst") <= d), F.col("err")) for d, p in some]
        local = ends.groupBy(*keys, "k").agg(*[(F.avg(e) / 2.0).alias(f"l{n}") for n, e in enumerate(passing)])
        model = local.groupBy(*keys).agg(*[F.avg(f"l{n}").alias(f"m{n}") for n in range(len(some))])
        # a model none of whose residues passes has no row in that configuration
        rows = _long(model, keys, some, ["dst_max", "prb"], lambda n: F.when(F.col(f"m{n}").isNotNull(), _global(F.col(f"m{n}")))).filter("global IS NOT NULL")
        out = rows if out is None else out.unionByName(rows)
    return out


def combos(configs: DataFrame, k: int, distinct_on: str = "run") -> DataFrame:
    """(c1 … ck): combinations of configurations in the order of their ids, all different in ``distinct_on``."""
    one = lambda n: configs.select(F.col("id").alias(f"c{n}"), F.col(distinct_on).alias(f"_d{n}"))
    out = one(1)
    for n in range(2, k + 1):
        different = reduce(lambda a, b: a & b, [F.col(f"_d{m}") != F.col(f"_d{n}") for m in range(1, n)])
        out = out.join(F.broadcast(one(n)), (F.col(f"c{n - 1}") < F.col(f"c{n}")) & different)  # configurations are a parameter table
    return out.select(*[f"c{n}" for n in range(1, k + 1)])


def term_subsets(spark: SparkSession, terms: int) -> DataFrame:
    """(subset, idx): all non-empty sets of term indexes, by their bit mask."""
    bits = F.expr(f"filter(sequence(0, {terms - 1}), b -> (shiftright(id, b) & 1) = 1)")
    return spark.range(1, 1 << terms).select(F.col("id").cast("int").alias("subset"), bits.alias("idx"))


def subsets_of(rows: DataFrame, have: str) -> DataFrame:
    """(…, subset, idx): all non-empty sets of each row's own term indexes, sorted ones below 16, by their bit mask; 2^n - 1 of n terms."""
    mask = lambda n: F.explode(F.sequence(F.lit(1), (F.pow(F.lit(2), n) - 1).cast("int")))
    picked = F.filter(have, lambda x, at: F.getbit(F.col("_m"), at) == 1)
    some = rows.filter(F.size(have) > 0).withColumn("_m", mask(F.size(have))).withColumn("idx", picked)
    subset = F.aggregate("idx", F.lit(0), lambda s, b: s + F.pow(F.lit(2), b).cast("int"))
    return some.withColumn("subset", subset).drop("_m", have)


def weights(spark: SparkSession, steps: int = 9) -> DataFrame:
    """(w10, w): weights 0.1 to 0.9, from whole tenths."""
    return spark.range(1, steps + 1).select(F.col("id").cast("int").alias("w10"), (F.col("id") / 10).alias("w"))


def terms_except(a, b):
    """Terms without constant ones, as an array expression."""
    return F.array_except(a, b)


def sweep_combos(qa: DataFrame, combo: DataFrame, k: int, gt: DataFrame, keys: list[str]) -> DataFrame:
    """Rank error of every combination's averaged quality: (combo, mean, sd) over targets.

    qa: (id, name, k, local) of single configurations. A residue's members stand side by side in one row; each combination is a mean over
    some of them, and these means are averaged for a model, all in two aggregations.
    """
    found = [tuple(r[f"c{n}"] for n in range(1, k + 1)) for r in combo.select(*[f"c{n}" for n in range(1, k + 1)]).distinct().collect()]  # a parameter table
    ids = sorted({i for c in found for i in c})
    at = {i: f"v{n}" for n, i in enumerate(ids)}
    side = qa.filter(F.col("id").isin(ids)).groupBy("name", "k").agg(*[F.avg(F.when(F.col("id") == i, F.col("local"))).alias(c) for i, c in at.items()], *[F.count(F.when(F.col("id") == i, 1)).alias(f"n_{c}") for i, c in at.items()])
    out = None
    for first in range(0, len(found), COLUMNS):
        some = found[first : first + COLUMNS]

        def mean(c: tuple) -> Column:
            values = F.filter(F.array(*[F.col(at[i]) for i in c]), lambda x: x.isNotNull())
            return F.try_divide(F.aggregate(values, F.lit(0.0), lambda a, x: a + x), F.size(values))

        here = lambda c: F.greatest(*[F.col(f"n_{at[i]}") for i in c])
        model = side.groupBy("name").agg(*[F.avg(mean(c)).alias(f"m{n}") for n, c in enumerate(some)], *[F.max(here(c)).alias(f"h{n}") for n, c in enumerate(some)])
        named = [("-".join(map(str, c)),) for c in some]
        # a model that no member has takes no part
        scores = _long(model, ["name"], named, ["combo"], lambda n: F.when(F.col(f"h{n}") > 0, _global(F.col(f"m{n}")))).filter("global IS NOT NULL")
        out = scores if out is None else out.unionByName(scores)
    located = out.join(gt.select(*keys, "name"), "name")
    return rank_error_summary(rank_error(located, gt, keys, ["combo"]), ["combo"])


def sweep_energy(qa: DataFrame, en: DataFrame, terms: int, steps: int = 9) -> DataFrame:
    """(subset, w10, name, global) for every set of energy terms and every weight; ``terms`` of 6 and 9 weights are 567 configurations.

    The blend (1 - w) local + w capped is linear in w. So a model needs, beside the sum and the number of its local errors, one sum for each set: of
    capped - local over the residues that have all the set's terms. Two columns and one a set are all that is summed and shuffled.
    """
    rows = qa.join(en, ["name", "k"], "left").filter("local IS NOT NULL")
    subsets = range(1, 1 << terms)
    out = None
    for first in range(0, len(subsets), COLUMNS):
        some = subsets[first : first + COLUMNS]
        term = [F.try_element_at("terms", F.lit(t + 1)) for t in range(terms)]
        total = lambda s: reduce(lambda a, b: a + b, [term[t] for t in range(terms) if s >> t & 1])
        gain = [F.coalesce(F.sum(F.when(total(s).isNotNull(), capped_exp(total(s), F.col("local")) - F.col("local"))), F.lit(0.0)).alias(f"d{s}") for s in some]
        sums = rows.groupBy("name").agg(F.sum("local").alias("l"), F.count("*").alias("n"), *gain)
        cells = F.array(*[F.struct(F.lit(s).alias("subset"), F.col(f"d{s}").alias("d")) for s in some])
        tenths = F.array(*[F.lit(w) for w in range(1, steps + 1)])
        wide = sums.select("name", "l", "n", F.explode(cells).alias("c")).select("name", "l", "n", "c.subset", "c.d", F.explode(tenths).alias("w10"))
        part = wide.select("subset", "w10", "name", _global((F.col("l") + F.col("w10") / 10 * F.col("d")) / F.col("n")).alias("global"))
        out = part if out is None else out.unionByName(part)
    # models without any local error score 0 everywhere
    bare = qa.groupBy("name").agg(F.count("local").alias("n")).filter("n = 0").select("name")
    every = F.explode(F.sequence(F.lit(1), F.lit((1 << terms) - 1))).alias("subset")
    bare = bare.select("name", every).select("name", "subset", F.explode(F.sequence(F.lit(1), F.lit(steps))).alias("w10"))
    return out.unionByName(bare.select("subset", "w10", "name", F.lit(0.0).alias("global")))
