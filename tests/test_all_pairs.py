"""All pairs of a chain: what a row costs in bytes and digits, with the same values."""

import math
import random

from pyspark.sql import functions as F

from spinel.functions import probs as pr
from spinel.operators import pairs


def points(spark, n, seed=5):
    rng = random.Random(seed)
    rows = [(k % 2, k // 2 + 1, *(rng.uniform(-25, 25) for _ in "xyz")) for k in range(2 * n)]
    return spark.createDataFrame(rows, "chain int, resnum int, x double, y double, z double")


def test_mask_takes_few_bytes_a_row(spark, tmp_path):
    """Rows of one residue follow each other; halves that alternate took more than three bytes a row."""
    out = tmp_path / "mask"
    pairs.mask_from_points(points(spark, 500)).write.parquet(str(out))
    n = spark.read.parquet(str(out)).count()
    assert n > 400_000 and sum(p.stat().st_size for p in out.glob("*.parquet")) < 2 * n


def test_mask_has_both_halves_and_the_diagonal(spark):
    rows = [("a", 1, 0.0, 0.0, 0.0), ("a", 2, 2.5, 0.0, 0.0), ("a", 3, 0.0, 63.0, 0.0), ("a", 3, 0.0, 64.0, 0.0), ("a", 9, 0.0, 0.0, -99.0), ("b", 1, None, 0.0, 0.0)]
    got = sorted(map(tuple, pairs.mask_from_points(spark.createDataFrame(rows, "chain string, resnum int, x double, y double, z double")).collect()))
    off = [(c, r, q, max(2, round(math.dist(v, w))) - 1) for c, r, *v in rows for d, q, *w in rows if c == d and r != q and None not in v + w and math.dist(v, w) <= 64]
    assert got == sorted(off + [(c, r, r, 1) for c, r, *_ in rows])


def test_rounded_is_round(spark):
    """The same doubles as round's, at ties and beside them, signed, large, null or not a number; few take round's way."""
    rng = random.Random(3)
    ties = [s * (k + 0.5) / 1e6 for k in (0, 1, 2, 7, 12345, 63999999) for s in (1, -1)]
    values = [*ties, *[math.nextafter(t, s) for t in ties for s in (-99.0, 99.0)], *[rng.uniform(-64, 64) for _ in range(20000)], *[k / 64 for k in range(4096)], 0.0, -0.0, -1e-9, 1e12, -1e300, math.inf, math.nan, None]
    df = spark.createDataFrame([(v,) for v in values], "v double").select("v", F.round("v", 6).alias("a"), pr.rounded(F.col("v"), 6).alias("b"))
    assert [(r.v, r.a, r.b) for r in df.collect() if repr(r.a) != repr(r.b)] == []


def test_pair_distances_query_rounds_without_digits(spark, sf):
    """round is only what remains for values near a tie."""
    from spinel.queries import QUERIES

    plan = QUERIES["j01_pair_distances"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "ELSE round(" in plan


def test_class_is_half_even_without_digits(spark):
    values = [0.0, 1.2, 2.5, 3.5, 4.5, 62.5, 63.5, math.nextafter(2.5, 9), math.nextafter(3.5, 0), 64.0, 64.1, math.inf, math.nan, None, *[random.Random(1).uniform(0, 66) for _ in range(5000)]]
    df = spark.createDataFrame([(v,) for v in values], "d double").select("d", pr.distance_class(F.col("d")).alias("c"))
    want = [int(round(max(d, 2.0))) - 1 if d is not None and d <= 64 else None for d in values]
    assert [r.c for r in df.collect()] == want
    assert "bround" not in df._jdf.queryExecution().optimizedPlan().toString()
