"""Sweeps against one run for each configuration; what they shuffle."""

import math

import pytest
from pyspark.sql import functions as F
from spinel.functions.probs import capped_exp
from spinel.operators import ensemble, evaluate, quality, sweep


@pytest.fixture(scope="module")
def qa(spark):
    rows = [(f"m{n}", k, None if (n, k) in ((0, 1), (3, 0), (3, 1), (3, 2), (3, 3)) else 0.5 + (n * 7 + k * 3) % 11) for n in range(4) for k in range(4)]
    return spark.createDataFrame(rows, "name string, k int, local double")


@pytest.fixture(scope="module")
def energy(spark):
    rows = [(f"m{n}", k, [(n - k) * 0.7, (k % 3) * 1.1, None if k == 2 else n * 0.4]) for n in range(4) for k in range(4) if (n, k) != (1, 1)]
    return spark.createDataFrame(rows, "name string, k int, terms array<double>")


@pytest.mark.parametrize("columns", [256, 3])
def test_energy_sweep_is_each_blend(spark, qa, energy, monkeypatch, columns):
    monkeypatch.setattr(sweep, "COLUMNS", columns)
    got = {(r.subset, r.w10, r.name): r["global"] for r in sweep.sweep_energy(qa, energy, 3).collect()}
    assert len(got) == 7 * 9 * 4 and all(got[s, w, "m3"] == 0 for s in range(1, 8) for w in range(1, 10))
    for s in (1, 4, 5, 7):
        for w in (1, 5, 9):
            blended = quality.blend_energy(qa, quality.energy_sum(energy, [t for t in range(3) if s >> t & 1]), w / 10)
            for r in quality.global_score(blended, ["name"]).collect():
                assert math.isclose(got[s, w, r.name], r["global"], abs_tol=1e-12)
    assert capped_exp  # the cap is the blend's own


def test_threshold_sweep_is_each_local_error(spark):
    rows = [("a" if n % 3 else "b", n % 9 + 1, n % 13 + 1, float(n % 30), (n % 10) / 10, float(n * 7 % 40)) for n in range(400)]
    cells = spark.createDataFrame(rows, "chain string, i int, j int, dst double, prob double, md double").dropDuplicates(["chain", "i", "j"])
    grid = sweep.grid(spark, [4, 8, 20], [0, 0.5, 0.95])
    got = {(r.dst_max, r.prb, r.chain): r["global"] for r in sweep.sweep_thresholds(cells, grid, ["chain"]).collect()}
    want = {}
    for r in grid.collect():
        for s in quality.global_score(quality.local_error(cells, ["chain"], r.prb, r.dst_max), ["chain"]).collect():
            want[r.dst_max, r.prb, s.chain] = s["global"]
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-12) for k in got)


def test_combinations_are_each_ensemble(spark, qa):
    single = None
    for n in range(4):
        one = qa.filter(~((F.lit(n) == 2) & (F.col("name") == "m1"))).select(F.lit(n).alias("id"), "name", "k", (F.col("local") * (1 + n)).alias("local"))
        single = one if single is None else single.unionByName(one)
    truth = spark.createDataFrame([("t", f"m{n}", 4 - n) for n in range(4)], "target string, name string, gt_rank int")
    combo = sweep.combos(spark.createDataFrame([(n, n) for n in range(4)], "id int, run int"), 2)
    got = {r.combo: (r.mean, r.sd) for r in sweep.sweep_combos(single, combo, 2, truth, ["target"]).collect()}
    assert len(got) == 6
    for c, (mean, sd) in got.items():
        mine = single.filter(F.col("id").isin([int(x) for x in c.split("-")]))
        scores = quality.global_score(ensemble.ensemble_quality(mine), ["name"]).join(truth.select("target", "name"), "name")
        one = evaluate.rank_error_summary(evaluate.rank_error(scores.withColumn("c", F.lit(c)), truth, ["target"], ["c"]), ["c"]).first()
        assert (mean, sd) == (one.mean, one.sd)


def test_no_row_fans_out_before_the_sums(spark, qa, energy):
    plan = sweep.sweep_energy(qa, energy, 3)._jdf.queryExecution().optimizedPlan().toString()
    below = plan[plan.index("Aggregate") :].split("Join")[0]
    assert "Generate" not in below


def test_subsets_of_rows(spark):
    rows = spark.createDataFrame([("a", [0, 2]), ("b", []), ("c", [5])], "name string, have array<int>")
    got = {(r.name, r.subset, tuple(r.idx)) for r in sweep.subsets_of(rows, "have").collect()}
    assert got == {("a", 1, (0,)), ("a", 4, (2,)), ("a", 5, (0, 2)), ("c", 32, (5,))}
