"""What shows only on larger tables than the given ones, on a few rows made to show it."""

import math

from spinel import carriers
from spinel.operators import evaluate, pairs, runs
from spinel.sources import sinks
from pyspark.sql import functions as F


def test_zero_keeps_its_sign(spark, tmp_path):
    """A mean discount of 0 times -15 is -0.0 in SQL."""
    rows = [(7, 3, 10.0, 0.0, 0.01), (7, 3, 20.0, 0.0, 0.01), (8, 3, 5.0, 0.1, 0.0)]
    spark.createDataFrame(rows, "l_suppkey long, l_partkey long, l_quantity double, l_discount double, l_tax double").write.parquet(f"{tmp_path}/lineitem.parquet")
    got = {r.name: list(r.terms) for r in carriers.energy(spark, str(tmp_path)).collect()}
    assert got == {"m7": [0.9, 0.0, 0.15], "m8": [0.3, -1.5, 0.0]}
    assert math.copysign(1, got["m7"][1]) == -1 and math.copysign(1, got["m8"][2]) == 1
    assert math.copysign(1, carriers.energy_terms(spark, str(tmp_path)).filter("name = 'm7'").first().terms[1]) == -1


def test_atom_columns_stay_in_place(spark):
    """Numbers wider than their columns don't move what follows; ties round to even."""
    rows = [("A", 9999, 99999, "CA", "GLY", 0.0625, -0.1875, 2.5), ("A", 10001, 100002, "CA", "GLY", -0.0003, 2.0, 3.0)]
    atoms = spark.createDataFrame(rows, "chain string, resnum int, serial int, atom string, resname string, x double, y double, z double")
    lines = {r.serial: r.line for r in sinks.atom_lines(atoms).collect()}
    assert {len(x) for x in lines.values()} == {66}
    assert lines[99999] == "ATOM  99999  CA  GLY A9999       0.062  -0.188   2.500  1.00  0.00"
    assert lines[100002] == "ATOM  10000  CA  GLY A1000      -0.000   2.000   3.000  1.00  0.00"


def test_distinct_classes_gather_classes_only(spark):
    """Pairs are made distinct before a chain's classes are gathered."""
    df = evaluate.distinct_classes(spark.range(1000).select((F.col("id") % 3).alias("chain"), (F.col("id") % 5).cast("int").alias("cls")), F.col("cls"))
    assert {r.chain: r.classes for r in df.collect()} == {k: [0, 1, 2, 3, 4] for k in range(3)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 2


def exchanges(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].count("Exchange hashpartitioning")


def test_coordinates_without_a_shuffle(spark):
    """Whole rows are counted where they stand, whatever their length."""
    rows = [("g", 1, "A-C"), ("g", 2, "--"), ("h", 1, "AB-" * 50), ("h", 3, "")]
    df = runs.row_coord(spark.createDataFrame(rows, "grp string, name int, aln string"))
    want = sorted((g, n, k + 1, a[k], len(a[: k + 1].replace("-", ""))) for g, n, a in rows for k in range(len(a)))
    assert sorted((r.grp, r.name, r.col, r.res, r.coord) for r in df.collect()) == want
    assert exchanges(df) == 0


def test_pair_features_shuffle_residues_only(spark):
    """Nothing is shuffled behind the join that forms pairs."""
    rows = [("a", k, 0.5 * k, 2.0) for k in range(1, 6)] + [("b", 1, 7.0, 1.0)]
    df = pairs.pair_features_of_residues(spark.createDataFrame(rows, "name string, pos int, u double, h double"), ["u"], lambda a, b: [a["h"] * b["h"]], ["h"])
    want = sorted((n, i, j, [h * g, u, v]) for n, i, u, h in rows for m, j, v, g in rows if n == m and i <= j)
    assert sorted((r.name, r.i, r.j, list(r.feat)) for r in df.collect()) == want
    lines = df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan")[0].splitlines()
    formed = next(k for k, x in enumerate(lines) if "Join" in x and "<" in x.split("Join", 1)[1])
    assert "Exchange" not in "".join(lines[:formed])
