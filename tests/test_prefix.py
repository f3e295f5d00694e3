"""Running sums, ranks and neighbours by parts against plain versions; how evenly rows are dealt."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F
from spinel.operators import prefix, quality, runs


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema).repartition(5)


@pytest.mark.parametrize("parts", [1, 2, 7, 50])
def test_running_sums(spark, parts):
    rng = random.Random(parts)
    rows = [(rng.choice(["a", "a", "a", "b", None]), rng.randint(0, 40), k, rng.randint(-5, 9)) for k in range(600)]
    got = prefix.running_sums(table(spark, rows, "g string, x int, id int, v int"), ["g"], [-F.col("x"), F.col("id")], {"s": F.col("v"), "n": F.lit(1)}, parts).collect()
    want, at = {}, Counter()
    for g, _x, i, v in sorted(rows, key=lambda r: (r[0] or "", -r[1], r[2])):
        at[g, "s"] += v
        at[g, "n"] += 1
        want[i] = (at[g, "s"], at[g, "n"])
    assert {r.id: (r.s, r.n) for r in got} == want and got[0].asDict().keys() == {"g", "x", "id", "v", "s", "n"}


@pytest.mark.parametrize("parts", [1, 9])
def test_ranks_without_keys(spark, parts):
    rows = [(f"m{k}", 0.0 if k % 10 else k / 1000) for k in range(1000)]
    got = quality.rank_models(table(spark, rows, "name string, global double"), parts=parts).collect()
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    assert {r.name: r.rank for r in got} == {name: k + 1 for k, (name, _) in enumerate(order)}


def test_nine_tenths_of_equal_scores_are_dealt_evenly(spark):
    rows = table(spark, [(f"m{k}", 0.0 if k % 10 else k / 20000) for k in range(20000)], "name string, global double")
    p = prefix.parted(rows, [], [-F.col("global"), F.col("name")], 16)
    sizes = [r["count"] for r in p.rows.groupBy("_part").count().collect()]
    assert len(sizes) == 16 and max(sizes) < 2 * 20000 / 16


@pytest.mark.parametrize("parts", [1, 3, 30])
def test_previous(spark, parts):
    rows = [(k % 3, k // 3, None if k % 7 == 0 else k) for k in range(300)]
    t = table(spark, rows, "g int, pos int, v int")
    cut = prefix.stretches(t, ["g"], "pos", 10) if parts == 3 else prefix.parted(t, ["g"], [F.col("pos")], parts)
    got = prefix.previous(cut, "v", "was").rows.collect()
    values = {(g, pos): v for g, pos, v in rows}
    assert all(r.was == values.get((r.g, r.pos - 1)) for r in got) and len(got) == 300


def test_no_rows_and_null_scores(spark):
    assert prefix.ranks(table(spark, [], "name string, global double"), [], [F.col("name")]).count() == 0
    got = quality.rank_models(table(spark, [("a", None), ("b", 0.5), ("c", float("nan"))], "name string, global double"), parts=2).collect()
    assert {r.name: r.rank for r in got}["b"] < {r.name: r.rank for r in got}["a"]


@pytest.mark.parametrize("stretch", [1, 10, 64, 1 << 16])
def test_runs_over_stretches(spark, stretch):
    rng = random.Random(9)
    rows = [(s, pos, rng.choice("HHHECC")) for s in range(3) for pos in range(200)]
    got = {(r.seq, r.pos): r.run for r in runs.run_ids(table(spark, rows, "seq int, pos int, state string"), stretch).collect()}
    for s in range(3):
        number, last = 0, None
        for _, pos, state in sorted(r for r in rows if r[0] == s):
            number += state != "C" and state != last
            assert got[s, pos] == (-1 if state == "C" else number)
            last = state


@pytest.mark.parametrize("stretch", [1, 10, 1 << 16])
def test_coordinates_over_stretches(spark, stretch):
    rows = [("g", n, k + 1, c) for n, text in ((1, "AC--D" * 9), (2, "-" * 30 + "W" * 15)) for k, c in enumerate(text)]
    got = {(r.name, r.col): r.coord for r in runs.aln_coord(table(spark, rows, "grp string, name int, col int, res string"), stretch).collect()}
    assert all(got[n, c] == sum(q[1] == n and q[2] <= c and q[3] != "-" for q in rows) for _, n, c, _ in rows)
