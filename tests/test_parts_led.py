"""What came before a stretch leads it as a row: the same values, and no join of rows."""

import random

import pytest
from pyspark.sql import functions as F

from spinel.operators import prefix
from spinel.sources import split_files


def groups(spark, seed=2):
    rng = random.Random(seed)
    rows = [(rng.choice(["a", "b", None, ""]), pos, rng.choice([None, None, rng.randint(-5, 9)]), rng.randint(-3, 3)) for pos in range(400)]
    return rows, spark.createDataFrame(rows, "g string, pos int, v int, x int").repartition(4)


@pytest.mark.parametrize("stretch", [1, 7, 90, 1 << 16])
def test_stretches_with_null_keys(spark, stretch):
    rows, df = groups(spark)
    cut = lambda: prefix.stretches(df, ["g"], "pos", stretch)
    got = {r.pos: r for r in prefix.summed(cut(), {"s": F.col("x"), "n": F.lit(1)}, carry=("v",)).collect()}
    rank = {r.pos: r.k for r in prefix.numbered(cut(), "k").collect()}
    last = {r.pos: r.v for r in prefix.carried(cut(), "v").rows.collect()}
    was = {r.pos: r.was for r in prefix.previous(cut(), "v", "was").rows.collect()}
    total, n, known, before = {}, {}, {}, {}
    for g, pos, v, x in rows:
        total[g], n[g], known[g] = total.get(g, 0) + x, n.get(g, 0) + 1, known.get(g) if v is None else v
        assert (got[pos].g, got[pos].s, got[pos].n, got[pos].v) == (g, total[g], n[g], known[g])
        assert (rank[pos], last[pos], was[pos]) == (n[g], known[g], before.get(g))
        before[g] = v
    assert len(got) == len(rank) == len(last) == len(was) == len(rows) and got[0].asDict().keys() == {"g", "pos", "v", "x", "s", "n"}


def test_rows_of_stretches_are_dealt_once(spark):
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = prefix.numbered(prefix.stretches(groups(spark)[1], ["g"], "pos", 7), "k")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert "Join" not in plan


@pytest.mark.parametrize("stretch", [1, 5, 1 << 16])
def test_records_of_one_name(spark, stretch):
    text = [">b one", "AC", ">a", "--", "aC.", "", ">  a two", "G", ">ab", "T", ">", "K"]
    lines = spark.createDataFrame([(f, 3 * k, t) for f in ("x", "y", None) for k, t in enumerate(text)], "file string, ord long, line string")
    every = split_files.fasta(lines, stretch)
    for name in ("a", "ab", "zz"):
        want = sorted(map(str, every.filter(F.col("name") == name).collect()))
        assert sorted(map(str, split_files.fasta(lines, stretch, name).collect())) == want and len(want) == {"a": 6, "ab": 3, "zz": 0}[name]


def test_lines_of_other_records_are_not_grouped(spark):
    """Only the wanted record's lines come to the grouping; the name used to be looked for behind it."""
    lines = spark.createDataFrame([("x", k, f">n{k // 2}" if k % 2 == 0 else "AC") for k in range(200)], "file string, ord long, line string")
    plan = split_files.fasta(lines, 50, "n7")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Aggregate [file") < plan.index("_name#") and "= n7" in plan[plan.index("Aggregate [file") :]
