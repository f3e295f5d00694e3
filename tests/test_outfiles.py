"""Finished files, byte for byte; what a failed job leaves; many targets."""

import os

import pytest
from pyspark.sql import functions as F
from spinel.operators import ensemble, pairs
from spinel.sources import outfiles, sinks


def content(folder):
    return {f: open(os.path.join(folder, f), encoding="utf-8").read() for f in sorted(os.listdir(folder)) if not f.startswith((".", "_"))}


def test_distance_files_with_a_contact_across_chains(spark, tmp_path):
    ends = spark.createDataFrame([("T1", 1, "A", 10), ("T1", 2, "B", 20), ("T2", 1, "C", 40)], "target string, ord int, chain string, end_pos int")
    row = lambda t, a, b, p: (t, 0, a, b, [p] + [0.0] * 8 + [1 - p])
    pred = spark.createDataFrame([row("T1", 10, 11, 0.5), row("T1", 1, 9, 0.25), row("T1", 3, 5, 0.75), row("T2", 10, 11, 0.5), row("T2", 1, 30, 1.0)], "target string, predictor int, r1 int, r2 int, p array<double>")
    mean = ensemble.ensemble_mean(pred, 1, 0, ("target",))
    located = pairs.chain_sep(pairs.locate_chain(mean, ends, "target", stretch=4))
    out = str(tmp_path / "out")
    assert outfiles.write_files(sinks.distance_files(located, methods=("one", "two")), out, suffix=".rr") == 2
    head = "PFRMAT RR\nTARGET {}\nAUTHOR spinel\nMETHOD one\nMETHOD two\nRMODE  2\nMODEL  1\n"
    zeros = " 0" * 8
    assert content(out) == {
        "T1.rr": head.format("T1") + f"A1 A9  0.25  0.25{zeros} 0.75\nA10 B1  0.5  0.5{zeros} 0.5\nEND\n",
        "T2.rr": head.format("T2") + f"C1 C30  1  1{zeros} 0\nEND\n",
    }
    assert {r.file: r.value for r in outfiles.read_files(spark, out).collect()} == {f[:-3]: v for f, v in content(out).items()}


def test_residue_behind_the_last_chain_of_its_target(spark):
    ends = spark.createDataFrame([("T1", 1, "A", 10), ("T2", 1, "C", 40)], "target string, ord int, chain string, end_pos int")
    pred = spark.createDataFrame([("T1", 1, 30)], "target string, r1 int, r2 int")
    assert pairs.locate_chain(pred.withColumn("target", F.lit("T2")), ends, "target").first().pos2 == 30
    with pytest.raises(Exception, match="no chain holds residue 30"):
        pairs.locate_chain(pred, ends, "target").collect()


@pytest.mark.parametrize("split", [False, True])
def test_order_over_many_rows_and_partitions(spark, tmp_path, split):
    rows = spark.range(60_000).select(F.when(F.col("id") % 3 == 0, "a/b c").otherwise(F.concat(F.lit("t"), F.col("id") % 4)).alias("target"), F.lit(1).alias("part"), ((F.col("id") * 7919) % 60_000).alias("ord"), F.concat(F.lit("line "), "id").alias("line"))
    out = str(tmp_path / "out")
    made = outfiles.write_files(rows.repartition(7), out, split=split)
    files = content(out)
    assert made == len(files) and (split or made == 5)
    for name in ("a%2Fb c", "t0", "t1", "t2", "t3"):
        got = "".join(v for f, v in files.items() if f == f"{name}.txt" or f.startswith(f"{name}-")).splitlines()
        mine = [(k * 7919 % 60_000, k) for k in range(60_000) if ("a%2Fb c" if k % 3 == 0 else f"t{k % 4}") == name]
        assert got == [f"line {k}" for _, k in sorted(mine)]
    assert sum(len(v.splitlines()) for v in files.values()) == 60_000


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    out = str(tmp_path / "out")
    rows = spark.range(1000).select(F.lit("t").alias("target"), F.lit(1).alias("part"), F.col("id").alias("ord"), F.when(F.col("id") < 999, "x").otherwise(F.raise_error(F.lit("broken"))).alias("line"))
    with pytest.raises(Exception, match="broken"):
        outfiles.write_files(rows, out)
    with pytest.raises(Exception, match="a null target"):
        outfiles.write_files(rows.filter("id < 5").withColumn("target", F.lit(None).cast("string")), out)
    assert os.listdir(tmp_path) == []
    good = rows.filter("id < 5")
    assert outfiles.write_files(good, out) == 1
    with pytest.raises(FileExistsError):
        outfiles.write_files(good, out)
    with pytest.raises(Exception, match="broken"):
        outfiles.write_files(rows, out, overwrite=True)
    assert content(out) == {"t.txt": "x\n" * 5}
    outfiles.write_files(good.filter("ord < 2"), out, overwrite=True)
    assert content(out) == {"t.txt": "x\n" * 2} and [f for f in os.listdir(tmp_path) if f.startswith(".")] == []


def test_no_lines_at_all(spark, tmp_path):
    rows = spark.createDataFrame([], "target string, part int, ord long, line string")
    assert outfiles.write_files(rows, str(tmp_path / "out")) == 0 and content(tmp_path / "out") == {}
