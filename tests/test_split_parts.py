"""Files written as numbered parts and read as one, and masks of which only half is made."""

import os

from pyspark.sql import functions as F

from spinel.operators import evaluate, pairs
from spinel.sources import outfiles, split_files


def test_parts_are_one_file(spark, tmp_path):
    rows = spark.range(3000).select(F.when(F.col("id") % 5 > 0, "a-00001").otherwise("b.c").alias("target"), F.col("id").alias("ord"), F.concat(F.lit(">d"), "id", F.lit(" text\nAC\n-D")).alias("line"))
    rows = rows.unionByName(spark.createDataFrame([("one", 1, ">x\nA")], "target string, ord long, line string"))
    out = f"file://{tmp_path}/files"
    kept = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        outfiles.write_files(rows, out, order=("ord",), suffix=".fa", split=True, numbered=True)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", kept)
    names = [n for n in os.listdir(tmp_path / "files") if n.endswith(".fa")]
    assert sum(n.startswith("a-00001-") for n in names) > 1 and "one-00000.fa" in names
    got = {}
    for r in split_files.fasta(split_files.line_table(spark, out, parts=True), 50).orderBy("file", "ord").collect():
        got.setdefault(r.file, []).append((r.ord, r.name, r.aln))
    want = {t: [(k, f"d{i}", "AC-D") for k, i in enumerate((i for i in range(3000) if (i % 5 > 0) == (t[0] == "a")), 1)] for t in ("a-00001.fa", "b.c.fa")}
    assert got == want | {"one.fa": [(1, "x", "A")]}


def test_half_a_mask_counts_as_the_whole(spark):
    points = spark.range(80).select(F.lit("A").alias("chain"), F.col("id").alias("idx"), F.col("id").cast("int").alias("resnum"), *[(F.hash("id", F.lit(c)) % 50).cast("double").alias(c) for c in "xyz"])
    whole = pairs.mask_from_points(points)
    assert sorted(map(tuple, evaluate.class_histogram(whole).collect())) == sorted(map(tuple, evaluate.class_fractions(pairs.mask_counts(points)).collect()))
    upper = pairs.mask_from_points(points, part="upper")
    assert sorted(map(tuple, upper.collect())) == sorted(map(tuple, pairs.triangle(whole, "upper").collect()))
