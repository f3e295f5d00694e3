"""Letters of whole rows counted without a row for each, and joins that don't shuffle cells."""

import random
from collections import Counter

from pyspark.sql import functions as F

from spinel import carriers as C
from spinel.operators import msa


def test_counts_of_rows_are_those_of_cells(spark):
    rng = random.Random(4)
    rows = [(rng.choice("xyz"), k, "".join(rng.choice("AC-é𝄞") for _ in range(rng.choice((0, 1, 7, 3000))))) for k in range(60)] + [("w", 1, None)]
    aln = spark.createDataFrame(rows, "grp string, name long, aln string")
    want = Counter((g, c, x) for g, _, t in rows if t for c, x in enumerate(t, 1))
    assert {(r.grp, r.col, r.res): r.n for r in msa.row_counts(aln).collect()} == dict(want)
    cells = C.columns(aln.filter("aln <> ''"))
    assert sorted(map(tuple, msa.consensus(cells).collect())) == sorted(map(tuple, msa.consensus_of_counts(msa.row_counts(aln)).collect()))


def test_tied_and_wide_residues(spark):
    cells = spark.createDataFrame([("g", 1, 1, "b"), ("g", 2, 1, "a"), ("g", 1, 2, "𝄞"), ("g", 2, 2, "𝄞")], "grp string, name long, col int, res string")
    assert {r.col: r.cons for r in msa.consensus(cells).collect()} == {1: "a", 2: "𝄞"}


def test_cells_meet_the_consensus_where_they_lie(spark):
    """The only exchange before ranking is of rows; the cells used to be shuffled by column."""
    cells = spark.range(20000).select((F.col("id") % 2).cast("string").alias("grp"), F.floor(F.col("id") / 20).alias("name"), (F.col("id") % 10).cast("int").alias("col"), F.when(F.col("id") % 7 == 0, "A").otherwise("C").alias("res"))
    cons = msa.consensus(cells)
    seen = []
    kept, msa._ranked = msa._ranked, lambda rows: seen.append(rows) or kept(rows)
    try:
        out = msa.consensus_matches(cells, cons)
    finally:
        msa._ranked = kept
    assert out.count() == 2000
    plan = seen[0]._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan


def test_blocks_of_long_texts(spark, tmp_path):
    text = "aé1\n" * 500 + "zz"
    spark.createDataFrame([(1, text, "en"), (2, "", "en"), (3, None, "de"), (4, "x" * 60, None)], "doc_id long, text string, lang string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {(r.grp, r.name): r.aln for r in C.alignment(spark, str(tmp_path)).collect()}
    t = "".join(c.upper() if c.isascii() and c.isalpha() else "-" for c in text)
    assert got == {(f"en:{b}", 1): t[60 * b : 60 * b + 60].ljust(60, "-") for b in range(-(-len(t) // 60))} | {("0", 4): "X" * 60}
