"""Hand-made cases for operators and parsers."""

import math

import pytest
from pyspark.sql import functions as F
from spinel.functions import probs as pr
from spinel.functions import text as tx
from spinel.operators import align, cluster, ensemble, evaluate, msa, pairs, quality, runs, sweep
from spinel.sources import files, reports, sinks, tables


def one(spark, col):
    return spark.range(1).select(col.alias("v")).first()["v"]


def test_ensemble_fill(spark):
    p = spark.createDataFrame([(0, 1, 8, 5.0, 0.9, [0.6, 0.3, 0.1] + [0.0] * 7)], "predictor int, r1 int, r2 int, dst double, prob double, p array<double>")
    r = ensemble.ensemble_mean(p, 3).first()
    assert [round(x, 4) for x in r.p] == [0.2, 0.1, 0.0333, 0, 0, 0, 0, 0, 0, 0.6667] and round(r.contact, 4) == 0.3333


def test_four_fields_are_rejected_in_the_ensemble(spark):
    p = spark.createDataFrame([(0, 1, 8, 5.0, 0.9, [])], "predictor int, r1 int, r2 int, dst double, prob double, p array<double>")
    with pytest.raises(Exception, match="ten bins"):
        ensemble.ensemble_mean(p, 1).collect()


def test_pivot_and_separation(spark):
    p = spark.createDataFrame([(0, 1, 9, 5.0, 0.9), (0, 1, 6, 5.0, 0.9), (1, 1, 7, 4.0, 0.5)], "predictor int, r1 int, r2 int, dst double, prob double")
    got = {(r.r1, r.r2): (r.dst_0, r.dst_1) for r in ensemble.pivot_predictors(p, 2).collect()}
    assert got == {(1, 9): (5.0, None), (1, 7): (None, 4.0)}


def test_weighted_distance(spark):
    p = spark.createDataFrame([(0, 1, 9, 10.0, 0.5), (1, 1, 9, 14.0, 0.25), (0, 2, 9, 10.0, 0.5)], "predictor int, r1 int, r2 int, dst double, prob double")
    (r,) = ensemble.weighted_distance(p, 2).collect()
    assert (round(r.dst, 4), r.prob) == (11.3333, 0.375)


def test_distance_class(spark):
    d = spark.createDataFrame([(x,) for x in (1.2, 2.5, 3.5, 64.0, 64.1)], "d double")
    assert [r.c for r in d.select(pr.distance_class(F.col("d")).alias("c")).collect()] == [1, 1, 3, 63, None]


def test_local_and_global_quality(spark):
    cells = spark.createDataFrame([("a", 1, 6, 10.0, 1.0, 65.0), ("b", 1, 6, 10.0, 1.0, 10.0), ("b", 6, 1, 10.0, 1.0, 10.0)], "name string, i int, j int, dst double, prob double, md double")
    got = {(r.name, r.k): r.local for r in quality.local_error(cells, ["name"]).collect()}
    assert got == {("a", 1): 27.5, ("a", 6): 27.5, ("b", 1): 0.0, ("b", 6): 0.0}
    local = spark.createDataFrame([("x", 4.0), ("x", 8.0), ("x", None), ("y", 9.0), ("z", None), ("w", 0.0)], "name string, local double")
    assert {r.name: r["global"] for r in quality.global_score(local, ["name"]).collect()} == {"x": 0.25, "y": 0.0, "z": 0.0, "w": 1.0}


def test_capped_exp_and_blend(spark):
    assert [one(spark, pr.capped_exp(F.lit(float(s)), F.lit(float(e)))) for s, e in ((0, 3), (5, 3), (5, 10))] == [1, 8, 10]
    assert round(one(spark, pr.blend(F.lit(3.0), F.lit(1.0))), 6) == 2.6


def test_rank_error(spark):
    s = spark.createDataFrame([("t", "b", 0.9), ("t", "a", 0.8), ("t", "c", 0.1)], "target string, name string, global double")
    g = spark.createDataFrame([("t", "a", 1), ("t", "b", 2), ("t", "c", 3)], "target string, name string, gt_rank int")
    r = evaluate.rank_error(s, g, ["target"]).first()
    assert (round(r.mean, 4), round(r.sd, 4)) == (0.6667, 0.4714)
    missing = evaluate.rank_error(s, g.filter("name <> 'c'"), ["target"], missing="zero").first()
    assert round(missing.mean, 4) == round((1 + 1 + 3) / 3, 4)


def test_runs(spark):
    st = spark.createDataFrame([(1, k, c) for k, c in enumerate("CHHECCEE")], "seq int, pos int, state string")
    assert [r.run for r in runs.run_ids(st).orderBy("pos").collect()] == [-1, 1, 1, 2, -1, -1, 3, 3]


def test_locate_chain(spark):
    ends = spark.createDataFrame([(1, "A", 100), (2, "B", 250)], "ord int, chain string, end_pos int")
    p = spark.createDataFrame([(100, 101)], "r1 int, r2 int")
    assert tuple(pairs.locate_chain(p, ends).first()) == (100, 101, "A", 100, "B", 1)
    with pytest.raises(Exception, match="no chain holds"):
        pairs.locate_chain(spark.createDataFrame([(1, 251)], "r1 int, r2 int"), ends).collect()
    with pytest.raises(Exception, match="must increase"):
        pairs.chain_bounds(spark.createDataFrame([(1, "A", 9), (2, "B", 9)], "ord int, chain string, end_pos int")).collect()


@pytest.mark.parametrize("column,want", [("AAA-", "A"), ("AG--", "a"), ("A---", "-"), ("AAGG", "a")])
def test_consensus(spark, column, want):
    cols = spark.createDataFrame([("g", k, 1, c) for k, c in enumerate(column)], "grp string, name int, col int, res string")
    assert msa.consensus(cols).first().cons == want


def test_master_slave(spark):
    hits = spark.createDataFrame([("q", 1, "AC-D", "ACXD", 1), ("q", 2, "ACD", "ACD", 1)], "query string, ord int, qaln string, saln string, qstart int")
    assert {r.ord: r.aln for r in msa.master_slave(hits).collect()} == {1: "ACXD", 2: "AC-D"}
    full = {r.ord: r.aln for r in msa.insert_query(hits, spark.createDataFrame([("q", "ACDEF")], "query string, seq string")).collect()}
    assert full == {0: "AC-DEF", 1: "ACXD--", 2: "AC-D--"}
    clash = spark.createDataFrame([("q", 1, "ACD", "ACD", 1), ("q", 2, "AXD", "ACD", 1)], "query string, ord int, qaln string, saln string, qstart int")
    flags = {r.qpos: r.conflict for r in msa.check_query(msa.hit_cells(clash)).collect()}
    assert flags == {1: False, 2: True, 3: False} and not any(r.conflict for r in msa.check_query(msa.hit_cells(clash), True).collect())


def test_subsets_and_cluster(spark):
    rows = sweep.term_subsets(spark, 6).collect()
    assert len(rows) == 63 and {tuple(r.idx) for r in rows} >= {(0,), (0, 1, 2, 3, 4, 5), (2, 5)}
    sim = {(a, a): 1.0 for a in (1, 2, 3, 4)} | {(1, 2): 0.8, (2, 3): 0.75, (1, 3): 0.4, (1, 4): 0.1, (2, 4): 0.1, (3, 4): 0.1}
    rows = [(a, b, s) for (a, b), s in sim.items()] + [(b, a, s) for (a, b), s in sim.items() if a != b]
    df = spark.createDataFrame(rows, "m1 int, m2 int, score double")
    labels = cluster.cluster(df, 0.7)
    assert {r.m: r.label for r in labels.collect()} == {1: 1, 2: 1, 3: 1, 4: -1}
    (s,) = cluster.cluster_summary(df, labels).collect()
    assert (s.size, s.centre, round(s.mean, 4)) == (3, 2, 0.65)
    assert cluster.assert_square(df).count() == 0


def brute(a, b, go, ge):
    """The best score over all alignments, by plain recursion; a gap never follows the other gap."""
    from functools import lru_cache

    row = {c: dict(zip("ARNDCQEGHILKMFPSTWYVBZ", map(int, line.split()), strict=True)) for c, line in zip("ARNDCQEGHILKMFPSTWYVBZ", align.BLOSUM62.strip().split("\n"), strict=True)}

    def score(x, y):
        return 0 if x == y == "-" else -6 if "-" in (x, y) else 0 if "X" in (x, y) else row[x][y]

    @lru_cache(None)
    def f(i, j, s):
        if i == len(a) and j == len(b):
            return 0.0
        best = -math.inf
        if i < len(a) and j < len(b):
            best = max(best, score(a[i], b[j]) + f(i + 1, j + 1, 0))
        if i < len(a) and s != 2:
            best = max(best, (ge if s == 1 else go) + f(i + 1, j, 1))
        if j < len(b) and s != 1:
            best = max(best, (ge if s == 2 else go) + f(i, j + 1, 2))
        return best

    return f(0, 0, 0)


@pytest.mark.parametrize("a,b", [("ACDEF", "ACEF"), ("A", "WWA"), ("GATTACA", "GCATGCT"), ("AAAA", "AA"), ("", "AC"), ("ACD", "A-CD"), ("WWXYZB", "WYV"), ("MKVLAAGIT", "MKAGT")])
@pytest.mark.parametrize("go,ge", [(-15.0, 0.0), (-10.0, -1.0), (-3.0, -1.0)])
def test_global_alignment(a, b, go, ge):
    q, s, score = align.global_align(a, b, go, ge)
    assert len(q) == len(s) and score == pytest.approx(brute(a, b, go, ge))
    assert q.replace("-", "") == a.replace("-", "") and s.replace("-", "") == b.replace("-", "")


def test_alignment_scores_by_hand():
    # A-A 4, C-C 9, D-D 6, E-E 5, F-F 6, W-W 11, W-F 1, I-L 2
    assert align.global_align("ACDEF", "ACDEF")[2] == 4 + 9 + 6 + 5 + 6
    assert align.global_align("ACDEF", "ACEF") == ("ACDEF", "AC-EF", 4 + 9 - 15 + 5 + 6)
    assert align.global_align("WI", "FL")[2] == 1 + 2
    assert align.global_align("ACDEFG", "ACG", -10, -1)[2] == 4 + 9 - 10 - 1 - 1 + 6
    assert align.global_align("A-C", "A-C")[2] == 4 + 0 + 9 and align.global_align("ACC", "A-C")[2] == 4 - 6 + 9


def test_transitive_alignment():
    got = align.transitive("MACDEFG", "ACDE-FG", "AC-EQFG", "ACEQFGK")
    assert got == ("ACDE-FG", "ACDE-FG", "AC-EQFG", "AC-EQFG", 2, 1)


def test_text_functions(spark):
    assert one(spark, tx.parse_evalue(F.lit("e-5"))) == 1e-5 and one(spark, tx.parse_evalue(F.lit("n/a"))) is None
    assert tuple(one(spark, tx.trim_gaps(F.lit("--AC-D"), F.lit("MAACFD"), F.lit(3), F.lit(1)))) == ("AC-D", "ACFD", 3, 3)
    assert one(spark, tx.wrap(F.lit("ABCDEF"), 2)) == "AB\nCD\nEF"
    assert [tuple(c) for c in one(spark, tx.parse_configs(F.lit("r1e20d8p0.1_r2e30d20p0")))] == [(1, 20, 8, 0.1), (2, 30, 20, 0.0)]
    with pytest.raises(Exception, match="below 1"):
        one(spark, tx.shift(F.lit(1), -3))


def write(tmp_path, **texts):
    for name, text in texts.items():
        (tmp_path / name).write_text(text)
    return str(tmp_path)


def test_listing_and_pairs(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    for d in (a, b):
        d.mkdir()
    (a / "x.prb").write_text("1 2 3 4")
    (a / "y.prb").write_text("1")
    (b / "x.prb").write_text("1")
    left, right = files.listing(spark, str(a), ".prb", True), files.listing(spark, str(b), ".prb", True)
    assert [r.name for r in files.by_size(left).collect()] == ["x", "y"]
    assert {r.name: r.partner is not None for r in files.pair_files(left, right).collect()} == {"x": True, "y": False}
    with pytest.raises(Exception, match="no partner"):
        files.pair_files(left, right, strict=True).collect()


def test_prediction_and_quality_files(spark, tmp_path):
    rows = files.lines(spark, write(tmp_path, p="  1  7  8.5 0.25\n 2 9 4 1.0 .1 .2 .3 .4 .5 .6 .7 .8 .9 1\n"))
    got = tables.predictions(rows).collect()
    assert [(r.r1, r.r2, r.dst, len(r.p)) for r in got] == [(1, 7, 8.5, 0), (2, 9, 4.0, 10)]
    with pytest.raises(Exception, match="another number of fields"):
        tables.predictions(rows, (4,)).collect()


def test_quality_file_checks(spark, tmp_path):
    rows = files.lines(spark, write(tmp_path, q="PFRMAT QA\nm1 0.5 1.0 X\nm2 0.25 2 3\nEND"))
    got = {(r.part, r.name): (r["global"], r.local) for r in tables.quality(rows).collect()}
    assert got[(1, "m1")] == (0.5, [1.0, None]) and got[(1, "m2")] == (0.25, [2.0, 3.0]) and (0, None) in got and (2, None) in got
    bad = files.lines(spark, write(tmp_path, q="m1 0.5 1.0 X\nm1 0.25 2 3"))
    with pytest.raises(Exception, match="uneven or repeated"):
        tables.quality(bad).collect()


def test_structure_files(spark, tmp_path):
    pdb = "MODEL        1\nATOM      1  CA  GLY A   5      11.000   2.000  -3.500  1.00  0.00\nATOM      2  CB  ALA A   6A     12.000   2.000  -3.500  1.00  0.00\nHETATM    3  O   HOH B   7      12.000   2.000  -3.500  1.00  0.00\nENDMDL\nATOM      1  CA  GLY A   9      11.000   2.000  -3.500\n"
    got = tables.atoms(files.lines(spark, write(tmp_path, x=pdb)), hetatm=False).orderBy("serial").collect()
    assert [(r.atom, r.resname, r.resnum, r.icode, r.x, r.z) for r in got] == [("CA", "GLY", 5, "", 11.0, -3.5), ("CB", "ALA", 6, "A", 12.0, -3.5)]
    assert [r.chain for r in tables.atoms(files.lines(spark, str(tmp_path)), "B").collect()] == ["B"]


def test_mmcif(spark, tmp_path):
    items = "group_PDB id label_atom_id label_comp_id auth_asym_id auth_seq_id pdbx_PDB_ins_code Cartn_x Cartn_y Cartn_z pdbx_PDB_model_num".split()
    text = "data_x\nloop_\n" + "".join(f"_atom_site.{i}\n" for i in items) + "ATOM 1 CA GLY A 5 ? 1.5 2 3 1\nATOM 2 CA GLY B 6 ? 1 2 3 1\nATOM 3 CA GLY A 5 ? 1 2 3 2\n#\n"
    got = tables.atoms_mmcif(files.lines(spark, write(tmp_path, x=text))).collect()
    assert [(r.serial, r.chain, r.resnum, r.icode, r.x) for r in got] == [(1, "A", 5, "", 1.5)]


def profile_text(n=2):
    def pos(k, res):
        records = [f"{k} {res}    " + " ".join(str(100 * j) for j in range(20)), " ".join(str(1000 * j) for j in range(9)), "1500 2000 500", "9000 3", "7000 20 10", "5 4 3", "CV: " + " ".join(str(10 * j) for j in range(22)), "SS:C 6000 3000 1000"]
        return "\n".join([records[0], *["      " + r for r in records[1:]]])

    return f"COMER profile v1\nDESC: d\nFILE: f\nLEN:    {n}\nSCALE:  10000\n" + "\n".join(pos(k + 1, "AC"[k]) for k in range(n)) + "\n      K, Lambda: 1 2\n*\n".replace("      K", "K")


def test_profile(spark, tmp_path):
    rows = files.lines(spark, write(tmp_path, p=profile_text()))
    got = tables.profile(rows).orderBy("pos").collect()
    assert [(r.pos, r.res, len(r.attrs)) for r in got] == [(1, "A", 59), (2, "C", 59)]
    v = [round(x, 4) for x in got[1].attrs]
    assert v[:2] == [2, 4] and v[2:22] == [round(0.01 * j, 4) for j in range(20)]
    assert v[22:29] == [0, 0.1, 0.2, 0.3, 0.4, 0.6, 0.8] and v[29:32] == [1.5, 2.0, 0.5]
    assert v[32:35] == [0.9, 0.7, 5] and v[35:56] == [round(0.001 * j, 4) for j in range(22) if j != 2] and v[56:] == [0.6, 0.3, 0.1]
    bad = files.lines(spark, write(tmp_path, p=profile_text().replace("9000 3", "9000 0")))
    with pytest.raises(Exception, match="not a record of a profile"):
        tables.profile(bad).collect()


def test_fasta_and_pairwise(spark, tmp_path):
    path = write(tmp_path, f=">q one\nAC.d\nEF\n>s two\nACGD\n-F\n")
    aln = reports.fasta(spark, path)
    assert [(r.name, r.aln) for r in aln.orderBy("ord").collect()] == [("q", "AC-DEF"), ("s", "ACGD-F")]
    (h,) = reports.aligned_hits(aln, "q").collect()
    assert (h.sbjct, h.qaln, h.saln, h.qend, h.send) == ("s", "AC-DEF", "ACGD-F", 5, 5)
    pw = tmp_path / "pw"
    pw.mkdir()
    (pw / "x").write_text(">q (ALN: 1-4) of one  Expect=e-7\nAC-D\nE\n>s (ALN: 3-6) LEN=90 two 2-3b  Expect=e-7\nACGD\n-\n//\n>q (ALN: 1-1)   Expect=0.5\nA\n>t (ALN: 2-2)   Expect=n/a\nA\n//\n")
    got = [(r.query, r.sbjct, r.evalue, r.qaln, r.saln, r.qstart, r.send, r.slen) for r in reports.pairwise(spark, str(pw)).orderBy("ord").collect()]
    assert got[1] == ("q", "t", 0.5, "A", "A", 1, 2, None) and got[0][:6] == ("q", "s", 1e-7, "AC-DE", "ACGD-", 1) and got[0][7] == 90
    hits = spark.createDataFrame([(0, "q", "of one", 1, 4, "AC-DE", "d9", "", 3, 6, "ACGD-", "1e-07")], "ord int, query string, qdescr string, qstart int, qend int, qaln string, sbjct string, sdescr string, sstart int, send int, saln string, evalue string")
    assert sinks.pairwise_lines(hits, 3).first().line == ">q (ALN: 1-4) of one  Expect=1e-07\nAC-\nDE\n>d9 (ALN: 3-6)   Expect=1e-07\nACG\nD-\n//"
    h = one(spark, tx.parse_header(F.lit(">d1 (ALN: 3-90) text  Expect=1e-5")))
    assert tuple(h) == ("d1", 3, 90, 1e-5, None)


def test_reports(spark, tmp_path):
    hh = "Query         q some\nMatch_columns 90\nResults from round 2\nNo 1\n>d1 first\nProbab=99.0  E-value=1e-10  Score=50.1\n\nQ ss_pred          CCC\nQ q             3 AC-DE    6 (90)\nQ Consensus     3 ac-de    6 (90)\nT Consensus     7 acgde   11 (50)\nT d1            7 aCGDE   11 (50)\n\nQ q             7 FF    8 (90)\nT d1           12 FF   13 (50)\nProbab=1.0  E-value=3  Score=1\nQ q             7 F    7 (90)\nT d1           12 F   12 (50)\nNo 2\n>d2\nProbab=9  E-value=e-3  Score=1\nQ q             1 A    1 (90)\nT d2            2 A    2 (9)\n"
    hm = "Query:       q1  [L=90]\n@@ Round:                  2\n>> s1 desc LEN=77\n   #    score  bias  c-Evalue  i-Evalue hmmfrom  hmm to\n   1 !   50.0   0.1   1.0e-09   2.0e-08       1       4 ..\n   2 ?   10.0   0.1   1.0e-03   e-02       5       6 ..\n\n  == domain 1  score: 50.0 bits;  conditional E-value: 1e-09\n  q1-cons 1 AC.d 3\n            AC+d\n  s1      5 aCGD 8\n  == domain 2  score: 9 bits;  conditional E-value: 1e-3\n  q1-cons 2 AA 3\n  s1      9 AA 10\nInternal pipeline statistics\n"
    cm = ">s9 text\n Length of subject = 40\n Score = 9.1, Expect = 3e-2, P = 1\nQuery: 4 ACD 6\nSbjct: 1 A-D 2\nQuery: 7 EF 8\nSbjct: 3 EF 4"
    for kind, text in (("profile", hh), ("domain", hm), ("pair", cm)):
        d = tmp_path / kind
        d.mkdir()
        (d / "r").write_text(text)

    def hits(kind, **options):
        return [(r.round, r.descr, r.evalue, r.qaln, r.saln, r.qstart, r.qend, r.sstart, r.send, r.slen) for r in reports.report_hits(spark, str(tmp_path / kind), kind, **options).orderBy("ord").collect()]

    first, second = (2, "d1 first", 1e-10, "AC-DEFF", "aCGDEFF", 3, 8, 7, 13, 50), (2, "d2", 1e-3, "A", "A", 1, 1, 2, 2, 9)
    assert hits("profile") == [first, second] and hits("profile", alternatives=True) == [first, (2, "d1 first", 3.0, "F", "F", 7, 7, 12, 12, 50), second]
    best = (2, "s1 desc LEN=77", 2e-8, "AC-d", "aCGD", 1, 3, 5, 8, 77)
    assert hits("domain") == [best] and hits("domain", alternatives=True) == [best, (2, "s1 desc LEN=77", 0.01, "AA", "AA", 2, 3, 9, 10, 77)]
    assert hits("pair") == [(1, "s9 text", 0.03, "ACDEF", "A-DEF", 4, 8, 1, 4, 40)]


def test_structural_report(spark, tmp_path):
    text = "<html><PRE>\nQuery skip 1\n<h3> No 1: Query=1abcA Sbjct=2xyzB Z-score=12.5</h3>\nDSSP  LLL\nQuery ..acD-   2\nident  xx\nSbjct mk-ck-   5\n\nQuery EF   9\nSbjct EF   7\n</PRE>\n<PRE>\n<h3> No 2: Query=1abcA Sbjct=3 Z-score=2.5</h3>\nQuery AA   2\nSbjct AA   3\n</PRE></html>"
    (r,) = reports.structural_report(spark, write(tmp_path, d=text)).collect()
    assert (r.zscore, r.qaln, r.saln, r.qstart, r.sstart) == (12.5, "cD-EF", "ck-EF", 2, 3)
    assert tuple(one(spark, tx.trim_gaps(F.lit("A-CD"), F.lit("-BCD"), F.lit(1), F.lit(1)))) == ("CD", "CD", 2, 2)


def test_line_formats(spark):
    pred = spark.createDataFrame([(3, 12, 8.25, 0.5, [0.1] * 10, "G", "A")], "r1 int, r2 int, dst double, prob double, p array<double>, res1 string, res2 string")
    assert sinks.prediction_lines(pred).first().line == "3 12  8.3 0.500   " + " 0.100" * 10 or sinks.prediction_lines(pred).first().line == "3 12  8.2 0.500   " + " 0.100" * 10
    every = pred.withColumn("p", F.array(F.lit(0.7), F.lit(0.2), F.lit(0.1)))
    assert sinks.prediction_lines(every, every=True).first().line.endswith("0.500    0.200 0.100  0.700")
    wide = spark.createDataFrame([(1, 9, 5.0, 0.9, None, None)], "r1 int, r2 int, dst_0 double, prob_0 double, dst_1 double, prob_1 double")
    assert [r.line for r in sinks.combined_lines(wide, 2).orderBy("part").collect()] == ["#R1 R2       Dst  Prob    Dst  Prob", "1 9          5.0 0.900   ---- -----"]
    want = {
        "HARMONIC": "HARMONIC 8.0 0.5",
        "FLAT_HARMONIC": "FLAT_HARMONIC 8.0 1 4",
        "BOUNDED": "BOUNDED 0 8.0 0.501 199.6 TAG",
        "SIGMOID": "SCALARWEIGHTEDFUNC 2.500 SUMFUNC 2 SIGMOID 10.0 2.0 CONSTANTFUNC -0.5",
        "SIGMOID2": "SCALARWEIGHTEDFUNC 2.500 SUMFUNC 2 SIGMOID 10.0 2.0 SCALARWEIGHTEDFUNC -1.0 SIGMOID 6.0 2.0",
    }
    for kind, text in want.items():
        assert sinks.constraint_lines(pred.withColumn("dst", F.lit(8.0)), kind, first=3).first().line == f"AtomPair CA 1 CB 10 {text}"
    mean = spark.createDataFrame([(2, 9, 0.123456, [0.00001234, 1.0, 0.5]), (1, 9, 0.0, [0.25, 0.0, 12345.0])], "r1 int, r2 int, contact double, p array<double>")
    lines = [r.line for r in sinks.distance_file(mean, "T1").orderBy("part", "ord").collect()]
    assert lines[5:] == ["1 9  0  0.25 0 1.23e+04", "2 9  0.123  1.23e-05 1 0.5", "END"]
    located = mean.withColumns({"chain1": F.lit("A"), "pos1": F.lit(2), "chain2": F.lit("B"), "pos2": F.lit(1)})
    assert "A2 B1  0.123  1.23e-05 1 0.5" in [r.line for r in sinks.distance_file(located, "T1").collect()]
    local = spark.createDataFrame([("m", 0, 1.25), ("m", 2, 3.0)], "name string, k int, local double")
    scores = spark.createDataFrame([("m", 0.5)], "name string, global double")
    line = sinks.quality_lines(local, scores, 3, first=0)
    assert line.first().line in ("m 0.50000   1.3 X 3.0", "m 0.50000   1.2 X 3.0")
    assert [r.line for r in sinks.quality_file(line, "T1").orderBy("part", "name").collect()][-1] == "END"
    pssm = sinks.pssm_lines(spark.createDataFrame([("p", 1, "A", [1, -2], [10, 0])], "name string, pos int, res string, scores array<int>, percents array<int>"))
    assert [r.line for r in pssm.orderBy("part", "pos").collect()][1] == "    1 A     1  -2   10   0  0.00     0.00"
    ss = sinks.ss_lines(spark.createDataFrame([("p", 1, "A", "H", [2500, 2500, 5000])], "name string, pos int, res string, state string, p array<int>"))
    assert [r.line for r in ss.orderBy("pos").collect()] == ["# PSIPRED VFORMAT (PSIPRED V2.6)", "   1 A H   0.250  0.250  0.500"]


def test_alignment_files(spark):
    aln = spark.createDataFrame([("g", 0, "q", "query", 1, 4, 0.0, "A-CD"), ("g", 1, "s", "two", 3, 6, 1e-7, "AXC-")], "grp string, ord int, name string, descr string, start int, end int, evalue double, aln string")
    got = "\n".join(r.line for r in sinks.msa_file(aln).orderBy("part", "ord").collect())
    want = ["# STOCKHOLM 1.0", "#=GF ID q", "##=GF DE query", "", "#=GS q" + " " * 25 + " DE query", "#=GS s/3-6" + " " * 21 + " DE (3-6) two  Expect=1e-07", "", "q" + " " * 34 + "A.CD", "s/3-6" + " " * 30 + "AXC-", "#=GC RF" + " " * 28 + "A.CD", "//"]
    assert got.split("\n") == want
    got = "\n".join(r.line for r in sinks.msa_file(aln, "rosetta").orderBy("part", "ord").collect())
    assert got.split("\n") == ["## q query", "## s (3-6) two  Expect=1e-07", "## q s", "scores from program: 0", "0 A-CD", "0 AXC-"]
    hit = spark.createDataFrame([(0, 12.5, "1abcA", "a.1.1.1", 2, 9, 1, "2xyzB", "b.1", 3, 10, 1, "AC", "AC", "GC", "GC")], "ord int, zscore double, query string, qscop string, qstart int, qend int, qbeg int, sbjct string, sscop string, sstart int, send int, sbeg int, qseq string, qstr string, sstr string, sseq string")
    assert sinks.superposition_blocks(hit).first().line.split("\n") == [">1abcA     a.1.1.1          1 SEQUENCE", "AC", ">1abcA     a.1.1.1          2 9          12.5", "AC", ">2xyzB     b.1              3 10  ", "GC", ">2xyzB     b.1              1 SEQUENCE", "GC", "//"]


def test_tables_and_their_errors(spark, tmp_path):
    sim = spark.createDataFrame([("f", x) for x in ("# c", "a b 0.5 1 2 3 4 5 6 7 8", "short line", "a c 0.25 1 2 3 4 5 6 7 8")], "file string, line string")
    assert sorted((r.m1, r.m2, r.score) for r in cluster.cluster_table(sim).collect()) == [("a", "b", 0.5), ("a", "c", 0.25)]
    cov = lambda size: files.lines(spark, write(tmp_path, c=f"# note\nLength=  2 xcov_size=  {size}\n1 1 0.5 1\n1 2 1 2\n2 2 3 4\n"))
    assert [(r.i, r.j, r.xcov) for r in tables.xcov(cov(2), 2).orderBy("i", "j").collect()] == [(1, 1, [0.5, 1]), (1, 2, [1, 2]), (2, 2, [3, 4])]
    with pytest.raises(Exception, match="needs 2 values"):
        tables.xcov(cov(3), 2).collect()
    base = spark.createDataFrame([("f", 0, "COMER profile v1\nDESC: x\nFILE: other\n"), ("f", 1, "COMER profile v1\nDESC: y\nFILE: d1abc.pro\n"), ("f", 2, "FILE: d1abd\n")], "file string, ord long, line string")
    assert [r.ord for r in tables.profile_record(base, "d1ab").collect()] == [1]
    summary = lambda *x: spark.createDataFrame([("f", k, t) for k, t in enumerate(x)], "file string, ord long, line string")
    assert [(r.config, r.target, r.t_sd) for r in tables.eval_summary(summary("m1 1 2 | T1 3 4 T2 5 6")).collect()] == [("m1", "T1", 4), ("m1", "T2", 6)]
    for bad in (("m1 1 2 | T1 3 4", "m1 1 2 | T1 3 4"), ("m1 1 2 | T1 3 4", "m2 1 2 | T1 3 4 T2 5 6")):
        with pytest.raises(Exception, match="uneven line"):
            tables.eval_summary(summary(*bad)).collect()
    d, f = spark.createDataFrame([("d1",), ("abcd1",)], "domain string"), spark.createDataFrame([("d1x",), ("d",), ("abcd12",), ("d1",)], "name string")
    assert sorted((r.domain, r.name, r.matches) for r in runs.prefix_match(d, f).collect()) == [("abcd1", "abcd12", 1), ("d1", "d1", 2), ("d1", "d1x", 2)]
    palette = {r.cls: (r.name, r.r) for r in sinks.class_dictionary(spark).collect()}
    assert palette[0] == ("Background", 255) and palette[1] == ("2", 0) and palette[2] == ("3", 3) and palette[62] == ("63", 183)


def test_structure_errors(spark):
    atoms = spark.createDataFrame([("A", 1, "CA", "GLY", False), ("A", 2, "CA", "ALA", False), ("A", 2, "CB", "ALA", False), ("A", 3, "CA", "ALA", False)], "chain string, resnum int, atom string, resname string, het boolean")
    assert [(r.resnum, r.atom) for r in pairs.pick_atom(atoms).orderBy("resnum").collect()] == [(1, "CA"), (2, "CB")]
    assert pairs.pick_atom(atoms.filter("resnum < 3"), need=["chain", "resnum"]).count() == 2
    with pytest.raises(Exception, match="no such atom in residue A 3"):
        pairs.pick_atom(atoms, need=["chain", "resnum"]).collect()
    points = spark.createDataFrame([("A", 1, 5), ("A", 2, 7), ("A", 3, 6)], "chain string, idx int, resnum int")
    with pytest.raises(Exception, match="out of order or range in chain A 6"):
        pairs.checked_numbers(points).collect()
    lengths = spark.createDataFrame([("A", 6)], "chain string, length int")
    assert pairs.checked_numbers(points.filter("idx <> 2"), lengths).count() == 2
    with pytest.raises(Exception, match="out of order or range in chain A 7"):
        pairs.checked_numbers(points.filter("idx <> 3"), lengths).collect()
    qa = spark.createDataFrame([("m", 1, 2.0)], "name string, k int, local double")
    en = spark.createDataFrame([("m", 1, [1.0]), ("m", 9, [1.0])], "name string, k int, terms array<double>")
    size = spark.createDataFrame([("m", 3)], "name string, length int")
    assert quality.join_energy(qa, en.filter("k = 1"), size).first().terms == [1.0]
    with pytest.raises(Exception, match="beyond the length of m 9"):
        quality.join_energy(qa, en, size).collect()


def test_rank_without_one_task(spark):
    rows = [(f"m{k}", s) for k, s in enumerate([0.5, 1.0, 0.0, 0.5, 0.99995, 0.99994, 0.12])]
    got = {r.name: r.rank for r in quality.rank_models(spark.createDataFrame(rows, "name string, global double")).collect()}
    assert got == {n: k for k, (n, _) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1)}


def test_config_names(spark):
    name = "QA2__modelRUN1e20__full_d8_p0.1QA2__modelRUN2e5__full_d20_p0"
    assert [tuple(c) for c in one(spark, tx.parse_configs(F.lit(name)))] == [(1, 20, 8, 0.1), (2, 5, 20, 0.0)]


def test_union_unique_and_dictionary(spark, tmp_path):
    a = spark.createDataFrame([("x",)], "k string")
    with pytest.raises(Exception, match="occurs twice"):
        runs.union_unique(["k"], a, a).collect()
    out = str(tmp_path / "dict")
    sinks.class_dictionary(spark).select("name", "r", "g", "b").coalesce(1).write.csv(out, header=True)
    assert files.class_dictionary(spark, out).count() == 64
