"""Files read in many ranges give the rows that they give whole, records across the cuts included."""

import random

import pytest
from spinel.sources import files, reports, split_files, tables


@pytest.fixture
def ranges(spark):
    """Sets how many bytes a range has."""
    conf = spark.conf
    old = conf.get("spark.sql.files.maxPartitionBytes"), conf.get("spark.sql.files.openCostInBytes")

    def put(size):
        conf.set("spark.sql.files.maxPartitionBytes", str(size))
        conf.set("spark.sql.files.openCostInBytes", "1")

    yield put
    conf.set("spark.sql.files.maxPartitionBytes", old[0])
    conf.set("spark.sql.files.openCostInBytes", old[1])


def profile_report(rng, n):
    out = ["Query         q", "Match_columns 9"]
    for k in range(n):
        if k % 17 == 0:
            out += [f"Results from round {k // 17 + 1}", "", " No Hit   Prob", ""]
        out += [f"No {k}", f">s{k} some words", f"Probab=9  E-value={rng.choice(['1e-5', 'e-7', '0.3'])}  Score=1", ""]
        at = 1
        for _ in range(rng.randint(1, 4)):
            m = rng.randint(1, 9)
            out += [f"Q q  {at} {'A' * m} {at + m - 1} (90)", "Q Consensus  1 a 1 (90)", f"T s{k}  {at} {'C' * m} {at + m - 1} (50)", ""]
            at += m
        if k % 5 == 0:
            out += ["Probab=1  E-value=3  Score=1", "Q q 1 A 1 (90)", f"T s{k} 1 A 1 (50)"]
    return "\n".join(out) + "\n"


def domain_report(rng, n):
    out = ["Query:       q1  [L=90]"]
    for k in range(n):
        if k % 13 == 0:
            out += [f"@@ Round:  {k // 13 + 1}"]
        out += [f">> d{k} first LEN=50"] + [f"   {j} !   50.0   0.1   1.0e-09   1e-{rng.randint(1, 9)}       1       4 .." for j in (1, 2)]
        for j in (1, 2):
            out += ["", f"  == domain {j}  score: 50.0 bits", "  q1  1 AC.DE 4", f"  d{k}   2 ACGDE 6"]
    return "\n".join(out) + "\n"


def pair_report(rng, n):
    return "".join(f">d{k} first\n Length = 50\n Score = 9.1, Expect = 1e-{rng.randint(1, 9)}, P = 1\nQuery: 1 AC-DE 4\nSbjct: 2 ACGDE 6\n\nQuery: 5 W 5\nSbjct: 7 W 7\n" for k in range(n))


@pytest.mark.parametrize(("kind", "make"), [("profile", profile_report), ("domain", domain_report), ("pair", pair_report)])
@pytest.mark.parametrize("alternatives", [False, True])
def test_reports(spark, tmp_path, ranges, kind, make, alternatives):
    for n in range(2):
        (tmp_path / f"f{n}.txt").write_text(make(random.Random(n), 60 + n))
    want = sorted(map(tuple, reports.report_hits(spark, str(tmp_path), kind, alternatives).collect()))
    assert len({r[0] for r in want}) == 2 and len(want) >= 120
    for size, stretch in ((1 << 27, 1 << 16), (300, 40)):
        ranges(size)
        lines = split_files.line_table(spark, str(tmp_path))
        assert sorted(map(tuple, split_files.report_hits(lines, kind, alternatives, stretch).collect())) == want
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20


def test_fasta_and_pairwise(spark, tmp_path, ranges):
    rng = random.Random(3)
    (tmp_path / "a").mkdir()
    (tmp_path / "b").mkdir()
    seq = lambda: "".join(rng.choice("ACDE.-\n") for _ in range(rng.randint(1, 300))).strip("\n") or "A"
    (tmp_path / "a" / "x.fa").write_text("; a line before\n" + "".join(f">d{k} text {k}\n{seq()}\n" for k in range(80)))
    (tmp_path / "b" / "x.txt").write_text("".join(f">q (ALN: 1-9) of it  Expect=e-3\n{'AC' * (k % 40 + 1)}\n>s{k} (ALN: 3-9) other  Expect=e-3\n{'CA' * (k % 40 + 1)}\n//\n" for k in range(80)))
    want = [sorted(map(tuple, f(spark, str(tmp_path / d)).collect())) for f, d in ((reports.fasta, "a"), (reports.pairwise, "b"))]
    for size, stretch in ((1 << 27, 1 << 16), (200, 25)):
        ranges(size)
        got = [sorted(map(tuple, f(split_files.line_table(spark, str(tmp_path / d)), stretch).collect())) for f, d in ((split_files.fasta, "a"), (split_files.pairwise, "b"))]
        assert got == want and len(got[0]) == len(got[1]) == 80


def test_numbers_follow_the_file(spark, tmp_path, ranges):
    text = ["x" * random.Random(k).randint(0, 9) for k in range(500)]
    (tmp_path / "f.txt").write_text("\n".join(text) + "\n")
    ranges(64)
    rows = split_files.line_table(spark, str(tmp_path)).orderBy("ord").collect()
    assert [r.line for r in rows] == text and len({r.ord for r in rows}) == 500


def test_profiles_and_atoms_by_stretches(spark, tmp_path, ranges):
    position = lambda k: [f"{k} A " + " ".join(str(j * 10) for j in range(20)), "   " + " ".join("1" for _ in range(9)), "   1 2 3", "   9 3", "   4 5", "   6 7", "   CV: " + " ".join(str(j) for j in range(22)), "   SS:C 6 3 1"]
    (tmp_path / "p.pro").write_text("\n".join(["COMER", "LEN: 40", "SCALE: 10"] + [x for k in range(1, 41) for x in position(k)]) + "\n")
    whole = sorted(map(tuple, tables.profile(files.lines(spark, str(tmp_path))).collect()))
    ranges(150)
    lines = split_files.line_table(spark, str(tmp_path))
    assert sorted(map(tuple, tables.profile(lines, 100).collect())) == whole and len(whole) == 40
    atom = lambda k, c: f"ATOM  {k:5d}  CA  GLY {c}{k:4d}    {k:8.3f}{1:8.3f}{2:8.3f}"
    (tmp_path / "s").mkdir()
    (tmp_path / "s" / "s.pdb").write_text("\n".join([atom(k, "B" if k < 50 else "A") for k in range(1, 90)] + ["ENDMDL"] + [atom(1, "B")]) + "\n")
    got = tables.atoms(split_files.line_table(spark, str(tmp_path / "s"))).collect()
    assert sorted(r.serial for r in got) == list(range(1, 50)) and {r.chain for r in got} == {"B"}


def test_empty_files(spark, tmp_path):
    (tmp_path / "f.txt").write_text("")
    lines = split_files.line_table(spark, str(tmp_path))
    assert lines.count() == 0 and split_files.fasta(lines).count() == 0 and split_files.report_hits(lines, "pair").count() == 0


def test_profile_database(spark, tmp_path, ranges):
    (tmp_path / "db").write_text("".join(f"profile\nDESC: d{k}\nFILE: f{k}.pro\n{'x ' * (k % 30)}\n*\n" for k in range(60)))
    ranges(100)
    rows = split_files.profile_database(split_files.line_table(spark, str(tmp_path)), 50)
    assert rows.count() == 60
    assert tables.profile_record(rows, "f17.p").first().line == "profile\nDESC: d17\nFILE: f17.pro\n" + "x " * 17
