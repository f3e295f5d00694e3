"""Queries that write finished files, one for each target, and read them back whole.

Numbers are cut to the places that the format prints before they are formatted, so that SQL can write them from whole numbers.
"""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from . import carriers as C
from .operators import ensemble, pairs, quality
from .queries import query
from .session import scratch_folder as _folder
from .session import table
from .sources import outfiles, sinks, split_files


def _cut(x, places: int):
    """Half up at so many places; the small part decides ties that sums in another order would shift."""
    return F.floor(x * 10**places + 0.5 + 1e-6) / 10**places


def _whole(x: str, places: int) -> str:
    """The same as a whole number, in SQL."""
    return f"floor({x} * {10**places} + 0.5 + 1e-6)::BIGINT"


def _fixed(n: str, places: int) -> str:
    """A whole number of 10^-places, as printed with all places, in SQL."""
    return f"(({n}) // {10**places}) || '.' || lpad((({n}) % {10**places})::VARCHAR, {places}, '0')"


def _short(n: str) -> str:
    """A whole number of hundredths up to a few units, as printed with three significant digits at most, in SQL."""
    return f"CASE WHEN ({n}) % 100 = 0 THEN (({n}) // 100)::VARCHAR WHEN ({n}) % 10 = 0 THEN (({n}) // 100) || '.' || (({n}) // 10 % 10) ELSE {_fixed(n, 2)} END"


def _read(spark, lines, name, **given):
    out = f"{_folder(spark, name)}/files"
    outfiles.write_files(lines, out, **given)
    return outfiles.read_files(spark, out)


TARGETS = ", tp AS (SELECT 'T' || (r1 % 4) AS target, * FROM predictions), te AS (SELECT 'T' || t AS target, ord, chain, end_pos + 3 * t * ord AS end_pos FROM chain_ends, range(4) r(t)), tb AS (SELECT *, coalesce(lag(end_pos) OVER (PARTITION BY target ORDER BY ord), 0) + 1 AS beg FROM te)"


def _target_predictions(spark, sf):
    return C.predictions(spark, sf).withColumn("target", F.concat(F.lit("T"), F.col("r1") % 4))


def _target_ends(spark, sf):
    t = F.explode(F.array(*[F.lit(k) for k in range(4)])).alias("t")
    return C.chain_ends(spark, sf).select("ord", "chain", "end_pos", t).select(F.concat(F.lit("T"), "t").alias("target"), "ord", "chain", (F.col("end_pos") + 3 * F.col("t") * F.col("ord")).alias("end_pos"))


@query(f"{TARGETS} SELECT target, ord, chain, beg, end_pos FROM tb", "predictions chain_ends")
def w07_chain_bounds_of_targets(spark, sf):
    return pairs.chain_bounds(_target_ends(spark, sf), "target")


@query(f"{TARGETS} SELECT p.target, predictor, r1, r2, a.chain AS chain1, r1 - a.beg + 1 AS pos1, b.chain AS chain2, r2 - b.beg + 1 AS pos2 FROM tp p JOIN tb a ON a.target = p.target AND r1 BETWEEN a.beg AND a.end_pos JOIN tb b ON b.target = p.target AND r2 BETWEEN b.beg AND b.end_pos", "predictions chain_ends")
def j09_locate_chain_of_targets(spark, sf):
    return pairs.locate_chain(_target_predictions(spark, sf).select("target", "predictor", "r1", "r2"), _target_ends(spark, sf), "target")


DISTANCE = (
    TARGETS
    + ", bins AS (SELECT target, r1, r2, count(*) AS c, ["
    + ", ".join(f"sum(p[{k + 1}])" for k in range(10))
    + "] AS b FROM tp GROUP BY target, r1, r2), mean AS (SELECT target, r1, r2, ["
    + ", ".join(f"{_whole(f'(b[{k + 1}]' + (' + greatest(3 - c, 0)' if k == 9 else '') + ') / greatest(3, c)', 2)}" for k in range(10))
    + f"] AS q, {_whole('(b[1] + b[2] + b[3]) / greatest(3, c)', 2)} AS contact FROM bins),"
    + " loc AS (SELECT m.*, a.chain AS c1, r1 - a.beg + 1 AS p1, b.chain AS c2, r2 - b.beg + 1 AS p2 FROM mean m JOIN tb a ON a.target = m.target AND r1 BETWEEN a.beg AND a.end_pos JOIN tb b ON b.target = m.target AND r2 BETWEEN b.beg AND b.end_pos),"
    + f" body AS (SELECT target, 1 AS part, r1, r2, c1 || p1 || ' ' || c2 || p2 || '  ' || {_short('contact')} || ' ' || array_to_string(list_transform(q, lambda n: ' ' || {_short('n')}), '') AS line FROM loc WHERE c1 <> c2 OR abs(p2 - p1) >= 6),"
    + " lines AS (SELECT * FROM body UNION ALL SELECT target, 0, k, 0, line FROM (SELECT DISTINCT target FROM body), (SELECT unnest(range(5)) AS k) r, LATERAL (SELECT ['PFRMAT RR', 'TARGET ' || target, 'AUTHOR spinel', 'RMODE  2', 'MODEL  1'][k + 1] AS line) UNION ALL SELECT DISTINCT target, 2, 0, 0, 'END' FROM body)"
    + " SELECT target AS file, string_agg(line, chr(10) ORDER BY part, r1, r2) || chr(10) AS value FROM lines GROUP BY target"
)


@query(DISTANCE, "predictions chain_ends")
def k03_distance_files(spark, sf):
    """The files of four targets, each with chains of its own; pairs of two chains stay however close their numbers are."""
    mean = ensemble.ensemble_mean(_target_predictions(spark, sf), 3, 0, ("target",))
    mean = mean.select("target", "r1", "r2", F.transform("p", lambda x: _cut(x, 2)).alias("p"), _cut(F.col("contact"), 2).alias("contact"))
    located = pairs.chain_sep(pairs.locate_chain(mean, _target_ends(spark, sf), "target"))
    return _read(spark, sinks.distance_files(located), "distances")


@query(
    f"SELECT 'p' || predictor AS file, string_agg(r1 || ' ' || r2 || '  ' || {_fixed(_whole('dst', 1), 1)} || ' ' || {_fixed(_whole('prob', 3), 3)} || '   ' || array_to_string(list_transform(p, lambda x: ' ' || {_fixed(_whole('x', 3), 3)}), ''), chr(10) ORDER BY r1, r2) || chr(10) AS value FROM predictions GROUP BY predictor",
    "predictions",
)
def k01_prediction_files(spark, sf):
    pred = C.predictions(spark, sf).withColumns({"dst": _cut(F.col("dst"), 1), "prob": _cut(F.col("prob"), 3), "p": F.transform("p", lambda x: _cut(x, 3))})
    # the line is of one row, so it can be made beside the row's predictor
    lines = sinks.prediction_lines(pred, beside=("predictor",)).withColumn("target", F.concat(F.lit("p"), "predictor"))
    return _read(spark, lines, "predictions", order=("r1", "r2"))


@query(
    f"""{TARGETS}, wide AS (SELECT target, r1, r2, {', '.join(f"max(CASE WHEN predictor = {k} THEN dst END) AS d{k}, max(CASE WHEN predictor = {k} THEN prob END) AS q{k}" for k in range(3))} FROM tp WHERE r2 - r1 >= 6 GROUP BY target, r1, r2),
l AS (SELECT target, r1, r2, CASE WHEN length(r1 || ' ' || r2) > 9 THEN r1 || ' ' || r2 ELSE rpad(r1 || ' ' || r2, 9, ' ') END || {" || ".join(f"CASE WHEN d{k} IS NULL THEN '   ---- -----' ELSE '   ' || lpad({_fixed(_whole(f'd{k}', 1), 1)}, 4, ' ') || ' ' || {_fixed(_whole(f'q{k}', 3), 3)} END" for k in range(3))} AS line FROM wide)
SELECT target AS file, '#R1 R2   ' || repeat('    Dst  Prob', 3) || chr(10) || string_agg(line, chr(10) ORDER BY r1, r2) || chr(10) AS value FROM l GROUP BY target""",
    "predictions chain_ends",
)
def k02_combined_files(spark, sf):
    pred = _target_predictions(spark, sf).withColumns({"dst": _cut(F.col("dst"), 1), "prob": _cut(F.col("prob"), 3)})
    wide = ensemble.pivot_predictors(pred, 3, keys=("target",))
    return _read(spark, sinks.combined_files(wide, 3), "combined")


QUALITY = (
    "e AS (SELECT name, k, avg(local) AS local FROM quality GROUP BY name, k), g AS (SELECT name, CASE WHEN avg(local) IS NULL THEN 0 ELSE greatest(0, least(1, 1 - avg(local) / 8)) END AS g FROM e GROUP BY name),"
    " cells AS (SELECT name, string_agg(coalesce(' ' || " + _fixed(_whole("local", 1), 1) + ", ' X'), '' ORDER BY k) AS cells FROM (SELECT DISTINCT name FROM e WHERE local IS NOT NULL) CROSS JOIN range(50) r(k) LEFT JOIN e USING (name, k) GROUP BY name),"
    " body AS (SELECT 'T' || (substr(name, 2)::BIGINT % 5) AS target, name, name || ' ' || " + _fixed(_whole("g", 5), 5) + " || '  ' || cells AS line FROM cells JOIN g USING (name))"
    " SELECT target AS file, 'PFRMAT QA' || chr(10) || 'TARGET ' || target || chr(10) || 'REMARK Error estimate is CB-CB distance in Angstroms' || chr(10) || 'MODEL  1' || chr(10) || 'QMODE  2' || chr(10)"
    " || string_agg(line, chr(10) ORDER BY substr(name, 2)::BIGINT) || chr(10) || 'END' || chr(10) AS value FROM body GROUP BY target"
)


@query(f", {QUALITY}", "quality")
def k05_quality_files(spark, sf):
    qa = ensemble.ensemble_quality(C.quality(spark, sf))
    scores = quality.global_score(qa, ["name"]).withColumn("global", _cut(F.col("global"), 5))
    lines = sinks.quality_lines(qa.filter("local IS NOT NULL").withColumn("local", _cut(F.col("local"), 1)), scores, 50, first=0)
    number = F.substr("name", F.lit(2)).cast("long")
    return _read(spark, sinks.quality_files(lines.select(F.concat(F.lit("T"), number % 5).alias("target"), number.alias("ord"), "line")), "quality")


@query("SELECT grp AS file, string_agg('>' || name || chr(10) || rtrim(regexp_replace(aln, '(.{20})', '\\1' || chr(10), 'g'), chr(10)), chr(10) ORDER BY name) || chr(10) AS value FROM (SELECT lang AS grp, * EXCLUDE (grp) FROM (SELECT grp[1:2] AS lang, * FROM alignment) WHERE ends_with(grp, ':0')) GROUP BY grp", "alignment")
def k07_fasta_files(spark, sf):
    """One alignment for each language: its texts' first blocks."""
    aln = C.alignment(spark, sf).filter(F.col("grp").endswith(":0"))
    lines = sinks.msa_lines(aln, "fasta", 20, beside=("grp",)).select(F.substring("grp", 1, 2).alias("target"), F.col("name").alias("ord"), "line")
    return _read(spark, lines, "fasta", order=("ord",), suffix=".fa")


@query("SELECT 'h' || (o_custkey % 8) AS file, string_agg('>q' || o_custkey || ' (ALN: ' || (o_orderkey % 9 + 1) || '-' || (o_orderkey % 9 + 4) || ') of it  Expect=' || (o_orderkey % 5) || chr(10) || s || chr(10) || '>s' || o_orderkey || ' (ALN: 3-9) ' || o_orderpriority || '  Expect=' || (o_orderkey % 5) || chr(10) || s || chr(10) || '//', chr(10) ORDER BY o_orderkey) || chr(10) AS value FROM (SELECT *, upper(regexp_replace(o_orderpriority || o_orderstatus, '[^A-Za-z]', '-', 'g')) AS s FROM orders) GROUP BY o_custkey % 8")
def k08_pairwise_files(spark, sf):
    k = F.col("o_orderkey")
    aln = F.upper(F.regexp_replace(F.concat("o_orderpriority", "o_orderstatus"), "[^A-Za-z]", "-"))
    hits = table(spark, sf, "orders").select(
        k.alias("ord"), F.concat(F.lit("q"), "o_custkey").alias("query"), F.concat(F.lit("s"), "o_orderkey").alias("sbjct"), (k % 9 + 1).alias("qstart"), (k % 9 + 4).alias("qend"), F.lit(3).alias("sstart"), F.lit(9).alias("send"),
        aln.alias("qaln"), aln.alias("saln"), F.lit("of it").alias("qdescr"), F.col("o_orderpriority").alias("sdescr"), (k % 5).alias("evalue"), F.concat(F.lit("h"), F.col("o_custkey") % 8).alias("target"),
    )
    return _read(spark, sinks.pairwise_lines(hits, beside=("target",)), "pairwise", order=("ord",))


@query("SELECT 'p' || substr(lpad(s_suppkey::VARCHAR, 3, '0'), 3) AS file, count(*) AS n, min(s_suppkey) AS first_key FROM supplier GROUP BY ALL")
def k07_split_files(spark, sf):
    """A target as several ordered parts, whose numbers follow on from one another."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("p"), F.substring(F.lpad(F.col("s_suppkey").cast("string"), 3, "0"), 3, 99)).alias("target"), F.col("s_suppkey").alias("ord"), F.col("s_suppkey").cast("string").alias("line"))
    out = _read(spark, s, "split", order=("ord",), split=True)
    stem = F.regexp_replace("file", r"-\d{5}$", "")
    lines = out.select(stem.alias("file"), F.col("file").alias("f"), F.posexplode(F.split(F.regexp_replace("value", "\n$", ""), "\n")).alias("at", "line"))
    w = Window.partitionBy("file").orderBy("f", "at")  # a handful of rows a file
    steps = lines.withColumn("ok", F.coalesce(F.lag(F.col("line").cast("long")).over(w) < F.col("line").cast("long"), F.lit(True)))
    return steps.groupBy("file").agg(F.count(F.when(F.col("ok"), 1)).alias("n"), F.min(F.col("line").cast("long")).alias("first_key"))


# --- large files, read in ranges -------------------------------------------------------------------------------------------------------


def _lines(spark, lines, name, **given):
    out = f"{_folder(spark, name)}/files"
    outfiles.write_files(lines, out, split=True, numbered=True, **given)  # a target is as many tasks as its size asks for
    return split_files.line_table(spark, out, parts=True)


@query(
    """SELECT o_orderpriority[1:1] || '.hhr' AS file, (row_number() OVER w - 1)::INT AS ord, coalesce(max(CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey // 1000 + 2 END) OVER (PARTITION BY o_orderpriority[1:1] ORDER BY o_orderkey ROWS UNBOUNDED PRECEDING), 1)::INT AS round,
'd' || o_custkey || ' first' AS descr, ('1e-' || (o_orderkey % 9 + 1))::DOUBLE AS evalue, 'AC-DEFG' AS qaln, 'ACGDE-G' AS saln, (o_orderkey % 50 + 1)::INT AS qstart, (o_orderkey % 50 + 6)::INT AS qend, (o_custkey % 40 + 1)::INT AS sstart, (o_custkey % 40 + 6)::INT AS send FROM orders WINDOW w AS (PARTITION BY o_orderpriority[1:1] ORDER BY o_orderkey)"""
)
def s13_large_reports(spark, sf):
    """One report for each priority: rounds are named before some hits and hold until the next, each hit is two rows of alignment."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    at, b = (k % 50 + 1).cast("int"), (c % 40 + 1).cast("int")
    named = F.when(k % 11 == 0, F.format_string("Results from round %d\n", F.floor(k / 1000) + 2)).otherwise("")
    hit = F.format_string(">d%d first\nProbab=99.0  E-value=1e-%d  Score=50.1\n\nQ q  %d AC-D %d (90)\nT d  %d ACGD %d (50)\n\nQ q  %d EFG %d (90)\nT d  %d E-G %d (50)", c, k % 9 + 1, at, at + 2, b, b + 3, at + 4, at + 5, b + 4, b + 5)
    lines = table(spark, sf, "orders").select(F.substring("o_orderpriority", 1, 1).alias("target"), k.alias("ord"), F.concat(named, hit).alias("line"))
    hits = split_files.report_hits(_lines(spark, lines, "reports", order=("ord",), suffix=".hhr"), "profile")
    return hits.select("file", "ord", "round", "descr", "evalue", "qaln", "saln", "qstart", "qend", "sstart", "send")


@query("SELECT lang || '.fa' AS file, row_number() OVER (PARTITION BY lang ORDER BY doc_id)::INT AS ord, 'd' || doc_id AS name, 'd' || doc_id || ' text' AS descr, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS aln FROM documents WHERE text IS NOT NULL")
def s17_large_fasta(spark, sf):
    """One file for each language, of whole texts in lines of 60 letters."""
    from .functions.text import wrap

    d = table(spark, sf, "documents").filter("text IS NOT NULL")
    seq = wrap(F.regexp_replace("text", "[^A-Za-z]", "."), 60)
    lines = d.select(F.col("lang").alias("target"), F.col("doc_id").alias("ord"), F.concat(F.lit(">d"), "doc_id", F.lit(" text\n"), seq).alias("line"))
    return split_files.fasta(_lines(spark, lines, "fasta", order=("ord",), suffix=".fa"))


@query("SELECT 'h' || (o_custkey % 3) || '.txt' AS file, (row_number() OVER (PARTITION BY o_custkey % 3 ORDER BY o_orderkey) - 1)::INT AS ord, 'q' || o_custkey AS query, 's' || o_orderkey AS sbjct, (o_orderkey % 5)::DOUBLE AS evalue, s AS qaln, s AS saln, (o_orderkey % 9 + 1)::INT AS qstart, (o_orderkey % 9 + 4)::INT AS qend, 3 AS sstart, 9 AS send FROM (SELECT *, upper(regexp_replace(o_orderpriority || o_orderstatus, '[^A-Za-z]', '-', 'g')) AS s FROM orders)")
def s16_large_pairwise(spark, sf):
    k = F.col("o_orderkey")
    aln = F.upper(F.regexp_replace(F.concat("o_orderpriority", "o_orderstatus"), "[^A-Za-z]", "-"))
    hits = table(spark, sf, "orders").select(
        k.alias("ord"), F.concat(F.lit("q"), "o_custkey").alias("query"), F.concat(F.lit("s"), "o_orderkey").alias("sbjct"), (k % 9 + 1).alias("qstart"), (k % 9 + 4).alias("qend"), F.lit(3).alias("sstart"), F.lit(9).alias("send"),
        aln.alias("qaln"), aln.alias("saln"), F.lit("of it").alias("qdescr"), F.col("o_orderpriority").alias("sdescr"), (k % 5).alias("evalue"), F.concat(F.lit("h"), F.col("o_custkey") % 3).alias("target"),
    )
    lines = sinks.pairwise_lines(hits, beside=("target",))
    return split_files.pairwise(_lines(spark, lines, "pairwise", order=("ord",))).drop("slen")
