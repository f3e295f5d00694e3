"""Queries for sources and sinks: lines are made from the driver's tables and read back by the parsers."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import carriers as C
from .operators import align, cluster, ensemble, msa, prefix, quality
from .queries import query
from .session import scratch_folder as _folder
from .session import table
from .sources import sinks, tables


def _lines(df, line, file="f", order="ord"):
    return df.select(F.lit(file).alias("file") if isinstance(file, str) else file.alias("file"), F.col(order).cast("long").alias("ord"), line.alias("line"))


@query("SELECT l_orderkey::INT AS r1, l_linenumber AS r2, l_quantity AS dst, l_discount AS prob, [l_tax] AS p FROM lineitem")
def s07_s08_predictions(spark, sf):
    li = table(spark, sf, "lineitem").withColumn("ord", F.col("l_orderkey"))
    rows = _lines(li, F.concat_ws("  ", F.lit(""), "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax"))
    return tables.predictions(rows, ()).select("r1", "r2", "dst", "prob", "p")


@query("SELECT 'f' || (n_regionkey) AS file, n_name AS name, n_nationkey / 32.0::DOUBLE AS global, [NULL, n_nationkey + 0.5::DOUBLE, 4.25] AS local FROM nation")
def s09_quality(spark, sf):
    n = table(spark, sf, "nation").withColumn("ord", F.col("n_nationkey"))
    rows = _lines(n, F.concat_ws(" ", "n_name", F.col("n_nationkey") / 32, F.lit("X"), F.col("n_nationkey") + 0.5, F.lit("4.25")), F.concat(F.lit("f"), "n_regionkey"))
    head = rows.select("file").distinct().select("file", F.lit(-1).cast("long").alias("ord"), F.lit("PFRMAT QA").alias("line"))
    got = tables.quality(rows.unionByName(head)).filter("part = 1")
    return got.select("file", "name", "global", "local")


@query("SELECT o_orderkey::INT AS resnum, [o_totalprice, NULL, 2.5] AS terms FROM orders")
def s11_energy(spark, sf):
    o = table(spark, sf, "orders").withColumn("ord", F.col("o_orderkey") + 1)
    letter = F.when(F.col("o_orderkey") % 2 == 0, "B").otherwise("")
    return tables.energy(_lines(o, F.concat_ws(" ", F.lit("ALA"), F.concat("o_orderkey", letter), F.lit("A"), "o_totalprice", F.lit("none"), F.lit("2.5"), F.lit("u"), F.lit("v"))), None).select("resnum", "terms")


@query("SELECT m1::VARCHAR AS m1, m2::VARCHAR AS m2, score FROM similarity", "similarity")
def s12_similarity(spark, sf):
    s = C.similarity(spark, sf)
    rows = s.select(F.concat(F.lit("f"), "m1").alias("file"), F.concat_ws(" ", "m1", "m2", "score", *[F.lit(str(k)) for k in range(8)]).alias("line"))
    return cluster.cluster_table(rows.unionByName(rows.select("file", F.lit("# a comment").alias("line")).distinct()))


@query("SELECT 'r' || n_nationkey AS config, 0.5::DOUBLE AS mean, 0.25::DOUBLE AS sd, 't' || n_regionkey AS target, n_nationkey / 4.0::DOUBLE AS t_mean, 1.5::DOUBLE AS t_sd FROM nation UNION ALL SELECT 'r' || n_nationkey, 0.5, 0.25, 'u', 2, 3 FROM nation")
def s24_eval_summary(spark, sf):
    n = table(spark, sf, "nation").withColumn("ord", F.col("n_nationkey"))
    line = F.concat(F.lit("r"), "n_nationkey", F.lit(" 0.5 0.25 | t"), "n_regionkey", F.lit(" "), F.col("n_nationkey") / 4, F.lit(" 1.5 u 2 3"))
    return tables.eval_summary(_lines(n, line))


@query("SELECT target, name, gt_rank::INT AS gt_rank FROM truth", "truth")
def s25_ground_truth(spark, sf):
    t = C.truth(spark, sf)
    rows = t.select(F.col("target").alias("file"), F.col("gt_rank").cast("long").alias("ord"), F.format_string(" %d  %s-D1 0.5", "gt_rank", "name").alias("line"))
    return tables.ground_truth(rows)


@query("SELECT vec_id::INT AS i, (vec_id + label)::INT AS j, embedding AS xcov FROM embeddings")
def s05_xcov(spark, sf):
    e = table(spark, sf, "embeddings").withColumn("ord", F.col("vec_id"))
    line = F.concat_ws(" ", "vec_id", F.col("vec_id") + F.col("label"), F.array_join(F.transform("embedding", lambda x: x.cast("string")), " "))
    return tables.xcov(_lines(e, line), 64).select("i", "j", "xcov")


@query("SELECT vec_id, list_transform(range(1, 9), lambda k: CASE WHEN k IN (2, 4) THEN NULL ELSE (vec_id * k) / 1000.0::DOUBLE END) AS v FROM embeddings")
def s04_scaled_values(spark, sf):
    line = F.array_join(F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: (F.col("vec_id") * k).cast("string")), " ")
    e = table(spark, sf, "embeddings")
    kept = tables.scaled_values(line, 1000.0, (1, 3))
    return e.select("vec_id", F.transform(F.sequence(F.lit(1), F.lit(8)), lambda k: F.when(k.isin(2, 4), None).otherwise(F.element_at(kept, F.when(k == 1, 1).when(k == 3, 2).otherwise(k - 2)))).alias("v"))


@query("SELECT DISTINCT n_name AS id FROM nation WHERE n_name NOT LIKE '% %' UNION SELECT DISTINCT unnest(string_split(n_name, ' ')) FROM nation WHERE n_name LIKE '% %'")
def s26_id_list(spark, sf):
    from .sources import files

    n = table(spark, sf, "nation")
    return files.id_list(n.select(F.col("n_name").alias("line")).unionByName(n.select(F.concat(F.lit("#"), "n_name").alias("line"))))


@query("SELECT seq::VARCHAR AS file, string_agg(state, '' ORDER BY pos) AS seq FROM states GROUP BY seq", "states")
def c24_profile_to_seq(spark, sf):
    return tables.profile_to_seq(C.states(spark, sf).select(F.col("seq").cast("string").alias("file"), "pos", F.col("state").alias("res")))


@query("SELECT name, '>' || name || chr(10) || regexp_replace(aln, '(.{20})', '\\1' || chr(10), 'g').rtrim(chr(10)) AS line FROM alignment", "alignment")
def k07_msa_fasta(spark, sf):
    return sinks.msa_lines(C.alignment(spark, sf), "fasta", 20)


@query("SELECT name, rpad(name::VARCHAR, 34, ' ') || ' ' || aln AS line FROM alignment", "alignment")
def k07_msa_stockholm(spark, sf):
    return sinks.msa_lines(C.alignment(spark, sf), "stockholm")


@query("SELECT o_orderkey AS ord, '>q (ALN: ' || (o_orderkey % 9 + 1) || '-20) of it  Expect=2e-05' || chr(10) || 'AC-D' || chr(10) || '>s' || o_custkey || ' (ALN: 3-9) other  Expect=2e-05' || chr(10) || 'ACDD' || chr(10) || '//' AS line FROM orders")
def k08_pairwise(spark, sf):
    o = table(spark, sf, "orders").select(
        F.col("o_orderkey").alias("ord"), F.lit("q").alias("query"), F.concat(F.lit("s"), "o_custkey").alias("sbjct"), (F.col("o_orderkey") % 9 + 1).alias("qstart"), F.lit(20).alias("qend"), F.lit(3).alias("sstart"), F.lit(9).alias("send"), F.lit("AC-D").alias("qaln"), F.lit("ACDD").alias("saln"),
        F.lit("of it").alias("qdescr"), F.lit("other").alias("sdescr"), F.lit("2e-05").alias("evalue"),
    )
    return sinks.pairwise_lines(o)


@query(
    """SELECT event_id AS ord, (event_id % 50) / 4.0::DOUBLE AS zscore, '>' || rpad('q' || user_id, 9, ' ') || ' a.1.1         ' || '   1 SEQUENCE' || chr(10) || 'AC' || chr(10) || '>' || rpad('q' || user_id, 9, ' ') || ' a.1.1         ' || '   2 9   ' || ' '
|| lpad(((event_id % 50) / 4.0::DOUBLE)::VARCHAR.regexp_replace('\\.0$', ''), 10, ' ') || chr(10) || event_type || chr(10) || '>s         b.2           ' || '   3 8   ' || chr(10) || 'GC' || chr(10) || '>s         b.2           ' || '   4 SEQUENCE' || chr(10) || 'TT' || chr(10) || '//' AS line FROM events"""
)
def k19_superposition_blocks(spark, sf):
    lit = {"qscop": "a.1.1", "sscop": "b.2", "sbjct": "s", "qseq": "AC", "sstr": "GC", "sseq": "TT", "qbeg": 1, "qstart": 2, "qend": 9, "sstart": 3, "send": 8, "sbeg": 4}
    e = table(spark, sf, "events").select(F.col("event_id").alias("ord"), (F.col("event_id") % 50 / 4).alias("zscore"), F.concat(F.lit("q"), "user_id").alias("query"), F.col("event_type").alias("qstr"), *[F.lit(v).alias(k) for k, v in lit.items()])
    return sinks.superposition_blocks(e)


@query("SELECT cls, CASE WHEN cls = 0 THEN 'Background' ELSE (cls + 1)::VARCHAR END AS name, c AS r, c AS g, c AS b, n FROM (SELECT label::INT AS cls, CASE WHEN label = 0 THEN 255 ELSE (label - 1) * 3 % 255 END::INT AS c, count(*) AS n FROM embeddings GROUP BY label)")
def k13_class_dictionary(spark, sf):
    """The classes that masks have, with their colours and cells."""
    cells = table(spark, sf, "embeddings").groupBy(F.col("label").cast("int").alias("cls")).agg(F.count("*").alias("n"))
    return sinks.class_dictionary(spark).join(cells, "cls")


HITS = """WITH h AS (SELECT l_orderkey AS query, l_linenumber AS ord, 'AC-DE' AS qaln, CASE l_linenumber % 3 WHEN 0 THEN 'ACXDE' WHEN 1 THEN 'A-XDE' ELSE 'GCYD-' END AS saln FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem))"""


def _hits(spark, sf):
    k = F.col("l_linenumber") % 3
    saln = F.when(k == 0, "ACXDE").when(k == 1, "A-XDE").otherwise("GCYD-")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber").distinct().select(F.col("l_orderkey").alias("query"), F.col("l_linenumber").alias("ord"), F.lit("AC-DE").alias("qaln"), saln.alias("saln"), F.lit(1).alias("qstart"))


@query(f"{HITS} SELECT query, ord, saln AS aln FROM h")
def r03_master_slave(spark, sf):
    return msa.master_slave(_hits(spark, sf))


@query(f"{HITS}, q AS (SELECT query, bool_or(ord = 4) AND NOT bool_and(ord = 4) AS clash, bool_and(ord = 4) AS alone FROM h GROUP BY query) SELECT query, unnest([1, 2, 3, 4]) AS qpos, unnest(['A', CASE WHEN alone THEN 'W' ELSE 'C' END, 'D', 'E']) AS res, unnest([false, clash, false, false]) AS conflict FROM q")
def r04_check_query(spark, sf):
    """The fourth hit of a query has another second residue."""
    hits = _hits(spark, sf).withColumn("qaln", F.when(F.col("ord") == 4, "AW-DE").otherwise(F.col("qaln")))
    return msa.check_query_of_hits(hits)


@query(f"{HITS}, q AS (SELECT DISTINCT query, query % 2 = 0 AS whole FROM h) SELECT h.query, h.ord::BIGINT AS ord, saln || CASE WHEN whole THEN '-' ELSE '' END AS aln, whole FROM h JOIN q USING (query) UNION ALL SELECT query, 0, CASE WHEN whole THEN 'AC-DEF' ELSE 'AC-DE' END, whole FROM q")
def r05_insert_query(spark, sf):
    hits = _hits(spark, sf)
    seq = F.when(F.col("query") % 2 == 0, "ACDEF").otherwise("ACDF")
    return msa.insert_query(hits, hits.select("query").distinct().withColumn("seq", seq))


PROFILE = "WITH prof AS (SELECT DISTINCT l_suppkey AS name, (l_partkey % 20 + 1)::INT AS pos, CASE WHEN l_partkey % 20 = 3 THEN 'X' ELSE 'A' END AS res FROM lineitem), st AS (SELECT name, pos AS idx, pos + 100 AS resnum FROM prof WHERE pos % 3 > 0)"


@query(f"{PROFILE} SELECT p.name, p.pos, p.res, s.resnum FROM prof p JOIN st s ON s.name = p.name AND s.idx = p.pos WHERE p.res NOT IN ('-', 'X')")
def r19_mask_aligned_a(spark, sf):
    return align.mask_aligned(*_aligned(spark, sf), "A")


@query(f"{PROFILE} SELECT p.name, p.pos, p.res, s.resnum FROM prof p LEFT JOIN st s ON s.name = p.name AND s.idx = p.pos")
def r19_mask_aligned_b(spark, sf):
    return align.mask_aligned(*_aligned(spark, sf), "B")


def _aligned(spark, sf):
    pos = (F.col("l_partkey") % 20 + 1).cast("int")
    prof = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("name"), pos.alias("pos"), F.when(F.col("l_partkey") % 20 == 3, "X").otherwise("A").alias("res")).distinct()
    chain = prof.filter("pos % 3 > 0").select("name", F.col("pos").alias("idx"), (F.col("pos") + 100).alias("resnum"))
    return prof, chain, prof.select("name", "pos", F.col("pos").alias("idx"))


@query()
def r19_from_alignment(spark, sf):
    """Positions mapped by global alignment (J04): the structure lacks every seventh letter of the sequence."""
    t = F.upper(F.regexp_replace("p_type", "[^A-Za-z]", ""))
    kept = F.array_join(F.filter(F.split(t, ""), lambda x, i: i % 7 != 3), "")
    both = table(spark, sf, "part").select(F.col("p_partkey").alias("name"), t.alias("a"), kept.alias("b"))
    letters = lambda c: F.posexplode(F.split(c, ""))
    prof = both.select("name", letters("a").alias("pos", "res")).withColumn("pos", F.col("pos") + 1)
    chain = both.select("name", letters("b").alias("idx", "x")).select("name", (F.col("idx") + 1).alias("idx"), (F.col("idx") + 101).alias("resnum"))
    return align.mask_aligned(prof, chain, align.map_positions(both, "name"), "A")


# --- formatted numbers: Java and C round decimal ties apart, so these have no SQL ------------------------------------------------------


@query()
def k01_prediction_lines(spark, sf):
    return sinks.prediction_lines(C.predictions(spark, sf))


@query()
def k01_prediction_lines_every_class(spark, sf):
    from .functions import probs as pr

    p = C.logits(spark, sf).select(F.col("i").alias("r1"), F.col("j").alias("r2"), pr.softmax(F.col("logits")).alias("p"))
    return sinks.prediction_lines(p.select("r1", "r2", pr.expected_distance(F.col("p")).alias("dst"), F.array_max("p").alias("prob"), "p"), every=True)


@query()
def k02_combined_lines(spark, sf):
    return sinks.combined_lines(ensemble.pivot_predictors(C.predictions(spark, sf), 3), 3)


@query()
def k03_distance_file(spark, sf):
    return sinks.distance_file(ensemble.ensemble_mean(C.predictions(spark, sf), 3), "T0001")


@query()
def k03_distance_file_of_chains(spark, sf):
    """Pairs are dropped by their separation within a chain, so they are located first."""
    from .operators import pairs

    mean = ensemble.ensemble_mean(C.predictions(spark, sf), 3, 0)
    return sinks.distance_file(pairs.chain_sep(pairs.locate_chain(mean, C.chain_ends(spark, sf))), "T0001")


@query()
def k07_msa_files(spark, sf):
    aln = prefix.numbered(prefix.stretches(C.alignment(spark, sf), ["grp"], "name"), "ord").withColumn("ord", F.col("ord") - 1)
    rows = aln.select("grp", "ord", F.concat(F.lit("d"), F.col("name")).alias("name"), F.lit("text").alias("descr"), F.lit(1).alias("start"), F.lit(60).alias("end"), (F.col("name") / 1e6).alias("evalue"), "aln")
    return sinks.msa_files(rows)


CONSTRAINTS = """, w AS (SELECT r1, r2, sum(dst * prob) / sum(prob) AS d, sum(prob) / 3 AS q FROM predictions GROUP BY r1, r2 HAVING count(*) = 3 AND sum(prob) <> 0),
v AS (SELECT r1, r2, floor(d * 100 + 0.5 + 1e-6) / 100 + 0.003 AS d, floor(q * 1000 + 0.5 + 1e-6) / 1000 + 0.00007 AS q FROM w),
a AS (SELECT *, 'AtomPair ' || CASE WHEN r1 % 5 = 0 THEN 'CA' ELSE 'CB' END || ' ' || r1 || ' ' || CASE WHEN r2 % 5 = 0 THEN 'CA' ELSE 'CB' END || ' ' || r2 || ' ' AS head, printf('SCALARWEIGHTEDFUNC %.3f SUMFUNC 2 ', q * 5) AS weight FROM v)
SELECT r1, r2, head || f.line AS line, f.kind AS kind FROM a, LATERAL (SELECT unnest(['HARMONIC', 'FLAT_HARMONIC', 'BOUNDED', 'SIGMOID', 'SIGMOID2']) AS kind, unnest([printf('HARMONIC %.1f 0.5', d), printf('FLAT_HARMONIC %.1f 1 4', d), printf('BOUNDED 0 %.1f %g %.1f TAG', d, 1.001 - q, 100 / (q + 0.001)),
  weight || printf('SIGMOID %.1f 2.0 CONSTANTFUNC -0.5', d + 2), weight || printf('SIGMOID %.1f 2.0 SCALARWEIGHTEDFUNC -1.0 SIGMOID %.1f 2.0', d + 2, d - 2)]) AS line) f"""


@query(CONSTRAINTS, "predictions")
def k04_r09_constraint_lines(spark, sf):
    """Distances and probabilities that lie off the ties of what is printed, so that SQL rounds them alike."""
    letter = lambda r: F.when(F.col(r) % 5 == 0, "G").otherwise("A")
    off = lambda c, by, more: F.floor(F.col(c) * by + 0.5 + 1e-6) / by + more
    pred = ensemble.weighted_distance(C.predictions(spark, sf), 3).withColumns({"res1": letter("r1"), "res2": letter("r2"), "dst": off("dst", 100, 0.003), "prob": off("prob", 1000, 0.00007)})
    kinds = ("HARMONIC", "FLAT_HARMONIC", "BOUNDED", "SIGMOID", "SIGMOID2")
    out = None
    for kind in kinds:
        one = sinks.constraint_lines(pred, kind).withColumn("kind", F.lit(kind))
        out = one if out is None else out.unionByName(one)
    return out


@query()
def k05_quality_lines(spark, sf):
    qa = ensemble.ensemble_quality(C.quality(spark, sf))
    return sinks.quality_lines(qa.filter("local IS NOT NULL"), quality.global_score(qa, ["name"]), 50, first=0)


@query()
def k10_checkpoint_bytes(spark, sf):
    rows = table(spark, sf, "embeddings").select(F.col("vec_id").alias("name"), F.lit("ACDE").alias("seq"), F.transform("embedding", lambda x: x.cast("double")).alias("freqs"))
    return sinks.checkpoint_bytes(rows)


@query(
    """SELECT label AS name, 1 AS part, vec_id::INT AS pos, CASE WHEN length(vec_id::VARCHAR) > 5 THEN vec_id::VARCHAR ELSE lpad(vec_id::VARCHAR, 5, ' ') END || ' A  ' || array_to_string(list_transform(v, lambda x: ' ' || lpad(x::VARCHAR, 3, ' ')), '') || ' ' || array_to_string(list_transform(v, lambda x: ' ' || lpad(abs(x)::VARCHAR, 3, ' ')), '') || '  0.00     0.00' AS line
FROM (SELECT label, vec_id, list_transform(embedding[1:20], lambda x: trunc(x::DOUBLE * 10)::INT) AS v FROM embeddings)
UNION ALL SELECT name, unnest([0, 2]), 0, unnest(['Position-specific scoring matrix computed, weighted observed percentages rounded down, information per position, and relative weight of gapless real matches to pseudocounts' || chr(10) || repeat(' ', 12) || l || '   ' || l, chr(10) || repeat(' ', 22) || 'K         Lambda'])
FROM (SELECT DISTINCT label AS name, 'A   R   N   D   C   Q   E   G   H   I   L   K   M   F   P   S   T   W   Y   V' AS l FROM embeddings)"""
)
def k11_pssm_lines(spark, sf):
    e = table(spark, sf, "embeddings")
    ints = F.transform(F.slice("embedding", 1, 20), lambda x: (x.cast("double") * 10).cast("int"))
    return sinks.pssm_lines(e.select(F.col("label").alias("name"), F.col("vec_id").cast("int").alias("pos"), F.lit("A").alias("res"), ints.alias("scores"), F.transform(ints, lambda x: F.abs(x)).alias("percents")))


@query("SELECT seq AS name, pos::INT AS pos, CASE WHEN length(pos::VARCHAR) > 4 THEN pos::VARCHAR ELSE lpad(pos::VARCHAR, 4, ' ') END || ' A ' || state || '  ' || printf('%6.3f %6.3f %6.3f', pos % 100 / 1000.0::DOUBLE, seq % 100 / 1000.0::DOUBLE, 0.5::DOUBLE) AS line FROM states UNION ALL SELECT DISTINCT seq, 0, '# PSIPRED VFORMAT (PSIPRED V2.6)' FROM states", "states")
def k12_ss_lines(spark, sf):
    p = F.array((F.col("pos") % 100 * 10).cast("int"), (F.col("seq") % 100 * 10).cast("int"), F.lit(5000))
    st = C.states(spark, sf).select(F.col("seq").alias("name"), F.col("pos").cast("int").alias("pos"), F.lit("A").alias("res"), "state", p.alias("p"))
    return sinks.ss_lines(st)


@query("SELECT chain::VARCHAR AS chain, idx AS serial, 'ATOM  ' || lpad(idx::VARCHAR, 5, ' ') || '  CA  GLY ' || chain || lpad(resnum::VARCHAR, 4, ' ') || '    ' || printf('%8.3f%8.3f%8.3f%6.2f%6.2f', x, y, z, 1.0::DOUBLE, resnum % 7 / 2.0::DOUBLE) AS line FROM points", "points")
def k17_atom_lines(spark, sf):
    p = C.points(spark, sf).select(F.col("chain").cast("string").alias("chain"), "resnum", F.col("idx").alias("serial"), F.lit("CA").alias("atom"), F.lit("GLY").alias("resname"), "x", "y", "z")
    return sinks.atom_lines(p, p.select("chain", "resnum", (F.col("resnum") % 7 / 2).alias("error")))


@query()
def r08_transitive_align(spark, sf):
    """Two parts' names as sequences, carried along their structures: the same letters without some, gapped to one length."""
    p = table(spark, sf, "part").select("p_partkey", F.upper(F.regexp_replace("p_type", "[^A-Za-z]", "")).alias("qseq"), F.upper(F.regexp_replace(F.concat("p_type", "p_brand"), "[^A-Za-z]", "")).alias("sseq"))
    n = F.greatest(F.length("qseq"), F.length("sseq"))
    lacks = lambda seq, every: F.array_join(F.transform(F.split(F.rpad(seq, n, "-"), ""), lambda x, i: F.when((i + F.col("p_partkey")) % every == 2, "-").otherwise(x)), "")
    return align.transitive_align(p.select("*", lacks(F.col("qseq"), 6).alias("qstr"), lacks(F.col("sseq"), 7).alias("sstr")))


# --- sources: texts in the formats that they read, made from the tables; file sources read what was written to the shared folder ----------


def _written(spark, sf, name="nation"):
    """One text file for each region, named by its key, in a folder part=key."""
    out = _folder(spark, name)
    n = table(spark, sf, "nation")
    n.select(F.col("n_regionkey").alias("part"), F.concat_ws(" ", "n_nationkey", "n_name").alias("line")).repartition(5, "part").write.partitionBy("part").text(out)
    return out


@query("SELECT n_regionkey::VARCHAR AS part, sum(length(n_nationkey || ' ' || n_name) + 1)::BIGINT AS length, true AS text FROM nation GROUP BY n_regionkey")
def s01_listing(spark, sf):
    from .sources import files

    found = files.listing(spark, _written(spark, sf), ".txt", True)
    part = F.regexp_extract("path", r"part=(\d+)/", 1)
    return found.groupBy(part.alias("part")).agg(F.sum("length").alias("length"), F.bool_and(~F.col("name").endswith(".txt")).alias("text"))


@query("SELECT n_regionkey::VARCHAR AS part, row_number() OVER (ORDER BY sum(length(n_nationkey || ' ' || n_name) + 1) DESC, n_regionkey) AS place FROM nation GROUP BY n_regionkey")
def s02_by_size(spark, sf):
    from pyspark.sql import Window

    from .sources import files

    found = files.listing(spark, _written(spark, sf), ".txt").select(F.regexp_extract("path", r"part=(\d+)/", 1).alias("name"), "length")
    sizes = found.groupBy("name").agg(F.sum("length").alias("length"))
    return files.by_size(sizes).withColumn("place", F.row_number().over(Window.orderBy(F.desc("length"), "name"))).select(F.col("name").alias("part"), "place")  # one row a file


@query("SELECT n_regionkey::VARCHAR AS part, n_nationkey || ' ' || n_name AS line FROM nation")
def s01_lines(spark, sf):
    from .sources import files

    rows = files.lines(spark, _written(spark, sf) + "/*").filter("line <> ''")
    return rows.select(F.col("line")).join(table(spark, sf, "nation").select(F.concat_ws(" ", "n_nationkey", "n_name").alias("line"), F.col("n_regionkey").cast("string").alias("part")), "line").select("part", "line")


PROFILE_SQL = """SELECT 'p' || s_nationkey AS file, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey)::INT AS pos, CASE s_suppkey % 3 WHEN 0 THEN 'A' WHEN 1 THEN 'C' ELSE 'W' END AS res,
list_transform([row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey), CASE s_suppkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 4 ELSE 17 END] || list_transform(range(20), lambda j: (s_suppkey + j) / 1000) || [0, 1, 2, 3, 4, 6, 8] || [1.5, 2, 0.5] || [0.9, s_suppkey / 1000, 5]
|| list_transform([0, 1] || range(3, 22), lambda j: j / 100) || [0.6, 0.3, 0.1], lambda v: round(v::DOUBLE, 4)) AS attrs FROM supplier"""


@query(PROFILE_SQL)
def s03_profile(spark, sf):
    from pyspark.sql import Window

    s = table(spark, sf, "supplier").withColumn("pos", F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey")))
    k = F.col("s_suppkey")
    numbers = lambda n, f: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(n - 1)), f), " ")
    letter = F.element_at(F.array(F.lit("A"), F.lit("C"), F.lit("W")), (k % 3 + 1).cast("int"))
    records = [
        F.concat_ws(" ", "pos", letter, numbers(20, lambda j: ((k + j) * 10).cast("string"))), F.concat(F.lit("   "), numbers(9, lambda j: (j * 10000).cast("string"))), F.lit("   1500 2000 500"), F.lit("   9000 3"),
        F.concat(F.lit("   "), (k * 10).cast("string"), F.lit(" 3 1")), F.lit("   5 4 2"), F.concat(F.lit("   CV: "), numbers(22, lambda j: (j * 100).cast("string"))), F.lit("   SS:C 6000 3000 1000"),
    ]
    file = F.concat(F.lit("p"), "s_nationkey")
    body = s.select(file.alias("file"), "pos", F.posexplode(F.array(*records)).alias("k", "line")).select("file", (F.col("pos") * 10 + F.col("k")).cast("long").alias("ord"), "line")
    head = s.select(file.alias("file")).distinct().select("file", F.posexplode(F.array(F.lit("COMER profile"), F.lit("LEN: 9"), F.lit("SCALE: 10000"))).alias("ord", "line")).withColumn("ord", F.col("ord").cast("long"))
    return tables.profile(head.unionByName(body)).withColumn("attrs", F.transform("attrs", lambda x: F.round(x.cast("double"), 4)))


@query("SELECT (vec_id % 100000)::INT AS serial, 'CA' AS atom, 'GLY' AS resname, (vec_id % 500)::INT AS resnum, CASE WHEN vec_id % 7 = 0 THEN 'B' ELSE '' END AS icode, round(embedding[1]::DOUBLE * 100, 1) + 0.0::DOUBLE AS x, vec_id % 5 = 0 AS het FROM embeddings")
def s06_atoms(spark, sf):
    e = table(spark, sf, "embeddings")  # the format has five places for a serial number
    x = F.round(F.col("embedding")[0].cast("double") * 100, 1)
    line = F.concat(
        F.when(F.col("vec_id") % 5 == 0, "HETATM").otherwise("ATOM  "), F.format_string("%5d", (F.col("vec_id") % 100000).cast("int")), F.lit("  CA  GLY A"), F.format_string("%4d", (F.col("vec_id") % 500).cast("int")),
        F.when(F.col("vec_id") % 7 == 0, "B").otherwise(" "), F.lit("   "), F.format_string("%8.3f%8.3f%8.3f", x, F.lit(1.0), F.lit(2.0)),
    )
    return tables.atoms(_lines(e.withColumn("ord", F.col("vec_id")), line)).select("serial", "atom", "resname", "resnum", "icode", "x", "het")


@query("SELECT o_orderkey::INT AS resnum, list_transform(range(29), lambda j: CASE WHEN j < 2 THEN CASE WHEN j = 1 THEN o_orderkey ELSE NULL END ELSE j + o_custkey END::DOUBLE) AS terms FROM orders")
def s10_energy_fixed(spark, sf):
    o = table(spark, sf, "orders").withColumn("ord", F.col("o_orderkey") + 1)
    rest = F.array_join(F.transform(F.sequence(F.lit(2), F.lit(28)), lambda j: (j + F.col("o_custkey")).cast("string")), " ")
    return tables.energy(_lines(o, F.concat_ws(" ", F.lit("ALA"), "o_orderkey", rest)), 29).select("resnum", "terms")


def _texts(df, file, value):
    return df.select(file.cast("string").alias("file"), value.alias("value"))


def _report(spark, sf, kind):
    from .sources import reports

    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf, "orders")
    at, b = (k % 50 + 1).cast("int"), (c % 40 + 1).cast("int")
    # nothing but %d and %s: the exponent carries the value
    text = {
        "profile": F.format_string("Query         q\nMatch_columns 9\nResults from round 2\nNo 1\n>d%d first\nProbab=99.0  E-value=1e-%d  Score=50.1\n\nQ q  %d AC-DE  %d (90)\nQ Consensus  1 ac-de 4 (90)\nT d  %d ACGDE %d (50)\nProbab=1  E-value=3  Score=1\nQ q 1 A 1 (90)\nT d 1 A 1 (50)\n", c, k % 9 + 1, at, at + 3, b, b + 4),
        "domain": F.format_string("Query:       q1  [L=90]\n@@ Round:  3\n>> d%d first LEN=50\n   1 !   50.0   0.1   1.0e-09   1e-%d       1       4 ..\n   2 ?   10.0   0.1   1.0e-03   9       5       6 ..\n\n  == domain 1  score: 50.0 bits\n  q1  %d AC.DE %d\n  s   %d ACGDE %d\n  == domain 2  score: 9 bits\n  q1  2 AA 3\n  s   9 AA 10\n", c, k % 9 + 1, at, at + 3, b, b + 4),
        "pair": F.format_string(">d%d first\n Length = 50\n Score = 9.1, Expect = 1e-%d, P = 1\nQuery: %d AC-DE %d\nSbjct: %d ACGDE %d\n", c, k % 9 + 1, at, at + 3, b, b + 4),
    }[kind]
    return reports.parsed_reports(_texts(o, k, text), kind).select("file", "round", "descr", "evalue", "qaln", "saln", "qstart", "qend", "sstart", "send", "slen")


def _report_sql(rnd, descr="' first'"):
    return f"SELECT o_orderkey::VARCHAR AS file, {rnd} AS round, 'd' || o_custkey || {descr} AS descr, ('1e-' || (o_orderkey % 9 + 1))::DOUBLE AS evalue, 'AC-DE' AS qaln, 'ACGDE' AS saln, (o_orderkey % 50 + 1)::INT AS qstart, (o_orderkey % 50 + 4)::INT AS qend, (o_custkey % 40 + 1)::INT AS sstart, (o_custkey % 40 + 5)::INT AS send, 50 AS slen FROM orders"


@query(_report_sql(2))
def s13_profile_report(spark, sf):
    return _report(spark, sf, "profile")


@query(_report_sql(3, "' first LEN=50'"))
def s14_domain_report(spark, sf):
    return _report(spark, sf, "domain")


@query(_report_sql(1))
def s15_pair_report(spark, sf):
    return _report(spark, sf, "pair")


@query("SELECT o_orderkey::VARCHAR AS file, unnest([0, 1]) AS ord, 'q' AS query, unnest(['s' || o_custkey, 't']) AS sbjct, unnest([1e-3, 0.5])::DOUBLE AS evalue, unnest(['AC-D', 'A']) AS qaln, unnest(['ACDD', 'C']) AS saln, unnest([o_orderkey % 9 + 1, 1])::INT AS qstart, 20 AS qend, 3 AS sstart, unnest([9, 3]) AS send FROM orders")
def s16_pairwise(spark, sf):
    from .sources import reports

    text = F.format_string(">q (ALN: %d-20) of it  Expect=e-3\nAC-\nD\n>s%d (ALN: 3-9) other  Expect=e-3\nAC.D\nD\n//\n>q (ALN: 1-20)   Expect=0.5\nA\n>t (ALN: 3-3)   Expect=0.5\nc\n//\n", F.col("o_orderkey") % 9 + 1, F.col("o_custkey"))
    text = F.regexp_replace(text, "AC\\.D\nD", "ac\ndd")
    return reports.pairwise_blocks(_texts(table(spark, sf, "orders"), F.col("o_orderkey"), text)).drop("slen")


FASTA_SQL = "SELECT grp AS file, row_number() OVER (PARTITION BY grp ORDER BY name)::INT AS ord, 'd' || name AS name, 'd' || name || ' text' AS descr, aln FROM alignment"


def _fasta(spark, sf, only=None):
    """Records of three lines, numbered by the name that they are sorted by; those named ``only``, if given."""
    from .sources import split_files

    lines = F.array(F.concat(F.lit(">d"), F.col("name"), F.lit(" text")), F.lower(F.substring("aln", 1, 30)), F.translate(F.substring("aln", 31, 30), "-", "."))
    rows = C.alignment(spark, sf).select(F.col("grp").alias("file"), "name", F.posexplode(lines).alias("k", "line"))
    return split_files.fasta(rows.select("file", (F.col("name") * 3 + F.col("k")).alias("ord"), "line"), name=only)


@query(FASTA_SQL, "alignment")
def s17_s19_fasta(spark, sf):
    return _fasta(spark, sf).select("file", "ord", "name", "descr", "aln")


@query(f", f AS ({FASTA_SQL}) SELECT file, name, aln FROM f WHERE name = 'd0'", "alignment")
def s18_reference_row(spark, sf):
    from .sources import reports

    return reports.reference_row(_fasta(spark, sf, "d0"), "d0").select("file", "name", "aln")


@query(f", f AS ({FASTA_SQL}) SELECT f.file, f.ord, f.name AS sbjct, r.aln AS qaln, f.aln AS saln, length(replace(r.aln, '-', '')) AS qend, length(replace(f.aln, '-', '')) AS send FROM f JOIN f r ON r.file = f.file AND r.name = 'd0' WHERE NOT starts_with(f.name, 'd0')", "alignment")
def s17_aligned_hits(spark, sf):
    from .sources import reports

    return reports.aligned_hits(_fasta(spark, sf), "d0").select("file", "ord", "sbjct", "qaln", "saln", "qend", "send")


@query("SELECT s_suppkey AS ord, 'profile' || chr(10) || 'DESC: d' || chr(10) || 'FILE: f' || s_suppkey || '.pro' || chr(10) AS line FROM supplier WHERE s_suppkey = 7")
def s20_profile_record(spark, sf):
    rows = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("ord"), F.concat(F.lit("profile\nDESC: d\nFILE: f"), "s_suppkey", F.lit(".pro\n")).alias("line"))
    return tables.profile_record(rows, "f7.p")


@query("SELECT vec_id, list_transform(embedding, lambda x: x::FLOAT) AS tensor, label AS mask FROM embeddings")
def s21_k15_tensors(spark, sf):
    """Tensors and masks are kept as Parquet, compressed, and read back."""
    out = _folder(spark, "tensors")
    table(spark, sf, "embeddings").select("vec_id", F.col("embedding").alias("tensor"), F.col("label").alias("mask")).write.option("compression", "zstd").parquet(out)
    return spark.read.parquet(out)


@query("SELECT CASE WHEN cls = 0 THEN 'Background' ELSE (cls + 1)::VARCHAR END AS name, c AS r, c AS g, c AS b FROM (SELECT DISTINCT label AS cls, CASE WHEN label = 0 THEN 255 ELSE (label - 1) * 3 % 255 END::INT AS c FROM embeddings)")
def s22_class_dictionary(spark, sf):
    """Written with the classes that masks have, and read back."""
    from .sources import files

    out = f"{_folder(spark, 'classes')}/table"
    found = table(spark, sf, "embeddings").select(F.col("label").cast("int").alias("cls")).distinct()
    sinks.class_dictionary(spark).join(found, "cls", "left_semi").orderBy("cls").select("name", "r", "g", "b").coalesce(1).write.csv(out, header=True)
    return files.class_dictionary(spark, out)


@query("SELECT p_partkey AS name, CASE p_partkey % 4 WHEN 0 THEN 'train' WHEN 1 THEN 'val' ELSE 'test' END AS split FROM part WHERE p_partkey % 4 < 3")
def s23_splits(spark, sf):
    from .sources import files

    folder = F.element_at(F.array(F.lit("train"), F.lit("val_labels"), F.lit("test"), F.lit("other")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return files.splits(table(spark, sf, "part").select(F.col("p_partkey").alias("name"), F.concat(F.lit("/data/"), folder, F.lit("/x.png")).alias("path"))).select("name", "split")


@query("SELECT o_orderkey::VARCHAR AS file, o_custkey / 4.0::DOUBLE AS zscore, 'CD-EF' AS qaln, 'CK-EF' AS saln, (o_orderkey % 3 + 1)::INT AS qstart, 3 AS sstart FROM orders")
def s28_structural_pages(spark, sf):
    from .sources import reports

    a = F.repeat(F.lit("M"), (F.col("o_orderkey") % 3).cast("int"))
    dots = F.repeat(F.lit("."), (F.col("o_orderkey") % 3).cast("int"))
    text = F.concat(F.lit("<html><PRE>\nQuery skip 1\n<h3> No 1: Query=1abcA Sbjct=2xyzB Z-score="), (F.col("o_custkey") / 4).cast("string"), F.lit("</h3>\nQuery "), a, F.lit("..CD-   2\nident  xx\nSbjct "), dots, F.lit("MKCK-   5\n\nQuery EF   9\nSbjct EF   7\n</PRE>\n<PRE> Sbjct=3 Z-score=2.5<\nQuery AA   2\nSbjct AA   3\n</PRE></html>"))
    return reports.structural_pages(_texts(table(spark, sf, "orders"), F.col("o_orderkey"), text))


@query("SELECT p_partkey AS name, 'a' || p_partkey AS path, CASE WHEN p_size > 20 THEN 'b' || p_partkey END AS partner FROM part")
def s29_pair_files(spark, sf):
    from .sources import files

    p = table(spark, sf, "part")
    side = lambda df, letter: df.select(F.col("p_partkey").alias("name"), F.concat(F.lit(letter), "p_partkey").alias("path"))
    return files.pair_files(side(p, "a"), side(p.filter("p_size > 20"), "b"))
