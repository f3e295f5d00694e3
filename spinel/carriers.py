"""Driver tables dressed as the engine's schemas, so that every operator has input at any scale.

Each function takes (spark, sf_dir) and returns one of the domain tables: points, logits, pair predictions, local quality, energy terms,
ground truth, alignments, hits, states, labels, similarities, chain ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .session import table


def points(spark: SparkSession, sf_dir: str, scale: float = 120.0) -> DataFrame:
    """(chain, idx, resnum, x, y, z): one point for each vector; every chain's numbering starts at chain + 1."""
    e = table(spark, sf_dir, "embeddings")
    at = [(F.col("embedding")[k].cast("double") * scale).alias(c) for k, c in enumerate("xyz")]
    w = Window.partitionBy("chain").orderBy("vec_id")
    rows = e.select(F.col("label").alias("chain"), "vec_id", *at).withColumn("idx", F.row_number().over(w))
    return rows.select("chain", "idx", (F.col("idx") + F.col("chain")).alias("resnum"), "x", "y", "z")


def logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(pair, i, j, logits): 64 class logits for a cell; i and j run over a 40 x 40 square so that both directions occur."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(
        F.col("vec_id").alias("pair"),
        (F.floor(F.col("vec_id") / 40) % 40 + 1).cast("int").alias("i"),
        (F.col("vec_id") % 40 + 1).cast("int").alias("j"),
        F.transform("embedding", lambda x: x.cast("double") * 20).alias("logits"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predictor, r1, r2, dst, prob, p): three predictors' pair predictions with ten distance bins each."""
    li = table(spark, sf_dir, "lineitem")
    rows = li.select(
        (F.col("l_suppkey") + 1).cast("int").alias("r1"), (F.col("l_suppkey") + 2 + F.col("l_partkey") % 40).cast("int").alias("r2"), (F.col("l_linenumber") % 3).alias("predictor"), F.col("l_quantity").alias("q"), (F.col("l_discount") * 10).alias("d")
    )
    one = rows.groupBy("predictor", "r1", "r2").agg(F.round(F.avg("q"), 6).alias("dst"), F.round(F.avg("d"), 6).alias("prob"), (F.min("q").cast("int") % 9).alias("bin"))
    p = F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k == F.col("bin"), F.col("prob")).when(k == 9, 1 - F.col("prob")).otherwise(F.lit(0.0)))
    return one.select("predictor", "r1", "r2", "dst", "prob", p.alias("p"))


def quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(predictor, name, k, local): local errors of residues, null where the residue is absent."""
    li = table(spark, sf_dir, "lineitem")
    by = li.groupBy((F.col("l_linenumber") % 3).alias("predictor"), F.concat(F.lit("m"), F.col("l_suppkey")).alias("name"), (F.col("l_partkey") % 50).cast("int").alias("k"))
    return by.agg(F.when(F.bool_and(F.col("l_returnflag") == "N"), F.lit(None)).otherwise(F.avg("l_quantity") / 6).alias("local"))


def _round6(x: Column) -> Column:
    """Rounded to six places; a zero keeps its sign, as in SQL's."""
    r = F.round(x, 6)
    return F.when(r == 0, x * 0.0).otherwise(r)


def energy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, k, terms): three energy terms of each residue."""
    li = table(spark, sf_dir, "lineitem")
    by = li.groupBy(F.concat(F.lit("m"), F.col("l_suppkey")).alias("name"), (F.col("l_partkey") % 50).cast("int").alias("k"))
    terms = [_round6(F.avg("l_quantity") * 1.5 / 25), _round6(F.avg("l_discount") * -15), _round6(F.avg("l_tax") * 15)]
    return by.agg(F.array(*terms).alias("terms"))


def energy_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(name, k, terms): six energy terms of each residue, the last of which some lack."""
    li = table(spark, sf_dir, "lineitem")
    by = li.groupBy(F.concat(F.lit("m"), F.col("l_suppkey")).alias("name"), (F.col("l_partkey") % 50).cast("int").alias("k"))
    q = F.col("l_quantity")
    terms = [_round6(F.avg(q) * 1.5 / 25), _round6(F.avg("l_discount") * -15), _round6(F.avg("l_tax") * 15), F.min(q) / 32, F.max(q) / -64, F.when(F.min(q) > 3, F.max(q) / 16)]
    return by.agg(F.array(*terms).alias("terms"))


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(target, name, gt_rank): the ground-truth ranking of models in each target."""
    s = table(spark, sf_dir, "supplier")
    target = F.concat(F.lit("t"), F.col("s_nationkey") % 5)
    w = Window.partitionBy("target").orderBy(F.desc("s_acctbal"), "name")
    rows = s.select(target.alias("target"), F.concat(F.lit("m"), F.col("s_suppkey")).alias("name"), "s_acctbal")
    return rows.select("target", "name", F.row_number().over(w).alias("gt_rank"))


def alignment(spark: SparkSession, sf_dir: str, width: int = 60) -> DataFrame:
    """(grp, name, aln): aligned rows of equal length, gaps for everything but letters; texts of one language are cut in blocks, and the
    blocks with one number are a group."""
    d = table(spark, sf_dir, "documents")
    # one file may be one scan task, and each text becomes many rows
    d = d.select("lang", "doc_id", "text").repartition("doc_id")
    # one pass over a text, whatever its length: a substring is looked for from the text's first byte
    t = F.upper(F.regexp_replace("text", "[^A-Za-z]", "-"))
    blocks = d.filter(F.length("text") > 0).select("lang", "doc_id", F.posexplode(F.regexp_extract_all(t, F.lit(f".{{1,{width}}}"), F.lit(0))).alias("b", "x"))
    return blocks.select(F.concat_ws(":", "lang", "b").alias("grp"), F.col("doc_id").alias("name"), F.rpad("x", width, "-").alias("aln"))


def columns(aln: DataFrame) -> DataFrame:
    """(grp, name, col, res): an alignment in long form."""
    return aln.select("grp", "name", F.posexplode(F.split("aln", "")).alias("col", "res")).withColumn("col", F.col("col") + 1)


def hits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, sbjct, round, evalue, qstart, qend): search hits over several rounds."""
    e = table(spark, sf_dir, "events")
    start = (F.col("event_id") % 50 + 1).cast("int")
    return e.select(
        F.col("event_id").alias("ord"), F.col("user_id").alias("sbjct"), F.dayofmonth("ts").alias("round"), F.round(F.col("value") * 1e-3, 9).alias("evalue"), start.alias("qstart"), (start + 20 + F.col("user_id") % 30).cast("int").alias("qend")
    )


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(seq, pos, state): states in order; 'view' plays the coil."""
    e = table(spark, sf_dir, "events")
    pos = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    return e.select(F.col("user_id").alias("seq"), pos.alias("pos"), F.when(F.col("event_type") == "view", "C").otherwise(F.upper(F.substring("event_type", 1, 1))).alias("state"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, label, pred): a labelled sample with a prediction, four classes."""
    lab, d = table(spark, sf_dir, "labels"), table(spark, sf_dir, "documents")
    label = F.col("quality") * 2 + F.col("toxic")
    pred = F.when(F.col("n_chars") > 1000, 2).otherwise(0) + F.when(F.col("n_chars") % 7 == 0, 1).otherwise(0)
    return lab.join(d, "doc_id").select(F.col("doc_id").alias("id"), label.cast("int").alias("label"), pred.cast("int").alias("pred"))


def similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(m1, m2, score): a complete symmetric matrix of the cosines between groups' mean vectors (label and vec_id mod 3)."""
    e = table(spark, sf_dir, "embeddings")
    comp = e.select((F.col("label") * 3 + F.col("vec_id") % 3).cast("int").alias("m"), F.posexplode("embedding").alias("k", "x"))
    mean = comp.groupBy("m", "k").agg(F.avg(F.col("x").cast("double")).alias("x"))
    norm = mean.groupBy("m").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("n"))
    mean = mean.join(norm, "m").select("m", "k", (F.col("x") / F.col("n")).alias("x"))
    other = mean.select(F.col("m").alias("m2"), "k", F.col("x").alias("y"))
    return mean.join(other, "k").groupBy(F.col("m").alias("m1"), "m2").agg(F.round(F.sum(F.col("x") * F.col("y")), 6).alias("score"))


def chain_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(ord, chain, end_pos): chains laid end to end, with strictly increasing ends, over all residues that predictions have."""
    o = table(spark, sf_dir, "orders")
    most = table(spark, sf_dir, "lineitem").agg(F.floor(F.max("l_suppkey") / 5).alias("m"))
    n = o.groupBy(F.substring("o_orderpriority", 1, 1).alias("chain")).agg((F.count("*") % 7 + 10).alias("n"))
    n = n.join(F.broadcast(most)).select("chain", (F.col("n") + F.col("m")).alias("n"))
    w = Window.orderBy("chain")  # one row for each chain
    return n.select(F.row_number().over(w).alias("ord"), "chain", F.sum("n").over(w).cast("int").alias("end_pos"))


#: The same tables in DuckDB's SQL, as common table expressions.
SQL = {
    "points": "points AS (SELECT chain, idx, idx + chain AS resnum, x, y, z FROM (SELECT label AS chain, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS idx, 120 * embedding[1]::DOUBLE AS x, 120 * embedding[2]::DOUBLE AS y, 120 * embedding[3]::DOUBLE AS z FROM embeddings))",
    "logits": "logits AS (SELECT vec_id AS pair, ((vec_id // 40) % 40 + 1)::INT AS i, (vec_id % 40 + 1)::INT AS j, list_transform(embedding, lambda x: x::DOUBLE * 20) AS logits FROM embeddings)",
    "predictions": "predictions AS (SELECT predictor, r1, r2, dst, prob, list_transform(range(10), lambda k: CASE WHEN k = bin THEN prob WHEN k = 9 THEN 1 - prob ELSE 0.0::DOUBLE END) AS p FROM (SELECT l_linenumber % 3 AS predictor, (l_suppkey + 1)::INT AS r1, (l_suppkey + 2 + l_partkey % 40)::INT AS r2, round(avg(l_quantity), 6) AS dst, round(avg(l_discount * 10), 6) AS prob, trunc(min(l_quantity))::INT % 9 AS bin FROM lineitem GROUP BY ALL))",
    "quality": "quality AS (SELECT l_linenumber % 3 AS predictor, 'm' || l_suppkey AS name, (l_partkey % 50)::INT AS k, CASE WHEN bool_and(l_returnflag = 'N') THEN NULL ELSE avg(l_quantity) / 6 END AS local FROM lineitem GROUP BY ALL)",
    "energy": "energy AS (SELECT 'm' || l_suppkey AS name, (l_partkey % 50)::INT AS k, [round(avg(l_quantity) * 1.5 / 25, 6), round(avg(l_discount) * -15, 6), round(avg(l_tax) * 15, 6)] AS terms FROM lineitem GROUP BY l_suppkey, l_partkey % 50)",
    "energy_terms": "energy_terms AS (SELECT 'm' || l_suppkey AS name, (l_partkey % 50)::INT AS k, [round(avg(l_quantity) * 1.5 / 25, 6), round(avg(l_discount) * -15, 6), round(avg(l_tax) * 15, 6), min(l_quantity) / 32.0::DOUBLE, max(l_quantity) / -64.0::DOUBLE, CASE WHEN min(l_quantity) > 3 THEN max(l_quantity) / 16.0::DOUBLE END] AS terms FROM lineitem GROUP BY l_suppkey, l_partkey % 50)",
    "truth": "truth AS (SELECT target, name, row_number() OVER (PARTITION BY target ORDER BY s_acctbal DESC, name) AS gt_rank FROM (SELECT 't' || (s_nationkey % 5) AS target, 'm' || s_suppkey AS name, s_acctbal FROM supplier))",
    "alignment": "alignment AS (SELECT lang || ':' || b AS grp, doc_id AS name, rpad(t[b * 60 + 1 : b * 60 + 60], 60, '-') AS aln FROM (SELECT lang, doc_id, t, unnest(range(0, (length(t) - 1) // 60 + 1)) AS b FROM (SELECT lang, doc_id, upper(regexp_replace(text, '[^A-Za-z]', '-', 'g')) AS t FROM documents) WHERE length(t) > 0)), cols AS (SELECT grp, name, col::INT AS col, aln[col:col] AS res FROM alignment, range(1, 61) r(col))",
    "hits": "hits AS (SELECT event_id AS ord, user_id AS sbjct, day(ts) AS round, round(value * 1e-3, 9) AS evalue, (event_id % 50 + 1)::INT AS qstart, (event_id % 50 + 21 + user_id % 30)::INT AS qend FROM events)",
    "states": "states AS (SELECT user_id AS seq, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos, CASE WHEN event_type = 'view' THEN 'C' ELSE upper(event_type[1:1]) END AS state FROM events)",
    "labelled": "labelled AS (SELECT doc_id AS id, (quality * 2 + toxic)::INT AS label, (CASE WHEN n_chars > 1000 THEN 2 ELSE 0 END + CASE WHEN n_chars % 7 = 0 THEN 1 ELSE 0 END)::INT AS pred FROM labels JOIN documents USING (doc_id))",
    "similarity": "comp AS (SELECT (label * 3 + vec_id % 3)::INT AS m, k, avg(embedding[k]::DOUBLE) AS x FROM embeddings, range(1, 65) r(k) GROUP BY ALL), unit AS (SELECT m, k, x / sqrt(sum(x * x) OVER (PARTITION BY m)) AS x FROM comp), similarity AS (SELECT a.m AS m1, b.m AS m2, round(sum(a.x * b.x), 6) AS score FROM unit a JOIN unit b USING (k) GROUP BY ALL)",
    "chain_ends": "chain_ends AS (SELECT row_number() OVER (ORDER BY chain) AS ord, chain, sum(n) OVER (ORDER BY chain)::INT AS end_pos FROM (SELECT o_orderpriority[1:1] AS chain, count(*) % 7 + 10 + (SELECT max(l_suppkey) // 5 FROM lineitem) AS n FROM orders GROUP BY o_orderpriority[1:1]))",
}
