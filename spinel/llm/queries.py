"""The registered queries of this package and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import anisotropic, codes, compression, dualtree, forest, html, lines, mixing, pieces, quality, spelling, suffixes, toxicity
from .sample import fold


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def _held_out(modulus: int, held: int):
    return F.coalesce(fold(F.col("doc_id"), modulus) == held, F.lit(False)).alias("held_out")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score_documents(_docs(spark, sf_dir), _labels(spark, sf_dir))
    return scored.select("doc_id", _held_out(4, 2), "score", "predicted", "offending")


def op2_compression_bands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compression.judge_documents(_docs(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.score_documents(_docs(spark, sf_dir).select("doc_id", "text"), _labels(spark, sf_dir))
    return scored.select("doc_id", _held_out(5, 0), "score", "predicted")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.dedup_lines(_docs(spark, sf_dir).select("doc_id", "text"))


def op5_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(_docs(spark, sf_dir).select("doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return anisotropic.search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return forest.join_documents(_docs(spark, sf_dir).select("doc_id", "text")).select("doc_id", "class_id", "n_links", "n_copies")


def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffixes.remove_repeats(_docs(spark, sf_dir).select("doc_id", "text")).drop("kept")


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode_documents(_docs(spark, sf_dir), variants=True)


def op11_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    named = codes.identify(_docs(spark, sf_dir).select("doc_id", "text", "lang"))
    return named.select("doc_id", _held_out(3, 1), "lang_pred", "score", "runner_up", "gap", "ambiguous")


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_docs(spark, sf_dir).select("doc_id", "text"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dualtree.cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_compression_bands": op2_compression_bands,
    "op3_quality": op3_quality,
    "op4_line_dedup": op4_line_dedup,
    "op5_html_extraction": op5_html_extraction,
    "op6_mixing": op6_mixing,
    "op7_nearest": op7_nearest,
    "op8_jaccard_join": op8_jaccard_join,
    "op9_suffix_dedup": op9_suffix_dedup,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_language": op11_language,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_centroids": op13_centroids,
}


def _lloyd_sql(rounds: int) -> str:
    """Plain rounds over all pairs of vectors and centroids."""
    nearest = """a{0} AS MATERIALIZED (SELECT uid, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT uid, k, list_sum(list_transform(list_zip(v, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d FROM v, c{0}) GROUP BY uid)"""
    moved = """c{1} AS MATERIALIZED (SELECT k, coalesce(m.c, c{0}.c) AS c FROM c{0} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY p) AS c
  FROM (SELECT k, p, sum(x) AS s, count(*) AS n FROM (SELECT k, unnest(v) AS x, unnest(range(64)) AS p FROM a{0} JOIN v USING (uid)) GROUP BY k, p) GROUP BY k) m USING (k))"""
    steps = [text.format(r, r + 1) for r in range(rounds) for text in (nearest, moved)]
    return (
        """
WITH v AS MATERIALIZED (SELECT row_number() OVER () AS uid, vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c FROM (SELECT sha256('1:' || vec_id::VARCHAR) AS h, v FROM v) QUALIFY row_number() OVER (ORDER BY h, v) <= 16),
"""
        + ",\n".join([*steps, nearest.format(rounds)])
        + """
SELECT v.vec_id, a{0}.k::INTEGER AS cluster, a{0}.d AS distance, (sum(a{0}.d) OVER (PARTITION BY a{0}.k))::BIGINT AS cluster_inertia, (sum(a{0}.d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{0}.c, ',')) AS centroid_sha256
FROM v JOIN a{0} USING (uid) JOIN c{0} USING (k)
""".format(rounds)
    )


ORACLE: dict[str, str] = {
    "op13_centroids": _lloyd_sql(3),
    "op4_line_dedup": r"""
WITH l AS (SELECT doc_id, text, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents WHERE text IS NOT NULL),
nb AS (SELECT doc_id, i, trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS t, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM l
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]')),
w AS (SELECT a.doc_id, a.i AS i0, b.i AS i1, c.i AS i2, a.t || chr(10) || b.t || chr(10) || c.t AS k
  FROM nb a JOIN nb b ON a.doc_id = b.doc_id AND b.j = a.j + 1 JOIN nb c ON a.doc_id = c.doc_id AND c.j = a.j + 2),
r AS (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, i0) AS rn FROM w),
gone AS (SELECT DISTINCT doc_id, unnest([i0, i1, i2]) AS i FROM r WHERE rn > 1),
kept AS (SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.i) AS text FROM l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.i = g.i WHERE g.i IS NULL GROUP BY l.doc_id),
n AS (SELECT doc_id, count(*) AS n FROM gone GROUP BY doc_id)
SELECT d.doc_id, CASE WHEN d.text IS NULL THEN NULL ELSE coalesce(kept.text, '') END AS text,
  CASE WHEN d.text IS NULL THEN 0 ELSE len(string_split(d.text, chr(10))) END AS n_lines, coalesce(n.n, 0) AS n_removed
FROM documents d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN n ON d.doc_id = n.doc_id
""",
    "op6_mixing": r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5(concat_ws(':', 'mix-0', doc_id::VARCHAR, text)) AS h FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size, (row_number() OVER (ORDER BY source COLLATE "binary" NULLS LAST) - 1) % 3 + 1 AS weight FROM d GROUP BY source),
o AS (SELECT *, sum(3 * source_size) OVER w - 3 * source_size AS held, sum(weight) OVER () - sum(weight) OVER w + weight AS free, sum(source_size) OVER () AS total
  FROM s WINDOW w AS (ORDER BY 3.0 * source_size / weight, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
lv AS (SELECT arg_min((total - held) / free::DOUBLE, 3.0 * source_size / weight) FILTER (WHERE (total - held) / free::DOUBLE <= 3.0 * source_size / weight) AS level FROM o),
t AS (SELECT source, source_size, round(least(3.0 * source_size, level * weight)::DOUBLE, 6) AS target FROM s, lv),
p AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS whole FROM t),
r AS (SELECT *, row_number() OVER (ORDER BY h) AS rn FROM d),
m AS (SELECT *, sum(size) OVER (PARTITION BY source ORDER BY h, rn ROWS UNBOUNDED PRECEDING) - size / 2.0 AS middle FROM r),
e AS (SELECT m.doc_id, m.size, p.*, p.whole + CASE WHEN p.target > p.whole * p.source_size AND m.middle < p.target - p.whole * p.source_size THEN 1 ELSE 0 END AS copies FROM m JOIN p ON p.source IS NOT DISTINCT FROM m.source)
SELECT doc_id, size::BIGINT AS size, source_size, target, (size * copies)::BIGINT AS taken, copies::BIGINT AS copies FROM e
""",
}
