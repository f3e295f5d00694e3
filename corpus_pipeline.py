"""A corpus pipeline of five operators: each stage's rows are written as Parquet and read again by the next.

ORACLE_SQL is None: the classifier and the piece lattice have no SQL; ``tests/llm/test_pipeline.py`` holds each stage against
a brute-force version instead.

Input with null, empty or very long texts, null or repeated ids, repeated rows, no rows, and further columns of any name is defined for
every stage, as its function says; all but the last return exactly the columns of their input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spinel.llm import forest, lines, mixing, pieces, quality
from spinel.llm.staging import private, staged, word_count


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier accepts (predicted 1); each row by itself, so repeated rows share their fate.

    Null and empty texts have no features and go by the layer's bias; without labels of both kinds all documents stay or all go, as the
    only label says. Columns of its own names (score, predicted) come through.
    """
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    own = private(docs.columns, "quality_")
    spare = {c: f"{own}{c}" for c in docs.columns if c in ("score", "predicted")}
    scored = quality.score_documents(docs.withColumnsRenamed(spare), labels).filter("predicted = 1")
    return scored.drop("score", "predicted").withColumnsRenamed({v: k for k, v in spare.items()}).select(*docs.columns)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later occurrences of three-line windows cut; a document that loses its last word this way goes. n_chars, if there, follows the text.

    Null texts and texts of fewer than three lines stay as they are; rows that repeat id and text have one verdict. Columns of its own
    names (n_lines, n_removed) come through.
    """
    own = private(docs.columns, "lines_")
    spare = {c: f"{own}{c}" for c in docs.columns if c in ("n_lines", "n_removed")}
    cut = F.col("n_removed") > 0
    cleaned = lines.dedup_lines(docs.withColumnsRenamed(spare)).filter(~cut | (word_count(F.col("text")) > 0))
    follows = lambda c: F.when(cut, F.length("text")).otherwise(F.col(c)).cast(docs.schema[c].dataType).alias(c)
    return cleaned.select(*[follows(c) if c == "n_chars" else F.col(spare.get(c, c)).alias(c) for c in docs.columns])


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id (null last), of each group linked by a Jaccard similarity of 0.8 or more.

    Null, empty and blank texts have no links and stay; of rows that repeat id and text one stays.
    """
    return forest.one_of_each(docs)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources at their targets: a document stands as often as the mix takes it, up to three times.

    Null and empty texts have size 0; a null source is one of its own. A table without words has targets of 0, and nothing is taken.
    """
    return mixing.mixed_rows(docs)


def encoding_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids and scores of the N best segmentations of each row; null and empty texts have no pieces, and repeated rows repeated results."""
    return pieces.encode_documents(docs, variants=True)


STAGES = [
    ("quality classifier", quality_stage),
    ("line dedup", line_stage),
    ("n-gram Jaccard join", near_duplicate_stage),
    ("mixing sources to target weights", mixing_stage),
    ("SentencePiece encoding", encoding_stage),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"pipeline-{k}")
    return docs
