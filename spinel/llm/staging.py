"""Cutting lineage through tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Java regex of a word: a run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"


_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder only where it is unset and the session is local, as in tests."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _LOCAL:
            _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="spinel-checkpoint-")
        return _LOCAL[app]
    return folder


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back: lost executors repeat nothing before it."""
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/spinel/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._spinel_path = path
    return out


def discard(df: DataFrame) -> None:
    """Deletes a staged table that no later plan reads."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(df._spinel_path)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def private(columns: list[str], stem: str) -> str:
    """A prefix that no column has, whatever its case."""
    while any(c.lower().startswith(stem) for c in columns):
        stem = "_" + stem
    return stem


def word_count(text: Column) -> Column:
    """Number of words; null counts as the empty text."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")
