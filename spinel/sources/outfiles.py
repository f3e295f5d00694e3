"""One ordered text file for each target, written by Spark's own committer and published by a rename.

The lines of a target go to one task, which sorts them on disk where they don't fit in memory and writes them in order; targets are spread
over the cluster. A target too large for one task is written as ordered parts (``split``). Everything is first written beside the
final folder; a task that fails is repeated by Spark, and a job that fails leaves nothing behind.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def framed(body: DataFrame, heads: list[Column | str], foot: list[Column | str] = (), target: str = "target") -> DataFrame:
    """(target, part, ord, line): header, body (target, ord, line) and footer of every target that the body has."""
    rows = body.select(target, F.lit(1).alias("part"), F.col("ord").cast("long").alias("ord"), "line")
    ends = [(p, k, x if isinstance(x, Column) else F.lit(x)) for p, lines in ((0, heads), (2, foot)) for k, x in enumerate(lines)]
    if not ends:
        return rows
    each = F.explode(F.array(*[F.struct(F.lit(p).alias("part"), F.lit(k).cast("long").alias("ord"), x.alias("line")) for p, k, x in ends]))
    return body.select(target).distinct().select(target, each.alias("e")).select(target, "e.*").unionByName(rows)


def _files(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def write_files(lines: DataFrame, path: str, target: str = "target", order: tuple[str, ...] = ("part", "ord"), suffix: str = ".txt", split: bool = False, overwrite: bool = False, numbered: bool = False) -> int:
    """Writes ``<path>/<target><suffix>`` with the target's lines in the order of ``order``, and says how many files there are.

    Characters that paths can't hold are escaped as Spark escapes them in partition folders. With ``split`` a target may be several files,
    ``<target>-00000<suffix>`` and so on, which put together are its file; with ``numbered`` one of a single file is named so too. A null target or line is an error. The folder must not be there,
    or is replaced at the end with ``overwrite``. The driver renames files, one call each, and never reads them.
    """
    spark = lines.sparkSession
    final, fs = _files(spark, path.rstrip("/"))
    if fs.exists(final) and not overwrite:
        raise FileExistsError(f"{path} is there")
    work = f"{final.getParent()}/.{final.getName()}-{uuid.uuid4().hex}"
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.raise_error(F.lit(f"a null {c}")).cast("string"), F.lit("")).alias(c)
    rows = lines.select(said(target), *order, said("line"))
    dealt = rows.repartitionByRange(target, *order) if split else rows.repartition(target)
    try:
        dealt.sortWithinPartitions(target, *order).select(target, "line").write.partitionBy(target).text(f"{work}/parts")
        made = _named(spark, work, target, suffix, numbered)
        if overwrite:
            fs.delete(final, True)
        if not fs.rename(spark._jvm.org.apache.hadoop.fs.Path(f"{work}/files"), final):
            raise OSError(f"{path} can't be made")
        return made
    finally:
        fs.delete(spark._jvm.org.apache.hadoop.fs.Path(work), True)


def _named(spark: SparkSession, work: str, target: str, suffix: str, numbered: bool = False) -> int:
    """Moves the writer's parts, whose names sort as their tasks do, to files named by target."""
    new = spark._jvm.org.apache.hadoop.fs.Path
    parts, fs = _files(spark, f"{work}/parts")
    fs.mkdirs(new(f"{work}/files"))
    made = 0
    for folder in fs.listStatus(parts):
        name = folder.getPath().getName()
        if not folder.isDirectory() or not name.startswith(f"{target}="):
            continue
        own = sorted(str(f.getPath()) for f in fs.listStatus(folder.getPath()) if f.getPath().getName().startswith("part-"))
        for k, one in enumerate(own):
            stem = name[len(target) + 1 :] + (f"-{k:05d}" if numbered or len(own) > 1 else "")
            if not fs.rename(new(one), new(f"{work}/files/{stem}{suffix}")):
                raise OSError(f"{one} can't be named {stem}{suffix}")
            made += 1
    return made


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(file, value): whole files under a path, named by their target, as they were written."""
    name = F.regexp_replace(F.element_at(F.split(F.input_file_name(), "/"), -1), r"\.[^.]*$", "")
    return spark.read.text(path, wholetext=True).select(name.alias("file"), "value")
