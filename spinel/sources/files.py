"""Finding files: listings, pairing, layouts. Only Spark's readers touch the file system."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def listing(spark: SparkSession, folder: str, ext: str = "", stem: bool = False) -> DataFrame:
    """(path, name, length) of a folder's files with an extension, without it if ``stem``; contents aren't read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", f"*{ext}").load(folder).select("path", "length")
    name = F.element_at(F.split("path", "/"), -1)
    return files.select("path", (F.expr(f"left(element_at(split(path, '/'), -1), length(element_at(split(path, '/'), -1)) - {len(ext)})") if stem and ext else name).alias("name"), "length")


def by_size(files: DataFrame) -> DataFrame:
    """Largest first."""
    return files.orderBy(F.desc("length"), "name")


def lines(spark: SparkSession, path: str, sep: str | None = None) -> DataFrame:
    """(file, ord, line): records of text files with their order, which the reader's byte offsets don't give across splits.

    A file is one record list; files of this domain are small, and many of them are read at once.
    """
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    parts = F.split("value", "\n" if sep is None else sep)
    rows = text.select("file", F.posexplode(parts).alias("ord", "line"))
    # what follows the last separator is no record
    return rows.filter(~((F.trim("line") == "") & (F.lit(sep is not None)))).select("file", F.col("ord").cast("long").alias("ord"), "line")


def pair_files(left: DataFrame, right: DataFrame, strict: bool = False) -> DataFrame:
    """Files of two folders by stem: those of the left with their partner or null; in strict form a missing one is an error."""
    r = right.select("name", F.col("path").alias("partner"))
    if not strict:
        return left.select("name", "path").join(r, "name", "left")
    rows = left.select("name", "path").join(r, "name", "full_outer")
    both = F.when(F.col("path").isNotNull() & F.col("partner").isNotNull(), F.col("path")).otherwise(F.raise_error(F.concat(F.lit("no partner for "), "name")).cast("string"))
    return rows.select("name", both.alias("path"), "partner")


def splits(files: DataFrame) -> DataFrame:
    """The train, val or test part a path lies in, sorted by name."""
    return files.withColumn("split", F.regexp_extract("path", r"/(train|val|test)(?:_labels)?/", 1)).filter("split <> ''").orderBy("split", "name")


def class_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(name, r, g, b)."""
    return spark.read.csv(path, header=True, schema="name string, r int, g int, b int")


def first_available(wanted: DataFrame, *sources: DataFrame) -> DataFrame:
    """The first of several local candidates for each id, null if none has it; nothing is fetched."""
    out = wanted
    for k, s in enumerate(sources):
        out = out.join(s.select("id", F.col("path").alias(f"_p{k}")), "id", "left")
    return out.select(*wanted.columns, F.coalesce(*[F.col(f"_p{k}") for k in range(len(sources))]).alias("path"))


def id_list(rows: DataFrame) -> DataFrame:
    """Ids from lines, without comments; a line may hold several with commas."""
    one = rows.filter(~F.trim("line").startswith("#")).select(F.explode(F.split("line", "[,\\s]+")).alias("id"))
    return one.filter("id <> ''").distinct()
