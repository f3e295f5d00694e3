"""Text files larger than a task: read in byte ranges, cut at record marks, with the state of what encloses a record carried in.

Spark's text reader deals a file out by byte ranges that end with a line. Every line gets a number that grows with its place in the file, from the start
of its range and its place in it, and the numbered lines are written once to the shared folder, so that what follows finds the same
numbers however often it is repeated. A record's number is then a running count of marks, and its state (the search round, the query) the last
one named before it: both come from running values over stretches of a file (``operators.prefix``), so neither a file nor a range
has to be one task. Only the lines of one record are ever put together.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_seq
from ..operators import prefix
from ..session import scratch_folder, ship
from .reports import HIT, PARSERS, pairwise_records


#: Numbers that the lines of one part have to themselves.
PART = 1 << 44


def line_table(spark: SparkSession, path: str, parts: bool = False) -> DataFrame:
    """(file, ord, line) of all text files under a path; ``ord`` grows with the place in the file, with gaps. With ``parts`` the files are numbered
    parts, ``<target>-00000<suffix>`` and so on, and those of a target are one file."""
    at = F.col("_metadata.file_block_start")
    raw = spark.read.text(path).select(F.col("_metadata.file_path").alias("p"), at.alias("b"), F.monotonically_increasing_id().alias("i"), F.col("value").alias("line"))
    # the k-th line of a range starts k bytes behind the range's start at least, so numbers don't run into the next range
    place = F.col("b") + F.row_number().over(Window.partitionBy("p", "b").orderBy("i")) - 1
    out = f"{scratch_folder(spark, 'lines')}/table"
    name = F.element_at(F.split("p", "/"), -1)
    if parts:
        mark = r"-(\d{5,})(\.[^./-]*)?$"
        # a part is shorter than PART bytes
        place = F.regexp_extract(name, mark, 1).cast("long") * PART + place
        name = F.regexp_replace(name, mark, "$2")
    raw.select(name.alias("file"), place.alias("ord"), "line").write.parquet(out)
    return spark.read.schema("file string, ord long, line string").parquet(out)


def records(lines: DataFrame, start: Column, states: dict[str, Column] | None = None, ends: bool = False, stretch: int = prefix.STRETCH, only: Column | None = None) -> DataFrame:
    """(file, block, states …, text): the lines from one mark to the next, numbered from 1 in each file, with the last non-null value of each state up to
    the mark; with ``ends`` the mark closes a record and belongs to none, and numbers begin with 0. ``only`` says by the states which lines are put
    together; all are counted."""
    states = states or {}
    p = prefix.stretches(lines.withColumns({"_mark": start.cast("int"), **states}), ["file"], "ord", stretch)
    rows = prefix.summed(p, {"block": F.col("_mark")}, carry=tuple(states))
    rows = rows.filter("_mark = 0") if ends else rows.filter("block > 0")
    rows = rows if only is None else rows.filter(only)
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "line"))), lambda x: x["line"]), "\n")
    return rows.groupBy("file", "block").agg(*[F.min_by(n, "ord").alias(n) for n in states], text.alias("text"))


def _round(pattern: str) -> Column:
    return F.nullif(F.regexp_extract("line", pattern, 1), F.lit(""))


#: For each kind of report: what begins a record, the states that it needs, and the lines that tell the parser of them.
KINDS = {
    "profile": (">", {"round": r"^Results\s+from\s+round\s+(\d+)"}, {"round": "Results from round {}"}),
    "domain": (">>", {"query": r"^Query:\s*(\S+)", "round": r"^@@\s+Round:\s+(\d+)"}, {"query": "Query: {}", "round": "@@ Round: {}"}),
    "pair": (">", {}, {}),
}


def report_hits(lines: DataFrame, kind: str, alternatives: bool = False, stretch: int = prefix.STRETCH) -> DataFrame:
    """S13 to S15 from (file, ord, line): the hits of reports of any length, numbered from 0 in each file."""
    ship(lines.sparkSession)
    mark, patterns, told = KINDS[kind]
    found = records(lines, F.col("line").startswith(mark), {n: _round(p) for n, p in patterns.items()}, stretch=stretch)
    columns = [c.split()[0] for c in HIT.split(", ")]

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                head = [line.format(getattr(r, n)) for n, line in told.items() if getattr(r, n)]
                rows += [(r.file, r.block, k, *h) for k, h in enumerate(PARSERS[kind]("\n".join([*head, r.text]), alternatives))]
            out = pd.DataFrame(rows, columns=["file", "block", "k", *columns[2:]])
            yield out.astype({c: "Int32" for c in ("round", "qstart", "qend", "sstart", "send", "slen")})

    hits = found.mapInPandas(parse, "file string, block long, k int, " + ", ".join(HIT.split(", ")[2:]))
    # records of one file are numbered, so their hits are cut in stretches of these numbers
    p = prefix.Parts(hits.withColumn("_part", F.floor(F.col("block") / stretch)), ["file"], [F.col("block"), F.col("k")], False)
    return prefix.numbered(p, "ord").withColumn("ord", (F.col("ord") - 1).cast("int")).select(*columns)


def fasta(lines: DataFrame, stretch: int = prefix.STRETCH, name: str | None = None) -> DataFrame:
    """S17, S19 from (file, ord, line): (file, ord, name, descr, aln). With ``name`` the records of that name, of which alone the lines are grouped."""
    mark, head, first = F.col("line").startswith(">"), r"^>([^\n]*)", lambda c: F.regexp_extract(c, r"^\s*(\S+)", 1)
    states = {} if name is None else {"_name": F.when(mark, first(F.regexp_extract("line", head, 1)))}
    rows = records(lines, mark, states, stretch=stretch, only=None if name is None else F.col("_name") == name)
    descr = F.regexp_extract("text", head, 1)
    return rows.select("file", F.col("block").cast("int").alias("ord"), first(descr).alias("name"), F.trim(descr).alias("descr"), clean_seq(F.regexp_replace("text", r"^[^\n]*", "")).alias("aln"))


def pairwise(lines: DataFrame, stretch: int = prefix.STRETCH) -> DataFrame:
    """S16 from (file, ord, line): hits of blocks that end in '//'."""
    rows = records(lines, F.col("line").rlike(r"^//\s*$"), ends=True, stretch=stretch).filter(F.trim("text") != "")
    return pairwise_records(rows.select("file", F.col("block").cast("int").alias("ord"), F.col("text").alias("b")))


def profile_database(lines: DataFrame, stretch: int = prefix.STRETCH) -> DataFrame:
    """S20 from (file, ord, line): (file, ord, line) with a record of a profile database, which ends in a line '*', in each row, for
    ``tables.profile_record``."""
    rows = records(lines, F.rtrim("line") == "*", ends=True, stretch=stretch).filter(F.trim("text") != "")
    return rows.select("file", F.col("block").alias("ord"), F.col("text").alias("line"))
