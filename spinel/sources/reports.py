"""Alignments and search reports as hits. FASTA dialects are native; the reports of search programs are read file by file in Arrow
batches, since their blocks carry state from line to line.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import clean_seq, parse_header, trim_gaps
from ..session import ship

HIT = "file string, ord int, round int, descr string, evalue double, qaln string, saln string, qstart int, qend int, sstart int, send int, slen int"


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """(file, ord, name, descr, aln) of FASTA files, in order; letters upper case, dots gaps."""
    return fasta_records(spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value"))


def fasta_records(texts: DataFrame) -> DataFrame:
    """S17, S19 from (file, value), whole files."""
    rows = texts.select("file", F.posexplode(F.split("value", r"(?m)^>")).alias("ord", "rec")).filter("ord > 0")
    descr = F.regexp_extract("rec", r"^([^\n]*)", 1)
    return rows.select("file", F.col("ord").alias("ord"), F.regexp_extract(descr, r"^\s*(\S+)", 1).alias("name"), F.trim(descr).alias("descr"), clean_seq(F.regexp_replace("rec", r"^[^\n]*", "")).alias("aln"))


def reference_row(aln: DataFrame, name: str) -> DataFrame:
    """S18."""
    return aln.filter(F.col("name") == name).withColumn("aln", F.upper("aln"))


def aligned_hits(aln: DataFrame, reference: str) -> DataFrame:
    """S17, J: each row of an alignment beside the reference row, as a hit; the reference (by prefix) itself is left out."""
    ref = reference_row(aln, reference).select("file", F.col("aln").alias("qaln"))
    rows = aln.filter(~F.col("name").startswith(reference)).join(ref, "file")
    n = lambda c: F.length(F.regexp_replace(c, "-", ""))
    return rows.select("file", "ord", F.col("name").alias("sbjct"), "qaln", F.col("aln").alias("saln"), F.lit(1).alias("qstart"), n("qaln").alias("qend"), F.lit(1).alias("sstart"), n("aln").alias("send"))


def pairwise(spark: SparkSession, path: str) -> DataFrame:
    """Hits of pairwise FASTA whose blocks end in '//': two headers with bounds and E-value, each before its aligned string."""
    text = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return pairwise_blocks(text)


def pairwise_blocks(texts: DataFrame) -> DataFrame:
    """S16 from (file, value), whole files."""
    return pairwise_records(texts.select("file", F.posexplode(F.split("value", r"(?m)^//\s*$")).alias("ord", "b")).filter(F.trim("b") != ""))


def pairwise_records(rows: DataFrame) -> DataFrame:
    """S16 from (file, ord, b), one block each."""
    g = lambda k: F.regexp_extract("b", r"(?s)>([^\n]*)\n([^>]*)>([^\n]*)\n(.*)", k)
    both = rows.select("file", "ord", parse_header(g(1)).alias("q"), parse_header(g(3)).alias("s"), clean_seq(g(2)).alias("qaln"), clean_seq(g(4)).alias("saln"))
    return both.select(
        "file", "ord", F.col("q.name").alias("query"), F.col("s.name").alias("sbjct"), F.coalesce("s.evalue", "q.evalue").alias("evalue"), "qaln", "saln",
        F.col("q.start").alias("qstart"), F.col("q.end").alias("qend"), F.col("s.start").alias("sstart"), F.col("s.end").alias("send"), F.col("s.len").alias("slen"),
    )


def _number(text: str) -> float | None:
    text = text.strip().rstrip(",")
    text = "1" + text if text[:1] in "eE" else text
    try:
        return float(text)
    except ValueError:
        return None


def _hit(descr: str, evalue: float | None, rnd: int, length: int | None = None) -> dict:
    return {"r": rnd, "d": descr, "e": evalue, "q": "", "s": "", "qs": None, "qe": None, "ss": None, "se": None, "l": length}


def _add(hit: dict, side: str, start: str, seq: str, end: str) -> None:
    hit[side] += seq.replace(".", "-")
    hit[side + "s"] = hit[side + "s"] or int(start)
    hit[side + "e"] = int(end)


def _rows(hits: list[dict]) -> list[tuple]:
    """Hits with a subject, an E-value and strings of one length; others are left out."""
    whole = [h for h in hits if h["d"] and h["e"] is not None and h["q"] and len(h["q"]) == len(h["s"])]
    return [(h["r"], h["d"], h["e"], h["q"], h["s"], h["qs"], h["qe"], h["ss"], h["se"], h["l"]) for h in whole]


def parse_profile_report(text: str, alternatives: bool = False) -> list[tuple]:
    """S13: '>description', 'Probab=… E-value=…', then rows 'Q name start seq end (len)' and 'T name start seq end (len)'.

    'Results from round N' counts rounds. A second 'Probab=' below one description is another alignment of that subject, kept only with
    ``alternatives``. Consensus rows and rows without numbers don't count.
    """
    out: list[dict] = []
    hit, rnd, subject = None, 1, ""
    for line in text.split("\n"):
        if m := re.match(r"Results\s+from\s+round\s+(\d+)", line):
            rnd = int(m[1])
        elif line.startswith(">"):
            subject, hit = line[1:].strip(), None
        elif m := re.match(r"Probab=\s*\S+\s+E-value=\s*(\S+)", line):
            again = hit is not None
            hit = _hit(subject, _number(m[1]), rnd)
            if alternatives or not again:
                out.append(hit)
        elif hit is not None and (m := re.match(r"([QT])\s+(?!Consensus)\S+\s+(\d+)\s+([A-Za-z-]+)\s+(\d+)\s*(?:\((\d+)\))?", line)):
            _add(hit, "q" if m[1] == "Q" else "s", m[2], m[3], m[4])
            if m[1] == "T" and m[5] and hit["l"] is None:
                hit["l"] = int(m[5])
    return _rows(out)


def parse_domain_report(text: str, alternatives: bool = False) -> list[tuple]:
    """S14: '>> subject', a table of domains whose sixth column is the E-value, '== domain k', then rows 'name start seq end' of the query and
    of the subject; '@@ Round:' counts rounds, 'Query:' names the query. Of several domains the one with the least E-value is kept, or all
    with ``alternatives``."""
    out: list[dict] = []
    rnd, query, subject, length = 1, "", None, None
    evalues: dict[str, float | None] = {}
    domains: dict[str, dict] = {}
    hit = None

    def close() -> None:
        for k, h in domains.items():
            h["e"] = evalues.get(k)
        known = [h for h in domains.values() if h["e"] is not None]
        out.extend(known if alternatives else sorted(known, key=lambda h: h["e"])[:1])
        domains.clear()
        evalues.clear()

    for line in text.split("\n"):
        if m := re.match(r"Query:\s*(\S+)", line):
            query = m[1]
        elif m := re.match(r"@@\s+Round:\s+(\d+)", line):
            close()
            rnd = int(m[1])
        elif line.startswith(">>"):
            close()
            subject, hit = line[2:].strip(), None
            m = re.search(r"LEN=(\d+)", line)
            length = int(m[1]) if m else None
        elif subject is None or not query:
            continue
        elif m := re.match(r"\s+(\d+)\s+[!?]\s+\S+\s+\S+\s+\S+\s+([\d.eE+-]+)\s", line):
            evalues[m[1]] = _number(m[2])
        elif m := re.match(r"\s+==\s+domain\s+(\d+)\s", line):
            hit = domains.setdefault(m[1], _hit(subject, None, rnd, length))
        elif hit is not None and (m := re.match(r"\s*(\S+)\s+(\d+)\s+([A-Za-z.-]+)\s+(\d+)\s*$", line)):
            _add(hit, "q" if m[1].startswith(query) else "s", m[2], m[3], m[4])
    close()
    return _rows(out)


def parse_pair_report(text: str, alternatives: bool = False) -> list[tuple]:
    """S15: '>subject', 'Length = n', 'Score = …, Expect = x', then rows 'Query: start seq end' and 'Sbjct: start seq end'."""
    out: list[dict] = []
    hit, subject, length = None, "", None
    for line in text.split("\n"):
        if line.startswith(">"):
            subject, length, hit = line[1:].strip(), None, None
        elif m := re.search(r"Length\s*(?:of subject)?\s*[=:]\s*(\d+)", line):
            length = int(m[1])
        if m := re.search(r"Expect\s*=\s*([^\s,]+)", line):
            hit = _hit(subject, _number(m[1]), 1, length)
            out.append(hit)
        elif hit is not None and (m := re.match(r"\s*(Query|Sbjct):?\s+(\d+)\s+([A-Za-z.\-]+)\s+(\d+)", line)):
            _add(hit, m[1][0].lower(), m[2], m[3], m[4])
    return _rows(out)


PARSERS = {"profile": parse_profile_report, "domain": parse_domain_report, "pair": parse_pair_report}


def report_hits(spark: SparkSession, path: str, kind: str, alternatives: bool = False) -> DataFrame:
    """Hits of all reports under a path, one file a row in Arrow batches."""
    texts = spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value")
    return parsed_reports(texts, kind, alternatives)


def parsed_reports(texts: DataFrame, kind: str, alternatives: bool = False) -> DataFrame:
    """S13 to S15 from (file, value), whole reports."""
    ship(texts.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(f, k, *h) for f, t in zip(pdf["file"], pdf["value"], strict=True) for k, h in enumerate(PARSERS[kind](t, alternatives))]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in HIT.split(", ")]).astype({c: "Int32" for c in ("ord", "round", "qstart", "qend", "sstart", "send", "slen")})

    return texts.select("file", "value").mapInPandas(run, HIT)


def structural_report(spark: SparkSession, path: str) -> DataFrame:
    """(file, zscore, qaln, saln, qstart, sstart) of structural-alignment pages, ends trimmed."""
    return structural_pages(spark.read.text(path, wholetext=True).select(F.element_at(F.split(F.input_file_name(), "/"), -1).alias("file"), "value"))


def structural_pages(texts: DataFrame) -> DataFrame:
    """S28 from (file, value): the first alignment of a page, from its line '… Sbjct=… Z-score=x<' to the end of the preformatted block."""
    part = F.regexp_extract("value", r"(?s)[^\n]*\sSbjct=\S+\s+Z-score=([\d.eE+-]+)<(.*?)(?:\n</PRE>|\z)", 2)
    z = F.regexp_extract("value", r"\sSbjct=\S+\s+Z-score=([\d.eE+-]+)<", 1).try_cast("double")
    strand = lambda n: F.array_join(F.transform(F.regexp_extract_all("t", F.lit(rf"(?m)^{n}\s+(\S+)\s+\d+\s*$"), 1), lambda x: F.translate(x, ".", "-")), "")
    rows = texts.select("file", z.alias("zscore"), part.alias("t")).select("file", "zscore", strand("Query").alias("q"), strand("Sbjct").alias("s"))
    rows = rows.filter((F.col("q") != "") & (F.length("q") == F.length("s")))
    t = trim_gaps(F.col("q"), F.col("s"), F.lit(1), F.lit(1))
    return rows.select("file", "zscore", t.alias("t")).select("file", "zscore", F.col("t.q").alias("qaln"), F.col("t.s").alias("saln"), F.col("t.q_start").alias("qstart"), F.col("t.s_start").alias("sstart"))
