"""Scalar functions over sequences, headers and report fields; all are native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Three-letter residue names and their letters.
RESIDUES = {
    "ALA": "A", "ARG": "R", "ASN": "N", "ASP": "D", "CYS": "C", "GLN": "Q", "GLU": "E", "GLY": "G", "HIS": "H", "ILE": "I",
    "LEU": "L", "LYS": "K", "MET": "M", "PHE": "F", "PRO": "P", "SER": "S", "THR": "T", "TRP": "W", "TYR": "Y", "VAL": "V",
}


def mask_noncanonical(s: Column) -> Column:
    """Letters that are no residue become X; gaps stay."""
    return F.regexp_replace(s, "[^ACDEFGHIKLMNPQRSTVWY-]", "X")


def parse_evalue(s: Column) -> Column:
    """C16: 'e-5' means 1e-5; 'n/a' and what is no number are null."""
    return F.regexp_replace(F.trim(s), "^[eE]", "1e").try_cast("double")


def parse_header(s: Column) -> Column:
    """C17: name, bounds, E-value and length of a header such as '>name (ALN: 3-90) text  Expect=1e-5'.

    The bounds may lack their mark and parentheses, and are the last such pair behind white space; the E-value ends the header; the
    length, LEN=n, may be absent.
    """
    g = lambda k: F.nullif(F.regexp_extract(s, r"^>?\s*(\S+).*\s\(?(?:ALN:\s*)?(\d+)[-\s](\d+)\)?", k), F.lit(""))
    e = F.regexp_extract(s, r"[=\s]([\d.eE+-]+|n/a)\s*$", 1)
    length = F.nullif(F.regexp_extract(s, r"LEN=(\d+)", 1), F.lit("")).cast("int")
    return F.struct(F.regexp_extract(s, r"^>?\s*(\S+)", 1).alias("name"), g(2).cast("int").alias("start"), g(3).cast("int").alias("end"), parse_evalue(e).alias("evalue"), length.alias("len"))


def clean_seq(s: Column) -> Column:
    """Dots become gaps, letters upper case, white space goes."""
    return F.upper(F.regexp_replace(F.translate(s, ".", "-"), r"\s+", ""))


def shift(pos: Column, n: int) -> Column:
    """A shifted position; one below 1 is an error."""
    moved = pos + n
    return F.when(moved >= 1, moved).otherwise(F.raise_error(F.concat(F.lit("position below 1: "), moved.cast("string"))).cast("int"))


CONFIG = r"(?:modelRUN|r)(\d+)e(\d+)(?:__full_)?d(\d+)_?p([0-9.]*[0-9])"


def parse_config(s: Column) -> Column:
    """C20: run, epoch, distance and probability of the first configuration in a name such as 'QA2__modelRUN1e20__full_d8_p0.1', or in
    short 'r1e20d8p0.1'."""
    part = lambda k, t: F.nullif(F.regexp_extract(s, CONFIG, k), F.lit("")).cast(t)
    return F.struct(part(1, "int").alias("run"), part(2, "int").alias("epoch"), part(3, "int").alias("dst"), part(4, "double").alias("prob"))


def parse_configs(s: Column) -> Column:
    """C20: all configurations of a combined name."""
    return F.transform(F.regexp_extract_all(s, F.lit(CONFIG), 0), parse_config)


def one_letter(name: Column) -> Column:
    """The residue's letter, X if unknown."""
    table = F.create_map(*[F.lit(x) for kv in RESIDUES.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.upper(name)), F.lit("X"))


def strip_icode(s: Column) -> Column:
    """A residue number without its insertion letter."""
    return F.regexp_replace(F.trim(s), "[A-Za-z]$", "").cast("int")


def trim_gaps(q: Column, s: Column, q_start: Column, s_start: Column) -> Column:
    """An aligned pair without the columns before and after both strings have letters, and the starts this gives."""
    both = F.transform(F.sequence(F.lit(1), F.greatest(F.length(q), F.lit(1))), lambda k: (F.substr(q, k, F.lit(1)) != "-") & (F.substr(s, k, F.lit(1)) != "-"))
    at = F.array_position(both, True).cast("int")
    first = F.when(at > 0, at - 1).otherwise(F.length(q))
    last = F.when(at > 0, F.array_position(F.reverse(both), True).cast("int") - 1).otherwise(0)
    n = F.greatest(F.length(q) - first - last, F.lit(0))
    cut = lambda x: F.substr(x, first + 1, n)
    skipped = lambda x: F.length(F.regexp_replace(F.substr(x, F.lit(1), first), "-", ""))
    return F.struct(cut(q).alias("q"), cut(s).alias("s"), (q_start + skipped(q)).alias("q_start"), (s_start + skipped(s)).alias("s_start"))


def wrap(s: Column, width: int = 60) -> Column:
    """A sequence in lines of fixed width."""
    return F.rtrim(F.regexp_replace(s, f"(.{{{width}}})", "$1\n"), F.lit("\n"))
