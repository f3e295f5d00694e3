"""Sequential structure: runs, ordinals, search rounds, top-k per group, order and set operations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import prefix


def run_ids(states: DataFrame, stretch: int = prefix.STRETCH) -> DataFrame:
    """(seq, pos, state, run): runs of equal states numbered from 1 over the non-coil ones; coil is -1.

    A sequence longer than ``stretch`` is several tasks: each stretch hears the state before it, and how many runs begin in the ones before.
    """
    p = prefix.previous(prefix.stretches(states.select("seq", "pos", "state"), ["seq"], "pos", stretch), "state", "_was")
    coil = F.upper("state") == "C"
    fresh = (~coil & (F.col("_was").isNull() | (F.col("_was") != F.col("state")))).cast("int")
    number = prefix.summed(prefix.Parts(p.rows.withColumn("_f", fresh), p.keys, p.order, p.few), {"_n": F.col("_f")})
    return number.select("seq", "pos", "state", F.when(coil, -1).otherwise(F.col("_n")).cast("int").alias("run"))


def ordinal(df: DataFrame, key: str, order: str) -> DataFrame:
    """The place of a row in its group."""
    return df.withColumn("ordinal", F.row_number().over(Window.partitionBy(key).orderBy(order)))


def aln_coord(cols: DataFrame, stretch: int = prefix.STRETCH) -> DataFrame:
    """The number of residues up to each column; a row of more than ``stretch`` columns is several tasks."""
    return prefix.summed(prefix.stretches(cols, ["grp", "name"], "col", stretch), {"coord": (F.col("res") != "-").cast("int")})


def row_coord(aln: DataFrame, piece: int = 64) -> DataFrame:
    """W06 from whole rows (grp, name, aln): (grp, name, col, res, coord). A row's residues are counted where it stands, in pieces, so neither rows
    nor columns are shuffled."""
    count = lambda s: F.length(F.translate(s, "-", ""))
    at = F.explode(F.sequence(F.lit(0), F.floor((F.length("aln") - 1) / piece).cast("int")))
    pieces = aln.filter(F.length("aln") > 0).select("*", at.alias("_b"))
    pieces = pieces.select("grp", "name", "_b", F.substr("aln", F.col("_b") * piece + 1, F.lit(piece)).alias("_s"), count(F.substr("aln", F.lit(1), F.col("_b") * piece)).alias("_n"))
    cells = pieces.select("*", F.explode(F.sequence(F.lit(1), F.length("_s"))).alias("_c"))
    coord = (F.col("_n") + count(F.substr("_s", F.lit(1), F.col("_c")))).cast("long")
    return cells.select("grp", "name", (F.col("_b") * piece + F.col("_c")).alias("col"), F.substr("_s", F.col("_c"), F.lit(1)).alias("res"), coord.alias("coord"))


def evalue_filter(hits: DataFrame, most: float = 1e-4, reject_negative: bool = True) -> DataFrame:
    """F01."""
    rows = hits.filter(F.col("evalue") <= most)
    return rows.filter(F.col("evalue") >= 0) if reject_negative else rows


def allow_list(hits: DataFrame, ids: DataFrame | None) -> DataFrame:
    """subjects of a list; all without one."""
    return hits if ids is None else hits.join(ids, "sbjct", "left_semi")


def valid_hits(hits: DataFrame) -> DataFrame:
    """hits with the reason against them, null if valid."""
    reason = (
        F.when(F.length("qaln") != F.length("saln"), "lengths differ")
        .when((F.col("qstart") < 1) | (F.col("sstart") < 1), "start below 1")
        .when((F.col("qend") < F.col("qstart")) | (F.col("send") < F.col("sstart")), "end before start")
    )
    return hits.withColumn("invalid", reason)


def last_round(hits: DataFrame, number: int | None = None) -> DataFrame:
    """the last search round, or a given one."""
    if number is not None:
        return hits.filter(F.col("round") == number)
    last = hits.agg(F.max("round").alias("round"))
    return hits.join(F.broadcast(last), "round", "left_semi")  # one row


def best_alternative(hits: DataFrame, key: str = "sbjct") -> DataFrame:
    """the hit with the least E-value of each subject, the first of equals."""
    cols = [c for c in hits.columns if c != key]
    best = hits.groupBy(key).agg(F.min_by(F.struct(*cols), F.struct("evalue", "ord")).alias("_h"))
    return best.select(key, "_h.*")


def hit_extent(hits: DataFrame, key: str = "sbjct") -> DataFrame:
    """A25."""
    return hits.groupBy(key).agg(F.min("qstart").alias("qstart"), F.max("qend").alias("qend"))


def drop_target(hits: DataFrame, prefix: str, col: str = "sbjct") -> DataFrame:
    """without what begins like the target."""
    return hits.filter(~F.col(col).cast("string").startswith(prefix))


def top_n(df: DataFrame, n: int, order: list, keys: list[str] | None = None) -> DataFrame:
    """The first n rows, of each group if there are keys."""
    if not keys:
        return df.orderBy(*order).limit(n)
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter(F.col("_r") <= n).drop("_r")


def sort_subjects(hits: DataFrame) -> DataFrame:
    """(…, place): subjects by their largest E-value, largest first, their hits by E-value."""
    most = F.max("evalue").over(Window.partitionBy("sbjct"))
    return hits.withColumn("most", most).withColumn("place", F.row_number().over(Window.partitionBy("round").orderBy(F.desc("most"), "sbjct", "evalue", "ord"))).drop("most")


def sort_pairs(pred: DataFrame) -> DataFrame:
    """T01."""
    return pred.orderBy("r1", "r2")


def sort_desc(df: DataFrame, col: str, tie: str) -> DataFrame:
    """Largest first (Z-score, file size)."""
    return df.orderBy(F.desc(col), tie)


def sample(df: DataFrame, n: int, key: str, seed: int = 0) -> DataFrame:
    """N rows in the order of a seeded hash of the key; the same rows every time."""
    return df.orderBy(F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string"))), key).limit(n)


def union_unique(key: list[str], *dfs: DataFrame) -> DataFrame:
    """The union; a key that occurs twice is an error."""
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d)
    w = Window.partitionBy(*key)
    checked = F.when(F.count("*").over(w) == 1, F.lit(True)).otherwise(F.raise_error(F.concat_ws(" ", F.lit("key occurs twice:"), *[F.col(k).cast("string") for k in key])).cast("boolean"))
    return out.withColumn("_ok", checked).filter("_ok").drop("_ok")


def assemble(header: DataFrame, body: DataFrame, footer: DataFrame) -> DataFrame:
    """(part, ord, line) of a text file, to be ordered by (part, ord)."""
    parts = [d.select(F.lit(k).alias("part"), "ord", "line") for k, d in enumerate((header, body, footer))]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


def others(df: DataFrame, name: str) -> DataFrame:
    """(q, s): each model beside every other one; the result has this size, so it is for lists of models only."""
    names = df.select(F.col(name).alias("q")).distinct()
    return names.join(names.select(F.col("q").alias("s")), F.col("q") != F.col("s"))


def prefix_match(domains: DataFrame, fastas: DataFrame) -> DataFrame:
    """(domain, name, matches): files whose name begins with the domain; more than one is for a warning.

    An equi-join: each file gives its beginnings, of the lengths that domain names have (a handful).
    """
    d = domains.withColumn("_k", F.col("domain"))
    lengths = domains.agg(F.collect_set(F.length("domain")).alias("_n"))
    f = fastas.join(F.broadcast(lengths)).withColumn("_k", F.explode(F.transform(F.filter("_n", lambda n: n <= F.length("name")), lambda n: F.substr("name", F.lit(1), n)))).drop("_n")
    rows = d.join(f, "_k")
    return rows.select("domain", "name").withColumn("matches", F.count("*").over(Window.partitionBy("domain")))
