"""Line deduplication by overlapping windows of three consecutive lines.

Lines are split at newlines and compared without white space at their ends; lines without a word take no part and stay. Each
window of three such lines that follow one another is hashed (128 bits). Of all windows with one hash in the whole corpus, the
first (smallest doc_id, null last, then position) stays; the lines covered by any later one are removed, overlaps merged.

Defined cases: null and short texts (fewer than three lines with a word) stay as they are; rows that repeat both id and text share
one position and so one verdict; extra columns pass through. The count per hash is combined before the shuffle and the join back
to the windows is a plain equi-join, so a passage that a third of all rows hold is split by the skew handling of the session.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import private

WHITE = " \t\n\x0b\f\r"
HAS_WORD = r"[^\x20\x09-\x0D]"


def dedup_lines(docs: DataFrame, window: int = 3, id_col: str = "doc_id") -> DataFrame:
    """``docs`` with the cleaned text and, beside its own columns, n_lines and n_removed (both count lines of the input)."""
    lines = F.transform(F.split(F.col("text"), "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(WHITE)).alias("l")))
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64("text").alias("th"), F.filter(lines, lambda x: x["l"].rlike(HAS_WORD)).alias("nb"))
    rows = rows.filter(F.size("nb") >= window)

    def at(j):
        parts = [F.element_at("nb", (j + k).cast("int")) for k in range(window)]
        texts = [p["l"] for p in parts]
        return F.struct(F.xxhash64(F.lit(1), *texts).alias("h1"), F.xxhash64(F.lit(2), *texts).alias("h2"), F.array(*[p["i"] for p in parts]).alias("at"))

    windows = rows.select("id", "th", F.explode(F.transform(F.sequence(F.lit(1), F.size("nb") - (window - 1)), at)).alias("w")).select("id", "th", "w.*")
    place = lambda: F.struct(F.col("id").isNull().alias("last"), "id", "th", F.element_at("at", 1).alias("pos"))
    first = windows.groupBy("h1", "h2").agg(F.min(place()).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    again = windows.join(first, ["h1", "h2"]).filter(place() > F.col("first"))
    own = private(docs.columns, "line_dedup_")
    # a set, so that rows that repeat id and text gather each line once, before the shuffle too
    drop = again.select("id", "th", F.explode("at").alias("at")).groupBy("id", "th").agg(F.collect_set("at").alias(f"{own}drop"))
    keyed = docs.withColumns({f"{own}id": F.col(id_col), f"{own}th": F.xxhash64("text")})
    drop = drop.select(F.col("id").alias(f"{own}i2"), F.col("th").alias(f"{own}t2"), f"{own}drop")
    joined = keyed.join(drop, keyed[f"{own}id"].eqNullSafe(drop[f"{own}i2"]) & (keyed[f"{own}th"] == drop[f"{own}t2"]), "left")
    split, gone = F.split(F.col("text"), "\n"), F.col(f"{own}drop")
    # array_except hashes, and the one-element array binds the lines for the inner function
    stay = F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone)
    left = F.transform(F.array(split), lambda x: F.transform(stay, lambda i: F.element_at(x, i + 1)))[0]
    text = F.when(gone.isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    added = {"n_lines": F.coalesce(F.size(split), F.lit(0)).cast("long"), "n_removed": F.coalesce(F.size(gone), F.lit(0)).cast("long")}
    return joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in docs.columns if c not in added], *[c.alias(n) for n, c in added.items()])
