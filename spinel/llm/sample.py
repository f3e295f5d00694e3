"""A bounded sample of labelled documents, on which a classifier may be fitted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def fold(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null ids fall in a fold of their own (null)."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, modulus: int, held: int, per_class: int, max_chars: int) -> tuple[list[str], np.ndarray]:
    """At most ``per_class`` documents of either label outside fold ``held``, chosen by a hash of the id, of up to ``max_chars`` characters.

    Ids with several labels count by the largest; of rows that repeat an id one is used; null labels and ids are left out.
    """
    lab = labels.select("doc_id", F.col(label).cast("int").alias("y")).filter(F.col("y").isNotNull() & (fold(F.col("doc_id"), modulus) != held))
    lab = lab.groupBy("doc_id").agg(F.max("y").alias("y")).withColumn("o", F.md5(F.concat(F.lit("fit"), F.col("doc_id").cast("string"))))
    texts = docs.select("doc_id", F.col("text")).filter(F.length("text").between(1, max_chars))
    picked = None
    for y in (0, 1):
        one = lab.filter(F.col("y") == y).orderBy("o", "doc_id").limit(per_class)
        picked = one if picked is None else picked.unionByName(one)
    # per_class bounds the broadcast side
    rows = texts.join(F.broadcast(picked), "doc_id").groupBy("doc_id", "y", "o").agg(F.min("text").alias("text")).orderBy("o", "doc_id").select("text", "y").collect()
    return [r["text"] for r in rows], np.array([r["y"] for r in rows], dtype=np.float64)
