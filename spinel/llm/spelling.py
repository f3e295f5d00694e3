"""Spelling variants: words one edit apart, found in a forward and a reversed sorted dictionary.

Of two words that differ by one inserted, deleted or replaced code point, with m the longer one's length, either the first m / 2 code
points are intact or the last m - m / 2 are. So each word is entered four times, with m as its own length and one more: in the forward
dictionary under its first half and in the reversed one under its last half. Words under one key are a block. A block says that the edit
is at one of the open places, ``a`` to ``m - b``; one with more than ``LARGEST`` words is subdivided by halving these places, again by what
comes before or behind them, until it is small enough. With one open place a block has at most one word for each letter and one more, so
this ends, after as many rounds as the longest word can be halved.

The blocks are then dealt by range of key, sorted, and scanned: a task halves what is in a block further and compares the words of the last
blocks. The first differing place of a pair lies among the open places of one block only, so each pair is found once, and no pair of words
without a common half is formed. The form of a word needs the count of its near words and the largest of them, a sum and a
minimum that are combined before the shuffle; roots are found by pointer doubling, as counts double along every chain.

Defined cases: null and empty texts have no words; rows that repeat count as often as they stand; no run of a document without an id is
altered; texts of any length are read whole; an empty table gives no rows; columns other than id and text are ignored.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .staging import discard, staged

RUN = "[A-Za-zÀ-ÿ]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SHORTEST, RAREST, EVERY = 5, 3, 97
#: Words of a block that one task halves in memory, and words that are compared without halving.
LARGEST, FEW = 256, 8


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = EVERY) -> DataFrame:
    """(word, n): words of at least ``SHORTEST`` code points with at least ``RAREST`` occurrences.

    If ``every`` divides the crc32 of ``<id>:<run>``, the run's code point at that crc32 modulo the length is left out first.
    """
    runs = docs.select(F.col(id_col).cast("string").alias("id"), F.explode(F.regexp_extract_all(F.translate(text_col, UPPER, LOWER), F.lit(RUN), F.lit(0))).alias("run"))
    word = F.col("run")
    if every:
        h = F.crc32(F.concat("id", F.lit(":"), "run").cast("binary"))
        at = (h % F.length("run")).cast("int")
        word = F.when(h % every == 0, F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.length("run")))).otherwise(word)
    return runs.select(word.alias("word")).filter(F.length("word") >= SHORTEST).groupBy("word").agg(F.count("*").alias("n")).filter(F.col("n") >= RAREST)


def _key():
    """What words of a block share: length of the longer word, the open places, and the text before and behind them."""
    before, behind = F.substring("word", F.lit(1), F.col("a")), F.when(F.col("b") > 0, F.substring("word", F.length("word") - F.col("b") + 1, F.col("b"))).otherwise("")
    return F.concat_ws(":", "m", "a", "b", before, behind).alias("key")


def _halved(rows: DataFrame) -> DataFrame:
    """Each entry (m, a, b, word, n) under the two halves of its open places."""
    middle = F.col("a") + F.floor((F.col("m") - F.col("b") - F.col("a")) / 2).cast("int")
    halves = F.explode(F.array(F.struct(middle.alias("a"), F.col("b").alias("b")), F.struct(F.col("a").alias("a"), (F.col("m") - middle).alias("b")))).alias("h")
    return rows.select("m", "word", "n", halves).select("m", "h.a", "h.b", "word", "n").select("*", _key())


def blocks(words: DataFrame) -> DataFrame:
    """(m, a, b, word, n, key) of blocks with at most ``LARGEST`` words."""
    longer = F.explode(F.array(F.length("word"), F.length("word") + 1)).alias("m")
    todo, small = _halved(words.select("word", "n", longer).withColumns({"a": F.lit(0), "b": F.lit(0)})), None
    while True:
        large = staged(todo.groupBy("key").agg(F.count("*").alias("size")).filter(F.col("size") > LARGEST).select("key", F.lit(True).alias("large")), "spelling-large")
        if large.isEmpty():
            discard(large)
            return todo if small is None else small.unionByName(todo)
        # a large block's entries are many rows of one key on the left side, which skew handling may split
        marked = staged(todo.join(large, "key", "left"), "spelling-blocks")
        discard(large)
        done = marked.filter(F.col("large").isNull()).drop("large")
        small = done if small is None else small.unionByName(done)
        todo = _halved(marked.filter("large"))


def one_edit(u: str, v: str, a: int, end: int) -> bool:
    """Whether words that share their first ``a`` code points differ by one edit, u not being longer, whose place lies before ``end``."""
    i, n = a, len(u)
    while i < n and u[i] == v[i]:
        i += 1
    return i < end and (u[i + 1 :] == v[i + 1 :] if n == len(v) else u[i:] == v[i + 1 :])


def near_in_block(words: list[tuple[str, int]], m: int, a: int, b: int) -> Iterator[tuple[str, int, str, int]]:
    """(word, n, other, n) for the pairs of a block whose edit lies among its open places."""
    todo = [(words, a, b)]
    while todo:
        own, a, b = todo.pop()
        if len(own) <= FEW or m - a - b == 1:
            own.sort(key=lambda w: len(w[0]))
            for k, (v, nv) in enumerate(own):
                if len(v) == m:
                    for u, nu in own[:k]:
                        if one_edit(u, v, a, m - b):
                            yield u, nu, v, nv
            continue
        middle = a + (m - b - a) // 2
        for first, last in ((middle, b), (a, m - middle)):
            parts: dict[tuple[str, str], list[tuple[str, int]]] = defaultdict(list)
            for w in own:
                parts[w[0][:first], w[0][len(w[0]) - last :]].append(w)
            todo += [(p, first, last) for p in parts.values() if len(p) > 1]


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, other, other_n): for every word those that are one edit away."""
    ship(words.sparkSession)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, shape, own = None, (0, 0, 0), []
        found: list[tuple[str, str, int]] = []

        def close() -> None:
            if len(own) > 1:
                for u, nu, v, nv in near_in_block(own, *shape):
                    found.extend(((u, v, nv), (v, u, nu)))

        def out() -> pd.DataFrame:
            pdf = pd.DataFrame(found, columns=["word", "other", "other_n"])
            found.clear()
            return pdf

        for pdf in batches:
            for k, m, a, b, w, n in zip(pdf["key"], pdf["m"], pdf["a"], pdf["b"], pdf["word"], pdf["n"], strict=True):
                if k != key:
                    close()
                    key, shape, own = k, (int(m), int(a), int(b)), []
                    if len(found) >= 1 << 16:
                        yield out()
                own.append((w, n))
        close()
        yield out()

    # a plain sort key: blocks are never cut between tasks, and hold at most LARGEST words
    dealt = blocks(words).repartitionByRange("key").sortWithinPartitions("key", "word")
    return dealt.mapInPandas(scan, "word string, other string, other_n long")


def _roots(links: DataFrame) -> DataFrame:
    """(word, root) for words with a form, from (word, form)."""
    at = staged(links.select("word", F.col("form").alias("root"), F.lit(True).alias("open")), "spelling-roots")
    while not at.filter("open").isEmpty():
        further = at.select(F.col("word").alias("root"), F.col("root").alias("next"))
        moved = at.filter("open").join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("open"))
        before, at = at, staged(at.filter("NOT open").unionByName(moved), "spelling-roots")
        discard(before)
    return at.select("word", "root")


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, form, root, n, n_near, form_n), one row a word."""
    words = staged(vocabulary(docs, id_col, text_col), "spelling-words")
    best = near_pairs(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("o"), "other")).alias("best"))
    known = words.join(best, "word", "left")
    has = -F.col("best.o") >= 2 * F.col("n")
    known = staged(known.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(has, F.col("best.other")).alias("form"), F.when(has, -F.col("best.o")).alias("form_n")), "spelling-forms")
    roots = _roots(known.filter("form IS NOT NULL").select("word", "form"))
    return known.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
