"""Running sums, ranks and neighbours over sorted rows, where neither a group nor the whole table has to be one task.

Rows are cut into parts of the order, each a window of its own, and what a group's earlier parts add up to is joined back. There are two ways to cut:
by splitters of the sort key, which come from a bounded sample, for any order over groups of any size, or by stretches of an integer position. Where the
parts lie decides how even they are, never the result: a row's part is a function of its own key, so a repeated task finds the same rows in it. A part
between splitters can begin inside one group at most, so there is at most one row a part to join back, by broadcast; to stretches it goes
as a first row of each, into the same window, so that rows are dealt once and sorted once. Keys have to tell rows apart for parts to be even and the order to be total; equal keys share a part.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Rows of the sample for each part; a part's size then varies by about a tenth.
SAMPLED = 100
MOST_PARTS = 4096
#: Rows that are worth a part of their own, and positions in a stretch.
ROWS_EACH, STRETCH = 100_000, 1 << 16


@dataclass
class Parts:
    """A table with its part (``_part``) in the order of ``keys`` and then ``order``, both ascending."""

    rows: DataFrame
    keys: list[str]
    order: list[Column]
    #: Whether what came before parts is at most one row a part; None where there is one part only.
    few: bool | None = True

    @property
    def window(self):
        return Window.partitionBy(*self.keys, "_part").orderBy(*self.order)

    def before(self, totals: dict[str, Column], combine=F.sum) -> DataFrame:
        """(keys, _part, totals): for each part that begins inside a group, what the group's earlier parts add up to."""
        each = self.rows.groupBy(*self.keys, "_part").agg(*[c.alias(n) for n, c in totals.items()])
        w = Window.partitionBy(*self.keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
        earlier = each.select(*self.keys, "_part", F.count(F.lit(1)).over(w).alias("_earlier"), *[combine(n).over(w).alias(n) for n in totals])
        return earlier.filter("_earlier > 0").drop("_earlier")

    def led(self, rows: DataFrame, totals: dict[str, Column], combine=F.sum) -> DataFrame:
        """``rows`` and, marked by ``_led``, what came before each part as a row ahead of its others: its order is null, and nulls come first."""
        before = self.before(totals, combine).withColumn("_led", F.lit(True))
        return rows.unionByName(before, allowMissingColumns=True)

    def last_known(self, value: str) -> Column:
        """The last non-null value of a part."""
        return F.max_by(F.col(value), F.when(F.col(value).isNotNull(), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(self.order)])))

    def joined(self, rows: DataFrame, before: DataFrame) -> DataFrame:
        """``rows`` with what came before their part; null where a group begins in it."""
        own = {k: f"_before_key_{i}" for i, k in enumerate([*self.keys, "_part"])}
        same = F.col("_part") == F.col(own["_part"])
        for k in self.keys:
            same &= F.col(k).eqNullSafe(F.col(own[k]))
        before = before.withColumnsRenamed(own)
        # between splitters: one row for each part, of which there are MOST_PARTS at most
        return rows.join(F.broadcast(before) if self.few else before, same, "left").drop(*own.values())


def _place(key: Column, splits: Column, n: int) -> Column:
    """How many of the sorted splitters are at most ``key``: a binary search by falling powers of two."""
    steps = F.array(*[F.lit(1 << b) for b in range(max(0, n.bit_length() - 1), -1, -1)])
    fits = lambda at, step: (at + step <= n) & (F.try_element_at(splits, at + step) <= key)
    return F.aggregate(steps, F.lit(0), lambda at, step: F.when(fits(at, step), at + step).otherwise(at))


def parted(rows: DataFrame, keys: list[str], order: list[Column], parts: int | None = None) -> Parts:
    """Cuts ``rows`` into ``parts`` of about one size; if not given, as many as ``ROWS_EACH`` asks for. A count and a sample read ``rows`` before the result does."""
    spark, n = rows.sparkSession, None
    if parts is None:
        n = rows.count()
        parts = -(-n // ROWS_EACH)
    parts = min(MOST_PARTS, parts)
    fields = [F.col(k) for k in keys] + order
    key = F.struct(*[c.alias(f"k{i}") for i, c in enumerate(fields)])
    wanted, splits = SAMPLED * parts, []
    if parts > 1:
        n = rows.count() if n is None else n
        some = rows.select(key.alias("k"))
        some = some if n <= wanted else some.sample(min(1.0, 1.2 * wanted / n), seed=7)
        ordered = [r["k"] for r in some.orderBy("k").limit(2 * wanted).collect()]  # a bounded sample
        splits = [ordered[len(ordered) * p // parts] for p in range(1, parts)] if ordered else []
    if not splits:
        return Parts(rows.withColumn("_part", F.lit(0)), keys, order, None)
    kind = rows.select(key.alias("k")).schema["k"].dataType
    table = spark.createDataFrame([(splits,)], f"_splits array<{kind.simpleString()}>")
    # one row of parts - 1 keys
    placed = rows.join(F.broadcast(table)).withColumn("_part", _place(key, F.col("_splits"), len(splits)))
    return Parts(placed.drop("_splits"), keys, order)


def stretches(rows: DataFrame, keys: list[str], position: str, size: int = STRETCH) -> Parts:
    """Cuts each group at every ``size``-th value of an integer position; nothing is read before the result."""
    return Parts(rows.withColumn("_part", F.floor(F.col(position) / size)), keys, [F.col(position)], False)


def summed(p: Parts, sums: dict[str, Column], carry: tuple[str, ...] = ()) -> DataFrame:
    """Inclusive running sums over rows that are cut into parts, with the values ``carry`` as ``carried`` leaves them."""
    if p.few is False:
        rows = p.rows.withColumns({f"_own_{n}": c for n, c in sums.items()})
        totals = {f"_own_{n}": F.sum(c) for n, c in sums.items()} | {v: p.last_known(v) for v in carry}
        rows = p.led(rows, totals, lambda n: F.last(n, ignorenulls=True) if n in carry else F.sum(n))
        w = p.window.rowsBetween(Window.unboundedPreceding, 0)
        rows = rows.withColumns({n: F.sum(f"_own_{n}").over(w) for n in sums} | {v: F.last(v, ignorenulls=True).over(w) for v in carry})
        return rows.filter("_led IS NULL").drop("_part", "_led", *[f"_own_{n}" for n in sums])
    for v in carry:
        p = carried(p, v)
    inside = p.rows.withColumns({n: F.sum(c).over(p.window.rowsBetween(Window.unboundedPreceding, 0)) for n, c in sums.items()})
    if p.few is None:
        return inside.drop("_part")
    out = p.joined(inside, p.before({f"_before_{n}": F.sum(c) for n, c in sums.items()}))
    return out.withColumns({n: F.col(n) + F.coalesce(f"_before_{n}", F.lit(0)) for n in sums}).drop("_part", *[f"_before_{n}" for n in sums])


def running_sums(rows: DataFrame, keys: list[str], order: list[Column], sums: dict[str, Column], parts: int | None = None) -> DataFrame:
    """``rows`` with inclusive running sums within ``keys`` in ``order``."""
    return summed(parted(rows, keys, order, parts), sums)


def numbered(p: Parts, name: str) -> DataFrame:
    """The rows of parts with their place, from 1, within the keys."""
    if p.few is False:
        return summed(p, {name: F.lit(1).cast("long")})
    out = p.rows.withColumn(name, F.row_number().over(p.window).cast("long"))
    if p.few is None:
        return out.drop("_part")
    out = p.joined(out, p.before({"_before": F.count(F.lit(1))}))
    return out.withColumn(name, F.col(name) + F.coalesce("_before", F.lit(0))).drop("_part", "_before")


def ranks(rows: DataFrame, keys: list[str], order: list[Column], name: str = "rank", parts: int | None = None) -> DataFrame:
    """``rows`` with their place in ``order``, from 1, within ``keys``; ties take places in any order, one each."""
    return numbered(parted(rows, keys, order, parts), name)


def carried(p: Parts, value: str) -> Parts:
    """The parts with ``value`` replaced by its last non-null one up to each row; the order has to be total."""
    rows = p.led(p.rows, {value: p.last_known(value)}, lambda n: F.last(n, ignorenulls=True)) if p.few is False else p.rows
    out = rows.withColumn(value, F.last(value, ignorenulls=True).over(p.window.rowsBetween(Window.unboundedPreceding, 0)))
    if p.few is False:
        out = out.filter("_led IS NULL").drop("_led")
    elif p.few:
        out = p.joined(out, p.before({"_carried": p.last_known(value)}, lambda n: F.last(n, ignorenulls=True)))
        out = out.withColumn(value, F.coalesce(value, "_carried")).drop("_carried")
    return Parts(out, p.keys, p.order, p.few)


def previous(p: Parts, value: str, name: str) -> Parts:
    """The parts with the ``value`` of the row before, null for a group's first; the order has to be total."""
    last = F.max_by(F.struct(F.col(value).alias("v")), F.struct(*[c.alias(f"o{i}") for i, c in enumerate(p.order)]))
    rows = p.rows.withColumn("_last", F.struct(F.col(value).alias("v")))
    rows = p.led(rows, {"_last": last}, lambda n: F.last(n, ignorenulls=True)) if p.few is False else rows
    mine = rows.withColumn(name, F.lag("_last").over(p.window)).drop("_last")
    if p.few is False:
        mine = mine.filter("_led IS NULL").drop("_led")
    elif p.few:
        mine = p.joined(mine, p.before({"_last": last}, lambda n: F.last(n, ignorenulls=True)))
        mine = mine.withColumn(name, F.coalesce(name, "_last")).drop("_last")
    return Parts(mine.withColumn(name, F.col(name)["v"]), p.keys, p.order, p.few)
