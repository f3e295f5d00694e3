"""Removal of repeated byte strings by a sparse suffix array, built with a common-prefix-aware distributed merge sort.

A byte goes if some string of ``LENGTH`` bytes over it also starts in a document with a smaller id. Any two equal strings of that
length choose the same position inside them, the one with the least hash of its next ``GRAM`` bytes, so only suffixes at such positions
(about one in eighteen) need to be compared.

1. Documents are dealt into chunks of a few MB. Each chunk sends, for each gram it chose, its hash, smallest and largest document and
   count, as sorted delta-coded runs by hash range. A range says which grams lie in more than one document, and which are hot.
2. Each chunk sorts its suffixes at shared grams (``LENGTH`` bytes from the position, then the bytes before it, backwards). Suffixes
   with the same bytes are one item with its smallest and largest document. Items go out as front-coded runs: common prefix with the
   one before, and the rest.
3. Runs are combined by a loser tree that keeps, for each loser, its common prefix with the winner it lost to; two heads are compared
   only where these are equal, and only behind them. The order and the common prefixes show which strings around a position are
   equal. Each run hears, per item, the smallest document that repeats it. No pairs are formed.
4. Chunks apply these answers to the members of their items, and the covered bytes are cut out.

Skew: a passage that a third of all documents hold costs a range or a merge one row for each chunk, not one for each document. A gram
with more than ``HOT`` occurrences may still stand in many different surroundings; its strings are then dealt by ``LENGTH - NARROW``
of their bytes instead of ``GRAM``: each position is entered ``FAMILIES`` times, every ``NARROW + 1`` bytes further to the left, and each
entry stands for the strings that start up to ``NARROW`` bytes before it.

The text is shuffled once, for all steps; the plan is one lazy job, so lost executors repeat only their part. A task holds a chunk of
text, or a range of grams, or a part of all suffixes; ``CHUNK``, ``GRAMS_EACH`` and ``SUFFIXES_EACH`` bound these and may grow with
the executors.

Defined cases: null text is empty; texts shorter than ``LENGTH`` keep everything; a null id counts as larger than any other
(as the largest long, which no id may be); rows that share an id never remove from one another, and repeated rows give repeated
results; very long texts are one document of their chunk, whole; an empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .staging import staged

LENGTH, GRAM = 50, 16
SPAN = LENGTH - GRAM  # offsets at which a string may hold a chosen gram
#: Offsets that one entry of a hot gram stands for, less one, and entries of such a position.
NARROW = 6
FAMILIES = -(-(SPAN + 1) // (NARROW + 1))
#: Row of a suffix: bytes from the position, bytes before it backwards, then how many there are of both and the offsets it stands for.
BEFORE, AFTER, REACH = LENGTH + SPAN, LENGTH + SPAN + 1, LENGTH + SPAN + 2
WIDTH = 8 * -(-(REACH + 1) // 8)
#: Chosen grams and suffixes a task combines, and bytes of text in a chunk, on average; occurrences beyond which a gram is hot.
GRAMS_EACH, SUFFIXES_EACH, CHUNK, HOT = 400_000, 150_000, 4 << 20, 20_000
#: Equal rows that a chunk may hold, and that one task writes out again.
REPEATED = 1000
NO_ID = np.iinfo(np.int64).max
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _sliding(x: np.ndarray, w: int, op: np.ufunc) -> np.ndarray:
    """op over x[i : i + w] for each i, by windows of doubled width."""
    out, k = x, 1
    while 2 * k <= w:
        out, k = op(out[:-k], out[k:]), 2 * k
    return op(out[: len(out) - (w - k)], out[w - k :]) if k < w else out


def chosen(raw: bytes, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and gram hashes chosen in documents that lie one after another and end at ``bounds``."""
    n, w = len(raw), SPAN + 1
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    eight = np.ndarray((n - 7,), dtype="<u8", buffer=raw, strides=(1,))
    h = _mix(eight[: n - GRAM + 1] * _A ^ _mix(eight[GRAM - 8 :][: n - GRAM + 1] + _B)) | np.uint64(1)
    least = _sliding(h, w, np.minimum)  # by string start; n - LENGTH + 1 of them
    whole = np.ones(len(least), dtype=bool)
    for e in bounds[:-1].tolist():
        whole[max(0, e - LENGTH + 1) : e] = False
    least[~whole] = 0
    reach = np.concatenate([np.zeros(SPAN, np.uint64), least, np.zeros(SPAN, np.uint64)])
    at = np.flatnonzero(_sliding(reach, w, np.maximum)[: len(h)] == h)
    return at, h[at]


def stretches(x: np.ndarray) -> list[tuple[int, int]]:
    """(first, end) of the stretches of equal values."""
    if not len(x):
        return []
    first = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])).tolist()
    return list(zip(first, [*first[1:], len(x)], strict=True))


def pack(*columns: np.ndarray) -> bytes:
    """Columns of equal length, byte plane by byte plane, compressed."""
    n = len(columns[0])
    body = b"".join(np.ascontiguousarray(c).view(np.uint8).reshape(n, -1).T.tobytes() for c in columns)
    return zstandard.ZstdCompressor(level=1).compress(n.to_bytes(8, "little") + body)


def unpack(blob: bytes, *dtypes: str) -> list[np.ndarray]:
    body = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int.from_bytes(body[:8], "little"), 8, []
    for d in dtypes:
        size = np.dtype(d).itemsize
        planes = np.frombuffer(body, np.uint8, n * size, at).reshape(size, n)
        out.append(np.ascontiguousarray(planes.T).view(d).ravel())
        at += n * size
    return out


def front_code(rows: np.ndarray) -> tuple[np.ndarray, bytes]:
    """Common prefix of each sorted row with the one before, and all the bytes behind these prefixes."""
    if len(rows) == 0:
        return np.zeros(0, np.uint8), b""
    differ = rows[1:] != rows[:-1]
    lcp = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), rows.shape[1])]).astype(np.uint8)
    return lcp, rows[np.arange(rows.shape[1])[None, :] >= lcp[:, None]].tobytes()


def front_decode(lcp: np.ndarray, rest: np.ndarray, width: int) -> np.ndarray:
    rows = np.zeros((len(lcp), width), dtype=np.uint8)
    own = np.arange(width)[None, :] >= lcp[:, None]
    rows[own] = rest
    # a byte inside the common prefix is that of the last row that brought its own
    source = np.maximum.accumulate(np.where(own, np.arange(len(lcp))[:, None], 0), axis=0)
    return rows[source, np.arange(width)[None, :]]


def slices(whole: bytes, width: int) -> Iterator[bytes]:
    return (whole[k : k + width] for k in range(0, len(whole), width))


def merge_runs(runs: list[tuple[Iterable[bytes], Iterable[int]]]) -> tuple[list[int], list[int]]:
    """The order in which items of sorted runs come (run numbers) and each item's common prefix with the one before, in bytes.

    A run is its items, byte strings of one length, and their common prefixes with the item before in the run; one item of each run is
    held at a time.
    """
    k = 1
    while k < len(runs):
        k *= 2
    words, prefixes = ([iter(r[c]) for r in runs] + [iter(())] * (k - len(runs)) for c in (0, 1))
    head = [next(w, None) for w in words]
    for p in prefixes:
        next(p, None)
    full = max((len(h) for h in head if h is not None), default=0)
    loser, common = [0] * k, [0] * k

    def play(a: int, la: int, b: int, lb: int) -> tuple[int, int, int, int]:
        """Winner and loser of two heads, with their common prefixes with the last winner and with each other."""
        x, y = head[a], head[b]
        if x is None:
            return b, lb, a, -1
        if y is None:
            return a, la, b, -1
        i = la
        while i < full and x[i : i + 8] == y[i : i + 8]:
            i += 8
        if i >= full:
            return a, la, b, full
        p, q = x[i : i + 8], y[i : i + 8]
        same = i + len(p) - (((int.from_bytes(p) ^ int.from_bytes(q)).bit_length() + 7) >> 3)
        return (a, la, b, same) if p < q else (b, la, a, same)

    winners = [(r, 0) for r in range(k)]
    level = k
    while level > 1:
        nxt = []
        for j in range(0, level, 2):
            w, lw, lo, ll = play(*winners[j], *winners[j + 1])
            node = (level + j) // 2
            loser[node], common[node] = lo, ll
            nxt.append((w, lw))
        winners, level = nxt, level // 2
    w, lw = winners[0]
    order: list[int] = []
    lcps: list[int] = []
    while head[w] is not None:
        order.append(w)
        lcps.append(lw)
        head[w] = next(words[w], None)
        lw = next(prefixes[w], -1)  # -1: the run has ended
        node = (k + w) >> 1
        while node:
            ll = common[node]
            if ll > lw:
                w, loser[node] = loser[node], w
                lw, common[node] = ll, lw
            elif ll == lw and ll >= 0:
                w, lw, loser[node], common[node] = play(w, lw, loser[node], ll)
            node >>= 1
    return order, lcps


def smaller(rows: np.ndarray, lcp: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For items in order, with their common prefixes and their smallest and largest document: (item, first offset, last offset,
    smallest document that holds the strings at these offsets), where that is smaller than the item's largest."""
    n = len(rows)
    before, after, reach = rows[:, BEFORE], rows[:, AFTER], rows[:, REACH]
    # the order of what lies before the positions, and common prefixes there
    back = np.ascontiguousarray(rows[:, LENGTH:BEFORE])
    by_back = np.argsort(back.view(f"S{SPAN}").ravel(), kind="stable")
    back = back[by_back]
    differ = back[1:] != back[:-1]
    back_lcp = np.concatenate([[0], np.where(differ.any(1), differ.argmax(1), SPAN)])
    del back, differ
    kind = np.empty(n, dtype=np.int64)
    on, value, since = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int64)
    found: list[tuple[np.ndarray, ...]] = []
    for o in range(SPAN + 2):
        hit, least = np.zeros(n, dtype=bool), np.zeros(n, dtype=np.int64)
        own = np.zeros(0, dtype=np.int64)
        if o <= SPAN:
            block = np.cumsum(lcp < LENGTH - o)
            own = np.flatnonzero((before >= o) & (after >= LENGTH - o) & (reach >= o) & ((np.bincount(block)[block] > 1) | (high > low)))
        if len(own):
            kind[by_back] = np.cumsum(back_lcp < o)
            key = block[own] * np.int64(n + 1) + kind[own]
            order = np.argsort(key, kind="stable")
            key, own = key[order], own[order]
            first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
            group_least = np.repeat(np.minimum.reduceat(low[own], first), np.diff(np.append(first, len(own))))
            gone = high[own] > group_least
            hit[own[gone]], least[own[gone]] = True, group_least[gone]
        end = np.flatnonzero(on & (~hit | (least != value)))
        found.append((end, since[end], np.full(len(end), o - 1), value[end]))
        since[hit & (~on | (least != value))] = o
        on, value = hit, least
    return tuple(np.concatenate([f[k] for f in found]) for k in range(4))


class Chunk:
    """The documents of one chunk, by id and text, and what lies in them."""

    def __init__(self, pdf: pd.DataFrame):
        pdf = pdf.sort_values(["id", "raw"], kind="stable")
        self.raws, self.ids, self.times = list(pdf["raw"]), pdf["id"].to_numpy(dtype=np.int64), pdf.get("times", pd.Series(1, pdf.index)).to_numpy()
        self.chunk = int(pdf["chunk"].iat[0])

    def choose(self) -> Chunk:
        """Sets grams (the distinct ones in order), first, count, and owner and place of their occurrences."""
        hs, owners, places = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for a, b in self.groups():
            ends = np.cumsum([len(r) for r in self.raws[a:b]])
            at, h = chosen(b"".join(self.raws[a:b]), ends)
            d = np.searchsorted(ends, at, side="right")
            hs.append(_mix(h) >> np.uint64(16))  # chosen hashes are small ones; mixed, they fill all ranges alike
            owners.append(d + a)
            places.append(at - np.concatenate([[0], ends[:-1]])[d])
        h, owner, place = np.concatenate(hs), np.concatenate(owners), np.concatenate(places)
        order = np.argsort(h, kind="stable")
        h, self.owner, self.place = h[order], owner[order], place[order]
        self.first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]])) if len(h) else np.zeros(0, np.int64)
        self.grams, self.count = h[self.first], np.diff(np.append(self.first, len(h)))
        return self

    def groups(self, most: int = 1 << 15) -> Iterator[tuple[int, int]]:
        """Ranges of documents of about ``most`` bytes."""
        a = size = 0
        for k, raw in enumerate(self.raws):
            if size and size + len(raw) > most:
                yield a, k
                a, size = k, 0
            size += len(raw)
        if a < len(self.raws):
            yield a, len(self.raws)

    def runs(self, ranges: int) -> list[tuple[int, int, bytes]]:
        """(range, chunk, run): grams in order with their smallest and largest document and count."""
        if not len(self.first):
            return []
        ids = self.ids[self.owner]
        low, high = np.minimum.reduceat(ids, self.first), np.maximum.reduceat(ids, self.first)
        cut = np.searchsorted(self.grams, np.array([-(-(r << 48) // ranges) for r in range(1, ranges)], dtype=np.uint64))
        ends = zip([0, *cut], [*cut, len(self.grams)], strict=True)
        return [(r, self.chunk, pack(np.diff(self.grams[a:b], prepend=np.uint64(0)), low[a:b], high[a:b] - low[a:b], self.count[a:b].astype(np.uint32))) for r, (a, b) in enumerate(ends) if b > a]

    def items(self, flags: list[bytes], parts: int) -> None:
        """Sets rows (the distinct ones in order, by part), part, start (of each item's members), ordinal and at (members)."""
        flag = np.repeat(np.concatenate([unpack(f, "u1")[0] for f in flags]), self.count)
        own = np.flatnonzero(flag)
        own = own[np.lexsort((self.place[own], self.owner[own]))]
        owner, place, hot = self.owner[own], self.place[own], flag[own] > 1
        wide = np.flatnonzero(hot)
        step = np.tile(np.arange(FAMILIES) * (NARROW + 1), len(wide))
        wide = np.repeat(wide, FAMILIES)
        owner, place, hot = np.concatenate([owner[~hot], owner[wide]]), np.concatenate([place[~hot], place[wide] - step]), np.concatenate([hot[~hot], np.ones(len(wide), bool)])
        inside = place >= 0
        owner, place, hot = owner[inside], place[inside], hot[inside]
        order = np.argsort(owner, kind="stable")
        owner, place, hot = owner[order], place[order], hot[order]
        rows = np.zeros((len(owner), WIDTH), dtype=np.uint8)
        lens = np.array([len(r) for r in self.raws], dtype=np.int64)
        gap = bytes(LENGTH)
        for a, b in self.groups():
            x, y = np.searchsorted(owner, [a, b])
            if x == y:
                continue
            flat = np.frombuffer(gap + gap.join(self.raws[a:b]) + gap, dtype=np.uint8)
            base = np.cumsum(lens[a:b] + LENGTH) - lens[a:b]
            at = base[owner[x:y] - a] + place[x:y]
            rows[x:y, :LENGTH] = np.lib.stride_tricks.sliding_window_view(flat, LENGTH)[at]
            rows[x:y, LENGTH:BEFORE] = np.lib.stride_tricks.sliding_window_view(flat, SPAN)[at - SPAN][:, ::-1]
        reach = np.where(hot, NARROW, SPAN)
        rows[:, LENGTH:BEFORE][np.arange(SPAN)[None, :] >= reach[:, None]] = 0
        rows[:, BEFORE], rows[:, AFTER], rows[:, REACH] = np.minimum(place, reach), np.minimum(lens[owner] - place, LENGTH), reach
        some = rows[:, AFTER] >= LENGTH - reach  # else no whole string
        rows, owner, place, hot = rows[some], owner[some], place[some], hot[some]
        words = rows.view(">u8")
        h = _mix(words[:, 0].astype(np.uint64) * _A ^ _mix(words[:, 1].astype(np.uint64) + _B))
        for k in range(2, (LENGTH - NARROW) // 8):
            h[hot] = _mix(h[hot] * _A ^ words[hot, k].astype(np.uint64))
        part = (h % np.uint64(parts)).astype(np.int64)
        order = np.argsort(rows.view(f"S{WIDTH}").ravel(), kind="stable")
        order = order[np.argsort(part[order], kind="stable")]
        rows, part, self.ordinal, self.at = rows[order], part[order], owner[order], place[order]
        fresh = np.flatnonzero(np.concatenate([[True], (rows[1:] != rows[:-1]).any(1)])) if len(rows) else np.zeros(0, np.int64)
        self.rows, self.part, self.start = rows[fresh], part[fresh], np.append(fresh, len(rows))


def _without_repeats(docs: DataFrame) -> tuple[DataFrame, bool]:
    """``docs`` with ``times`` (1), and whether there are rows that repeat id and text more than ``REPEATED`` times: these are one row with their
    number, counted before anything is shuffled, as all of them would be in one chunk."""
    rows = docs.select("doc_id", "text")
    th = F.xxhash64("text", F.lit(7))
    many = rows.groupBy("doc_id", th.alias("th")).agg(F.count("*").alias("n")).filter(F.col("n") > REPEATED).select(F.col("doc_id").alias("i"), "th")
    many = staged(many, "suffix-repeats")
    if many.isEmpty():
        return rows.withColumn("times", F.lit(1).cast("long")), False
    keyed = rows.withColumn("th", th).join(many.withColumnRenamed("th", "t2").withColumn("m", F.lit(True)), F.col("doc_id").eqNullSafe(F.col("i")) & (F.col("th") == F.col("t2")), "left")
    some = keyed.filter("m").groupBy("doc_id", "text").agg(F.count("*").alias("times"))
    return keyed.filter("m IS NULL").select("doc_id", "text", F.lit(1).cast("long").alias("times")).unionByName(some), True


def remove_repeats(docs: DataFrame, hot: int = HOT) -> DataFrame:
    """One row per document: doc_id, kept (the bytes left), n_bytes, n_removed, n_spans, kept_sha256."""
    ship(docs.sparkSession)
    id_type = docs.schema["doc_id"].dataType.simpleString()
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    ranges, parts, chunks = (max(1, -(-size // each)) for each in (18 * GRAMS_EACH, 18 * SUFFIXES_EACH, CHUNK))
    own_id = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    chunk = F.pmod(F.xxhash64("doc_id", "text"), F.lit(chunks)).cast("int")
    rows, repeated = _without_repeats(docs)
    keyed = rows.select(own_id.alias("id"), F.coalesce(F.col("text").cast("binary"), F.lit(b"")).alias("raw"), chunk.alias("chunk"), "times")

    def grams(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame(Chunk(pdf).choose().runs(ranges), columns=["range", "chunk", "run"])

    runs = keyed.groupBy("chunk").applyInPandas(grams, "range int, chunk int, run binary")

    def judge(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [unpack(x, "u8", "i8", "i8", "u4") for x in pdf["run"]]
        h = np.concatenate([np.cumsum(x[0], dtype=np.uint64) for x in got])
        low, high, count = (np.concatenate([x[k] for x in got]) for k in (1, 2, 3))
        ends = np.cumsum([len(x[0]) for x in got])
        del got
        high += low
        order = np.argsort(h, kind="stable")
        first = np.flatnonzero(np.concatenate([[True], np.diff(h[order]) != 0]))
        shared = np.minimum.reduceat(low[order], first) != np.maximum.reduceat(high[order], first)
        flag = (shared + (shared & (np.add.reduceat(count[order].astype(np.int64), first) > hot))).astype(np.uint8)
        by_run = np.empty(len(h), dtype=np.uint8)
        by_run[order] = np.repeat(flag, np.diff(np.append(first, len(h))))
        return pd.DataFrame({"chunk": pdf["chunk"], "place": pdf["range"], "found": [pack(by_run[a:b]) for a, b in zip([0, *ends[:-1]], ends, strict=True)]})

    flags = runs.groupBy("range").applyInPandas(judge, "chunk int, place int, found binary")

    def suffixes(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(pdf) and len(found):
            c = Chunk(pdf).choose()
            c.items(list(found.sort_values("place")["found"]), parts)
            ids = c.ids[c.ordinal]
            if len(ids):
                low, high = np.minimum.reduceat(ids, c.start[:-1]), np.maximum.reduceat(ids, c.start[:-1])
                for a, b in stretches(c.part):
                    lcp, rest = front_code(c.rows[a:b])
                    run = zstandard.ZstdCompressor(level=1).compress(len(lcp).to_bytes(8, "little") + lcp.tobytes() + rest)
                    out.append((int(c.part[a]), c.chunk, run, pack(low[a:b], high[a:b] - low[a:b])))
                # the chunk's note to itself: which documents and places its items stand for
                fresh = np.zeros(len(ids), dtype=np.uint8)
                fresh[c.start[:-1]] = 1
                parts_at = np.array([(c.part[a], a) for a, _ in stretches(c.part)], dtype=np.int64)
                out.append((-1 - c.chunk, c.chunk, pack(parts_at[:, 0], parts_at[:, 1]), pack(c.ordinal.astype(np.uint32), c.at.astype(np.uint32), fresh)))
        return pd.DataFrame(out, columns=["part", "chunk", "run", "members"])

    sorted_runs = keyed.groupBy("chunk").cogroup(flags.groupBy("chunk")).applyInPandas(suffixes, "part int, chunk int, run binary, members binary")

    def combine(pdf: pd.DataFrame) -> pd.DataFrame:
        part = int(pdf["part"].iat[0])
        if part < 0:
            return pd.DataFrame({"chunk": pdf["chunk"], "part": part, "found": pdf["run"], "members": pdf["members"]})
        pdf = pdf.sort_values("chunk")
        blobs, runs, lows, highs = [], [], [], []
        for run, members in zip(pdf["run"], pdf["members"], strict=True):
            body = zstandard.ZstdDecompressor().decompress(run)
            n = int.from_bytes(body[:8], "little")
            lcp = body[8 : 8 + n]
            whole = front_decode(np.frombuffer(lcp, np.uint8), np.frombuffer(body, np.uint8, offset=8 + n), WIDTH).tobytes()
            blobs.append(whole)
            runs.append((slices(whole, WIDTH), lcp))
            low, high = unpack(members, "i8", "i8")
            lows.append(low)
            highs.append(low + high)
        order, lcps = merge_runs(runs)
        run_of, lcp = np.array(order), np.array(lcps)
        # the j-th time a run comes up it gives its j-th item
        by_run = np.argsort(run_of, kind="stable")
        rank = np.empty(len(run_of), dtype=np.int64)
        rank[by_run] = np.arange(len(run_of))
        rows = np.frombuffer(b"".join(blobs), dtype=np.uint8).reshape(-1, WIDTH)[rank]
        del blobs, runs
        item, since, until, least = smaller(rows, lcp, np.concatenate(lows)[rank], np.concatenate(highs)[rank])
        source = run_of[item]
        item = rank[item] - np.concatenate([[0], np.cumsum([len(x) for x in lows])])[source]
        by = np.lexsort((since, item, source))
        source, item, since, until, least = source[by], item[by], since[by], until[by], least[by]
        chunk = pdf["chunk"].to_numpy()
        out = [(int(chunk[source[a]]), part, pack(item[a:b].astype(np.uint32), since[a:b].astype(np.uint8), until[a:b].astype(np.uint8), least[a:b]), b"") for a, b in stretches(source)]
        return pd.DataFrame(out, columns=["chunk", "part", "found", "members"])

    answers = sorted_runs.groupBy("part").applyInPandas(combine, "chunk int, part int, found binary, members binary")

    def cut(pdf: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
        columns = ["id", "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256", "times"]
        if not len(pdf):
            return pd.DataFrame([], columns=columns)
        c = Chunk(pdf)
        owner = start = end = np.zeros(0, np.int64)
        heard = found[found["part"] >= 0].sort_values("part")
        if len(heard):
            note = found[found["part"] < 0].iloc[0]
            parts_at = dict(zip(*(x.tolist() for x in unpack(note["found"], "i8", "i8")), strict=True))
            ordinal, at, fresh = unpack(note["members"], "u4", "u4", "u1")
            ordinal, at, begin = ordinal.astype(np.int64), at.astype(np.int64), np.append(np.flatnonzero(fresh), len(fresh))
            got = [unpack(x, "u4", "u1", "u1", "i8") for x in heard["found"]]
            item = np.concatenate([parts_at[p] + x[0].astype(np.int64) for p, x in zip(heard["part"].tolist(), got, strict=True)])
            since, until, least = (np.concatenate([x[k] for x in got]).astype(np.int64) for k in (1, 2, 3))
            n = begin[item + 1] - begin[item]
            member = np.repeat(begin[item] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            of = np.repeat(np.arange(len(item)), n)
            gone = c.ids[ordinal[member]] > least[of]
            member, of = member[gone], of[gone]
            owner, start, end = ordinal[member], at[member] - until[of], at[member] - since[of] + LENGTH
            order = np.argsort(owner, kind="stable")
            owner, start, end = owner[order], start[order], end[order]
        out = []
        bounds = np.searchsorted(owner, np.arange(len(c.raws) + 1)).tolist()
        for k, raw in enumerate(c.raws):
            a, b = bounds[k], bounds[k + 1]
            kept, removed, n = raw, 0, 0
            if b > a:
                step = np.zeros(len(raw) + 1, dtype=np.int64)
                np.add.at(step, start[a:b], 1)
                np.add.at(step, end[a:b], -1)
                gone = np.cumsum(step[:-1]) > 0
                removed = int(gone.sum())
                n = int(gone[0]) + int(np.count_nonzero(gone[1:] & ~gone[:-1]))
                kept = np.frombuffer(raw, dtype=np.uint8)[~gone].tobytes()
            out.append((kept, len(raw), removed, n, hashlib.sha256(kept).hexdigest()))
        done = pd.DataFrame(out, columns=columns[1:-1]).assign(times=c.times)
        done.insert(0, "id", c.ids)
        return done

    done = keyed.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInPandas(cut, "id long, kept binary, n_bytes long, n_removed long, n_spans long, kept_sha256 string, times long")
    if repeated:
        blocks = F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("times") - 1) / REPEATED))).alias("b")
        done = done.select("*", blocks).repartition("id", "b").select("*", F.explode(F.sequence(F.col("b") * REPEATED + 1, F.least((F.col("b") + 1) * REPEATED, F.col("times")))).alias("copy"))
    doc_id = F.when(F.col("id") != NO_ID, F.col("id")).cast(id_type).alias("doc_id")
    return done.select(doc_id, "kept", "n_bytes", "n_removed", "n_spans", "kept_sha256")
