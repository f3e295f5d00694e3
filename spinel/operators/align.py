"""Global alignment with affine gaps, and what builds on it. Alignments run in Arrow batches, one pair a row."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: Gap open and gap extend of the two parameter sets in use: sequences, and a sequence with a structure.
DEFAULT, STRUCTURE = (-15.0, 0.0), (-10.0, -1.0)

# The BLOSUM62 matrix, and what unknown letters, * and gap letters score.
LETTERS = "ARNDCQEGHILKMFPSTWYVBZ"
BLOSUM62 = """
 4 -1 -2 -2  0 -1 -1  0 -2 -1 -1 -1 -1 -2 -1  1  0 -3 -2  0 -2 -1
-1  5  0 -2 -3  1  0 -2  0 -3 -2  2 -1 -3 -2 -1 -1 -3 -2 -3 -1  0
-2  0  6  1 -3  0  0  0  1 -3 -3  0 -2 -3 -2  1  0 -4 -2 -3  3  0
-2 -2  1  6 -3  0  2 -1 -1 -3 -4 -1 -3 -3 -1  0 -1 -4 -3 -3  4  1
 0 -3 -3 -3  9 -3 -4 -3 -3 -1 -1 -3 -1 -2 -3 -1 -1 -2 -2 -1 -3 -3
-1  1  0  0 -3  5  2 -2  0 -3 -2  1  0 -3 -1  0 -1 -2 -1 -2  0  3
-1  0  0  2 -4  2  5 -2  0 -3 -3  1 -2 -3 -1  0 -1 -3 -2 -2  1  4
 0 -2  0 -1 -3 -2 -2  6 -2 -4 -4 -2 -3 -3 -2  0 -2 -2 -3 -3 -1 -2
-2  0  1 -1 -3  0  0 -2  8 -3 -3 -1 -2 -1 -2 -1 -2 -2  2 -3  0  0
-1 -3 -3 -3 -1 -3 -3 -4 -3  4  2 -3  1  0 -3 -2 -1 -3 -1  3 -3 -3
-1 -2 -3 -4 -1 -2 -3 -4 -3  2  4 -2  2  0 -3 -2 -1 -2 -1  1 -4 -3
-1  2  0 -1 -3  1  1 -2 -1 -3 -2  5 -1 -3 -1  0 -1 -3 -2 -2  0  1
-1 -1 -2 -3 -1  0 -2 -3 -2  1  2 -1  5  0 -2 -1 -1 -1 -1  1 -3 -1
-2 -3 -3 -3 -2 -3 -3 -3 -1  0  0 -3  0  6 -4 -2 -2  1  3 -1 -3 -3
-1 -2 -2 -1 -3 -1 -1 -2 -2 -3 -3 -1 -2 -4  7 -1 -1 -4 -3 -2 -2 -1
 1 -1  1  0 -1  0  0  0 -1 -2 -2  0 -1 -2 -1  4  1 -3 -2 -2  0  0
 0 -1  0 -1 -1 -1 -1 -2 -2 -1 -1 -1 -1 -2 -1  1  5 -2 -2  0 -1 -1
-3 -3 -4 -4 -2 -2 -3 -2 -2 -3 -2 -3 -1  1 -4 -3 -2 11  2 -3 -4 -3
-2 -2 -2 -3 -2 -1 -2 -3  2 -1 -1 -2 -1  3 -3 -2 -2  2  7 -1 -3 -2
 0 -3 -3 -3 -1 -2 -2 -3 -3  3  1 -2  1 -1 -2 -2  0 -3 -1  4 -3 -2
-2 -1  3  4 -3  0  1 -1  0 -3 -4  0 -3 -3 -2  0 -1 -4 -3 -3  4  1
-1  0  0  1 -3  3  4 -2  0 -3 -3  1 -1 -3 -1  0 -1 -3 -2 -2  1  4
"""
UNKNOWN, STAR, STAR_STAR, GAP_LETTER, GAP_GAP = 0, -4, 1, -6, 0


def _matrix() -> np.ndarray:
    """Scores by code: the letters, then any other letter, * and -."""
    n = len(LETTERS)
    m = np.full((n + 3, n + 3), float(UNKNOWN))
    m[:n, :n] = np.array(BLOSUM62.split(), dtype=float).reshape(n, n)
    m[n + 2, :] = m[:, n + 2] = GAP_LETTER
    m[n + 1, :] = m[:, n + 1] = STAR
    m[n + 1, n + 1], m[n + 2, n + 2] = STAR_STAR, GAP_GAP
    return m


SCORES = _matrix()
_CODES = {c: i for i, c in enumerate(LETTERS)} | {"*": len(LETTERS) + 1, "-": len(LETTERS) + 2}


#: Below any score that can be reached.
LOW = -1e9


def codes(seq: str) -> np.ndarray:
    return np.array([_CODES.get(c, len(LETTERS)) for c in seq.upper()], dtype=np.int64)


class _Rows:
    """Rows of the three states' scores, of which every ``step``-th is kept and the others are made again, ``step`` at a time, on the way back."""

    def __init__(self, x: np.ndarray, y: np.ndarray, gap_open: float, gap_extend: float):
        self.x, self.y, self.open, self.extend = x, y, gap_open, gap_extend
        self.step = max(1, int(np.sqrt(len(x))))
        self.steps = gap_extend * np.arange(len(y) + 1)
        row = np.full((3, len(y) + 1), LOW)
        row[0, 0] = 0
        row[1, 1:] = gap_open + self.steps[:-1]
        self.kept = [row]
        for i in range(1, len(x) + 1):
            row = self.next(row, i)
            if i % self.step == 0:
                self.kept.append(row)
        self.last, self.base, self.block = row, -1, []

    def next(self, before: np.ndarray, i: int) -> np.ndarray:
        row = np.full(before.shape, LOW)
        row[0, 1:] = before[:, :-1].max(0) + SCORES[self.x[i - 1]][self.y]
        row[2, 0] = self.open + self.extend * (i - 1)
        row[2, 1:] = np.maximum(before[0, 1:] + self.open, before[2, 1:] + self.extend)
        # s[1, j] = max(s[0, j - 1] + open, s[1, j - 1] + extend), as a running maximum
        run = np.maximum.accumulate(row[0, :-1] + self.open - self.steps[:-1]) + self.steps[:-1]
        row[1, 1:] = np.maximum(run, row[1, 0] + self.steps[1:])
        return row

    def __getitem__(self, i: int) -> np.ndarray:
        """Row i; rows are asked for from the last one backwards, and a block also holds the row before it."""
        if not self.base <= i < self.base + len(self.block):
            self.base = max(0, i - 1) // self.step * self.step
            self.block = [self.kept[self.base // self.step]]
            for at in range(self.base + 1, min(self.base + self.step, len(self.x)) + 1):
                self.block.append(self.next(self.block[-1], at))
        return self.block[i - self.base]


def global_align(a: str, b: str, gap_open: float = -15.0, gap_extend: float = 0.0) -> tuple[str, str, float]:
    """Three-state global alignment by BLOSUM62. A gap follows a match or itself, never the other gap; a gap character in either string
    scores as a letter of its own. Of equal scores the match state is preferred in the first half of both strings, behind it the
    gaps: first the one in b, then the one in a.

    Memory grows with n times the root of m: 50 MB for two strings of 10,000, where three whole matrices would take 2.4 GB.
    """
    m, n = len(a), len(b)
    # states: 0 both advance, 1 only b advances, 2 only a advances
    s = _Rows(codes(a), codes(b), gap_open, gap_extend)
    i, j = m, n
    state = max((2, 1, 0), key=lambda k: s.last[k, n])  # of equal ones the first
    score, p, q = float(s.last[state, n]), [], []
    while i or j:
        order = (0, 1, 2) if 2 * i <= m + 1 and 2 * j <= n + 1 else (2, 1, 0)
        if state == 0:
            before = s[i - 1]
            from_ = {k: before[k, j - 1] for k in order}
            p.append(a[i - 1])
            q.append(b[j - 1])
            i, j = i - 1, j - 1
        elif state == 1:
            here = s[i]
            from_ = {k: here[k, j - 1] + (gap_open if k == 0 else gap_extend) for k in order if k != 2}
            p.append("-")
            q.append(b[j - 1])
            j -= 1
        else:
            before = s[i - 1]
            from_ = {k: before[k, j] + (gap_open if k == 0 else gap_extend) for k in order if k != 1}
            p.append(a[i - 1])
            q.append("-")
            i -= 1
        if i == 0 or j == 0:
            state = 0 if i == j == 0 else 1 if i == 0 else 2
            continue
        best = max(from_.values())
        state = next(k for k, v in from_.items() if v >= best - 1e-9)
    return "".join(reversed(p)), "".join(reversed(q)), score


#: Scores that a batch of alignments holds at once; a pair with more is aligned by itself, with kept rows.
BATCH_SCORES = 1 << 21


def _batch_align(pairs: list[tuple[str, str]], gap_open: float, gap_extend: float) -> list[tuple[str, str, float]]:
    """``global_align`` of several non-empty pairs side by side: the same scores by the same sums, a row of all pairs at a time, and the same way back."""
    size, m, n = len(pairs), np.array([len(a) for a, _ in pairs]), np.array([len(b) for _, b in pairs])
    rows, width = int(m.max()), int(n.max())
    x, y = (np.full((size, w), len(LETTERS), dtype=np.int64) for w in (rows, width))
    for k, (a, b) in enumerate(pairs):
        x[k, : m[k]], y[k, : n[k]] = codes(a), codes(b)
    steps = gap_extend * np.arange(width + 1)
    s = np.full((rows + 1, 3, size, width + 1), LOW)
    s[0, 0, :, 0] = 0
    s[0, 1, :, 1:] = gap_open + steps[:-1]
    for i in range(1, rows + 1):
        before, row = s[i - 1], s[i]
        row[0, :, 1:] = before[:, :, :-1].max(0) + SCORES[x[:, i - 1, None], y]
        row[2, :, 0] = gap_open + gap_extend * (i - 1)
        row[2, :, 1:] = np.maximum(before[0, :, 1:] + gap_open, before[2, :, 1:] + gap_extend)
        run = np.maximum.accumulate(row[0, :, :-1] + gap_open - steps[:-1], axis=1) + steps[:-1]
        row[1, :, 1:] = np.maximum(run, row[1, :, :1] + steps[1:])
    at, i, j = np.arange(size), m.copy(), n.copy()
    last = s[m, :, at, n]
    state = 2 - np.argmax(last[:, ::-1], axis=1)  # of equal ones the first of 2, 1, 0
    score = last[at, state]
    # how the two strings go on, from their ends: which of both advances
    took_x, took_y = (np.zeros((size, rows + width), dtype=bool) for _ in range(2))
    add = np.array([[0.0, 0.0, 0.0], [gap_open, gap_extend, -np.inf], [gap_open, -np.inf, gap_extend]])
    for step in range(rows + width):
        at = at[(i[at] > 0) | (j[at] > 0)]
        if not len(at):
            break
        now = state[at]
        early = (2 * i[at] <= m[at] + 1) & (2 * j[at] <= n[at] + 1)
        dx, dy = now != 1, now != 2
        took_x[at, step], took_y[at, step] = dx, dy
        i[at] -= dx
        j[at] -= dy
        from_ = s[i[at], :, at, j[at]] + add[now]
        fits = from_ >= from_.max(1, keepdims=True) - 1e-9
        chosen = np.where(early, np.argmax(fits, axis=1), np.where(fits[:, 0] & ~fits[:, 1] & ~fits[:, 2], 0, np.where(fits[:, 2], 2, 1)))
        edge = np.where(i[at] == 0, np.where(j[at] == 0, 0, 1), 2)
        state[at] = np.where((i[at] == 0) | (j[at] == 0), edge, chosen)
    out = []
    for k, (a, b) in enumerate(pairs):
        used = took_x[k] | took_y[k]
        end = int(used.sum())
        p, q = iter(a), iter(b)
        out.append(("".join(next(p) if t else "-" for t in took_x[k, :end][::-1].tolist()), "".join(next(q) if t else "-" for t in took_y[k, :end][::-1].tolist()), float(score[k])))
    return out


def align_all(pairs: list[tuple[str, str] | None], gap_open: float = -15.0, gap_extend: float = 0.0) -> list[tuple[str, str, float] | None]:
    """``global_align`` of each pair; equal pairs are aligned once, and pairs of about one length together, as many as ``BATCH_SCORES`` holds."""
    done: dict[tuple[str, str], tuple[str, str, float]] = {}
    held: list[tuple[str, str]] = []
    rows = width = 0

    def flush() -> None:
        if held:
            done.update(zip(held, _batch_align(held, gap_open, gap_extend), strict=True))
            held.clear()

    for p in sorted({p for p in pairs if p is not None}, key=lambda p: (len(p[0]), len(p[1]))):
        m, n = len(p[0]) + 1, len(p[1]) + 1
        if min(m, n) == 1 or 3 * m * n > BATCH_SCORES:
            done[p] = global_align(*p, gap_open, gap_extend)
            continue
        if 3 * max(rows, m) * max(width, n) * (len(held) + 1) > BATCH_SCORES:
            flush()
        rows, width = (max(rows, m), max(width, n)) if held else (m, n)
        held.append(p)
    flush()
    return [done[p] if p is not None else None for p in pairs]


def aligned(a: Column, b: Column, gap_open: float = -15.0, gap_extend: float = 0.0) -> Column:
    """Struct (qaln, saln, score); nulls give null."""

    @F.pandas_udf("qaln string, saln string, score double")
    def run(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)]
        return pd.DataFrame([r or (None, None, None) for r in align_all(pairs, gap_open, gap_extend)], columns=["qaln", "saln", "score"])

    return run(a, b)


def _spread(rows: DataFrame) -> DataFrame:
    """Rows dealt by number: many short strings are one small file, and their alignments more work than its size says."""
    spark = rows.sparkSession
    return rows.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism))


def nw_align(pairs: DataFrame, gap_open: float = -15.0, gap_extend: float = 0.0) -> DataFrame:
    """(…, qaln, saln, score) of the columns a and b."""
    ship(pairs.sparkSession)
    return _spread(pairs).withColumn("_al", aligned(F.col("a"), F.col("b"), gap_open, gap_extend)).select(*pairs.columns, "_al.*")


def map_positions(pairs: DataFrame, key: str) -> DataFrame:
    """(key, pos, idx): which residue of the structure stands at which position of the sequence (a: sequence, b: structure)."""
    ship(pairs.sparkSession)

    @F.pandas_udf("pos array<int>, idx array<int>")
    def places(x: pd.Series, y: pd.Series) -> pd.DataFrame:
        pairs = [(p, q) if p is not None and q is not None else None for p, q in zip(x, y, strict=True)]
        known: dict[tuple[str, str], tuple] = {}
        for p, both in zip(pairs, align_all(pairs, *STRUCTURE), strict=True):
            if p is not None and p not in known:
                own = [np.frombuffer(z.encode("utf-32-le"), dtype=np.uint32) != ord("-") for z in both[:2]]
                met = own[0] & own[1]
                known[p] = tuple(np.cumsum(z)[met].astype(np.int32) for z in own)
        out = [known[p] if p is not None else ([], []) for p in pairs]
        return pd.DataFrame(out, columns=["pos", "idx"])

    done = _spread(pairs.select(key, "a", "b")).select(key, places("a", "b").alias("_p"))
    return done.select(key, F.explode(F.arrays_zip("_p.pos", "_p.idx")).alias("_m")).select(key, "_m.pos", "_m.idx")


def draw(p: str, q: str, others: list[str]) -> list[str]:
    """The strings that stand beside ``q`` without its new gaps, in the columns of an alignment in which p is new and q has gaps added."""
    out: list[list[str]] = [[] for _ in others]
    k = 0
    for added in q:
        for o, other in zip(out, others, strict=True):
            o.append("-" if added is None else other[k])
        k += added is not None
    return ["".join(o) for o in out]


def transitive(qseq: str, qstr: str, sstr: str, sseq: str) -> tuple[str, str, str, str, int, int]:
    """The four strings (query sequence, its structure, the subject's structure, its sequence) in the same columns, without the columns
    at the ends where a structure has gaps, and the first residue of both sequences."""
    return transitive_all([(qseq, qstr, sstr, sseq)])[0]


def transitive_all(rows: list[tuple[str, str, str, str]]) -> list[tuple[str, str, str, str, int, int]]:
    """``transitive`` of each row: first all queries are aligned to their structures, then all subjects; equal rows are one."""
    each = list(dict.fromkeys(rows))

    def onto(p: str, q: str, struct: str, others: list[str]) -> list[str]:
        at, marked = 0, []
        for c in q:  # a gap of q is new unless it is the next character of the string that was aligned
            own = at < len(struct) and struct[at] == c
            marked.append(c if own else None)
            at += own
        return [p, q, *draw(p, marked, others)]

    first = [onto(p, q, r[1], [r[2]]) for r, (p, q, _) in zip(each, align_all([(r[0], r[1]) for r in each], *DEFAULT), strict=True)]
    second = align_all([(r[3], st) for r, (_, _, st) in zip(each, first, strict=True)], *DEFAULT)
    done = {}
    for r, (qs, qt, st), (p, q, _) in zip(each, first, second, strict=True):
        ss, st, qs, qt = onto(p, q, st, [qs, qt])
        beg = max(len(qt) - len(qt.lstrip("-")), len(st) - len(st.lstrip("-")))
        last = min(len(qt.rstrip("-")), len(st.rstrip("-")))
        start = [beg - x[:beg].count("-") + 1 for x in (qs, ss)]
        done[r] = (qs[beg:last], qt[beg:last], st[beg:last], ss[beg:last], *start)
    return [done[r] for r in rows]


def transitive_align(rows: DataFrame) -> DataFrame:
    """Sequences carried along an alignment of structures: (…, qaln, qstruct, sstruct, saln, qbeg, sbeg).

    rows: (key, qseq, qstr, sstr, sseq) with qstr and sstr aligned to one another. The query's sequence is aligned to its structure
    string, the subject's to what that makes of its own, and columns at the ends where a structure has gaps go.
    """
    ship(rows.sparkSession)

    @F.pandas_udf("qaln string, qstruct string, sstruct string, saln string, qbeg int, sbeg int")
    def carry(qseq: pd.Series, qstr: pd.Series, sstr: pd.Series, sseq: pd.Series) -> pd.DataFrame:
        got = transitive_all(list(zip(qseq, qstr, sstr, sseq, strict=True)))
        return pd.DataFrame(got, columns=["qaln", "qstruct", "sstruct", "saln", "qbeg", "sbeg"])

    return _spread(rows).withColumn("_t", carry("qseq", "qstr", "sstr", "sseq")).select(*rows.columns, "_t.*")


def mask_aligned(profile: DataFrame, chain: DataFrame, mapping: DataFrame, mode: str = "A") -> DataFrame:
    """Profile positions with their residue of the structure; mode A keeps only those that have one, B keeps all.

    profile (name, pos, res), chain (name, idx, resnum), mapping (name, pos, idx).
    """
    rows = profile.join(mapping, ["name", "pos"], "left").join(chain, ["name", "idx"], "left")
    rows = rows.filter("resnum IS NOT NULL AND res NOT IN ('-', 'X')") if mode == "A" else rows
    return rows.select("name", "pos", "res", "resnum")
