"""Nearest neighbours by cosine through score-aware (anisotropic) product quantisation.

Vectors are scaled to length one, so the largest inner product is the largest cosine. Each pair of dimensions has 16 codewords, so a
vector takes four bits a pair. The loss weighs the part of the residual parallel to the vector more than the rest by
eta = (d - 1) t^2 / (1 - t^2), since that part is what disturbs large inner products; codes are chosen by coordinate descent under
this loss and codewords by its weighted least squares. Codewords are fitted on a bounded sample (``SAMPLE`` vectors); every vector is
encoded.

Search: rows and queries are dealt into blocks of bounded size and each block of queries meets each block of rows once; a row travels
with its codes packed two a byte and its vector as stored, once for every ``QUERY_BLOCK`` queries. There, a query's tables of 256 partial
sums (one a byte) are scanned over all codes, and the best of the block are scored again by the
original vectors in double precision: ``RERANK`` rows, and twice as many again while the next one's approximate score is less than
``MARGIN`` standard errors (measured for the query) below the k-th exact score. So where a third of all vectors lie close together, all of
those are scored exactly. The best k of all blocks stay. Equal vectors in a block are scanned as one and
then give their smallest ids, so a vector that a third of all rows share needs no more candidates.

Defined cases: vectors that are null, zero, hold null or non-finite components, or have another length than most take no part; a
query whose id several rows share uses the smallest of their vectors, and a candidate's id counts once, by its best row; with fewer than
k candidates all are returned; ties go to the smaller id; rows equal in id and vector are one; an empty table gives no rows; extra columns are
left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .staging import staged

SAMPLE = 8192
THRESHOLD = 0.2
ROW_BLOCK, QUERY_BLOCK = 8192, 32768
RERANK, MARGIN = 128, 3.0


def usable(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(vec_id, v): the vectors that take part; floats stay floats, anything else becomes doubles."""
    kind = vectors.schema[vector_col].dataType.elementType.simpleString()
    v = F.col(vector_col) if kind in ("float", "double") else F.transform(F.col(vector_col), lambda x: x.cast("double"))
    rows = vectors.filter(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return rows.filter(~broken & F.exists("v", lambda x: x != 0))


def packed(codes: np.ndarray) -> np.ndarray:
    """Two codes a byte, the first in the low half; an odd last one alone."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return codes[:, ::2] | (codes[:, 1::2] << 4)


def _eta(d: int, t: float = THRESHOLD) -> float:
    return max(1.0, (d - 1) * t * t / (1 - t * t))


def encode(u: np.ndarray, books: np.ndarray, eta: float, rounds: int = 3) -> np.ndarray:
    """Codes (n, pairs) of unit vectors by coordinate descent under the anisotropic loss."""
    n, pairs = len(u), len(books)
    parts = u.reshape(n, pairs, 2)
    codes = np.empty((n, pairs), dtype=np.uint8)
    along = np.empty((n, pairs))
    for m in range(pairs):
        r = parts[:, m, None, :] - books[m][None, :, :]
        codes[:, m] = (r * r).sum(2).argmin(1)
        along[:, m] = ((parts[:, m] - books[m][codes[:, m]]) * parts[:, m]).sum(1)
    total = along.sum(1)
    for _ in range(rounds):
        changed = False
        for m in range(pairs):
            r = parts[:, m, None, :] - books[m][None, :, :]
            par = (r * parts[:, m, None, :]).sum(2)
            rest = total - along[:, m]
            best = ((r * r).sum(2) + (eta - 1) * (rest[:, None] + par) ** 2).argmin(1)
            changed |= bool((best != codes[:, m]).any())
            codes[:, m] = best
            along[:, m] = par[np.arange(n), best]
            total = rest + along[:, m]
        if not changed:
            break
    return codes


def train(u: np.ndarray, rounds: int = 6, seed: int = 0) -> np.ndarray:
    """Codewords (pairs, 16, 2)."""
    rng = np.random.default_rng(seed)
    n, pairs = len(u), u.shape[1] // 2
    parts, eta = u.reshape(n, pairs, 2), _eta(u.shape[1])
    books = np.empty((pairs, 16, 2))
    for m in range(pairs):
        c = parts[rng.choice(n, 16, replace=n < 16), m].copy()
        for _ in range(8):
            at = ((parts[:, m, None, :] - c[None]) ** 2).sum(2).argmin(1)
            count = np.bincount(at, minlength=16)
            for axis in (0, 1):
                c[:, axis] = np.where(count > 0, np.bincount(at, weights=parts[:, m, axis], minlength=16) / np.maximum(count, 1), c[:, axis])
        books[m] = c
    for _ in range(rounds):
        codes = encode(u, books, eta, rounds=1)
        residual = parts - books[np.arange(pairs)[None, :], codes]
        total = (residual * parts).sum((1, 2))
        for m in range(pairs):
            p, code = parts[:, m], codes[:, m]
            rest = total - (residual[:, m] * p).sum(1)
            # minimise |p - c|^2 + (eta - 1) (rest + p.(p - c))^2 over the rows of each codeword
            a = np.eye(2)[None] + (eta - 1) * p[:, :, None] * p[:, None, :]
            b = p + (eta - 1) * (rest + (p * p).sum(1))[:, None] * p
            for k in range(16):
                own = code == k
                if own.any():
                    books[m, k] = np.linalg.solve(a[own].sum(0) + 1e-9 * np.eye(2), b[own].sum(0))
    return books


def _unit(v: np.ndarray) -> np.ndarray:
    v = v / np.abs(v).max(1, keepdims=True)
    return v / np.sqrt((v * v).sum(1, keepdims=True))


def _even(u: np.ndarray) -> np.ndarray:
    return u if u.shape[1] % 2 == 0 else np.pad(u, ((0, 0), (0, 1)))


def scan(q_ids: np.ndarray, q: np.ndarray, ids: np.ndarray, v: np.ndarray, codes: np.ndarray, books: np.ndarray, k: int, rerank: int = RERANK) -> list[tuple[int, int, float]]:
    """(query_id, vec_id, score): each query's k best of one block of rows, whose codes are packed."""
    order = np.argsort(ids, kind="stable")
    ids, v, codes = ids[order], v[order], codes[order]
    _, first, group = np.unique(np.ascontiguousarray(v).view(np.dtype((np.void, v.dtype.itemsize * v.shape[1]))).ravel(), return_index=True, return_inverse=True)
    members = np.split(np.argsort(group, kind="stable"), np.cumsum(np.bincount(group))[:-1])
    rows = v[first]
    rows_u = _unit(rows)
    pairs = len(books)
    two = list(codes[first].T.astype(np.int64))
    some = np.arange(0, len(rows), max(1, len(rows) // 256))
    rerank, out = max(rerank, k + 2), []
    q_u = _unit(q)
    for i, qid in enumerate(q_ids):
        if i % 1024 == 0:
            look = np.einsum("qmd,mkd->qmk", _even(q_u[i : i + 1024]).reshape(-1, pairs, 2), books).astype(np.float32)
        own = look[i % 1024]
        approx = np.zeros(len(rows), dtype=np.float32)
        for j, byte in enumerate(two):
            m = 2 * j
            table = (own[m][None, :] + own[m + 1][:, None]).ravel() if m + 1 < pairs else own[m]
            approx += table[byte]
        error = (rows_u[some] * q_u[i]).sum(1) - approx[some]
        slack, depth = float(error.mean() + MARGIN * error.std()), min(rerank, len(approx))
        while True:
            top = np.argpartition(-approx, depth - 1)[:depth] if depth < len(approx) else np.arange(len(approx))
            exact = (rows_u[top] * q_u[i]).sum(1)
            if depth == len(approx) or np.partition(exact, -k - 1)[-k - 1] > approx[top].min() + slack:
                break
            depth = min(2 * depth, len(approx))
        found: dict[int, float] = {}
        for s, g in zip(exact.tolist(), top.tolist(), strict=True):
            taken = 0
            for x in ids[members[g]]:
                if x != qid and found.get(int(x), -2.0) < s:
                    found[int(x)] = s
                    taken += 1
                    if taken > k:
                        break
        out.extend((int(qid), x, s) for x, s in sorted(found.items(), key=lambda e: (-e[1], e[0]))[:k])
    return out


def search(vectors: DataFrame, every: int = 50, k: int = 5, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score) for the queries, the rows whose id is divisible by ``every``."""
    ship(vectors.sparkSession)
    rows = usable(vectors, id_col, vector_col)
    schema = "query_id long, vec_id long, score double"
    most = rows.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    if most is None:
        empty = rows.sparkSession.createDataFrame([], schema)
        return empty.select("query_id", F.lit(1).alias("rank"), "vec_id", "score")
    d, n = most["d"], most["count"]
    # equal rows count once; one with another vector goes to another block
    rows = rows.filter(F.size("v") == d).dropDuplicates(["vec_id", "v"])
    # a top-k sends SAMPLE rows of every partition to the driver; this bound on the hash leaves about twice SAMPLE in all
    below = int(2**64 * min(1.0, 2 * SAMPLE / n)) - 2**63
    hashed = rows.withColumn("o", F.xxhash64("vec_id", "v"))
    fit = hashed.filter(F.col("o") <= min(below, 2**63 - 1)).orderBy("o", "vec_id").limit(SAMPLE).select("v").toPandas()["v"]
    if not len(fit):  # many equal rows have one hash
        fit = rows.limit(SAMPLE).select("v").toPandas()["v"]
    books = train(_even(_unit(np.array(fit.tolist(), dtype=np.float64))))
    eta = _eta(d)

    def quantise(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            codes = packed(encode(_even(_unit(np.array(pdf["v"].tolist(), dtype=np.float64))), books, eta)) if len(pdf) else []
            yield pdf.assign(code=[c.tobytes() for c in codes])

    coded = rows.mapInPandas(quantise, f"vec_id long, v {rows.schema['v'].dataType.simpleString()}, code binary")
    queries = staged(rows.filter(F.col("vec_id") % every == 0).groupBy("vec_id").agg(F.min("v").alias("v")), "ann-queries")
    r_blocks, q_blocks = max(1, -(-n // ROW_BLOCK)), max(1, -(-queries.count() // QUERY_BLOCK))
    left = queries.select(F.pmod(F.xxhash64("vec_id"), F.lit(q_blocks)).alias("qb"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(r_blocks - 1).cast("long"))).alias("rb"), "vec_id", "v")
    right = coded.select(F.explode(F.sequence(F.lit(0).cast("long"), F.lit(q_blocks - 1).cast("long"))).alias("qb"), F.pmod(F.xxhash64("vec_id", "v", F.lit(1)), F.lit(r_blocks)).alias("rb"), "vec_id", "v", "code")

    def meet(q: pd.DataFrame, r: pd.DataFrame) -> pd.DataFrame:
        found: list[tuple[int, int, float]] = []
        if len(q) and len(r):
            codes = np.frombuffer(b"".join(r["code"]), dtype=np.uint8).reshape(len(r), -1)
            found = scan(q["vec_id"].to_numpy(), np.array(q["v"].tolist(), dtype=np.float64), r["vec_id"].to_numpy(), np.array(r["v"].tolist(), dtype=np.float64), codes, books, k)
        return pd.DataFrame(found, columns=["query_id", "vec_id", "score"])

    near = left.groupBy("qb", "rb").cogroup(right.groupBy("qb", "rb")).applyInPandas(meet, schema)
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return near.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
