"""Centroid clustering: Lloyd's rounds over two trees.

Vectors become integers and are gathered, as they lie in their partitions, into blocks of at most ``BLOCK``; nothing is shuffled, so neither
repeated rows nor hot ids make a large task. Each block gets a cover tree once: a node's points lie within its radius of the node's
point, and its children cover them at half that scale, their points more than that scale apart. Points whose child would hold fewer than
``LEAF`` are pooled in one leaf, so vectors without neighbours cost no nodes of their own. A block is one row of a staged table: vectors in
tree order, and for each node its range, point, radius and sum.

In each round the centroids get a tree too, and every block walks both: for a node and the centroid nodes still in question, those whose
least possible distance exceeds the least greatest distance of the others are pruned. A node with one centroid left hands its sum to
it unread; leaves compare their points with the centroids left, exactly and in integers. Tasks return one row for each centroid, and only
these sums, centroids times components, reach the driver. Centroids travel with the tasks: ``k`` vectors, a parameter.

Defined cases: vectors that are null, of another length than ``dims``, or hold null or non-finite components take no part; components
beyond 2^27 after scaling raise an error, as distances would not fit in a long. Rows that repeat are vectors of their own; a starting centroid of
a repeated vector leaves its twin empty, as ties go to the smaller number, and a centroid without vectors stays. Of rows that repeat an id
with other vectors the smaller vector comes first. A null id is clustered but never starts a centroid, unless ids run out. With fewer
than ``k`` vectors there are as many centroids; an empty table gives no rows. Extra columns are left out.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .staging import staged

BLOCK, LEAF = 2048, 16
LARGEST = 1 << 27
BLOCKS = "ids binary, named binary, v binary, bounds binary, radius binary, at binary, sums binary"


def integers(vectors: DataFrame, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): the vectors that take part, with components floor(scale * x)."""
    v = F.transform(F.col(vector_col), lambda x: x.cast("double"))
    broken = F.exists("v", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v")).filter((F.size("v") == dims) & ~broken)
    wide = F.exists("v", lambda x: F.abs(x * scale) > LARGEST)
    return rows.select("vec_id", F.when(wide, F.raise_error(F.lit(f"components times {scale} have to lie within {LARGEST}"))).otherwise(F.transform("v", lambda x: F.floor(x * scale))).alias("v"))


def _gaps(x: np.ndarray, point: np.ndarray) -> np.ndarray:
    d = x - point
    return np.sqrt(np.einsum("nd,nd->n", d, d, dtype=np.float64))


def _apart(x: np.ndarray) -> np.ndarray:
    """All distances of a block, good enough to group by; radii and bounds are computed from the integers."""
    f = x.astype(np.float64)
    f -= f.mean(0)
    squares = np.einsum("nd,nd->n", f, f)
    return np.sqrt(np.maximum(squares[:, None] + squares[None, :] - 2 * (f @ f.T), 0)).astype(np.float32)


def cover_tree(x: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int, int]], list[float], list[int]]:
    """(order, bounds, radius, at): points in tree order; for each node (lo, hi, first child, children), its radius and its point's place.

    A node's range in ``order`` is that of its children put together, and the children of a node are neighbours in the list.
    """
    apart = _apart(x)
    order = np.arange(len(x))
    bounds, radius, at = [(0, len(x), 0, 0)], [0.0], [0]
    todo = [(0, np.inf)]
    while todo:
        node, above = todo.pop()
        lo, hi, _, _ = bounds[node]
        own = order[lo:hi]
        radius[node] = float(_gaps(x[own], x[own[0]]).max())
        scale = min(above, 2.0 ** np.ceil(np.log2(max(radius[node], 0.5)))) / 2
        if hi - lo < 2 * LEAF or scale < 0.5:
            continue
        groups, rest = [], own
        while len(rest):
            near = apart[rest[0], rest] <= scale
            groups.append(rest[near])
            rest = rest[~near]
        pooled = [g for g in groups if len(g) < LEAF]
        groups = [g for g in groups if len(g) >= LEAF]
        if not groups:
            continue
        if pooled:
            groups.append(np.concatenate(pooled))
        if len(groups) == 1:
            todo.append((node, scale))
            continue
        first = len(bounds)
        bounds[node] = (lo, hi, first, len(groups))
        order[lo:hi] = np.concatenate(groups)
        for g in groups:
            # pooled points lie apart at this scale; their node has no finer level
            todo.append((len(bounds), 0.0 if pooled and g is groups[-1] else scale))
            bounds.append((lo, lo + len(g), 0, 0))
            radius.append(0.0)
            at.append(lo)
            lo += len(g)
    return order, bounds, radius, at


def pack(ids: list, vectors: list) -> dict:
    """One block as a row."""
    x = np.stack(vectors).astype(np.int64)
    order, bounds, radius, at = cover_tree(x)
    x = x[order]
    sums = np.stack([x[lo:hi].sum(0) for lo, hi, _, _ in bounds])
    named = np.array([ids[i] is not None for i in order])
    known = np.array([ids[i] if ids[i] is not None else 0 for i in order], dtype=np.int64)
    whole = {"ids": known, "named": named, "v": x.astype(np.int32), "bounds": np.array(bounds, dtype=np.int32), "radius": np.array(radius), "at": np.array(at, dtype=np.int32), "sums": sums}
    return {k: a.tobytes() for k, a in whole.items()}


def tree_blocks(rows: DataFrame) -> DataFrame:
    def build(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list = []
        vectors: list = []
        for pdf in batches:
            ids += [None if pd.isna(i) else int(i) for i in pdf["vec_id"]]
            vectors += list(pdf["v"])
            while len(ids) >= BLOCK:
                yield pd.DataFrame([pack(ids[:BLOCK], vectors[:BLOCK])])
                ids, vectors = ids[BLOCK:], vectors[BLOCK:]
        if ids:
            yield pd.DataFrame([pack(ids, vectors)])

    return staged(rows.mapInPandas(build, BLOCKS), "dual-tree-blocks")


class Centroids:
    """The centroids' tree: halves around the two that lie farthest apart."""

    def __init__(self, c: np.ndarray):
        self.c, f = c, c.astype(np.float64)
        self.middle, self.radius, self.children, self.leaf = [], [], [], []
        todo = [np.arange(len(c))]
        self.members = [todo[0]]
        while len(self.middle) < len(self.members):
            own = self.members[len(self.middle)]
            middle = f[own].mean(0)
            gaps = _gaps(f[own], middle)
            self.middle.append(middle)
            self.radius.append(float(gaps.max()))
            a = own[gaps.argmax()]
            b = own[_gaps(f[own], f[a]).argmax()]
            nearer = _gaps(f[own], f[a]) <= _gaps(f[own], f[b])
            if len(own) == 1 or nearer.all():
                self.children.append(())
            else:
                self.children.append((len(self.members), len(self.members) + 1))
                self.members += [own[nearer], own[~nearer]]
        self.middle, self.radius = np.stack(self.middle), np.array(self.radius)


def _open(pdf: pd.DataFrame, dims: int) -> Iterator[dict]:
    kinds = {"ids": np.int64, "named": bool, "v": np.int32, "bounds": np.int32, "radius": np.float64, "at": np.int32, "sums": np.int64}
    for row in pdf.itertuples(index=False):
        b = {k: np.frombuffer(getattr(row, k), dtype=t) for k, t in kinds.items()}
        yield b | {"v": b["v"].reshape(-1, dims).astype(np.int64), "bounds": b["bounds"].reshape(-1, 4), "sums": b["sums"].reshape(-1, dims)}


def walk(block: dict, tree: Centroids, whole: bool) -> Iterator[tuple[int, int, np.ndarray, np.ndarray | None]]:
    """(lo, hi, clusters, distances) for ranges of points; one cluster and no distances where a whole node has one centroid left and ``whole``."""
    v, todo = block["v"], [(0, np.zeros(1, dtype=np.int64))]
    while todo:
        node, open_nodes = todo.pop()
        lo, hi, first, n = block["bounds"][node].tolist()
        reach, middle = block["radius"][node], v[block["at"][node]]
        while True:
            gaps = _gaps(tree.middle[open_nodes], middle)
            wide = tree.radius[open_nodes] + reach
            most = (gaps + wide).min()
            open_nodes = open_nodes[gaps - wide <= most * (1 + 1e-9) + 1e-6]
            # the wider side is opened first: centroid nodes here, the block's node below
            inner = [m for m in open_nodes if tree.children[m] and (tree.radius[m] >= reach or not n)]
            if not inner:
                break
            open_nodes = np.array([m for m in open_nodes if m not in inner] + [c for m in inner for c in tree.children[m]])
        left = np.sort(np.concatenate([tree.members[m] for m in open_nodes]))
        if len(left) == 1 and whole:
            yield lo, hi, left, None
        elif n and len(left) > 1:
            todo += [(c, open_nodes) for c in range(first, first + n)]
        else:
            best, least = np.full(hi - lo, left[0]), None
            for k in left:
                d = v[lo:hi] - tree.c[k]
                d = np.einsum("nd,nd->n", d, d)
                if least is None:
                    least = d
                else:
                    best, least = np.where(d < least, k, best), np.minimum(d, least)
            yield lo, hi, best, least


def _moved(blocks: DataFrame, c: np.ndarray) -> np.ndarray:
    """The centroids after one round."""
    k, dims = c.shape

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree, sums, counts = Centroids(c), np.zeros((k, dims), dtype=np.int64), np.zeros(k, dtype=np.int64)
        for pdf in batches:
            for block in _open(pdf, dims):
                of = {(int(lo), int(hi)): i for i, (lo, hi, _, _) in enumerate(block["bounds"])}
                for lo, hi, clusters, distances in walk(block, tree, True):
                    if distances is None:
                        sums[clusters[0]] += block["sums"][of[lo, hi]]
                        counts[clusters[0]] += hi - lo
                    else:
                        np.add.at(sums, clusters, block["v"][lo:hi])
                        counts += np.bincount(clusters, minlength=k)
        yield pd.DataFrame({"cluster": np.arange(k, dtype=np.int32), "n": counts, "total": list(sums)})

    parts = blocks.mapInPandas(run, "cluster int, n long, total array<long>").select("cluster", "n", F.posexplode("total").alias("p", "x"))
    out = c.copy()
    for r in parts.groupBy("cluster", "p").agg(F.sum("n").alias("n"), F.sum("x").alias("x")).collect():  # k times dims rows
        if r["n"]:
            out[r["cluster"], r["p"]] = r["x"] // r["n"]
    return out


def _assigned(blocks: DataFrame, c: np.ndarray) -> DataFrame:
    dims = c.shape[1]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tree = Centroids(c)
        for pdf in batches:
            for block in _open(pdf, dims):
                cluster, distance = np.empty(len(block["v"]), dtype=np.int32), np.empty(len(block["v"]), dtype=np.int64)
                for lo, hi, clusters, distances in walk(block, tree, False):
                    cluster[lo:hi], distance[lo:hi] = clusters, distances
                ids = pd.Series(block["ids"], dtype="Int64").where(block["named"])
                yield pd.DataFrame({"vec_id": ids, "cluster": cluster, "distance": distance})

    return blocks.mapInPandas(run, "vec_id long, cluster int, distance long")


def cluster(vectors: DataFrame, k: int = 16, rounds: int = 3, seed: int = 1, dims: int = 64, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one row a vector that takes part."""
    spark = vectors.sparkSession
    ship(spark)
    rows = integers(vectors, dims, scale, id_col, vector_col)
    blocks = tree_blocks(rows)
    named = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = rows.withColumn("h", named).orderBy(F.asc_nulls_last("h"), "v").limit(k).collect()
    schema = "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string"
    if not start:
        return spark.createDataFrame([], schema)
    c = np.array([r["v"] for r in start], dtype=np.int64)
    for _ in range(rounds):
        c = _moved(blocks, c)
    final = _assigned(blocks, c)
    own = {r["cluster"]: r["s"] for r in final.groupBy("cluster").agg(F.sum("distance").alias("s")).collect()}  # at most k rows
    hashes = [hashlib.sha256(",".join(map(str, x.tolist())).encode()).hexdigest() for x in c]
    facts = spark.createDataFrame([(i, s, sum(own.values()), hashes[i]) for i, s in sorted(own.items())], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return final.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")
