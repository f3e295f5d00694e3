"""N-gram Jaccard join by a MinHash LSH forest.

A document is its set of five-word shingles. Documents with one set form a class, and everything below works on classes. Each tree of
the forest labels a class with ``DEEPEST`` bytes, one for each MinHash value; in byte order the labels of a tree are a sorted prefix trie,
whose nodes of depth ``d`` hold the classes that agree in the first ``d`` bytes.

Prefixes start at ``DEEPEST`` and are shortened until the target recall. A forest at depth d holds a pair of similarity s in some node with
probability 1 - (1 - s^d)^trees, and d is shortened until a pair at exactly the threshold, the least likely of all links, reaches
``RECALL`` by itself. So every link of any corpus does, and nothing is estimated from a sample of it.

At that depth each class is tied to the least class of its nodes, and the connected components of these ties are the candidate groups.
Within one, all pairs are verified exactly, whether they shared a node or not, by products of incidence matrices: small groups many at
a time, large ones in blocks of bounded size where every block meets every other one. A block's shingles are made once and travel as
one value, each distinct shingle once. So no pair is ever a row; a task returns counts and a spanning forest. Links to identical copies
count without being expanded.

Defined cases: null, empty and blank texts have no shingles, no links and a class of their own; texts of one to four words have one
shingle, all their words; words are compared as they stand; ids may repeat or be null, rows are told apart by a 128-bit hash of id and
text, and rows equal in both are copies; very long texts are one set, whole; an empty table gives no rows; columns beside doc_id and text
are ignored by the join and kept by ``one_of_each``, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .components import components
from .staging import private, staged

WORDS, THRESHOLD = 5, 0.8
TREES, DEEPEST, RECALL = 40, 10, 0.9999
#: Shingles and classes in a block; blocks meet two by two in a task.
BLOCK_SHINGLES, BLOCK_CLASSES = 120_000, 800
_P = np.uint64(0x9E3779B97F4A7C15)
_WHITE = np.zeros(256, dtype=bool)
_WHITE[[9, 10, 11, 12, 13, 32]] = True


def prefix_depth(threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> int:
    """The longest prefix at which the expected recall of a pair at the threshold reaches the target."""
    d = DEEPEST
    while d > 1 and 1 - (1 - threshold**d) ** trees < recall:
        d -= 1
    return d


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_hashes(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Hash and start of each word of UTF-8 bytes; words lie between ASCII white space."""
    c = np.frombuffer(raw, dtype=np.uint8)
    blank = np.concatenate([[True], _WHITE[c], [True]])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    if not len(starts):
        return np.zeros(0, np.uint64), starts
    length = int((ends - starts).max())
    h = np.zeros(len(starts), dtype=np.uint64)
    if length <= 64:
        padded = np.concatenate([c, np.zeros(length, np.uint8)])
        for k in range(length):
            live = ends - starts > k
            h = np.where(live, h * _P + padded[starts + k] + np.uint64(1), h)
    else:
        for i, (a, b) in enumerate(zip(starts.tolist(), ends.tolist(), strict=True)):
            x = c[a:b].astype(np.uint64) + np.uint64(1)
            p = np.full(len(x), _P)
            p[0] = 1
            h[i] = (x * np.multiply.accumulate(p)[::-1]).sum(dtype=np.uint64)
    return _mix(h), starts


def shingles_of(words: np.ndarray, n: int = WORDS) -> np.ndarray:
    """The distinct hashes of ``n`` words in a row, sorted."""
    if not len(words):
        return words
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, np.uint64(k))
    for i in range(k):
        h = h * _P + words[i : len(words) - k + 1 + i]
    return np.unique(_mix(h))


def shingle_sets(texts: list[str | None], n: int = WORDS) -> Iterator[np.ndarray]:
    """One sorted set for each text; texts are hashed together up to a few MB."""
    group: list[bytes] = []
    size = 0

    def flush() -> Iterator[np.ndarray]:
        h, starts = word_hashes(b"\n".join(group))
        bounds = np.cumsum([len(g) + 1 for g in group])
        cut = np.searchsorted(starts, bounds)
        for a, b in zip([0, *cut[:-1]], cut, strict=True):
            yield shingles_of(h[a:b], n)

    for t in texts:
        raw = (t or "").encode("utf-8", "surrogatepass")
        if group and size + len(raw) > 1 << 20:
            yield from flush()
            group, size = [], 0
        group.append(raw)
        size += len(raw)
    if group:
        yield from flush()


def class_key(s: np.ndarray) -> bytes:
    """128 bits for a shingle set."""
    return hashlib.blake2b(s.tobytes(), digest_size=16).digest()


def row_key(doc_id: Column, text: Column) -> Column:
    """128 bits for an id and a text, nulls included."""
    whole = F.concat(F.coalesce(doc_id.cast("string"), F.lit("-")), F.when(text.isNull(), ":").otherwise("="), F.coalesce(text, F.lit("")))
    return F.unhex(F.md5(whole))


def labels_of(sets: list[np.ndarray], trees: int, depth: int = DEEPEST, seed: int = 7) -> np.ndarray:
    """(sets, trees * depth) bytes: the labels of all trees one after another."""
    rng = np.random.default_rng(seed)
    a = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32) | np.uint32(1)
    b = rng.integers(0, 1 << 32, trees * depth, dtype=np.uint32)
    least = np.empty((len(sets), trees * depth), dtype=np.uint32)
    for i, s in enumerate(sets):
        x = (s >> np.uint64(32)).astype(np.uint32)
        low = None
        for at in range(0, len(x), 256):
            part = (x[at : at + 256, None] * a[None, :] + b[None, :]).min(0)
            low = part if low is None else np.minimum(low, part)
        least[i] = low
    return ((least * np.uint32(0x9E3779B1)) >> np.uint32(24)).astype(np.uint8)


def signatures(docs: DataFrame, words: int, trees: int) -> DataFrame:
    """(doc_id, row_key, class_key, n, label): null class_key and label for texts without words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                sets = list(shingle_sets(part.column("text").to_pylist(), words))
                some = [i for i, s in enumerate(sets) if len(s)]
                labels: list = [None] * len(sets)
                for i, x in zip(some, labels_of([sets[i] for i in some], trees), strict=True):
                    labels[i] = x.tobytes()
                yield pa.RecordBatch.from_pydict(
                    {
                        "doc_id": part.column("doc_id"),
                        "row_key": part.column("row_key"),
                        "class_key": pa.array([class_key(s) if len(s) else None for s in sets], pa.binary()),
                        "n": pa.array([len(s) for s in sets], pa.int64()),
                        "label": pa.array(labels, pa.binary()),
                    }
                )

    rows = docs.select("doc_id", row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    return rows.mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, row_key binary, class_key binary, n long, label binary")


def nodes_at(classes: DataFrame, depth: int, trees: int) -> DataFrame:
    """(cid, key): the node of each class in each tree, as a hash of the tree and the prefix."""
    prefix = lambda t: F.xxhash64(t, F.substring("label", (t * DEEPEST + 1).cast("int"), F.lit(depth)))
    return classes.select("cid", F.explode(F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), prefix)).alias("key"))


def expected_recall(similarity: np.ndarray, weight: np.ndarray, depth: int, trees: int) -> float:
    """Share of links, of these similarities and weights, that share a node at this depth."""
    return float((weight * (1 - (1 - similarity**depth) ** trees)).sum() / weight.sum())


def adapted_depth(similarity: np.ndarray, shortest: int, trees: int, recall: float) -> int:
    """The prefix length for links of known similarities, taken from nodes at ``shortest``; the join itself takes the one that any link reaches."""
    if not len(similarity):
        return shortest
    weight = 1 / similarity**shortest  # a pair stands in a number of nodes in proportion to this power
    depth = DEEPEST
    while depth > shortest and expected_recall(similarity, weight, depth, trees) < recall:
        depth -= 1
    return depth


def _cross(a: list[np.ndarray], b: list[np.ndarray] | None, threshold: float) -> np.ndarray:
    """Which of ``a`` link to which of ``b`` (of ``a`` itself without it), exactly."""
    own = a if b is None else a + b
    flat = np.concatenate(own)
    at = np.repeat(np.arange(len(own)), [len(s) for s in own])
    values, inverse, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count > 1  # what only one set holds is in no intersection
    place = np.cumsum(shared) - 1
    keep = shared[inverse]
    at, col = at[keep], place[inverse[keep]]
    order = np.argsort(col, kind="stable")
    at, col, wide = at[order], col[order], int(shared.sum())
    na, nb = len(a), len(own) - len(a)
    inter = np.zeros((na, na if b is None else nb), dtype=np.float32)
    step = 1024
    edges = np.searchsorted(col, np.arange(0, wide + step, step))
    for k in range(len(edges) - 1):
        m = np.zeros((len(own), step), dtype=np.float32)
        m[at[edges[k] : edges[k + 1]], col[edges[k] : edges[k + 1]] - k * step] = 1
        inter += m[:na] @ (m[:na] if b is None else m[na:]).T
    sizes = np.array([len(s) for s in own], dtype=np.float64)
    sa, sb = sizes[:na], sizes[:na] if b is None else sizes[na:]
    link = np.empty(inter.shape, dtype=bool)
    for k in range(0, na, 256):
        both = np.rint(inter[k : k + 256]).astype(np.float64)
        link[k : k + 256] = both >= threshold * (sa[k : k + 256, None] + sb[None, :] - both) - 1e-9
    if b is None:
        np.fill_diagonal(link, False)
    return link


def _roots(link: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """The least key that each node reaches inside the block."""
    low = keys.copy()
    while True:
        new = low.copy()
        for i, row in enumerate(link):
            near = low[row]
            if len(near):
                new[i] = min(new[i], near.min())
        if (new == low).all():
            return low
        low = new


def verify(sets: list[np.ndarray], keys: np.ndarray, copies: np.ndarray, block: np.ndarray, i: int, j: int, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links (weighted by copies) and local roots of one candidate group, or of one pair of its blocks."""
    links = np.zeros(len(keys), dtype=np.int64)
    if i == j:
        link = _cross(sets, None, threshold)
        return (link * copies[None, :]).sum(1).astype(np.int64), _roots(link, keys)
    left, right = np.flatnonzero(block == i), np.flatnonzero(block == j)
    if not len(left) or not len(right):
        return links, keys
    part = _cross([sets[x] for x in left], [sets[x] for x in right], threshold)
    links[left], links[right] = (part * copies[right][None, :]).sum(1), (part * copies[left][:, None]).sum(0)
    link = np.zeros((len(keys), len(keys)), dtype=bool)
    link[np.ix_(left, right)], link[np.ix_(right, left)] = part, part.T
    return links, _roots(link, keys)


def to_block(keys: np.ndarray, copies: np.ndarray, sets: list[np.ndarray]) -> bytes:
    """Classes and their sets as one value, each distinct shingle once."""
    values, inverse = np.unique(np.concatenate(sets), return_inverse=True)
    sizes = np.array([len(s) for s in sets], dtype=np.int64)
    head = np.array([len(keys), len(values)], dtype=np.int64)
    return zstandard.ZstdCompressor(level=1).compress(b"".join([head.tobytes(), keys.astype(np.int64).tobytes(), copies.astype(np.int64).tobytes(), sizes.tobytes(), values.tobytes(), inverse.astype(np.uint32).tobytes()]))


def from_block(block: bytes) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    body = zstandard.ZstdDecompressor().decompress(block)
    n, m = np.frombuffer(body, np.int64, 2).tolist()
    keys, copies, sizes = np.frombuffer(body, np.int64, 3 * n, 16).reshape(3, n)
    values = np.frombuffer(body, np.uint64, m, 16 + 24 * n)
    inverse = np.frombuffer(body, np.uint32, offset=16 + 24 * n + 8 * m)
    return keys, copies, np.split(values[inverse], np.cumsum(sizes)[:-1])


def join_documents(docs: DataFrame, words: int = WORDS, threshold: float = THRESHOLD, trees: int = TREES, recall: float = RECALL) -> DataFrame:
    """One row per document: doc_id, row_key, class_id (the least doc_id of all documents linked to it directly or through others),
    n_links (other documents at or above the threshold, copies among them) and n_copies (documents with the same shingles)."""
    ship(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    sig = staged(signatures(docs, words, trees), "forest-signatures")
    classes = sig.filter("class_key IS NOT NULL").groupBy("class_key").agg(F.min("row_key").alias("row_key"), F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"), F.max("n").alias("n"), F.first("label").alias("label"))
    classes = staged(classes.withColumn("cid", F.monotonically_increasing_id()), "forest-classes")
    nodes = nodes_at(classes, prefix_depth(threshold, trees, recall), trees)
    least = nodes.groupBy("key").agg(F.min("cid").alias("a"), F.max("cid").alias("z")).filter("a < z").drop("z")
    ties = nodes.join(least, "key").filter("cid <> a").select("a", F.col("cid").alias("b"))
    groups = staged(components(ties), "forest-groups")

    members = groups.join(classes.drop("label"), groups["node"] == classes["cid"]).select("cid", "root", "row_key", "copies", "n")
    sizes = members.groupBy("root").agg(F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_CLASSES)).cast("int").alias("blocks"), F.sum("n").alias("all"))
    sizes = staged(sizes, "forest-sizes")
    small = sizes.filter("blocks = 1").agg(F.sum("all")).first()[0] or 0
    packs = max(1, -(-small // BLOCK_SHINGLES))
    members = members.join(sizes.select("root", "blocks"), "root")
    text = docs.select(row_key(F.col("doc_id"), F.col("text")).alias("row_key"), "text")
    # one text for each class; after the join rows of one key lie together
    full = text.join(members, "row_key").dropDuplicates(["row_key"])
    many = F.col("blocks") > 1
    dealt = full.select(
        "cid", "root", "copies", "text", many.alias("many"), "blocks",
        F.when(many, F.col("root")).otherwise(F.pmod(F.xxhash64("root"), F.lit(packs))).alias("pack"),
        F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int").alias("block"),
    )
    schema = "cid long, links long, local long"

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        """Small groups are verified; a block of a large one becomes a value."""
        sets = list(shingle_sets(pdf["text"].tolist(), words))
        keys, copies = pdf["cid"].to_numpy(), pdf["copies"].to_numpy()
        if pdf["many"].iat[0]:
            row = {"cid": None, "links": None, "local": None, "root": int(pdf["root"].iat[0]), "block": int(pdf["block"].iat[0]), "blocks": int(pdf["blocks"].iat[0]), "sets": to_block(keys, copies, sets)}
            return pd.DataFrame([row])
        links, roots = np.zeros(len(pdf), dtype=np.int64), keys.copy()
        for at in pdf.groupby("root", sort=False).indices.values():
            links[at], roots[at] = verify([sets[x] for x in at], keys[at], copies[at], np.zeros(len(at)), 0, 0, threshold)
        return pd.DataFrame({"cid": keys, "links": links, "local": roots, "root": None, "block": None, "blocks": None, "sets": None})

    one = staged(dealt.groupBy("pack", "many", "block").applyInPandas(first, f"{schema}, root long, block int, blocks int, sets binary"), "forest-blocks")
    meeting = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("block")).alias("i"), F.greatest(x, F.col("block")).alias("j")))
    meetings = one.filter("sets IS NOT NULL").select("root", "block", "sets", F.explode(meeting).alias("at")).select("root", "block", "sets", "at.*")

    def meet(pdf: pd.DataFrame) -> pd.DataFrame:
        got = [(b, *from_block(x)) for b, x in zip(pdf["block"], pdf["sets"], strict=True)]
        keys, copies = (np.concatenate([g[k] for g in got]) for k in (1, 2))
        block = np.concatenate([np.full(len(g[1]), g[0]) for g in got])
        links, roots = verify([s for g in got for s in g[3]], keys, copies, block, int(pdf["i"].iat[0]), int(pdf["j"].iat[0]), threshold)
        return pd.DataFrame({"cid": keys, "links": links, "local": roots})

    met = meetings.groupBy("root", "i", "j").applyInPandas(meet, schema)
    checked = staged(one.filter("sets IS NULL").select("cid", "links", "local").unionByName(met), "forest-links")
    final = components(checked.filter("cid <> local").select(F.col("cid").alias("a"), F.col("local").alias("b")))
    links = checked.groupBy("cid").agg(F.sum("links").alias("links"))
    known = classes.select("cid", "class_key", "first_doc", "copies").join(final.select(F.col("node").alias("cid"), "root"), "cid", "left").withColumn("root", F.coalesce("root", "cid"))
    least_doc = known.groupBy("root").agg(F.min("first_doc").alias("class_id"))
    known = staged(known.join(least_doc, "root").join(links, "cid", "left").select("class_key", "root", "class_id", "copies", F.coalesce("links", F.lit(0)).alias("links")), "forest-known")
    out = sig.select("doc_id", "row_key", "class_key").join(known, "class_key", "left")
    has = F.col("class_key").isNotNull()
    return out.select(
        "doc_id",
        "row_key",
        F.when(has, F.col("class_id")).otherwise(F.col("doc_id")).alias("class_id"),
        F.when(has, F.col("root")).alias("root"),
        F.when(has, F.col("copies") - 1 + F.col("links")).otherwise(0).cast("long").alias("n_links"),
        F.when(has, F.col("copies")).otherwise(1).cast("long").alias("n_copies"),
    )


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with one document of each group of linked ones, the one with the least id (null last), and all without words."""
    found = join_documents(docs, **options)
    own = private(docs.columns, "jaccard_")
    order = F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_key")
    best = found.filter("root IS NOT NULL").groupBy("root").agg(F.min(order).alias("o")).select(F.col("o.row_key").alias(f"{own}keep"))
    best = best.unionByName(found.filter("root IS NULL").select(F.col("row_key").alias(f"{own}keep")).distinct())
    keyed = docs.withColumn(f"{own}row", row_key(F.col("doc_id"), F.col("text")))
    return keyed.join(best, keyed[f"{own}row"] == best[f"{own}keep"]).dropDuplicates([f"{own}row"]).select(*docs.columns)
