"""Quality classifier: supervised subword embeddings.

The features of a text are its words and the character n-grams (3 to 5, with the space before and after a word) inside them, and a
mark for a word that repeats the one before it. Each is hashed to a row of a learned embedding; a document is the mean of its rows,
and a softmax layer gives the label. Embedding and layer are trained by numpy stochastic gradient descent on a bounded sample
(``PER_CLASS`` documents of each label, ``MAX_CHARS`` characters at most each); every whole text is scored.

All hashing is vectorised over the code points of many texts at once. As mean and layer are linear, scoring needs one number per
hash bucket, so what tasks receive is a fixed 1 MB. Texts are worked on in pieces of ``PIECE`` characters, and what reaches over a cut
(the open word, the last word, the last characters) is carried on, so very long texts need no more memory and have the same features.

Defined cases: null, empty and blank texts have no features and score by the layer's bias alone; without labels of both kinds every
score is the share of label 1 (1 if there are none at all); each row is scored alone, so repeated rows get one score; an empty table
gives no rows; columns named score or predicted are replaced, other extra columns pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from .sample import labelled_sample

PER_CLASS = 2000
MAX_CHARS = 20_000
BUCKETS = 1 << 18
DIM = 8
NGRAMS = (3, 4, 5)
PIECE = 1 << 18
THRESHOLD = 0.3
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _spread(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h = h * _MIX
    return (h ^ (h >> np.uint64(29))).astype(np.uint64)


def _powers(n: int, base: int) -> np.ndarray:
    out = np.full(n, np.uint64(base), dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_INVERSE = pow(int(_P), -1, 1 << 64)
_TABLES: dict[str, np.ndarray] = {}
_MASK = np.uint64(BUCKETS - 1)


def features(text: str) -> Iterator[np.ndarray]:
    """Hash buckets of all features of a text, in arrays by kind and piece."""
    if len(_TABLES.get("p", ())) < PIECE + 8:
        _TABLES["p"], _TABLES["i"] = _powers(PIECE + 8, int(_P)), _powers(PIECE + 8, _INVERSE)
    power, inverse = _TABLES["p"], _TABLES["i"]
    reach = max(NGRAMS) - 1
    tail = np.full(1, 32, dtype=np.uint64)
    open_hash, open_power, last = np.zeros(1, np.uint64), np.ones(1, np.uint64), None  # arrays wrap without a warning
    for piece in (*pieces(text), " "):
        own = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
        own[(own >= 9) & (own <= 13)] = 32
        t, n = len(tail), len(own)
        c = np.concatenate([tail, own])
        blank = c == 32
        starts = np.flatnonzero(blank[t - 1 : -1] & ~blank[t:])
        ends = np.flatnonzero(~blank[t - 1 : -1] & blank[t:])
        upto = np.concatenate([np.zeros(1, np.uint64), np.cumsum((own + np.uint64(1)) * power[:n], dtype=np.uint64)])
        opened = not blank[t - 1]
        words = np.zeros(0, np.uint64)
        if opened and len(ends):
            words = _spread(open_hash + open_power * upto[ends[:1]])
        elif opened:
            open_hash, open_power = open_hash + open_power * upto[n : n + 1], open_power * power[n : n + 1]
        whole = len(ends) - opened if len(ends) else 0
        if whole:
            a, b = starts[:whole], ends[len(ends) - whole :]
            words = np.concatenate([words, _spread((upto[b] - upto[a]) * inverse[a])])
        if len(starts) > whole:
            a = starts[-1:]
            open_hash, open_power = (upto[n] - upto[a]) * inverse[a], power[n - a]
        if len(words):
            yield (words & _MASK).astype(np.int64)
            again = int(np.count_nonzero(words[1:] == words[:-1])) + (last is not None and int(words[0] == last))
            last = words[-1]
            if again:
                yield np.full(again, 7, dtype=np.int64)
        h, inner, n = c.copy(), np.cumsum(blank), t + n
        for k in range(2, min(reach + 1, n) + 1):
            h = h[: n - k + 1] * _P + c[k - 1 :]
            if k in NGRAMS:
                # at most the first and the last character are blank: no n-gram reaches over a word's ends; those of the tail came before
                ok = inner[k - 2 : n - 1] == inner[: n - k + 1]
                ok[: max(0, t - k + 1)] = False
                yield (_spread(h[ok] + np.uint64(k)) & _MASK).astype(np.int64)
        tail = c[-reach:]


def pieces(text: str, size: int | None = None) -> Iterator[str]:
    size = size or PIECE
    return (text[at : at + size] for at in range(0, len(text), size))


def fit(texts: list[str], y: np.ndarray, epochs: int = 6, rate: float = 0.6, seed: int = 0) -> dict:
    """``u``: what each hash bucket adds to the logit of label 1 over label 0; ``b``: the bias."""
    if len(y) == 0 or y.min() == y.max():
        share = float(y.mean()) if len(y) else 1.0
        return {"u": np.zeros(BUCKETS, np.float32), "b": 30.0 * (2 * share - 1)}
    bags = []
    for t in texts:
        own = list(features(t))
        ids, counts = np.unique(np.concatenate(own), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0))
        bags.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    rng = np.random.default_rng(seed)
    emb = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32)
    layer, bias = np.zeros((2, DIM), np.float32), np.zeros(2, np.float32)
    weight = np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, len(y) - y.sum())))
    total = epochs * len(y)
    for epoch in range(epochs):
        for k, d in enumerate(rng.permutation(len(y))):
            ids, share = bags[d]
            step = np.float32(rate * (1 - (epoch * len(y) + k) / total) * weight[d])
            x = share @ emb[ids] if len(ids) else np.zeros(DIM, np.float32)
            z = layer @ x + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            g = -p
            g[int(y[d])] += 1
            back = layer.T @ g
            layer += step * np.outer(g, x)
            bias += step * 0.1 * g
            if len(ids):
                # the mean divides each row's gradient by the text's length; the step makes up for it as in sparse training
                emb[ids] += step * np.minimum(share * 200, 20)[:, None] * back[None, :]
    return {"u": emb @ (layer[1] - layer[0]), "b": float(bias[1] - bias[0])}


def logits(texts: list[str | None], model: dict) -> np.ndarray:
    u, out = model["u"], np.zeros(len(texts))
    for i, t in enumerate(texts):
        total, count = 0.0, 0
        for f in features(t or ""):
            total += float(u[f].sum(dtype=np.float64))
            count += len(f)
        out[i] = model["b"] + (total / count if count else 0.0)
    return out


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "quality", modulus: int = 5, held: int = 0, threshold: float = THRESHOLD) -> DataFrame:
    """``docs`` with score and predicted beside its own columns, from the whole text."""
    ship(docs.sparkSession)
    model = fit(*labelled_sample(docs, labels, label, modulus, held, PER_CLASS, MAX_CHARS))
    own = [c for c in docs.columns if c not in ("score", "predicted")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = 1 / (1 + np.exp(-np.clip(logits(list(pdf["text"]), model), -700, 700)))
            yield pdf.assign(score=s, predicted=(s >= threshold).astype("int32"))

    kept = docs.select(*own)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema) + ", score double, predicted int"
    return kept.mapInPandas(run, schema)
