"""Language ID by error-correcting output codes.

Every language has a codeword of bits, with as many rows differing between any two as the code allows: all ways to part the languages in
two for up to ``EXHAUSTIVE`` of them, else a dense random code, the best of ``DRAWS``. One binary classifier a bit, logistic regression over
the mean of hashed words and character n-grams (lower-cased, ``quality.features``), is trained by numpy stochastic gradient descent on a
bounded sample: at most ``PER_LANGUAGE`` texts of a language and ``IN_ALL`` texts (but ``LEAST`` of each) of up to ``MAX_CHARS`` characters.

Decoding is loss-weighted: a codeword's distance is the sum of the bits' logistic losses, each weighted by how well its classifier did on
the part of the sample held back. The nearest codeword is the prediction; ``score`` is its share of exp(-distance). A text is ``ambiguous``
if the runner-up is nearer than ``MARGIN`` behind or if the nearest codeword is no nearer than undecided bits would be.

Whole texts are scored in pieces, so very long ones need no more memory. Tasks receive ``BUCKETS`` times bits floats, and nothing is shuffled but the
sample. Defined cases: null texts and texts without a letter are ``und`` with score 0 and not ambiguous, as is every text if no language was
learned; with one language every text with letters is that one with score 1; languages all of whose texts are longer than ``MAX_CHARS`` are
not learned, and more than ``MOST_LANGUAGES`` are an error; null languages and null ids are never learned from; each row is scored alone, so repeated rows share a result, and they count
once in the sample; an empty table gives no rows; columns of the results' names are replaced, others pass through.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import ship
from .quality import features
from .sample import fold

PER_LANGUAGE, IN_ALL, LEAST, MAX_CHARS = 600, 6000, 30, 20_000
EXHAUSTIVE, DRAWS, MOST_LANGUAGES = 6, 200, 1000
BUCKETS = 1 << 16
MARGIN = float(np.log(3))
ADDED = {"lang_pred": "string", "score": "double", "runner_up": "string", "gap": "double", "ambiguous": "boolean"}


def codewords(n: int, seed: int = 0) -> np.ndarray:
    """(n, bits) of -1 and 1; no column is constant, and none equals another or its opposite."""
    if n <= EXHAUSTIVE:
        # the first language has bit 1 everywhere, which leaves out opposites
        parts = np.arange(2 ** max(0, n - 1) - 1)
        return np.array([[1] * len(parts)] + [[1 if p >> k & 1 else -1 for p in parts] for k in range(n - 1)], dtype=np.int8)
    rng, best, widest = np.random.default_rng(seed), None, -1
    bits = int(np.ceil(10 * np.log2(n)))
    for _ in range(DRAWS):
        m = rng.choice(np.array([-1, 1], dtype=np.int8), (n, bits))
        m *= m[:1]
        m = np.unique(m[:, np.abs(m.sum(0, dtype=int)) < n], axis=1)
        agree = m.astype(int) @ m.T
        np.fill_diagonal(agree, -m.shape[1])
        apart = int((m.shape[1] - agree.max()) // 2)
        if apart > widest:
            best, widest = m, apart
    return best


def _bags(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    out = []
    for t in texts:
        own = list(features(t.lower()))
        ids, counts = np.unique(np.concatenate(own) & (BUCKETS - 1), return_counts=True) if own else (np.zeros(0, np.int64), np.zeros(0))
        out.append((ids, (counts / max(1, counts.sum())).astype(np.float32)))
    return out


def fit(texts: list[str], langs: list[str], epochs: int = 8, rate: float = 0.5, seed: int = 0) -> dict:
    """``langs``, their ``code``, ``u`` (bucket, bit), ``b`` (bit) and the bits' weights ``w``."""
    names = sorted(set(langs))
    code = codewords(len(names)) if names else np.zeros((0, 0), np.int8)
    bits = code.shape[1]
    u, b = np.zeros((BUCKETS, bits), np.float32), np.zeros(bits, np.float32)
    if not bits:
        return {"langs": names, "code": code, "u": u, "b": b, "w": np.ones(bits)}
    rng, bags = np.random.default_rng(seed), _bags(texts)
    y = code[[names.index(g) for g in langs]].astype(np.float32)
    share = 1 / np.array([langs.count(g) for g in names])
    weight = np.array([share[names.index(g)] for g in langs])
    weight = np.minimum(weight / weight.mean(), 5).astype(np.float32)
    back = rng.permutation(len(texts))
    held, used = back[: len(back) // 5], back[len(back) // 5 :]
    squares = np.full((BUCKETS, bits), 1e-8, np.float32)
    for _ in range(epochs):
        for d in rng.permutation(used):
            ids, x = bags[d]
            z = x @ u[ids] + b if len(ids) else b
            g = weight[d] * y[d] / (1 + np.exp(np.clip(y[d] * z, -60, 60)))
            b += 0.05 * g
            if len(ids):
                # each weight's step falls with the gradients it has seen, so rare n-grams learn as fast as common ones
                step = x[:, None] * g[None, :]
                squares[ids] += step * step
                u[ids] += rate * step / np.sqrt(squares[ids])
    wrong = np.full(bits, 0.5)
    if len(held):
        z = np.stack([bags[d][1] @ u[bags[d][0]] + b if len(bags[d][0]) else b for d in held])
        wrong = ((z * y[held]) <= 0).mean(0)
    w = np.maximum(1 - 2 * wrong, 0.05)
    return {"langs": names, "code": code, "u": u, "b": b, "w": w * bits / w.sum()}


def margins(text: str, model: dict) -> np.ndarray:
    """Each bit's classifier on a whole text."""
    u, count = model["u"], 0
    total = np.zeros(u.shape[1])
    for f in features(text.lower()):
        for at in range(0, len(f), 1 << 14):
            total += u[f[at : at + (1 << 14)] & (BUCKETS - 1)].sum(0, dtype=np.float64)
        count += len(f)
    return model["b"] + (total / count if count else 0.0)


def decode(z: np.ndarray, model: dict) -> tuple[str, float, str | None, float | None, bool]:
    """(language, score, runner-up, gap, ambiguous) of the bits' margins."""
    names, w = model["langs"], model["w"]
    if len(names) == 1:
        return names[0], 1.0, None, None, False
    distance = (w * np.logaddexp(0, -model["code"] * z)).sum(1)
    order = np.argsort(distance, kind="stable")
    share = np.exp(distance.min() - distance)
    gap = float(distance[order[1]] - distance[order[0]])
    undecided = float(w.sum() * np.log(2))
    return names[order[0]], float(share[order[0]] / share.sum()), names[order[1]], gap, bool(gap < MARGIN or distance[order[0]] >= undecided)


def predict(text: str | None, model: dict) -> tuple[str, float, str | None, float | None, bool]:
    if not model["langs"] or not any(map(str.isalpha, text or "")):
        return "und", 0.0, None, None, False
    return decode(margins(text, model), model)


def language_sample(docs: DataFrame, modulus: int, held: int) -> tuple[list[str], list[str]]:
    """Texts and their languages, by a hash of id and text."""
    rows = docs.filter((fold(F.col("doc_id"), modulus) != held) & F.col("lang").isNotNull() & F.length("text").between(1, MAX_CHARS))
    rows = rows.select("lang", "text", F.xxhash64("doc_id", "text").alias("h"))
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).limit(MOST_LANGUAGES + 1).collect()
    if len(counts) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    each = max(LEAST, min(PER_LANGUAGE, IN_ALL // max(1, len(counts))))
    sizes = docs.sparkSession.createDataFrame([(r["lang"], r["n"]) for r in counts], "lang string, n long")
    # twice as many as wanted by the hash alone, so that no language is sorted whole; texts meet the few sizes where they are
    few = rows.join(F.broadcast(sizes), "lang").filter(F.pmod("h", F.lit(1 << 30)) < F.lit(2.0 * each * (1 << 30)) / F.col("n"))
    few = few.groupBy("lang", "h").agg(F.min("text").alias("text"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    picked = few.withColumn("r", rank).filter(F.col("r") <= each).orderBy("lang", "h").select("text", "lang").collect()
    return [r["text"] for r in picked], [r["lang"] for r in picked]


def identify(docs: DataFrame, modulus: int = 3, held: int = 1) -> DataFrame:
    """``docs`` with lang_pred, score, runner_up, gap and ambiguous; ``lang`` is read for the sample alone."""
    spark = docs.sparkSession
    ship(spark)
    sent = spark.sparkContext.broadcast(fit(*language_sample(docs, modulus, held)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = sent.value
        for pdf in batches:
            found = pd.DataFrame([predict(t, model) for t in pdf["text"]], columns=list(ADDED), index=pdf.index)
            yield pdf.assign(**{c: found[c] for c in ADDED})

    kept = docs.select(*[c for c in docs.columns if c not in ADDED])
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema] + [f"{c} {t}" for c, t in ADDED.items()])
    return kept.mapInPandas(run, schema)
