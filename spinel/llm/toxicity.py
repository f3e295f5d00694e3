"""Toxicity by multiple-instance learning.

A document is a bag of sentences. Each sentence has a probability sigmoid(b + sum of its features' weights), where the features are
its words and the beginnings of its longer words; the document's is their noisy-or, 1 - prod(1 - p). Only documents carry labels: the
weights come from the likelihood of the document labels under the noisy-or, by proximal gradient steps with an L1 term and weights of
0 or more, so most features end without weight. A sentence without any weighted one is a null instance with probability 0: the features are
chosen, and the bias fixed, by a first fit over all sentences, and then fitted again over the sentences that have one of them. The fitted
model is the one that scores, and the same sentence probabilities locate the offending sentences.

The fit uses a bounded sample (``PER_CLASS`` documents of each label, ``MAX_CHARS`` characters at most each); every whole text is
scored. Defined cases: null and empty texts score 0; without labels of both kinds every score is 0; each row is scored alone, so
repeated rows and ties of ids give repeated results; very long texts are read sentence by sentence, a text without sentence ends as one
sentence; an empty table gives no rows; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from ..session import ship
from .sample import labelled_sample

PER_CLASS = 3000
MAX_CHARS = 20_000
#: Features kept for the fit, by how strongly their document counts differ between the labels.
VOCABULARY = 4000
L1 = 1e-3
#: Least weight of a feature that the first part of the fit kept; the second part fits only these.
LEAST = 1e-6
THRESHOLD = 0.3
SENTENCE = re.compile(r"[^.!?\n]+")
TOKEN = re.compile(r"\w+")
#: Lengths of word beginnings that are features beside the words.
BEGINNINGS = (4, 5)


def features(lower: str) -> set[str]:
    """Words of a lower-case text, and beginnings of longer words marked by a star."""
    own = set(TOKEN.findall(lower))
    for k in BEGINNINGS:
        own |= {f"{w[:k]}*" for w in own if len(w) > k and w[-1] != "*"}
    return own


def _screen(bags: Iterable[set[str]], y: np.ndarray, size: int) -> list[str]:
    pos, neg = Counter(), Counter()
    for bag, label in zip(bags, y, strict=True):
        (pos if label else neg).update(bag)
    n1, n0 = max(1.0, float(y.sum())), max(1.0, float(len(y) - y.sum()))

    def score(w: str) -> float:
        a, b = pos[w], neg[w]
        p = (a + b) / (n1 + n0)
        return abs(a / n1 - b / n0) / np.sqrt(p * (1 - p) * (1 / n1 + 1 / n0) + 1e-12)

    known = [w for w in pos.keys() | neg.keys() if pos[w] + neg[w] >= 3]
    return sorted(known, key=lambda w: (-score(w), w))[:size]


def fit(texts: list[str], y: np.ndarray, vocabulary: int = VOCABULARY, steps: int = 400, l1: float = L1) -> dict:
    """Weights by word and the bias, from whole documents and their labels."""
    if len(y) == 0 or y.min() == y.max():
        return {"b": -20.0, "w": {}}
    lower = [t.lower() for t in texts]
    words = _screen((features(t) for t in lower), y, vocabulary)
    index = {w: i for i, w in enumerate(words)}
    feat, sent_of, doc_of = [], [], []
    for d, t in enumerate(lower):
        for m in SENTENCE.finditer(t):
            own = {index[w] for w in features(m[0]) if w in index}
            if own:
                feat.extend(sorted(own))
                sent_of.extend([len(doc_of)] * len(own))
                doc_of.append(d)
    feat, sent_of, doc_of = np.array(feat, np.int64), np.array(sent_of, np.int64), np.array(doc_of, np.int64)
    w, b = _descend(np.zeros(len(words)), -4.0, feat, sent_of, doc_of, y, steps, l1, 0.0)
    # from here on the words are fixed, and a sentence without any of them is clean for sure, as it is to the scorer
    held = w[feat] > 0
    own_sents, sent_of = np.unique(sent_of[held], return_inverse=True)
    w, b = _descend(w, b, feat[held], sent_of, doc_of[own_sents], y, steps // 2, l1, LEAST)
    return {"b": float(b), "w": {word: float(x) for word, x in zip(words, w, strict=True) if x > 0}}


def _descend(w: np.ndarray, b: float, feat: np.ndarray, sent_of: np.ndarray, doc_of: np.ndarray, y: np.ndarray, steps: int, l1: float, least: float) -> tuple[np.ndarray, float]:
    """Proximal steps on the noisy-or loss; a weight above 0 does not fall below ``least``."""
    n, n_sent, floor = len(y), len(doc_of), np.where(w > 0, least, 0.0)
    m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
    scale = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, n - y.sum()))
    free = np.ones(len(w), dtype=bool) if not least else w > 0
    for k in range(1, steps + 1):
        z = b + np.bincount(sent_of, weights=w[feat], minlength=n_sent)
        p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        clean = np.exp(np.bincount(doc_of, weights=np.log1p(-np.minimum(p, 1 - 1e-9)), minlength=n))  # prod(1 - p)
        gain = np.where(y > 0, -clean / np.maximum(1 - clean, 1e-6), 1.0) * scale
        g = gain[doc_of] * p
        gw, gb = np.bincount(feat, weights=g[sent_of], minlength=len(w)), float(g.sum())
        m, v, mb, vb = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw * gw, 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb * gb
        rate, c1, c2 = 0.1, 1 - 0.9**k, 1 - 0.999**k
        step = rate / (np.sqrt(v / c2) + 1e-6)
        w = np.where(free, np.maximum(w - step * (m / c1 + l1), floor), 0.0)
        if not least:
            b = min(b - rate * (mb / c1) / (np.sqrt(vb / c2) + 1e-6), -2.0)
    return w, b


def score_text(text: str | None, model: dict) -> tuple[float, list[tuple[int, int, float]]]:
    """The document's score and (start, end, probability) of its sentences with some weighted word; offsets are code points."""
    if not text:
        return 0.0, []
    w, b = model["w"], model["b"]
    low = text.lower()
    if w.keys().isdisjoint(features(low)):
        return 0.0, []
    same, log_clean, spans = len(low) == len(text), 0.0, []
    for m in SENTENCE.finditer(text):
        own = w.keys() & features(low[m.start() : m.end()] if same else m[0].lower())
        if own:
            p = 1 / (1 + np.exp(-(b + sum(w[x] for x in sorted(own)))))
            log_clean += np.log1p(-min(p, 1 - 1e-9))
            spans.append((m.start(), m.end(), float(p)))
    return float(1 - np.exp(log_clean)), spans


def score_documents(docs: DataFrame, labels: DataFrame, label: str = "toxic", modulus: int = 4, held: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, score, predicted and the offending sentences (start, end, p; p >= threshold), from the whole text."""
    ship(docs.sparkSession)
    model = fit(*labelled_sample(docs, labels, label, modulus, held, PER_CLASS, MAX_CHARS))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = [score_text(t, model) for t in pdf["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": pdf["doc_id"],
                    "score": [s for s, _ in got],
                    "predicted": np.array([s >= threshold for s, _ in got], dtype="int32"),
                    "offending": [[{"start": a, "end": e, "p": p} for a, e, p in spans if p >= threshold] for _, spans in got],
                }
            )

    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double, predicted int, offending array<struct<start:int,end:int,p:double>>"
    return docs.select("doc_id", "text").mapInPandas(run, schema)
