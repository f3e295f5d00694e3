"""Language codes: the code's own rules, decoding against a plain version, held-out accuracy, defined cases."""

import itertools
import math

import numpy as np
import pytest
from spinel.llm import codes, queries


@pytest.mark.parametrize("n", [2, 3, 4, 6, 7, 20, 60])
def test_codewords(n):
    m = codes.codewords(n).astype(int)
    assert set(np.unique(m)) <= {-1, 1} and all(abs(c.sum()) < n for c in m.T)
    assert not any((a == b).all() or (a == -b).all() for a, b in itertools.combinations(m.T, 2))
    least = min(int((a != b).sum()) for a, b in itertools.combinations(m, 2))
    assert least >= (2 ** (n - 2) if n <= codes.EXHAUSTIVE else m.shape[1] // 4)


def test_an_error_in_a_bit_is_corrected():
    code = codes.codewords(4)
    model = {"langs": list("abcd"), "code": code, "w": np.ones(7)}
    for k, bit in itertools.product(range(4), range(7)):
        z = 4.0 * code[k]
        z[bit] *= -1
        lang, score, _, gap, ambiguous = codes.decode(z, model)
        assert lang == "abcd"[k] and score > 0.5 and gap > 0 and not ambiguous
    assert codes.decode(np.zeros(7), model)[4] and codes.decode(2.0 * code[0] + 2.0 * code[1], model)[4]


def test_held_out(spark):
    sf = "/root/testdata/sf0.1"
    rows = queries.op11_language(spark, sf).join(spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang"), "doc_id").filter("held_out AND lang IS NOT NULL").collect()
    right = [r for r in rows if r.lang_pred == r.lang]
    assert len(right) >= 0.98 * len(rows) and all(0 <= r.score <= 1 for r in rows)
    assert sum(r.ambiguous for r in right) < 0.05 * len(right)


def test_decoding_against_plain(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    texts, langs = codes.language_sample(docs, 3, 1)
    model = codes.fit(texts, langs)
    got = {r.doc_id: r for r in codes.identify(docs).collect()}
    for r in docs.limit(100).collect():
        ids = [int(f) & (codes.BUCKETS - 1) for part in codes.features(r.text.lower()) for f in part]
        z = [float(model["b"][k]) + math.fsum(float(model["u"][i, k]) for i in ids) / len(ids) for k in range(model["code"].shape[1])]
        d = {g: sum(w * math.log1p(math.exp(-int(m) * x)) for w, m, x in zip(model["w"], row, z, strict=True)) for g, row in zip(model["langs"], model["code"], strict=True)}
        near = sorted(d, key=lambda g: (d[g], g))
        own = got[r.doc_id]
        assert (own.lang_pred, own.runner_up) == tuple(near[:2]) and abs(own.gap - (d[near[1]] - d[near[0]])) < 1e-4
        assert abs(own.score - 1 / sum(math.exp(d[near[0]] - x) for x in d.values())) < 1e-4


def test_sample_is_bounded_and_leaves_out_the_fold(spark, monkeypatch):
    monkeypatch.setattr(codes, "PER_LANGUAGE", 40)
    rows = [(k % 3000, f"text number {k % 3000} of many", "a" if k % 10 else "b") for k in range(9000)] + [(None, "null id", "c"), (1, None, "d"), (2, "", "e"), (5, "no language", None)]
    texts, langs = codes.language_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), 3, 1)
    assert {g: langs.count(g) for g in set(langs)} == {"a": 40, "b": 40} and len(set(zip(texts, langs, strict=True))) == 80


def test_odd_rows(spark):
    long = "el perro y la casa de los señores " * 20_000
    rows = [(k, "the house and the dog of the town " * 3, "en", 1, "x") for k in range(40)] + [(k, "la casa y el perro de los señores " * 3, "es", 1, "x") for k in range(40, 80)]
    rows += [(100, None, "en", 1, "x"), (101, "", "en", 1, "x"), (102, "123 ?! \n", "en", 1, "x"), (103, long, None, 1, "x"), (None, "the town", "en", 1, "x"), (104, "la casa", "es", 1, "x"), (104, "la casa", "es", 1, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, score int, source string")
    out = codes.identify(df)
    assert out.columns == ["doc_id", "text", "lang", "source", *codes.ADDED]
    got = [(r.doc_id, r.lang_pred, r.score) for r in out.collect()]
    assert len(got) == len(rows) and {(100, "und", 0.0), (101, "und", 0.0), (102, "und", 0.0)} <= set(got)
    assert {g for i, g, _ in got if i in (103, 104)} == {"es"} and [g for i, g, _ in got if i is None] == ["en"] and len([1 for i, *_ in got if i == 104]) == 2
    assert {(r.lang_pred, r.score) for r in codes.identify(df.filter("doc_id < 40")).collect()} == {("en", 1.0)}
    unlearned = codes.identify(df.filter("doc_id = 103"))
    assert [(r.lang_pred, r.score) for r in unlearned.collect()] == [("und", 0.0)]
    assert codes.identify(df.filter("doc_id > 999")).count() == 0
