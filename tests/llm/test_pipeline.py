"""Each pipeline stage on its own input against a plain version."""

import collections

import corpus_pipeline as p
import pytest
from spinel.llm import quality
from spinel.llm.staging import staged


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = [docs]
    for k, (_, stage) in enumerate(p.STAGES):
        out.append(staged(stage(spark, out[-1], sf), f"test-{k}"))
    return out


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_columns(stages):
    assert all(s.columns == stages[0].columns for s in stages[1:-1])


def test_quality_stage(spark, stages):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    accepted = {r.doc_id for r in quality.score_documents(stages[0], labels).filter("score >= 0.3").collect()}
    assert {r["doc_id"] for r in rows(stages[1])} == accepted


def test_line_stage(stages):
    seen, expect = set(), {}
    for r in sorted(rows(stages[1]), key=lambda r: r["doc_id"]):
        lines = r["text"].split("\n")
        own = [k for k, x in enumerate(lines) if x.split()]
        gone, later = set(), set()
        for a in range(len(own) - 2):
            key = tuple(lines[k].strip(" \t\n\x0b\f\r") for k in own[a : a + 3])
            if key in seen or key in later:
                gone.update(own[a : a + 3])
            later.add(key)
        seen |= later
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone)
        if not gone or text.split():
            expect[r["doc_id"]] = text
    assert {r["doc_id"]: r["text"] for r in rows(stages[2])} == expect


def test_near_duplicate_stage(stages):
    sets = {}
    for r in rows(stages[2]):
        w = r["text"].split()
        sets[r["doc_id"]] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    assert sorted(r["doc_id"] for r in rows(stages[3])) == sorted(i for i in ids if find(i) == i)


def test_mixing_stage(stages):
    size = {r["doc_id"]: (r["source"], len(r["text"].encode().split())) for r in rows(stages[3])}
    by, taken = collections.Counter(), collections.Counter()
    largest = collections.Counter()
    for s, n in size.values():
        by[s] += n
        largest[s] = max(largest[s], n)
    copies = collections.Counter(r["doc_id"] for r in rows(stages[4]))
    for i, c in copies.items():
        assert c <= 3
        taken[size[i][0]] += c * size[i][1]
    weight = {s: k % 3 + 1 for k, s in enumerate(sorted(by))}
    total, target, held = sum(by.values()), {}, set()
    while True:
        free = sum(w for s, w in weight.items() if s not in held)
        left = total - sum(3 * by[s] for s in held)
        target = {s: 3 * by[s] if s in held else left * weight[s] / free for s in by}
        more = {s for s in by if target[s] > 3 * by[s]}
        if not more:
            break
        held |= more
    assert all(abs(taken[s] - target[s]) <= largest[s] for s in by)


def test_encoding_stage(stages):
    got, docs = rows(stages[5]), rows(stages[4])
    assert collections.Counter(r["doc_id"] for r in got) == collections.Counter(r["doc_id"] for r in docs) and all(r["round_trip"] for r in got)


ODD = [
    (1, "good words in a row of seven", "en", "a", 28, 0.5, 7),
    (1, "good words in a row of seven", "en", "a", 28, 0.5, 7),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 0.1, 1),
    (None, "a text without an id", "en", "b", 20, 0.1, 1),
    (4, "long text " * 30_000, "en", "c", 300_000, 0.1, 1),
    (5, "l1 x\nl2 x\nl3 x\nl4 y", "de", "c", 19, 0.1, 1),
    (6, "l1 x\nl2 x\nl3 x\nl4 z", "de", "c", 19, 0.1, 1),
]
ODD_SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, n_removed long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    sf = str(tmp_path_factory.mktemp("odd"))
    docs = spark.createDataFrame(ODD, ODD_SCHEMA)
    docs.write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (5, 1, 0), (4, 0, 1), (7, None, None)], "doc_id long, quality int, toxic int").write.parquet(f"{sf}/labels.parquet")
    return docs, sf


def test_stages_take_odd_rows(spark, odd):
    docs, sf = odd
    own = [r.asDict() for r in docs.collect()]
    for name, stage in p.STAGES[:-1]:
        got = stage(spark, docs, sf)
        assert got.columns == docs.columns, name
        back = [r.asDict() for r in got.collect()]
        assert all(any(all(r[c] == o[c] for c in docs.columns if c not in ("text", "n_chars")) for o in own) for r in back), name
    lines_left = {r.doc_id: (r.text, r.n_chars, r.n_removed) for r in p.line_stage(spark, docs, sf).collect()}
    assert lines_left[6] == ("l4 z", 4, 1) and lines_left[5] == ("l1 x\nl2 x\nl3 x\nl4 y", 19, 1) and lines_left[2][0] is None
    kept = sorted((r.doc_id or 0) for r in p.near_duplicate_stage(spark, docs, sf).collect())
    assert kept == [0, 1, 2, 3, 4, 5, 6]
    assert len(p.encoding_stage(spark, docs, sf).collect()) == len(ODD)


def test_stages_take_no_rows(spark, odd):
    docs, sf = odd
    none = docs.limit(0)
    for name, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0, name


def test_run_on_odd_rows(spark, odd):
    assert p.run(spark, odd[1]).filter("NOT round_trip").count() == 0
