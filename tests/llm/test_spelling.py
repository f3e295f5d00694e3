"""Spelling variants against all pairs of words, and their defined cases."""

import itertools
import random
import re
import zlib
from collections import Counter

import pytest
from spinel.llm import queries, spelling


def plain_words(docs):
    count = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda c: c[0].lower(), run)
            h = zlib.crc32(f"{i}:{run}".encode())
            if i is not None and h % 97 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            count[run] += 1
    return {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}


def edits(word, letters):
    for i in range(len(word) + 1):
        yield word[:i] + word[i + 1 :]
        for c in letters:
            yield word[:i] + c + word[i:]
            yield word[:i] + c + word[i + 1 :]


def plain(docs):
    count = plain_words(docs)
    letters = set("".join(count))
    form = {}
    for w in count:
        near = {x for x in edits(w, letters) if x in count} - {w}
        best = min(near, key=lambda x: (-count[x], x), default=None)
        form[w] = (best if best and count[best] >= 2 * count[w] else None, len(near))
    out = []
    for w, (f, near) in form.items():
        root = w
        while form[root][0]:
            root = form[root][0]
        out.append((w, f, root, count[w], near, count[f] if f else None))
    return sorted(out)


def got(df):
    return sorted(tuple(r) for r in df.collect())


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()
    want = plain(docs)
    assert got(queries.op12_spelling_variants(spark, "/root/testdata/sf0.01")) == want and sum(r[4] > 0 for r in want) > 100


@pytest.mark.parametrize(("largest", "few"), [(256, 8), (12, 3), (7, 1)])
def test_skewed_blocks(spark, monkeypatch, largest, few):
    """Long common beginnings and ends, so that blocks hold a large part of the words, and words of one run of letters."""
    monkeypatch.setattr(spelling, "LARGEST", largest)
    monkeypatch.setattr(spelling, "FEW", few)
    rng = random.Random(largest)
    words = ["".join(p) for p in itertools.product("ab", repeat=6)] + ["commonbegin" + "".join(p) for p in itertools.product("xyzé", repeat=3)] + ["".join(p) + "commonend" for p in itertools.product("xy", repeat=5)]
    words += ["a" * k for k in range(5, 40)] + ["ab" * 30, "ab" * 30 + "a", "Straße", "STRASSE", "straße"]
    docs = [(k, " ".join(w for w in words for _ in range(rng.randint(1, 3)))) for k in range(12)]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    assert got(spelling.variants(df)) == plain(docs)


def test_one_edit_at_its_place():
    assert spelling.one_edit("abcde", "abxde", 0, 5) and not spelling.one_edit("abcde", "abxde", 0, 2)
    assert spelling.one_edit("aaab", "aaaab", 1, 5) and spelling.one_edit("abcd", "abcde", 2, 5) and not spelling.one_edit("abcd", "abdce", 0, 5)


def test_odd_rows(spark):
    long = "verylongword otherword " * 50_000
    rows = [(1, None, 1), (2, "", 2), (3, "hello hello hello", 3), (3, "hello hello hello", 3), (None, "hellos hellos hellos", 4), (5, long, 5), (6, "1234 _ \n\t", 6)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n long")
    assert got(spelling.variants(df)) == plain([r[:2] for r in rows])
    assert {r.word: r.root for r in spelling.variants(df).collect()}["hellos"] == "hello"
    none = spelling.variants(df.filter("n > 9"))
    assert none.count() == 0 and none.columns == ["word", "form", "root", "n", "n_near", "form_n"]
