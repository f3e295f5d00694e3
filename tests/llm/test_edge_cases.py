"""Nulls, empty and long texts, repeated rows, empty tables and clashing column names, for every operator."""

import pytest
from spinel.llm import anisotropic, compression, forest, html, lines, mixing, pieces, quality, suffixes, toxicity

LONG = "alpha beta gamma delta epsilon zeta eta theta iota kappa. " * 3000
ROWS = [
    (1, "one two three four five six seven", "en", "a", 1, 5, 9),
    (1, "one two three four five six seven", "en", "a", 1, 5, 9),
    (2, None, None, None, None, None, None),
    (3, "", "en", "b", 0, 1, 1),
    (4, " \n\t ", "en", "b", 4, 1, 1),
    (None, "a null id", "en", "b", 9, 1, 1),
    (5, LONG, "de", "c", len(LONG), 1, 1),
    (6, "l1 x\nl2 x\nl3 x\nl4 x", "de", "c", 19, 1, 1),
    (7, "l1 x\nl2 x\nl3 x\nl4 x", "de", "c", 19, 1, 1),
]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score long"
LABELS = [(1, 1, 0), (5, 0, 1), (6, 1, 0), (7, None, None), (99, 1, 1), (1, 1, 0)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int")


def test_toxicity(docs, none, labels):
    got = toxicity.score_documents(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r.score <= 1 for r in got)
    assert {r.score for r in got if r.doc_id in (2, 3, 4)} == {0.0}
    assert toxicity.score_documents(none, labels).count() == 0


def test_quality(docs, none, labels):
    got = quality.score_documents(docs, labels)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "score", "predicted"]
    rows = got.collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({r.score for r in rows if r.doc_id in (2, 3, 4)}) == 1
    assert quality.score_documents(none, labels).count() == 0


def test_compression(docs, none):
    rows = {r.doc_id: r for r in compression.judge_documents(docs).collect()}
    assert rows[2].n_words == rows[3].n_words == rows[4].n_words == 0 and rows[2].base_failed and not rows[2].kept
    assert rows[5].base_failed and rows[5].n_repeat_words == rows[5].n_words == 30000
    assert compression.judge_documents(none).count() == 0


def test_lines(docs, none):
    got = lines.dedup_lines(docs)
    assert got.columns[:7] == docs.columns and got.count() == len(ROWS)
    rows = {r.doc_id: r for r in got.collect()}
    assert rows[6].n_removed == 0 and rows[7].n_removed == 4 and rows[7].text == "" and rows[2].text is None
    assert lines.dedup_lines(none).count() == 0


def test_mixing(docs, none):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(ROWS) and rows[0].asDict().keys() >= {"doc_id", "text", "size", "source_size", "target", "copies"}
    assert all(r.copies <= 3 for r in rows)
    mixed = mixing.mixed_rows(docs)
    assert mixed.columns == docs.columns and {r.size for r in mixed.collect()} <= {None, 1, 5}
    assert mixing.mix(none).count() == 0 and mixing.mixed_rows(none).count() == 0


def test_forest(docs, none):
    rows = forest.join_documents(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[7].class_id == 6 and by[6].n_links == by[7].n_links == 1 and by[1].n_links == 1 and by[2].n_links == 0 and by[3].class_id == 3
    kept = forest.one_of_each(docs)
    assert kept.columns == docs.columns
    assert sorted((r.doc_id or 0) for r in kept.collect()) == [0, 1, 2, 3, 4, 5, 6]
    assert forest.join_documents(none).count() == 0 and forest.one_of_each(none).count() == 0


def test_suffixes(docs, none):
    rows = suffixes.remove_repeats(docs).collect()
    assert len(rows) == len(ROWS)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_bytes == 0 and by[5].n_removed == 0 and by[5].kept == LONG.encode()
    assert suffixes.remove_repeats(none).count() == 0


def test_pieces(docs, none):
    rows = pieces.encode_documents(docs).collect()
    assert len(rows) == len(ROWS) and all(r.round_trip for r in rows)
    by = {r.doc_id: r for r in rows}
    assert by[2].n_pieces == by[3].n_pieces == 0 and by[2].scores == [0.0]
    back = {r.doc_id: r.text for r in pieces.decode_documents(pieces.encode_documents(docs)).collect()}
    assert back[5] == LONG and back[2] == "" and back[4] == " \n\t "
    assert pieces.encode_documents(none).count() == 0


def test_html(spark):
    rows = [(1, "http://a.org/x", None), (2, None, "<p>hello</p>"), (3, "http://a.org/y", ""), (4, "nonsense", "<div>" * 2000 + "deep"), (4, "nonsense", "<div>" * 2000 + "deep"), (None, "http://a.org/z", "<article><p>a&amp;b<br>c</article>")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in html.extract_pages(pages).collect())
    assert got == [(0, "a&b c", 5), (1, "", 0), (2, "hello", 5), (3, "", 0), (4, "deep", 4), (4, "deep", 4)]
    assert html.extract_pages(pages.limit(0)).count() == 0


def test_nearest(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [0.0, 1.0]), (3, None), (4, [0.0, 0.0]), (5, [nan, 1.0]), (6, [inf, 0.0]), (7, [1.0, None]), (8, [1.0]), (9, [3.0, 0.0]), (9, [3.0, 0.0]), (50, [1.0, 1.0]), (None, [1.0, 1.0])]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in anisotropic.search(vectors).orderBy("query_id", "rank").collect()]
    assert got[:5] == [(0, 1, 1, 1.0), (0, 2, 9, 1.0), (0, 3, 50, 0.707107), (0, 4, 2, 0.0), (50, 1, 0, 0.707107)]
    assert anisotropic.search(vectors.limit(0)).count() == 0


def test_html_class_names_and_hidden_text():
    from spinel.llm.html import extract

    assert extract('<div class="layout no-sidebar"><p>one</p></div>') == "one"
    assert extract('<article class="post has-comments">one</article>') == "one"
    assert extract('<article><div class="article-header">Title</div><p class="market-share">text</p></article>') == "Title text"
    assert extract('<div class="share"><article>one</article></div><div class="site-footer">no</div><div id="cookie-banner">no</div>') == "one"
    assert extract('<article>one</article><div class="comments"><article class="comment">no</article></div>') == "one"
    assert extract('<p hidden>one<p style="display: none">two <math><mi>x</mi></math>') == "one two x"


def test_mixing_of_rows_that_repeat(spark):
    rows = [(1, "one two three four", "a", 0)] * 600 + [(k, "one two three", "a", 0) for k in range(2, 202)] + [(1000 + k, "five words are in it", "b", 0) for k in range(100)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, mix_h int").repartition(5)
    got = mixing.mix(df, spark.createDataFrame([("a", 1.0), ("b", 2.0)], "source string, weight double")).collect()
    assert len(got) == len(rows) and set(got[0].asDict()) == {"doc_id", "text", "source", "mix_h", "size", "source_size", "target", "copies"}
    for s in "ab":
        own = [r for r in got if r.source == s]
        assert abs(sum(r["size"] * r.copies for r in own) - own[0].target) <= 5 and max(r.copies for r in own) <= 3
    assert {len({r.copies for r in got if r.doc_id == 1}), 2} == {2}
    mixed = mixing.mixed_rows(df.withColumnRenamed("mix_h", "size"))
    assert mixed.columns == ["doc_id", "text", "source", "size"]


def test_line_dedup_of_rows_that_repeat(spark):
    text = "\n".join(f"line number {k % 40}" for k in range(60))
    df = spark.createDataFrame([(5, text, 1)] * 3000 + [(1, "\n".join(f"line number {k}" for k in range(3, 9)), 2), (6, text + "\nend", 3)], "doc_id long, text string, n_lines int").repartition(4)
    got = {(r.doc_id, r.n_lines, r.n_removed) for r in lines.dedup_lines(df).collect()}
    # the first forty lines are new but for those of document 1; the last twenty repeat
    assert got == {(5, 60, 26), (1, 6, 0), (6, 61, 60)}


def test_suffixes_of_rows_that_repeat(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "REPEATED", 20)
    a, b = "the first passage of more than fifty bytes, which others hold too. ", "another passage that is also longer than fifty bytes, by a little. "
    rows = [(5, a + b, "x")] * 50 + [(None, a, "y")] * 30 + [(5, a, "z")] * 3 + [(1, b, "w"), (7, a + "end", "v")]
    got = sorted(((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, times string").repartition(4)).collect()))
    want = [(1, len(b), 0)] + [(5, len(a), 0)] * 3 + [(5, len(a + b), len(b))] * 50 + [(7, len(a) + 3, len(a))] + [(99, len(a), len(a))] * 30
    assert [g[:2] for g in got] == [w[:2] for w in sorted(want)]
    monkeypatch.setattr(suffixes, "REPEATED", 1000)
    plain = sorted(((r.doc_id or 99, r.n_bytes, r.n_removed) for r in suffixes.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string, times string")).collect()))
    assert got == plain


def test_nearest_of_rows_that_repeat(spark):
    rows = [(50, [1.0, 0.0], 0)] * 40 + [(1, [1.0, 0.1], 0)] * 40 + [(1, [0.0, 1.0], 0), (2, [1.0, 0.2], 0), (100, [0.0, 1.0], 0)]
    got = anisotropic.search(spark.createDataFrame(rows, "vec_id long, embedding array<double>, rank int"), k=3).collect()
    assert [(r.query_id, r["rank"], r.vec_id) for r in sorted(got, key=lambda r: (r.query_id, r["rank"]))] == [(50, 1, 1), (50, 2, 2), (50, 3, 100), (100, 1, 1), (100, 2, 2), (100, 3, 50)]
