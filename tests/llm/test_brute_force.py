"""Operators without SQL against brute force, exact round trips or held-out accuracy."""

import collections
import hashlib
import itertools
import random
import zlib

import numpy as np
import pandas as pd
import pytest
from spinel.llm import anisotropic, compression, forest, html, pieces, quality, queries, suffixes, toxicity
from spinel.llm.components import components


@pytest.fixture(scope="module")
def small():
    return "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def larger():
    return "/root/testdata/sf0.1"


def test_toxicity_held_out(spark, larger):
    rows = queries.op1_toxicity(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").filter("held_out AND toxic IS NOT NULL").collect()
    assert sum(r.predicted == r.toxic for r in rows) >= 0.95 * len(rows)


def test_toxicity_locates_sentences():
    texts = [f"plain words number {k}. you are a gleeb. more plain words here." for k in range(60)] + [f"plain words number {k}. nothing here. more plain words here." for k in range(60)]
    model = toxicity.fit(texts, np.array([1.0] * 60 + [0.0] * 60))
    score, spans = toxicity.score_text("fine. You GLEEB now! fine", model)
    assert score > 0.3 and [("fine. You GLEEB now! fine"[a:b]) for a, b, p in spans if p >= 0.3] == [" You GLEEB now"]
    assert toxicity.score_text("all is fine here.", model)[0] < 0.3


def test_quality_held_out(spark, larger):
    rows = queries.op3_quality(spark, larger).join(spark.read.parquet(f"{larger}/labels.parquet"), "doc_id").filter("held_out AND quality IS NOT NULL").collect()
    assert sum(r.predicted == r.quality for r in rows) >= 0.98 * len(rows)


def plain_features(text):
    """Every word, every n-gram inside a word with the space before and after it, and every repeated word."""
    words = text.split()
    grams = [f" {w} "[i : i + k] for w in words for k in quality.NGRAMS for i in range(len(w) + 3 - k)]
    return collections.Counter(words) + collections.Counter(grams), sum(a == b for a, b in itertools.pairwise(words))


@pytest.mark.parametrize("size", [1, 7, 64, quality.PIECE])
def test_quality_features_carry_over_cuts(monkeypatch, size):
    text = "the the cat " + "word " * 20 + "x" * 300 + " \t\nend end e" + "é字" * 9
    assert "".join(quality.pieces(text, size)) == text
    whole = np.sort(np.concatenate(list(quality.features(text))))
    expect, again = plain_features(text)
    assert len(whole) == sum(expect.values()) + again and len(np.unique(whole)) >= len(expect) - 2
    monkeypatch.setattr(quality, "PIECE", size)
    quality._TABLES.clear()
    assert (np.sort(np.concatenate(list(quality.features(text)))) == whole).all()
    quality._TABLES.clear()


@pytest.mark.parametrize("size", [quality.PIECE - 1, quality.PIECE + 1, quality.PIECE + 40_000])
def test_quality_beyond_a_piece(size):
    text = ("word word " * (size // 10 + 1))[:size]
    expect, again = plain_features(text)
    assert sum(map(len, quality.features(text))) == sum(expect.values()) + again


def test_compression_counts(spark, small):
    rows = queries.op2_compression_bands(spark, small).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in rows:
        t = texts[r.doc_id]
        words = t.encode().split()
        grams = collections.Counter(zip(words, words[1:], words[2:]))
        covered = {i + k for i, g in enumerate(zip(words, words[1:], words[2:])) if grams[g] > 1 for k in range(3)}
        seen, dup = set(), 0
        for line in t.split("\n"):
            if line.encode().split():
                dup += line in seen
                seen.add(line)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(words), sum(len(w.decode()) for w in words), sum(c in "#*$%&|<>" for c in t), dup, len(covered))
        assert r.base_failed == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r.base_failed and r.kept)


def test_compression_verdict(spark, larger):
    """The verdict from a plain reading of the rule; the bands reject texts that pass the base rule, and few of good quality."""
    import math

    import zstandard

    def limits(n, width):
        if n < 256:
            return 0, math.inf
        table = compression.PROSE
        (n0, r0), (n1, r1) = next(((p, q) for p, q in itertools.pairwise(table) if n <= q[0]), (table[-1], table[-1]))
        middle = r0 if n1 == n0 else r0 + (r1 - r0) * math.log(n / n0) / math.log(n1 / n0)
        return 0.78 * middle, 1.1 * middle * width

    def inside(raw, width):
        low, high = limits(len(raw), width)
        return low <= len(raw) / len(zstandard.compress(raw, 3)) <= high

    rows = {r.doc_id: r for r in queries.op2_compression_bands(spark, larger).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{larger}/labels.parquet").collect()}
    count = collections.Counter()
    for r in spark.read.parquet(f"{larger}/documents.parquet").orderBy("doc_id").collect():
        raw, good = r.text.encode(), False
        if raw:
            chunks = [c for c in (raw[i : i + 2048] for i in range(0, len(raw), 2048)) if len(c) >= 1024] if len(raw) >= 2048 else []
            out = sum(not inside(c, len(c) / max(1, len(c.decode("utf-8", "ignore")))) for c in chunks) if r.text.isascii() else rows[r.doc_id].n_chunks_outside
            good = inside(raw, len(raw) / len(r.text)) and out <= 0.2 * len(chunks)
        assert rows[r.doc_id].kept == (good and not rows[r.doc_id].base_failed)
        if not rows[r.doc_id].base_failed:
            count[labels.get(r.doc_id), good] += 1
    assert count[0, False] > 0.2 * count[0, True] and count[1, False] <= 0.002 * count[1, True]


def test_compression_bands():
    import zstandard

    z = zstandard.ZstdCompressor(level=compression.LEVEL)
    noise = random.Random(0).randbytes(9000)
    assert not compression.in_bands(b"the same again. " * 400, z)[3] and not compression.in_bands(noise, z)[3]
    assert not compression.in_bands("да это опять. ".encode() * 400, z)[3]
    assert compression.band(1024) == (0.78 * 1.86, 1.1 * 1.86) and compression.band(255)[1] == float("inf")
    assert compression.band(1 << 30) == (0.78 * 2.7, 1.1 * 2.7) and compression.band(1024, 2.0)[1] == 2.2 * 1.86


def test_forest_against_all_pairs(spark):
    rng = random.Random(3)
    docs = []
    for g in range(25):
        base = [f"w{rng.randrange(4000)}" for _ in range(60 + g)]
        for _ in range(1 + g % 6):
            t = list(base)
            for _ in range(rng.choice([0, 0, 1, 2, 8])):
                t[rng.randrange(len(t))] = f"w{rng.randrange(4000)}"
            docs.append((len(docs) * 7 % 1009, " ".join(t)))
    docs += [(2000 + k, "short text") for k in range(3)]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(max(1, len(t.split()) - 4))} for i, t in docs}
    links, parent = collections.Counter(), {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) - 1e-9:
            links[a] += 1
            links[b] += 1
            parent[max(find(a), find(b))] = min(find(a), find(b))
    got = forest.join_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {(r.doc_id, r.class_id, r.n_links) for r in got} == {(i, find(i), links[i]) for i in sets}


def test_forest_blocks_give_the_same():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 40, 30).astype(np.uint64)) for _ in range(12)]
    keys, copies, block = np.arange(12), rng.integers(1, 4, 12), np.arange(12) % 3
    whole, _ = forest.verify(sets, keys, copies, np.zeros(12, int), 0, 0, 0.6)
    parts = np.zeros(12, dtype=np.int64)
    for i in range(3):
        own = np.flatnonzero(block == i)
        parts[own] += forest.verify([sets[x] for x in own], keys[own], copies[own], block[own], i, i, 0.6)[0]
        for j in range(i + 1, 3):
            both = np.flatnonzero((block == i) | (block == j))
            parts[both] += forest.verify([sets[x] for x in both], keys[both], copies[both], block[both], i, j, 0.6)[0]
    assert (whole == parts).all()
    assert forest.prefix_depth() == next(d for d in range(forest.DEEPEST, 0, -1) if 1 - (1 - 0.8**d) ** forest.TREES >= forest.RECALL)


def test_forest_in_blocks_equals_all_pairs(spark, monkeypatch):
    """A large group of near copies in blocks that travel as values, and classes no longer than their blocks."""
    monkeypatch.setattr(forest, "BLOCK_CLASSES", 7)
    rng = random.Random(8)
    base = [f"w{k}" for k in range(80)]
    docs = []
    for k in range(60):
        t = list(base)
        for _ in range(rng.choice([1, 1, 2])):
            t[rng.randrange(80)] = f"x{rng.randrange(30)}"
        docs.append((k, " ".join(t)))
    docs += [(60 + k, " ".join(rng.choices(base, k=40))) for k in range(20)] + [(90, docs[3][1])]
    sets = {i: {tuple(t.split()[k : k + 5]) for k in range(len(t.split()) - 4)} for i, t in docs}
    links = {i: sum(j != i and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) - 1e-9 for j in sets) for i in sets}
    got = {r.doc_id: r.n_links for r in forest.join_documents(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == links and max(links.values()) > 20


def test_forest_depth_follows_the_links():
    low = forest.prefix_depth()
    assert forest.adapted_depth(np.zeros(0), low, forest.TREES, forest.RECALL) == low
    assert forest.adapted_depth(np.full(50, 0.97), low, forest.TREES, forest.RECALL) == forest.DEEPEST
    assert forest.adapted_depth(np.full(50, 0.8), low, forest.TREES, forest.RECALL) == low
    middle = forest.adapted_depth(np.full(50, 0.85), low, forest.TREES, forest.RECALL)
    assert low < middle < forest.DEEPEST and forest.expected_recall(np.full(9, 0.85), np.ones(9), middle + 1, forest.TREES) < forest.RECALL


def test_labels_agree_as_often_as_sets_do():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    b = np.concatenate([a[:360], rng.integers(0, 1 << 63, 40).astype(np.uint64)])
    x, y = forest.labels_of([a, b], 200)
    assert abs((x == y).mean() - 360 / 440) < 0.03
    assert forest.class_key(a) != forest.class_key(b) and len(forest.class_key(a)) == 16


def test_components_of_a_long_chain(spark):
    chain = [(k, k + 1) for k in range(1, 200)] + [(1000, 1001), (5, 5)]
    got = {r.node: r.root for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {k: 1 for k in range(1, 201)} | {1000: 1000, 1001: 1000}


def all_windows(docs):
    """By id: bytes, removed bytes, runs of them and the hash of the rest, from every window of 50 bytes."""
    seen, out = {}, {}
    for i, t in sorted(docs):
        b = t.encode()
        gone = np.zeros(len(b), dtype=bool)
        for j in range(len(b) - 49):
            if seen.setdefault(b[j : j + 50], i) < i:
                gone[j : j + 50] = True
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int(gone[:1].sum()) + int((gone[1:] & ~gone[:-1]).sum()), hashlib.sha256(kept).hexdigest())
    return out


@pytest.mark.parametrize(("hot", "chunk"), [(suffixes.HOT, suffixes.CHUNK), (suffixes.HOT, 60_000), (3, 60_000)])
def test_suffixes_against_all_windows(spark, small, monkeypatch, hot, chunk):
    for name, value in (("CHUNK", chunk), ("GRAMS_EACH", 4000), ("SUFFIXES_EACH", 2000)):
        monkeypatch.setattr(suffixes, name, value)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{small}/documents.parquet").orderBy("doc_id").limit(400).collect()]
    docs += [(10**6, "ab" * 100), (10**6 + 1, "x" + "ab" * 60 + "y"), (10**6 + 2, "a" * 120), (10**6 + 3, "b" + "a" * 50)]
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == all_windows(docs)


def test_suffixes_of_a_hot_passage(spark):
    """A passage in a third of the documents, in different surroundings; equal ids of old 32-bit marks keep apart."""
    rng = random.Random(4)
    words = [bytes(rng.choices(b"abcdefghij", k=3 + k % 6)).decode() for k in range(500)]
    passage = " ".join(rng.choices(words, k=18))
    docs = [(k, " ".join(rng.choices(words, k=12)) + (" " + passage if k % 3 == 0 else "") + " " + " ".join(rng.choices(words, k=6))) for k in [*range(900), 72296, 298816]]
    got = suffixes.remove_repeats(spark.createDataFrame(docs, "doc_id long, text string"), hot=50).collect()
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got} == all_windows(docs)
    frame = pd.DataFrame({"id": [i for i, _ in docs], "raw": [t.encode() for _, t in docs], "chunk": 0})
    c = suffixes.Chunk(frame).choose()
    assert c.count.max() > 200
    for flag, most in ((1, None), (2, 60)):  # items go out, not occurrences: a hot gram's surroundings hold little that differs
        c.items([suffixes.pack(np.where(c.count > 50, flag, 0).astype(np.uint8))], 64)
        parts = np.bincount(c.part)
        assert len(c.rows) < len(c.at) and (most is None or parts[c.part[np.argmax(np.diff(c.start))]] < most * suffixes.FAMILIES)


def test_loser_tree_merges_and_gives_prefixes():
    rng = random.Random(5)
    runs = [sorted(bytes(rng.choices(b"ab", k=16)) for _ in range(rng.randrange(0, 30))) for _ in range(7)]

    def common(x, y):
        return next((k for k in range(16) if x[k] != y[k]), 16)

    order, lcps = suffixes.merge_runs([(r, [0] + [common(a, b) for a, b in itertools.pairwise(r)] if r else []) for r in runs])
    at = [0] * 7
    out = []
    for r in order:
        out.append(runs[r][at[r]])
        at[r] += 1
    assert out == sorted(itertools.chain(*runs)) and lcps[1:] == [common(a, b) for a, b in itertools.pairwise(out)]


def test_front_coding_round_trip():
    rows = np.unique(np.random.default_rng(1).integers(0, 3, (200, 8)).astype(np.uint8), axis=0)
    lcp, rest = suffixes.front_code(rows)
    assert (suffixes.front_decode(lcp, np.frombuffer(rest, np.uint8), 8) == rows).all()


@pytest.fixture(scope="module")
def lattice():
    return pieces.Lattice(nbest=5)


@pytest.mark.parametrize("text", ["the cat", "Hello  world\n\tx", "é¼字 a", "aaaaaaa", "  x", "a\n\nb ", "in the\n", "co-operate, re."])
def test_nbest_against_all_segmentations(lattice, text):
    full = pieces.SPACE + text.replace(" ", pieces.SPACE)
    every = []

    def walk(i, score, ids):
        if i == len(full):
            every.append((score, ids))
            return
        for j in range(i + 1, len(full) + 1):
            got = lattice.score.get(full[i:j])
            if got:
                walk(j, score + got[1], (*ids, got[0]))
        if full[i] not in lattice.score:
            walk(i + 1, score + lattice.floor, ids + lattice.unknown(full[i]))

    walk(0, 0.0, ())
    every.sort(key=lambda x: -x[0])
    ids, scores, others = lattice.encode(text, variants=True)
    assert scores == [s for s, _ in every[:5]]
    known = {i for s, i in every if s >= scores[-1]}
    assert {tuple(ids), *map(tuple, others)} <= known and all(lattice.decode(np.array(i)) == text for i in [ids, *others])


def test_registered_encoding_returns_all_segmentations(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    got, text = queries.op10_sentencepiece(spark, "/root/testdata/sf0.001").collect(), {r.doc_id: r.text for r in docs.collect()}
    lat = pieces.Lattice(pieces.MODEL, 4)
    some = collections.defaultdict(list)
    for r in got:
        every = [r.ids, *r.variants]
        assert r.round_trip and len(every) == len(r.scores) == len({tuple(x) for x in every})
        some[len(r.scores)].append(r)
    assert len(some[4]) > 0.9 * len(got)
    for r in some[4][:40]:
        for ids in [r.ids, *r.variants]:
            assert lat.decode(np.array(ids)) == text[r.doc_id].replace(pieces.SPACE, " ")


def test_learned_parts_equal_single_ones(lattice):
    """One rule for ties in the forward pass over many parts, over one, and in the search."""
    rng = random.Random(1)
    words = {pieces.SPACE + "".join(rng.choices("abcdeouHnr$xß字é,", k=1 + k % 20)) for k in range(3000)} | {"▁Heouou$$$", "▁reonon$$$", "▁", "▁▁▁", "\n", "▁" + "ab$" * 40}
    for w in words:
        ids, _, _ = lattice.encode(w[1:])
        if w[0] == pieces.SPACE and w[1:]:
            first = lattice.first(w)
            assert tuple(ids) == tuple(first[1]) == lattice.search(w, 1)[0][1]
            n = lattice.known[w]
            assert (lattice.best[n], lattice.cost[n]) == (first[0], first[2])


@pytest.mark.parametrize("keep", [1, 3000, pieces.KEEP])
def test_kept_parts_change_nothing(spark, monkeypatch, keep):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").orderBy("doc_id").collect()]
    texts += ["Heouou$$$ reonon$$$ x", "word " * 700, "$" * 3000, None, "", "▁ ▁"]
    monkeypatch.setattr(pieces, "KEEP", keep)
    lat = pieces.Lattice(nbest=4)
    got = [lat.encode_group(texts[k : k + 9], True) for k in range(0, len(texts), 9)]
    plain = pieces.Lattice(nbest=4)
    flat, others = [], []
    for ids, bounds, _, other, ok in got:
        flat += [ids[a:b].tolist() for a, b in itertools.pairwise(bounds)]
        others += other
        assert all(ok)
    for text, ids, other in zip(texts, flat, others, strict=True):
        assert ids == [i for p in plain.split(text) for i in plain.search(p, 1)[0][1]]
        every = [tuple(ids), *map(tuple, other)]
        assert len(every) == len(set(every)) and all(plain.decode(np.array(i)) == (text or "").replace(pieces.SPACE, " ") for i in every)


def test_model_whose_pieces_cross_words(lattice):
    other = pieces.Lattice(nbest=3)
    assert other.apart
    other.apart = False  # as read from a model with such pieces: a text is one part
    for text in ("the cat sat", "a\nb  c", "in the $$"):
        assert other.encode(text)[1] == lattice.encode(text)[1][:3] and other.decode(other.encode(text)[0]) == text


def test_nearest_recall(spark, small):
    rows = spark.read.parquet(f"{small}/embeddings.parquet").orderBy("vec_id").collect()
    ids, v = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], dtype=np.float64)
    u = v / np.sqrt((v * v).sum(1, keepdims=True))
    got = collections.defaultdict(list)
    for r in anisotropic.search(spark.read.parquet(f"{small}/embeddings.parquet")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    hit = total = 0
    for q in ids[ids % 50 == 0]:
        s = np.round(u @ u[ids == q][0], 12)
        s[ids == q] = -9
        best = ids[np.lexsort((ids, -s))[:5]]
        hit, total = hit + len(set(best) & set(got[q])), total + 5
    assert hit >= 0.9 * total


def test_nearest_recall_in_clusters(spark):
    rng = np.random.default_rng(2)
    centres = rng.normal(size=(60, 32))
    v = (centres[rng.integers(0, 60, 20_000)] + 0.15 * rng.normal(size=(20_000, 32))).astype(np.float32)
    v[:6000] = v[0] + 0.001 * rng.normal(size=(6000, 32)).astype(np.float32)  # close together
    vectors = spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(v)), "embedding": [x.tolist() for x in v]}), "vec_id long, embedding array<float>")
    got = anisotropic.search(vectors).toPandas()
    w = v.astype(np.float64)
    u = w / np.sqrt((w * w).sum(1, keepdims=True))
    hit = 0
    for q, own in got.groupby("query_id"):
        s = u @ u[q]
        s[q] = -9
        hit += int((own["score"] >= np.sort(s)[-5] - 1e-9).sum())
        assert np.allclose(own.sort_values("rank")["score"], s[own.sort_values("rank")["vec_id"]], atol=1e-12)
    assert len(got) == 5 * 400 and hit >= 0.9 * len(got)


def test_codes_pack_two_a_byte():
    codes = np.random.default_rng(0).integers(0, 16, (9, 7)).astype(np.uint8)
    p = anisotropic.packed(codes)
    assert p.shape == (9, 4) and (p[:, :3] & 15 == codes[:, 0:6:2]).all() and (p[:, :3] >> 4 == codes[:, 1:7:2]).all() and (p[:, 3] == codes[:, 6]).all()


def test_html_without_semantic_elements(spark):
    def page(k):
        body = " ".join(f"body{k}word{i}" for i in range(40))
        return f"<html><body><div class=top><a href=/>Home</a><a href=/a>About us</a></div><div class=c><p>{body}</p><p>second {k}</p></div><div class=bottom>All rights reserved by us</div></body></html>"

    pages = spark.createDataFrame([(k, "http://site.org/x", page(k)) for k in range(12)], "page_id long, url string, html string")
    for r in html.extract_pages(pages).collect():
        assert r.text == " ".join(f"body{r.page_id}word{i}" for i in range(40)) + f" second {r.page_id}"


def test_html_unlabelled_siblings(spark):
    def body(k):
        return [f"page{k} paragraph{i} " + "word " * 8 for i in range(3 + k % 4)]

    def page(k):
        return f"<body><div>Home About</div><div>{' '.join(body(k))}</div><div>All rights reserved</div></body>"

    def noted(k):
        ps = [f"<p>{x}</p>" for x in body(k)]
        return f"<body><div><p>{k} title</p>{''.join(ps[:2])}<p>Read our notice</p>{''.join(ps[2:])}</div></body>"

    rows = [(k, "http://a.org/x", page(k)) for k in range(12)] + [(100 + k, "http://b.org/x", noted(k)) for k in range(12)]
    for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        k = r.page_id % 100
        assert r.text == (f"{k} title " if r.page_id >= 100 else "") + " ".join(" ".join(body(k)).split())


@pytest.mark.parametrize("tag", ["div", "article"])
def test_html_wrapper_decides(spark, tag):
    """Two layouts on one host, an error page, a notice that no mark gives away, and copies of one article on half of the pages."""

    def article(k):
        return "copied text " * 9 if k % 2 else f"own text {k} " * 9

    def page(k):
        top = "<section class=a><p>Our shop sells tea</p></section>" if k < 20 else "<section class=b><p>Write to us</p><p>By post</p></section>"
        return f"<html><body>{top}<div class=c><{tag}><h1>title {k}</h1><p>{article(k)}</p><p>date {k}</p></{tag}></div><section class=z><p>All rights reserved</p></section></body></html>"

    rows = [(k, "http://c.org/x", page(k)) for k in range(40)] + [(90, "http://c.org/x", "<html><body></body></html>"), (91, "http://c.org/x", "")]
    got = {r.page_id: r for r in html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(40):
        assert got[k].text == f"title {k} {article(k).strip()} date {k}" and got[k].by_wrapper
    if tag == "div":
        assert html.extract(page(1)) != got[1].text  # without its wrapper
    assert got[90].text == got[91].text == ""


def test_html_different_texts_are_counted():
    for n in (1, 2, 9, 60):
        bits = 0
        for k in range(n):
            bits |= 1 << ((zlib.crc32(str(k).encode()) * 0x9E3779B1 >> 16) % html.BITS)
        assert 0.75 * n <= html.different(bits) <= 1.25 * n


def test_html_matching_is_largest():
    def tree(rnd, depth):
        return "".join(f"<{t}>{tree(rnd, depth - 1) if depth else ''}</{t}>" for t in rnd.choices(["div", "section", "ul"], k=rnd.randrange(4)))

    def most(a, b):
        if a.label != b.label:
            return 0
        m = collections.defaultdict(int)
        for i, x in enumerate(a.kids, 1):
            for j, y in enumerate(b.kids, 1):
                m[i, j] = max(m[i - 1, j], m[i, j - 1], m[i - 1, j - 1] + most(x, y))
        return 1 + m[len(a.kids), len(b.kids)]

    rnd = random.Random(1)
    for _ in range(300):
        a, b = (html.flatten(html.parse(tree(rnd, 3)))[0] for _ in range(2))
        assert html._weigh(a, b) == most(a, b) >= len(html.match(a, b))


@pytest.mark.parametrize("depth", [10, 160, 3000])
def test_html_deep_elements(depth):
    def page(k):
        return f"<body><div id=page><article>{'<div>' * depth}head {k}<nav>menu</nav><div class=ad>buy</div>{'</div>' * depth}<p>tail {k}</p></article></div>"

    assert html.extract(page(1)) == "head 1 tail 1"
    ref, other = html.flatten(html.parse(page(1))), html.flatten(html.parse(page(2) + "<div>" * depth))
    assert len(html.match(html.load(html.dump(ref))[0], other[0])) == len(ref)


def test_html_article_rules():
    text = "<body><header>Site</header><nav>menu</nav><article><header><h1>T</h1></header><p>One<script>x='</p>'</script> <b>two</b><p>three &eacute;<ul><li>a<li>b</ul><div class='comments'>no</div><form>no</form><!-- no --></article><aside>no</aside>"
    assert html.extract(text) == "T One two three é a b"


def test_toxicity_scores_as_it_was_fitted(spark, small):
    """The noisy-or that the second part of the fit minimises, written out over its own sentences."""
    docs = spark.read.parquet(f"{small}/documents.parquet")
    model = toxicity.fit(*toxicity.labelled_sample(docs, spark.read.parquet(f"{small}/labels.parquet"), "toxic", 4, 2, 600, 20_000))
    assert model["w"] and min(model["w"].values()) >= toxicity.LEAST
    for r in docs.select("text").collect():
        clean = 1.0
        for sentence in toxicity.SENTENCE.findall((r.text or "").lower()):
            own = [model["w"][f] for f in toxicity.features(sentence) if f in model["w"]]
            clean *= 1 - 1 / (1 + np.exp(-(model["b"] + sum(own)))) if own else 1.0
        assert abs(toxicity.score_text(r.text, model)[0] - (1 - clean)) < 1e-9


@pytest.mark.parametrize("own", ['<div id="post-{k}">', '<div class="post post-{k}">', '<div id=post{k} class="entry p{k}x big">', '<div id="content">'])
def test_html_pages_with_numbers_of_their_own(spark, own):
    """Ids and classes that carry a page's number don't part the pages of a host."""
    rows = [(k, f"http://blog.example/{k}", f"<body><div>Home About Contact</div>{own.format(k=k)}<p>Unique story {k} of the fox {k * 7919} that ran</p></div><div>All rights reserved by the firm</div></body>") for k in range(60)]
    got = html.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    assert {r.text for r in got} == {f"Unique story {k} of the fox {k * 7919} that ran" for k in range(60)} and all(r.by_wrapper for r in got)
