"""Lovász-softmax and seeded augmentation against plain versions."""

import numpy as np
import pytest
from pyspark.sql import functions as F
from spinel.functions import images
from spinel.operators import loss


def plain_loss(labels, probs, cls):
    own = (labels == cls).astype(float)
    e = np.abs(own - probs[:, cls])
    order = np.argsort(-e, kind="stable")
    own, e = own[order], e[order]
    jaccard = 1 - (own.sum() - own.cumsum()) / (own.sum() + (1 - own).cumsum())
    return float((e * np.diff(jaccard, prepend=0.0)).sum())


@pytest.mark.parametrize(("parts", "saturated"), [(1, False), (6, False), (6, True)])
def test_lovasz(spark, parts, saturated):
    rng = np.random.default_rng(parts)
    labels, probs = rng.integers(0, 4, 900), rng.dirichlet(np.ones(6), 900)
    if saturated:
        probs = (probs == probs.max(1, keepdims=True)).astype(float)
    df = spark.createDataFrame([(int(g), [float(x) for x in p]) for g, p in zip(labels, probs, strict=True)] + [(None, [1.0] * 6), (2, None)], "label int, p array<double>")
    got = {r.cls: r.loss for r in loss.lovasz_softmax(df, parts=parts).collect()}
    assert set(got) == {0, 1, 2, 3} and all(abs(got[c] - plain_loss(labels, probs, c)) < 1e-9 for c in got)
    every = {r.cls: r.loss for r in loss.lovasz_softmax(df, only_present=False, parts=parts).collect()}
    assert set(every) == set(range(6)) and all(abs(every[c] - plain_loss(labels, probs, c)) < 1e-9 for c in every)
    assert abs(loss.mean_loss(loss.lovasz_softmax(df, parts=parts)).first().loss - np.mean(list(got.values()))) < 1e-9


def test_lovasz_by_image_and_without_a_class(spark):
    rng = np.random.default_rng(5)
    image, labels, probs = rng.integers(0, 3, 400), rng.integers(0, 3, 400), rng.dirichlet(np.ones(3), 400)
    df = spark.createDataFrame([(int(i), int(g), [float(x) for x in p]) for i, g, p in zip(image, labels, probs, strict=True)], "image int, label int, p array<double>")
    for r in loss.lovasz_softmax(df, ["image"], ignore=1, parts=4).collect():
        use = (image == r.image) & (labels != 1)
        assert r.cls != 1 and abs(r.loss - plain_loss(labels[use], probs[use], r.cls)) < 1e-9
    perfect = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0])], "label int, p array<double>")
    assert [r.loss for r in loss.lovasz_softmax(perfect).collect()] == [0.0, 0.0]
    assert loss.lovasz_softmax(perfect.filter("label > 5")).count() == 0


def test_no_window_without_parts(spark):
    df = spark.createDataFrame([(k % 3, [0.2, 0.3, 0.5]) for k in range(50)], "label int, p array<double>")
    plan = loss.lovasz_softmax(df, parts=4)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.split("\n") if "Window" in line]
    assert windows and all("_part" in line for line in windows)


@pytest.mark.parametrize("seed", range(4))
def test_augment_is_numpy_s(spark, seed):
    h, w, ch, cw = 7, 9, 4, 6
    rows = [(k, [float(k + x) for x in range(h * w)], list(range(h * w))) for k in range(40)]
    df = spark.createDataFrame(rows, "id int, image array<double>, mask array<int>")
    made = images.augment(df, "id", "image", "mask", (h, w), (ch, cw), seed=seed, quarters=True)
    key = F.col("id")
    picks = [images.below(key, seed, p, n) for p, n in (("y", h - ch + 1), ("x", w - cw + 1), ("h", 2), ("v", 2), ("quarters", 4))]
    chosen = {r[0]: r[1:] for r in df.select("id", *picks).collect()}
    assert len({c[4] for c in chosen.values()}) == 4
    for r in made.collect():
        y, x, fx, fy, t = chosen[r.id]
        a = np.arange(h * w).reshape(h, w)[y : y + ch, x : x + cw]
        a = np.rot90(a[:: -1 if fy else 1, :: -1 if fx else 1], t)
        assert r.mask == a.ravel().tolist() and r.image == (a + r.id).astype(float).ravel().tolist() and (r.height, r.width) == a.shape
    assert made.collect() == images.augment(df.repartition(3), "id", "image", "mask", (h, w), (ch, cw), seed=seed, quarters=True).orderBy("id").collect()


def test_rotation_and_brightness(spark):
    df = spark.createDataFrame([(90.0,), (0.0,), (180.0,), (37.0,)], "d double")
    h = w = 5
    for d, at in ((r.d, r.at) for r in df.select("d", images.turned_places(h, w, F.col("d")).alias("at")).collect()):
        cos, sin = np.cos(np.radians(d)), np.sin(np.radians(d))
        for k, p in enumerate(at):
            r, c = k // w - 2, k % w - 2
            row, col = int(np.floor(sin * c + cos * r + 2.5)), int(np.floor(cos * c - sin * r + 2.5))
            assert p == (row * w + col if 0 <= row < h and 0 <= col < w else None)
    image = spark.createDataFrame([(1, [100.0, 200.0, 250.0, 0.0])], "id int, image array<double>")
    bright = images.augment(image, "id", "image", None, (2, 2), (2, 2), h_flip=False, v_flip=False, brightness=0.5).first().image
    f = bright[0] / 100
    assert 0.5 <= f <= 1.5 and bright == [100 * f, min(200 * f, 255.0), min(250 * f, 255.0), 0.0]


def test_augment_rejects_wrong_sizes(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, None)], "id int, image array<double>")
    with pytest.raises(ValueError, match="exceeds"):
        images.augment(df, "id", "image", None, (1, 2), (2, 2))
    assert [r.image for r in images.augment(df.filter("id = 2"), "id", "image", None, (2, 2), (1, 1)).collect()] == [None]
    with pytest.raises(Exception, match="has to have"):
        images.augment(df, "id", "image", None, (2, 2), (1, 1)).collect()
