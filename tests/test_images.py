import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from anomalake.functions import hashing, images
from anomalake.operators import manifest, regions, selection, subspace


def test_recipes_follow_the_path_alone(spark):
    df = spark.createDataFrame([("a/b.png", 1), ("a\\b.png", 2), ("c.png", 3), (None, 4)], "path string, n int")
    got = {r.n: r for r in images.recipes(df).collect()}
    assert (got[1].first, got[1].second, got[1].params) == (got[2].first, got[2].second, got[2].params)
    assert got[1].first != got[1].second and got[4].first is None
    for r in (got[1], got[3]):
        for op, p in zip((r.first, r.second), json.loads(r.params), strict=True):
            assert set(p) == {n for n, *_ in images.DRAWS[op]}


def test_pixel_transforms():
    x = np.full((4, 6, 3), 100, np.uint8)
    assert (images.gamma(x, 1.0) >= 99).all() and images.brightness(x, 3.0).max() == 255 and (images.gains(x, 1, 0.5, 2)[0, 0] == (100, 50, 200)).all()
    f = images.illumination(x, 0.2, 0.0)
    assert f[0, 0, 0] < f[0, -1, 0] and (f[0] == f[-1]).all()
    with pytest.raises(ValueError):
        images.apply(x, [("JPEG", {"quality": 80})])
    assert images.apply(x, [("JPEG", {"quality": 80})], {"JPEG": lambda a, p: a}).shape == x.shape


def test_float32_thresholds():
    t = np.array([0.1, 0.5, 1 / 3])
    for strict in (False, True):
        c = images.float32_above(t, strict).astype(np.float64)
        below = np.nextafter(images.float32_above(t, strict), np.float32(-1)).astype(np.float64)
        assert ((c > t) if strict else (c >= t)).all() and ((below <= t) if strict else (below < t)).all()


def test_sizes(spark):
    r = spark.range(1).select(images.preprocessed_size(F.lit(400), F.lit(900), 1.0).alias("a"), images.preprocessed_size(F.lit(700), F.lit(900), 1.0).alias("b")).first()
    assert (r.a.h, r.a.w) == (640, 1440) and (r.b.h, r.b.w) == (700, 900)
    assert regions.evaluation_size(301, 509) == (75, 127)
    with pytest.raises(ValueError):
        regions.evaluation_size(3, 20)


def test_stitch_takes_the_last_crop(spark):
    c = spark.createDataFrame([(1, 0, 0, 0, 0, 0, 5.0), (1, 1, 0, 0, 0, 0, 6.0), (1, 1, 0, 1, 0, 0, 7.0)], "image int, crop int, y0 int, x0 int, y int, x int, value double")
    assert sorted((r.y, r.x, r.value) for r in images.stitch(c, ["image"]).collect()) == [(0, 0, 6.0), (0, 1, 7.0)]


def test_transform_manifest(spark):
    im = spark.createDataFrame([("c", "train", f"{i}.png") for i in range(3)], "category string, split string, image string")
    got = manifest.transform_manifest(im, 4, 10).collect()
    assert len(got) == 10 and len({r.physical_id for r in got}) == 10
    by = {}
    for r in got:
        by.setdefault(r.image, []).append((r.x, r.y))
        assert r.transform_id == hashing.stable_u64(f"c|train|{r.image}|{r.x}|{r.y}|42") % 9
    assert sorted(map(len, by.values())) == [3, 3, 4] and set(by["1.png"]) < set(by["0.png"])
    assert manifest.transform_manifest(im, 4, 1000).count() == 48


def test_paired_bootstrap(spark):
    df = spark.range(200).selectExpr("id % 10 = 0 a", "id % 5 = 0 b")
    r = manifest.paired_bootstrap(df, "a", "b", 7)
    assert r["delta"] == pytest.approx(0.1) and r["low"] < 0.1 < r["high"] and r == manifest.paired_bootstrap(df.repartition(5), "a", "b", 7)


def test_kcenter_and_waterfill():
    v = np.array([[0.0], [1.0], [10.0], [10.0], [4.0]])
    assert selection.kcenter(v, 4, 0) == [0, 2, 4, 1]
    assert selection.kcenter(np.zeros((5, 2)), 3, 0, masked=False) == [0, 0, 0] and selection.kcenter(np.zeros((5, 2)), 3, 0) == [0, 1, 2]
    got = selection.waterfill({1: 100, 2: 10, 3: 1}, 60, 1)
    assert sum(got.values()) == 60 and got[3] == 1 and got[1] > got[2] >= 5
    assert selection.waterfill({1: 2, 2: 3}, 5) == {1: 2, 2: 3} and selection.waterfill({1: 5, 2: 5}, 2, 2) == {1: 1, 2: 1}
    with pytest.raises(ValueError):
        selection.waterfill({1: 2, 2: 3}, 100)


def test_subspace_algebra(spark):
    r = np.random.default_rng(0)
    x = r.normal(size=(200, 3)) @ r.normal(size=(3, 6)) + 5
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "id long, vec array<double>").repartition(3)
    n, s, g = subspace.moments(df)[""]
    assert n == 200 and np.allclose(s, x.sum(0)) and np.allclose(g, x.T @ x)
    b = {"": subspace.basis(n, s, g, 3, True)}
    out = subspace.residuals(df, b).collect()
    assert max(q.residual for q in out) < 1e-4 and min(q.explained for q in out) > 0.999
    y = r.normal(size=(4000, 4)) * (1, 2, 3, 4)
    w = subspace.pca_whitener(len(y), y.sum(0), y.T @ y, rho=1.0, shrinkage=0.0)
    assert np.allclose(np.cov(w.apply(y).T), np.eye(4), atol=0.02)
    c = y - y.mean(0)
    lw, share = subspace.ledoit_wolf(len(y), y.sum(0), y.T @ y, float(((c * c).sum(1) ** 2).sum()))
    assert 0 <= share < 0.05 and np.allclose(np.cov(lw.apply(y).T), np.eye(4), atol=0.1)
    assert subspace.spectrum(np.ones(5))["effective_rank"] == pytest.approx(5)
    assert subspace.projector_distance(np.eye(4)[:2], np.eye(4)[:2]) == 0 and subspace.projector_distance(np.eye(4)[:2], np.eye(4)[2:]) == pytest.approx(1)
