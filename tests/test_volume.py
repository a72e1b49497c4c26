"""Projections and scatter images against numpy brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ephysframe.operators import volume as V


def _volume(rng, shape=(7, 6, 9)):
    vol = rng.integers(0, 4, size=shape)
    vol[rng.random(shape) < 0.4] = 0
    return vol


def _table(spark, vol):
    rows = [(int(a), int(b), int(c), int(vol[a, b, c])) for a, b, c in zip(*np.nonzero(vol))]
    return spark.createDataFrame(rows, "ml int, dv int, ap int, structure_id long")


def _dense(df, shape, col="a"):
    img = np.zeros(shape)
    for r in df.collect():
        img[r.y, r.x] = r[col]
    return img


def test_hemisphere_and_midline(spark):
    vol = _volume(np.random.default_rng(1))
    vol[6, 0, 0] = 2
    t = _table(spark, vol)
    assert spark.range(1).select(V.midline(7).alias("m")).first().m == 25 * 0.5 * 7
    assert spark.range(1).select(V.midline(V.axis_size(t, "ml")).alias("m")).first().m == 25 * 0.5 * 7
    left = V.hemisphere(t, "left", 7).agg(F.max("ml")).first()[0]
    assert left < 3 and V.hemisphere(t, "right", 7).agg(F.min("ml")).first()[0] >= 3


def test_empty_outer_planes_do_not_move_the_midline(spark):
    t = spark.createDataFrame([(ml, 0, 0, 1) for ml in range(2, 8)], "ml int, dv int, ap int, structure_id long")
    assert V.hemisphere(t, "left", 10).count() == 3 and V.hemisphere(t, "right", 10).count() == 3
    with pytest.raises(ValueError):
        V.hemisphere(t, "left")


def test_projection_matches_numpy(spark):
    rng = np.random.default_rng(2)
    vol = _volume(rng)
    t = _table(spark, vol)
    mask = V.region_mask(t, spark.createDataFrame([(1,), (2,)], "id long"), side="both")
    m = np.isin(vol, [1, 2])
    for projection, depth, (cen, thick) in (("horizontal", 1, (None, None)), ("coronal", 2, (4, 3)), ("sagittal", 0, (1, 2))):
        n = vol.shape[depth]
        c = n // 2 if cen is None else cen
        th = n if thick is None else thick
        lo, hi = max(round(c - 0.5 * th), 0), min(round(c + 0.5 * th) + 1, n)
        sub = np.take(m, range(lo, hi), axis=depth).sum(axis=depth)
        y, x = V.PROJECTION_YX[projection]
        dims = [a for a in V.AXES if a != V.PROJECTION_TO_AXIS[projection]]
        if (y, x) != tuple(dims):
            sub = sub.T
        want = sub / sub.max()
        img = V.project(mask, projection, depth_size=n, center=cen, thickness=thick, rgb=(0.1, 0.2, 0.3))
        got = _dense(img, want.shape)
        assert np.allclose(got, want), projection
        assert {(r.r, r.g, r.b) for r in img.collect()} == {(0.1, 0.2, 0.3)}


def test_slabs_of_running_counts(spark):
    rng = np.random.default_rng(5)
    t = _table(spark, _volume(rng))
    # voxels outside the volume, one counted twice, one without a depth
    odd = spark.createDataFrame([(0, 9, 0, 1), (0, -1, 0, 1), (1, 2, 3, 1), (1, 2, 3, 1), (2, None, 2, 1)], t.schema)
    t = t.unionByName(odd)
    for projection, n in (("horizontal", 6), ("coronal", 9), ("sagittal", 7)):
        running = V.running_counts(t, projection, depth_size=n)
        first = running.first().upto
        assert len(first) == n + 1 and first[0] == 0 and first == sorted(first)
        slabs = [(None, None), (0, 0), (n - 1, 1), (n + 9, 2)] + [(int(rng.integers(-2, n + 2)), int(rng.integers(0, n + 3))) for _ in range(4)]
        for cen, thick in slabs:
            opts = dict(depth_size=n, center=cen, thickness=thick, normalize_rgb=False)
            got, want = V.project_counts(running, **opts), V.project(t, projection, **opts)
            assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())), (projection, cen, thick)


def test_running_counts_of_nothing(spark):
    t = spark.createDataFrame([], "ml int, dv int, ap int, structure_id long")
    running = V.running_counts(t, "coronal", depth_size=4)
    assert running.count() == 0 and V.project_counts(running, depth_size=4).count() == 0


def test_scatter_matches_histogram(spark):
    rng = np.random.default_rng(3)
    pts = rng.uniform(-20, 260, size=(400, 2))
    pts[:5] = [[250.0, 10.0], [0.0, 0.0], [249.9, 124.9], [10.0, 250.0], [125.0, 125.0]]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in pts], "ccf_ap double, ccf_ml double")
    h, w = 10, 5
    counts, _, _ = np.histogram2d(pts[:, 0] / 25, pts[:, 1] / 25, bins=(np.arange(h + 1), np.arange(w + 1)))
    lo, hi = 0.8, 1.0
    want = lo + (hi - lo) * counts / counts.max()
    want[want <= lo] = 0
    want = np.clip(want, 0, 1)
    got = _dense(V.scatter_density(df, "horizontal", image_shape=(h, w)), (h, w))
    assert np.allclose(got, want)
    flat = _dense(V.scatter_density(df, "horizontal", image_shape=(h, w), opacity_range=(1.0, 1.0)), (h, w))
    assert np.array_equal(flat, (counts > 0) * 1.0)


def test_scatter_colour(spark):
    df = spark.createDataFrame([(30.0, 30.0), (30.0, 30.0), (80.0, 10.0)], "ccf_ap double, ccf_ml double")
    rows = V.scatter_density(df, "horizontal", image_shape=(4, 4), rgb=(0.0, 0.0, 0.0)).collect()
    assert {(r.r, r.g, r.b) for r in rows} == {(0.0, 0.0, 0.0)}
    shaped = V.scatter_density(df, "horizontal", volume_shape={"ml": 8, "dv": 3, "ap": 4}, rgb=(0.0, 0.0, 0.0))
    assert sorted(map(tuple, shaped.collect())) == sorted(map(tuple, rows))
    alpha = {(r.y, r.x): r.a for r in rows}
    assert alpha[(1, 1)] == 1.0 and abs(alpha[(3, 0)] - 0.9) < 1e-12 and len(alpha) == 2
