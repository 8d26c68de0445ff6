"""Searches for what is nearest in crowded images."""

import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.operators import detection, geometry


def _brute(a, b):
    """(label, l1) by comparing all pairs; ties by IoU, then the label's place."""
    out = []
    for q in a:
        l1 = np.abs(q - b) @ np.ones(4)
        iou = detection._pair_iou(np.repeat(q[None], len(b), 0), b)
        g = np.lexsort((np.arange(len(b)), -iou, l1))[0]
        out.append((g, l1[g], iou[g]))
    return [np.array(x) for x in zip(*out)]


def _some(rng, n, step):
    at = rng.integers(0, 200, (n, 2)) * step
    return np.concatenate([at, at + 1 + rng.integers(0, 60, (n, 2)) * step], 1).astype(float)


@pytest.mark.parametrize(("n", "m", "step"), [(700, 1500, 1.0), (2000, 900, 0.37), (40, 3, 1.0), (300, 2500, 25.0)])
def test_nearest_equals_brute_force(n, m, step):
    rng = np.random.default_rng(n)
    image, of = np.sort(rng.integers(0, 2, n)), rng.integers(0, 2, m)
    a, b = _some(rng, n, step), _some(rng, m, step)
    label, l1, iou = detection.nearest(image, a, of, b)
    for k in (0, 1):
        rows, mine = np.flatnonzero(of == k), image == k
        want, d, u = _brute(a[mine], b[rows])
        assert (label[mine] == rows[want]).all() and np.allclose(l1[mine], d) and (iou[mine] == u).all()


def test_nearest_label_with_odd_rows(spark):
    box = [0.0, 0.0, 4.0, 4.0]
    chips = spark.createDataFrame([("a", 1, box), ("a", 2, None), ("a", 3, [float("nan"), 0.0, 4.0, 4.0]), ("a", None, box), ("a", 4, [90.0, 90.0, 94.0, 94.0]), ("a", 4, [1.0, 1.0, 5.0, 5.0]), ("b", 5, box), ("c", 6, box), (None, 7, box)], "image_id string, chip_idx int, box array<double>")
    labels = spark.createDataFrame([("a", "z", box), ("a", "x", None), ("a", "y", [0.0, 0.0, 4.0, 4.0]), ("c", "n", None), ("d", "q", box), (None, "r", box)], "image_id string, label_id string, box array<double>")
    got = {(r.image_id, r.chip_idx): r for r in detection.nearest_label(chips, labels).collect()}
    assert set(got) == {("a", 1), ("a", 2), ("a", 3), ("a", None), ("a", 4), ("c", 6)}
    # a label without a box comes after all others
    assert (got["a", 1].label_id, got["a", 1].l1, got["a", 1].iou) == ("y", 0, 1) and got["a", None].label_id == "y"
    assert (got["a", 4].label_id, got["a", 4].l1) == ("y", 4)
    assert (got["a", 2].l1, got["a", 2].iou, got["c", 6].label_id, got["c", 6].l1) == (None, 0, "n", None)


def test_nearest_label_of_crowded_images(spark):
    """5e8 pairs of boxes in two images, few of them different."""
    i = F.col("id")
    box = lambda x, y: F.array(*[c.cast("double") for c in (x, y, x + 40, y + 40)])
    chips = spark.range(30_000).select((i % 2).alias("image_id"), i.alias("chip_idx"), box(i % 7, i % 5).alias("box"))
    labels = spark.range(32_000).select((i % 2).alias("image_id"), i.alias("label_id"), box(i % 20, i % 4).alias("box"))
    plan = detection.nearest_label(chips, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan, "pairs of boxes must not be written out"
    got = detection.nearest_label(chips, labels).collect()
    at = lambda j, m, n: np.array([j % m, j % n, j % m + 40, j % n + 40], float)
    for j in range(70):
        of = np.arange(j % 2, 20, 2)  # later labels only repeat these
        want, _, _ = _brute(at(j, 7, 5)[None], np.array([at(x, 20, 4) for x in of]))
        assert {r.label_id for r in got if r.chip_idx % 70 == j} == {of[want[0]]}
    assert len(got) == 30_000


@pytest.mark.parametrize("kind", ["spread", "few centres", "on a line", "with outliers"])
@pytest.mark.parametrize(("k", "most"), [(4, 256), (1, 10), (7, 5000)])
def test_edges_equal_brute_force(kind, k, most):
    rng, n = np.random.default_rng(k), 500
    x = {"spread": rng.random((n, 2)), "few centres": rng.integers(0, 6, (n, 2)) / 640, "on a line": np.column_stack([np.zeros(n), rng.integers(0, 90, n) / 7]), "with outliers": rng.random((n, 2)) * np.where(np.arange(n)[:, None] % 10, 1e-3, 1e3)}[kind]
    d = np.round(np.sqrt((x[:, None, 0] - x[:, 0]) ** 2 + (x[:, None, 1] - x[:, 1]) ** 2), 12)
    pairs = {(min(a, b), max(a, b)) for a in range(n) for b in sorted(set(range(n)) - {a}, key=lambda b: (d[a, b], b))[:k]}
    want = sorted(pairs, key=lambda p: (d[p], p))[:most]
    assert list(zip(*geometry.edges(np.arange(n), x, k, most))) == want


def test_edges_of_chips_without_a_centre():
    x = np.column_stack([np.arange(40.0), np.zeros(40)])
    x[3], x[7, 0] = np.nan, np.inf
    i, j = geometry.edges(np.arange(40), x, 2, 256)
    assert len(i) and not (set(i) | set(j)) & {3, 7} and (2, 4) in set(zip(i, j))
    assert not len(geometry.edges(np.arange(40), np.full((40, 2), np.nan), 2, 256)[0])


@pytest.mark.parametrize("centres", [315, 40_000])
def test_edges_of_a_crowded_image_take_no_square_of_its_chips(centres):
    n = 40_000
    at = np.random.default_rng(3).random((centres, 2))
    x = at[np.arange(n) % centres]
    began = time.process_time()
    i, j = geometry.edges(np.arange(n), x, 4, 256)
    assert time.process_time() - began < 10  # all distances took 60 s
    if centres == 315:  # the first chip of a centre is the nearest of all others there
        assert (i[:126] == 0).all() and j[:126].tolist() == list(range(315, n, 315))[:126]
