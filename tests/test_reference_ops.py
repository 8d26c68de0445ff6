"""Numeric anchors and error paths of the detection, ranking and pooling operators."""

import hashlib
import json
import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from skewline.functions import boxes as X
from skewline.functions import vectors as V
from skewline.operators import binning, chips, combine, compare, detection, failure, geometry, masks, metrics, pooling, ranks
from skewline.operators import detectors as D
from skewline.operators.bank import ScoreBank
from skewline.operators.linalg import moments, principal_dim
from skewline.sources import bdd, coco, images, imagenet, saved, store

COLS = D.Features("z", "x")


def bank(spark, scores, ood, **kw):
    rows = [(i, float(s), int(o)) for i, (s, o) in enumerate(zip(scores, ood))]
    return ScoreBank.of(spark.createDataFrame(rows, "sample_id long, s double, y int"), {"d": "s"}, ood="y", **kw)


def vectors(spark, x, z=None, y=None):
    rows = [(i, [float(v) for v in r], None if z is None else [float(v) for v in z[i]], None if y is None else int(y[i])) for i, r in enumerate(x)]
    return spark.createDataFrame(rows, "sample_id long, x array<double>, z array<double>, y int")


def scores(df):
    return np.array([r.score for r in df.orderBy("sample_id").collect()])


def test_perfect_and_inverted_ranking(spark):
    up = metrics.evaluate(bank(spark, range(8), [0] * 4 + [1] * 4)).head()
    assert (up.auroc, up.fpr95, up.aupr_ood, up.det_err) == (1.0, 0.0, 1.0, 0.0)
    down = metrics.evaluate(bank(spark, range(8), [1] * 4 + [0] * 4)).head()
    assert (down.auroc, down.fpr95, down.det_err) == (0.0, 1.0, 0.5)


def test_ties_follow_sample_order(spark):
    assert metrics.evaluate(bank(spark, [1] * 4, [0, 0, 1, 1])).head().auroc == 0.0
    assert metrics.evaluate(bank(spark, [1] * 4, [1, 1, 0, 0])).head().auroc == 1.0


@pytest.mark.parametrize("hot", [0.0, 0.4, 1.0])
def test_metrics_equal_direct_computation(spark, hot):
    """Also where many or all rows share one score, whose rows several tasks number."""
    rng = np.random.default_rng(1)
    s, y = np.round(rng.normal(size=300), 1), rng.integers(0, 2, 300)
    s[rng.random(300) < hot] = 0.3
    got = metrics.evaluate(bank(spark, s, y)).head()
    o = np.lexsort((np.arange(300), -np.float32(s)))
    tp, fp = np.cumsum(y[o]), np.cumsum(1 - y[o])
    tpr, fpr = np.r_[0, tp / tp[-1]], np.r_[0, fp / fp[-1]]
    assert got.auroc == pytest.approx(np.trapezoid(tpr, fpr))
    assert got.fpr95 == pytest.approx(fpr[np.argmax(tpr >= 0.95)])
    assert got.aupr_ood == pytest.approx(np.trapezoid(np.r_[1, tp / (tp + fp)], tpr))
    assert got.det_err == pytest.approx((0.5 * (fpr + 1 - tpr)).min())


@pytest.mark.parametrize("keys", [[], ["g"]])
def test_percentiles_are_exact(spark, keys):
    rng = np.random.default_rng(3)
    x = np.r_[np.round(rng.normal(size=500), 2), np.full(700, 0.25), [np.nan]]
    g = np.arange(len(x)) % 3
    df = spark.createDataFrame([(int(a), None if i == 5 else float(b)) for i, (a, b) in enumerate(zip(g, x))], "g int, x double")
    for r in ranks.percentiles(df, keys, "x", [0, 0.1, 0.5, 0.67, 1]).collect():
        own = x[(g == r.g if keys else True) & (np.arange(len(x)) != 5) & ~np.isnan(x)]
        assert r.n == len(own) and np.allclose(r.percentiles, np.quantile(own, [0, 0.1, 0.5, 0.67, 1]))
    assert ranks.percentiles(df.limit(0), keys, "x", [0.5]).count() == 0


def test_numbers_and_first_by_hash_of_strings(spark):
    names = [f"im{i:03d}é" for i in range(200)] + ["a", "b", ""]
    df = spark.createDataFrame([(n,) for n in names], "k string")
    got = [r.k for r in ranks.dense(df, [], "k", "i").orderBy("i").collect()]
    assert got == sorted(names, key=lambda n: n.encode()) and [r.i for r in ranks.dense(df, [], "k", "i").orderBy("i").collect()] == list(range(203))
    order = sorted(names, key=lambda n: hashlib.md5(f"7:{n}".encode()).hexdigest())
    for k in (0, 1, 50, 203, 500):
        assert {r.k for r in ranks.first_by_hash(df, "k", k, masks.hash_key(7, F.col("k"))).collect()} == set(order[:k])


def test_concatenate_string_ids(spark):
    a, b = (spark.createDataFrame([(f"{p}{i:02d}", float(i)) for i in (5, 1, 3)], "sample_id string, v double") for p in "xa")
    got = [(r.sample_id, r.block, r.v) for r in combine.concatenate([a, b], [0, 1]).orderBy("sample_id").collect()]
    assert got == [(0, 0, 1.0), (1, 0, 3.0), (2, 0, 5.0), (3, 1, 1.0), (4, 1, 3.0), (5, 1, 5.0)]


def test_a_stratum_is_split_into_disjoint_parts(spark):
    df = spark.range(1000).select("id", F.when(F.col("id") < 900, "hot").when(F.col("id") < 990, "b").alias("s"))
    got = masks.stratified_split(df, "s", "id", (0.35, 0.35), seed=3)
    n = {(r.s, r.part): r.n for r in masks.stratum_counts(got, "s", "part").collect()}
    assert n[("hot", 0)] == n[("hot", 1)] == 315 and n[("b", 0)] == 31 and n[(None, 0)] == 4 and got.count() == 1000
    one = {r.id for r in masks.stratified(df, "s", "id", 0.35, seed=3).collect()}
    assert one == {r.id for r in got.where("part = 0").collect()}


def test_a_bank_takes_one_row_for_each_sample(spark):
    b = bank(spark, [1, 2], [0, 1])
    for rows in ([(0, 1.0)], [(0, 1.0), (1, 2.0), (1, 3.0)], [(0, 1.0), (1, 1.0), (2, 1.0)]):
        with pytest.raises(ValueError):
            b.add("e", spark.createDataFrame(rows, "sample_id long, score double"))
    assert b.add("e", spark.createDataFrame([(1, 5.0), (0, 4.0)], "sample_id long, score double")).df.count() == 2


@pytest.mark.parametrize("crowded", [False, True])
def test_ground_truth_rows_of_one_id_are_taken_together(spark, crowded, monkeypatch):
    monkeypatch.setattr(detection, "_MATRIX", 0 if crowded else 10**6)
    box = np.array([[0.0, 0, 10, 10]])
    hit, own, back, best = detection.greedy(box, np.array([0.9]), np.array([0]), np.repeat(box, 2, 0), np.arange(2), np.array(["a", "a"], object), 0.5)
    assert hit.tolist() == [1] and back.tolist() == [0, 0] and best.tolist() == [1, 1] and own.tolist() == [1]


def test_nan_scores_rank_last_both_ways(spark):
    b = bank(spark, [1, float("nan"), 3], [0, 1, 1])
    assert [r.sample_id for r in compare.rank_samples(b, "d").orderBy("rank").collect()] == [2, 0, 1]
    assert [r.sample_id for r in compare.rank_samples(b, "d", direction="id").orderBy("rank").collect()] == [0, 2, 1]


def test_bank_errors(spark):
    b = bank(spark, [1, 2], [0, 1])
    with pytest.raises(KeyError):
        b.scores_for("no")
    with pytest.raises(ValueError):
        b.by_class(1)
    with pytest.raises(ValueError):
        b.subset([True, False])
    with pytest.raises(ValueError):
        compare.score_correlation(b)
    with pytest.raises(ValueError):
        compare.rank_samples(b, "d", rank_range=(3, 3))
    with pytest.raises(ValueError):
        metrics.evaluate(ScoreBank.of(b.df, {"d": "d"}))
    with pytest.raises(ValueError):
        metrics.evaluate_by_class(ScoreBank.of(b.df.withColumn("c", F.lit(0)).where("ood = 0"), {"d": "d"}, ood="ood", class_id="c"))
    assert "d" in repr(metrics.MetricsTable(metrics.evaluate(b))) and b.n_samples == 2
    more = b.add("e", spark.createDataFrame([(0, 5.0), (1, 6.0)], "sample_id long, score double"))
    assert more.detectors == ("d", "e") and more.df.count() == 2


def test_softmax_anchors(spark):
    df = vectors(spark, [[0], [0], [0]], [[10, 0, 0], [0, 0, 0], [2, 0, 0]])
    msp = scores(D.MSP(features=COLS).fit(df).transform(df))
    assert msp[0] == pytest.approx(-1, abs=1e-3) and msp[1] == pytest.approx(-1 / 3)
    assert scores(D.Energy(features=COLS).fit(df).transform(df))[1] == pytest.approx(-np.log(3))
    hot = scores(D.MSP(5.0, features=COLS).fit(df).transform(df))
    assert hot[2] > msp[2]
    with pytest.raises(ValueError):
        D.MSP(0)
    with pytest.raises(RuntimeError):
        D.Energy(features=COLS).transform(df)
    with pytest.raises(ValueError):
        D.Features()
    with pytest.raises(NotImplementedError):
        D.Energy(features=COLS).fit(df).predict(df)


def clusters(spark):
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(-1, 0.1, (20, 2)), rng.normal(1, 0.1, (20, 2))]
    return x, np.r_[np.zeros(20), np.ones(20)]


def test_near_and_far(spark):
    x, y = clusters(spark)
    train = vectors(spark, x, y=y)
    q = vectors(spark, [[1.05, 0.95], [4, 4]])
    for det in (D.Mahalanobis(features=COLS), D.KNN(3, features=COLS), D.WDiscOOD(features=COLS)):
        near, far = scores(det.fit(train, "y").transform(q))
        assert near < far
    with pytest.raises(ValueError):
        D.WDiscOOD(features=COLS).fit(train)
    with pytest.raises(ValueError):
        D.KNN(50, features=COLS).fit(train)
    with pytest.raises(ValueError):
        D.KNN(metric="other")
    with pytest.raises(ValueError):
        D.Mahalanobis(features=COLS).fit(train.limit(0))


def test_moments_equal_numpy(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(1000, 1, (50, 4)), rng.integers(0, 3, 50)
    m = moments(vectors(spark, x, y=y).repartition(3), "x", "y")
    assert np.allclose(m.mean, x.mean(0)) and np.allclose(m.scatter(), (x - x.mean(0)).T @ (x - x.mean(0)))
    mu = np.stack([x[y == c].mean(0) for c in range(3)])
    assert np.allclose(m.within(), (x - mu[y]).T @ (x - mu[y]))


def test_principal_dim_rules():
    assert principal_dim(np.array([3.0, 1, 0]), 3, None, 0.75) == 1
    assert principal_dim(np.array([3.0, 1, 0]), 3, None, 1.0) == 2
    assert principal_dim(np.zeros(3), 3, None, 0.9) == 1
    assert principal_dim(np.ones(3), 3, 0, 0.9) == 0
    for n, p in ((3, 0.5), (-1, 0.5), (None, 0), (None, 1.1)):
        with pytest.raises(ValueError):
            principal_dim(np.ones(3), 3, n, p)


def test_pca_and_vim(spark):
    rng = np.random.default_rng(5)
    x = np.c_[rng.normal(size=(60, 2)) * 5, rng.normal(size=(60, 2)) * 0.01]
    W, b = rng.normal(size=(3, 4)), np.array([0.1, -0.1, 0.2])
    train = vectors(spark, x, x @ W.T + b)
    q = np.array([[5, 5, 0, 0], [5, 5, 3, 3.0]])
    test = vectors(spark, q, q @ W.T + b)
    for det in (D.PCA(features=COLS), D.PCAFusion(features=COLS), D.PCA("rff_cosine", random_state=1, features=COLS), D.ViM(W, b, 2, features=COLS)):
        s = scores(det.fit(train).transform(test))
        assert np.isfinite(s).all()
        if not (isinstance(det, D.PCA) and det.space.kernel != "linear"):
            assert s[0] < s[1]
    assert np.allclose(D.ViM(np.eye(2, 3), [1, 2], 1, features=COLS)._fit(vectors(spark, np.eye(3), np.eye(3)), None) or 0, 0)
    with pytest.raises(ValueError):
        D.PCA("other")
    with pytest.raises(ValueError):
        D.ViM(np.eye(2), [1])


def test_detector_anchors(spark, sf):
    """Means and AUROCs from an independent NumPy computation on sf0.01."""
    from skewline.plans.detecting import detector_anchors

    want = {"msp": (-0.12958186, 0.460317), "energy": (-2.05980967, 0.457492), "knn": (1.25653061, 0.450660), "mahalanobis": (91.05525906, 0.482149), "pca": (0.37691627, 0.509067), "pca_fusion": (-1.28346550, 0.508758), "vim": (0.11823184, 0.463656), "wdiscood": (2.34766688, 0.489444)}
    got = detector_anchors(spark, sf.replace("sf0.001", "sf0.01"))
    for k, (mean, auroc) in want.items():
        assert got[k][0] == pytest.approx(mean, rel=1e-6) and got[k][1] == pytest.approx(auroc, abs=1e-6)


def test_scores_on_a_stream(spark, tmp_path):
    x, y = clusters(spark)
    train = vectors(spark, x, y=y)
    train.write.parquet(str(tmp_path / "in"))
    det = D.Mahalanobis(features=COLS).fit(train, "y")
    stream = det.transform(spark.readStream.schema(train.schema).parquet(str(tmp_path / "in")))
    q = stream.writeStream.format("memory").queryName("scored").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("scored").count() == 40


def test_masks(spark):
    df = vectors(spark, [[0], [0], [0]], [[2, 1], [0, 1], [1, 1]], [0, 0, 0])
    got = [r.m for r in df.select(masks.correct_prediction("z", "y").alias("m")).collect()]
    assert got == [True, False, True]
    assert [r.m for r in df.select(masks.correct_prediction("z", "y", 0.6).alias("m")).collect()] == [True, False, False]
    with pytest.raises(ValueError):
        masks.correct_prediction("z", "y", 1.5)
    with pytest.raises(ValueError):
        masks.as_mask(df, "x")
    with pytest.raises(ValueError):
        masks.fit_on_mask(D.MSP(features=COLS), df.withColumn("m", F.lit(0)), "m")
    with pytest.raises(ValueError):
        masks.fit_on_mask(D.MSP(features=COLS), df, "y", min_samples=0)
    assert masks.stratified(spark.range(5).withColumn("s", F.lit(1)), "s", "id", 0.5).count() == 2  # half to even
    with pytest.raises(ValueError):
        masks.grouped_split(df, "y")


def test_boxes(spark):
    df = spark.createDataFrame([([0.0, 0.0, 10.0, 10.0], [5.0, 5.0, 15.0, 15.0])], "a array<double>, b array<double>")
    r = df.select(X.iou(F.col("a"), F.col("b")).alias("i"), X.square_chip(F.col("a")).alias("s"), X.to_xyxy(F.col("b"), "cxcywh").alias("c")).head()
    assert r.i == pytest.approx(25 / 175) and r.s == [-8, -8, 17, 17] and r.c == [-2.5, -2.5, 12.5, 12.5]
    with pytest.raises(ValueError):
        X.to_xyxy(F.col("a"), "yx")
    img = np.arange(12).reshape(3, 4)
    assert X.crop_pixels(img, [-1, -1, 2, 2]).tolist() == [[0, 0, 0], [0, 0, 1], [0, 4, 5]]
    assert X.crop_pixels(img, [9, 9, 11, 11]).sum() == 0


def test_pooling_anchors(spark):
    df = spark.createDataFrame([(0, 1.0), (0, 2.0), (0, 3.0), (2, 4.0)], "image_idx long, score double")
    got = lambda **kw: [r.score for r in pooling.pool_image_scores(df, n_images=3, **kw).orderBy("image_idx").collect()]
    assert got() == [2.0, None, 4.0] and got(method="max") == [3.0, None, 4.0] and got(method="topk_mean", k=2) == [2.5, None, 4.0]
    for kw in ({"method": "x"}, {"k": 0}):
        with pytest.raises(ValueError):
            pooling.pool_image_scores(df, **kw)


def test_detection_tables(spark):
    pred = spark.createDataFrame([("a", 1, [0.0, 0.0, 10.0, 10.0], "0.9", 0), ("a", 1, [50.0, 50.0, 60.0, 60.0], "bad", 1), (None, 1, [0.0, 0.0, 1.0, 1.0], "1", 2)], "image_id string, class_id int, bbox array<double>, confidence string, pos int")
    gt = spark.createDataFrame([("a", 1, [0.0, 0.0, 10.0, 10.0], 0), ("a", 1, [100.0, 100.0, 110.0, 110.0], 1), ("b", 2, [0.0, 0.0, 5.0, 5.0], 2)], "image_id string, class_id int, bbox array<double>, pos int")
    t = detection.evaluate_detection(pred, gt, order="pos", gt_order="pos", class_names={1: "one"})
    r = {x.image_id: x for x in t.metrics.collect()}
    a = r["a"]
    assert (a.tp, a.fp, a.fn, a.precision, a.recall, a.f1, a.class_name, a.has_failure) == (1, 1, 1, 0.5, 0.5, 0.5, "one", True)
    assert a.mean_detection_confidence is None and not a.low_precision
    assert r["b"].precision is None and r["b"].low_precision is None and r["b"].recall == 0.0 and r["b"].low_recall
    assert {x.detection_id for x in t.detections.collect()} == {"det_0", "det_1"}
    for kw in ({"iou_threshold": 1.5}, {"backend": "x"}):
        with pytest.raises(ValueError):
            detection.evaluate_detection(pred, gt, order="pos", gt_order="pos", **kw)
    with pytest.raises(ValueError):
        detection.prepare_predictions(pred.drop("bbox"), "pos")
    empty = detection.evaluate_detection(pred.limit(0), gt, order="pos", gt_order="pos").metrics
    assert empty.where("fn = num_gt").count() == 2


def test_greedy_prefers_confidence_then_later_truth():
    det = np.array([[0, 0, 10, 10], [0, 0, 10, 10.0]])
    gt = np.array([[0, 0, 10, 10], [0, 0, 10, 10.0]])
    hit, own, back, best = detection.greedy(det, np.array([0.1, np.nan]), np.arange(2), gt, np.arange(2), np.array(["a", "b"], object), 0.5)
    assert hit.tolist() == [1, 0] and own.tolist() == [1, 1] and back.tolist() == [1, 0]


def test_geometry_errors(spark):
    for kw in ({"k": 0}, {"smoothing": 0}, {"weights": {"x": 1}}, {"weights": {"size": -1}}, {"method": "no"}):
        with pytest.raises(ValueError):
            geometry.GeometryAwarePooler(**kw)
    chips = spark.createDataFrame([(0, i, i % 2, float(i), [10.0 * i, 10.0, 10.0 * i + 9.0, 20.0], 100.0, 100.0) for i in range(4)], "image_idx long, chip_idx long, class_id int, score double, box array<double>, image_w double, image_h double")
    with pytest.raises(RuntimeError):
        geometry.GeometryAwarePooler().score(chips)
    s = geometry.GeometryAwarePooler().fit(chips).score(chips, n_images=2)
    assert [r.score is None for r in s.orderBy("image_idx").collect()] == [False, True]


def test_failure_model(spark):
    rng = np.random.default_rng(2)
    rows = []
    for i in range(120):
        v = float(rng.normal())
        rows.append((i // 2, ["a", "b"][i % 2], None if i % 10 == 0 else v, None, int(v + rng.normal() * 0.5 > 0) if i % 17 else None))
    df = spark.createDataFrame(rows, "g int, class_name string, v double, none double, y int")
    m, p = failure.evaluate_failure_baselines(df, "y", "g", {"class prior": (), "v": ("class_name", "v", "none")})
    r = {x.model: x for x in m.collect()}
    assert r["class prior"].auroc == 0.5 and r["v"].auroc > 0.8
    train = df.where("y is not null")
    model = failure.LogisticPipeline(("v", "none"), ("class_name",)).fit(train, "y")
    # the gradient of the balanced objective vanishes at the fit
    d = model._featurize(train)
    for s in model.stages:
        d = s.transform(d)
    x = np.array([row._x.toArray() for row in d.select("_x").collect()])
    y = np.array([row.y for row in train.select("y").collect()])
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (len(y) - y.sum())))
    coef, c0 = model.model.coefficients.toArray(), model.model.intercept
    e = w * (1 / (1 + np.exp(-(x @ coef + c0))) - y)
    assert np.abs(x.T @ e + coef).max() < 1e-3 and abs(e.sum()) < 1e-3
    assert model.transform(train.withColumn("class_name", F.lit("new"))).where("p > 0 and p < 1").count() == train.count()
    with pytest.raises(ValueError):
        failure.evaluate_failure_baselines(df, "y", "g", {"x": ("missing",)})
    one = failure.evaluate_failure_baselines(df.withColumn("y", F.lit(1)), "y", "g", {"v": ("v",)})[0].head()
    assert one.auroc is None and one.brier == 0


def test_calibration_anchor(spark):
    df = spark.createDataFrame([(0, 0.1), (0, 0.4), (1, 0.6), (1, 0.9)], "y int, p double")
    assert [(r.n, r.observed) for r in binning.calibration_bins(df, "y", "p", 2).orderBy("bin").collect()] == [(2, 0.0), (2, 1.0)]


def test_combine_errors(spark):
    with pytest.raises(ValueError):
        combine.ood_labels_from_counts(spark, -1, 2)
    with pytest.raises(ValueError):
        combine.ood_labels_from_blocks(spark, [1], [2])
    a = spark.createDataFrame([(5, 0), (9, 3)], "sample_id long, img long")
    got = [(r.sample_id, r.block, r.img) for r in combine.concatenate([a, a], [0, 1], image="img").orderBy("sample_id").collect()]
    assert got == [(0, 0, 0), (1, 0, 3), (2, 1, 4), (3, 1, 7)]
    with pytest.raises(ValueError):
        combine.concatenate([a, a.withColumn("z", F.lit(1))], [0, 1])


COCO = {
    "images": [{"id": 1, "file_name": "d/one.jpg", "width": 100, "height": 50}, {"id": 2, "file_name": "two.jpg"}, {"id": 3, "file_name": "three.jpg", "width": 9, "height": 9}],
    "annotations": [{"id": 1, "image_id": 1, "category_id": 18, "bbox": [1, 2, 10, 20]}, {"id": 2, "image_id": 1, "category_id": 17, "bbox": [0, 0, 5, 3]}, {"id": 3, "image_id": 2, "category_id": 17, "bbox": [0, 0, 8, 8], "iscrowd": 1}, {"id": 4, "image_id": 2, "category_id": 17, "bbox": [1, 1, 4]}, {"id": 5, "image_id": 1, "category_id": 18, "bbox": [3, 3, 6, 6]}],
    "categories": [{"id": 18, "name": "dog"}, {"id": 17, "name": "cat"}],
}


def test_coco(spark, tmp_path):
    for name in ("cartoon", "sketch"):
        os.makedirs(tmp_path / name / "annotations")
        os.makedirs(tmp_path / name / "val2017")
        (tmp_path / name / "annotations" / "instances_val2017.json").write_text(json.dumps(COCO))
    os.makedirs(tmp_path / "broken")
    found = coco.discover_ood(spark, str(tmp_path))
    assert [p.name for p in found] == ["cartoon", "sketch"]
    with pytest.raises(FileNotFoundError):
        coco.discover_ood(spark, str(tmp_path), ["broken"])
    rows = coco.load(spark, found[0].annotations, found[0].images, "g")
    got = sorted((r.image_id, r.class_id, r.class_name, tuple(r.box)) for r in rows.collect())
    assert got == [("one", 0, "cat", (0, 0, 5, 3)), ("one", 1, "dog", (1, 2, 11, 22)), ("one", 1, "dog", (3, 3, 9, 9))]
    assert coco.load(spark, found[0].annotations, "r", include_empty=True).count() == 5
    assert coco.load(spark, found[0].annotations, "r", min_side=4).count() == 2
    chips = coco.chip_table(rows).orderBy("chip_idx").collect()
    assert [c.object_id for c in chips] == ["one_dog_g_0", "one_cat_g_0", "one_dog_g_1"] and [c.chip_idx for c in chips] == [0, 1, 2]
    assert coco.load_domains(spark, found).groupBy("grp").count().count() == 2
    bad = tmp_path / "bad.json"
    bad.write_text(json.dumps({**COCO, "categories": [{"id": 17, "name": "a"}, {"id": 17, "name": "b"}]}))
    with pytest.raises(ValueError):
        coco.categories(coco.read(spark, str(bad)))
    with pytest.raises(ValueError):
        coco.chip_table(rows.limit(0))


def test_imagenet(spark, tmp_path):
    table = tmp_path / "synsets.txt"
    table.write_text("# names\nn00000001 fish\n\nn00000002 bird of prey\n")
    t = imagenet.synsets(spark, str(table))
    assert [(r.wnid, r.class_id, r.class_name) for r in t.collect()] == [("n00000001", 0, "fish"), ("n00000002", 1, "bird of prey")]
    for text in ("n00000002 a\nn00000001 b", "n1 a", "n00000001 a\nn00000001 b"):
        table.write_text(text)
        with pytest.raises(ValueError):
            imagenet.synsets(spark, str(table))
    for d in ("n00000001", "n00000009"):
        os.makedirs(tmp_path / "root" / d)
        (tmp_path / "root" / d / "x.jpg").write_bytes(b"1")
    root = str(tmp_path / "root")
    paths = imagenet.image_paths(spark, root)
    assert {(r.wnid, r.status) for r in imagenet.validate_root(paths, t).collect()} == {("n00000001", "present"), ("n00000002", "missing"), ("n00000009", "unknown")}
    with pytest.raises(ValueError):
        imagenet.variant_dataset(spark, root, t)
    assert imagenet.variant_dataset(spark, root, t, strict=False).count() == 1
    folder = images.image_folder(spark, root)
    assert {r.label for r in folder.collect()} == {0, 1}
    with pytest.raises(TypeError):
        images.image_folder(spark, str(table))


def test_embedding_store(spark, tmp_path):
    rows = [(i, [float(i), 1.0], i % 2, f"g{i}") for i in range(7)]
    df = spark.createDataFrame(rows, "sample_id long, embeddings array<float>, labels long, `group` string")
    store.save_npy(df, str(tmp_path / "s"))
    back = store.load(spark, str(tmp_path / "s"))
    assert sorted(map(tuple, back.select("sample_id", "embeddings", "labels", "group").collect()))[3][2] == 1
    assert back.count() == 7 and store.load(spark, str(tmp_path / "s"), 0.5, seed=1).count() == 3
    with pytest.raises(ValueError):
        store.load(spark, str(tmp_path / "s"), 0)
    store.save(df, str(tmp_path / "p"))
    assert spark.read.parquet(str(tmp_path / "p")).count() == 7


def test_models(spark):
    df = spark.createDataFrame([(i, f"im{i}", bytes([i, 2 * i])) for i in range(5)], "o long, image_id string, content binary")
    factory = lambda: lambda batch: (np.array([[b[0], b[1]] for b in batch]), np.array([[b[0], 1] for b in batch]))
    e = images.extract(df, factory, keep=("image_id",), batch=2).orderBy("image_id").collect()
    assert e[3].embeddings == [3.0, 6.0] and e[3].logits == [3.0, 1.0]
    det = lambda: lambda batch: [[([0, 0, 1, 1], 5, "car", b[0] / 4), ([0, 0, 2, 2], 6, "cat", 0.1)] for b in batch]
    d = images.detect(df, det, "o", threshold=0.25, names={"car": 1}).orderBy("detection_id").collect()
    assert [(r.detection_id, r.class_id) for r in d] == [("im1_det_0", 1), ("im2_det_1", 1), ("im3_det_2", 1), ("im4_det_3", 1)]
    with pytest.raises(ImportError):
        images.model_factory("dinov2-small")
    rng = np.random.default_rng(0)
    x = np.r_[rng.normal(-2, 1, (30, 2)), rng.normal(2, 1, (30, 2))]
    h = vectors(spark, x, y=[0] * 30 + [1] * 30)
    W, b = images.train_head(h, "x", "y")
    z = images.apply_head(h, W, b, "x", "out")
    assert z.where(V.argmax(F.col("out")) == F.col("y")).count() > 55
    with pytest.raises(ValueError):
        images.train_head(h.where("y = 0"), "x", "y")


def test_bdd_tables(spark):
    p = json.dumps({"name": "a.jpg", "attributes": {"weather": "Clear ", "timeofday": "daytime"}, "labels": [{"category": "car", "box2d": [0, 0, 9, 9]}, {"category": "boat", "box2d": [0, 0, 9, 3]}, {"category": "car", "box2d": None}]})
    raw = spark.createDataFrame([(1, p)], "record_id long, payload string")
    t = bdd.class_table(spark, spark.createDataFrame([("boat",), ("car",)], "category string"))
    assert t.count() == 11
    assert [(r.obj_path, r.class_name) for r in bdd.chip_annotations(raw, t, 5).collect()] == [("labels[0]", "car")]
    assert bdd.attributes(raw).head().bdd_partition == "reference"


def test_too_many_categories_are_an_error(spark):
    seen = spark.range(bdd.MAX_CLASSES + 1).selectExpr("concat('c', id) AS category")
    with pytest.raises(ValueError, match="categories"):
        bdd.class_table(spark, seen)
    assert bdd.class_table(spark, seen.limit(bdd.MAX_CLASSES)).count() == bdd.MAX_CLASSES + len(bdd.CLASSES)


def test_chip_stream_errors(spark):
    from skewline.operators import chips

    rec = lambda rows, kind="image_idx long, image_path string, boxes array<array<double>>, labels array<int>, image_w double": spark.createDataFrame(rows, kind)
    ok = rec([(0, "a", [[0.0, 0.0, 1.0, 1.0]] * 2, [1, 1], 5.0), (1, "b", [], None, None), (2, "c", [[0.0, 0.0, 2.0, 2.0]], [0], 5.0)])
    got = chips.chip_stream(ok).orderBy("chip_idx").collect()
    assert [(r.chip_idx, r.image_idx, r.object_id) for r in got] == [(0, 0, "0_1_0"), (1, 0, "0_1_1"), (2, 2, "2_0_0")]
    for bad in ([(0, "a", [], None, None)], [(0, "a", [[0.0] * 4], [1], 1.0), (1, "b", [[0.0] * 4], None, 1.0)], [(0, "a", [[0.0] * 4], [1, 2], 1.0)], [(0, "a", [[0.0] * 4], [1], 0.0)]):
        with pytest.raises(ValueError):
            chips.chip_stream(rec(bad))


def test_pipelines(spark):
    from skewline.plans import pipelines

    x, y = clusters(spark)
    train = vectors(spark, x, y=y)
    test = train.withColumn("ood", (F.col("sample_id") % 2).cast("int"))
    bank_, m = pipelines.fit_score_evaluate(train, test, {"m": D.Mahalanobis(features=COLS), "k": D.KNN(2, features=COLS)}, y="y")
    assert {r.detector for r in m.collect()} == {"m", "k"} and bank_.n_samples == 40


def test_outlier_rates_on_a_stream(spark, tmp_path):
    from datetime import datetime as T

    from skewline.streaming.scoring import outlier_rates

    rows = [(T(2024, 1, 1, 0, i), float(i)) for i in range(30)]
    df = spark.createDataFrame(rows, "ts timestamp, s double")
    df.write.parquet(str(tmp_path / "e"))
    s = outlier_rates(spark.readStream.schema(df.schema).parquet(str(tmp_path / "e")), "ts", "s", 9.5, "10 minutes", "1 minute")
    q = s.writeStream.format("memory").outputMode("complete").queryName("rates").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.n, r.n_out) for r in spark.table("rates").collect()) == [(10, 0), (10, 10), (10, 10)]


def test_what_is_saved_scores_the_same(spark, tmp_path):
    rng = np.random.default_rng(5)
    x, y = rng.normal(size=(60, 5)), rng.integers(0, 3, 60)
    df = vectors(spark, x, rng.normal(size=(60, 3)), y)
    fitted = [D.KNN(3, "manhattan", COLS), D.KNN(3, "cosine", COLS, bank_limit=10, block_numbers=100), D.PCAFusion(features=COLS), D.ViM(rng.normal(size=(3, 5)), np.zeros(3), features=COLS), D.WDiscOOD(features=COLS), D.PCA("rff_cosine", random_state=1, features=COLS)]
    for i, det in enumerate(fitted):
        det.fit(df, "y")
        saved.save(spark, det, f"{tmp_path}/{i}")
        again = saved.load(spark, f"{tmp_path}/{i}")
        assert type(again) is type(det) and np.allclose(scores(again.transform(df)), scores(det.transform(df)))
    table = df.select((F.col("sample_id") % 2).alias("f"), F.col("x")[0].alias("a"), F.when(F.col("y") > 0, F.col("x")[1]).alias("b"), F.col("y").cast("string").alias("c"))
    model = failure.LogisticPipeline(("a", "b"), ("c",)).fit(table, "f")
    saved.save(spark, model, f"{tmp_path}/model")
    p = lambda m: sorted(r.p for r in m.transform(table).collect())
    assert p(saved.load(spark, f"{tmp_path}/model")) == pytest.approx(p(model))
    with pytest.raises(ValueError):
        saved.save(spark, object(), f"{tmp_path}/x")
    spark.createDataFrame([('{"class": "os:system", "state": {}}',)], "v string").write.text(f"{tmp_path}/evil/state")
    with pytest.raises(ValueError):
        saved.load(spark, f"{tmp_path}/evil")


def test_detectors_fitted_together_score_as_alone(spark):
    rng = np.random.default_rng(8)
    x, y = rng.normal(size=(80, 5)) + 100, rng.integers(0, 3, 80)
    df = vectors(spark, x, rng.normal(size=(80, 3)), y)
    make = lambda: {"m": D.Mahalanobis(features=COLS), "p": D.PCA(features=COLS), "f": D.PCAFusion(features=COLS), "v": D.ViM(rng.normal(size=(3, 5)) * 0 + np.arange(15).reshape(3, 5), np.ones(3), features=COLS), "w": D.WDiscOOD(features=COLS), "e": D.Energy(features=COLS), "r": D.PCA("rff_cosine", random_state=2, features=COLS)}
    for name, det in D.fit_all(make(), df, "y").items():
        assert np.allclose(scores(det.transform(df)), scores(make()[name].fit(df, "y").transform(df)), rtol=1e-6), name


def test_embedder_modes_labels_and_chips(spark, tmp_path):
    images.register_model("bytes", lambda: lambda batch: (np.array([[x[0], x[1], 1.0] for x in batch]), None))
    with pytest.raises(ValueError):
        images.Embedder("nothing known")
    rows = [(i, bytes([i % 3 * 50, i % 7, 3]), i % 3, "abc"[i % 3], i // 2, [0.0, 0.0, 5.0, 5.0]) for i in range(30)]
    df = spark.createDataFrame(rows, "id int, content binary, label int, class_name string, chip_to_image int, boxes array<double>")
    e = images.Embedder("bytes")
    with pytest.raises(ValueError):
        e.fit(df, "half")
    with pytest.raises(ValueError):
        e.fit(df.drop("label"), "head")
    with pytest.raises(ValueError):
        e.fit(df, "full")
    assert e.fit_extract(df, keep=("id",)).where("logits is null").count() == 30
    out = e.fit(df, "head").extract(df, ("id",))
    assert {"id", "label", "chip_to_image", "boxes", "logits"} <= set(out.columns) and e.head.names == ("a", "b", "c")
    e.save(spark, f"{tmp_path}/e")
    again = images.Embedder.load(spark, f"{tmp_path}/e").extract(df, ("id",))
    assert sorted(map(str, again.select("id", "logits").collect())) == sorted(map(str, out.select("id", "logits").collect()))
    for bad in (df.drop("boxes"), df.withColumn("boxes", F.array(F.lit(1.0))), df.withColumn("image_sizes", F.array(F.lit(0.0), F.lit(1.0)))):
        with pytest.raises(ValueError):
            e.extract(bad)


def test_crop_chips_and_descriptor(spark):
    image = np.arange(4 * 5 * 3, dtype=np.uint8).reshape(4, 5, 3)
    df = spark.createDataFrame([(1, bytearray(image.tobytes()), 4, 5, [-1, 1, 2, 4]), (2, None, 4, 5, [0, 0, 1, 1])], "i int, pixels binary, image_h int, image_w int, region array<int>")
    got = {r.i: r for r in images.crop_chips(df, keep=("i",)).collect()}
    assert got[1].side == 3 and got[1].chip == X.crop_pixels(image, [-1, 1, 2, 4]).tobytes() and got[2].chip is None
    rec = spark.createDataFrame([(0, "p/a.jpg", [[0.0, 0.0, 5.0, 5.0], [1.0, 1.0, 4.0, 4.0]], [1, 7])], "image_idx int, image_path string, boxes array<array<double>>, labels array<int>")
    stream = chips.chip_stream(rec, class_names=["a", "b"])
    one = chips.sample_descriptor(stream, 1, ["a", "b"])
    assert one == {"index": 1, "image_index": 0, "image_path": "p/a.jpg", "image_id": "0", "object_id": one["object_id"], "box_xyxy": [1.0, 1.0, 4.0, 4.0], "label": 7}
    assert chips.sample_descriptor(stream, 0, ["a", "b"])["class_name"] == "b"
    with pytest.raises(IndexError):
        chips.sample_descriptor(stream, 2)


def test_cut_tables_are_released(spark):
    from skewline import session

    a, b = session.cut(spark.range(3), "x"), session.cut(spark.range(4), "x")
    assert session.exists(spark, a.__dict__["_cut_path"])
    session.release(a)
    assert not session.exists(spark, a.__dict__["_cut_path"]) and b.count() == 4
    assert session.cleanup(spark) >= 1 and not session.exists(spark, b.__dict__["_cut_path"])
