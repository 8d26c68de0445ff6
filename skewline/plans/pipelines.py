"""The usual chains of operators, end to end."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.operators import analysis, detection, failure, geometry, metrics, pooling
from skewline.operators.bank import ScoreBank
from skewline.operators.detectors import Detector


def fit_score_evaluate(train: DataFrame, test: DataFrame, detectors: dict[str, Detector], ood: str = "ood", y: str | None = None, sample_id: str = "sample_id", **bank) -> tuple[ScoreBank, DataFrame]:
    """Fits each detector, scores the test rows in one pass, and gives the saved bank and its metrics."""
    fitted = {n: d.fit(train, y) for n, d in detectors.items()}
    df = test
    for n, d in fitted.items():
        df = d.transform(df, n)
    b = ScoreBank.of(df, {n: n for n in fitted}, sample_id=sample_id, ood=ood, **bank).saved()
    return b, metrics.evaluate(b)


def chips_to_images(id_chips: DataFrame, chips: DataFrame, pooler: geometry.GeometryAwarePooler | None = None) -> DataFrame:
    """image_idx with pooled, geometry-aware and fused scores; the fusion adds z-scores against the ID images of ``chips`` (ood = 0)."""
    pooler = (pooler or geometry.GeometryAwarePooler()).fit(id_chips)
    pooled = pooling.pool_image_scores(chips, method="topk_mean", order="chip_idx").withColumnRenamed("score", "pooled")
    scene = pooler.score(chips).withColumnRenamed("score", "scene")
    y = chips.groupBy("image_idx").agg(F.max("ood").alias("ood"))
    z = analysis.zscore_on_id(pooled.join(scene, "image_idx").join(y, "image_idx"), ("pooled", "scene"))
    return z.withColumn("fused", analysis.safe_add(F.col("z_pooled"), F.col("z_scene")))


def detections_to_failures(pred: DataFrame, gt: DataFrame, order: str, global_scores: DataFrame | None = None, chip_scores: DataFrame | None = None, **kw) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(failure table, metrics per feature set, predictions) from detections, ground truth and OOD scores."""
    t = detection.evaluate_detection(pred, gt, order=order, gt_order=order)
    table = detection.attach_ood_features(t.metrics, global_scores, chip_scores)
    m, p = failure.evaluate_failure_baselines(table, **kw)
    return table, m, p
