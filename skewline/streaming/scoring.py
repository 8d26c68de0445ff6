"""Scoring of streams with fitted detectors, and running outlier rates by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.operators.detectors import Detector


def score_stream(stream: DataFrame, detectors: dict[str, Detector]) -> DataFrame:
    """The stream with one score column per fitted detector: row maps without state, so any output mode goes."""
    for name, d in detectors.items():
        stream = d.transform(stream, name)
    return stream


def outlier_rates(scored: DataFrame, ts: str, score: str, threshold: float, every: str = "5 minutes", late: str = "10 minutes", keys: tuple[str, ...] = ()) -> DataFrame:
    """window, keys, n, n_out, mean_score per tumbling window; rows later than ``late`` are dropped with their windows' state."""
    over = F.col(score) > F.lit(float(threshold))
    return scored.withWatermark(ts, late).groupBy(F.window(ts, every), *keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(over).alias("n_out"), F.avg(score).alias("mean_score"))
