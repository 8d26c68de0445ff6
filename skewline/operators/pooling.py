"""Chip scores pooled to images, and image labels from chips."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

METHODS = ("mean", "max", "topk_mean")


def pool_image_scores(chips: DataFrame, score: str = "score", image: str = "image_idx", method: str = "mean", k: int = 3, n_images: int | None = None, order: str | None = None) -> DataFrame:
    """image_idx, score of each image; with ``n_images`` every index below it comes out, null without chips."""
    if method not in METHODS:
        raise ValueError(f"method must be one of {METHODS}")
    if k < 1:
        raise ValueError("k must be at least 1")
    d = chips.select(F.col(image).alias("image_idx"), F.col(score).cast("double").alias("s"), *([F.col(order).alias("o")] if order else []))
    if method == "topk_mean":
        w = Window.partitionBy("image_idx").orderBy(F.col("s").desc(), *(["o"] if order else []))
        d = d.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k)
    out = d.groupBy("image_idx").agg((F.max("s") if method == "max" else F.avg("s")).alias("score"))
    if n_images is None:
        return out
    spine = chips.sparkSession.range(n_images).withColumnRenamed("id", "image_idx")
    return spine.join(out, "image_idx", "left")


def image_labels(chips: DataFrame, image: str = "image_idx", label: str = "ood", group: str = "grp", cls: str = "class_id", chip: str = "chip_idx") -> DataFrame:
    """image_idx, ood (greatest of its chips), grp (of its last chip), class_id (most frequent, ties to the smallest)."""
    parts = chips.groupBy(F.col(image).alias("image_idx"), F.col(cls).alias("c")).agg(F.max(label).alias("y"), F.count(F.lit(1)).alias("n"), F.max(chip).alias("at"), F.max_by(group, chip).alias("g"))
    return parts.groupBy("image_idx").agg(F.max("y").alias("ood"), F.max_by("g", "at").alias("grp"), F.max_by("c", F.struct(F.col("n"), -F.col("c"))).alias("class_id"))
