"""Concatenation of feature blocks: labels from counts, unions in block order, running image offsets."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewline.operators.ranks import dense


def ood_labels_from_counts(spark: SparkSession, n_id: int, n_ood: int) -> DataFrame:
    """sample_id, ood: zeros, then ones."""
    if n_id < 0 or n_ood < 0:
        raise ValueError("counts must not be negative")
    return spark.range(n_id + n_ood).select(F.col("id").alias("sample_id"), F.when(F.col("id") < n_id, 0).otherwise(1).alias("ood"))


def ood_labels_from_blocks(spark: SparkSession, lengths: list[int], flags: list[int]) -> DataFrame:
    """sample_id, block, ood: each block's flag repeated over its length."""
    if len(lengths) != len(flags):
        raise ValueError("as many flags as lengths are needed")
    if any(n < 0 for n in lengths) or any(f not in (0, 1) for f in flags):
        raise ValueError("lengths must not be negative and flags must be 0 or 1")
    rows, at = [], 0
    for b, (n, f) in enumerate(zip(lengths, flags)):
        rows.append((b, at, at + n, int(f)))
        at += n
    blocks = spark.createDataFrame(rows, "block int, a long, b long, ood int")
    return spark.range(at).join(F.broadcast(blocks), (F.col("id") >= F.col("a")) & (F.col("id") < F.col("b"))).select(F.col("id").alias("sample_id"), "block", "ood")


def concatenate(blocks: list[DataFrame], flags: list[int], sample_id: str = "sample_id", image: str | None = None) -> DataFrame:
    """Union of blocks in their order with ``block``, ``ood`` and a new dense ``sample_id``.

    The blocks' columns must agree (ValueError). Images are renumbered by the running greatest index plus one. Dense ids
    come from per-partition counts: rows are range-sorted once, then each partition numbers its own.
    """
    if not blocks or len(blocks) != len(flags):
        raise ValueError("give as many flags as blocks, and at least one block")
    if any(f not in (0, 1) for f in flags):
        raise ValueError("flags must be 0 or 1")
    if any(set(b.columns) != set(blocks[0].columns) for b in blocks):
        raise ValueError("all blocks must have the same columns")
    tagged = [b.withColumn("block", F.lit(i)).withColumn("ood", F.lit(int(f))) for i, (b, f) in enumerate(zip(blocks, flags))]
    all_ = reduce(DataFrame.unionByName, tagged)
    if image:
        tops = all_.groupBy("block").agg((F.max(image) + 1).alias("top"))
        w = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # one row a block
        offsets = tops.select("block", F.coalesce(F.sum("top").over(w), F.lit(0)).alias("offset"))
        all_ = all_.join(F.broadcast(offsets), "block").withColumn(image, F.col(image) + F.col("offset")).drop("offset")
    return dense_ids(all_, ["block", sample_id], sample_id)


def dense_ids(df: DataFrame, order: list[str], out: str, slices: int = 16) -> DataFrame:
    """Numbers rows from 0 by the first column, then by the last, whose values are distinct there: numbers or strings. Each value of the first is numbered apart, in ranges of the last, and shifted by the counts before it."""
    first, last = order[0], order[-1]
    d = dense(df, [first], last, "_id", slices)
    counts = df.groupBy(first).agg(F.count(F.lit(1)).alias("_n"))
    w = Window.orderBy(first).rowsBetween(Window.unboundedPreceding, -1)  # one row a block
    counts = counts.select(first, F.coalesce(F.sum("_n").over(w), F.lit(0)).alias("_before"))
    d = d.join(F.broadcast(counts), first)
    return d.withColumn("_id", (F.col("_before") + F.col("_id")).cast("long")).drop("_before", *([out] if out in df.columns else [])).withColumnRenamed("_id", out)
