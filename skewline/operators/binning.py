"""Quantile-binned curves, calibration, histograms and kernel densities, as tables."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from skewline.operators.bank import CLASS, GROUP, LABEL, ScoreBank
from skewline.operators.ranks import percentiles


def place(value: Column, edges: Column) -> Column:
    """Number of the inner edges that a value reaches."""
    return F.size(F.filter(edges, lambda e: e <= value))


def score_vs_metric(bank: ScoreBank, metric: str, detectors: tuple[str, ...] | None = None, n_bins: int = 10) -> DataFrame:
    """detector, bin, left, right, center, mean_metric, n_samples over exact quantile bins of the score; an empty bin has a null mean."""
    if metric not in bank.metrics:
        raise KeyError(metric)
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    detectors = detectors or bank.detectors
    long = bank.df.select(metric, *detectors).unpivot([metric], list(detectors), "detector", "score")
    n_bins = max(1, min(n_bins, bank.df.count()))
    edges = percentiles(long, ["detector"], "score", [i / n_bins for i in range(n_bins + 1)], "edges").drop("n")
    d = long.join(F.broadcast(edges), "detector").withColumn("bin", place(F.col("score").cast("double"), F.slice("edges", 2, n_bins - 1) if n_bins > 1 else F.array().cast("array<double>")))
    got = d.groupBy("detector", "bin").agg(F.avg(F.col(metric).cast("double")).alias("mean_metric"), F.count(F.lit(1)).alias("n_samples"))
    spine = edges.select("detector", "edges", F.explode(F.sequence(F.lit(0), F.lit(n_bins - 1))).alias("bin"))
    left, right = F.col("edges")[F.col("bin")], F.col("edges")[F.col("bin") + 1]
    return spine.join(got, ["detector", "bin"], "left").select("detector", "bin", left.alias("left"), right.alias("right"), ((left + right) / 2).alias("center"), "mean_metric", F.coalesce("n_samples", F.lit(0).cast("long")).alias("n_samples"))


def calibration_bins(df: DataFrame, y: str, p: str, n_bins: int = 10) -> DataFrame:
    """bin, left, right, n, mean_predicted, observed: right-open bins of equal width, the last closed; all bins come out."""
    if n_bins < 1:
        raise ValueError("n_bins must be at least 1")
    e = np.linspace(0, 1, n_bins + 1)
    edges = F.array(*[F.lit(float(x)) for x in e])
    inner = F.array(*[F.lit(float(x)) for x in e[1:-1]]) if n_bins > 1 else F.array().cast("array<double>")
    d = df.select(F.col(y).cast("double").alias("y"), F.col(p).cast("double").alias("p")).where("y is not null and p is not null")
    got = d.groupBy(place(F.col("p"), inner).alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.avg("p").alias("mean_predicted"), F.avg("y").alias("observed"))
    spine = df.sparkSession.range(n_bins).select(F.col("id").cast("int").alias("bin"))
    return spine.join(F.broadcast(got), "bin", "left").select("bin", edges[F.col("bin")].alias("left"), edges[F.col("bin") + 1].alias("right"), F.coalesce("n", F.lit(0).cast("long")).alias("n"), "mean_predicted", "observed")


def _pooled(bank: ScoreBank, standardize: bool) -> DataFrame:
    bank._need(LABEL, "ood labels")
    long = bank.long(LABEL).select("detector", F.col("score").cast("double").alias("s"), F.when(F.col(LABEL) == 1, "ood").otherwise("id").alias("pool"))
    if not standardize:
        return long
    stats = long.where("pool = 'id'").groupBy("detector").agg(F.avg("s").alias("m"), F.stddev_pop("s").alias("sd"), F.count(F.lit(1)).alias("c"))
    ok = F.when((F.col("c") >= 2) & (F.col("sd") > 0), (F.col("s") - F.col("m")) / F.col("sd")).otherwise(F.raise_error(F.lit("two ID scores that differ are needed")))
    return long.join(F.broadcast(stats), "detector").select("detector", ok.alias("s"), "pool")


def score_histogram(bank: ScoreBank, bins: int = 30, standardize: bool = False) -> DataFrame:
    """detector, pool, bin, left, right, n, density; bins are shared by the pools, the last is closed; density sums to one per pool."""
    d = _pooled(bank, standardize)
    span = d.groupBy("detector").agg(F.min("s").alias("lo"), F.max("s").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    b = F.when(F.col("hi") > F.col("lo"), F.least(F.floor((F.col("s") - F.col("lo")) / width), F.lit(bins - 1))).otherwise(F.lit(0)).cast("int")
    got = d.join(F.broadcast(span), "detector").groupBy("detector", "pool", b.alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = d.groupBy("detector", "pool").agg(F.count(F.lit(1)).alias("total"))
    spine = total.join(F.broadcast(span), "detector").withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    out = spine.join(got, ["detector", "pool", "bin"], "left")
    n = F.coalesce("n", F.lit(0).cast("long"))
    return out.select("detector", "pool", "bin", (F.col("lo") + F.col("bin") * width).alias("left"), (F.col("lo") + (F.col("bin") + 1) * width).alias("right"), n.alias("n"), F.try_divide(n, F.col("total") * width).alias("density"))


def gaussian_kde(df: DataFrame, keys: list[str], value: str, grid: int = 256, pad: float = 0.05, min_points: int = 2) -> DataFrame:
    """keys, point, x, density on a grid of the padded range, with Scott's bandwidth; keys with fewer or constant values drop out.

    Each task adds its values up on its keys' grids, in arrays, before anything is shuffled.
    """
    d = df.select(*keys, F.col(value).cast("double").alias("v")).where("v is not null and not isnan(v)")
    stats = d.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("v").alias("sd"), F.min("v").alias("lo"), F.max("v").alias("hi")).where(F.col("n") >= max(2, min_points)).where("sd > 0")
    span = F.col("hi") - F.col("lo")
    lo, hi = F.col("lo") - pad * span, F.col("hi") + pad * span
    stats = stats.select(*keys, "n", (F.col("sd") * F.pow(F.col("n").cast("double"), F.lit(-0.2))).alias("h"), lo.alias("a"), ((hi - lo) / (grid - 1)).alias("step"))
    joined = d.join(stats, keys) if keys else d.join(F.broadcast(stats))  # without keys one row
    joined = joined.select(*keys, "v", "n", "h", "a", "step")

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        points, sums = np.arange(grid), {}
        for b in batches:
            names = [b.column(i).to_pylist() for i in range(len(keys))]
            v, n, h, a, step = (b.column(len(keys) + i).to_numpy() for i in range(5))
            place: dict[tuple, list[int]] = {}
            for i, key in enumerate(zip(*names) if names else [()] * len(v)):
                place.setdefault(key, []).append(i)
            for key, rows in place.items():
                i = rows[0]
                x = a[i] + points * step[i]
                at = sums.setdefault(key, (n[i], h[i], a[i], step[i], np.zeros(grid)))[4]
                for s in range(0, len(rows), 4096):
                    at += np.exp(-0.5 * ((x - v[rows[s : s + 4096], None]) / h[i]) ** 2).sum(0)
        cols = [pa.array([k[i] for k in sums], f) for i, f in enumerate(kinds)]
        rest = [pa.array([x[i] for x in sums.values()], pa.int64() if i == 0 else pa.float64()) for i in range(4)]
        yield pa.RecordBatch.from_arrays([*cols, *rest, pa.array([x[4] for x in sums.values()], pa.list_(pa.float64()))], names=[*keys, "n", "h", "a", "step", "sums"])

    kinds = [to_arrow_type(joined.schema[k].dataType) for k in keys]
    schema = ", ".join([*(f"`{k}` {joined.schema[k].dataType.simpleString()}" for k in keys), "n long, h double, a double, step double, sums array<double>"])
    each = joined.mapInArrow(add, schema).select(*keys, "n", "h", "a", "step", F.posexplode("sums").alias("point", "s"))
    out = each.groupBy(*keys, "point", "n", "h", "a", "step").agg(F.sum("s").alias("s"))
    return out.select(*keys, "point", (F.col("a") + F.col("point") * F.col("step")).alias("x"), (F.col("s") / (F.col("n") * F.col("h") * F.sqrt(F.lit(2 * np.pi)))).alias("density"))


def score_kde(bank: ScoreBank, standardize: bool = False, grid: int = 256) -> DataFrame:
    return gaussian_kde(_pooled(bank, standardize), ["detector", "pool"], "s", grid)


def score_kde_grid(bank: ScoreBank, detector: str, grid: int = 64, min_per_side: int = 5) -> DataFrame:
    """Densities per class and group, where both have enough samples."""
    return gaussian_kde(bank.df, [CLASS, GROUP], detector, grid, min_points=min_per_side)
