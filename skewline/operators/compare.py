"""Ranks, disagreements, correlations and normalisation of scores."""

from __future__ import annotations

from dataclasses import replace
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.operators.bank import CLASS, GROUP, ID, LABEL, ScoreBank
from skewline.operators.ranks import running


def ordinal_ranks(bank: ScoreBank) -> DataFrame:
    """sample_id and the 0-based ordinal rank of each detector's ascending score; ties by sample_id."""
    long = running(bank.long(ID), ["detector"], "score", {"k": F.lit(1).cast("long")}, ascending=True, tie=ID)
    return long.groupBy(ID).agg(*[F.max(F.when(F.col("detector") == d, F.col("k") - 1)).alias(d) for d in bank.detectors])


def rank_samples(bank: ScoreBank, detector: str, top_k: int = 20, direction: str = "ood", rank_range: tuple[int, int] | None = None) -> DataFrame:
    """rank, sample_id, score: the most (``ood``) or least (``id``) outlying samples, or those of a half-open range of ranks."""
    if direction not in ("ood", "id"):
        raise ValueError("direction must be ood or id")
    if detector not in bank.detectors:
        raise KeyError(detector)
    s = F.col(detector)
    order = [F.isnan(s).asc(), s.desc() if direction == "ood" else s.asc(), F.col(ID).asc()]
    a, b = rank_range or (0, top_k)
    a = max(a, 0)
    if b <= a:
        raise ValueError("the range of ranks is empty")
    top = bank.df.orderBy(*order).limit(b)  # a top-k in each task, then of theirs
    extra = [c for c in (CLASS, GROUP, LABEL) if c in bank.df.columns]
    out = top.withColumn("rank", (F.row_number().over(Window.orderBy(*order)) - 1).cast("long"))
    return out.where(F.col("rank") >= a).select("rank", ID, s.alias("score"), *extra)


def rank_grid(bank: ScoreBank, detector: str, top_k: int = 20, direction: str = "ood", rank_range=None, class_id: int | str | None = None, group: str | None = None, ood: int | None = None) -> DataFrame:
    """``rank_samples`` within a class, group or truth: filtered before ranking. An empty pool is a ValueError."""
    if class_id is not None:
        bank = bank.by_class(class_id)
    if group is not None:
        bank = bank.by_group(group)
    if ood is not None:
        bank._need(LABEL, "ood labels")
        bank = bank.where(F.col(LABEL) == int(ood))
    if bank.df.isEmpty():
        raise ValueError("no samples pass the filters")
    return rank_samples(bank, detector, top_k, direction, rank_range)


def disagreements(bank: ScoreBank, a: str, b: str, top_k: int = 20) -> DataFrame:
    """sample_id, rank_a, rank_b, gap: the samples that two detectors rank most differently."""
    for d in (a, b):
        if d not in bank.detectors:
            raise KeyError(d)
    r = ordinal_ranks(replace(bank, detectors=(a, b)))
    out = r.select(ID, F.col(a).alias("rank_a"), F.col(b).alias("rank_b"), F.abs(F.col(a) - F.col(b)).alias("gap"))
    return out.orderBy(F.col("gap").desc(), ID).limit(top_k)


def score_correlation(bank: ScoreBank, method: str = "spearman") -> DataFrame:
    """detector_a, detector_b, corr of every ordered pair; spearman: Pearson of ordinal ranks."""
    if method not in ("spearman", "pearson"):
        raise ValueError("method must be spearman or pearson")
    if len(bank.detectors) < 2:
        raise ValueError("at least two detectors are needed")
    d = ordinal_ranks(bank) if method == "spearman" else bank.df
    pairs = list(combinations(bank.detectors, 2))
    one = d.agg(*[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    rows = [F.struct(F.lit(x).alias("detector_a"), F.lit(y).alias("detector_b"), F.col(f"c{i}").alias("corr")) for i, (a, b) in enumerate(pairs) for x, y in ((a, b), (b, a))]
    rows += [F.struct(F.lit(x).alias("detector_a"), F.lit(x).alias("detector_b"), F.lit(1.0).alias("corr")) for x in bank.detectors]
    return one.select(F.inline(F.array(*rows)))


def normalize_scores(bank: ScoreBank, method: str = "standardize") -> ScoreBank:
    """Scores less their mean over their population deviation (0 counts as 1), or scaled to [0, 1] (constant: 0). The new bank keeps labels, classes and metrics, but no groups and no class names."""
    if method not in ("standardize", "minmax"):
        raise ValueError("method must be standardize or minmax")
    ds = bank.detectors
    c = lambda d: F.col(d).cast("double")
    stats = bank.df.agg(*[f(c(d)).alias(f"_{n}_{d}") for d in ds for n, f in (("m", F.avg), ("s", F.stddev_pop), ("lo", F.min), ("hi", F.max))])
    joined = bank.df.join(F.broadcast(stats))
    out = {}
    for d in ds:
        m, s, lo, hi = (F.col(f"_{n}_{d}") for n in ("m", "s", "lo", "hi"))
        out[d] = (c(d) - m) / F.when(s > 0, s).otherwise(F.lit(1.0)) if method == "standardize" else F.when(hi > lo, (c(d) - lo) / (hi - lo)).otherwise(F.lit(0.0))
    cols = [out[x].cast("float").alias(x) if x in out else F.col(x) for x in bank.df.columns if x != GROUP]
    return replace(bank, df=joined.select(*cols), class_names=None)
