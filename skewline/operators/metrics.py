"""Ranking metrics over ordered samples.

Order: score descending (ascending for the ID side), NaN last, then ``sample_id``. Ties are not collapsed: each row is a
step. A ranking is cut into buckets whose counts give each its offset (``ranks``), so one detector's prefix sums are
spread over many tasks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.operators.bank import CLASS, ID, LABEL, ScoreBank
from skewline.operators.ranks import BUCKETS, running

METRICS = ("auroc", "fpr95", "aupr_ood", "aupr_id", "det_err")


def ranked(long: DataFrame, keys: list[str], positive: Column, ascending: bool = False, score: str = "score", sample_id: str = ID, buckets: int = BUCKETS) -> DataFrame:
    """Adds pos (0/1), tp (positives so far), k (rows so far), n_pos and n to each row of each key's ranking."""
    d = long.withColumn("pos", positive.cast("long"))
    r = running(d, keys, score, {"tp": F.col("pos"), "k": F.lit(1).cast("long")}, ascending, sample_id, buckets)
    return r.withColumnsRenamed({"tp_all": "n_pos", "k_all": "n"})


def _labels(df: DataFrame, label: str) -> Column:
    y = F.col(label)
    return F.when(y.isin(0, 1), y).otherwise(F.raise_error(F.lit("labels must be 0 or 1")))


def roc_points(long: DataFrame, keys: list[str] = ["detector"], label: str = LABEL) -> DataFrame:
    """keys, k, fpr, tpr: one point per row, and the origin as k = 0; both classes are needed."""
    r = ranked(long, keys, _labels(long, label))
    pts = r.select(*keys, "k", F.try_divide(F.col("k") - F.col("tp"), F.col("n") - F.col("n_pos")).alias("fpr"), F.try_divide("tp", "n_pos").alias("tpr"))
    origin = long.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("fpr"), F.lit(0.0).alias("tpr"))
    return pts.unionByName(origin)


def pr_points(long: DataFrame, positive: str = "ood", keys: list[str] = ["detector"], label: str = LABEL) -> DataFrame:
    """keys, k, recall, precision, with the sentinel (0, 1) as k = 0. positive: ``ood``, or ``id`` (ranked by ascending score)."""
    if positive not in ("ood", "id"):
        raise ValueError("positive must be ood or id")
    y = _labels(long, label)
    r = ranked(long, keys, y if positive == "ood" else 1 - y, ascending=positive == "id")
    pts = r.select(*keys, "k", F.try_divide("tp", "n_pos").alias("recall"), (F.col("tp") / F.col("k")).alias("precision"))
    first = long.select(*keys).distinct().select(*keys, F.lit(0).cast("long").alias("k"), F.lit(0.0).alias("recall"), F.lit(1.0).alias("precision"))
    return pts.unionByName(first)


def _roc_summary(long: DataFrame, keys: list[str], label: str, tpr: float) -> DataFrame:
    r = ranked(long, keys, _labels(long, label))
    n_neg = F.col("n") - F.col("n_pos")
    fp = F.col("k") - F.col("tp")
    rate, false = F.try_divide("tp", "n_pos"), F.try_divide(fp, n_neg)
    d = r.groupBy(*keys, "n_pos", "n").agg(
        F.sum(F.when(F.col("pos") == 0, F.col("tp"))).alias("area"),
        F.min(F.when(rate >= F.lit(float(tpr)), fp)).alias("fp_at"),
        F.min(F.lit(0.5) * (false + 1 - rate)).alias("err"),
        F.try_divide(F.sum(_precision_step()), F.max("n_pos")).alias("aupr_ood"),
    )
    at = F.lit(0.0) if tpr <= 0 else F.coalesce(F.try_divide("fp_at", n_neg), F.lit(1.0))
    both = (F.col("n_pos") > 0) & (n_neg > 0)
    return d.select(*keys, "n_pos", "n", F.when(both, F.try_divide("area", F.col("n_pos") * n_neg)).alias("auroc"), F.when(both, at).alias("fpr95"), F.when(both, F.least(F.lit(0.5), "err")).alias("det_err"), F.when(both, F.col("aupr_ood")).alias("aupr_ood"))


def _precision_step() -> Column:
    """Trapezoid of precision over recall: only rows that are positive move recall, by 1/n_pos."""
    # the row before has tp - 1 positives among k - 1 rows; before the first row precision is 1
    before = F.when(F.col("k") == 1, F.lit(1.0)).otherwise(F.try_divide(F.col("tp") - 1, F.col("k") - 1))
    return F.when(F.col("pos") == 1, (F.col("tp") / F.col("k") + before) / 2)


def _aupr_id(long: DataFrame, keys: list[str], label: str) -> DataFrame:
    r = ranked(long, keys, 1 - _labels(long, label), ascending=True)
    return r.groupBy(*keys).agg(F.try_divide(F.sum(_precision_step()), F.max("n_pos")).alias("aupr_id"))


def summary(long: DataFrame, keys: list[str] = ["detector"], label: str = LABEL, tpr: float = 0.95) -> DataFrame:
    """keys, auroc, fpr95, aupr_ood, aupr_id, det_err: two rankings (descending and ascending) give all five. Null where a side is missing."""
    down, up = _roc_summary(long, keys, label, tpr), _aupr_id(long, keys, label)
    both = (F.col("n_pos") > 0) & (F.col("n_pos") < F.col("n"))
    return down.join(up, keys).select(*keys, "auroc", "fpr95", "aupr_ood", F.when(both, F.col("aupr_id")).alias("aupr_id"), "det_err")


def evaluate(bank: ScoreBank) -> DataFrame:
    """detector and the five metrics. Raises ValueError without labels or detectors."""
    bank._need(LABEL, "ood labels")
    return summary(bank.long(LABEL))


def evaluate_by_class(bank: ScoreBank, strict: bool = True) -> DataFrame:
    """class_id, detector and the metrics; with ``strict`` a class that lacks a side is a ValueError, else its metrics are null."""
    bank._need(LABEL, "ood labels")
    bank._need(CLASS, "class labels")
    if strict:
        sides = bank.df.groupBy(CLASS).agg(F.countDistinct(LABEL).alias("n")).where("n < 2").limit(1).collect()
        if sides:
            raise ValueError(f"class {sides[0][CLASS]} lacks ID or OOD samples")
    return summary(bank.long(LABEL, CLASS), keys=[CLASS, "detector"])


class MetricsTable:
    """Collected metrics with a plain-text form."""

    TITLES = dict(zip(METRICS, ("AUROC", "FPR@95", "AUPR-OOD", "AUPR-ID", "DetErr")))

    def __init__(self, df: DataFrame):
        self.rows = {r["detector"]: {m: r[m] for m in METRICS} for r in df.orderBy("detector").collect()}

    def __getitem__(self, detector: str) -> dict[str, float]:
        return self.rows[detector]

    def to_dict(self) -> dict[str, dict[str, float]]:
        return {k: dict(v) for k, v in self.rows.items()}

    def __repr__(self) -> str:
        wide = max([8, *map(len, self.rows)])
        lines = [" ".join([f"{'Detector':<{wide}}", *(f"{t:>9}" for t in self.TITLES.values())])]
        for name, r in self.rows.items():
            lines.append(" ".join([f"{name:<{wide}}", *(f"{'—' if r[m] is None else format(r[m], '.4f'):>9}" for m in METRICS)]))
        return "\n".join(lines)


def classification_metrics(df: DataFrame, keys: list[str], label: str = "y", p: str = "p") -> DataFrame:
    """keys, auroc, average_precision, brier, n: ties share their rank and are one step of precision; null where a class is missing."""
    d = df.select(*keys, F.col(label).cast("long").alias("_y"), F.col(p).cast("double").alias("_p"))
    steps = d.groupBy(*keys, "_p").agg(F.sum("_y").alias("_pos"), F.count(F.lit(1)).alias("_n"), F.sum((F.col("_p") - F.col("_y")) ** 2).alias("_sq"))
    steps = running(steps, keys, "_p", {"_tp": F.col("_pos"), "_k": F.col("_n")}).withColumnsRenamed({"_tp_all": "_np", "_k_all": "_nn"})
    neg = F.col("_n") - F.col("_pos")
    # of each negative the positives above it, and half of those beside it
    wins = neg * (F.col("_tp") - F.col("_pos") / 2)
    out = steps.groupBy(*keys).agg(F.sum(wins).alias("_w"), F.sum(F.col("_pos") * F.col("_tp") / F.col("_k")).alias("_ap"), F.sum("_sq").alias("_sq"), F.max("_np").alias("_np"), F.max("_nn").alias("_nn"))
    both = (F.col("_np") > 0) & (F.col("_np") < F.col("_nn"))
    return out.select(*keys, F.when(both, F.try_divide("_w", F.col("_np") * (F.col("_nn") - F.col("_np")))).alias("auroc"), F.when(both, F.try_divide("_ap", "_np")).alias("average_precision"), F.try_divide("_sq", "_nn").alias("brier"), F.col("_nn").alias("n"))
