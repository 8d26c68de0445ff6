"""Masks over samples: filters of features, fitting on a mask, correct predictions, samples and splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.functions.vectors import argmax, doubles, max_softmax
from skewline.operators.detectors import Detector
from skewline.operators.ranks import dense, first_by_hash, running


def as_mask(df: DataFrame, mask: str) -> Column:
    """Boolean column from a boolean or 0/1 column; anything else is an error at run time, another type a ValueError."""
    kind = dict(df.dtypes)[mask]
    c = F.col(mask)
    if kind == "boolean":
        return c
    if kind not in ("tinyint", "smallint", "int", "bigint", "float", "double"):
        raise ValueError(f"a mask is boolean or 0/1, not {kind}")
    return F.when(c.isin(0, 1), c == 1).otherwise(F.raise_error(F.lit("a mask holds 0 and 1 only")))


def subset(df: DataFrame, mask: str) -> DataFrame:
    return df.where(as_mask(df, mask))


def fit_on_mask(detector: Detector, df: DataFrame, mask: str, y: str | None = None, min_samples: int = 1) -> Detector:
    """Fits on the selected rows; too few of them is a ValueError."""
    if min_samples < 1:
        raise ValueError("min_samples must be at least 1")
    rows = subset(df, mask)
    if rows.limit(min_samples).count() < min_samples:
        raise ValueError(f"fewer than {min_samples} rows selected")
    return detector.fit(rows, y)


def correct_prediction(logits: str, label: str, min_confidence: float | None = None) -> Column:
    """Whether the first greatest logit is the label's and, with a floor, the softmax confidence reaches it."""
    z = doubles(F.col(logits))
    hit = argmax(z) == F.col(label)
    if min_confidence is None:
        return hit
    if not 0 <= min_confidence <= 1:
        raise ValueError("min_confidence must be in [0, 1]")
    return hit & (max_softmax(z) >= F.lit(float(min_confidence)))


def hash_key(seed: str | int, key: Column) -> Column:
    """Order that any engine can reproduce: md5 of seed and key."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")))


def sample_groups(df: DataFrame, group: str, fraction: float, seed: str | int = 0) -> DataFrame:
    """Rows of max(1, int(n * fraction)) of the groups, picked by hash; groups keep all their rows. Adds ``idx``: the dense number of the group."""
    if not 0 < fraction <= 1:
        raise ValueError("fraction must be in (0, 1]")
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    n = max(1, int(groups.count() * fraction))
    return df.join(dense(first_by_hash(groups, group, n, hash_key(seed, F.col(group))), [], group, "idx"), group)


def stratified(df: DataFrame, stratum: str, key: str, fraction: float, seed: str | int = 0) -> DataFrame:
    """Of each stratum the first max(1, min(round-half-even(n * fraction), n)) rows in hash order; null strata are one stratum."""
    return _strata(df, stratum, key, (fraction,), seed).where("part = 0").drop("part")


def stratified_split(df: DataFrame, stratum: str, key: str, fractions: tuple[float, ...], seed: str | int = 0) -> DataFrame:
    """Adds ``part``: 0, 1, … for the disjoint shares of each stratum in hash order, null for what is left."""
    if min(fractions) < 0 or sum(fractions) > 1 + 1e-9:
        raise ValueError("fractions must not be negative and sum to at most 1")
    return _strata(df, stratum, key, fractions, seed)


def stratum_counts(df: DataFrame, stratum: str, part: str | None = None) -> DataFrame:
    """Rows of each stratum, and of each part of it."""
    return df.groupBy(stratum, *([part] if part else [])).agg(F.count(F.lit(1)).alias("n"))


def _strata(df: DataFrame, stratum: str, key: str, fractions: tuple[float, ...], seed: str | int) -> DataFrame:
    """A stratum may be most of the table: its rows are numbered in buckets of the hash."""
    h = F.conv(F.substring("_h", 1, 12), 16, 10).cast("double")
    d = df.withColumn("_h", hash_key(seed, F.col(key))).withColumn("_g", F.coalesce(F.col(stratum).cast("string"), F.lit("\0"))).withColumn("_o", h)
    d = d.withColumn("_h", F.concat("_h", F.lit(":"), F.col(key).cast("string")))
    r = running(d, ["_g"], "_o", {"_r": F.lit(1).cast("long")}, ascending=True, tie="_h")
    part, top = F.lit(None).cast("int"), F.lit(0).cast("long")
    for i, f in enumerate(fractions):
        k = F.greatest(F.lit(1), F.least(F.bround(F.col("_r_all") * F.lit(float(f))).cast("long"), F.col("_r_all"))) if f else F.lit(0).cast("long")
        part = F.when((F.col("_r") > top) & (F.col("_r") <= top + k), F.lit(i)).otherwise(part)
        top = top + k
    return r.withColumn("part", part).select(*df.columns, "part")


def grouped_split(df: DataFrame, group: str, test_size: float = 0.3, seed: str | int = 0, test_groups: list | None = None) -> DataFrame:
    """Adds ``is_test``; a group is wholly in or out. ceil(test_size * groups) groups are test, by hash order, or those given."""
    groups = df.select(group).where(F.col(group).isNotNull()).distinct()
    if test_groups is not None:
        return df.withColumn("is_test", F.col(group).isin(test_groups))
    n = groups.count()
    if n < 2:
        raise ValueError("at least two groups are needed")
    k = min(n - 1, -int(-test_size * n // 1))
    test = first_by_hash(groups, group, k, hash_key(seed, F.col(group))).withColumn("is_test", F.lit(True))
    return df.join(test, group, "left").withColumn("is_test", F.coalesce("is_test", F.lit(False)))


def permutation_split(df: DataFrame, key: str, train_share: float = 0.9, seed: str | int = 0) -> DataFrame:
    """Adds ``is_train``: the first int(n * train_share) rows in hash order."""
    n = df.count()
    train = first_by_hash(df, key, int(n * train_share), hash_key(seed, F.col(key))).withColumn("is_train", F.lit(True))
    return df.join(train, key, "left").withColumn("is_train", F.coalesce("is_train", F.lit(False)))
