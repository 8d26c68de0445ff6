"""Top N items within every group by descending score bands.

Contract of ``top_n_per_group``:

* rows whose group or item is null, or whose score is null, NaN or infinite, aren't ranked;
* with ``version``, of the rows of one item only the one with the greatest version counts, before any other test
  (a tie of versions goes to the greatest ``tie`` columns, then group, then score), so an item's stale rows never rank;
* without ``version`` repeated (group, item) rows count once, with their greatest score;
* order: score descending, then item ascending; groups with fewer than N items give all they have;
* an empty table gives an empty result; columns other than those named are never read, so clashing names can't matter.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.session import cut

#: shares of the rows that lie above each band's lower bound
BANDS = (0.04, 0.2, 0.6)


def finite(c):
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))


def latest(df: DataFrame, item: str, version: str, keep: Sequence[str], tie: Sequence[str] = ()) -> DataFrame:
    """The row with the greatest version of each item: one hash shuffle, combined on the map side."""
    best = F.max(F.struct(F.col(version), *[F.col(t).alias(f"_t{i}") for i, t in enumerate(tie)], *[F.col(k) for k in keep]))
    return df.where(F.col(item).isNotNull()).groupBy(item).agg(best.alias("_b")).select(item, *[F.col("_b")[k].alias(k) for k in keep])


def top_n_per_group(df: DataFrame, group: str, item: str, score: str, n: int = 5, version: str | None = None, tie: Sequence[str] = (), bands: Sequence[float] = BANDS) -> DataFrame:
    """(group, item, score, rank) of the N best items of each group.

    Bands of the score are cut by approximate percentiles (they steer only the speed) and written as partitions of one
    table. From the top band down, each task first keeps at most N rows per group (so a group of millions shuffles N rows
    a task), groups that are already filled are anti-joined away, and what a boundary band adds is ranked exactly.
    """
    if n < 1:
        raise ValueError("n must be at least 1")
    src = df.select(F.col(group).alias("g"), F.col(item).alias("i"), F.col(score).cast("double").alias("s"), *([F.col(version).alias("v")] if version else []), *[F.col(t).alias(f"t{k}") for k, t in enumerate(tie)])
    cuts = src.where(finite(F.col("s"))).agg(F.percentile_approx("s", F.array(*[F.lit(1 - b) for b in bands]), 1000).alias("q")).head()["q"] or []
    cuts = sorted({float(c) for c in cuts}, reverse=True)
    rows = latest(src, "i", "v", ["g", "s"], [f"t{k}" for k in range(len(tie))]) if version else src.where(F.col("i").isNotNull())
    rows = rows.where(F.col("g").isNotNull() & finite(F.col("s")))
    if not version:
        rows = rows.groupBy("g", "i").agg(F.max("s").alias("s"))
    # s + 0.0 makes -0.0 and 0.0 one score
    rows = rows.select("g", "i", (F.col("s") + 0.0).alias("s"))
    band = F.lit(len(cuts))
    for k, c in reversed(list(enumerate(cuts))):
        band = F.when(F.col("s") >= c, F.lit(k)).otherwise(band)
    banded = cut(rows.withColumn("band", band.cast("int")), "topn-bands", partition_by="band")
    by_rank = Window.partitionBy("g").orderBy(F.col("s").desc(), F.col("i").asc())
    done: list[DataFrame] = []
    for k in range(len(cuts) + 1):
        # the filter beside row_number makes Spark keep N rows per group in each task before the exchange
        top = banded.where(F.col("band") == k).select("g", "i", "s").withColumn("r", F.row_number().over(by_rank)).where(F.col("r") <= n)
        if done:
            have = _union(done).groupBy("g").agg(F.count(F.lit(1)).cast("int").alias("have"))
            filled = have.where(F.col("have") >= n).select("g")
            top = top.join(filled, "g", "left_anti").join(have, "g", "left")
            top = top.withColumn("r", F.col("r") + F.coalesce("have", F.lit(0))).where(F.col("r") <= n).drop("have")
        done.append(cut(top, "topn-found"))
    return _union(done).select(F.col("g").alias(group), F.col("i").alias(item), F.col("s").alias(score), F.col("r").alias("rank"))


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
