"""Orders over whole tables without a task that sees them all: running sums, dense numbers, exact percentiles, first k by hash.

A ranking is cut into value buckets whose sums give each bucket its offset. Where one value takes a bucket of its own its
rows are cut once more by their tie column, so a score that most rows share is spread too. The cuts are approximate and
steer only the speed; results are exact.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

#: buckets of a ranking, each a task's work
BUCKETS = 16


def ordinal(df: DataFrame, col: str) -> Column:
    """A number that never falls as the column rises: the value itself, or the first bytes of a string."""
    if isinstance(df.schema[col].dataType, NumericType):
        return F.col(col).cast("double")
    return F.conv(F.rpad(F.hex(F.substring(F.encode(F.col(col).cast("string"), "UTF-8"), 1, 6)), 12, "0"), 16, 10).cast("double")


def _cuts(value: str, buckets: int) -> Column:
    return F.percentile_approx(value, F.array(*[F.lit(i / buckets) for i in range(1, buckets)]), 2000)


def running(df: DataFrame, keys: Sequence[str], value: str, sums: dict[str, Column], ascending: bool = False, tie: str | None = None, buckets: int = BUCKETS) -> DataFrame:
    """Adds to each row the sums over its key's rows up to it (``name``) and over all of them (``name_all``).

    Order: value descending or ascending, null and NaN last, then ``tie`` ascending. Without a tie column rows of one
    value must be one row.
    """
    own = list(keys)
    by = own or ["_key"]
    v = F.col(value).cast("double")
    v = F.when(F.isnan(v), F.lit(None)).otherwise(-v if ascending else v)
    d = df if own else df.withColumn("_key", F.lit(0))
    d = d.withColumn("_s", v).select("*", *[c.alias(f"_v_{n}") for n, c in sums.items()], *([ordinal(df, tie).alias("_t")] if tie else []))
    cuts = d.groupBy(*by).agg(_cuts("_s", buckets).alias("_cuts"), *([_cuts("_t", buckets).alias("_ties")] if tie else []))
    d = d.join(cuts, by, "left")
    place = F.when(F.col("_s").isNull(), F.lit(buckets)).otherwise(F.size(F.filter("_cuts", lambda c: c > F.col("_s"))))
    # the rows of a value that is a cut are the last of its bucket; those without a value have one of their own
    sub = F.when(F.coalesce(F.array_contains("_cuts", F.col("_s")), F.lit(True)), F.size(F.filter("_ties", lambda c: c <= F.col("_t"))) + 1).otherwise(F.lit(0)) if tie else F.lit(0)
    d = d.withColumn("_b", F.greatest(place, F.lit(0))).withColumn("_u", F.coalesce(sub, F.lit(0))).drop("_cuts", "_ties", "_t")
    parts = d.groupBy(*by, "_b", "_u").agg(*[F.sum(f"_v_{n}").alias(f"_p_{n}") for n in sums])
    before = Window.partitionBy(*by).orderBy("_b", "_u").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*by)
    parts = parts.select(*by, "_b", "_u", *[F.coalesce(F.sum(f"_p_{n}").over(before), F.lit(0)).alias(f"_0_{n}") for n in sums], *[F.sum(f"_p_{n}").over(whole).alias(f"{n}_all") for n in sums])
    order = Window.partitionBy(*by, "_b", "_u").orderBy(F.col("_s").desc_nulls_last(), *([F.col(tie).asc()] if tie else [])).rowsBetween(Window.unboundedPreceding, 0)
    d = d.select("*", *[F.sum(f"_v_{n}").over(order).alias(f"_r_{n}") for n in sums]).join(parts, [*by, "_b", "_u"])
    return d.select(*df.columns, *[(F.col(f"_0_{n}") + F.col(f"_r_{n}")).alias(n) for n in sums], *[F.col(f"{n}_all") for n in sums])


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: Sequence[float], out: str = "percentiles") -> DataFrame:
    """keys, n and an array of exact linear percentiles. Nulls and NaN take no part.

    Values are counted first, so a task sees distinct values of one bucket only; for groups known to be small
    ``F.percentile`` is cheaper.
    """
    own = list(keys)
    d = df.select(*own, F.col(value).cast("double").alias("_x")).where("_x is not null and not isnan(_x)")
    steps = d.groupBy(*own, (F.col("_x") + 0.0).alias("_x")).agg(F.count(F.lit(1)).alias("_n"))
    r = running(steps, own, "_x", {"_k": F.col("_n")}, ascending=True)
    pos = [(F.col("_k_all") - 1) * F.lit(float(p)) for p in shares]
    at = lambda c: (F.col("_k") > c) & (F.col("_k") - F.col("_n") <= c)
    aggs = [F.max("_k_all").alias("n")]
    for i, p in enumerate(pos):
        aggs += [F.max(F.when(at(F.floor(p)), F.col("_x"))).alias(f"_a{i}"), F.max(F.when(at(F.ceil(p)), F.col("_x"))).alias(f"_b{i}")]
    # the greatest positions are those of the key, the same in all its rows
    got = r.groupBy(*own).agg(*aggs).where("n is not null")
    value_at = [F.col(f"_a{i}") + (F.col(f"_b{i}") - F.col(f"_a{i}")) * ((F.col("n") - 1) * F.lit(float(p)) - F.floor((F.col("n") - 1) * F.lit(float(p)))) for i, p in enumerate(shares)]
    return got.select(*own, "n", F.array(*value_at).alias(out))


def first_by_hash(df: DataFrame, key: str, k: int, order: Column) -> DataFrame:
    """(key) of the k first rows by a hexadecimal hash, then key: counted by the hash's first digits, so only one of 65536 parts is sorted."""
    d = df.select(key, order.alias("_h")).withColumn("_p", F.substring("_h", 1, 4))
    counts = sorted((r["_p"], r["n"]) for r in d.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect())  # 65536 rows at most
    before = 0
    for p, n in counts:
        if before + n >= k:
            edge = d.where(F.col("_p") == p).orderBy("_h", key).limit(k - before)
            return d.where(F.col("_p") < p).select(key).unionByName(edge.select(key))
        before += n
    return d.select(key)


def dense(df: DataFrame, keys: Sequence[str], order: str, out: str, buckets: int = BUCKETS) -> DataFrame:
    """Adds ``out``: 0, 1, … in each key's order of a column of distinct values, numbers or strings."""
    o = "_ordinal"
    d = df.withColumn(o, ordinal(df, order))
    r = running(d, keys, o, {out: F.lit(1).cast("long")}, ascending=True, tie=order, buckets=buckets)
    return r.withColumn(out, F.col(out) - 1).drop(o, f"{out}_all")
