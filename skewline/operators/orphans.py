"""References to records that do not exist at that time.

Contract: null and blank keys are no reference; keys are compared trimmed and in lower case; a reference is fulfilled if
some target row with an equal key has ``start <= at`` and an ``end`` that is null or later than ``at``; a reference
without ``at`` is never fulfilled, a target row without ``start`` fulfils nothing. Repeated rows give one result row.
Only the named columns are read. Empty tables on either side are allowed.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.functions.keys import eq_key, ref_key


@dataclass(frozen=True)
class Target:
    """A table that is referred to: its key and the time from and until which a row exists."""

    name: str
    df: DataFrame
    key: str
    start: str
    end: str | None = None


@dataclass(frozen=True)
class Reference:
    """A field that refers to a target."""

    src_table: str
    ref_field: str
    target: str
    df: DataFrame
    row_key: str
    at: str


FAR = "9999-12-31 00:00:00"


def _long_form(targets: list[Target], refs: list[Reference]) -> DataFrame:
    """Parents and children in one long table, tagged; parents that start at the same time are one row."""
    parts = []
    for t in targets:
        until = F.coalesce(F.col(t.end), F.lit(FAR).cast("timestamp_ntz")) if t.end else F.lit(FAR).cast("timestamp_ntz")
        p = t.df.select(ref_key(F.col(t.key)).alias("k"), F.col(t.start).cast("timestamp_ntz").alias("at"), until.cast("timestamp_ntz").alias("until"))
        p = p.where(F.col("k").isNotNull() & F.col("at").isNotNull()).groupBy("k", "at").agg(F.max("until").alias("until"))
        parts.append(p.select(F.lit(t.name).alias("target"), "k", "at", "until", F.lit(-1).alias("ref"), F.lit(None).cast("string").alias("row_key")))
    for n, r in enumerate(refs):
        c = r.df.select(ref_key(F.col(r.ref_field)).alias("k"), F.col(r.at).cast("timestamp_ntz").alias("at"), eq_key(F.col(r.row_key)).alias("row_key")).where(F.col("k").isNotNull())
        parts.append(c.select(F.lit(r.target).alias("target"), "k", "at", F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(n).alias("ref"), "row_key"))
    return reduce(DataFrame.unionByName, parts)


#: keys that the search for hot ones tracks: it can't miss one with more than 1 / 7500 of the rows
TRACKED = 10_000


def _hot_keys(targets: list[Target], refs: list[Reference], hot_rows: int) -> tuple[int, list[tuple[str, str, int]]]:
    """(rows in all, (target, key, about how many rows) of the keys that are too many for one task): one pass, nothing is shuffled."""
    sides = [(t.name, t.df, t.key) for t in targets] + [(r.target, r.df, r.ref_field) for r in refs]
    rows = reduce(DataFrame.unionByName, [df.select(F.concat(F.lit(f"{n}\0"), ref_key(F.col(c))).alias("k")) for n, df, c in sides])
    r = rows.where("k is not null").agg(F.count(F.lit(1)).alias("n"), F.expr(f"approx_top_k(k, 2000, {TRACKED})").alias("top")).head()
    least = max(hot_rows, r["n"] // 2000)
    return r["n"], [(*x["item"].split("\0", 1), x["count"]) for x in r["top"] or [] if x["count"] > least]


def check_references(targets: list[Target], refs: list[Reference], hot_rows: int = 200_000) -> DataFrame:
    """(src_table, ref_field, row_key, at, orphan) of every reference.

    Tagged rows are grouped by target and key and run through in time order: the running maximum of the parents' ends
    tells whether a parent is there. A key with more than ``hot_rows`` rows (or 1/2000 of all, so there are at most 2000
    of them) is cut into time slices, each with one row that carries over what the slices before it held; the children of a
    slice that is still too large, because they share one time, are dealt out. No key's rows need meet in one task.
    """
    long = _long_form(targets, refs)
    total, hot = _hot_keys(targets, refs, hot_rows)
    least = max(hot_rows, total // 2000)
    if hot:
        slices = max(2, max(-(-n // least) for _, _, n in hot))
        spark = long.sparkSession
        keys = ["target", "k"]
        names = spark.createDataFrame([(a, b) for a, b, _ in hot], "target string, k string")
        cuts = long.join(F.broadcast(names), keys, "left_semi").groupBy(*keys).agg(F.percentile_approx(F.unix_micros(F.col("at").cast("timestamp")), F.array(*[F.lit(j / slices) for j in range(1, slices)])).alias("cuts"))
        long = long.join(F.broadcast(cuts), keys, "left")
        long = long.withColumn("slice", F.when(F.col("cuts").isNull() | F.col("at").isNull(), 0).otherwise(F.size(F.filter("cuts", lambda c: c <= F.unix_micros(F.col("at").cast("timestamp")))))).drop("cuts")
        by_slice = Window.partitionBy(*keys).orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
        hot_rows_ = long.join(F.broadcast(names), keys, "left_semi")
        spine = F.broadcast(names).withColumn("slice", F.explode(F.sequence(F.lit(0), F.lit(slices - 1))))
        carried = spine.join(hot_rows_.where("ref = -1").groupBy(*keys, "slice").agg(F.max("until").alias("until")), [*keys, "slice"], "left").withColumn("until", F.max("until").over(by_slice))
        carried = carried.where("until is not null").select("target", "k", F.lit("0001-01-01 00:00:00").cast("timestamp_ntz").alias("at"), "until", F.lit(-1).alias("ref"), F.lit(None).cast("string").alias("row_key"), "slice")
        long = long.unionByName(carried)
        # a slice of one time can't be cut by time: its children are dealt out, each part with the slice's parents (one a time)
        parts = hot_rows_.groupBy(*keys, "slice").agg(F.ceil(F.count(F.lit(1)) / least).cast("int").alias("parts")).where("parts > 1")  # at most total / least slices
        long = long.join(F.broadcast(parts), [*keys, "slice"], "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
        dealt = F.array(F.pmod(F.xxhash64("ref", "row_key"), F.col("parts")).cast("int"))
        long = long.withColumn("part", F.explode(F.when(F.col("ref") >= 0, dealt).otherwise(F.sequence(F.lit(0), F.col("parts") - 1)))).drop("parts")
    else:
        long = long.withColumn("slice", F.lit(0)).withColumn("part", F.lit(0))
    run = Window.partitionBy("target", "k", "slice", "part").orderBy(F.col("at").asc_nulls_first(), F.col("ref").asc()).rowsBetween(Window.unboundedPreceding, 0)
    seen = long.withColumn("seen", F.max("until").over(run)).where("ref >= 0")
    pick = lambda xs: F.element_at(F.array(*[F.lit(x) for x in xs]), F.col("ref") + 1)
    return seen.select(pick([r.src_table for r in refs]).alias("src_table"), pick([r.ref_field for r in refs]).alias("ref_field"), "row_key", "at", (~F.coalesce(F.col("seen") > F.col("at"), F.lit(False))).alias("orphan"))


def orphan_rows(targets: list[Target], refs: list[Reference], hot_rows: int = 200_000) -> DataFrame:
    """Distinct (src_table, ref_field, row_key) of the references that aren't fulfilled."""
    return check_references(targets, refs, hot_rows).where("orphan").select("src_table", "ref_field", "row_key").distinct()


def orphans_by_period(targets: list[Target], refs: list[Reference], period: str = "month", hot_rows: int = 200_000) -> DataFrame:
    """Counts of references and orphans per table, field and period; references without a time have a null period."""
    rows = check_references(targets, refs, hot_rows).distinct()
    return rows.groupBy("src_table", "ref_field", F.date_trunc(period, F.col("at")).cast("date").alias("period")).agg(F.count(F.lit(1)).alias("n_refs"), F.sum(F.col("orphan").cast("long")).alias("n_orphans"))
