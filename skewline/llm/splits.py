"""Splits that keep related records together.

Contract of ``units``: every id gets exactly one unit, the smallest id it is connected to by shared keys or links; null
keys connect nothing; links with an end that isn't among the records (or is null) are ignored, as are self links; an
empty table gives an empty result. Contract of ``split_units``: a unit never straddles splits, whatever its size.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.session import cut, release


#: rows from which a key or hub may be too much for one task; hubs above a thousandth of the rows are joined by broadcast
HOT_FROM, HUB_SHARE = 1_000_000, 0.001


def with_least(rows: DataFrame, least: DataFrame, key: str, n_rows: int) -> DataFrame:
    """``rows`` joined with one row of each key (``m`` and its number of rows ``n``), inner.

    Of large tables the rows of hot keys (at most 1 / ``HUB_SHARE`` keys, so that is the bound of the broadcast) stay where
    they are and only the rest is shuffled.
    """
    if n_rows < HOT_FROM:
        return rows.join(least.select(key, "m"), key)
    hot = F.col("n") > int(n_rows * HUB_SHARE)
    r = rows.join(F.broadcast(least.where(hot).select(key, F.col("m").alias("_hot"))), key, "left")
    rest = r.where("_hot is null").drop("_hot").join(least.where(~hot).select(key, "m"), key)
    return r.where("_hot is not null").withColumnRenamed("_hot", "m").unionByName(rest)


def key_edges(records: DataFrame, id_col: str, keys: Sequence[str], n_rows: int = 0) -> DataFrame:
    """Edges (a, b), a > b, from each record to the smallest id with the same key: n edges a key, not n squared."""
    out = None
    for k in keys:
        rows = records.select(F.col(id_col).alias("a"), F.col(k).alias("k")).where(F.col("k").isNotNull() & F.col("a").isNotNull()).distinct()
        least = rows.groupBy("k").agg(F.min("a").alias("m"), F.count(F.lit(1)).alias("n")).where("n > 1")
        e = with_least(rows, least, "k", n_rows).where("a > m").select("a", F.col("m").alias("b"))
        out = e if out is None else out.unionByName(e)
    return out


def connected(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(id, root) of each id on some edge: the smallest id of its component.

    Alternating large-star and small-star steps, until every component is a star: O(log^2 n) rounds at most. A hub only
    ever sends each neighbour one row, every round aggregates before it joins, and each ends in a table in the shared
    folder, which replaces the one before.
    """
    e = cut(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct(), "cc-edges")
    n = e.count()
    for _ in range(max_rounds):
        # large star: neighbours greater than u go to the smallest of u and its neighbours
        both = e.unionByName(e.select(F.col("b").alias("a"), F.col("a").alias("b")))
        m = both.groupBy("a").agg(F.least("a", F.min("b")).alias("m"), F.count(F.lit(1)).alias("n"))
        large = with_least(both, m, "a", 2 * n).where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b").distinct()
        # small star: u and its smaller neighbours go to the smallest of them
        m = large.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n"))
        small = with_least(large, m, "a", n).select(F.col("b").alias("a"), F.col("m").alias("b")).unionByName(m.select("a", F.col("m").alias("b"))).where("a <> b").distinct()
        last, e = e, cut(small, "cc-edges")
        release(last)
        # stars: every id has one edge up, and no root has any
        now = e.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("a").alias("na")).head()
        n = now["n"]
        if n == now["na"] and e.select(F.col("b").alias("a")).join(e.select("a"), "a", "left_semi").isEmpty():
            return e.select(F.col("a").alias("id"), F.col("b").alias("root")).unionByName(e.select(F.col("b").alias("id"), F.col("b").alias("root")).distinct())
    raise RuntimeError(f"components didn't settle in {max_rounds} rounds")


def units(records: DataFrame, id_col: str, keys: Sequence[str], links: DataFrame | None = None, name: str | None = None, ends: tuple[str, str] = ("a", "b")) -> DataFrame:
    """(id, unit) of every record. ``links`` names records by their column ``name`` in its two ``ends`` columns."""
    ids = records.select(F.col(id_col).alias("id")).where("id is not null").distinct()
    n_rows = records.count()
    edges = key_edges(records, id_col, keys, n_rows)
    if links is not None:
        names = records.select(F.col(name).alias("k"), F.col(id_col).alias("i")).where("k is not null and i is not null").groupBy("k").agg(F.min("i").alias("i"))
        l = links.select(F.col(ends[0]).alias("x"), F.col(ends[1]).alias("y")).where("x is not null and y is not null and x <> y").distinct()
        l = l.join(names.select(F.col("k").alias("x"), F.col("i").alias("a")), "x").join(names.select(F.col("k").alias("y"), F.col("i").alias("b")), "y")
        edges = edges.unionByName(l.select("a", "b")).unionByName(key_edges(records, id_col, [name], n_rows))
    roots = connected(edges)
    return ids.join(roots, "id", "left").select("id", F.coalesce("root", "id").alias("unit"))


def place(vectors: np.ndarray, shares: Sequence[float]) -> np.ndarray:
    """Split of each block, given its label counts (rows: blocks; column 0: records).

    Iterative stratification: the label with the fewest outstanding records first, its largest blocks first, each into
    the split that needs that label most (then the one that needs records most).
    """
    shares_ = np.asarray(shares, float)
    need = np.outer(shares_, vectors.sum(0)) if len(vectors) else np.zeros((len(shares_), 1))
    out = np.full(len(vectors), -1)
    rest = vectors.sum(0).astype(float)
    while (out < 0).any():
        live = [c for c in range(1, vectors.shape[1]) if rest[c] > 0.5]
        label = min(live, key=lambda c: (rest[c], c)) if live else 0
        block = np.flatnonzero((out < 0) & (vectors[:, label] > 0))
        if not len(block):
            block = np.flatnonzero(out < 0)
        for i in block[np.lexsort((block, -vectors[block, 0]))]:
            room = [k for k in range(len(shares_)) if need[k, 0] >= vectors[i, 0] / 2] or range(len(shares_))
            s = max(room, key=lambda k: (need[k, label], need[k, 0]))
            out[i] = s
            need[s] -= vectors[i]
            rest -= vectors[i]
    return out


#: label values that are balanced, at most; blocks of small units, about
MAX_LABELS, MAX_VECTORS = 1000, 20_000


def split_units(records: DataFrame, units_: DataFrame, id_col: str, labels: Sequence[str], names: Sequence[str] = ("train", "validation", "test"), shares: Sequence[float] = (0.8, 0.1, 0.1), blocks: int = 512, big: float = 0.0005, seed: str = "split") -> DataFrame:
    """(id, unit, split): grouped iterative stratification.

    Label counts are summed per unit. Units with more than ``big`` of the records (at most 1/big of them) are placed one
    by one; the rest are gathered, by their rarest label and a hash, into at most ``blocks`` blocks a label (fewer with
    many labels). What the driver places are thus at most 1/big + MAX_VECTORS + 8 x labels vectors, at any size of the
    table. Labels are categories: more than MAX_LABELS values are a ValueError.
    """
    if abs(sum(shares) - 1) > 1e-9 or len(shares) != len(names) or min(shares) < 0:
        raise ValueError("shares must be as many as names, not negative, and sum to 1")
    per_id = records.select(F.col(id_col).alias("id"), *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(f"l{i}") for i, c in enumerate(labels)]).where("id is not null")
    per_id = per_id.groupBy("id").agg(F.min(F.array(*[f"l{i}" for i in range(len(labels))])).alias("ls"))
    rows = cut(per_id.join(units_, "id").select("id", "unit", F.transform("ls", lambda x, i: F.concat_ws("=", i.cast("string"), x)).alias("ls")), "split-rows")
    top = rows.select(F.explode("ls").alias("l")).groupBy("l").count().orderBy("count", "l", ascending=[False, True]).limit(MAX_LABELS + 1).collect()
    if len(top) > MAX_LABELS:
        raise ValueError(f"more than {MAX_LABELS} label values")
    freq = {r["l"]: r["count"] for r in top}
    order = sorted(freq, key=lambda x: (freq[x], x))
    at = {x: i for i, x in enumerate(order)}
    spark = records.sparkSession
    ranks = F.create_map(*[x for k, v in at.items() for x in (F.lit(k), F.lit(v))]) if at else F.create_map().cast("map<string,int>")
    rows = rows.withColumn("ls", F.transform("ls", lambda x: F.coalesce(ranks[x], F.lit(len(order)))))
    total = rows.count()
    blocks = max(8, min(blocks, MAX_VECTORS // max(1, len(order))))
    sizes = rows.groupBy("unit").agg(F.count(F.lit(1)).alias("n"), F.min(F.array_min("ls")).alias("rare"))
    h = F.conv(F.substring(F.md5(F.concat_ws(":", F.lit(seed), F.col("unit"))), 1, 7), 16, 10).cast("long")
    block = F.when(F.col("n") > max(1.0, big * total), F.concat_ws(":", F.lit("unit"), "unit")).otherwise(F.concat_ws(":", "rare", F.pmod(h, F.lit(blocks))))
    of_unit = cut(sizes.select("unit", block.alias("block")), "split-blocks")
    counts = rows.join(of_unit, "unit").select("block", F.explode(F.concat(F.array(F.lit(-1)), "ls")).alias("l")).groupBy("block", "l").agg(F.count(F.lit(1)).alias("n")).toPandas()
    index = {b: i for i, b in enumerate(sorted(counts["block"].unique()))}
    vectors = np.zeros((len(index), len(order) + 2), np.float32)
    vectors[counts["block"].map(index).to_numpy(int), counts["l"].to_numpy(int) + 1] = counts["n"]
    found = place(vectors, shares)
    plan = spark.createDataFrame([(b, names[found[i]]) for b, i in index.items()], "block string, split string")
    return rows.select("id", "unit").join(of_unit.join(F.broadcast(plan), "block").select("unit", "split"), "unit").select("id", "unit", "split")


def split_report(assigned: DataFrame, records: DataFrame, id_col: str, labels: Sequence[str], names: Sequence[str] = ("train", "validation", "test"), shares: Sequence[float] = (0.8, 0.1, 0.1)) -> DataFrame:
    """(label, value, split, target, reached, n, n_units): records of each split, in all (label ``all``) and of each label value, next to the targets."""
    first = [F.min(F.coalesce(F.col(c).cast("string"), F.lit(""))).alias(f"l{i}") for i, c in enumerate(labels)]
    per_id = records.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(F.lit(1).alias("one"), *first)
    pairs = F.array(F.struct(F.lit("all").alias("label"), F.lit("").alias("value")), *[F.struct(F.lit(c).alias("label"), F.col(f"l{i}").alias("value")) for i, c in enumerate(labels)])
    d = assigned.join(per_id, "id").select("split", "unit", F.inline(pairs))
    got = d.groupBy("label", "value", "split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("unit").alias("n_units"))
    want = assigned.sparkSession.createDataFrame(list(zip(names, map(float, shares))), "split string, target double")
    every = got.select("label", "value").distinct().crossJoin(F.broadcast(want))  # label values times splits
    out = every.join(got, ["label", "value", "split"], "left").fillna(0, ["n", "n_units"])
    whole = F.sum("n").over(Window.partitionBy("label", "value"))  # one row a split
    return out.select("label", "value", "split", "target", F.when(whole > 0, F.col("n") / whole).otherwise(F.lit(0.0)).alias("reached"), "n", "n_units")
