"""Composite analyses over banks and pooled scores."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.operators.bank import CLASS, GROUP, ID, LABEL, ScoreBank
from skewline.operators.metrics import summary
from skewline.operators.pooling import pool_image_scores
from skewline.operators.ranks import percentiles


def hardest_classes(bank: ScoreBank, detector: str, least: int = 5, top_k: int = 12) -> DataFrame:
    """class_id, auroc, n_id, n_ood of the classes with the lowest AUROC and enough samples on both sides."""
    n = bank.df.groupBy(CLASS).agg(F.count_if(F.col(LABEL) == 0).alias("n_id"), F.count_if(F.col(LABEL) == 1).alias("n_ood")).where((F.col("n_id") >= least) & (F.col("n_ood") >= least))
    d = bank.df.select(ID, CLASS, LABEL, F.col(detector).alias("score")).join(n, CLASS)
    m = summary(d, keys=[CLASS]).select(CLASS, "auroc")
    return m.join(n, CLASS).orderBy("auroc", CLASS).limit(top_k)


def auroc_by_class_and_group(bank: ScoreBank, detector: str, id_group: str, least: int = 5) -> DataFrame:
    """class_id, grp, auroc, n_id, n_ood: each class's samples of one ID group against those of each other group; null with too few on a side."""
    d = bank.df.select(ID, CLASS, GROUP, LABEL, F.col(detector).alias("score"))
    ood = d.where((F.col(LABEL) == 1) & (F.col(GROUP) != id_group))
    pairs = ood.select(CLASS, GROUP).distinct()  # one row per class and group
    inside = d.where((F.col(LABEL) == 0) & (F.col(GROUP) == id_group)).drop(GROUP).join(pairs, CLASS)
    both = inside.select(ID, CLASS, GROUP, LABEL, "score").unionByName(ood.select(ID, CLASS, GROUP, LABEL, "score"))
    n = both.groupBy(CLASS, GROUP).agg(F.count_if(F.col(LABEL) == 0).alias("n_id"), F.count_if(F.col(LABEL) == 1).alias("n_ood"))
    m = summary(both, keys=[CLASS, GROUP]).select(CLASS, GROUP, "auroc")
    enough = (F.col("n_id") >= least) & (F.col("n_ood") >= least)
    return n.join(m, [CLASS, GROUP]).select(CLASS, GROUP, F.when(enough, F.col("auroc")).alias("auroc"), "n_id", "n_ood")


#: the ID rows are ranked once with each domain: more domains than these are refused
MAX_DOMAINS = 1000


def per_domain(long: DataFrame, domain: str, keys: list[str] = ["detector"]) -> DataFrame:
    """keys, domain and the metrics of all ID rows against each domain's OOD rows."""
    ood = long.where(F.col(LABEL) == 1)
    names = sorted(r[domain] for r in ood.select(domain).where(F.col(domain).isNotNull()).distinct().limit(MAX_DOMAINS + 1).collect())
    if len(names) > MAX_DOMAINS:
        raise ValueError(f"more than {MAX_DOMAINS} domains")
    every = F.array(*[F.lit(n) for n in names]) if names else F.array().cast(f"array<{long.schema[domain].dataType.simpleString()}>")
    inside = long.where(F.col(LABEL) == 0).withColumn(domain, F.explode(every))
    return summary(inside.select(long.columns).unionByName(ood.where(F.col(domain).isNotNull())), keys=[*keys, domain])


def image_metrics_by_pooling(chips: DataFrame, labels: DataFrame, methods: tuple[str, ...] = ("mean", "max", "topk_mean"), k: int = 3) -> DataFrame:
    """method and the metrics of the pooled image scores. labels: image_idx, ood."""
    parts = None
    for m in methods:
        p = pool_image_scores(chips, method=m, k=k, order="chip_idx").withColumn("method", F.lit(m))
        parts = p if parts is None else parts.unionByName(p)
    d = parts.join(labels.select("image_idx", LABEL), "image_idx").withColumn("score", F.col("score").cast("float"))
    return summary(d.withColumnRenamed("image_idx", ID), keys=["method"])


def zscore_on_id(df: DataFrame, cols: tuple[str, ...], label: str = LABEL) -> DataFrame:
    """Adds z_<col> against the ID rows' mean and population deviation (0: 1)."""
    stats = df.where(F.col(label) == 0).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    j = df.join(F.broadcast(stats))
    for c in cols:
        j = j.withColumn(f"z_{c}", (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)))
    return j.drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


def safe_add(*parts: Column) -> Column:
    """Sum, null if any part is missing or not finite."""
    ok = None
    for p in parts:
        good = p.isNotNull() & ~F.isnan(p) & (F.abs(p) != float("inf"))
        ok = good if ok is None else ok & good
    return F.when(ok, sum(parts[1:], parts[0]))


def count_bucket(n: Column) -> Column:
    """1, 2, 3-5 or 6+."""
    return F.when(n <= 1, "1").when(n == 2, "2").when(n <= 5, "3-5").otherwise("6+")


def metrics_by_count(images: DataFrame, chips: DataFrame, score: str) -> DataFrame:
    """bucket of an image's objects and the metrics in it. images: image_idx, ood, the score."""
    n = chips.groupBy("image_idx").agg(F.count(F.lit(1)).alias("n"))
    d = images.join(n, "image_idx").select(F.col("image_idx").alias(ID), LABEL, F.col(score).cast("float").alias("score"), count_bucket(F.col("n")).alias("bucket"))
    return summary(d, keys=["bucket"])


def fusion_correlation(df: DataFrame, cols: tuple[str, ...]) -> DataFrame:
    """a, b, corr, n of each pair of scores over the rows where all are finite."""
    fine = None
    for c in cols:
        x = F.col(c).cast("double")
        g = x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
        fine = g if fine is None else fine & g
    one = df.where(fine).agg(F.count(F.lit(1)).alias("n"), *[F.corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(combinations(cols, 2))])
    return one.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"c{i}").alias("corr"), F.col("n")) for i, (a, b) in enumerate(combinations(cols, 2))])))


def fusion_disagreement(df: DataFrame, a: str, b: str, top_k: int = 20, key: str = "image_idx") -> DataFrame:
    """The rows whose ID z-scores of two scores differ most."""
    z = zscore_on_id(df, (a, b))
    return z.withColumn("gap", F.col(f"z_{a}") - F.col(f"z_{b}")).where("gap is not null").orderBy(F.abs("gap").desc(), key).limit(top_k).select(key, LABEL, f"z_{a}", f"z_{b}", "gap")


def top_chips(bank: ScoreBank, per: int = 5, direction: str = "ood") -> DataFrame:
    """detector, class_id, rank, sample_id, score: the first samples of every detector and class."""
    if direction not in ("ood", "id"):
        raise ValueError("direction must be ood or id")
    s = F.col("score")
    w = Window.partitionBy("detector", CLASS).orderBy(F.isnan(s), s.desc() if direction == "ood" else s.asc(), ID)
    return bank.long(CLASS).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per).select("detector", CLASS, "rank", ID, "score")


def group_summary(df: DataFrame, group: str, score: str, least: int = 5) -> DataFrame:
    """group, n, mean, p10, p90 of groups with enough rows."""
    d = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean")).where(F.col("n") >= least)
    q = percentiles(df.where(F.col(group).isNotNull()), [group], score, [0.1, 0.9], "q").drop("n")
    return d.join(q, group, "left").select(group, "n", "mean", F.col("q")[0].alias("p10"), F.col("q")[1].alias("p90"))
