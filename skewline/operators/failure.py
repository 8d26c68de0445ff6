"""Failure prediction: feature sets, an imputing logistic model, baselines, and the reports on them."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.operators.binning import calibration_bins
from skewline.operators.masks import grouped_split
from skewline.operators.metrics import classification_metrics
from skewline.operators.ranks import percentiles
from skewline.session import cut

CONFIDENCE = ("mean_detection_confidence", "max_detection_confidence", "min_detection_confidence", "num_detections")
CHIP = ("chip_ood_mean", "chip_ood_max", "chip_ood_p90", "chip_ood_std", "num_chips")
GLOBAL = ("global_ood_score",)
#: feature sets by name; ``class prior`` has none and predicts the share of failures in training
FEATURE_SETS: dict[str, tuple[str, ...]] = {
    "class prior": (),
    "class": ("class_name",),
    "confidence": CONFIDENCE,
    "global ood": GLOBAL,
    "chip ood": CHIP,
    "confidence + chip ood": CONFIDENCE + CHIP,
    "all": ("class_name", *CONFIDENCE, *GLOBAL, *CHIP),
}


@dataclass
class LogisticPipeline:
    """Median imputation with indicators of what was missing in training, population standardisation, one-hot classes
    (unseen ones are all zeros) and an L2 logistic regression with balanced weights. Columns without any value count as 0."""

    numeric: tuple[str, ...]
    categorical: tuple[str, ...] = ()
    c: float = 1.0
    max_iter: int = 1000
    state: dict = field(default_factory=dict)

    def _numbers(self) -> dict[str, Column]:
        out = {}
        for n in self.numeric:
            v = F.col(n).cast("double")
            out[n] = F.when(F.isnan(v), F.lit(None)).otherwise(v)
        return out

    def fit(self, df: DataFrame, y: str) -> LogisticPipeline:
        from pyspark.ml.classification import LogisticRegression
        from pyspark.ml.feature import OneHotEncoder, StringIndexer, VectorAssembler

        raw = self._numbers()
        aggs = [F.count_if(raw[n].isNull()).alias(f"z{i}") for i, n in enumerate(self.numeric)]
        yv = F.col(y).cast("int")
        stats = df.agg(F.count(F.lit(1)).alias("n"), F.sum(yv).alias("pos"), *aggs).head()
        n, pos = stats["n"], stats["pos"] or 0
        if n == 0 or pos in (0, n):
            raise ValueError("both classes are needed to fit")
        self.medians = dict.fromkeys(self.numeric, 0.0)
        if self.numeric:
            long = df.select(*[raw[c].alias(c) for c in self.numeric]).unpivot([], list(self.numeric), "name", "v")
            self.medians |= {r["name"]: r["m"][0] for r in percentiles(long, ["name"], "v", [0.5], "m").collect()}  # one row a column
        self.missing = [c for i, c in enumerate(self.numeric) if stats[f"z{i}"] > 0]
        cols = self._filled()
        moments = df.agg(*[x for i, v in enumerate(cols.values()) for x in (F.avg(v).alias(f"a{i}"), F.stddev_pop(v).alias(f"s{i}"))]).head() if cols else None
        self.scale = {c: (moments[f"a{i}"], moments[f"s{i}"] or 1.0) for i, c in enumerate(cols)}
        self.stages = []
        d = self._featurize(df)
        ins = [f"_f{i}" for i in range(len(cols))]
        for i, c in enumerate(self.categorical):
            ix = StringIndexer(inputCol=f"_c{i}", outputCol=f"_i{i}", handleInvalid="keep", stringOrderType="alphabetAsc").fit(d)
            d = ix.transform(d)
            oh = OneHotEncoder(inputCol=f"_i{i}", outputCol=f"_o{i}", handleInvalid="error", dropLast=True).fit(d)
            d = oh.transform(d)
            self.stages += [ix, oh]
            ins.append(f"_o{i}")
        asm = VectorAssembler(inputCols=ins, outputCol="_x")
        self.stages.append(asm)
        # balanced weights sum to n; the objective then equals sum of losses + |w|^2 / 2C
        w = F.when(yv == 1, F.lit(n / (2.0 * pos))).otherwise(F.lit(n / (2.0 * (n - pos))))
        d = asm.transform(d).select("_x", yv.cast("double").alias("_y"), w.alias("_w"))
        lr = LogisticRegression(featuresCol="_x", labelCol="_y", weightCol="_w", regParam=1.0 / (self.c * n), standardization=False, maxIter=self.max_iter, tol=1e-10, probabilityCol="_p", rawPredictionCol="_r", predictionCol="_h")
        self.model = lr.fit(d)
        return self

    def _filled(self) -> dict[str, Column]:
        raw = self._numbers()
        out = {c: F.coalesce(raw[c], F.lit(float(self.medians[c]))) for c in self.numeric}
        return out | {f"missing {c}": raw[c].isNull().cast("double") for c in self.missing}

    def _featurize(self, df: DataFrame) -> DataFrame:
        cols = {f"_f{i}": (v - F.lit(float(self.scale[c][0]))) / F.lit(float(self.scale[c][1])) for i, (c, v) in enumerate(self._filled().items())}
        return df.withColumns(cols | {f"_c{i}": F.coalesce(F.col(c).cast("string"), F.lit("<missing>")) for i, c in enumerate(self.categorical)})

    def transform(self, df: DataFrame, out: str = "p") -> DataFrame:
        from pyspark.ml.functions import vector_to_array

        keep = df.columns
        d = self._featurize(df)
        for s in self.stages:
            d = s.transform(d)
        return self.model.transform(d).withColumn(out, vector_to_array("_p")[1]).select(*keep, out)


def evaluate_failure_baselines(table: DataFrame, target: str = "has_failure", group: str = "image_id", sets: dict[str, tuple[str, ...]] | None = None, categorical: tuple[str, ...] = ("class_name",), test_size: float = 0.3, seed: str | int = 0, test_groups: list | None = None, keep: tuple[str, ...] = ()) -> tuple[DataFrame, DataFrame]:
    """(metrics per feature set, long predictions: model, group, keep columns, y, p).

    Rows without a target drop out. Sets without columns, and training rows of one class, predict the training share.
    """
    sets = sets or FEATURE_SETS
    for name, cols in sets.items():
        lost = [c for c in cols if c not in table.columns]
        if lost:
            raise ValueError(f"feature set {name!r} lacks the columns {lost}")
    # every fit goes over it many times
    d = cut(grouped_split(table.where(F.col(target).isNotNull()), group, test_size, seed, test_groups), "failure-rows")
    train, test = d.where("not is_test"), d.where("is_test")
    prior = train.agg(F.avg(F.col(target).cast("double")).alias("p"), F.countDistinct(target).alias("c")).head()
    preds = None
    for name, cols in sets.items():  # a handful of models
        if not cols or prior["c"] < 2:
            p = test.withColumn("p", F.lit(prior["p"]))
        else:
            cats = tuple(c for c in cols if c in categorical)
            p = LogisticPipeline(tuple(c for c in cols if c not in cats), cats).fit(train, target).transform(test)
        p = p.select(F.lit(name).alias("model"), group, *[k for k in keep if k != group], F.col(target).cast("int").alias("y"), "p")
        preds = p if preds is None else preds.unionByName(p)
    return classification_metrics(preds, ["model"]), preds


def metrics_by_domain(preds: DataFrame, domains: DataFrame, key: str = "image_id", domain: str = "dataset_name") -> DataFrame:
    """model, domain and the classification metrics; predictions without a domain keep a null one."""
    return classification_metrics(preds.join(domains.select(key, domain), key, "left"), ["model", domain])


def confidence_ood_failure(df: DataFrame, confidence: str = "mean_detection_confidence", ood: str = "chip_ood_mean", failure: str = "has_failure", n_bins: int = 3, least: int = 4) -> DataFrame:
    """bin, n, low_cut, high_cut, low_failure, high_failure: within equal-width bins of confidence, the failure rates below the .33 and above the .67 quantile of the OOD score."""
    c = F.col(confidence).cast("double")
    d = df.select(F.least(F.floor(c * n_bins), F.lit(n_bins - 1)).cast("int").alias("bin"), F.col(ood).cast("double").alias("o"), F.col(failure).cast("double").alias("f")).where("bin is not null and o is not null and not isnan(o) and f is not null")
    cuts = percentiles(d, ["bin"], "o", [0.33, 0.67], "q").where(F.col("n") >= least).select("bin", "n", F.col("q")[0].alias("low_cut"), F.col("q")[1].alias("high_cut"))
    j = d.join(F.broadcast(cuts), "bin")  # one row a bin
    return j.groupBy("bin", "n", "low_cut", "high_cut").agg(F.avg(F.when(F.col("o") <= F.col("low_cut"), F.col("f"))).alias("low_failure"), F.avg(F.when(F.col("o") >= F.col("high_cut"), F.col("f"))).alias("high_failure"))


def reference_zscores(df: DataFrame, cols: tuple[str, ...], domain: str, reference: str) -> DataFrame:
    """Adds z_<col> against the reference domain's mean and population deviation (0 or none: 1), and their sum with null as 0."""
    r = df.where(F.col(domain) == reference).agg(*[x for c in cols for x in (F.avg(c).alias(f"_m_{c}"), F.stddev_pop(c).alias(f"_s_{c}"))])
    j = df.join(F.broadcast(r))
    for c in cols:
        j = j.withColumn(f"z_{c}", (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_s_{c}") > 0, F.col(f"_s_{c}")).otherwise(F.lit(1.0)))
    total = sum((F.coalesce(F.col(f"z_{c}"), F.lit(0.0)) for c in cols[1:]), F.coalesce(F.col(f"z_{cols[0]}"), F.lit(0.0)))
    return j.withColumn("z_combined", total).drop(*[f"_{k}_{c}" for k in "ms" for c in cols])


def high_confidence_failures(df: DataFrame, confidence: str = "mean_detection_confidence", least: float = 0.7, ood: str = "chip_ood_mean", top_k: int = 20, tie: tuple[str, ...] = ("image_id", "class_id")) -> DataFrame:
    return df.where(F.col("has_failure") & (F.col(confidence) >= least)).orderBy(F.col(ood).desc_nulls_last(), *tie).limit(top_k)


def dataset_summary(df: DataFrame, by: str = "dataset_name") -> DataFrame:
    return df.groupBy(by).agg(F.countDistinct("image_id").alias("n_images"), F.count(F.lit(1)).alias("n_rows"), F.avg(F.col("has_failure").cast("double")).alias("failure_rate"), F.avg("precision").alias("mean_precision"), F.avg("recall").alias("mean_recall"))


def coverage_summary(df: DataFrame, by: str = "dataset_name") -> DataFrame:
    return df.groupBy(by).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if((F.col("num_gt") > 0) & (F.col("num_detections") == 0)).alias("gt_only"), F.count_if((F.col("num_gt") == 0) & (F.col("num_detections") > 0)).alias("detection_only"), F.count_if(F.col("num_chips") == 0).alias("missing_chip_features"))


def calibration_by_model(preds: DataFrame, n_bins: int = 10) -> DataFrame:
    """``calibration_bins`` of each model."""
    out = None
    for m in sorted(r["model"] for r in preds.select("model").distinct().collect()):  # a handful of models
        b = calibration_bins(preds.where(F.col("model") == m), "y", "p", n_bins).withColumn("model", F.lit(m))
        out = b if out is None else out.unionByName(b)
    return out
