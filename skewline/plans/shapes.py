"""Feature, bank, chip and box tables derived from the plain tables, in Spark and in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.operators.bank import ScoreBank
from skewline.operators.linalg import moments
from skewline.session import table
from skewline.sources.images import apply_head


def features(spark: SparkSession, d: str) -> DataFrame:
    """sample_id, x, label, ood, train of the ``embeddings``."""
    e = table(spark, d, "embeddings")
    return e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").cast("array<double>").alias("x"), "label", (F.col("label") >= 8).alias("ood"), ((F.col("label") < 8) & (F.col("vec_id") % 2 == 0)).alias("train"))


def class_mean_head(train: DataFrame):
    """(W, b) of the nearest-class-mean head."""
    m = moments(train, "x", "label")
    return m.class_means, -0.5 * (m.class_means**2).sum(1)


def with_logits(spark: SparkSession, d: str) -> tuple[DataFrame, tuple]:
    f = features(spark, d)
    W, b = class_mean_head(f.where("train"))
    return apply_head(f, W, b, "x", "logits"), (W, b)


def bank(spark: SparkSession, d: str) -> ScoreBank:
    """A bank over ``events``: two detectors (one with many ties), a metric, labels, classes, groups."""
    e = table(spark, d, "events")
    rows = e.select(F.col("event_id").alias("sample_id"), F.col("event_type").isin("error", "purchase").cast("int").alias("y"), (F.col("event_id") % 5).alias("c"), F.col("event_type").alias("g"), F.col("value").alias("a"), (((F.col("event_id") * 7919) % 1000) / F.lit(8.0)).alias("b"), (((F.col("event_id") * 31) % 97) / F.lit(64.0)).alias("m"))
    return ScoreBank.of(rows, {"a": "a", "b": "b"}, {"m": "m"}, ood="y", class_id="c", group="g", class_names=["c0", "c1", "c2", "c3", "c4"])


_KIND = {"click": 0, "error": 1, "purchase": 2, "signup": 3, "view": 4}


def _kind():
    return F.create_map(*[x for k, v in _KIND.items() for x in (F.lit(k), F.lit(v))])[F.col("event_type")]


def chips(spark: SparkSession, d: str, n_images: int = 500) -> DataFrame:
    """One chip per event, on ``n_images`` images."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    x, y = ((i * 13) % 500).cast("double"), ((i * 29) % 300).cast("double")
    return e.select((i % n_images).alias("image_idx"), i.alias("chip_idx"), _kind().alias("class_id"), F.col("event_type").alias("grp"), F.col("value").alias("score"), F.array(x, y, x + 10 + (i * 7) % 90, y + 12 + (i * 11) % 70).alias("box"), (640 + (i % n_images) % 3 * 320).cast("double").alias("image_w"), F.lit(480.0).alias("image_h"), F.col("event_type").isin("error").cast("int").alias("ood"))


def boxes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """(predictions, ground truth) on a tight grid of boxes, so that matches are contested."""
    e = table(spark, d, "events")
    i = F.col("event_id")
    x, y, s = 5 * (F.floor(i / 500) % 4), 5 * (F.floor(i / 2000) % 5), i % 7
    box = lambda o: F.array((x + o).cast("double"), (y + o).cast("double"), (x + o + 40).cast("double"), (y + o + 40).cast("double"))
    image = (i % 500).alias("image_id")
    pred = e.where(i % 4 != 0).select(image, _kind().alias("class_id"), F.col("event_type").alias("class_name"), box(s).alias("bbox"), F.col("value").alias("confidence"), F.concat(F.lit("d"), i).alias("detection_id"), i.alias("pos"))
    gt = e.where(i % 3 != 0).select(image, _kind().alias("class_id"), F.col("event_type").alias("class_name"), box(F.lit(0)).alias("bbox"), F.concat(F.lit("g"), i).alias("gt_id"), i.alias("pos"))
    return pred, gt


SQL_FEAT = "SELECT vec_id AS sample_id, embedding::DOUBLE[] AS x, label, label >= 8 AS ood, (label < 8 AND vec_id % 2 = 0) AS train FROM embeddings"
SQL_HEAD = """feat AS (SELECT vec_id AS sample_id, embedding::DOUBLE[] AS x, label, label >= 8 AS ood, (label < 8 AND vec_id % 2 = 0) AS train FROM embeddings),
dims AS (SELECT unnest(range(1, 65)) AS i),
mu AS (SELECT label AS c, i, avg(x[i]) AS m FROM feat, dims WHERE train GROUP BY label, i),
head AS (SELECT c, list(m ORDER BY i) AS w, -0.5::DOUBLE * sum(m * m) AS b FROM mu GROUP BY c),
lg AS (SELECT sample_id, any_value(x) AS x, any_value(label) AS label, any_value(ood) AS ood, any_value(train) AS train, list(list_dot_product(x, w) + b ORDER BY c) AS z FROM feat, head GROUP BY sample_id)"""
SQL_BANK = """bank AS (SELECT event_id AS sample_id, CAST(event_type IN ('error', 'purchase') AS INTEGER) AS ood, CAST(event_id % 5 AS INTEGER) AS class_id, event_type AS grp,
 CAST(value AS FLOAT) AS a, CAST(((event_id * 7919) % 1000) / 8.0::DOUBLE AS FLOAT) AS b, CAST(((event_id * 31) % 97) / 64.0::DOUBLE AS FLOAT) AS m FROM events),
long AS (SELECT sample_id, ood, class_id, grp, 'a' AS detector, a AS score FROM bank UNION ALL SELECT sample_id, ood, class_id, grp, 'b', b FROM bank)"""
_CASE = "CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 WHEN 'view' THEN 4 END"


def sql_chips(n: int = 500) -> str:
    return f"""chips0 AS (SELECT event_id % {n} AS image_idx, event_id AS chip_idx, {_CASE} AS class_id, event_type AS grp, value AS score, ((event_id * 13) % 500)::DOUBLE AS x, ((event_id * 29) % 300)::DOUBLE AS y, event_id AS i, CAST(event_type = 'error' AS INTEGER) AS ood FROM events),
ch AS (SELECT image_idx, chip_idx, class_id, grp, score, [x, y, x + 10 + (i * 7) % 90, y + 12 + (i * 11) % 70] AS box, (640 + image_idx % 3 * 320)::DOUBLE AS image_w, 480.0::DOUBLE AS image_h, ood FROM chips0)"""


SQL_BOXES = f"""ev AS (SELECT event_id AS i, event_id % 500 AS image_id, {_CASE} AS class_id, event_type AS class_name, value, (5 * ((event_id // 500) % 4))::DOUBLE AS x, (5 * ((event_id // 2000) % 5))::DOUBLE AS y, event_id % 7 AS s FROM events),
pred AS (SELECT image_id, class_id, class_name, [x + s, y + s, x + s + 40, y + s + 40] AS bbox, value AS confidence, 'd' || i AS detection_id, i AS ord FROM ev WHERE i % 4 <> 0),
gt AS (SELECT image_id, class_id, class_name, [x, y, x + 40, y + 40] AS bbox, 'g' || i AS gt_id, i AS ord FROM ev WHERE i % 3 <> 0)"""
