"""Queries on boxes, chips, pooling, detections, scenes, failure tables and combined blocks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions import boxes as X
from skewline.operators import analysis, chips, combine, detection, failure, geometry, pooling
from skewline.plans import shapes
from skewline.plans.ranking import _RANK, rounded
from skewline.session import cut, table

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


C = shapes.sql_chips()


def _four(name: str, expr: str, kind: str = "DOUBLE") -> str:
    return ", ".join(f"CAST({expr}[{i + 1}] AS {kind}) AS {name}{i}" for i in range(4))


def four(name: str, c, kind: str = "double"):
    return [c[i].cast(kind).alias(f"{name}{i}") for i in range(4)]


@query(f"WITH {C}, b AS (SELECT chip_idx, box AS p, [box[1], box[2], box[1] + box[3], box[2] + box[4]] AS q, [box[1] - box[3] / 2, box[2] - box[4] / 2, box[1] + box[3] / 2, box[2] + box[4] / 2] AS r FROM ch) SELECT chip_idx, {_four('p', 'p')}, {_four('q', 'q')}, {_four('r', 'r')} FROM b")
def box_formats(spark: SparkSession, d: str) -> DataFrame:
    c = shapes.chips(spark, d)
    return c.select("chip_idx", *four("p", X.to_xyxy(F.col("box"), "xyxy")), *four("q", X.to_xyxy(F.col("box"), "xywh")), *four("r", X.to_xyxy(F.col("box"), "cxcywh")))


@query(f"""WITH {C}, s AS (SELECT *, greatest(box[3] - box[1], box[4] - box[2], 25.0::DOUBLE) AS side FROM ch), r AS (SELECT *, CAST(floor((box[1] + box[3]) / 2 - side / 2) AS BIGINT) AS x, CAST(floor((box[2] + box[4]) / 2 - side / 2) AS BIGINT) AS y, CAST(ceil(side) AS BIGINT) AS n FROM s)
SELECT chip_idx, x AS r0, y AS r1, x + n AS r2, y + n AS r3, greatest(x, 0) AS src_x1, greatest(y, 0) AS src_y1, least(x + n, CAST(image_w AS BIGINT)) AS src_x2, least(y + n, CAST(image_h AS BIGINT)) AS src_y2, greatest(x, 0) - x AS dst_x1 FROM r""")
def chip_regions(spark, d):
    c = shapes.chips(spark, d).withColumn("r", X.square_chip(F.col("box")))
    c = c.withColumn("w", X.crop_window(F.col("r"), F.col("image_w"), F.col("image_h")))
    return c.select("chip_idx", *four("r", F.col("r"), "bigint"), "w.src_x1", "w.src_y1", "w.src_x2", "w.src_y2", "w.dst_x1")


@query(f"WITH {C} SELECT chip_idx, greatest(box[3] - box[1], box[4] - box[2]) >= 60 AS longest, least(box[3] - box[1], box[4] - box[2]) >= 40 AS both, box[1] / image_w AS rel_x, (box[4] - box[2]) / image_h AS rel_h FROM ch")
def box_filters(spark, d):
    c, b = shapes.chips(spark, d), F.col("box")
    rel = X.to_relative_xywh(b, F.col("image_w"), F.col("image_h"))
    return c.select("chip_idx", X.longest_side_at_least(b, 60).alias("longest"), X.both_sides_at_least(b, 40).alias("both"), rel[0].alias("rel_x"), rel[3].alias("rel_h"))


@query(f"WITH {C} SELECT a.image_idx, a.chip_idx AS a, b.chip_idx AS b, round({X.sql_iou('a.box', 'b.box')}, 6) AS iou FROM ch a JOIN ch b ON a.image_idx = b.image_idx AND a.class_id = b.class_id AND a.chip_idx < b.chip_idx")
def box_iou(spark, d):
    c = shapes.chips(spark, d)
    a = c.select("image_idx", "class_id", F.col("chip_idx").alias("a"), F.col("box").alias("p"))
    b = c.select("image_idx", "class_id", F.col("chip_idx").alias("b"), F.col("box").alias("q"))
    return rounded(a.join(b, ["image_idx", "class_id"]).where("a < b").select("image_idx", "a", "b", X.iou(F.col("p"), F.col("q")).alias("iou")))


def _pool(agg: str, n: int = 520) -> str:
    return f"WITH {C}, p AS ({agg}) SELECT CAST(i AS BIGINT) AS image_idx, round(score, 6) AS score FROM (SELECT unnest(range({n})) AS i) LEFT JOIN p ON i = image_idx"


@query(_pool("SELECT image_idx, avg(score) AS score FROM ch GROUP BY 1"))
def pool_mean(spark, d):
    return rounded(pooling.pool_image_scores(shapes.chips(spark, d), n_images=520))


@query(_pool("SELECT image_idx, max(score) AS score FROM ch GROUP BY 1"))
def pool_max(spark, d):
    return rounded(pooling.pool_image_scores(shapes.chips(spark, d), method="max", n_images=520))


@query(_pool("SELECT image_idx, avg(score) AS score FROM (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY score DESC, chip_idx) AS r FROM ch) WHERE r <= 3 GROUP BY 1"))
def pool_topk(spark, d):
    return rounded(pooling.pool_image_scores(shapes.chips(spark, d), method="topk_mean", n_images=520, order="chip_idx"))


@query(f"WITH {C}, n AS (SELECT image_idx, class_id, count(*) AS n FROM ch GROUP BY ALL), m AS (SELECT image_idx, arg_min(class_id, [-n, class_id]) AS class_id FROM n GROUP BY 1) SELECT image_idx, max(ood) AS ood, arg_max(grp, chip_idx) AS grp, any_value(m.class_id) AS class_id FROM ch JOIN m USING (image_idx) GROUP BY image_idx")
def image_labels(spark, d):
    return pooling.image_labels(shapes.chips(spark, d))


def _per_method() -> str:
    return f"""WITH {C}, y AS (SELECT image_idx, max(ood) AS ood FROM ch GROUP BY 1), p AS (SELECT image_idx, 'mean' AS method, avg(score) AS s FROM ch GROUP BY 1 UNION ALL SELECT image_idx, 'max', max(score) FROM ch GROUP BY 1
UNION ALL SELECT image_idx, 'topk_mean', avg(score) FROM (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY score DESC, chip_idx) AS r FROM ch) WHERE r <= 3 GROUP BY 1),
src AS (SELECT image_idx AS sample_id, method, round(s, 4)::FLOAT AS score, ood FROM p JOIN y USING (image_idx)), {_RANK.format(keys='method', src='src')}
SELECT method, round(sum(CASE WHEN ood = 0 THEN tp END) / nullif(max(n_pos) * (max(n) - max(n_pos)), 0)::DOUBLE, 6) AS auroc FROM r GROUP BY method"""


@query(_per_method())
def image_metrics_by_pooling(spark, d):
    c = shapes.chips(spark, d)
    y = c.groupBy("image_idx").agg(F.max("ood").alias("ood"))
    parts = None
    for m in ("mean", "max", "topk_mean"):
        p = pooling.pool_image_scores(c, method=m, k=3, order="chip_idx").withColumn("method", F.lit(m)).withColumn("score", F.round("score", 4).cast("float"))
        parts = p if parts is None else parts.unionByName(p)
    from skewline.operators.metrics import summary

    return rounded(summary(parts.join(y, "image_idx").withColumnRenamed("image_idx", "sample_id"), keys=["method"]).select("method", "auroc"))


_GREEDY = f"""WITH RECURSIVE {shapes.SQL_BOXES},
pr AS (SELECT p.image_id, p.class_id, p.detection_id, p.ord AS d, g.gt_id, g.ord AS g, {X.sql_iou('p.bbox', 'g.bbox')} AS iou FROM pred p JOIN gt g ON p.image_id = g.image_id AND p.class_id = g.class_id),
cand AS (SELECT image_id, class_id, detection_id, list({{'iou': iou, 'g': g}} ORDER BY iou DESC, g DESC) FILTER (iou >= 0.5) AS c FROM pr GROUP BY ALL),
o AS (SELECT image_id, class_id, detection_id, row_number() OVER (PARTITION BY image_id, class_id ORDER BY confidence DESC NULLS LAST, ord) AS r FROM pred),
oc AS (SELECT o.*, coalesce(c, []) AS c FROM o LEFT JOIN cand USING (image_id, class_id, detection_id)),
f(image_id, class_id, r, used, hit) AS (SELECT DISTINCT image_id, class_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT) FROM oc
 UNION ALL SELECT image_id, class_id, r, CASE WHEN len(fr) > 0 THEN list_append(used, fr[1].g) ELSE used END, CASE WHEN len(fr) > 0 THEN fr[1].g END
 FROM (SELECT f.image_id, f.class_id, oc.r, f.used, list_filter(oc.c, lambda x: NOT list_contains(f.used, x.g)) AS fr FROM f JOIN oc ON oc.image_id = f.image_id AND oc.class_id = f.class_id AND oc.r = f.r + 1)),
m AS (SELECT o.image_id, o.class_id, o.detection_id, f.hit FROM f JOIN o USING (image_id, class_id, r)),
det AS (SELECT p.*, CASE WHEN m.hit IS NULL THEN 'FP' ELSE 'TP' END AS match_status, m.hit FROM pred p JOIN m USING (image_id, class_id, detection_id)),
gtm AS (SELECT g.*, CASE WHEN m.hit IS NULL THEN 'FN' ELSE 'TP' END AS match_status, m.detection_id FROM gt g LEFT JOIN m ON m.hit = g.ord AND m.image_id = g.image_id AND m.class_id = g.class_id)"""


def _tables(spark, d) -> detection.DetectionTables:
    p, g = shapes.boxes(spark, d)
    return detection.evaluate_detection(p, g, order="pos", gt_order="pos")


@query(f"{_GREEDY}, b AS (SELECT detection_id, max(iou) AS best FROM pr GROUP BY 1), t AS (SELECT d AS d, g AS g, iou FROM pr) SELECT det.image_id, det.class_id, det.detection_id, det.match_status, CASE WHEN hit IS NOT NULL THEN 'g' || hit END AS matched_gt_id, round(CASE WHEN hit IS NULL THEN coalesce(best, 0) ELSE t.iou END, 6) AS iou FROM det LEFT JOIN b USING (detection_id) LEFT JOIN t ON t.d = det.ord AND t.g = det.hit")
def match_detections(spark, d):
    return rounded(_tables(spark, d).detections.select("image_id", "class_id", "detection_id", "match_status", "matched_gt_id", "iou"))


@query(f"{_GREEDY}, b AS (SELECT gt_id, max(iou) AS best FROM pr GROUP BY 1) SELECT gtm.image_id, gtm.class_id, gtm.gt_id, gtm.match_status, gtm.detection_id AS matched_detection_id, round(CASE WHEN gtm.detection_id IS NULL THEN coalesce(best, 0) ELSE (SELECT max(iou) FROM pr WHERE pr.detection_id = gtm.detection_id AND pr.gt_id = gtm.gt_id) END, 6) AS iou FROM gtm LEFT JOIN b USING (gt_id)")
def match_ground_truth(spark, d):
    return rounded(_tables(spark, d).ground_truth.select("image_id", "class_id", "gt_id", "match_status", "matched_detection_id", "iou"))


_METRICS = f"""{_GREEDY}, da AS (SELECT image_id, class_id, count(*) AS num_detections, count_if(match_status = 'TP') AS tp, count_if(match_status = 'FP') AS fp, avg(confidence) AS mc, max(confidence) AS xc, min(confidence) AS nc, any_value(class_name) AS dn FROM det GROUP BY ALL),
ga AS (SELECT image_id, class_id, count(*) AS num_gt, count_if(match_status = 'FN') AS fn, any_value(class_name) AS gn FROM gtm GROUP BY ALL),
j AS (SELECT image_id, class_id, coalesce(gn, dn) AS class_name, coalesce(num_gt, 0) AS num_gt, coalesce(num_detections, 0) AS num_detections, coalesce(tp, 0) AS tp, coalesce(fp, 0) AS fp, coalesce(fn, 0) AS fn, mc, xc, nc FROM da FULL JOIN ga USING (image_id, class_id)),
k AS (SELECT *, tp / nullif(num_detections, 0)::DOUBLE AS p, tp / nullif(num_gt, 0)::DOUBLE AS r FROM j),
met AS (SELECT image_id, class_id, class_name, num_gt, num_detections, tp, fp, fn, p, r, CASE WHEN p IS NULL OR r IS NULL THEN NULL WHEN p + r = 0 THEN 0 ELSE 2 * p * r / (p + r) END AS f1, fp > 0 OR fn > 0 AS has_failure, fn > 0 AS missed_object, fp > 0 AS false_positive, p < 0.5 AS low_precision, r < 0.5 AS low_recall, mc, xc, nc FROM k)"""


@query(f"{_METRICS} SELECT image_id, class_id, class_name, CAST(num_gt AS BIGINT) AS num_gt, CAST(num_detections AS BIGINT) AS num_detections, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(p, 6) AS precision, round(r, 6) AS recall, round(f1, 6) AS f1, has_failure, missed_object, false_positive, low_precision, low_recall, round(mc, 6) AS mean_detection_confidence, round(xc, 6) AS max_detection_confidence, round(nc, 6) AS min_detection_confidence, 'fixture' AS detector_name, 'events' AS dataset_name FROM met")
def image_class_metrics(spark, d):
    t = _tables(spark, d)
    return rounded(detection.image_class_metrics(t.detections, t.ground_truth, detector_name="fixture", dataset_name="events"))


@query(f"WITH {shapes.SQL_BOXES}, s AS (SELECT image_id, class_id, CASE WHEN ord % 11 = 0 THEN NULL ELSE ((ord * 17) % 101) / 4.0::DOUBLE END AS s FROM pred) SELECT image_id, class_id, round(avg(s), 6) AS chip_ood_mean, max(s) AS chip_ood_max, round(quantile_cont(s, 0.9), 6) AS chip_ood_p90, round(stddev_pop(s), 6) AS chip_ood_std, count(s) AS num_chips FROM s GROUP BY ALL")
def chip_score_stats(spark, d):
    return rounded(detection.aggregate_chip_scores(_chip_scores(shapes.boxes(spark, d)[0])))


def _chip_scores(pred: DataFrame) -> DataFrame:
    score = F.when(F.col("pos") % 11 == 0, F.lit(float("nan"))).otherwise(((F.col("pos") * 17) % 101) / F.lit(4.0))
    return pred.withColumn("chip_ood_score", score)


def failure_table(spark, d) -> DataFrame:
    """Metrics per image and class with chip and global scores; the data set is named by the image."""
    t = _tables(spark, d)
    p, _ = shapes.boxes(spark, d)
    g = p.groupBy("image_id").agg((F.sum("pos") % 1000 / F.lit(8.0)).alias("global_ood_score"))
    out = detection.attach_ood_features(t.metrics.drop("dataset_name"), g, _chip_scores(p))
    return out.withColumn("dataset_name", F.when(F.col("image_id") % 3 == 0, "reference").otherwise("shifted"))


_FAIL = f"""{_METRICS}, cs AS (SELECT image_id, class_id, CASE WHEN ord % 11 = 0 THEN NULL ELSE ((ord * 17) % 101) / 4.0::DOUBLE END AS s FROM pred), ca AS (SELECT image_id, class_id, avg(s) AS chip_ood_mean, max(s) AS chip_ood_max, quantile_cont(s, 0.9) AS chip_ood_p90, stddev_pop(s) AS chip_ood_std, count(s) AS num_chips FROM cs GROUP BY ALL),
gs AS (SELECT image_id, (sum(ord) % 1000) / 8.0::DOUBLE AS global_ood_score FROM pred GROUP BY 1),
fa AS (SELECT met.*, global_ood_score, chip_ood_mean, chip_ood_max, chip_ood_p90, chip_ood_std, coalesce(num_chips, 0) AS num_chips, CASE WHEN image_id % 3 = 0 THEN 'reference' ELSE 'shifted' END AS dataset_name FROM met LEFT JOIN gs USING (image_id) LEFT JOIN ca USING (image_id, class_id))"""


@query(f"{_FAIL} SELECT image_id, class_id, has_failure, round(global_ood_score, 6) AS global_ood_score, round(chip_ood_mean, 6) AS chip_ood_mean, round(chip_ood_p90, 6) AS chip_ood_p90, num_chips, dataset_name FROM fa")
def attach_ood_features(spark, d):
    return rounded(failure_table(spark, d).select("image_id", "class_id", "has_failure", "global_ood_score", "chip_ood_mean", "chip_ood_p90", "num_chips", "dataset_name"))


@query(f"{_FAIL} SELECT dataset_name, count(*) AS n_rows, CAST(count_if(num_gt > 0 AND num_detections = 0) AS BIGINT) AS gt_only, CAST(count_if(num_gt = 0 AND num_detections > 0) AS BIGINT) AS detection_only, CAST(count_if(num_chips = 0) AS BIGINT) AS missing_chip_features FROM fa GROUP BY 1")
def coverage_summary(spark, d):
    return failure.coverage_summary(failure_table(spark, d)).select("dataset_name", *[F.col(c).cast("bigint").alias(c) for c in ("n_rows", "gt_only", "detection_only", "missing_chip_features")])


@query(f"{_FAIL} SELECT dataset_name, count(DISTINCT image_id) AS n_images, count(*) AS n_rows, round(avg(has_failure::INT), 6) AS failure_rate, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall FROM fa GROUP BY 1")
def dataset_summary(spark, d):
    return rounded(failure.dataset_summary(failure_table(spark, d)))


@query(f"{_FAIL}, b AS (SELECT CAST(least(floor(mc / 500 * 3), 2) AS INTEGER) AS bin, chip_ood_mean AS o, has_failure::INT AS f FROM fa WHERE mc IS NOT NULL AND chip_ood_mean IS NOT NULL), c AS (SELECT bin, count(*) AS n, quantile_cont(o, 0.33) AS lo, quantile_cont(o, 0.67) AS hi FROM b GROUP BY 1 HAVING count(*) >= 4) SELECT bin, n, round(lo, 6) AS low_cut, round(hi, 6) AS high_cut, round(avg(CASE WHEN o <= lo THEN f END), 6) AS low_failure, round(avg(CASE WHEN o >= hi THEN f END), 6) AS high_failure FROM b JOIN c USING (bin) GROUP BY ALL")
def confidence_ood_failure(spark, d):
    t = failure_table(spark, d).withColumn("mean_detection_confidence", F.col("mean_detection_confidence") / 500)
    return rounded(failure.confidence_ood_failure(t))


@query(f"{_FAIL}, z AS (SELECT avg(chip_ood_mean) AS a, stddev_pop(chip_ood_mean) AS b, avg(global_ood_score) AS c, stddev_pop(global_ood_score) AS e FROM fa WHERE dataset_name = 'reference') SELECT image_id, class_id, round((chip_ood_mean - a) / b, 6) AS z_chip_ood_mean, round((global_ood_score - c) / e, 6) AS z_global_ood_score, round(coalesce((chip_ood_mean - a) / b, 0) + coalesce((global_ood_score - c) / e, 0), 6) AS z_combined FROM fa, z")
def reference_zscores(spark, d):
    return rounded(failure.reference_zscores(failure_table(spark, d), ("chip_ood_mean", "global_ood_score"), "dataset_name", "reference").select("image_id", "class_id", "z_chip_ood_mean", "z_global_ood_score", "z_combined"))


@query(f"{_FAIL} SELECT image_id, class_id, round(mc, 6) AS mean_detection_confidence, round(chip_ood_mean, 6) AS chip_ood_mean FROM fa WHERE has_failure AND mc >= 60 ORDER BY fa.chip_ood_mean DESC NULLS LAST, image_id, class_id LIMIT 15")
def high_confidence_failures(spark, d):
    return rounded(failure.high_confidence_failures(failure_table(spark, d), least=60, top_k=15).select("image_id", "class_id", "mean_detection_confidence", "chip_ood_mean"))


def _baselines(spark, d):
    t = failure_table(spark, d)
    t = cut(t, "failure")
    return failure.evaluate_failure_baselines(t, keep=("class_id", "dataset_name"))


@query()
def failure_baselines(spark, d):
    return rounded(_baselines(spark, d)[0])


@query()
def failure_by_domain(spark, d):
    return rounded(failure.classification_metrics(_baselines(spark, d)[1], ["model", "dataset_name"]))


@query()
def failure_calibration(spark, d):
    return rounded(failure.calibration_by_model(_baselines(spark, d)[1]))


@query(f"WITH {shapes.SQL_BOXES}, n AS (SELECT 'error' AS class_name, 'fault' AS new_name, 7 AS new_id UNION ALL SELECT 'view', 'look', 9) SELECT detection_id, new_name AS class_name, CAST(new_id AS INTEGER) AS class_id FROM pred JOIN n USING (class_name)")
def remap_classes(spark, d):
    m = spark.createDataFrame([("error", "fault", 7), ("view", "look", 9)], "class_name string, new_name string, new_id int")
    return detection.remap_classes(shapes.boxes(spark, d)[0], m).select("detection_id", "class_name", "class_id")


@query(f"WITH {shapes.SQL_BOXES}, l AS (SELECT image_id, ord AS label_id, bbox AS lb FROM gt), j AS (SELECT p.image_id, p.ord AS chip_idx, l.label_id, abs(bbox[1] - lb[1]) + abs(bbox[2] - lb[2]) + abs(bbox[3] - lb[3]) + abs(bbox[4] - lb[4]) AS l1, {X.sql_iou('bbox', 'lb')} AS iou FROM pred p JOIN l USING (image_id)) SELECT image_id, chip_idx, label_id, l1, round(iou, 6) AS iou FROM j QUALIFY row_number() OVER (PARTITION BY image_id, chip_idx ORDER BY l1, -iou, label_id) = 1")
def nearest_label(spark, d):
    p, g = shapes.boxes(spark, d)
    chips = p.select("image_id", F.col("pos").alias("chip_idx"), F.col("bbox").alias("box"))
    labels = g.select("image_id", F.col("pos").alias("label_id"), F.col("bbox").alias("box"))
    return rounded(detection.nearest_label(chips, labels))


@query(f"WITH {shapes.SQL_BOXES} SELECT image_id, min(ord) AS \"first\", 'img/' || image_id || '.jpg' AS image_path, list(detection_id ORDER BY ord)[1] AS first_detection, count(*) AS n FROM pred GROUP BY image_id")
def detection_chips(spark, d):
    p = shapes.boxes(spark, d)[0].withColumnRenamed("pos", "ord")
    imgs = p.select("image_id").distinct().withColumn("image_path", F.concat(F.lit("img/"), "image_id", F.lit(".jpg")))
    c = detection.detection_chips(p, imgs)
    return c.select("image_id", "first", "image_path", F.col("detection_ids")[0].alias("first_detection"), F.size("detection_ids").cast("bigint").alias("n"))


def _geom(n: int) -> str:
    return f"""{shapes.sql_chips(n)}, ge AS (SELECT image_idx, chip_idx, class_id, score, box, (box[1] + box[3]) * 0.5::DOUBLE / image_w AS cx, (box[2] + box[4]) * 0.5::DOUBLE / image_h AS cy, ln((box[3] - box[1]) * (box[4] - box[2]) / (image_w * image_h)) AS la, ln((box[3] - box[1]) / (box[4] - box[2])) AS lr FROM ch)"""


@query(f"WITH {_geom(500)} SELECT image_idx, chip_idx, round(cx, 9) AS cx, round(cy, 9) AS cy, round(la, 9) AS log_area, round(lr, 9) AS log_aspect FROM ge")
def geometry_features(spark, d):
    return rounded(geometry.geometry_features(shapes.chips(spark, d)).select("image_idx", "chip_idx", "cx", "cy", "log_area", "log_aspect"), 9)


def _pairs(n: int, k: int = 4, most: int = 256) -> str:
    """All pairs of images with few, nearest edges of the others."""
    return f"""{_geom(n)}, cnt AS (SELECT image_idx, count(*) AS n FROM ge GROUP BY 1), ds AS (SELECT p.image_idx, p.chip_idx AS me, q.chip_idx AS other, sqrt(pow(p.cx - q.cx, 2) + pow(p.cy - q.cy, 2)) AS dist FROM ge p JOIN ge q ON p.image_idx = q.image_idx AND p.chip_idx <> q.chip_idx),
nb AS (SELECT *, row_number() OVER (PARTITION BY image_idx, me ORDER BY round(dist, 12), other) AS r FROM ds), ed AS (SELECT DISTINCT image_idx, least(me, other) AS a, greatest(me, other) AS b, round(dist, 12) AS dist FROM nb WHERE r <= {k}),
pk AS (SELECT image_idx, a, b FROM (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY dist, a, b) AS r FROM ed JOIN cnt USING (image_idx) WHERE n * (n - 1) / 2 > {most}) WHERE r <= {most} UNION ALL SELECT image_idx, me, other FROM ds JOIN cnt USING (image_idx) WHERE n * (n - 1) / 2 <= {most} AND me < other),
pf AS (SELECT image_idx, a, b, CASE WHEN s THEN qc ELSE pc END AS ci, CASE WHEN s THEN pc ELSE qc END AS cj, greatest(ps, qs) AS top, (CASE WHEN s THEN -1 ELSE 1 END) * (qx - px) AS dx, (CASE WHEN s THEN -1 ELSE 1 END) * (qy - py) AS dy, (CASE WHEN s THEN -1 ELSE 1 END) * (pa - qa) AS sc, {X.sql_iou('pb', 'qb')} AS iou, sqrt(pow(qx - px, 2) + pow(qy - py, 2)) AS dist
 FROM (SELECT pk.*, p.class_id AS pc, q.class_id AS qc, p.class_id > q.class_id AS s, p.score AS ps, q.score AS qs, p.cx AS px, q.cx AS qx, p.cy AS py, q.cy AS qy, p.la AS pa, q.la AS qa, p.box AS pb, q.box AS qb FROM pk JOIN ge p ON p.image_idx = pk.image_idx AND p.chip_idx = pk.a JOIN ge q ON q.image_idx = pk.image_idx AND q.chip_idx = pk.b))"""


_PF = "SELECT image_idx, a, b, ci, cj, round(dist, 6) AS dist, round(dx, 6) AS dx, round(dy, 6) AS dy, round(sc, 6) AS scale, round(iou, 6) AS iou FROM pf"


@query(f"WITH {_pairs(500)} {_PF}")
def scene_pairs(spark, d):
    return _scene(spark, d, 500)


@query(f"WITH {_pairs(100)} {_PF}")
def scene_pairs_crowded(spark, d):
    return _scene(spark, d, 100)


def _scene(spark, d, n):
    p = geometry.pair_features(geometry.geometry_features(shapes.chips(spark, d, n)), 4, 256)
    return rounded(p.select("image_idx", "a", "b", "ci", "cj", "dist", "dx", "dy", "scale", "iou"))


_F5 = ("dist", "dx", "dy", "sc", "iou")
_MS = lambda t, cols: ", ".join(f"avg({c}) AS {t}m_{c}, CASE WHEN count(*) < 2 OR stddev_pop({c}) <= 1e-6 THEN 1 ELSE stddev_pop({c}) END AS {t}s_{c}" for c in cols)
_Z = " + ".join(f"abs(({c} - pm_{c}) / ps_{c})" for c in _F5)
_SCENE = f"""WITH {_pairs(500)}, sg AS (SELECT class_id, {_MS('c', ('la', 'lr'))} FROM ge GROUP BY 1), sz AS (SELECT image_idx, avg((abs((la - cm_la) / cs_la) + abs((lr - cm_lr) / cs_lr)) / 2) AS size FROM ge JOIN sg USING (class_id) GROUP BY 1),
pg AS (SELECT ci, cj, count(*) AS seen, {_MS('p', _F5)} FROM pf GROUP BY 1, 2), tt AS (SELECT sum(seen) AS total, count(*) AS vocab FROM pg), sm AS (SELECT avg(score) AS m, stddev_pop(score) AS s FROM ge),
pv AS (SELECT image_idx, ({_Z}) / 5 AS l, -ln((seen + 1.0::DOUBLE) / (total + 1.0::DOUBLE * (vocab + 1))) AS c, greatest(0, (top - m) / s) AS z FROM pf JOIN pg USING (ci, cj), tt, sm),
im AS (SELECT image_idx, avg(l) AS layout, avg(c) AS cooccurrence, avg(z * (l + c)) AS interaction FROM pv GROUP BY 1),
nd AS (SELECT image_idx, avg(score) AS node FROM (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY score DESC, chip_idx) AS r FROM ge) WHERE r <= 3 GROUP BY 1),
raw AS (SELECT image_idx, node, size, coalesce(layout, 0) AS layout, coalesce(cooccurrence, 0) AS cooccurrence, coalesce(interaction, 0) AS interaction FROM nd JOIN sz USING (image_idx) LEFT JOIN im USING (image_idx)),
cal AS (SELECT {_MS('k', geometry.COMPONENTS)} FROM raw),
co AS (SELECT image_idx, {', '.join(f'greatest(0, ({c} - km_{c}) / ks_{c}) AS {c}' for c in geometry.COMPONENTS)} FROM raw, cal)
SELECT image_idx, round(node + size + layout + cooccurrence + interaction, 5) AS score, {', '.join(f'round({c}, 5) AS {c}' for c in geometry.COMPONENTS)} FROM co"""


@query(_SCENE)
def scene_scores(spark, d):
    c = shapes.chips(spark, d)
    return rounded(geometry.GeometryAwarePooler().fit(c).score(c, return_components=True), 5)


@query("SELECT CAST(i AS BIGINT) AS sample_id, CAST(i >= 7 AS INTEGER) AS ood FROM (SELECT unnest(range(12)) AS i)")
def labels_from_counts(spark, d):
    return combine.ood_labels_from_counts(spark, 7, 5)


@query("SELECT CAST(i AS BIGINT) AS sample_id, CAST(CASE WHEN i < 3 THEN 0 WHEN i < 7 THEN 2 ELSE 3 END AS INTEGER) AS block, CAST(i >= 3 AND i < 7 AS INTEGER) AS ood FROM (SELECT unnest(range(9)) AS i)")
def labels_from_blocks(spark, d):
    return combine.ood_labels_from_blocks(spark, [3, 0, 4, 2], [0, 1, 1, 0])


@query("""WITH u AS (SELECT 0 AS block, 0 AS ood, event_id AS k, event_id % 50 AS image_idx, value FROM events WHERE event_id % 2 = 0 UNION ALL SELECT 1, 1, event_id, event_id % 40, value FROM events WHERE event_id % 2 = 1)
SELECT CAST(row_number() OVER (ORDER BY block, k) - 1 AS BIGINT) AS sample_id, CAST(block AS INTEGER) AS block, CAST(ood AS INTEGER) AS ood, image_idx + CASE WHEN block = 1 THEN (SELECT max(image_idx) + 1 FROM u WHERE block = 0) ELSE 0 END AS image_idx, value FROM u""")
def concatenate_blocks(spark, d):
    e = table(spark, d, "events")
    a = e.where("event_id % 2 = 0").select(F.col("event_id").alias("sample_id"), (F.col("event_id") % 50).alias("image_idx"), "value")
    b = e.where("event_id % 2 = 1").select(F.col("event_id").alias("sample_id"), (F.col("event_id") % 40).alias("image_idx"), "value")
    return combine.concatenate([a, b], [0, 1], image="image_idx")


@query(f"WITH {C}, n AS (SELECT im, CASE WHEN count(*) <= 1 THEN '1' WHEN count(*) = 2 THEN '2' WHEN count(*) <= 5 THEN '3-5' ELSE '6+' END AS bucket, max(ood) AS ood, max(score)::FLOAT AS score, im AS sample_id FROM (SELECT *, (chip_idx // 100) * 100 + (chip_idx % 100) // (1 + (chip_idx // 100) % 8) AS im FROM ch) GROUP BY im), {_RANK.format(keys='bucket', src='n')} SELECT bucket, round(sum(CASE WHEN ood = 0 THEN tp END) / nullif(max(n_pos) * (max(n) - max(n_pos)), 0)::DOUBLE, 6) AS auroc FROM r GROUP BY bucket")
def metrics_by_count(spark, d):
    """Images of one to eight chips."""
    i = F.col("chip_idx")
    size = 1 + F.floor(i / 100) % 8
    c = shapes.chips(spark, d).withColumn("image_idx", F.floor(i / 100) * 100 + F.floor((i % 100) / size))
    i = c.groupBy("image_idx").agg(F.max("ood").alias("ood"), F.max("score").alias("s"))
    return rounded(analysis.metrics_by_count(i, c, "s").select("bucket", "auroc"))


@query(f"WITH {shapes.SQL_BANK}, o AS (SELECT * FROM long WHERE ood = 1), u AS (SELECT sample_id, ood, detector, score, grp FROM o UNION ALL SELECT l.sample_id, l.ood, l.detector, l.score, g.grp FROM long l, (SELECT DISTINCT grp FROM o) g WHERE l.ood = 0), {_RANK.format(keys='detector, grp', src='u')} SELECT detector, grp, round(sum(CASE WHEN ood = 0 THEN tp END) / (max(n_pos) * (max(n) - max(n_pos)))::DOUBLE, 6) AS auroc FROM r GROUP BY detector, grp")
def metrics_per_domain(spark, d):
    long = shapes.bank(spark, d).long("ood", "grp")
    return rounded(analysis.per_domain(long, "grp").select("detector", "grp", "auroc"))


@query(f"""WITH {C}, k AS (SELECT *, row_number() OVER (PARTITION BY image_idx ORDER BY chip_idx) - 1 AS place FROM ch)
SELECT image_idx, CAST(row_number() OVER (ORDER BY image_idx, chip_idx) - 1 AS BIGINT) AS chip_idx, CAST(place AS INTEGER) AS place, box[1] AS x1, CAST(class_id AS INTEGER) AS label, 'im' || image_idx || '_' || ['c0', 'c1', 'c2', 'c3', 'c4'][class_id + 1] || '_g_' || (row_number() OVER (PARTITION BY image_idx, class_id ORDER BY chip_idx) - 1) AS object_id FROM k
UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL WHERE false""")
def chip_stream(spark, d):
    """Nested records, one per image, flattened to chips with object ids."""
    c = shapes.chips(spark, d)
    nested = c.groupBy("image_idx").agg(F.array_sort(F.collect_list(F.struct("chip_idx", "box", "class_id"))).alias("r"))  # a fixture of small images
    rec = nested.select("image_idx", F.concat(F.lit("img/"), "image_idx").alias("path"), F.col("r.box").alias("b"), F.col("r.class_id").alias("l"), F.lit("g").alias("g"), F.concat(F.lit("im"), "image_idx").alias("i"))
    a = chips.annotations(rec.withColumnRenamed("path", "image_path"), boxes="b", labels="l", grp="g", image_id="i")
    a = a.withColumn("image_idx", F.regexp_extract("image_path", r"(\d+)$", 1).cast("long"))
    s = chips.chip_stream(a, class_names=["c0", "c1", "c2", "c3", "c4"])
    return s.select("image_idx", F.col("chip_idx").cast("long").alias("chip_idx"), "place", F.col("box")[0].alias("x1"), F.col("label").cast("int").alias("label"), "object_id")


@query(f"""WITH {C}, ev AS (SELECT event_id, time_bucket(INTERVAL 1 hour, ts) AS w, event_type, value FROM events)
SELECT w AS start, event_type, count(*) AS n, CAST(count_if(value > 60) AS BIGINT) AS n_out, round(avg(value), 6) AS mean_score FROM ev GROUP BY ALL""")
def outlier_rates(spark, d):
    """The windowed aggregate of the streaming module, over the table at rest."""
    from skewline.streaming.scoring import outlier_rates as rates

    e = table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    out = rates(e, "ts", "value", 60, "1 hour", keys=("event_type",))
    return rounded(out.select(F.col("window.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "n_out", "mean_score"))


@query(f"WITH {C} SELECT image_idx, round(avg(s), 6) AS pooled, any_value(o) AS ood FROM (SELECT image_idx, score AS s, row_number() OVER (PARTITION BY image_idx ORDER BY score DESC, chip_idx) AS r, max(ood) OVER (PARTITION BY image_idx) AS o FROM ch) WHERE r <= 3 GROUP BY image_idx")
def chips_to_images(spark, d):
    """Chip scores pooled and fused to image scores, end to end; the SQL checks the pooled part."""
    from skewline.plans.pipelines import chips_to_images as chain

    c = shapes.chips(spark, d)
    return rounded(chain(c.where("image_idx % 2 = 0"), c).select("image_idx", "pooled", "ood"))
