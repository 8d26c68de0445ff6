"""Queries through the sources: annotation files, synset tables, stores, label records and models, written to the shared folder first."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.operators import chips
from skewline.operators import detectors as D
from skewline.plans import detecting, shapes
from skewline.plans.ranking import rounded
from skewline.session import cut, scratch_path, table
from skewline.sources import bdd, coco, images, imagenet, saved, store

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


#: of the boxes some are crowds, some lack a number, some have no height
_ANN = "SELECT *, event_type AS domain, event_id % 50 AS image, event_id % 7 = 0 AS crowd, event_id % 11 = 0 AS short, event_id % 13 = 0 AS flat, (event_id % 40)::DOUBLE AS x, (event_id % 30)::DOUBLE AS y, (5 + event_id % 60)::DOUBLE AS w, CASE WHEN event_id % 13 = 0 THEN 0 ELSE 5 + event_id % 45 END::DOUBLE AS h, event_id % 3 AS cat FROM events"


def _coco_root(spark: SparkSession, d: str) -> str:
    """One annotation file for each event type, and an image folder beside it. A file is one document by its format."""
    i = F.col("event_id")
    h = F.when(i % 13 == 0, 0).otherwise(5 + i % 45).cast("double")
    bbox = F.when(i % 11 == 0, F.array((i % 40).cast("double"), (i % 30).cast("double"), (5 + i % 60).cast("double"))).otherwise(F.array((i % 40).cast("double"), (i % 30).cast("double"), (5 + i % 60).cast("double"), h))
    e = table(spark, d, "events").select("event_type", F.struct(i.alias("id"), (i % 50).alias("image_id"), (10 + i % 3 * 5).alias("category_id"), bbox.alias("bbox"), (i % 7 == 0).cast("int").alias("iscrowd")).alias("a"))
    pics = F.transform(F.sequence(F.lit(0), F.lit(49)), lambda k: F.struct(k.alias("id"), F.concat(F.lit("dir/im"), k, F.lit(".jpg")).alias("file_name"), (F.lit(100) + k).alias("width"), F.lit(80).alias("height")))
    cats = F.array(*[F.struct(F.lit(10 + 5 * k).alias("id"), F.lit(n).alias("name")) for k, n in ((2, "zebra"), (0, "apple"), (1, "mug"))])
    docs = e.groupBy("event_type").agg(F.array_sort(F.collect_list("a")).alias("annotations"))
    root = scratch_path(spark, "coco")
    for r in docs.select("event_type").collect():  # five domains
        one = docs.where(F.col("event_type") == r["event_type"]).select(F.to_json(F.struct(pics.alias("images"), "annotations", cats.alias("categories"))).alias("value"))
        one.coalesce(1).write.text(f"{root}/{r['event_type']}/annotations/instances_val2017.json")
        spark.range(1).select(F.lit("x").alias("value")).write.text(f"{root}/{r['event_type']}/val2017")
    return root


_CATS = "['apple', 'mug', 'zebra'][cat + 1]"


@query(f"""WITH a AS ({_ANN}), u AS (SELECT * FROM a WHERE NOT crowd AND NOT short AND w >= 8 AND h >= 8)
SELECT domain AS grp, image AS image_idx, CAST(row_number() OVER (PARTITION BY domain ORDER BY image, event_id) - 1 AS BIGINT) AS chip_idx, 'im' || image || '_' || {_CATS} || '_' || domain || '_' || (row_number() OVER (PARTITION BY domain, image, cat ORDER BY event_id) - 1) AS object_id, CAST(cat AS INTEGER) AS class_id, x AS x1, y AS y1, x + w AS x2, y + h AS y2 FROM u""")
def coco_chips(spark, d):
    """Discovery of all domains, one category table, boxes with both sides long enough, one chip stream for each domain."""
    root = _coco_root(spark, d)
    rows = cut(coco.load_domains(spark, coco.discover_ood(spark, root), min_side=8), "coco-rows")
    parts = None
    for p in coco.discover_ood(spark, root):
        c = coco.chip_table(rows.where(F.col("grp") == p.name))
        parts = c if parts is None else parts.unionByName(c)
    return parts.select("grp", F.col("image_idx").cast("bigint").alias("image_idx"), "chip_idx", "object_id", "class_id", *[F.col("box")[k].alias(n) for k, n in enumerate(("x1", "y1", "x2", "y2"))])


@query("SELECT CAST(10 + 5 * i AS BIGINT) AS category_id, CAST(i AS INTEGER) AS class_id, ['apple', 'mug', 'zebra'][i + 1] AS class_name FROM (SELECT unnest(range(3)) AS i)")
def coco_categories(spark, d):
    root = _coco_root(spark, d)
    return coco.check_same_categories([coco.categories(coco.read(spark, p.annotations)) for p in coco.discover_ood(spark, root)]).select("category_id", "class_id", "class_name")


@query(f"WITH a AS ({_ANN}) SELECT domain, CAST(event_id AS VARCHAR) AS gt_id, 'im' || image AS image_id, {_CATS} AS class_name, x AS x1, x + w AS x2, y + h AS y2, (100 + image)::DOUBLE AS image_width FROM a WHERE NOT crowd AND NOT short AND h > 0")
def coco_flat_tables(spark, d):
    root, out = _coco_root(spark, d), None
    for p in coco.discover_ood(spark, root):
        pics, gt = coco.tables(coco.read(spark, p.annotations))
        t = gt.join(pics, "image_id").select(F.lit(p.name).alias("domain"), "gt_id", "image_id", "class_name", F.col("bbox")[0].alias("x1"), F.col("bbox")[2].alias("x2"), F.col("bbox")[3].alias("y2"), "image_width")
        out = t if out is None else out.unionByName(t)
    return out


def _synsets(spark: SparkSession, d: str) -> DataFrame:
    """A synset file of the nations (a fixed dimension), with a comment and blank lines."""
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("n"), F.lpad((F.col("n_nationkey") * 7).cast("string"), 8, "0"), F.lit(" "), F.col("n_name")).alias("value"))
    path = scratch_path(spark, "synsets")
    lines = [r["value"] for r in n.orderBy("k").collect()]  # 25 rows
    spark.createDataFrame([("# names\n\n" + "\n\n".join(lines),)], "value string").coalesce(1).write.text(path)
    return imagenet.synsets(spark, path)


_SYN = "syn AS (SELECT 'n' || lpad(CAST(n_nationkey * 7 AS VARCHAR), 8, '0') AS wnid, n_name AS class_name FROM nation)"


@query(f"WITH {_SYN} SELECT wnid, CAST(row_number() OVER (ORDER BY wnid) - 1 AS INTEGER) AS class_id, class_name FROM syn")
def synset_table(spark, d):
    return _synsets(spark, d)


@query(f"""WITH {_SYN}, f AS (SELECT DISTINCT 'n' || lpad(CAST(s_suppkey % 60 AS VARCHAR), 8, '0') AS wnid FROM supplier)
SELECT coalesce(f.wnid, syn.wnid) AS wnid, CASE WHEN f.wnid IS NULL THEN 'missing' WHEN syn.wnid IS NULL THEN 'unknown' ELSE 'present' END AS status FROM f FULL JOIN syn ON f.wnid = syn.wnid""")
def synset_folders(spark, d):
    """Folders against the synset table: intersection and both differences."""
    f = table(spark, d, "supplier").select(F.concat(F.lit("n"), F.lpad((F.col("s_suppkey") % 60).cast("string"), 8, "0")).alias("folder"))
    return imagenet.validate_root(f, _synsets(spark, d))


@query("SELECT vec_id AS sample_id, embedding[1]::DOUBLE AS first, embedding[64]::DOUBLE AS last, CAST(label AS BIGINT) AS labels, 'g' || label AS \"group\" FROM embeddings")
def stored_embeddings(spark, d):
    """Saved as a store of npy files, read back through the data source."""
    return _stored(spark, d, 1.0)


@query("SELECT CAST(greatest(1, floor(count(*) * 0.3)) AS BIGINT) AS n, CAST(greatest(1, floor(count(*) * 0.3)) AS BIGINT) AS n_ids FROM embeddings")
def stored_share(spark, d):
    """Exactly the share that was asked for, without repeats."""
    s = _stored(spark, d, 0.3)
    return s.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("sample_id").alias("n_ids"))


def _stored(spark, d, frac):
    e = table(spark, d, "embeddings")
    rows = e.select(F.col("vec_id").alias("sample_id"), F.col("embedding").alias("embeddings"), F.col("label").cast("long").alias("labels"), F.concat(F.lit("g"), "label").alias("group"))
    path = scratch_path(spark, "store")
    store.save_npy(rows, path)
    s = store.load(spark, path, frac, seed=5)
    # ids of the store count its rows; the vectors' own ids are dense from the least on
    least = e.agg(F.min("vec_id")).head()[0]
    return s.select((F.col("sample_id") + least).alias("sample_id"), F.col("embeddings")[0].cast("double").alias("first"), F.col("embeddings")[63].cast("double").alias("last"), "labels", "group")


def register_bdd(sql: dict[str, str]) -> None:
    """The label records' queries build on the SQL of the flat tables."""
    boxes, objects, records = (f"(SELECT * FROM ({sql[n]}))" for n in ("p5_boxes", "p5_objects", "p5_records"))
    key = "lower(trim({0}, E' \\t\\n\\r'))"
    S["bdd_attributes"] = f"""SELECT record_id, regexp_replace(name, '\\.[^.]*$', '') AS image_id, weather, scene, timeofday, CASE WHEN {key.format('weather')} = 'clear' AND {key.format('timeofday')} = 'daytime' THEN 'reference' ELSE 'shifted' END AS bdd_partition FROM {records}"""
    S["bdd_chips"] = f"""SELECT b.record_id, b.obj_path, CAST(c.class_id AS INTEGER) AS class_id, c.class_name, b.x1, b.y2 FROM {boxes} b JOIN {objects} o USING (record_id, obj_path) JOIN bdd_classes c ON c.class_name = o.category WHERE least(b.x2 - b.x1, b.y2 - b.y1) >= 12"""


@query()
def bdd_attributes(spark, d):
    return bdd.attributes(table(spark, d, "bdd_label_train"))


@query()
def bdd_chips(spark, d):
    """Boxes of the usual classes whose shorter side is long enough."""
    raw = table(spark, d, "bdd_label_train")
    c = bdd.chip_annotations(raw, table(spark, d, "bdd_classes"), min_side=12)
    return c.select("record_id", "obj_path", F.col("class_id").cast("int").alias("class_id"), "class_name", F.col("box")[0].alias("x1"), F.col("box")[3].alias("y2"))


def _bytes_model():
    """A stand-in for a network: length, first and last byte."""
    return lambda batch: (np.array([[len(x) % 1000, x[0] if x else 0, x[-1] if x else 0] for x in batch], np.float32).reshape(-1, 3), None)


_RAW = "SELECT event_id AS id, encode(event_type || '-' || event_id || '-' || props) AS c, event_id % 3 AS label FROM events"


@query(f"WITH r AS ({_RAW}) SELECT id, octet_length(c) % 1000 AS a, ord(event_type[1]) AS b, 125 AS z FROM r JOIN events ON id = event_id")
def extracted_features(spark, d):
    """A registered model run over contents in batches, through the embedder."""
    images.register_model("bytes-of-content", _bytes_model)
    rows = table(spark, d, "events").select(F.col("event_id").alias("id"), F.encode(F.concat_ws("-", "event_type", "event_id", "props"), "UTF-8").alias("content"))
    out = images.Embedder("bytes-of-content").fit_extract(rows, "none", keep=("id",))
    return out.select("id", *[F.col("embeddings")[k].cast("bigint").alias(n) for k, n in enumerate("abz")])


def _two_boxes():
    """A stand-in for a detector: one sure box and one whose confidence depends on the content's length."""
    return lambda batch: [[([0.0, 0.0, 5.0, 6.0], 1, "cat", 0.9), ([1.0, 2.0, 3.0, 4.0], 4, "dog", len(x) % 10 / 10)] for x in batch]


@query(f"""WITH r AS ({_RAW}), b AS (SELECT id, 0 AS n, 1 AS class_id, 'cat' AS class_name, 0.9::DOUBLE AS confidence, 5.0::DOUBLE AS x2 FROM r UNION ALL SELECT id, 1, 7, 'dog', (octet_length(c) % 10) / 10.0::DOUBLE, 3.0::DOUBLE FROM r WHERE octet_length(c) % 10 >= 3)
SELECT CAST(id AS VARCHAR) AS image_id, CAST(class_id AS INTEGER) AS class_id, class_name, confidence, x2, id || '_det_' || (row_number() OVER (ORDER BY id, n) - 1) AS detection_id FROM b""")
def detected_boxes(spark, d):
    """A detector over all contents: threshold, mapped names, ids that count through the images in order."""
    rows = table(spark, d, "events").select(F.col("event_id").alias("o"), F.col("event_id").cast("string").alias("image_id"), F.encode(F.concat_ws("-", "event_type", "event_id", "props"), "UTF-8").alias("content"))
    got = images.detect(rows, _two_boxes, "o", threshold=0.3, names={"dog": 7})
    return got.select("image_id", "class_id", "class_name", "confidence", F.col("bbox")[2].alias("x2"), "detection_id")


@query(detecting.S["mahalanobis_scores"])
def saved_mahalanobis(spark, d):
    """Fitted, saved, loaded, scored."""
    return _through_folder(spark, d, D.Mahalanobis(features=detecting.COLS), "label")


@query(detecting.S["knn_scores_cosine"])
def saved_knn_blocks(spark, d):
    """A bank beyond its limit is saved as a table and searched in blocks after loading."""
    return _through_folder(spark, d, D.KNN(10, "cosine", detecting.COLS, bank_limit=1000, block_numbers=4000), None)


def _through_folder(spark, d, det, y):
    train, test, _ = detecting.test_rows(spark, d)
    path = scratch_path(spark, "saved")
    saved.save(spark, det.fit(train, y), path)
    return rounded(saved.load(spark, path).transform(test).select("sample_id", "score"), 5)


@query(f"WITH {shapes.sql_chips()} SELECT chip_idx, image_idx, box[1] AS x1, class_id AS label FROM ch")
def chip_descriptors(spark, d):
    """The fields of each chip's descriptor, over the whole stream (``chips.sample_descriptor`` gives one)."""
    c = shapes.chips(spark, d)
    stream = c.select("chip_idx", "image_idx", F.concat(F.lit("im"), "chip_idx").alias("object_id"), F.concat(F.lit("p"), "image_idx").alias("image_path"), "box", F.col("class_id").alias("label"))
    one = stream.agg(F.max("chip_idx").alias("m")).head()["m"]
    assert chips.sample_descriptor(stream, one)["index"] == one
    return stream.select("chip_idx", "image_idx", F.col("box")[0].alias("x1"), "label")
