"""Queries and SQL of the llm operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions.keys import known_key, ref_key, sql_key
from skewline.llm import mixing, neighbors, residue, splits, tokens, topn
from skewline.session import cut, table

IMAGE_KEYS = ("source_key", "sequence_key")
LABELS = ("weather", "timeofday", "scene")


def p1_top(spark: SparkSession, d: str) -> DataFrame:
    chips = table(spark, d, "chips")
    return topn.top_n_per_group(chips, "chip_to_image", "chip_id", "chip_ood_max", 5, version="scored_at", tie=("arrived_at",))


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return p1_top(spark, d).select("chip_to_image", "chip_id")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return neighbors.pairs(neighbors.knn(table(spark, d, "embedding_result"), k=5, floor=0.85, version="extracted_at"))


def p2_knn(spark: SparkSession, d: str) -> DataFrame:
    """The five most similar of every vector whose id is divisible by 50, against all vectors."""
    found = neighbors.knn(table(spark, d, "embedding_result"), k=5, queries="vec_id % 50 = 0", version="extracted_at")
    return found.select("query_id", "neighbor_id", "rank")


def _image_units(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    images = table(spark, d, "images")
    rec = images.select("image_idx", known_key(F.col("source_image_id"), "unknown").alias("source_key"), known_key(F.col("sequence_id"), "unknown").alias("sequence_key"), ref_key(F.col("image_id")).alias("image_key"))
    links = table(spark, d, "image_links").select(ref_key(F.col("image_id")).alias("a"), ref_key(F.col("other_image_id")).alias("b"))
    return images, splits.units(rec, "image_idx", IMAGE_KEYS, links, "image_key")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    _, u = _image_units(spark, d)
    return u.where("unit <> id").select(F.col("unit").alias("unit_idx"), F.col("id").alias("image_idx"))


def p4_splits(spark: SparkSession, d: str) -> DataFrame:
    images, u = _image_units(spark, d)
    out = splits.split_units(images, u, "image_idx", LABELS)
    return out.select(F.col("id").alias("image_idx"), F.col("unit").alias("unit_idx"), "split")


def p4_report(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all images and of each weather, time of day and scene in each split."""
    images, u = _image_units(spark, d)
    assigned = cut(splits.split_units(images, u, "image_idx", LABELS), "splits")
    return splits.split_report(assigned, images, "image_idx", LABELS)


def p4_straddling(spark: SparkSession, d: str) -> DataFrame:
    """Images and splits of each unit: one split each."""
    return p4_splits(spark, d).groupBy("unit_idx").agg(F.countDistinct("split").alias("n_splits"), F.count(F.lit(1)).alias("n_images")).select("unit_idx", "n_splits", "n_images")


def p4_rows(spark: SparkSession, d: str) -> DataFrame:
    """Rows per table and split of the tables that name images; rows that name no known image have a null split."""
    images = table(spark, d, "images")
    names = images.select(ref_key(F.col("image_id")).alias("k"), "image_idx").where("k is not null").distinct()
    split_of = names.join(p4_splits(spark, d).select("image_idx", "split"), "image_idx").select("k", "split").groupBy("k").agg(F.min("split").alias("split"))
    rows = None
    for t in ("gt_boxes", "detections"):
        r = table(spark, d, t).select(F.lit(t).alias("src_table"), ref_key(F.col("image_id")).alias("k")).groupBy("src_table", "k").agg(F.count(F.lit(1)).alias("n"))
        rows = r if rows is None else rows.unionByName(r)
    return rows.join(split_of, "k", "left").groupBy("src_table", "split").agg(F.sum("n").alias("n"))


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"))


def p6_decoded(spark: SparkSession, d: str) -> DataFrame:
    """Documents by whether decoding their ids gives back their text (null counts as empty)."""
    docs = table(spark, d, "documents")
    ids = tokens.encode(docs, keep=("doc_id", "text")).withColumnRenamed("text", "given")
    back = tokens.decode(ids, keep=("doc_id", "given"))
    return back.select("doc_id", F.length("text").cast("long").alias("n_chars"), (F.col("text") == F.coalesce("given", F.lit(""))).alias("same"))


def p7_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix_report(table(spark, d, "documents"), table(spark, d, "mix_targets"))


def p7_copies(spark: SparkSession, d: str) -> DataFrame:
    """Per source its documents and how many of them have a wrong number of copies: neither floor(rate) nor one more, beyond the cap, or numbered with gaps."""
    docs, targets = table(spark, d, "documents"), table(spark, d, "mix_targets")
    sizes = mixing.sized(docs)
    plan = mixing.mix_report(docs, targets, sizes=sizes).select("source", "rate", "max_repeats")
    got = mixing.mix(docs, targets, sizes=sizes).groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"), F.max("copy_no").alias("last"))
    n = F.coalesce("n", F.lit(0))
    wrong = (n < F.floor("rate")) | (n > F.floor("rate") + 1) | (n > F.col("max_repeats")) | (n != F.coalesce("last", F.lit(0)))
    rows = sizes.join(got, "doc_id", "left").join(F.broadcast(plan), "source")  # one row a source
    return rows.groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(wrong).alias("wrong"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents")).select("doc_id")


def p8_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.found(table(spark, d, "documents")).groupBy("kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_segments").alias("segments"))


def p8_validation(spark: SparkSession, d: str) -> DataFrame:
    """The classifier against the weak labels on hosts it wasn't trained on."""
    return residue.validate(table(spark, d, "documents"))


QUERIES = {f.__name__: f for f in (p1_found, p1_top, p2_found, p2_knn, p4_found, p4_splits, p4_straddling, p4_report, p4_rows, p6_ids, p6_decoded, p7_mix, p7_shares, p7_copies, p8_found, p8_kinds, p8_validation)}

_LATEST = """SELECT chip_id, chip_to_image, chip_ood_max, row_number() OVER (PARTITION BY chip_id ORDER BY scored_at DESC NULLS LAST, arrived_at DESC NULLS LAST, chip_to_image DESC NULLS LAST, chip_ood_max DESC NULLS LAST) AS v FROM chips WHERE chip_id IS NOT NULL"""
_TOP = f"""SELECT chip_to_image, chip_id, chip_ood_max + 0.0::DOUBLE AS chip_ood_max, CAST(row_number() OVER (PARTITION BY chip_to_image ORDER BY chip_ood_max + 0.0::DOUBLE DESC, chip_id) AS INTEGER) AS rank
FROM ({_LATEST}) WHERE v = 1 AND chip_to_image IS NOT NULL AND chip_ood_max IS NOT NULL AND isfinite(chip_ood_max)"""


def _value(c: str) -> str:
    k = sql_key(c)
    return f"CASE WHEN {k} NOT IN ('', 'unknown') THEN {k} END"


#: reachability by repeated spreading of the smallest index over keys and links
_UNITS = f"""WITH RECURSIVE im AS (SELECT DISTINCT image_idx AS i, {_value('source_image_id')} AS s, {_value('sequence_id')} AS q, {sql_key('image_id')} AS k FROM images WHERE image_idx IS NOT NULL),
hubs AS (SELECT i, 's' || s AS h FROM im WHERE s IS NOT NULL UNION SELECT i, 'q' || q FROM im WHERE q IS NOT NULL
 UNION SELECT i, 'k' || k FROM im WHERE k <> ''
 UNION SELECT x.i, 'l' || link_id FROM image_links JOIN im x ON x.k = {sql_key('image_links.image_id')} JOIN im y ON y.k = {sql_key('other_image_id')}
 UNION SELECT y.i, 'l' || link_id FROM image_links JOIN im x ON x.k = {sql_key('image_links.image_id')} JOIN im y ON y.k = {sql_key('other_image_id')}),
least AS (SELECT h, min(i) AS m FROM hubs GROUP BY h),
e AS (SELECT DISTINCT i, m FROM hubs JOIN least USING (h) WHERE i <> m UNION SELECT DISTINCT m, i FROM hubs JOIN least USING (h) WHERE i <> m),
r(i, u) AS (SELECT DISTINCT i, i FROM im UNION SELECT e.m, r.u FROM r JOIN e ON e.i = r.i WHERE e.m > r.u)
SELECT u AS unit_idx, i AS image_idx FROM (SELECT i, min(u) AS u FROM r GROUP BY i) WHERE u <> i"""

#: brute force over all pairs
_VECTORS = """WITH one AS (SELECT vec_id, arg_max(embeddings, extracted_at) AS e FROM embedding_result WHERE vec_id IS NOT NULL AND len(embeddings) = 96 AND list_bool_and(list_transform(embeddings, lambda v: v IS NOT NULL AND isfinite(v))) AND list_bool_or(list_transform(embeddings, lambda v: v <> 0)) GROUP BY vec_id),
v AS (SELECT vec_id, e::DOUBLE[96] AS e FROM one),
p AS (SELECT a.vec_id AS q, b.vec_id AS m, array_cosine_similarity(a.e, b.e) AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id{where}),
t AS (SELECT q, m, s, row_number() OVER (PARTITION BY q ORDER BY s DESC, m) AS r FROM p QUALIFY r <= 5)
"""

SQL = {
    "p2_found": _VECTORS.format(where="") + "SELECT DISTINCT least(q, m) AS vec_id_a, greatest(q, m) AS vec_id_b FROM t WHERE s >= 0.85",
    "p2_knn": _VECTORS.format(where=" AND a.vec_id % 50 = 0") + "SELECT q AS query_id, m AS neighbor_id, CAST(r AS INTEGER) AS rank FROM t",
    "p1_top": f"SELECT * FROM ({_TOP}) WHERE rank <= 5",
    "p1_found": f"SELECT chip_to_image, chip_id FROM ({_TOP}) WHERE rank <= 5",
    "p4_found": _UNITS,
    "p4_straddling": f"WITH RECURSIVE {_UNITS[len('WITH RECURSIVE '):_UNITS.rindex('SELECT u AS unit_idx')]} SELECT u AS unit_idx, CAST(1 AS BIGINT) AS n_splits, count(*) AS n_images FROM (SELECT i, min(u) AS u FROM r GROUP BY i) GROUP BY u",
    "p7_copies": f"SELECT s AS source, count(DISTINCT doc_id) AS documents, CAST(0 AS BIGINT) AS wrong FROM (SELECT doc_id, {sql_key('source')} AS s FROM documents) WHERE s IN (SELECT {sql_key('source')} FROM mix_targets) GROUP BY s",
    "p6_decoded": "SELECT doc_id, CAST(coalesce(length(text), 0) AS BIGINT) AS n_chars, true AS same FROM documents",
}
