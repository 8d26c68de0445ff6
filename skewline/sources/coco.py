"""COCO annotation files as tables, with their category table and the discovery of data sets on disk."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from skewline.functions.boxes import both_sides_at_least, to_xyxy
from skewline.operators.combine import dense_ids
from skewline.session import exists, folders

SCHEMA = """images array<struct<id long, file_name string, width double, height double>>,
annotations array<struct<id long, image_id long, category_id long, bbox array<double>, iscrowd int>>,
categories array<struct<id long, name string>>"""


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per file with ``path``; one file is one JSON object. The schema is fixed, so nothing is inferred."""
    return spark.read.schema(SCHEMA).option("multiLine", True).json(path).withColumn("path", F.input_file_name())


def categories(raw: DataFrame) -> DataFrame:
    """category_id, class_id (dense, by ascending id), class_name. An id with two names is a ValueError."""
    c = raw.select(F.explode("categories").alias("c")).select(F.col("c.id").alias("category_id"), F.col("c.name").alias("class_name")).distinct()
    twice = c.groupBy("category_id").count().where("count > 1").limit(1).collect()
    if twice:
        raise ValueError(f"category {twice[0]['category_id']} has several names")
    return c.withColumn("class_id", (F.row_number().over(Window.orderBy("category_id")) - 1).cast("int"))  # a few thousand rows at most


def check_same_categories(tables: list[DataFrame]) -> DataFrame:
    """The first table, if all are equal to it; else a ValueError."""
    if not tables:
        raise ValueError("no category tables")
    for t in tables[1:]:
        if not tables[0].exceptAll(t.select(tables[0].columns)).isEmpty() or not t.select(tables[0].columns).exceptAll(tables[0]).isEmpty():
            raise ValueError("the category tables differ")
    return tables[0]


def images(raw: DataFrame, image_root: str) -> DataFrame:
    """image_idx (order of the file), image_id (stem), source_id, image_path, image_w, image_h; of repeated ids the last counts."""
    i = raw.select(F.posexplode("images").alias("pos", "i"))
    i = i.groupBy(F.col("i.id").alias("source_id")).agg(F.max_by("i", "pos").alias("i"), F.min("pos").alias("pos"))
    stem = F.regexp_extract(F.col("i.file_name"), r"([^/]+?)(?:\.[^./]*)?$", 1)
    d = i.select("source_id", "pos", F.lit(0).alias("one"), stem.alias("image_id"), F.concat(F.lit(image_root.rstrip("/") + "/"), F.col("i.file_name")).alias("image_path"), F.col("i.width").alias("image_w"), F.col("i.height").alias("image_h"))
    return dense_ids(d, ["one", "pos"], "image_idx").drop("one", "pos")


def boxes(raw: DataFrame, cats: DataFrame, min_side: float = 0) -> DataFrame:
    """source_id, ann_pos, box (xyxy), class_id, class_name of the usable annotations: no crowds, four numbers, both sides at least ``min_side``. An unknown category is an error at run time."""
    a = raw.select(F.posexplode("annotations").alias("ann_pos", "a"))
    a = a.where((F.coalesce("a.iscrowd", F.lit(0)) == 0) & (F.size("a.bbox") == 4))
    a = a.select("ann_pos", F.col("a.image_id").alias("source_id"), F.col("a.category_id").alias("category_id"), to_xyxy(F.col("a.bbox"), "xywh").alias("box"))
    if min_side > 0:
        a = a.where(both_sides_at_least(F.col("box"), min_side))
    j = a.join(F.broadcast(cats), "category_id", "left")
    return j.withColumn("class_id", F.coalesce("class_id", F.raise_error(F.concat(F.lit("unknown category "), F.col("category_id").cast("string")))))


def load(spark: SparkSession, path: str, image_root: str, group: str | None = None, cats: DataFrame | None = None, include_empty: bool = False, min_side: float = 0) -> DataFrame:
    """One row per box: image_idx, chip_pos, image_id, image_path, image_w, image_h, box, class_id, class_name, grp. With ``include_empty`` images without boxes have one row with a null box."""
    raw = read(spark, path)
    cats = categories(raw) if cats is None else cats
    j = images(raw, image_root).join(boxes(raw, cats, min_side), "source_id", "left" if include_empty else "inner")
    return j.select("image_idx", F.col("ann_pos").alias("chip_pos"), "image_id", "image_path", "image_w", "image_h", "box", "class_id", "class_name", F.lit(group).cast("string").alias("grp"))


def chip_table(rows: DataFrame) -> DataFrame:
    """The chip stream: dense chip_idx over (image, annotation) and object_id ``image_class_group_ordinal``. No boxes at all is a ValueError."""
    r = rows.where("box is not null")
    if r.isEmpty():
        raise ValueError("no usable annotations")
    w = Window.partitionBy("image_idx", "class_id").orderBy("chip_pos")
    counts = r.groupBy("image_idx").agg(F.count(F.lit(1)).alias("n"))
    counts = dense_offsets(counts)
    d = r.join(counts, "image_idx").withColumn("chip_idx", (F.col("before") + F.row_number().over(Window.partitionBy("image_idx").orderBy("chip_pos")) - 1).cast("long")).drop("before", "n")
    name = F.coalesce("class_name", F.col("class_id").cast("string"))
    return d.withColumn("object_id", F.concat_ws("_", "image_id", name, "grp", (F.row_number().over(w) - 1).cast("string")))


def dense_offsets(counts: DataFrame, slices: int = 64) -> DataFrame:
    """image_idx, n, before: rows of the images before each, by ranges of the image index."""
    cuts = counts.agg(F.percentile_approx("image_idx", F.array(*[F.lit(i / slices) for i in range(1, slices)])).alias("cuts"))
    c = counts.join(F.broadcast(cuts)).withColumn("s", F.size(F.filter("cuts", lambda x: x <= F.col("image_idx")))).drop("cuts")
    tops = c.groupBy("s").agg(F.sum("n").alias("t"))
    zero = F.lit(0).cast("long")
    tops = tops.select("s", F.coalesce(F.sum("t").over(Window.orderBy("s").rowsBetween(Window.unboundedPreceding, -1)), zero).alias("base"))
    own = F.coalesce(F.sum("n").over(Window.partitionBy("s").orderBy("image_idx").rowsBetween(Window.unboundedPreceding, -1)), zero)
    return c.join(F.broadcast(tops), "s").select("image_idx", "n", (F.col("base") + own).alias("before"))


def tables(raw: DataFrame, cats: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(images, ground truth) flat: image_id, file_name, image_width, image_height; gt_id, image_id, class_id, class_name, bbox (xyxy) of the boxes with positive sides that are no crowds."""
    cats = categories(raw) if cats is None else cats
    stem = F.regexp_extract("i.file_name", r"([^/]+?)(?:\.[^./]*)?$", 1)
    pics = raw.select(F.explode("images").alias("i")).select(F.col("i.id").alias("source_id"), stem.alias("image_id"), F.col("i.file_name").alias("file_name"), F.col("i.width").alias("image_width"), F.col("i.height").alias("image_height")).dropDuplicates(["source_id"])
    a = raw.select(F.explode("annotations").alias("a")).where((F.coalesce("a.iscrowd", F.lit(0)) == 0) & (F.size("a.bbox") == 4)).where("a.bbox[2] > 0 and a.bbox[3] > 0")
    a = a.select(F.col("a.id").cast("string").alias("gt_id"), F.col("a.image_id").alias("source_id"), F.col("a.category_id").alias("category_id"), to_xyxy(F.col("a.bbox"), "xywh").alias("bbox"))
    gt = a.join(F.broadcast(cats), "category_id").join(pics.select("source_id", "image_id"), "source_id")
    return pics.drop("source_id"), gt.select("gt_id", "image_id", "class_id", "class_name", "bbox")


@dataclass(frozen=True)
class CocoPaths:
    """Annotation file and image folder of one data set."""

    name: str
    annotations: str
    images: str


def discover_id(spark: SparkSession, root: str, split: str = "val2017") -> CocoPaths:
    """``annotations/instances_<split>.json`` and ``<split>/`` under a root; FileNotFoundError if one is missing."""
    a, i = f"{root}/annotations/instances_{split}.json", f"{root}/{split}"
    for p in (a, i):
        if not exists(spark, p):
            raise FileNotFoundError(p)
    return CocoPaths(split, a, i)


def discover_ood(spark: SparkSession, root: str, only: list[str] | None = None, split: str = "val2017") -> list[CocoPaths]:
    """The domains under a root. With ``only`` their order stays and an incomplete one is an error; else they are sorted and incomplete ones are left out."""
    found = []
    for name in only if only is not None else folders(spark, root):
        try:
            p = discover_id(spark, f"{root}/{name}", split)
            found.append(CocoPaths(name, p.annotations, p.images))
        except FileNotFoundError:
            if only is not None:
                raise
    return found


def load_domains(spark: SparkSession, paths: list[CocoPaths], **kw) -> DataFrame:
    """All domains in one table, each with its name as group; category tables must agree."""
    cats = check_same_categories([categories(read(spark, p.annotations)) for p in paths])
    parts = [load(spark, p.annotations, p.images, group=p.name, cats=cats, **kw).withColumn("block", F.lit(i)) for i, p in enumerate(paths)]
    return reduce(DataFrame.unionByName, parts)
