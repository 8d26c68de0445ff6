"""Chip streams from per-image records with nested boxes.

A record holds image_path, boxes (array of boxes) and, for all records or none, labels (array), grp, image_id, image_w and
image_h. Facts about the rows are checked by one aggregate before the stream is built.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skewline.functions.boxes import to_xyxy
from skewline.sources.coco import dense_offsets

OPTIONAL = ("labels", "grp", "image_id", "image_w", "image_h")


def annotations(df: DataFrame, image_path: str = "image_path", boxes: str = "boxes", fmt: str = "xyxy", **names: str) -> DataFrame:
    """Records with the standard column names; ``names`` maps optional ones to the columns that hold them, absent ones stay absent."""
    unknown = set(names) - set(OPTIONAL)
    if unknown:
        raise ValueError(f"unknown fields {sorted(unknown)}")
    box = F.transform(F.col(boxes), lambda b: to_xyxy(b, fmt))
    return df.select(F.col(image_path).alias("image_path"), F.coalesce(box, F.array().cast("array<array<double>>")).alias("boxes"), *[F.col(c).alias(n) for n, c in names.items() if c in df.columns])


def validate(records: DataFrame) -> int:
    """Number of boxes. ValueError if there is none, if an optional field is set for some images with boxes only, if labels and boxes differ in number, or if a size isn't positive."""
    has = [c for c in OPTIONAL if c in records.columns]
    some = records.where(F.size("boxes") > 0)
    aggs = [F.count(F.lit(1)).alias("images"), F.sum(F.size("boxes")).alias("boxes"), *[F.count(c).alias(f"n_{c}") for c in has]]
    if "labels" in has:
        aggs.append(F.count_if(F.size("labels") != F.size("boxes")).alias("uneven"))
    sizes = [c for c in ("image_w", "image_h") if c in has]
    aggs += [F.count_if(F.col(c) <= 0).alias(f"flat_{c}") for c in sizes]
    r = some.agg(*aggs).head()
    if not r["boxes"]:
        raise ValueError("no boxes")
    for c in has:
        if r[f"n_{c}"] not in (0, r["images"]):
            raise ValueError(f"{c} must be set for all images or none")
    if "labels" in has and r["uneven"]:
        raise ValueError("as many labels as boxes are needed")
    if any(r[f"flat_{c}"] for c in sizes):
        raise ValueError("image sizes must be positive")
    return r["boxes"]


def chip_stream(records: DataFrame, image_idx: str = "image_idx", class_names: list[str] | None = None, check: bool = True) -> DataFrame:
    """One row per box: chip_idx (dense, by image and place), image_idx, box, and what optional fields there are; object_id is ``image[_class][_group]_ordinal`` within image and class."""
    if check:
        validate(records)
    has = [c for c in OPTIONAL if c in records.columns]
    keep = [c for c in has if c != "labels"]
    d = records.select(image_idx, "image_path", *keep, *(["labels"] if "labels" in has else []), F.posexplode("boxes").alias("place", "box"))
    if "labels" in has:
        d = d.withColumn("label", F.col("labels")[F.col("place")]).drop("labels")
    counts = dense_offsets(records.where(F.size("boxes") > 0).select(F.col(image_idx).alias("image_idx"), F.size("boxes").cast("long").alias("n")))
    d = d.withColumnRenamed(image_idx, "image_idx") if image_idx != "image_idx" else d
    d = d.join(counts.select("image_idx", "before"), "image_idx").withColumn("chip_idx", F.col("before") + F.col("place")).drop("before")
    name = [F.coalesce("image_id", F.col("image_idx").cast("string")) if "image_id" in has else F.col("image_idx").cast("string")]
    by = ["image_idx"]
    if "labels" in has:
        label = F.col("label").cast("string")
        if class_names:
            known = F.array(*[F.lit(n) for n in class_names])
            label = F.when((F.col("label") >= 0) & (F.col("label") < len(class_names)), F.get(known, F.col("label").cast("int"))).otherwise(label)
        name.append(label)
        by.append("label")
    if "grp" in has:
        name.append(F.col("grp"))
    ordinal = (F.row_number().over(Window.partitionBy(*by).orderBy("place")) - 1).cast("string")
    return d.withColumn("object_id", F.concat_ws("_", *name, ordinal))


def sample_descriptor(stream: DataFrame, index: int, class_names: list[str] | None = None) -> dict:
    """What there is of one chip: its numbers, path, ids, box, size, label with its name, and group. An unknown index is an IndexError."""
    rows = stream.where(F.col("chip_idx") == index).limit(1).collect()
    if not rows:
        raise IndexError(index)
    r = rows[0].asDict()
    out = {"index": r["chip_idx"], "image_index": r["image_idx"], "image_path": r["image_path"], "image_id": r.get("image_id") or str(r["image_idx"]), "object_id": r["object_id"], "box_xyxy": list(r["box"])}
    if "image_w" in r:
        out["image_size"] = [r["image_w"], r["image_h"]]
    if "label" in r:
        out["label"] = r["label"]
        if class_names and 0 <= r["label"] < len(class_names):
            out["class_name"] = class_names[r["label"]]
    if "grp" in r:
        out["group"] = r["grp"]
    return out
