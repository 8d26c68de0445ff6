"""Synset tables and image folders of the ImageNet layout."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_LINE = re.compile(r"^(n\d{8})\s*(.*)$")


def synsets(spark: SparkSession, path: str) -> DataFrame:
    """wnid, class_id, class_name from a text file (``wnid name`` lines; blank and # lines are skipped).

    Bad lines, repeated and unsorted ids are ValueErrors. The file is a dimension of a few thousand lines.
    """
    rows = []
    for line in spark.read.text(path, wholetext=True).head()["value"].splitlines():
        line = line.strip()
        if not line or line.startswith("#"):
            continue
        m = _LINE.match(line)
        if not m:
            raise ValueError(f"not a synset line: {line!r}")
        rows.append((m[1], m[2].strip() or m[1]))
    ids = [r[0] for r in rows]
    if len(set(ids)) != len(ids):
        raise ValueError("synset ids repeat")
    if ids != sorted(ids):
        raise ValueError("synset ids must be sorted")
    return spark.createDataFrame([(w, i, n) for i, (w, n) in enumerate(rows)], "wnid string, class_id int, class_name string")


def image_paths(spark: SparkSession, root: str) -> DataFrame:
    """path, folder of the files one folder deep: a listing, contents aren't read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.{jpg,jpeg,png,JPEG,JPG,PNG}").load(root).select("path")
    return files.withColumn("folder", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1))


def validate_root(folders: DataFrame, table: DataFrame) -> DataFrame:
    """wnid, status: present, missing (in the table only) or unknown (a folder only)."""
    f = folders.select(F.col("folder").alias("wnid")).distinct()
    t = table.select("wnid")
    return f.join(t, "wnid").withColumn("status", F.lit("present")).unionByName(t.join(f, "wnid", "left_anti").withColumn("status", F.lit("missing"))).unionByName(f.join(t, "wnid", "left_anti").withColumn("status", F.lit("unknown")))


def variant_dataset(spark: SparkSession, root: str, table: DataFrame, strict: bool = True) -> DataFrame:
    """path, wnid, class_id, class_name. A folder that isn't a known synset is a ValueError, or left out if not strict."""
    paths = image_paths(spark, root).withColumnRenamed("folder", "wnid")
    if strict:
        odd = paths.join(F.broadcast(table), "wnid", "left_anti").select("wnid").distinct().limit(3).collect()
        if odd:
            raise ValueError(f"unknown synset folders: {[r['wnid'] for r in odd]}")
    return paths.join(F.broadcast(table), "wnid")
