"""Tables of driving-scene label records, from the flattened JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions.keys import eq_key
from skewline.operators.nested import flatten

#: fixed values: the usual detection classes, in their order
CLASSES = ("person", "rider", "car", "truck", "bus", "train", "motor", "bike", "traffic light", "traffic sign")
#: the class table is broadcast: more categories than these are refused rather than cut
MAX_CLASSES = 10_000


def class_table(spark: SparkSession, seen: DataFrame | None = None, name: str = "category") -> DataFrame:
    """class_id, class_name: the usual classes in their order, then what else is seen, sorted."""
    names = list(CLASSES)
    if seen is not None:
        rest = seen.select(name).where(F.col(name).isNotNull()).distinct().limit(MAX_CLASSES + 1).collect()
        if len(rest) > MAX_CLASSES:
            raise ValueError(f"more than {MAX_CLASSES} categories")
        names += sorted({r[name] for r in rest} - set(names))
    return spark.createDataFrame(list(enumerate(names)), "class_id int, class_name string")


def chip_annotations(raw: DataFrame, classes: DataFrame, min_side: float = 0) -> DataFrame:
    """record_id, obj_path, class_id, class_name, box of the usable boxes of known categories whose shorter side is long enough."""
    boxes = flatten(raw, "labelled").dropDuplicates(["record_id", "obj_path"])
    j = boxes.join(F.broadcast(classes), F.col("category") == F.col("class_name"))  # at most MAX_CLASSES rows
    side = F.least(F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1"))
    return j.where(side >= float(min_side)).select("record_id", "obj_path", "class_id", "class_name", F.array("x1", "y1", "x2", "y2").alias("box"))


def attributes(raw: DataFrame) -> DataFrame:
    """record_id, image_id (stem of the name), weather, scene, timeofday, bdd_partition."""
    r = flatten(raw, "records").dropDuplicates(["record_id"])
    return r.select("record_id", F.regexp_replace("name", r"\.[^.]*$", "").alias("image_id"), "weather", "scene", "timeofday", partition(F.col("weather"), F.col("timeofday")).alias("bdd_partition"))


def partition(weather: Column, timeofday: Column) -> Column:
    """reference for clear days, else shifted."""
    return F.when((eq_key(weather) == "clear") & (eq_key(timeofday) == "daytime"), "reference").otherwise("shifted")
