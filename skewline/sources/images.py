"""Image files, feature extraction and detection with pluggable models.

No deep-learning library is needed here: a model is any object (made by a factory on the executor) that maps a batch of
NumPy arrays to arrays. Presets give the dimension of known backbones.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions.boxes import crop_pixels
from skewline.session import cut, folders, is_folder
from skewline.sources import saved


@dataclass(frozen=True)
class Backbone:
    """A public model's name and the width of its embeddings."""

    model_id: str
    dim: int


#: fixed values: public model names and their widths
PRESETS = {
    "dinov2-small": Backbone("facebook/dinov2-small", 384),
    "dinov2-base": Backbone("facebook/dinov2-base", 768),
    "dinov2-large": Backbone("facebook/dinov2-large", 1024),
    "dinov3-small": Backbone("facebook/dinov3-vits16-pretrain-lvd1689m", 384),
    "dinov3-base": Backbone("facebook/dinov3-vitb16-pretrain-lvd1689m", 768),
    "dinov3-large": Backbone("facebook/dinov3-vitl16-pretrain-lvd1689m", 1024),
}
_MODELS: dict[str, Callable[[], Callable]] = {}


def register_model(name: str, factory: Callable[[], Callable]) -> None:
    """Registers a factory of a model: bytes or arrays of a batch -> (embeddings, logits or None)."""
    _MODELS[name] = factory


def model_factory(name: str) -> Callable[[], Callable]:
    if name in _MODELS:
        return _MODELS[name]
    try:
        import torch  # noqa: F401
        import transformers  # noqa: F401
    except ImportError as e:
        raise ImportError(f"{name!r} isn't registered, and torch and transformers aren't installed") from e
    return lambda: _hub_model(PRESETS[name].model_id if name in PRESETS else name)


def _hub_model(model_id: str) -> Callable:
    import io

    import torch
    from PIL import Image
    from transformers import AutoImageProcessor, AutoModel

    net, proc = AutoModel.from_pretrained(model_id).eval(), AutoImageProcessor.from_pretrained(model_id)

    def run(batch: list[bytes]) -> tuple[np.ndarray, None]:
        with torch.no_grad():
            out = net(**proc([Image.open(io.BytesIO(x)).convert("RGB") for x in batch], return_tensors="pt"))
        return out.last_hidden_state[:, 0].numpy(), None

    return run


def image_folder(spark: SparkSession, root: str) -> DataFrame:
    """path, content, label (number of the parent folder's name in sorted order), class_name."""
    if not isinstance(root, str) or not is_folder(spark, root):
        raise TypeError("an image folder is a path to a folder")
    names = folders(spark, root)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    table = spark.createDataFrame(list(enumerate(names)), "label int, class_name string")
    return files.withColumn("class_name", F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)).join(F.broadcast(table), "class_name")


def extract(df: DataFrame, factory: Callable[[], Callable], content: str = "content", keep: tuple[str, ...] = (), batch: int = 64) -> DataFrame:
    """keep, embeddings, logits (null without a head): the model is made once a task and fed in batches."""
    src = df.select(*keep, F.col(content).alias("_content"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            for a in range(0, b.num_rows, batch):
                part = b.slice(a, batch)
                emb, logits = model(part.column(len(keep)).to_pylist())
                cols = [part.column(i) for i in range(len(keep))]
                cols.append(pa.array([np.asarray(x, np.float32) for x in emb], pa.list_(pa.float32())))
                cols.append(pa.array([None if logits is None else np.asarray(logits[i], np.float32) for i in range(part.num_rows)], pa.list_(pa.float32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*keep, "embeddings", "logits"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[:-1]]
    return src.mapInArrow(run, ", ".join([*fields, "embeddings array<float>", "logits array<float>"]))


def train_head(df: DataFrame, embedding: str = "embeddings", label: str = "label", reg: float = 1e-4, max_iter: int = 200) -> tuple[np.ndarray, np.ndarray]:
    """(W, b) of a linear head on frozen embeddings: multinomial logistic regression. Fewer than two classes are a ValueError."""
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.functions import array_to_vector

    if df.select(label).distinct().limit(2).count() < 2:
        raise ValueError("at least two classes are needed")
    d = df.select(array_to_vector(F.col(embedding).cast("array<double>")).alias("x"), F.col(label).cast("double").alias("y"))
    m = LogisticRegression(featuresCol="x", labelCol="y", family="multinomial", regParam=reg, maxIter=max_iter, standardization=False).fit(d)
    return m.coefficientMatrix.toArray(), m.interceptVector.toArray()


def apply_head(df: DataFrame, W: np.ndarray, b: np.ndarray, embedding: str = "embeddings", out: str = "logits") -> DataFrame:
    from skewline.functions.vectors import rowwise

    W, b = np.asarray(W, float), np.asarray(b, float)
    return df.withColumn(out, rowwise(lambda x: x @ W.T + b, "array<double>")(F.col(embedding)))


class Embedder:
    """Embeddings, and logits once a head is fitted, of rows with image contents.

    ``fit`` takes mode ``none`` (nothing is trained), ``head`` (a linear head on frozen embeddings) or ``full``, for which
    the backbone's own ``tune`` function makes a tuned model's factory before the head is fitted. Labels are looked for in a
    column ``label``; chip columns (``chip_to_image``, ``boxes``, ``object_ids``, ``grp``, ``image_ids``, ``image_sizes``)
    are carried along where they are.
    """

    MODES = ("none", "head", "full")
    CHIP = ("chip_to_image", "boxes", "object_ids", "grp", "image_ids", "image_sizes")

    def __init__(self, backbone: str = "dinov2-small", tune: Callable[[DataFrame], str] | None = None):
        if backbone not in PRESETS and backbone not in _MODELS:
            raise ValueError(f"unknown backbone {backbone!r}: one of {sorted({*PRESETS, *_MODELS})}")
        self.backbone, self.tune, self.head, self.mode = backbone, tune, None, "none"

    def fit(self, df: DataFrame, mode: str = "none", **options) -> Embedder:
        if mode not in self.MODES:
            raise ValueError(f"mode must be one of {self.MODES}")
        if mode != "none":
            if "label" not in df.columns:
                raise ValueError("labels are needed: a column label")
            if mode == "full":
                if self.tune is None:
                    raise ValueError("mode full needs a tune function, which trains the backbone and registers the result")
                self.backbone = self.tune(df)
            named = "class_name" in df.columns
            e = cut(extract(df.where("label is not null"), model_factory(self.backbone), keep=("label",)), "head-embeddings")
            W, b = train_head(e, label="label", **options)
            names = [r["class_name"] for r in df.groupBy("label").agg(F.min("class_name").alias("class_name")).where("label is not null").orderBy("label").collect()] if named else []  # one row a class
            self.head = saved.Head(W, b, tuple(names))
        self.mode = mode
        return self

    def extract(self, df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
        """The kept, label and chip columns, embeddings, and logits (null without a head)."""
        self.check_chips(df)
        have = [c for c in ("label", *self.CHIP) if c in df.columns and c not in keep]
        out = extract(df, model_factory(self.backbone), keep=(*keep, *have))
        return apply_head(out, self.head.W, self.head.b) if self.head else out

    def fit_extract(self, df: DataFrame, mode: str = "none", keep: tuple[str, ...] = (), **options) -> DataFrame:
        return self.fit(df, mode, **options).extract(df, keep)

    @classmethod
    def check_chips(cls, df: DataFrame) -> bool:
        """Whether the rows are chips. Boxes without images or the other way round, boxes that haven't four numbers, and sizes that aren't two positive ones are ValueErrors."""
        has = [c for c in ("chip_to_image", "boxes") if c in df.columns]
        if not has:
            return False
        if len(has) == 1:
            raise ValueError("chips need chip_to_image and boxes")
        bad = F.col("chip_to_image").isNull() | (F.size("boxes") != 4)
        if "image_sizes" in df.columns:
            bad = bad | (F.size("image_sizes") != 2) | F.exists("image_sizes", lambda v: v <= 0)
        if df.where(F.coalesce(bad, F.lit(True))).limit(1).count():
            raise ValueError("a chip needs an image, a box of four numbers and, if given, a positive size")
        return True

    def save(self, spark: SparkSession, path: str) -> None:
        """Name of the backbone, mode and head; a tuned backbone is kept by whoever registered it."""
        tune, self.tune = self.tune, None
        try:
            saved.save(spark, self, path)
        finally:
            self.tune = tune

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Embedder:
        obj = saved.load(spark, path)
        if not isinstance(obj, cls):
            raise ValueError(f"{path} holds no embedder")
        return obj


def crop_chips(df: DataFrame, region: str = "region", pixels: str = "pixels", height: str = "image_h", width: str = "image_w", channels: int = 3, keep: tuple[str, ...] = ()) -> DataFrame:
    """keep, side and chip (bytes, zero-padded) of each row's region of its image, given as bytes in rows of pixels. An image whose bytes don't fit its sides is an error."""
    src = df.select(*keep, F.col(pixels).alias("_p"), F.col(height).cast("long").alias("_h"), F.col(width).cast("long").alias("_w"), F.col(region).cast("array<long>").alias("_r"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keep)
        for b in batches:
            sides, chips = [], []
            for p, h, w, r in zip(*(b.column(n + i).to_pylist() for i in range(4))):
                if p is None or r is None:
                    sides.append(None)
                    chips.append(None)
                    continue
                chip = crop_pixels(np.frombuffer(p, np.uint8).reshape(h, w, channels), r)
                sides.append(chip.shape[0])
                chips.append(chip.tobytes())
            yield pa.RecordBatch.from_arrays([b.column(i) for i in range(n)] + [pa.array(sides, pa.int32()), pa.array(chips, pa.binary())], names=[*keep, "side", "chip"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in src.schema.fields[: len(keep)]]
    return src.mapInArrow(run, ", ".join([*fields, "side int, chip binary"]))


def detect(df: DataFrame, factory: Callable[[], Callable], image_order: str, content: str = "content", threshold: float = 0.25, names: dict[str, int] | None = None, detector_name: str | None = None) -> DataFrame:
    """Rows of a detector: image_id, class_id, class_name, bbox, confidence, detection_id.

    A model maps a list of contents to lists of (box, label, class name, confidence). Rows below the threshold are dropped; names given are mapped to
    their ids, else the model's label stays. Ids count through the images in order.
    """
    from skewline.sources.coco import dense_offsets

    src = df.select(F.col(image_order).cast("long").alias("o"), "image_id", F.col(content).alias("c"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = factory()
        for b in batches:
            rows = []
            for o, i, found in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), model(b.column(2).to_pylist())):
                kept = [f for f in found if f[3] >= threshold]
                rows += [(o, i, n, (names or {}).get(f[2], f[1]), f[2], [float(v) for v in f[0]], float(f[3])) for n, f in enumerate(kept)]
            kinds = (pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.float64()), pa.float64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(kinds)], names=["image_idx", "image_id", "n_in_image", "class_id", "class_name", "bbox", "confidence"])

    d = src.withColumn("image_id", F.col("image_id").cast("string")).mapInArrow(run, "image_idx long, image_id string, n_in_image int, class_id int, class_name string, bbox array<double>, confidence double")
    d = cut(d, "detected")  # the offsets and the join read it: the model runs once
    before = dense_offsets(d.groupBy("image_idx").agg(F.count(F.lit(1)).alias("n"))).select("image_idx", "before")
    num = F.col("before") + F.col("n_in_image")
    return d.join(before, "image_idx").select("image_id", "class_id", "class_name", "bbox", "confidence", F.concat_ws("_det_", "image_id", num.cast("string")).alias("detection_id"), F.lit(detector_name).cast("string").alias("detector_name"))
