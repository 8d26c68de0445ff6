"""Embedding stores: a folder with a manifest and npy files, read as a Spark data source and written from a table."""

from __future__ import annotations

import json
import os

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

from skewline.operators.masks import hash_key
from skewline.operators.ranks import first_by_hash

ARRAYS = {"embeddings": "array<float>", "logits": "array<float>", "boxes": "array<double>", "image_sizes": "array<double>"}
SCALARS = {"labels": "bigint", "chip_to_image": "bigint"}
LISTS = ("image_paths", "object_ids", "group", "image_ids")


class _Rows(InputPartition):
    def __init__(self, start: int, stop: int):
        self.start, self.stop = start, stop


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: StructType, rows: int):
        self.path, self.schema, self.rows = path, schema, rows

    def partitions(self):
        n = len(np.load(os.path.join(self.path, "embeddings.npy"), mmap_mode="r"))
        return [_Rows(a, min(n, a + self.rows)) for a in range(0, n, self.rows)] or [_Rows(0, 0)]

    def read(self, part):
        import pyarrow as pa

        cols = [pa.array(np.arange(part.start, part.stop), pa.int64())]
        for f in self.schema.fields[1:]:
            npy = os.path.join(self.path, f"{f.name}.npy")
            if f.name in LISTS:
                with open(os.path.join(self.path, f"{f.name}.json")) as h:
                    cols.append(pa.array([None if x is None else str(x) for x in json.load(h)[part.start : part.stop]], pa.string()))
                continue
            m = np.asarray(np.load(npy, mmap_mode="r")[part.start : part.stop])
            if f.name in SCALARS:
                cols.append(pa.array(m.astype(np.int64)))
            else:
                kind = np.float32 if "float" in f.dataType.simpleString() else np.float64
                w = m.shape[1]
                cols.append(pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * w), pa.array(m.astype(kind).ravel())))
        yield pa.RecordBatch.from_arrays(cols, names=[f.name for f in self.schema.fields])


class EmbeddingStore(DataSource):
    """``spark.read.format("embedding_store").option("path", folder)``; partitions are row ranges of memory-mapped files."""

    @classmethod
    def name(cls) -> str:
        return "embedding_store"

    def schema(self) -> str:
        path = self.options["path"]
        with open(os.path.join(path, "manifest.json")) as h:
            has = json.load(h)
        cols = ["sample_id bigint", "embeddings array<float>"]
        cols += [f"{n} {t}" for n, t in {**ARRAYS, **SCALARS}.items() if n != "embeddings" and has.get(f"has_{n}")]
        cols += [f"`{n}` string" for n in LISTS if has.get(f"has_{n}") and os.path.exists(os.path.join(path, f"{n}.json"))]
        return ", ".join(cols)

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], schema, int(self.options.get("rows", 65536)))


def load(spark: SparkSession, path: str, frac: float = 1.0, seed: int | None = None) -> DataFrame:
    """The store's rows; with ``frac`` below 1 exactly max(1, int(n * frac)) of them, drawn without replacement."""
    if not 0 < frac <= 1:
        raise ValueError("frac must be in (0, 1]")
    spark.dataSource.register(EmbeddingStore)
    df = spark.read.format("embedding_store").option("path", path).load()
    if frac == 1:
        return df
    n = len(np.load(os.path.join(path, "embeddings.npy"), mmap_mode="r"))
    picked = first_by_hash(spark.range(n).withColumnRenamed("id", "sample_id"), "sample_id", max(1, int(n * frac)), hash_key(0 if seed is None else seed, F.col("sample_id")))
    return df.join(picked, "sample_id", "left_semi")


def save_npy(df: DataFrame, path: str, order: str = "sample_id") -> None:
    """Writes a table as such a store, row by row through the driver into memory-mapped files: memory stays at one partition."""
    os.makedirs(path, exist_ok=True)
    n, first = df.count(), df.head()
    cols = [c for c in df.columns if c in ARRAYS or c in SCALARS]
    maps = {}
    for c in cols:
        shape = (n, len(first[c])) if c in ARRAYS else (n,)
        kind = np.int64 if c in SCALARS else np.float32 if "float" in ARRAYS[c] else np.float64
        maps[c] = np.lib.format.open_memmap(os.path.join(path, f"{c}.npy"), mode="w+", dtype=kind, shape=shape)
    lists: dict[str, list] = {c: [] for c in df.columns if c in LISTS}
    for i, r in enumerate(df.orderBy(order).toLocalIterator()):
        for c in cols:
            maps[c][i] = r[c]
        for c in lists:
            lists[c].append(r[c])
    for m in maps.values():
        m.flush()
    for c, v in lists.items():
        with open(os.path.join(path, f"{c}.json"), "w") as h:
            json.dump(v, h)
    with open(os.path.join(path, "manifest.json"), "w") as h:
        json.dump({"n": n, **{f"has_{c}": True for c in [*cols, *lists]}}, h)


def save(df: DataFrame, path: str) -> None:
    """The native form: Parquet."""
    df.write.mode("overwrite").parquet(path)
