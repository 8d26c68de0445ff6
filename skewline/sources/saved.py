"""Saving and loading of what was fitted: detectors, heads, poolers, failure models.

A folder holds the state as one JSON document and tables (a bank of vectors, statistics by class) as Parquet, fitted Spark stages in their own form, written and
read through Spark, so any file system that the cluster knows will do. Only classes of this package are made on loading.
"""

from __future__ import annotations

import base64
import importlib
import json
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, Row, SparkSession

PACKAGE = __name__.split(".")[0]


@dataclass
class Head:
    """A linear head: logits = x W' + b."""

    W: np.ndarray
    b: np.ndarray
    names: tuple[str, ...] = ()


def save(spark: SparkSession, obj: Any, path: str) -> None:
    """Writes an object of this package with all that was fitted; what is there is replaced."""
    tables: dict[str, Any] = {}
    state = _out(obj, tables)
    for name, t in tables.items():
        if isinstance(t, DataFrame):
            t.write.mode("overwrite").parquet(f"{path}/{name}")
        else:
            t.write().overwrite().save(f"{path}/{name}")
    spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/state")


def load(spark: SparkSession, path: str) -> Any:
    """The object that was saved. A folder of something else is a ValueError."""
    rows = spark.read.text(f"{path}/state", wholetext=True).head(1)
    if not rows:
        raise ValueError(f"nothing is saved in {path}")
    return _in(json.loads(rows[0]["value"]), spark, path)


def _out(x: Any, tables: dict[str, Any]) -> Any:
    if x is None or isinstance(x, (bool, int, float, str)):
        return x
    if isinstance(x, np.generic):
        return x.item()
    if isinstance(x, np.ndarray):
        return {"array": base64.b64encode(np.ascontiguousarray(x).tobytes()).decode(), "dtype": x.dtype.str, "shape": x.shape}
    if isinstance(x, DataFrame):
        name = f"table{len(tables)}"
        tables[name] = x
        return {"table": name}
    if isinstance(x, Row):
        x = x.asDict()
    if isinstance(x, dict):
        return {"dict": [[_out(k, tables), _out(v, tables)] for k, v in x.items()]}
    if isinstance(x, (list, tuple)):
        return {"list" if isinstance(x, list) else "tuple": [_out(v, tables) for v in x]}
    kind = type(x)
    if kind.__module__.startswith("pyspark.ml.") and hasattr(x, "write"):
        name = f"stage{len(tables)}"
        tables[name] = x
        return {"stage": name, "of": f"{kind.__module__}:{kind.__qualname__}"}
    if kind.__module__.split(".")[0] != PACKAGE:
        raise ValueError(f"can't save a {kind.__name__}")
    return {"class": f"{kind.__module__}:{kind.__qualname__}", "state": {k: _out(v, tables) for k, v in vars(x).items()}}


def _in(x: Any, spark: SparkSession, path: str) -> Any:
    if not isinstance(x, dict):
        return x
    if "array" in x:
        return np.frombuffer(base64.b64decode(x["array"]), np.dtype(x["dtype"])).reshape(x["shape"]).copy()
    if "table" in x:
        return spark.read.parquet(f"{path}/{x['table']}")
    if "stage" in x:
        module, _, name = x["of"].partition(":")
        if not module.startswith("pyspark.ml.") or "." in name:
            raise ValueError(f"can't load a {name}")
        return getattr(importlib.import_module(module), name).load(f"{path}/{x['stage']}")
    if "dict" in x:
        return {_in(k, spark, path): _in(v, spark, path) for k, v in x["dict"]}
    if "list" in x or "tuple" in x:
        return [_in(v, spark, path) for v in x["list"]] if "list" in x else tuple(_in(v, spark, path) for v in x["tuple"])
    module, _, name = x.get("class", "").partition(":")
    if module.split(".")[0] != PACKAGE or "." in name:
        raise ValueError(f"can't load a {name or 'document of this form'}")
    kind = getattr(importlib.import_module(module), name)
    obj = kind.__new__(kind)
    for k, v in x["state"].items():
        object.__setattr__(obj, k, _in(v, spark, path))
    return obj
