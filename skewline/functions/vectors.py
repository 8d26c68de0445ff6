"""Column expressions on logits (JVM side) and Arrow functions on long vectors.

Logits have as many entries as there are classes: higher-order functions do. Work that is quadratic in the dimension
runs as NumPy over whole Arrow batches.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.functions import arrow_udf


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def doubles(c: Column) -> Column:
    return c.cast("array<double>")


def scaled(z: Column, temperature: float) -> Column:
    z = doubles(z)
    return z if temperature == 1 else F.transform(z, lambda v: v / F.lit(float(temperature)))


def exp_mass(z: Column) -> Column:
    """Sum of exp(z - max z)."""
    m = F.array_max(z)
    return _sum(F.transform(z, lambda v: F.exp(v - m)))


def logsumexp(z: Column) -> Column:
    return F.array_max(z) + F.log(exp_mass(z))


def max_softmax(z: Column) -> Column:
    return F.lit(1.0) / exp_mass(z)


def softmax(z: Column) -> Column:
    m, total = F.array_max(z), exp_mass(z)
    return F.transform(z, lambda v: F.exp(v - m) / total)


def argmax(z: Column) -> Column:
    """Place of the first greatest entry, from 0."""
    return (F.array_position(z, F.array_max(z)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def norm(a: Column) -> Column:
    return F.sqrt(_sum(F.transform(doubles(a), lambda v: v * v)))


def row_normalize(a: Column, eps: float = 1e-12) -> Column:
    n = F.greatest(norm(a), F.lit(float(eps)))
    return F.transform(doubles(a), lambda v: v / n)


def to_matrix(a: pa.Array) -> np.ndarray:
    """(rows, width) of a list column without nulls; ValueError if the rows differ in length."""
    if isinstance(a, pa.ChunkedArray):
        a = a.combine_chunks()
    n = len(a)
    flat = a.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    if n == 0:
        return np.zeros((0, 0))
    if a.null_count or len(flat) % n or (np.diff(a.offsets.to_numpy()) != len(flat) // n).any():
        raise ValueError("vectors must not be null and must have one length")
    return flat.reshape(n, -1)


def rowwise(fn: Callable[..., np.ndarray], kind: str = "double") -> Callable[..., Column]:
    """A Column function that maps matrices (one per column) to one value per row, batch by batch."""

    @arrow_udf(kind)
    def run(*cols: pa.Array) -> pa.Array:
        mats = [to_matrix(c) for c in cols]
        out = fn(*mats) if len(cols[0]) else np.zeros(0)
        if kind == "double":
            return pa.array(np.asarray(out, np.float64), pa.float64())
        out = np.asarray(out, np.float64)
        w = out.shape[1] if out.ndim == 2 else 0
        return pa.ListArray.from_arrays(pa.array(np.arange(len(out) + 1, dtype=np.int32) * w), pa.array(out.ravel(), pa.float64()))

    return lambda *cs: run(*[doubles(c) for c in cs])


def sql_softmax_mass(z: str) -> str:
    """DuckDB: sum of exp(z - max z)."""
    return f"list_sum(list_transform({z}, lambda v: exp(v - list_max({z}))))"
