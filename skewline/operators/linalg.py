"""Distributed moments of vectors, and the small dense algebra on them that the driver does."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.functions.vectors import doubles, to_matrix


@dataclass
class Moments:
    """Counts, class sums and the scatter about ``shift`` of a set of vectors."""

    labels: np.ndarray
    n: np.ndarray
    sums: np.ndarray  # of x - shift, by class
    gram: np.ndarray  # sum of (x - shift)(x - shift)^T
    shift: np.ndarray

    @property
    def total(self) -> int:
        return int(self.n.sum())

    @property
    def mean(self) -> np.ndarray:
        return self.shift + self.sums.sum(0) / self.total

    @property
    def class_means(self) -> np.ndarray:
        return self.shift + self.sums / self.n[:, None]

    def scatter(self, about: np.ndarray | None = None) -> np.ndarray:
        """Sum of (x - about)(x - about)^T; about the mean by default."""
        s = self.sums.sum(0)
        if about is None:
            return self.gram - np.outer(s, s) / self.total
        d = about - self.shift
        return self.gram - np.outer(s, d) - np.outer(d, s) + self.total * np.outer(d, d)

    def within(self) -> np.ndarray:
        """Scatter about the class means."""
        return self.gram - (self.sums / self.n[:, None]).T @ self.sums


def moments(df: DataFrame, x: str, y: str | None = None, shift: np.ndarray | None = None, transform=None) -> Moments:
    """One pass: each task adds up its own class sums and Gram matrix; their rows are then summed by a shuffle.

    What reaches the driver is one F x F matrix and one row a class, whatever the number of rows. Vectors are shifted by a
    pilot mean first, so large offsets don't cancel. ``transform``: maps a batch (n, F) to working space.
    """
    head = df.select(doubles(F.col(x)).alias("x")).where("x is not null").limit(256).toArrow().column(0)
    if not len(head):
        raise ValueError("no vectors to fit on")
    first = to_matrix(head)
    if transform:
        first = transform(first)
    pilot = first.mean(0) if shift is None else np.asarray(shift, float)
    src = df.select(doubles(F.col(x)).alias("x"), (F.col(y).cast("long") if y else F.lit(0).cast("long")).alias("y"))

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram, sums = None, {}
        for b in batches:
            if not b.num_rows:
                continue
            m = to_matrix(b.column(0))
            m = (transform(m) if transform else m) - pilot
            labels = b.column(1).to_numpy(zero_copy_only=False)
            gram = m.T @ m if gram is None else gram + m.T @ m
            for c in np.unique(labels):
                part = m[labels == c]
                n, s = sums.get(int(c), (0, 0.0))
                sums[int(c)] = (n + len(part), s + part.sum(0))
        if gram is not None:
            kinds = ["g"] * len(gram) + ["s"] * len(sums)
            keys = list(range(len(gram))) + list(sums)
            counts = [0] * len(gram) + [n for n, _ in sums.values()]
            rows = [*gram, *(s for _, s in sums.values())]
            yield pa.RecordBatch.from_arrays([pa.array(kinds), pa.array(keys, pa.int64()), pa.array(counts, pa.int64()), pa.array(rows, pa.list_(pa.float64()))], names=["kind", "key", "n", "v"])

    def add(t: pa.Table) -> pa.Table:
        m = to_matrix(t.column("v"))
        return pa.table({"kind": [t.column("kind")[0].as_py()], "key": pa.array([t.column("key")[0].as_py()], pa.int64()), "n": pa.array([int(t.column("n").to_numpy().sum())], pa.int64()), "v": pa.array([m.sum(0)], pa.list_(pa.float64()))})

    schema = "kind string, key long, n long, v array<double>"
    got = src.mapInArrow(partial, schema).groupBy("kind", "key").applyInArrow(add, schema).toPandas().sort_values("key")
    g, s = got[got["kind"] == "g"], got[got["kind"] == "s"]
    return Moments(s["key"].to_numpy(), s["n"].to_numpy(), np.stack(s["v"].to_list()), np.stack(g["v"].to_list()), pilot)


def principal_dim(evals: np.ndarray, f: int, n_components: int | None, pct: float) -> int:
    """How many leading directions to keep: the given number, or as many as reach the share of the spectrum."""
    if n_components is not None:
        if not 0 <= n_components < f:
            raise ValueError("n_components must be at least 0 and below the dimension")
        return int(n_components)
    if not 0 < pct <= 1:
        raise ValueError("pct_variance must be in (0, 1]")
    total = evals.sum()
    if total <= 0:
        return 1
    return int(np.clip(np.searchsorted(np.cumsum(evals) / total, pct, side="left") + 1, 1, f - 1))


def spectrum(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues, greatest first, and their vectors as columns."""
    w, v = np.linalg.eigh((a + a.T) / 2)
    return w[::-1], v[:, ::-1]


def explained(evals: np.ndarray) -> np.ndarray:
    e = np.maximum(evals, 0)
    return e / e.sum() if e.sum() > 0 else np.zeros_like(e)
