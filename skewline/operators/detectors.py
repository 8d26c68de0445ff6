"""Out-of-distribution detectors: fit by aggregation, score row by row; a higher score is further out.

``fit`` may run jobs; ``transform`` never does, so it also works on streams. Parameters that scoring needs are small
dense arrays and travel with the function. Fitting without rows, with wrong options or too few rows raises ValueError;
scoring before fitting raises RuntimeError.
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.functions.vectors import doubles, logsumexp, max_softmax, rowwise, scaled, to_matrix
from skewline.operators.linalg import Moments, explained, moments, principal_dim, spectrum
from skewline.operators.ranks import percentiles
from skewline.session import cut


@dataclass(frozen=True)
class Features:
    """Names of the columns that hold logits and embeddings; at least one is needed."""

    logits: str | None = None
    embeddings: str | None = None

    def __post_init__(self) -> None:
        if self.logits is None and self.embeddings is None:
            raise ValueError("name a logits or an embeddings column")


class Detector(ABC):
    """Base of all detectors."""

    needs: tuple[str, ...] = ()
    default_threshold: float | None = None
    _fitted = False
    _shared: Moments | None = None

    def __init__(self, features: Features | None = None):
        self.features = features or Features("logits", "embeddings")

    def _col(self, kind: str) -> str:
        name = getattr(self.features, kind)
        if name is None:
            raise ValueError(f"{type(self).__name__} needs {kind}")
        return name

    def fit(self, df: DataFrame, y: str | None = None) -> Detector:
        for kind in self.needs:
            self._col(kind)
        self._fit(df, y)
        self._fitted = True
        return self

    @abstractmethod
    def _fit(self, df: DataFrame, y: str | None) -> None: ...

    def _moments(self, df: DataFrame, y: str | None = None, shift: np.ndarray | None = None) -> Moments:
        """Moments of the embeddings: those of ``fit_all`` if there are any (they hold classes and move to any centre)."""
        return self._shared or moments(df, self._col("embeddings"), y, shift)

    @abstractmethod
    def _score(self) -> Column: ...

    def score_column(self) -> Column:
        if not self._fitted:
            raise RuntimeError(f"fit {type(self).__name__} first")
        return self._score()

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        return df.withColumn(out, self.score_column())

    def predict(self, df: DataFrame, threshold: float | None = None, out: str = "prediction") -> DataFrame:
        """1 where the score exceeds the threshold."""
        t = self.default_threshold if threshold is None else threshold
        if t is None:
            raise NotImplementedError(f"{type(self).__name__} has no default threshold")
        return df.withColumn(out, (self.score_column() > F.lit(float(t))).cast("int"))


def fit_all(detectors: dict[str, Detector], df: DataFrame, y: str) -> dict[str, Detector]:
    """Fits several detectors on the same labelled embeddings: their class sums and Gram matrix come from one pass.

    Every row needs a label. Detectors without classes see the same rows.
    """
    names = {d.features.embeddings for d in detectors.values() if not isinstance(d, (MSP, Energy, KNN))}
    shared = {x: moments(df, x, y) for x in names if x}
    for d in detectors.values():
        d._shared = shared.get(d.features.embeddings)
        try:
            d.fit(df, y)
        finally:
            d._shared = None
    return detectors


def _temperature(t: float) -> float:
    if not t > 0:
        raise ValueError("temperature must be positive")
    return float(t)


class MSP(Detector):
    """Minus the greatest softmax probability."""

    needs, default_threshold = ("logits",), -0.5

    def __init__(self, temperature: float = 1.0, features: Features | None = None):
        super().__init__(features)
        self.temperature = _temperature(temperature)

    def _fit(self, df, y):
        pass

    def _score(self):
        return -max_softmax(scaled(F.col(self._col("logits")), self.temperature))


class Energy(Detector):
    """Minus the temperature times the log-sum-exp of the logits."""

    needs = ("logits",)

    def __init__(self, temperature: float = 1.0, features: Features | None = None):
        super().__init__(features)
        self.temperature = _temperature(temperature)

    def _fit(self, df, y):
        pass

    def _score(self):
        return F.lit(-self.temperature) * logsumexp(scaled(F.col(self._col("logits")), self.temperature))


#: numbers that the bank of a broadcast nearest-neighbour search may hold; numbers of a block beyond that
BANK_LIMIT, BLOCK_NUMBERS = 4_000_000, 4_000_000


class KNN(Detector):
    """Distance to the k-th nearest training row (a training row counts itself).

    The bank is broadcast only up to ``bank_limit`` numbers; beyond that ``transform`` writes the rows with a number each
    and meets them with blocks of the bank (``block_knn``), with the same scores for every metric.
    """

    needs = ("embeddings",)
    METRICS = ("euclidean", "manhattan", "cosine", "chebyshev")

    def __init__(self, k: int = 10, metric: str = "euclidean", features: Features | None = None, bank_limit: int = BANK_LIMIT, block_numbers: int = BLOCK_NUMBERS):
        super().__init__(features)
        if k < 1:
            raise ValueError("k must be at least 1")
        if metric not in self.METRICS:
            raise ValueError(f"metric must be one of {self.METRICS}")
        self.k, self.metric, self.bank_limit, self.block_numbers = k, metric, bank_limit, block_numbers

    def _fit(self, df, y):
        col = doubles(F.col(self._col("embeddings")))
        bank = df.select(col.cast("array<float>").alias("x")).where("x is not null")
        shape = bank.agg(F.count(F.lit(1)).alias("n"), F.max(F.size("x")).alias("f")).head()
        if shape["n"] < self.k:
            raise ValueError("fewer training rows than k")
        self.bank_df, self.bank = bank, None
        if shape["n"] * shape["f"] <= self.bank_limit:
            self.bank = to_matrix(bank.toArrow().column(0))

    def _score(self):
        if self.bank is None:
            raise ValueError("the bank is too large for a column: use transform")
        bank, k, metric = self.bank, self.k, self.metric
        return rowwise(lambda q: kth_distance(q, bank, k, metric))(F.col(self._col("embeddings")))

    def transform(self, df: DataFrame, out: str = "score") -> DataFrame:
        if not self._fitted or self.bank is not None:
            return super().transform(df, out)
        x = self._col("embeddings")
        rows = cut(df.withColumn("_knn_row", F.monotonically_increasing_id()), "knn-rows")
        got = block_knn(rows.where(F.col(x).isNotNull()), self.bank_df, "_knn_row", x, self.k, self.metric, "x", self.block_numbers)
        return rows.join(got.withColumnRenamed("score", out), "_knn_row", "left").select(*df.columns, out)


def distances(q: np.ndarray, t: np.ndarray, metric: str) -> np.ndarray:
    if metric == "euclidean":
        return np.sqrt(np.maximum((q * q).sum(1)[:, None] + (t * t).sum(1) - 2 * q @ t.T, 0))
    if metric == "cosine":
        n = lambda m: m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-12)
        return 1 - n(q) @ n(t).T
    d = np.empty((len(q), len(t)))
    for i, row in enumerate(q):
        gap = np.abs(t - row)
        d[i] = gap.sum(1) if metric == "manhattan" else gap.max(1)
    return d


def kth_distance(q: np.ndarray, bank: np.ndarray, k: int, metric: str = "euclidean", block: int = 512) -> np.ndarray:
    if q.shape[1] != bank.shape[1]:
        raise ValueError("queries and bank differ in dimension")
    out = np.empty(len(q))
    for a in range(0, len(q), block):
        d = distances(q[a : a + block], bank, metric)
        near = np.argpartition(d, k - 1, axis=1)[:, k - 1]
        if metric == "euclidean":  # differences instead of expanded squares, which cancel near 0
            out[a : a + block] = np.sqrt(((q[a : a + block] - bank[near]) ** 2).sum(1))
        else:
            out[a : a + block] = d[np.arange(len(d)), near]
    return out


def block_knn(queries: DataFrame, bank: DataFrame, id_col: str, vector: str, k: int = 10, metric: str = "euclidean", bank_vector: str | None = None, block_numbers: int = BLOCK_NUMBERS) -> DataFrame:
    """(id, distance): distance to the k-th nearest bank row, for banks of any size.

    Queries and bank meet block by block in tasks of their own; each keeps the k least distances of a query, which are
    merged by one aggregation. This is the exact search of a stated query set against all rows. Blocks hold about
    ``block_numbers`` numbers; each side is copied once for each block of the other.
    """
    import pyarrow as pa

    bank_vector = bank_vector or vector
    count = lambda d, v: d.agg(F.count(F.lit(1)).alias("n"), F.max(F.size(v)).alias("f")).head()
    nq, nb = count(queries, vector), count(bank, bank_vector)
    of = lambda r: max(1, -(-(r["n"] * (r["f"] or 1)) // block_numbers))
    query_blocks, blocks = of(nq), of(nb)
    q = queries.select(F.col(id_col).alias("id"), doubles(F.col(vector)).alias("x"), F.pmod(F.xxhash64(id_col), F.lit(query_blocks)).alias("qb")).withColumn("bb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long"))))
    b = bank.select(doubles(F.col(bank_vector)).alias("x"), F.pmod(F.monotonically_increasing_id(), F.lit(blocks)).cast("long").alias("bb")).withColumn("qb", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(query_blocks - 1).cast("long"))))

    def near(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, out_i, out_d = left.column("id"), [], []
        if left.num_rows and right.num_rows:
            x, t = to_matrix(left.column("x")), to_matrix(right.column("x"))
            for a in range(0, len(x), 256):
                d = distances(x[a : a + 256], t, metric)
                kk = min(k, len(t))
                near_ = np.argpartition(d, kk - 1, axis=1)[:, :kk]
                d = np.take_along_axis(d, near_, 1)
                if metric == "euclidean":  # differences instead of expanded squares, which cancel near 0
                    d = np.sqrt(((x[a : a + 256, None] - t[near_]) ** 2).sum(2))
                out_i.append(np.repeat(np.arange(a, a + len(d)), kk))
                out_d.append(d.ravel())
        i = np.concatenate(out_i) if out_i else np.zeros(0, np.int64)
        return pa.table({"id": ids.take(pa.array(i)), "d": pa.array(np.concatenate(out_d) if out_d else np.zeros(0))})

    kind = q.schema["id"].dataType.simpleString()
    got = q.groupBy("qb", "bb").cogroup(b.groupBy("qb", "bb")).applyInArrow(near, f"id {kind}, d double")
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy("d")
    return got.withColumn("r", F.row_number().over(w)).where(F.col("r") == k).select(F.col("id").alias(id_col), F.col("d").alias("score"))


class Mahalanobis(Detector):
    """Least squared Mahalanobis distance to a class mean, with one covariance for all classes."""

    needs = ("embeddings",)

    def __init__(self, eps: float = 1e-6, features: Features | None = None):
        super().__init__(features)
        self.eps = eps

    def _fit(self, df, y):
        m = self._moments(df, y)
        if m.total < 2:
            raise ValueError("at least two rows are needed")
        cov = m.within() / max(m.total - len(m.n), 1)
        self.class_means = m.class_means
        self.precision = np.linalg.pinv(cov + self.eps * np.eye(len(cov)), hermitian=True)

    def _score(self):
        w, v = np.linalg.eigh((self.precision + self.precision.T) / 2)
        root = v * np.sqrt(np.maximum(w, 0))  # distances become plain ones in whitened space
        centers = self.class_means @ root

        def fn(x: np.ndarray) -> np.ndarray:
            if x.shape[1] != len(root):
                raise ValueError("the rows differ in dimension from those fitted")
            z = x @ root
            best = np.full(len(z), np.inf)
            for c in centers:
                best = np.minimum(best, ((z - c) ** 2).sum(1))
            return best

        return rowwise(fn)(F.col(self._col("embeddings")))


KERNELS = ("linear", "cosine", "rff_cosine")


class _Subspace:
    """Principal subspace in the working space of a kernel."""

    def __init__(self, kernel="linear", n_components=None, pct_variance=0.95, rff_dim=256, rff_gamma=1.0, random_state=None):
        if kernel not in KERNELS:
            raise ValueError(f"kernel must be one of {KERNELS}")
        if kernel == "rff_cosine" and rff_dim < 2:
            raise ValueError("rff_dim must be at least 2")
        self.kernel, self.n_components, self.pct_variance = kernel, n_components, pct_variance
        self.rff_dim, self.rff_gamma, self.random_state = rff_dim, rff_gamma, random_state
        self.omega = self.phase = None

    def working(self):
        kernel, omega, phase, dim = self.kernel, self.omega, self.phase, self.rff_dim

        def fn(x: np.ndarray) -> np.ndarray:
            if kernel == "linear":
                return x
            u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
            return u if kernel == "cosine" else np.sqrt(2.0 / dim) * np.cos(u @ omega + phase)

        return fn

    def fit(self, df: DataFrame, x: str, given: Moments | None = None) -> None:
        f = df.select(F.size(x).alias("f")).where("f >= 0").head()
        if f is None:
            raise ValueError("no vectors to fit on")
        if f["f"] < 2:
            raise ValueError("at least two dimensions are needed")
        if self.kernel == "rff_cosine":
            rng = np.random.default_rng(self.random_state)
            self.omega = rng.normal(0.0, np.sqrt(2 * self.rff_gamma), (f["f"], self.rff_dim))
            self.phase = rng.uniform(0.0, 2 * np.pi, self.rff_dim)
        m = given if given is not None and self.kernel == "linear" else moments(df, x, transform=None if self.kernel == "linear" else self.working())
        if m.total < 2:
            raise ValueError("at least two rows are needed")
        self.mean = m.mean
        self.evals, vectors = spectrum(m.scatter())
        self.k = principal_dim(self.evals, len(self.evals), self.n_components, self.pct_variance)
        self.basis = vectors[:, : self.k]

    def errors(self):
        mean, basis, work = self.mean, self.basis, self.working()

        def fn(x: np.ndarray) -> np.ndarray:
            d = work(x) - mean
            return np.linalg.norm(d - (d @ basis) @ basis.T, axis=1)

        return fn


class PCA(Detector):
    """Norm of what the principal subspace can't reconstruct."""

    needs = ("embeddings",)

    def __init__(self, kernel="linear", n_components=None, pct_variance=0.95, rff_dim=256, rff_gamma=1.0, random_state=None, features=None):
        super().__init__(features)
        self.space = _Subspace(kernel, n_components, pct_variance, rff_dim, rff_gamma, random_state)

    def _fit(self, df, y):
        self.space.fit(df, self._col("embeddings"), self._shared)

    def _score(self):
        return rowwise(self.space.errors())(F.col(self._col("embeddings")))

    @property
    def n_components_fitted(self) -> int:
        return self.space.k

    def explained_variance(self, spark) -> DataFrame:
        """(component, ratio, cum_ratio)."""
        return _explained(spark, self.space.evals)


def _explained(spark, evals: np.ndarray) -> DataFrame:
    r = explained(evals)
    return spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(zip(r, np.cumsum(r)))], "component int, ratio double, cum_ratio double")


class PCAFusion(PCA):
    """Reconstruction error, as a share of the vector's norm, fused with the log-sum-exp of the logits."""

    needs = ("logits", "embeddings")

    def __init__(self, kernel="linear", n_components=None, pct_variance=0.95, temperature=1.0, eps=1e-12, rff_dim=256, rff_gamma=1.0, random_state=None, features=None):
        super().__init__(kernel, n_components, pct_variance, rff_dim, rff_gamma, random_state, features)
        self.temperature, self.eps = _temperature(temperature), eps

    def _score(self):
        err, eps = self.space.errors(), self.eps
        share = rowwise(lambda x: np.clip(err(x) / (np.linalg.norm(x, axis=1) + eps), 0, 1))(F.col(self._col("embeddings")))
        return -(F.lit(1.0) - share) * logsumexp(scaled(F.col(self._col("logits")), self.temperature))


class ViM(Detector):
    """Softmax probability of a virtual logit: the scaled norm of the residual about the head's origin."""

    needs, default_threshold = ("logits", "embeddings"), 0.5

    def __init__(self, W, b, n_components=None, pct_variance=0.95, features=None):
        super().__init__(features)
        self.W, self.b = np.asarray(W, float), np.asarray(b, float)
        if self.W.ndim != 2 or self.b.shape != (len(self.W),):
            raise ValueError("W must be (classes, dims) and b (classes,)")
        self.n_components, self.pct_variance = n_components, pct_variance

    def _fit(self, df, y):
        x, z = self._col("embeddings"), self._col("logits")
        self.origin = -np.linalg.pinv(self.W) @ self.b
        m = self._moments(df, shift=self.origin)
        if len(self.origin) != len(m.shift):
            raise ValueError("the head and the vectors differ in dimension")
        self.evals, vectors = spectrum(m.scatter(self.origin))
        self.k = principal_dim(self.evals, len(self.evals), self.n_components, self.pct_variance)
        self.residual = vectors[:, self.k :]
        r = df.agg(F.avg(F.array_max(doubles(F.col(z)))).alias("z"), F.avg(self._norm(F.col(x))).alias("r")).head()
        self.alpha = r["z"] / (r["r"] + 1e-12)

    def _norm(self, x: Column) -> Column:
        origin, residual = self.origin, self.residual
        return rowwise(lambda v: np.linalg.norm((v - origin) @ residual, axis=1))(x)

    def _score(self):
        z = doubles(F.col(self._col("logits")))
        virtual = F.lit(self.alpha) * self._norm(F.col(self._col("embeddings")))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(logsumexp(z) - virtual))

    def explained_variance(self, spark) -> DataFrame:
        return _explained(spark, self.evals)


class WDiscOOD(Detector):
    """Distances in the whitened discriminative subspace and in what is left, each over its median on the training rows."""

    needs = ("embeddings",)

    def __init__(self, n_discriminants=None, ridge=1e-3, alpha=1.0, eps=1e-12, features=None):
        super().__init__(features)
        self.n_discriminants, self.ridge, self.alpha, self.eps = n_discriminants, ridge, alpha, eps

    def _fit(self, df, y):
        if y is None:
            raise ValueError("class labels are needed")
        x = self._col("embeddings")
        m = self._moments(df, y)
        if len(m.n) < 2:
            raise ValueError("at least two classes are needed")
        f = m.gram.shape[0]
        k = min(len(m.n) - 1, f) if self.n_discriminants is None else self.n_discriminants
        if not 1 <= k <= f:
            raise ValueError("n_discriminants must be between 1 and the dimension")
        sw = m.within() + self.ridge * np.eye(f)
        delta = m.class_means - m.mean
        sb = (delta * m.n[:, None]).T @ delta
        inv = np.linalg.pinv(sw, hermitian=True)
        w, v = np.linalg.eigh((inv + inv.T) / 2)
        half = (v * np.sqrt(np.maximum(w, 1e-8))) @ v.T
        _, top = spectrum(half @ sb @ half)
        self.V, _ = np.linalg.qr(half @ top[:, :k])
        self.mean, self.centers = m.mean, delta @ self.V
        long = df.select(self._distance("wd")(F.col(x)).alias("wd"), self._distance("wdr")(F.col(x)).alias("wdr")).unpivot([], ["wd", "wdr"], "kind", "v")
        med = {r["kind"]: r["m"][0] for r in percentiles(long, ["kind"], "v", [0.5], "m").collect()}  # two rows
        self.med_wd, self.med_wdr = med["wd"], med["wdr"]

    def _distance(self, kind: str):
        mean, V, centers = self.mean, self.V, self.centers

        def fn(x: np.ndarray) -> np.ndarray:
            d = x - mean
            p = d @ V
            if kind == "wdr":
                return np.linalg.norm(d - p @ V.T, axis=1)
            best = np.full(len(x), np.inf)
            for c in centers:
                best = np.minimum(best, np.linalg.norm(p - c, axis=1))
            return best

        return rowwise(fn)

    def _score(self):
        wd, wdr = self._distance("wd"), self._distance("wdr")
        a, b, alpha, eps = self.med_wd, self.med_wdr, self.alpha, self.eps
        x = F.col(self._col("embeddings"))
        return wd(x) / F.lit(a + eps) + F.lit(alpha) * wdr(x) / F.lit(b + eps)
