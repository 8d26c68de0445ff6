"""The k most similar vectors of every vector, by cosine.

Contract: usable are rows with an id whose vector is not null and has exactly ``dim`` finite numbers that aren't all zero;
other rows take no part. Repeated rows of an id count once; if an id comes with different usable vectors the one with
the greatest ``version`` counts (then the greatest content). Order: cosine descending, then id ascending. Equal vectors
(up to length) are searched once and shared out afterwards: each copy gets the first k others of its class. An empty
table gives an empty result.

Method: vectors are kept at 24 bits a number, the precision of a float. Spherical k-means cells and four-bit codebooks are
fitted on a bounded sample; codebooks and codes minimise an anisotropic loss, in which the part of the error parallel to
the vector weighs more, since it is what shifts large inner products. Every vector is coded and lies in one cell; it is
looked for in as many cells as keep the wanted recall of queries compared with all rows (or in ``probes``) by table scans over the codes, and
what scans well is reranked by its cosine. There are about n / ``cell_rows`` cells; cells beyond ``block`` rows are cut
into blocks that meet pairwise in separate tasks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skewline.session import cut, release

#: rows of the sample that cells and codebooks are fitted on: ten a cell, within these bounds
SAMPLE = (30_000, 200_000)
#: queries whose true neighbours tell how many cells are searched; share of these that lie there, without and with a floor
ASKED, RECALL, RECALL_FLOOR = 1000, 0.98, 0.99
#: rows of equal vectors that meet on one key
SALTS = 8
#: error weights: the threshold T of the score-aware loss, eta = (d - 1) T^2 / (1 - T^2)
THRESHOLD = 0.2
#: rows a cell with and without a floor; rows a block; cells at most
CELL_ROWS, BLOCK_ROWS, MAX_CELLS = (2000, 4000), 6000, 20_000


def to_code(x: np.ndarray) -> np.ndarray:
    """Vectors as 24-bit numbers scaled by the largest: (n, 3 * dim) bytes, the high 16 bits first."""
    v = np.rint(x.astype(np.float64) * (8388607 / np.abs(x).max(1, keepdims=True))).astype(np.int32)
    high, low = np.ascontiguousarray((v >> 8).astype("<i2")), (v & 255).astype(np.uint8)
    return np.concatenate([high.view(np.uint8), low], axis=1)


def from_code(raw: np.ndarray, dim: int) -> np.ndarray:
    """Unit vectors from rows of bytes."""
    b = raw.reshape(-1, 3 * dim)
    x = np.ascontiguousarray(b[:, : 2 * dim]).view("<i2").astype(np.float32) * 256 + b[:, 2 * dim :]
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def unpacked(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    return from_code(np.frombuffer(b"".join(col.to_pylist()), np.uint8), dim)


def kmeans_cells(x: np.ndarray, k: int, rounds: int = 8, seed: int = 7) -> np.ndarray:
    """Spherical k-means; cells that run empty are put on the rows that fit worst."""
    rng = np.random.default_rng(seed)
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        s = x @ c.T
        a = s.argmax(1)
        order = np.argsort(a, kind="stable")
        n = np.bincount(a, minlength=k)
        starts = np.concatenate([[0], np.cumsum(n)[:-1]])
        full = n > 0
        c[full] = np.add.reduceat(x[order], starts[full])
        worst = np.argsort(s.max(1))
        c[~full] = x[worst[: int((~full).sum())]]
        c /= np.maximum(np.linalg.norm(c, axis=1, keepdims=True), 1e-12)
    return c.astype(np.float32)


def turned(x: np.ndarray, sim: float, seed: int = 7) -> np.ndarray:
    """A vector at the cosine ``sim`` from each, in a random direction."""
    z = np.random.default_rng(seed).normal(size=x.shape).astype(np.float32)
    z -= (z * x).sum(1, keepdims=True) * x
    return sim * x + np.sqrt(1 - sim * sim) * z / np.maximum(np.linalg.norm(z, axis=1, keepdims=True), 1e-9)


def probes_for(reps: DataFrame, n: int, cells: np.ndarray, k: int, floor: float | None, dim: int, both: bool, seed: int) -> int:
    """Cells to search: with as many, the true neighbours of ``ASKED`` queries are found but for 1 - ``RECALL``.

    The queries are drawn by hash and compared with all rows; each task keeps the k best of each. Where every vector is
    a query, a pair is found from either side.
    """
    share = min(1.0, ASKED / max(n, 1))
    asked = reps.where(F.pmod(F.xxhash64(F.lit(seed + 1), "vec_id"), F.lit(1_000_000_000)) < int(share * 1_000_000_000)).select("vec_id", "code").toArrow()
    if not asked.num_rows:
        return len(cells)
    q = unpacked(asked.column(1), dim)
    shared = reps.sparkSession.sparkContext.broadcast((asked.column(0).to_numpy(), q, cells))  # about ASKED queries

    def near(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, q, cells = shared.value
        place = _places(q, cells)
        own = (q @ cells.T).argmax(1)
        best_s, best_need = np.full((len(q), k), -2, np.float32), np.zeros((len(q), k), np.int32)
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                v = unpacked(part.column(1), dim)
                s = q @ v.T
                s[ids[:, None] == part.column(0).to_numpy()[None]] = -2
                kk = min(k, len(v))
                i = np.argpartition(-s, kk - 1, axis=1)[:, :kk]
                there = _places(v[i.ravel()], cells) if both else None
                need = place[np.arange(len(q))[:, None], (v @ cells.T).argmax(1)[i]]
                if both:
                    need = np.minimum(need, there[np.arange(i.size), np.repeat(own, kk)].reshape(i.shape))
                best_s = np.concatenate([best_s, np.take_along_axis(s, i, 1)], axis=1)
                best_need = np.concatenate([best_need, need], axis=1)
                i = np.argpartition(-best_s, k - 1, axis=1)[:, :k]
                best_s, best_need = np.take_along_axis(best_s, i, 1), np.take_along_axis(best_need, i, 1)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(len(q)), k)), pa.array(best_s.ravel().astype(float)), pa.array(best_need.ravel(), pa.int32())], names=["q", "s", "need"])

    found = reps.select("vec_id", "code").mapInArrow(near, "q long, s double, need int").where(F.col("s") > (-1.5 if floor is None else floor))
    found = found.withColumn("r", F.row_number().over(Window.partitionBy("q").orderBy(F.col("s").desc(), "need"))).where(F.col("r") <= k)
    need = found.select("need").toArrow().column(0).to_numpy()  # k rows a query
    return int(np.quantile(need, RECALL if floor is None else RECALL_FLOOR, method="higher")) + 1 if len(need) else 1


def _places(q: np.ndarray, cells: np.ndarray) -> np.ndarray:
    """Place of each cell in each query's order."""
    order = np.argsort(-(q @ cells.T), axis=1)
    out = np.empty_like(order)
    np.put_along_axis(out, order, np.broadcast_to(np.arange(len(cells)), order.shape), 1)
    return out


class Codebooks:
    """16 centres for each pair of dimensions, fitted and used under the anisotropic loss."""

    def __init__(self, x: np.ndarray, rounds: int = 4, seed: int = 7):
        rng = np.random.default_rng(seed)
        d = x.shape[1]
        self.width = 2 if d % 4 == 0 else 1
        self.n_sub = d // self.width
        self.lam = max(0.0, (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2) - 1)
        xs = x.reshape(len(x), self.n_sub, self.width)
        reps = -(-16 // len(x))
        pick = np.tile(np.arange(len(x)), reps)
        self.c = np.stack([xs[rng.choice(pick, 16, replace=False), s] for s in range(self.n_sub)]).astype(np.float32)
        for _ in range(rounds):
            code = self.encode(x)
            par = self._parallel(xs, code)
            for s in range(self.n_sub):
                v, k = xs[:, s], code[:, s]
                fit = (v * (v - self.c[s][k])).sum(1)
                b = par - fit + (v * v).sum(1)
                for j in range(16):
                    m = k == j
                    if m.any():
                        left = m.sum() * np.eye(self.width) + self.lam * v[m].T @ v[m]
                        self.c[s, j] = np.linalg.solve(left, v[m].sum(0) + self.lam * (b[m, None] * v[m]).sum(0))
                par += (v * (v - self.c[s][k])).sum(1) - fit

    def _parallel(self, xs: np.ndarray, code: np.ndarray) -> np.ndarray:
        """Inner product of each vector with its residual."""
        out = np.zeros(len(xs), np.float32)
        for s in range(self.n_sub):
            out += (xs[:, s] * (xs[:, s] - self.c[s][code[:, s]])).sum(1)
        return out

    def encode(self, x: np.ndarray, sweeps: int = 1) -> np.ndarray:
        """(n, n_sub) codes: nearest centres, then sweeps of coordinate descent on the anisotropic loss."""
        xs = x.reshape(len(x), self.n_sub, self.width)
        code = np.empty((len(x), self.n_sub), np.uint8)
        cc = (self.c**2).sum(2)
        dots = np.einsum("nsw,skw->snk", xs, self.c)
        dist = cc[:, None, :] - 2 * dots
        code[:] = dist.argmin(2).T
        norm = (xs**2).sum(2)
        rows = np.arange(len(x))
        for _ in range(sweeps):
            par = norm.sum(1) - sum(dots[s, rows, code[:, s]] for s in range(self.n_sub))
            for s in range(self.n_sub):
                rest = par + dots[s, rows, code[:, s]]
                new = (dist[s] + self.lam * (rest[:, None] - dots[s]) ** 2).argmin(1)
                par = rest - dots[s, rows, new]
                code[:, s] = new
        return code

    @staticmethod
    def pack(code: np.ndarray) -> np.ndarray:
        """Two four-bit codes a byte."""
        return (code[:, 0::2] << 4) | code[:, 1::2]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tables, scale, base): for each query and pair of codes 256 bytes; score = base + scale * sum of bytes."""
        lut = np.einsum("nsw,skw->nsk", q.reshape(len(q), self.n_sub, self.width), self.c)
        low = lut.min(2, keepdims=True)
        scale = np.maximum((lut - low).max((1, 2)), 1e-9) / 127
        small = np.rint((lut - low) / scale[:, None, None]).astype(np.uint8)
        t = (small[:, 0::2, :, None] + small[:, 1::2, None, :]).reshape(len(q), self.n_sub // 2, 256)
        return t, scale, low.sum((1, 2))

    def slack(self, x: np.ndarray, sim: float, seed: int = 7) -> float:
        """How far a scan falls short of the cosine at ``sim``, but for one in a thousand."""
        q = turned(x, sim, seed)
        code = self.encode(x)
        got = np.zeros(len(x))
        qs = q.reshape(len(q), self.n_sub, self.width)
        for s in range(self.n_sub):
            got += (qs[:, s] * self.c[s][code[:, s]]).sum(1)
        return float(np.quantile(sim - got, 0.999)) + 0.02


def scan(t: np.ndarray, packed_t: np.ndarray) -> np.ndarray:
    """(queries, members) sums of table bytes. packed_t: (bytes, members)."""
    acc = np.zeros((t.shape[0], packed_t.shape[1]), np.uint16)
    for j in range(t.shape[1]):
        acc += np.take(t[:, j], packed_t[j], axis=1)
    return acc


def search_block(books: Codebooks, qid: np.ndarray, q: np.ndarray, mid: np.ndarray, m: np.ndarray, packed: np.ndarray, k: int, floor: float | None, slack: float, rerank: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query place, member place, cosine) of what scans well, reranked; with a floor every pair that may reach it."""
    packed_t = np.ascontiguousarray(packed.T)
    out_q, out_m, out_s = [], [], []
    for a in range(0, len(q), 128):
        part = q[a : a + 128]
        t, scale, base = books.tables(part)
        acc = scan(t, packed_t)
        if floor is not None:
            need = np.ceil((floor - slack - base) / scale)
            i, j = np.nonzero(acc >= np.clip(need, 0, 65535)[:, None])
        else:
            n = min(rerank, len(m))
            j = np.argpartition(acc, len(m) - n, axis=1)[:, len(m) - n :]
            i, j = np.repeat(np.arange(len(part)), n), j.ravel()
        kept = []
        for c in range(0, len(i), 100_000):
            ii, jj = i[c : c + 100_000], j[c : c + 100_000]
            s = np.einsum("ij,ij->i", part[ii], m[jj])
            keep = qid[a + ii] != mid[jj]
            if floor is not None:
                keep &= s >= floor
            kept.append((ii[keep], jj[keep], s[keep]))
        if not kept:
            continue
        i, j, s = (np.concatenate(x) for x in zip(*kept))
        if len(s) > 8 * k * len(part):
            # where all lie close together only the k best of each side can matter
            some = np.union1d(best(i, mid[j], s, k), best(j, qid[a + i], s, k))
            i, j, s = i[some], j[some], s[some]
        out_q.append(a + i)
        out_m.append(j)
        out_s.append(s)
    return tuple(np.concatenate(x) if x else np.zeros(0, d) for x, d in ((out_q, np.int64), (out_m, np.int64), (out_s, np.float32)))


def best(owner: np.ndarray, other_id: np.ndarray, s: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each owner: similarity descending, id ascending."""
    order = np.lexsort((other_id, -s, owner))
    o = owner[order]
    first = np.concatenate([[True], o[1:] != o[:-1]]) if len(o) else np.zeros(0, bool)
    rank = np.arange(len(o)) - np.maximum.accumulate(np.where(first, np.arange(len(o)), 0)) if len(o) else o
    return order[rank < k]


def coded(df: DataFrame, vec_id: str, vector: str, version: str | None, dim: int) -> DataFrame:
    """(vec_id, v, code) of the usable rows, written once; code: 24-bit numbers."""
    src = df.select(F.col(vec_id).cast("long").alias("vec_id"), (F.col(version).cast("string") if version else F.lit("")).alias("v"), F.col(vector).cast("array<float>").alias("x")).where(F.col("vec_id").isNotNull() & (F.size("x") == dim))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(2).flatten().to_numpy(zero_copy_only=False).astype(np.float32).reshape(-1, dim)
            big = np.abs(x).max(1) if len(x) else np.zeros(0)
            good = np.isfinite(x).all(1) & (big > 0)
            x = x[good] / big[good, None]
            code = to_code(x)
            keep = pa.array(good)
            yield pa.RecordBatch.from_arrays([b.column(0).filter(keep), b.column(1).filter(keep), pa.array([r.tobytes() for r in code], pa.binary())], names=["vec_id", "v", "code"])

    return cut(src.mapInArrow(run, "vec_id long, v string, code binary"), "knn-codes")


def _one_per_id(rows: DataFrame) -> DataFrame:
    """One row per id. Only ids are shuffled; where ids have different vectors (normally none) their rows are chosen by a join."""
    rows = rows.withColumn("h", F.xxhash64("code"))
    by_id = rows.groupBy("vec_id").agg(F.max(F.struct("v", "h")).alias("best"), F.count(F.lit(1)).alias("n"))
    odd = cut(by_id.where("n > 1").select("vec_id", F.col("best.h").alias("keep")), "knn-repeated")
    once = rows.join(odd.select("vec_id"), "vec_id", "left_anti")
    again = rows.join(odd, "vec_id").where("h = keep").groupBy("vec_id").agg(F.min("code").alias("code"), F.min("h").alias("h"))
    return once.select("vec_id", "code", "h").unionByName(again.select("vec_id", "code", "h"))


def knn(df: DataFrame, vec_id: str = "vec_id", vector: str = "embeddings", k: int = 5, floor: float | None = None, probes: int | None = None, queries: str | None = None, version: str | None = None, dim: int = 96, rerank: int = 64, sample: tuple[int, int] = SAMPLE, cell_rows: int | None = None, block: int = BLOCK_ROWS, seed: int = 7) -> DataFrame:
    """(query_id, neighbor_id, cosine, rank): the k most similar others of each vector.

    floor: only neighbours with at least this cosine. probes: cells searched per query (None: by the wanted recall).
    queries: SQL condition on ``vec_id`` that picks the queries (default: every vector).
    """
    spark = df.sparkSession
    all_rows = coded(df, vec_id, vector, version, dim)
    rows = _one_per_id(all_rows)
    # classes of equal vectors: searched by their smallest id
    classes = rows.groupBy("h", F.hash("code").alias("h2")).agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n")).where("n > 1").select("h", "h2", "rep", _salts())
    copies = cut(rows.select("vec_id", "h", F.hash("code").alias("h2"), _salt("vec_id")).join(classes, ["h", "h2", "salt"]).select("rep", "vec_id", "salt"), "knn-copies")
    is_query = F.coalesce(F.expr(queries), F.lit(False)) if queries else F.lit(True)
    reps = rows.join(copies.where("vec_id <> rep").select("vec_id"), "vec_id", "left_anti").select("vec_id", "code", is_query.alias("asks"))
    if queries:
        # a class is searched if any of its ids is a query
        told = copies.groupBy("rep").agg(F.bool_or(is_query).alias("told")).where("told").select(F.col("rep").alias("vec_id"), "told")
        reps = reps.join(told, "vec_id", "left").select("vec_id", "code", F.coalesce("told", "asks").alias("asks"))
    reps = cut(reps, "knn-vectors")
    release(all_rows)
    n = reps.count()
    cell_rows = cell_rows or CELL_ROWS[floor is None]
    share = min(1.0, float(np.clip(10 * n / cell_rows, *sample)) / max(n, 1))
    got = reps.where(F.pmod(F.xxhash64(F.lit(seed), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("code").toArrow()
    if not got.num_rows:
        got = reps.limit(100).select("code").toArrow()
    if not got.num_rows:
        return spark.createDataFrame([], "query_id long, neighbor_id long, cosine double, rank int")
    x = unpacked(got.column(0), dim)
    n_cells = int(np.clip(n // cell_rows, 1, min(MAX_CELLS, max(1, len(x) // 10))))
    cells = kmeans_cells(x, n_cells, seed=seed)
    books = Codebooks(x[: min(len(x), 12_000)], seed=seed)
    slack = books.slack(x[:4000], floor) if floor is not None else 0.0
    sizes = np.bincount((x @ cells.T).argmax(1), minlength=n_cells) * (n / len(x))
    n_blocks = np.maximum(1, np.ceil(sizes / block)).astype(np.int64)
    t = min(probes or probes_for(reps, n, cells, k, floor, dim, queries is None, seed), n_cells)
    every = queries is None
    # cells and codebooks are bounded by MAX_CELLS x dim and 16 x dim numbers
    shared = spark.sparkContext.broadcast((cells, books, n_blocks))

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cells, books, n_blocks = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 2000):
                part = b.slice(start, 2000)
                ids, raw, asks = part.column(0).to_numpy(), part.column(1), part.column(2).to_numpy(zero_copy_only=False)
                v = unpacked(raw, dim)
                s = v @ cells.T
                near = np.argpartition(-s, t - 1, axis=1)[:, :t]
                near = np.take_along_axis(near, np.argsort(-np.take_along_axis(s, near, 1), axis=1), 1)
                packed = Codebooks.pack(books.encode(v))
                salt = (ids * np.int64(-7046029254386353131)) >> 33
                who, cell, mb, qb, role = [], [], [], [], []
                for r in range(t):
                    c = near[:, r]
                    nb = n_blocks[c]
                    own = salt % nb
                    # a member goes to its block for every block of queries, a query to its block for every block of members
                    for kind in (0, 1):
                        if kind == 0 and r > 0:
                            continue
                        take = np.arange(len(ids)) if kind == 0 else np.flatnonzero(asks)
                        if kind == 1 and r == 0 and (nb == 1).all() and every:
                            continue  # members of undivided cells are their own queries
                        if kind == 1 and r == 0:
                            take = take[nb[take] > 1] if every else take
                        w = np.repeat(take, nb[take])
                        k_ = np.arange(len(w)) - np.repeat(np.cumsum(nb[take]) - nb[take], nb[take])
                        who.append(w)
                        cell.append(c[w])
                        mb.append(own[w] if kind == 0 else k_)
                        qb.append(k_ if kind == 0 else own[w])
                        role.append(np.full(len(w), kind))
                w, kind = np.concatenate(who), np.concatenate(role)
                names = ["cell", "mb", "qb", "role", "vec_id", "code", "pq"]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(cell), pa.int32()), pa.array(np.concatenate(mb), pa.int32()), pa.array(np.concatenate(qb), pa.int32()), pa.array(kind, pa.int8()), pa.array(ids[w]), raw.take(pa.array(w)), pa.array([packed[i].tobytes() if z == 0 else None for i, z in zip(w.tolist(), kind.tolist())], pa.binary())], names=names)

    def search(group: pa.Table) -> pa.Table:
        _, books, n_blocks = shared.value
        role = group.column("role").to_numpy()
        ids = group.column("vec_id").to_numpy()
        v = unpacked(group.column("code"), dim)
        mem = np.flatnonzero(role == 0)
        whole = every and n_blocks[group.column("cell")[0].as_py()] == 1
        ask = np.arange(len(role)) if whole else np.flatnonzero(role == 1)
        empty = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(mem) and len(ask):
            packed = np.frombuffer(b"".join(group.column("pq").take(pa.array(mem)).to_pylist()), np.uint8).reshape(len(mem), -1)
            i, j, s = search_block(books, ids[ask], v[ask], ids[mem], v[mem], packed, k, floor, slack, rerank)
            qi, mi = ids[ask][i], ids[mem][j]
            f = best(qi, mi, s, k)
            # what a visitor finds, the member has found too
            r = best(mi, qi, s, k) if every else f[:0]
            empty = [np.concatenate([qi[f], mi[r]]), np.concatenate([mi[f], qi[r]]), np.concatenate([s[f], s[r]]).astype(np.float64)]
        return pa.table(empty, names=["q", "m", "s"])

    routed = reps.mapInArrow(assign, "cell int, mb int, qb int, role tinyint, vec_id long, code binary, pq binary")
    found = routed.groupBy("cell", "mb", "qb").applyInArrow(search, "q long, m long, s double")
    first = Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("m").asc())
    found = found.repartition("q").groupBy("q", "m").agg(F.max("s").alias("s"))
    found = _with_copies(found, copies, k, queries)
    found = found.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)
    return found.select(F.col("q").alias("query_id"), F.col("m").alias("neighbor_id"), F.least(F.lit(1.0), "s").alias("cosine"), "rank")


def _salt(col: str) -> Column:
    return F.pmod(F.xxhash64(F.lit("salt"), col), F.lit(SALTS)).cast("int").alias("salt")


def _salts() -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt")


def _with_copies(found: DataFrame, copies: DataFrame, k: int, queries: str | None) -> DataFrame:
    """Shares what was found for one of equal vectors among all: its copies as neighbours (the first k + 1 do) and as queries.

    A class may be a third of all rows: its copies lie under several salts, and what each gets is cut to k + 1 rows first.
    """
    if copies.isEmpty():
        return found
    by_salt = Window.partitionBy("rep", "salt").orderBy("vec_id")
    few = copies.withColumn("r", F.row_number().over(by_salt)).where(F.col("r") <= k + 1)
    few = few.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("rep", "vec_id")
    m = found.join(few.select(F.col("rep").alias("m"), F.col("vec_id").alias("mm")), "m", "left").select("q", F.coalesce("mm", "m").alias("m"), "s")
    m = m.unionByName(few.select(F.col("rep").alias("q"), F.col("vec_id").alias("m"), F.lit(1.0).alias("s")))
    best_ = Window.partitionBy("q").orderBy(F.col("s").desc(), F.col("m").asc())
    m = m.withColumn("r", F.row_number().over(best_)).where(F.col("r") <= k + 1).select("q", "m", "s")
    alone = m.join(copies.select(F.col("rep").alias("q")).distinct(), "q", "left_anti")
    shared = m.select("*", _salts()).join(copies.select(F.col("rep").alias("q"), F.col("vec_id").alias("qq"), "salt"), ["q", "salt"]).select(F.col("qq").alias("q"), "m", "s")
    q = alone.unionByName(shared).where("q <> m")
    if queries:
        q = q.where(F.expr(queries.replace("vec_id", "q")))
    return q


def pairs(found: DataFrame) -> DataFrame:
    """Distinct (vec_id_a, vec_id_b), a < b, of which one is among the neighbours of the other."""
    return found.select(F.least("query_id", "neighbor_id").alias("vec_id_a"), F.greatest("query_id", "neighbor_id").alias("vec_id_b")).distinct()
