import numpy as np
import pytest

from skewline.llm import neighbors as N

SCHEMA = "vec_id long, embeddings array<float>, at int, cell int, q long"


def frame(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [None if x is None else float(x) for x in v], a, 0, 0) for i, v, a in rows], SCHEMA)


def brute(vectors, k, floor=None):
    ids = sorted(vectors)
    x = np.stack([vectors[i] for i in ids]).astype(float)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    s = np.round(x @ x.T, 4)
    out = {}
    for a, i in enumerate(ids):
        near = sorted((-s[a, b], j) for b, j in enumerate(ids) if b != a)[:k]
        out[i] = [(j, -v) for v, j in near if floor is None or -v >= floor]
    return out


def planted(n=600, dim=16, seed=3):
    rng = np.random.default_rng(seed)
    base = rng.normal(size=(n // 3, dim))
    x = np.r_[base, base + rng.normal(size=base.shape) * 0.15, rng.normal(size=(n - 2 * len(base), dim))]
    return {i: v * (1 + i % 5) for i, v in enumerate(x)}


def test_recall_of_near_pairs(spark):
    v = planted()
    df = frame(spark, [(i, x, 0) for i, x in v.items()])
    got = {(r.query_id, r.neighbor_id) for r in N.knn(df, k=3, floor=0.9, dim=16, cell_rows=100, probes=3).collect()}
    want = {(i, j) for i, near in brute(v, 3, 0.9).items() for j, _ in near}
    assert len(got & want) / len(want) >= 0.97 and len(got & want) / len(got) >= 0.97


@pytest.mark.parametrize("block", [6000, 40])
def test_all_cells_give_the_true_neighbours(spark, block):
    """Also where cells are cut into blocks that meet pairwise."""
    v = planted(300)
    df = frame(spark, [(i, x, 0) for i, x in v.items()])
    found = N.knn(df, k=5, dim=16, cell_rows=50, probes=1000, rerank=300, queries="vec_id % 10 = 0", block=block).collect()
    got = {}
    for r in found:
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    want = brute(v, 5)
    assert set(got) == {i for i in v if i % 10 == 0}
    hits = sum(len({j for j, _ in want[i]} & set(js)) for i, js in got.items())
    assert hits / sum(len(js) for js in got.values()) >= 0.98


@pytest.mark.parametrize("scale", ["sf0.01", "sf0.1"])
def test_recall_of_the_default_call_without_a_floor(spark, sf, scale):
    """Queries with ids divisible by 50 against all rows of the tables, nothing set but them."""
    df = spark.read.parquet(sf.replace("sf0.001", scale) + "/embedding_result.parquet")
    got = {(r.query_id, r.neighbor_id) for r in N.knn(df, queries="vec_id % 50 = 0", version="extracted_at").collect()}
    x = {r.vec_id: np.array(r.embeddings, float) for r in df.where("vec_id is not null and size(embeddings) = 96").collect() if None not in r.embeddings}
    x = {i: v / np.linalg.norm(v) for i, v in x.items() if np.isfinite(v).all() and v.any()}
    ids, m = np.array(sorted(x)), np.stack([x[i] for i in sorted(x)])
    want = set()
    for i in ids[ids % 50 == 0]:
        s = m @ x[i]
        s[ids == i] = -2
        want |= {(int(i), int(j)) for j in ids[np.lexsort((ids, -s))[:5]]}
    assert len(got & want) / len(want) >= 0.95 and len(got) == len(want)


def test_recall_where_every_vector_is_a_query(spark):
    v = planted(900)
    df = frame(spark, [(i, x, 0) for i, x in v.items()])
    got = {(r.query_id, r.neighbor_id) for r in N.knn(df, k=5, dim=16, cell_rows=100).collect()}
    want = {(i, j) for i, near in brute(v, 5).items() for j, _ in near}
    assert len(got & want) / len(want) >= 0.9


def test_vectors_keep_the_precision_of_floats():
    x = np.random.default_rng(2).normal(size=(200, 96)).astype(np.float32)
    unit = x / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    assert np.abs(N.from_code(N.to_code(x).ravel(), 96) - unit).max() < 1e-7


def test_copies_nulls_and_versions(spark):
    e = np.eye(4)
    rows = [(i, e[0] * (i + 1), 0) for i in range(9)] + [(20, e[1], 0), (20, e[1], 0), (21, e[1] + 0.1 * e[2], 0), (30, e[2], 0), (30, e[3], 1)]
    rows += [(None, e[0], 0), (40, None, 0), (41, [1, 2, 3], 0), (42, [0, 0, 0, 0], 0), (43, [1, None, 2, 3], 0), (44, [1, float("nan"), 0, 0], 0), (45, [float("inf"), 1, 1, 1], 0), (46, e[3] * 1e-30, 0)]
    out = N.knn(frame(spark, rows), k=3, floor=0.9, dim=4, version="at").collect()
    near = {}
    for r in sorted(out, key=lambda r: r["rank"]):
        near.setdefault(r.query_id, []).append(r.neighbor_id)
    assert near[0] == [1, 2, 3] and near[8] == [0, 1, 2] and near[1] == [0, 2, 3]
    assert near[20] == [21] and near[21] == [20]
    assert near[30] == [46] and near[46] == [30]  # the later version of 30 counts
    assert set(near) == {*range(9), 20, 21, 30, 46}
    assert {(p.vec_id_a, p.vec_id_b) for p in N.pairs(N.knn(frame(spark, rows), k=3, floor=0.9, dim=4, version="at")).collect() if p.vec_id_a > 9} == {(20, 21), (30, 46)}


def test_a_third_are_copies(spark):
    """Equal vectors don't meet in one task: they are searched once."""
    v = planted(300)
    rows = [(i, x, 0) for i, x in v.items()] + [(1000 + i, v[7], 0) for i in range(150)]
    out = N.knn(frame(spark, rows), k=5, floor=0.9, dim=16, cell_rows=100, block=50).where("query_id >= 1000").collect()
    assert len(out) == 150 * 5 and {r.neighbor_id for r in out} <= {7, *range(1000, 1006)}


def test_copies_are_queries_though_their_smallest_id_is_none(spark):
    v = planted(300)
    v |= {1000 + i: v[7] for i in range(0, 20, 10)} | {2001: v[13], 2010: v[13] * 2}
    found = N.knn(frame(spark, [(i, x, 0) for i, x in v.items()]), k=5, dim=16, cell_rows=50, probes=1000, rerank=320, queries="vec_id % 10 = 0").collect()
    got = {}
    for r in sorted(found, key=lambda r: r["rank"]):
        got.setdefault(r.query_id, []).append(r.neighbor_id)
    want = brute(v, 5)
    assert set(got) == {i for i in v if i % 10 == 0} and all(len(js) == 5 for js in got.values())
    for i in (1000, 1010, 2010):
        assert set(got[i]) == {j for j, _ in want[i]}


@pytest.mark.parametrize("block", [6000, 40])
def test_a_condition_that_holds_for_all(spark, block):
    """Queries are searched in their nearest cell too, whatever the rows of their batch ask."""
    v = planted(300)
    found = N.knn(frame(spark, [(i, x, 0) for i, x in v.items()]), k=5, dim=16, cell_rows=50, probes=1000, rerank=300, queries="vec_id >= 0", block=block).collect()
    got = {(r.query_id, r.neighbor_id) for r in found}
    want = {(i, j) for i, near in brute(v, 5).items() for j, _ in near}
    assert len(got) == 5 * len(v) and len(got & want) / len(want) >= 0.98


def test_empty_and_single(spark):
    assert N.knn(frame(spark, []), dim=4).count() == 0
    assert N.knn(frame(spark, [(1, [1, 0, 0, 0], 0)]), dim=4).count() == 0


def test_anisotropic_codes_keep_inner_products_better():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    b = N.Codebooks(x)
    code = b.encode(x)
    xs = x.reshape(len(x), b.n_sub, b.width)
    rec = np.stack([b.c[s][code[:, s]] for s in range(b.n_sub)], 1).reshape(x.shape)
    lam, b.lam = b.lam, 0.0
    plain = b.encode(x)
    rec0 = np.stack([b.c[s][plain[:, s]] for s in range(b.n_sub)], 1).reshape(x.shape)
    b.lam = lam
    par = lambda r: np.abs((x * (x - r)).sum(1)).mean()
    assert par(rec) < par(rec0)
    t, scale, base = b.tables(x[:5])
    got = base[:, None] + scale[:, None] * N.scan(t, np.ascontiguousarray(b.pack(code).T))
    assert np.abs(got - x[:5] @ rec.T).max() < 0.05 and xs.shape[1] == b.n_sub


def test_a_dense_blob_keeps_the_best_of_each_side():
    rng = np.random.default_rng(4)
    x = rng.normal(size=8) + rng.normal(size=(700, 8)) * 0.05
    x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
    ids = np.arange(700) * 3
    b = N.Codebooks(x)
    q, m, s = N.search_block(b, ids, x, ids, x, b.pack(b.encode(x)), 5, 0.85, 0.5, 64)
    assert len(s) < 700 * 700 / 4
    full = x @ x.T
    np.fill_diagonal(full, -1)
    want = np.sort(full, axis=1)[:, ::-1][:, :5]
    f = N.best(ids[q], ids[m], s, 5)
    got = np.full((700, 5), -1.0)
    for place, row in zip(f, q[f]):
        k = np.flatnonzero(got[row] < 0)[0]
        got[row, k] = s[place]
    assert np.allclose(got, want, atol=1e-5)
