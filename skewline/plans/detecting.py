"""Queries on detectors, heads and masks over the ``embeddings``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.functions import vectors as V
from skewline.operators import detectors as D
from skewline.operators import masks, metrics
from skewline.operators.bank import ScoreBank
from skewline.plans import shapes
from skewline.plans.ranking import _RANK, rounded

Q: dict = {}
S: dict = {}
COLS = D.Features("logits", "x")


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


H = shapes.SQL_HEAD
_LSE = "(list_max({z}) + ln({m}))"


def lse(z: str) -> str:
    return f"(list_max({z}) + ln({V.sql_softmax_mass(z)}))"


def test_rows(spark, d):
    f, head = shapes.with_logits(spark, d)
    return f.where("train"), f.where("not train"), head


def scored(det: D.Detector, spark, d, y: str | None = None, digits: int = 6) -> DataFrame:
    train, test, _ = test_rows(spark, d)
    return rounded(det.fit(train, y).transform(test).select("sample_id", "score"), digits)


@query(f"WITH {H} SELECT sample_id, round(-1.0::DOUBLE / {V.sql_softmax_mass('z')}, 6) AS score FROM lg WHERE NOT train")
def msp_scores(spark: SparkSession, d: str) -> DataFrame:
    return scored(D.MSP(features=COLS), spark, d)


@query(f"WITH {H} SELECT sample_id, round(-{lse('z')}, 6) AS score FROM lg WHERE NOT train")
def energy_scores(spark, d):
    return scored(D.Energy(features=COLS), spark, d)


@query(f"WITH {H}, s AS (SELECT sample_id, train, list_transform(z, lambda v: v / 2.0::DOUBLE) AS z FROM lg) SELECT sample_id, round(-2.0::DOUBLE * {lse('z')}, 6) AS score FROM s WHERE NOT train")
def energy_scores_t2(spark, d):
    return scored(D.Energy(2.0, features=COLS), spark, d)


@query(f"WITH {H} SELECT sample_id, CAST(-1.0::DOUBLE / {V.sql_softmax_mass('z')} > -0.13::DOUBLE AS INTEGER) AS prediction FROM lg WHERE NOT train")
def msp_predict(spark, d):
    train, test, _ = test_rows(spark, d)
    return D.MSP(features=COLS).fit(train).predict(test, -0.13).select("sample_id", "prediction")


def _knn(dist: str) -> str:
    return f"WITH feat AS ({shapes.SQL_FEAT}), p AS (SELECT q.sample_id, {dist} AS v, row_number() OVER (PARTITION BY q.sample_id ORDER BY {dist}) AS r FROM feat q, feat t WHERE t.train AND NOT q.train) SELECT sample_id, round(v, 5) AS score FROM p WHERE r = 10"


_COS = "1 - list_cosine_similarity(q.x, t.x)"


@query(_knn("list_distance(q.x, t.x)"))
def knn_scores(spark, d):
    return scored(D.KNN(10, features=COLS), spark, d, digits=5)


@query(_knn(_COS))
def knn_scores_cosine(spark, d):
    return scored(D.KNN(10, "cosine", features=COLS), spark, d, digits=5)


@query(_knn("list_sum(list_transform(range(1, 65), lambda i: abs(q.x[i] - t.x[i])))"))
def knn_scores_manhattan(spark, d):
    return scored(D.KNN(10, "manhattan", features=COLS), spark, d, digits=5)


@query(_knn("list_max(list_transform(range(1, 65), lambda i: abs(q.x[i] - t.x[i])))"))
def knn_scores_chebyshev(spark, d):
    return scored(D.KNN(10, "chebyshev", features=COLS), spark, d, digits=5)


def _blocks(metric: str, spark, d) -> DataFrame:
    """A bank beyond the limit of a broadcast, in several blocks."""
    return scored(D.KNN(10, metric, COLS, bank_limit=1000, block_numbers=4000), spark, d, digits=5)


@query(_knn("list_distance(q.x, t.x)"))
def knn_scores_blocks(spark, d):
    return _blocks("euclidean", spark, d)


@query(_knn(_COS))
def knn_scores_blocks_cosine(spark, d):
    return _blocks("cosine", spark, d)


@query(_knn("list_sum(list_transform(range(1, 65), lambda i: abs(q.x[i] - t.x[i])))"))
def knn_scores_blocks_manhattan(spark, d):
    return _blocks("manhattan", spark, d)


@query(_knn("list_max(list_transform(range(1, 65), lambda i: abs(q.x[i] - t.x[i])))"))
def knn_scores_blocks_chebyshev(spark, d):
    return _blocks("chebyshev", spark, d)


def gauss_jordan(out: str, source: str, n: int) -> str:
    """CTEs that invert a positive definite DOUBLE[][]: ``source`` has m; ``out`` gets inv."""
    return f"""{out}_a AS (SELECT list_transform(m, lambda r, i: list_concat(r, list_transform(range(1, {n + 1}), lambda j: CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END))) AS m FROM {source}),
{out}_g(k, m) AS (SELECT 1, m FROM {out}_a UNION ALL SELECT k + 1, list_transform(m, lambda r, i: CASE WHEN i = k THEN p ELSE list_transform(range(1, {2 * n + 1}), lambda j: r[j] - r[k] * p[j]) END) FROM (SELECT k, m, list_transform(m[k], lambda v: v / m[k][k]) AS p FROM {out}_g WHERE k <= {n})),
{out} AS (SELECT list_transform(m, lambda r: r[{n + 1}:{2 * n}]) AS inv FROM {out}_g WHERE k = {n + 1})"""


_CLASS = """cm AS (SELECT c, list(m ORDER BY i) AS v FROM mu GROUP BY c), cn AS (SELECT label AS c, count(*) AS n FROM feat WHERE train GROUP BY label),
dv AS (SELECT sample_id, i, x[i] - m AS v FROM feat, dims JOIN mu USING (i) WHERE train AND mu.c = label),
sw AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM dv a JOIN dv b USING (sample_id) GROUP BY 1, 2)"""
_MAHA = f"""WITH RECURSIVE {H}, {_CLASS}, nn AS (SELECT sum(n) AS n, count(*) AS c FROM cn),
mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v / (n - c) + CASE WHEN i = j THEN 1e-6::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) AS r FROM sw, nn GROUP BY i)),
{gauss_jordan('prec', 'mat', 64)},
df AS (SELECT sample_id, c, list_transform(range(1, 65), lambda i: x[i] - v[i]) AS e FROM feat, cm WHERE NOT train)
SELECT sample_id, round(min(list_dot_product(list_transform(inv, lambda r: list_dot_product(r, e)), e)), 5) AS score FROM df, prec GROUP BY sample_id"""


@query(_MAHA)
def mahalanobis_scores(spark, d):
    return scored(D.Mahalanobis(features=COLS), spark, d, "label", 5)


_WDISC = f"""WITH RECURSIVE {H}, {_CLASS}, gm AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(x[i]) AS m FROM feat, dims WHERE train GROUP BY i)),
mat AS (SELECT list(r ORDER BY i) AS m FROM (SELECT i, list(v + CASE WHEN i = j THEN 1e-3::DOUBLE ELSE 0.0::DOUBLE END ORDER BY j) AS r FROM sw GROUP BY i)),
{gauss_jordan('swi', 'mat', 64)},
a AS (SELECT c, list_transform(inv, lambda r: list_dot_product(r, dl)) AS a FROM (SELECT c, list_transform(range(1, 65), lambda i: v[i] - g[i]) AS dl FROM cm, gm WHERE c < 7), swi),
gram AS (SELECT list(r ORDER BY c) AS m FROM (SELECT p.c, list(list_dot_product(p.a, q.a) ORDER BY q.c) AS r FROM a p, a q GROUP BY p.c)),
{gauss_jordan('gi', 'gram', 7)},
e AS (SELECT sample_id, train, c, list_transform(range(1, 65), lambda i: x[i] - v[i]) AS e FROM feat, (SELECT c, v FROM cm UNION ALL SELECT -1, g FROM gm)),
u AS (SELECT sample_id, any_value(train) AS train, e.c, any_value(e) AS e, list(list_dot_product(a.a, e.e) ORDER BY a.c) AS u FROM e, a GROUP BY sample_id, e.c),
q AS (SELECT sample_id, train, c, list_dot_product(list_transform(inv, lambda r: list_dot_product(r, u)), u) AS inside, list_dot_product(e, e) AS whole FROM u, gi),
dist AS (SELECT sample_id, any_value(train) AS train, sqrt(min(CASE WHEN c >= 0 THEN inside END)) AS wd, sqrt(max(CASE WHEN c < 0 THEN greatest(whole - inside, 0) END)) AS wdr FROM q GROUP BY sample_id),
med AS (SELECT quantile_cont(wd, 0.5) AS a, quantile_cont(wdr, 0.5) AS b FROM dist WHERE train)
SELECT sample_id, round(wd / (a + 1e-12) + wdr / (b + 1e-12), 5) AS score FROM dist, med WHERE NOT train"""


@query(_WDISC)
def wdiscood_scores(spark, d):
    return scored(D.WDiscOOD(features=COLS), spark, d, "label", 5)


#: levels between the eigenvalues kept and dropped at sf0.01 (the oracle checks the rank they imply)
_TAU_MEAN, _TAU_ORIGIN = 1.2687344438534922, 1.3183620923417516


def principal_projector(rows: str, center: str, tau: float) -> str:
    """CTEs: pp.p, the projector on the eigenvectors of the scatter of ``rows`` (sample_id, train, w) about ``center`` (g) with eigenvalues above tau, by Newton-Schulz sign iteration."""
    return f"""dc AS (SELECT sample_id, i, w[i] - g[i] AS v FROM {rows}, {center}, dims WHERE train),
sc AS (SELECT a.i, b.i AS j, sum(a.v * b.v) AS v FROM dc a JOIN dc b USING (sample_id) GROUP BY 1, 2), tc AS (SELECT sum(v) AS t FROM sc WHERE i = j),
x0 AS (SELECT list(r ORDER BY i) AS x FROM (SELECT i, list((v - CASE WHEN i = j THEN {tau!r}::DOUBLE ELSE 0.0::DOUBLE END) / t ORDER BY j) AS r FROM sc, tc GROUP BY i)),
ns(k, x) AS (SELECT 0, x FROM x0 UNION ALL SELECT k + 1, list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: 1.5::DOUBLE * x[i][j] - 0.5::DOUBLE * list_dot_product(y[i], x[j]))) FROM (SELECT k, x, list_transform(x, lambda r: list_transform(x, lambda c: list_dot_product(r, c))) AS y FROM ns WHERE k < 30)),
pp AS (SELECT list_transform(range(1, 65), lambda i: list_transform(range(1, 65), lambda j: (x[i][j] + CASE WHEN i = j THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) / 2)) AS p FROM ns WHERE k = 30),
rk AS (SELECT CAST(round(list_sum(list_transform(range(1, 65), lambda i: p[i][i]))) AS INTEGER) AS k FROM pp)"""


_GM = "gm AS (SELECT list(m ORDER BY i) AS g FROM (SELECT i, avg(w[i]) AS m FROM ws, dims WHERE train GROUP BY i))"


def _pca(ws: str, score: str) -> str:
    return f"""WITH RECURSIVE {H}, ws AS ({ws}), {_GM}, {principal_projector('ws', 'gm', _TAU_MEAN)},
rs AS (SELECT sample_id, list_transform(range(1, 65), lambda i: w[i] - g[i]) AS e FROM ws, gm WHERE NOT train),
er AS (SELECT sample_id, sqrt(list_dot_product(e, e) - list_dot_product(list_transform(p, lambda r: list_dot_product(r, e)), e)) AS err FROM rs, pp)
SELECT sample_id, k, {score} FROM er, rk"""


_UNIT = "SELECT sample_id, train, list_transform(x, lambda v: v / sqrt(list_dot_product(x, x))) AS w FROM feat"


def _with_rank(det: D.PCA, df: DataFrame, digits: int = 5) -> DataFrame:
    return rounded(det.transform(df).select("sample_id", F.lit(det.n_components_fitted).alias("k"), "score"), digits)


@query(_pca("SELECT sample_id, train, x AS w FROM feat", "round(err, 5) AS score"))
def pca_scores(spark, d):
    train, test, _ = test_rows(spark, d)
    return _with_rank(D.PCA(features=COLS).fit(train), test)


@query(_pca(_UNIT, "round(err, 5) AS score"))
def pca_scores_cosine(spark, d):
    train, test, _ = test_rows(spark, d)
    scale = F.transform("x", lambda v: v * (1 + F.col("sample_id") % 5))
    return _with_rank(D.PCA("cosine", features=COLS).fit(train.withColumn("x", scale)), test.withColumn("x", scale))


@query()
def pca_scores_rff(spark, d):
    return scored(D.PCA("rff_cosine", random_state=3, features=COLS), spark, d)


@query()
def pca_explained(spark, d):
    train, _, _ = test_rows(spark, d)
    return rounded(D.PCA(features=COLS).fit(train).explained_variance(spark))


@query(_pca("SELECT sample_id, train, x AS w FROM feat", "err").replace("SELECT sample_id, k, err FROM er, rk", f"SELECT sample_id, k, round(-(1 - least(1.0::DOUBLE, err / sqrt(list_dot_product(x, x)))) * {lse('z')}, 5) AS score FROM er JOIN lg USING (sample_id), rk"))
def pca_fusion_scores(spark, d):
    train, test, _ = test_rows(spark, d)
    return _with_rank(D.PCAFusion(features=COLS).fit(train), test)


_VIM = f"""WITH RECURSIVE {H}, cm AS (SELECT c, list(m ORDER BY i) AS v FROM mu GROUP BY c), wm AS (SELECT list(r ORDER BY c) AS m FROM (SELECT a.c, list(list_dot_product(a.v, b.v) ORDER BY b.c) AS r FROM cm a, cm b GROUP BY a.c)),
{gauss_jordan('wi', 'wm', 8)}, bb AS (SELECT list(b ORDER BY c) AS b FROM head),
oc AS (SELECT list_transform(inv, lambda r: list_dot_product(r, b)) AS u FROM wi, bb), og AS (SELECT list(v ORDER BY i) AS g FROM (SELECT i, -sum(v[i] * u[c + 1]) AS v FROM cm, oc, dims GROUP BY i)),
ws AS (SELECT sample_id, train, x AS w FROM feat), {principal_projector('ws', 'og', _TAU_ORIGIN)},
es AS (SELECT sample_id, list_transform(range(1, 65), lambda i: w[i] - g[i]) AS e FROM ws, og),
er AS (SELECT sample_id, sqrt(list_dot_product(e, e) - list_dot_product(list_transform(p, lambda r: list_dot_product(r, e)), e)) AS r FROM es, pp),
al AS (SELECT avg(list_max(z)) / (avg(r) + 1e-12) AS a FROM er JOIN lg USING (sample_id) WHERE train)
SELECT sample_id, k, round(1.0::DOUBLE / (1.0::DOUBLE + exp({lse('z')} - a * r)), 6) AS score FROM er JOIN lg USING (sample_id), al, rk WHERE NOT train"""


@query(_VIM)
def vim_scores(spark, d):
    train, test, (W, b) = test_rows(spark, d)
    det = D.ViM(W, b, features=COLS).fit(train)
    return rounded(det.transform(test).select("sample_id", F.lit(det.k).alias("k"), "score"))


def embedding_bank(spark, d) -> ScoreBank:
    train, test, (W, b) = test_rows(spark, d)
    dets = {"msp": D.MSP(features=COLS), "energy": D.Energy(features=COLS), "knn": D.KNN(10, features=COLS), "mahalanobis": D.Mahalanobis(features=COLS), "pca": D.PCA(features=COLS), "pca_fusion": D.PCAFusion(features=COLS), "vim": D.ViM(W, b, features=COLS), "wdiscood": D.WDiscOOD(features=COLS)}
    D.fit_all(dets, train, "label")
    df = test
    for name, det in dets.items():
        df = det.transform(df, name)
    return ScoreBank.of(df, {n: n for n in dets}, ood="ood", class_id="label").saved()


@query()
def evaluate_detectors(spark, d):
    """All eight detectors against the held-out classes."""
    return rounded(metrics.evaluate(embedding_bank(spark, d)))


@query(f"""WITH {H}, long AS (SELECT sample_id, CAST(ood AS INTEGER) AS ood, 'energy' AS detector, CAST(-{lse('z')} AS FLOAT) AS score FROM lg WHERE NOT train), {_RANK.format(keys='detector', src='long')}
SELECT detector, round(sum(CASE WHEN ood = 0 THEN tp END) / (max(n_pos) * (max(n) - max(n_pos)))::DOUBLE, 6) AS auroc FROM r GROUP BY detector""")
def energy_auroc(spark, d):
    """Head by class means, energy of the logits, bank, AUROC."""
    train, test, _ = test_rows(spark, d)
    bank = ScoreBank.of(D.Energy(features=COLS).fit(train).transform(test), {"energy": "score"}, ood="ood")
    return rounded(metrics.evaluate(bank).select("detector", "auroc"))


@query(f"WITH {H} SELECT sample_id, list_position(z, list_max(z)) - 1 = label AS correct, list_position(z, list_max(z)) - 1 = label AND 1.0::DOUBLE / {V.sql_softmax_mass('z')} >= 0.13::DOUBLE AS sure FROM lg")
def correct_predictions(spark, d):
    f, _ = shapes.with_logits(spark, d)
    return f.select("sample_id", masks.correct_prediction("logits", "label").alias("correct"), masks.correct_prediction("logits", "label", 0.13).alias("sure"))


@query(f"WITH {H}, n AS (SELECT sample_id, x, sqrt(list_sum(list_transform(x, lambda v: v * v))) AS r FROM feat) SELECT sample_id, round(r, 6) AS norm, round(list_dot_product(x, x), 6) AS dot, round(list_sum(list_transform(x, lambda v: v / greatest(r, 1e-12::DOUBLE))), 6) AS unit_sum FROM n")
def vector_functions(spark, d):
    f = shapes.features(spark, d)
    x = F.col("x")
    return rounded(f.select("sample_id", V.norm(x).alias("norm"), V.dot(x, x).alias("dot"), F.aggregate(V.row_normalize(x), F.lit(0.0), lambda a, v: a + v).alias("unit_sum")))


@query(f"WITH {H} SELECT count(*) AS n, round(avg(list_max(z)), 6) AS mean_top FROM lg WHERE train AND label = list_position(z, list_max(z)) - 1")
def fit_on_correct(spark, d):
    """A detector fitted on the rows that the head gets right: how many there are, and their mean top logit."""
    f, _ = shapes.with_logits(spark, d)
    f = f.withColumn("ok", F.col("train") & masks.correct_prediction("logits", "label"))
    masks.fit_on_mask(D.Mahalanobis(features=COLS), f, "ok", "label", 10)
    return rounded(masks.subset(f, "ok").agg(F.count(F.lit(1)).alias("n"), F.avg(F.array_max("logits")).alias("mean_top")))


def detector_anchors(spark, d) -> dict[str, tuple[float, float]]:
    """Mean score and AUROC of each detector, for tests."""
    b = embedding_bank(spark, d)
    means = b.df.agg(*[F.avg(F.col(x).cast("double")).alias(x) for x in b.detectors]).head()
    return {r["detector"]: (means[r["detector"]], r["auroc"]) for r in metrics.evaluate(b).collect()}
