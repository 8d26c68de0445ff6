"""Queries on the score bank: metrics, ranks, bins, analyses."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.operators import analysis, binning, compare, masks, metrics
from skewline.plans import shapes

Q: dict = {}
S: dict = {}


def query(sql: str | None = None):
    def keep(f):
        Q[f.__name__] = f
        if sql:
            S[f.__name__] = sql
        return f

    return keep


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*[F.round(F.col(f.name).cast("double"), digits).alias(f.name) if f.dataType.simpleString() in ("double", "float") else F.col(f.name) for f in df.schema.fields])


B = shapes.SQL_BANK
_RANK = """r AS (SELECT *, row_number() OVER w AS k, sum(ood) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(ood) OVER (PARTITION BY {keys}) AS n_pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC, sample_id)),
ri AS (SELECT *, row_number() OVER w AS k, sum(1 - ood) OVER (w ROWS UNBOUNDED PRECEDING) AS tp, sum(1 - ood) OVER (PARTITION BY {keys}) AS n_pos, count(*) OVER (PARTITION BY {keys}) AS n FROM {src} WINDOW w AS (PARTITION BY {keys} ORDER BY score ASC, sample_id))"""


def _summary(keys: str, src: str = "long", extra: str = "") -> str:
    step = "(tp / k::DOUBLE + CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE (tp - 1) / (k - 1)::DOUBLE END) / 2"
    return f"""WITH {B}{extra}, {_RANK.format(keys=keys, src=src)},
roc AS (SELECT {keys}, max(n_pos) AS p, max(n) - max(n_pos) AS q, sum(CASE WHEN ood = 0 THEN tp END) AS area, min(CASE WHEN tp / nullif(n_pos, 0)::DOUBLE >= 0.95::DOUBLE THEN k - tp END) AS fp, min(0.5::DOUBLE * ((k - tp) / nullif(n - n_pos, 0)::DOUBLE + 1 - tp / nullif(n_pos, 0)::DOUBLE)) AS err FROM r GROUP BY {keys}),
po AS (SELECT {keys}, sum(CASE WHEN ood = 1 THEN {step} END) / nullif(max(n_pos), 0) AS v FROM r GROUP BY {keys}),
pi AS (SELECT {keys}, sum(CASE WHEN ood = 0 THEN {step} END) / nullif(max(n_pos), 0) AS v FROM ri GROUP BY {keys})
SELECT {keys}, round(CASE WHEN p > 0 AND q > 0 THEN area / (p * q)::DOUBLE END, 6) AS auroc, round(CASE WHEN p > 0 AND q > 0 THEN coalesce(fp / q::DOUBLE, 1.0) END, 6) AS fpr95,
 round(CASE WHEN p > 0 AND q > 0 THEN po.v END, 6) AS aupr_ood, round(CASE WHEN p > 0 AND q > 0 THEN pi.v END, 6) AS aupr_id, round(CASE WHEN p > 0 AND q > 0 THEN least(0.5::DOUBLE, err) END, 6) AS det_err
FROM roc JOIN po USING ({keys}) JOIN pi USING ({keys})"""


@query(_summary("detector"))
def evaluate(spark: SparkSession, d: str) -> DataFrame:
    return rounded(metrics.evaluate(shapes.bank(spark, d)))


@query(_summary("class_id, detector"))
def evaluate_by_class(spark, d):
    return rounded(metrics.evaluate_by_class(shapes.bank(spark, d), strict=False))


@query(f"WITH {B}, {_RANK.format(keys='detector', src='long')} SELECT detector, CAST(k AS BIGINT) AS k, round((k - tp) / (n - n_pos)::DOUBLE, 6) AS fpr, round(tp / n_pos::DOUBLE, 6) AS tpr FROM r UNION ALL SELECT DISTINCT detector, CAST(0 AS BIGINT), 0.0::DOUBLE, 0.0::DOUBLE FROM long")
def roc_curve(spark, d):
    return rounded(metrics.roc_points(shapes.bank(spark, d).long("ood")))


def _pr(side: str) -> str:
    return f"WITH {B}, {_RANK.format(keys='detector', src='long')} SELECT detector, CAST(k AS BIGINT) AS k, round(tp / n_pos::DOUBLE, 6) AS recall, round(tp / k::DOUBLE, 6) AS precision FROM {side} UNION ALL SELECT DISTINCT detector, CAST(0 AS BIGINT), 0.0::DOUBLE, 1.0::DOUBLE FROM long"


@query(_pr("r"))
def pr_curve_ood(spark, d):
    return rounded(metrics.pr_points(shapes.bank(spark, d).long("ood"), "ood"))


@query(_pr("ri"))
def pr_curve_id(spark, d):
    return rounded(metrics.pr_points(shapes.bank(spark, d).long("ood"), "id"))


@query(f"WITH {B} SELECT sample_id, CAST(row_number() OVER (ORDER BY a, sample_id) - 1 AS BIGINT) AS a, CAST(row_number() OVER (ORDER BY b, sample_id) - 1 AS BIGINT) AS b FROM bank")
def ordinal_ranks(spark, d):
    return compare.ordinal_ranks(shapes.bank(spark, d))


@query(f"WITH {B} SELECT CAST(row_number() OVER (ORDER BY b DESC, sample_id) - 1 AS BIGINT) AS rank, sample_id, b AS score, class_id, grp, ood FROM bank QUALIFY rank < 20")
def rank_samples_ood(spark, d):
    return compare.rank_samples(shapes.bank(spark, d), "b")


@query(f"WITH {B} SELECT CAST(row_number() OVER (ORDER BY b, sample_id) - 1 AS BIGINT) AS rank, sample_id, b AS score, class_id, grp, ood FROM bank QUALIFY rank >= 10 AND rank < 25")
def rank_samples_range(spark, d):
    return compare.rank_samples(shapes.bank(spark, d), "b", direction="id", rank_range=(10, 25))


@query(f"WITH {B} SELECT CAST(row_number() OVER (ORDER BY a DESC, sample_id) - 1 AS BIGINT) AS rank, sample_id, a AS score, class_id, grp, ood FROM bank WHERE class_id = 2 AND grp = 'error' AND ood = 1 QUALIFY rank < 9")
def rank_grid(spark, d):
    return compare.rank_grid(shapes.bank(spark, d), "a", 9, class_id="c2", group="error", ood=1)


@query(f"WITH {B}, k AS (SELECT sample_id, row_number() OVER (ORDER BY a, sample_id) - 1 AS rank_a, row_number() OVER (ORDER BY b, sample_id) - 1 AS rank_b FROM bank) SELECT sample_id, CAST(rank_a AS BIGINT) AS rank_a, CAST(rank_b AS BIGINT) AS rank_b, CAST(abs(rank_a - rank_b) AS BIGINT) AS gap FROM k ORDER BY gap DESC, sample_id LIMIT 20")
def disagreements(spark, d):
    return compare.disagreements(shapes.bank(spark, d), "a", "b")


def _corr(src: str) -> str:
    return f"""WITH {B}, k AS (SELECT {src} FROM bank), c AS (SELECT round(corr(a, b), 6) AS v FROM k)
SELECT 'a' AS detector_a, 'b' AS detector_b, v AS corr FROM c UNION ALL SELECT 'b', 'a', v FROM c UNION ALL SELECT 'a', 'a', 1.0::DOUBLE UNION ALL SELECT 'b', 'b', 1.0::DOUBLE"""


@query(_corr("(row_number() OVER (ORDER BY a, sample_id))::DOUBLE AS a, (row_number() OVER (ORDER BY b, sample_id))::DOUBLE AS b"))
def correlation_spearman(spark, d):
    return rounded(compare.score_correlation(shapes.bank(spark, d)))


@query(_corr("a::DOUBLE AS a, b::DOUBLE AS b"))
def correlation_pearson(spark, d):
    return rounded(compare.score_correlation(shapes.bank(spark, d), "pearson"))


@query(f"WITH {B} SELECT sample_id, ood, class_id, round(((a::DOUBLE - avg(a::DOUBLE) OVER ()) / stddev_pop(a::DOUBLE) OVER ())::FLOAT::DOUBLE, 4) AS a, round(((b::DOUBLE - avg(b::DOUBLE) OVER ()) / stddev_pop(b::DOUBLE) OVER ())::FLOAT::DOUBLE, 4) AS b, round(m::DOUBLE, 4) AS m FROM bank")
def normalize_standardize(spark, d):
    return rounded(compare.normalize_scores(shapes.bank(spark, d)).df, 4)


@query(f"WITH {B} SELECT sample_id, ood, class_id, round(((a::DOUBLE - min(a::DOUBLE) OVER ()) / (max(a::DOUBLE) OVER () - min(a::DOUBLE) OVER ()))::FLOAT::DOUBLE, 5) AS a, round(((b::DOUBLE - min(b::DOUBLE) OVER ()) / (max(b::DOUBLE) OVER () - min(b::DOUBLE) OVER ()))::FLOAT::DOUBLE, 5) AS b, round(m::DOUBLE, 5) AS m FROM bank")
def normalize_minmax(spark, d):
    return rounded(compare.normalize_scores(shapes.bank(spark, d), "minmax").df, 5)


@query(f"WITH {B} SELECT detector, class_id, grp, count(*) AS n, round(sum(score::DOUBLE), 3) AS total FROM long GROUP BY ALL")
def bank_by_class_and_group(spark, d):
    return shapes.bank(spark, d).long("class_id", "grp").groupBy("detector", "class_id", "grp").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum(F.col("score").cast("double")), 3).alias("total"))


@query(f"WITH {B}, ids AS (SELECT unnest([7, 3, 7, 11]) AS i, unnest([0, 1, 2, 3]) AS pos) SELECT CAST(pos AS BIGINT) AS sample_id, ood, class_id, grp, a, b, m FROM ids JOIN bank ON i = bank.sample_id")
def bank_subset(spark, d):
    return shapes.bank(spark, d).subset([7, 3, 7, 11]).df


@query(f"""WITH {B}, e AS (SELECT detector, quantile_cont(score::DOUBLE, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS e FROM long GROUP BY detector),
p AS (SELECT l.detector, len(list_filter(e[2:10], lambda x: x <= l.score::DOUBLE)) AS bin, m FROM long l JOIN e USING (detector) JOIN (SELECT sample_id, m FROM bank) USING (sample_id)),
g AS (SELECT detector, bin, avg(m::DOUBLE) AS v, count(*) AS n FROM p GROUP BY ALL), s AS (SELECT detector, e, unnest(range(10)) AS bin FROM e)
SELECT detector, CAST(bin AS INTEGER) AS bin, round(e[bin + 1], 6) AS "left", round(e[bin + 2], 6) AS "right", round((e[bin + 1] + e[bin + 2]) / 2, 6) AS center, round(v, 6) AS mean_metric, coalesce(n, 0) AS n_samples FROM s LEFT JOIN g USING (detector, bin)""")
def score_vs_metric(spark, d):
    return rounded(binning.score_vs_metric(shapes.bank(spark, d), "m"))


@query(f"""WITH {B}, v AS (SELECT ood AS y, b::DOUBLE / 125 AS p FROM bank), e AS (SELECT [0.1, 0.2, 0.30000000000000004, 0.4, 0.5, 0.6000000000000001, 0.7000000000000001, 0.8, 0.9]::DOUBLE[] AS e),
g AS (SELECT len(list_filter(e, lambda x: x <= p)) AS bin, count(*) AS n, avg(p) AS mp, avg(y) AS ob FROM v, e GROUP BY 1)
SELECT CAST(b.bin AS INTEGER) AS bin, round(CASE WHEN b.bin = 0 THEN 0 ELSE e[b.bin] END, 6) AS "left", round(CASE WHEN b.bin = 9 THEN 1 ELSE e[b.bin + 1] END, 6) AS "right", coalesce(n, 0) AS n, round(mp, 6) AS mean_predicted, round(ob, 6) AS observed FROM (SELECT unnest(range(10)) AS bin) b CROSS JOIN e LEFT JOIN g ON g.bin = b.bin""")
def calibration_bins(spark, d):
    return rounded(binning.calibration_bins(shapes.bank(spark, d).df.select(F.col("ood").alias("y"), (F.col("b").cast("double") / 125).alias("p")), "y", "p"))


@query(f"""WITH {B}, s AS (SELECT detector, min(score::DOUBLE) AS lo, max(score::DOUBLE) AS hi FROM long GROUP BY 1), t AS (SELECT detector, CASE WHEN ood = 1 THEN 'ood' ELSE 'id' END AS pool, score::DOUBLE AS v FROM long),
g AS (SELECT detector, pool, CAST(least(floor((v - lo) / ((hi - lo) / 12)), 11) AS INTEGER) AS bin, count(*) AS n FROM t JOIN s USING (detector) GROUP BY ALL), c AS (SELECT detector, pool, count(*) AS total FROM t GROUP BY ALL)
SELECT detector, pool, CAST(bin AS INTEGER) AS bin, round(lo + bin * ((hi - lo) / 12), 6) AS "left", round(lo + (bin + 1) * ((hi - lo) / 12), 6) AS "right", coalesce(n, 0) AS n, round(coalesce(n, 0) / (total * ((hi - lo) / 12)), 6) AS density FROM (SELECT detector, pool, total, unnest(range(12)) AS bin FROM c) JOIN s USING (detector) LEFT JOIN g USING (detector, pool, bin)""")
def score_histogram(spark, d):
    return rounded(binning.score_histogram(shapes.bank(spark, d), 12))


@query(f"""WITH {B}, t AS (SELECT detector, CASE WHEN ood = 1 THEN 'ood' ELSE 'id' END AS pool, score::DOUBLE AS v FROM long), s AS (SELECT detector, pool, count(*) AS n, stddev_samp(v) * pow(count(*)::DOUBLE, -0.2::DOUBLE) AS h, min(v) - 0.05::DOUBLE * (max(v) - min(v)) AS a, max(v) + 0.05::DOUBLE * (max(v) - min(v)) AS b FROM t GROUP BY ALL),
p AS (SELECT *, unnest(range(16)) AS point FROM s), q AS (SELECT detector, pool, point, n, h, a + point * ((b - a) / 15) AS x FROM p)
SELECT detector, pool, CAST(point AS INTEGER) AS point, round(x, 6) AS x, round(sum(exp(-0.5::DOUBLE * pow((x - v) / h, 2))) / (n * h * sqrt(2 * pi())), 6) AS density FROM q JOIN t USING (detector, pool) GROUP BY detector, pool, point, x, n, h""")
def score_kde(spark, d):
    return rounded(binning.score_kde(shapes.bank(spark, d), grid=16))


@query(f"""WITH {B}, v AS (SELECT detector, ood AS y, score::DOUBLE AS p FROM long), g AS (SELECT detector, p, sum(y) AS pos, count(*) AS n, sum(pow(p - y, 2)) AS sq FROM v GROUP BY ALL),
c AS (SELECT *, sum(pos) OVER w AS tp, sum(n) OVER w AS k, sum(pos) OVER (PARTITION BY detector) AS np, sum(n) OVER (PARTITION BY detector) AS nn FROM g WINDOW w AS (PARTITION BY detector ORDER BY p DESC))
SELECT detector, round(sum((n - pos) * (tp - pos / 2.0::DOUBLE)) / (max(np) * (max(nn) - max(np))), 6) AS auroc, round(sum(pos * tp / k::DOUBLE) / max(np), 6) AS average_precision, round(sum(sq) / max(nn), 4) AS brier, CAST(max(nn) AS BIGINT) AS n FROM c GROUP BY detector""")
def classification_metrics(spark, d):
    out = metrics.classification_metrics(shapes.bank(spark, d).long("ood").withColumnRenamed("ood", "y"), ["detector"], p="score")
    return rounded(out).withColumn("brier", F.round("brier", 4))


@query(_summary("class_id", "hc", ", n0 AS (SELECT class_id, CAST(count_if(ood = 0) AS BIGINT) AS n_id, CAST(count_if(ood = 1) AS BIGINT) AS n_ood FROM bank GROUP BY 1), hc AS (SELECT sample_id, ood, class_id, a AS score FROM bank)").replace("SELECT class_id, round", "SELECT class_id, n_id, n_ood, round").split(", round(CASE WHEN p > 0 AND q > 0 THEN coalesce")[0] + " FROM roc JOIN n0 USING (class_id) ORDER BY auroc, class_id LIMIT 3")
def hardest_classes(spark, d):
    return rounded(analysis.hardest_classes(shapes.bank(spark, d), "a", top_k=3).select("class_id", "n_id", "n_ood", "auroc"))


@query(f"""WITH {B}, o AS (SELECT * FROM bank WHERE ood = 1 AND grp <> 'click'), pr AS (SELECT DISTINCT class_id, grp FROM o), u AS (SELECT sample_id, class_id, grp, ood, a AS score FROM o UNION ALL SELECT sample_id, b.class_id, pr.grp, ood, a FROM bank b JOIN pr ON b.class_id = pr.class_id WHERE ood = 0 AND b.grp = 'click'),
r AS (SELECT *, sum(ood) OVER (PARTITION BY class_id, grp ORDER BY score DESC, sample_id ROWS UNBOUNDED PRECEDING) AS tp FROM u)
SELECT class_id, grp, round(sum(CASE WHEN ood = 0 THEN tp END) / (sum(ood) * sum(1 - ood))::DOUBLE, 6) AS auroc, CAST(sum(1 - ood) AS BIGINT) AS n_id, CAST(sum(ood) AS BIGINT) AS n_ood FROM r GROUP BY class_id, grp""")
def auroc_by_class_and_group(spark, d):
    return rounded(analysis.auroc_by_class_and_group(shapes.bank(spark, d), "a", "click"))


@query(f"WITH {B} SELECT detector, class_id, CAST(row_number() OVER (PARTITION BY detector, class_id ORDER BY score DESC, sample_id) AS INTEGER) AS rank, sample_id, score FROM long QUALIFY rank <= 4")
def top_chips(spark, d):
    return analysis.top_chips(shapes.bank(spark, d), 4)


@query(f"WITH {B} SELECT grp, count(*) AS n, round(avg(a::DOUBLE), 6) AS mean, round(quantile_cont(a::DOUBLE, 0.1), 6) AS p10, round(quantile_cont(a::DOUBLE, 0.9), 6) AS p90 FROM bank GROUP BY grp HAVING count(*) >= 5")
def group_summary(spark, d):
    return rounded(analysis.group_summary(shapes.bank(spark, d).df.withColumn("a", F.col("a").cast("double")), "grp", "a"))


@query(f"WITH {B}, s AS (SELECT avg(a::DOUBLE) AS ma, stddev_pop(a::DOUBLE) AS sa, avg(b::DOUBLE) AS mb, stddev_pop(b::DOUBLE) AS sb FROM bank WHERE ood = 0) SELECT sample_id, round((a::DOUBLE - ma) / sa, 6) AS z_a, round((b::DOUBLE - mb) / sb, 6) AS z_b, round((a::DOUBLE - ma) / sa + (b::DOUBLE - mb) / sb, 6) AS fused FROM bank, s")
def zscore_fusion(spark, d):
    z = analysis.zscore_on_id(shapes.bank(spark, d).df.select("sample_id", "ood", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b")), ("a", "b"))
    return rounded(z.select("sample_id", "z_a", "z_b", analysis.safe_add(F.col("z_a"), F.col("z_b")).alias("fused")))


@query(f"WITH {B} SELECT 'a' AS a, 'b' AS b, round(corr(a::DOUBLE, b::DOUBLE), 6) AS corr, count(*) AS n FROM bank")
def fusion_correlation(spark, d):
    return rounded(analysis.fusion_correlation(shapes.bank(spark, d).df, ("a", "b")))


@query(f"WITH {B}, s AS (SELECT avg(a::DOUBLE) AS ma, stddev_pop(a::DOUBLE) AS sa, avg(b::DOUBLE) AS mb, stddev_pop(b::DOUBLE) AS sb FROM bank WHERE ood = 0), z AS (SELECT sample_id, ood, (a::DOUBLE - ma) / sa AS za, (b::DOUBLE - mb) / sb AS zb FROM bank, s) SELECT sample_id, ood, round(za, 6) AS z_a, round(zb, 6) AS z_b, round(za - zb, 6) AS gap FROM z ORDER BY abs(za - zb) DESC, sample_id LIMIT 10")
def fusion_disagreement(spark, d):
    df = shapes.bank(spark, d).df.select("sample_id", "ood", F.col("a").cast("double").alias("a"), F.col("b").cast("double").alias("b"))
    return rounded(analysis.fusion_disagreement(df, "a", "b", 10, "sample_id"))


@query(f"WITH {B}, k AS (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY md5('7:' || sample_id), sample_id) AS r, count(*) OVER (PARTITION BY grp) AS n FROM bank) SELECT sample_id, grp FROM k WHERE r <= greatest(1, least(round_even(n * 0.15::DOUBLE, 0), n))")
def stratified_sample(spark, d):
    return masks.stratified(shapes.bank(spark, d).df, "grp", "sample_id", 0.15, 7).select("sample_id", "grp")


@query("WITH g AS (SELECT DISTINCT user_id FROM events), n AS (SELECT greatest(1, floor(count(*) * 0.25::DOUBLE)) AS n FROM g), k AS (SELECT user_id, row_number() OVER (ORDER BY md5('3:' || user_id), user_id) AS r FROM g), p AS (SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS idx FROM k, n WHERE r <= n) SELECT user_id, event_id, CAST(idx AS BIGINT) AS idx FROM events JOIN p USING (user_id)")
def sample_by_group(spark, d):
    from skewline.session import table

    return masks.sample_groups(table(spark, d, "events").select("user_id", "event_id"), "user_id", 0.25, 3)


@query("WITH g AS (SELECT DISTINCT user_id FROM events), n AS (SELECT ceil(count(*) * 0.3::DOUBLE) AS n FROM g), k AS (SELECT user_id, row_number() OVER (ORDER BY md5('5:' || user_id), user_id) AS r FROM g) SELECT event_id, user_id, r <= n AS is_test FROM events JOIN k USING (user_id), n")
def grouped_split(spark, d):
    from skewline.session import table

    return masks.grouped_split(table(spark, d, "events").select("event_id", "user_id"), "user_id", 0.3, 5)


@query("WITH k AS (SELECT event_id, row_number() OVER (ORDER BY md5('1:' || event_id), event_id) AS r, count(*) OVER () AS n FROM events) SELECT event_id, r <= floor(n * 0.9::DOUBLE) AS is_train FROM k")
def permutation_split(spark, d):
    from skewline.session import table

    return masks.permutation_split(table(spark, d, "events").select("event_id"), "event_id", 0.9, 1)
