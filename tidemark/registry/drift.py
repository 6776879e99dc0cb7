"""Queries of the drift, correlation and test family."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import correlation as corr
from tidemark.operators import drift as op
from tidemark.registry.core import query
from tidemark.registry.features import H, TS
from tidemark.registry.quality import ks_sql

COLS = ["value", "k", "load"]


def q(c):
    return f'"{c}"'


BASE = "bp AS (" + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, avg({q(c)}) AS mean, stddev_samp({q(c)}) AS std, quantile_cont({q(c)}, 0.25) AS q25, quantile_cont({q(c)}, 0.5) AS q50, quantile_cont({q(c)}, 0.75) AS q75 FROM reference"
    for c in COLS) + ")"


def shares(table, name):
    return f"{name} AS (" + " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {c} AS category, count(*) / sum(count(*)) OVER () AS share FROM {table} GROUP BY {c}" for c in ("category", "zone")) + ")"


@query("dr1_baseline_profile", ctes("reference", extra=f"{BASE}, {shares('reference', 'cs')}") + """SELECT feature, 'numeric' AS kind, NULL::VARCHAR AS category, round(mean, 6) AS mean,
    round(std, 6) AS std, round(q25, 6) AS q25, round(q50, 6) AS q50, round(q75, 6) AS q75, NULL::DOUBLE AS share FROM bp
    UNION ALL SELECT feature, 'categorical', category, NULL, NULL, NULL, NULL, NULL, round(share, 6) FROM cs""")
def dr1(spark, root):
    return op.baseline_profile(fx.reference(spark, root), COLS, ["category", "zone"])


POINT = "dp AS (" + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, count(*)::DOUBLE AS n, avg({q(c)}) AS mean, stddev_samp({q(c)}) AS std, any_value(m) AS m, any_value(s) AS s,
    count(*) FILTER ({q(c)} <= m) AS upto, count(*) FILTER ({q(c)} < m) AS below FROM "current", (SELECT mean AS m, std AS s FROM bp WHERE feature = '{c}')""" for c in COLS) + ")"
NUMERIC = f"{BASE}, {POINT}" + """, nd AS (SELECT feature, greatest(below / n, 1 - upto / n) AS d, n, abs(mean - m) / CASE WHEN m <> 0 THEN abs(m) ELSE 1 END AS md,
    abs(std - s) / CASE WHEN s <> 0 THEN abs(s) ELSE 1 END AS sd FROM dp)"""


@query("dr2_numeric_drift", ctes("reference", "current", extra=NUMERIC) + "SELECT feature, round(md, 6) AS mean_difference, round(sd, 6) AS std_difference FROM nd")
def dr2(spark, root):
    r = fx.reference(spark, root)
    return op.numeric_drift(fx.current(spark, root), op.baseline_profile(r, COLS)).select("feature", "mean_difference", "std_difference")


@query("dr3_point_distance", ctes("reference", "current", extra=NUMERIC) + """SELECT feature, round(d, 6) AS ks_statistic,
    round(least(1.0, 2 * (n - ceil(round(n * d, 6)) + 1) / (n + 1)), 6) AS p_value FROM nd""")
def dr3(spark, root):
    r = fx.reference(spark, root)
    return op.numeric_drift(fx.current(spark, root), op.baseline_profile(r, COLS)).select("feature", "ks_statistic", "p_value")


def _buckets(df):
    return df.withColumn("bucket", F.floor(F.col("value") / 10).cast("bigint").cast("string"))


BUCKET = "CAST(CAST(floor(value / 10) AS BIGINT) AS VARCHAR)"


@query("dr4_category_drift", ctes("reference", "current", extra=", ".join(
    f"{n} AS (SELECT {BUCKET} AS c, count(*) / sum(count(*)) OVER () AS s FROM {t} GROUP BY 1)" for n, t in (("a", "reference"), ("b", '"current"')))) + """
    SELECT 'bucket' AS feature, round(least(1.0, sum(abs(coalesce(a.s, 0) - coalesce(b.s, 0))) / 2), 6) AS distribution_difference,
    coalesce(string_agg(b.c, ',' ORDER BY b.c) FILTER (a.c IS NULL), '') AS new_categories, coalesce(string_agg(a.c, ',' ORDER BY a.c) FILTER (b.c IS NULL), '') AS missing_categories
    FROM a FULL JOIN b ON a.c = b.c""")
def dr4(spark, root):
    r, c = _buckets(fx.reference(spark, root)), _buckets(fx.current(spark, root))
    d = op.category_drift(c, op.category_shares(r, ["bucket"]), ["bucket"])
    return d.select("feature", "distribution_difference", F.array_join("new_categories", ",").alias("new_categories"),
                    F.array_join("missing_categories", ",").alias("missing_categories"))


@query("dr5_drift_decision", ctes("reference", "current", extra=NUMERIC) + """SELECT feature, d > 0.5 OR md > 0.02 OR sd > 0.2 AS drift_detected,
    bool_or(d > 0.5 OR md > 0.02 OR sd > 0.2) OVER () AS batch_drift FROM nd""")
def dr5(spark, root):
    m = op.numeric_drift(fx.current(spark, root), op.baseline_profile(fx.reference(spark, root), COLS))
    return op.drift_decision(m, {"ks_statistic": 0.5, "mean_difference": 0.02, "std_difference": 0.2}).select("feature", "drift_detected", "batch_drift")


def two_sample_sql(a, b, cols, prefix=""):
    """Entries computing the two-sample distance of tables a and b: name (feature, d, na, nb)."""
    union = " UNION ALL ".join(
        f"SELECT '{c}' AS feature, {q(c)} AS v, 1 AS a, 0 AS b FROM {a} UNION ALL SELECT '{c}', {q(c)}, 0, 1 FROM {b}" for c in cols)
    return f"""{prefix}u AS ({union}), {prefix}f AS (SELECT feature, v, sum(a) AS a, sum(b) AS b FROM {prefix}u WHERE v IS NOT NULL GROUP BY 1, 2),
    {prefix}r AS (SELECT feature, sum(a) OVER w / sum(a) OVER p AS fa, sum(b) OVER w / sum(b) OVER p AS fb, CAST(sum(a) OVER p AS BIGINT) AS na, CAST(sum(b) OVER p AS BIGINT) AS nb
    FROM {prefix}f WINDOW w AS (PARTITION BY feature ORDER BY v), p AS (PARTITION BY feature)),
    {prefix}ks AS (SELECT feature, max(abs(fa - fb)) AS d, any_value(na) AS na, any_value(nb) AS nb FROM {prefix}r GROUP BY 1)"""


KS_OUT = f"""SELECT feature, round(d, 6) AS drift_score, round({ks_sql('(sqrt(na::DOUBLE * nb / (na + nb)) * d)')}, 6) AS p_value, na AS n_reference, nb AS n_current,
    {ks_sql('(sqrt(na::DOUBLE * nb / (na + nb)) * d)')} < 0.05 AS is_drift_detected, least(na, nb) AS sample_size FROM ks"""


@query("dr6_two_sample_ks", ctes("reference", "current", extra=two_sample_sql("reference", '"current"', COLS)) + KS_OUT)
def dr6(spark, root):
    return op.two_sample(fx.reference(spark, root), fx.current(spark, root), COLS, 100)


@query("dr7_distribution_stats", ctes("features") + " UNION ALL ".join(
    f"""SELECT '{c}' AS feature, round(avg({q(c)}), 6) AS mean, round(stddev_pop({q(c)}), 6) AS std, round(quantile_cont({q(c)}, 0.5), 6) AS median,
    round(quantile_cont({q(c)}, 0.25), 6) AS q1, round(quantile_cont({q(c)}, 0.75), 6) AS q3, round(min({q(c)}), 6) AS min, round(max({q(c)}), 6) AS max FROM features""" for c in COLS))
def dr7(spark, root):
    return op.distribution_stats(fx.features(spark, root), COLS)


def season_sql(table: str, p: str = "") -> str:
    """Entries of the additive seasonal adjustment with period 24: t1 (value, trend) and ss (seasonal means)."""
    return f"""{p}o AS (SELECT event_id, value, row_number() OVER (ORDER BY {TS}, event_id) - 1 AS i FROM {table}),
    {p}t0 AS (SELECT *, CASE WHEN count(*) OVER w = 25 THEN (sum(value) OVER w - (lag(value, 12) OVER (ORDER BY i) + lead(value, 12) OVER (ORDER BY i)) / 2) / 24 END AS t FROM {p}o
    WINDOW w AS (ORDER BY i ROWS BETWEEN 12 PRECEDING AND 12 FOLLOWING)),
    {p}sp AS (SELECT min(i) AS a, max(i) AS b FROM {p}t0 WHERE t IS NOT NULL),
    {p}hd AS (SELECT regr_slope(t, i) AS k, regr_intercept(t, i) AS n FROM {p}t0, {p}sp WHERE t IS NOT NULL AND i < b AND i < a + 24),
    {p}tl AS (SELECT regr_slope(t, i) AS k, regr_intercept(t, i) AS n FROM {p}t0, {p}sp WHERE t IS NOT NULL AND i < b AND i >= b - 24),
    {p}t1 AS (SELECT event_id, value, i, CASE WHEN i < a THEN hd.n + hd.k * i WHEN i > b THEN tl.n + tl.k * i ELSE t END AS t FROM {p}t0, {p}sp, {p}hd hd, {p}tl tl),
    {p}ss AS (SELECT i % 24 AS p, avg(value - t) AS s FROM {p}t1 GROUP BY 1)"""


SEASON = season_sql("features")
SEASONS = ", ".join([season_sql("reference", "r_"), season_sql('"current"', "c_")] + [
    f"{n} AS (SELECT value - (s - (SELECT avg(s) FROM {n}_ss)) AS value FROM {n}_t1 JOIN {n}_ss ON {n}_ss.p = {n}_t1.i % 24)" for n in ("r", "c")])


@query("dr8_seasonal_adjustment", ctes("features", extra=SEASON) + "SELECT event_id, round(value - (s - (SELECT avg(s) FROM ss)), 6) AS adjusted FROM t1 JOIN ss ON ss.p = t1.i % 24")
def dr8(spark, root):
    f = fx.features(spark, root).select("event_id", "timestamp", "value")
    return op.seasonal_adjust(f, "timestamp", "value", 24, ["event_id"]).select("event_id", "adjusted")


@query("dr8_seasonal_two_sample", ctes("reference", "current", extra=SEASONS + ", " + two_sample_sql("r", "c", ["value"], "k")) + KS_OUT.replace("FROM ks", "FROM kks").replace("SELECT feature,", "SELECT feature, TRUE AS seasonal_adjusted,"))
def dr8b(spark, root):
    r, c = (f(spark, root).select("event_id", "timestamp", "value") for f in (fx.reference, fx.current))
    return op.seasonal_two_sample(r, c, "timestamp", "value", 24, ["event_id"], 100)


ERRS = """ea AS (SELECT abs(round(predicted - actual, 9)) AS prediction_error FROM predictions WHERE "timestamp" < TIMESTAMP '1998-07-01 00:00:00'),
    eb AS (SELECT abs(round(predicted - actual, 9)) AS prediction_error FROM predictions WHERE "timestamp" >= TIMESTAMP '1998-07-01 00:00:00')"""


@query("dr9_concept_drift", ctes("predictions", extra=ERRS + ", " + two_sample_sql("ea", "eb", ["prediction_error"])) + KS_OUT)
def dr9(spark, root):
    p = fx.predictions(spark, root).withColumn("predicted", F.col("actual") + F.round(F.col("predicted") - F.col("actual"), 9))
    p = p.withColumn("predicted", F.round(F.col("predicted") - F.col("actual"), 9)).withColumn("actual", F.lit(0.0))
    cut = F.lit("1998-07-01").cast("timestamp")
    return op.concept_drift(p.where(F.col("timestamp") < cut), p.where(F.col("timestamp") >= cut))


def chi_sql(c):
    return f"""SELECT '{c}' AS feature, sum(pow(a - ea, 2) / ea + pow(b - eb, 2) / eb) AS statistic, count(*) - 1 AS dof FROM (SELECT *, (a + b) * ta / (ta + tb)::DOUBLE AS ea, (a + b) * tb / (ta + tb)::DOUBLE AS eb
    FROM (SELECT coalesce(x.n, 0) AS a, coalesce(y.n, 0) AS b, sum(coalesce(x.n, 0)) OVER () AS ta, sum(coalesce(y.n, 0)) OVER () AS tb
    FROM (SELECT {c} AS c, count(*) AS n FROM reference GROUP BY 1) x FULL JOIN (SELECT {c} AS c, count(*) AS n FROM "current" GROUP BY 1) y ON x.c = y.c))"""


@query("dr10_chi_square", ctes("reference", "current") + f"SELECT feature, round(statistic, 6) AS statistic, dof FROM ({chi_sql('category')} UNION ALL {chi_sql('zone')})")
def dr10a(spark, root):
    return op.chi_square(fx.reference(spark, root), fx.current(spark, root), ["category", "zone"])


@query("dr10_tabular_drift")
def dr10(spark, root):
    return op.tabular_drift(fx.reference(spark, root), fx.current(spark, root), COLS, ["category", "zone"])


@query("dr10_drift_summary")
def dr10s(spark, root):
    return op.drift_summary(op.tabular_drift(fx.reference(spark, root), fx.current(spark, root), COLS, ["category", "zone"]))


@query("dr11_pearson", ctes("features") + " UNION ALL ".join(f"SELECT '{c}' AS variable, round(corr({c}, value), 6) AS correlation FROM features" for c in ('k', '"load"', 'event_id')).replace("'\"load\"'", "'load'"))
def dr11(spark, root):
    return corr.pearson_with_target(fx.features(spark, root), ["k", "load", "event_id"], "value").orderBy(F.abs("correlation").desc())


def rank_sql(c, table="features", part=""):
    p = f"PARTITION BY {part}" if part else ""
    return f"(rank() OVER ({p} ORDER BY {c}) + (count(*) OVER (PARTITION BY {part + ', ' if part else ''}{c}) - 1) / 2.0)"


@query("dr12_spearman", ctes("features", extra=f"r AS (SELECT {rank_sql('k')} AS k, {rank_sql('value')} AS v, {rank_sql(q('load'))} AS l FROM features)") + """
    SELECT 'k' AS variable, round(corr(k, v), 6) AS correlation FROM r UNION ALL SELECT 'load', round(corr(l, v), 6) FROM r""")
def dr12(spark, root):
    return corr.spearman_with_target(fx.features(spark, root), ["k", "load"], "value")


# tau-b by pairs of distinct value cells: (x, y) cells joined to cells with larger x
KENDALL = """p AS (SELECT level AS x, CAST(least(floor(k / 20), 4) AS BIGINT) AS y FROM segments JOIN obs USING (event_id)), c AS (SELECT x, y, count(*) AS n FROM p GROUP BY 1, 2),
    s AS (SELECT sum(a.n * b.n * CASE WHEN b.y > a.y THEN 1 WHEN b.y < a.y THEN -1 ELSE 0 END)::DOUBLE AS s FROM c a JOIN c b ON b.x > a.x),
    tx AS (SELECT sum(t * (t - 1) / 2)::DOUBLE AS v FROM (SELECT sum(n)::DOUBLE AS t FROM c GROUP BY x)), ty AS (SELECT sum(t * (t - 1) / 2)::DOUBLE AS v FROM (SELECT sum(n)::DOUBLE AS t FROM c GROUP BY y)),
    n AS (SELECT sum(n)::DOUBLE AS n FROM c)"""


@query("dr13_kendall", ctes("segments", "obs", extra=KENDALL) + """SELECT round(s / (sqrt(n * (n - 1) / 2 - tx.v) * sqrt(n * (n - 1) / 2 - ty.v)), 6) AS correlation, CAST(n AS BIGINT) AS n
    FROM s, tx, ty, n""")
def dr13(spark, root):
    s = fx.segments(spark, root).select("event_id", F.col("level").alias("x"))
    o = fx.obs(spark, root).select("event_id", F.least(F.floor(F.col("k") / 20), F.lit(4)).alias("y"))
    return corr.kendall(s.join(o, "event_id"), "x", "y")


PAIRS_SQL = " UNION ALL ".join(
    f"""SELECT '{c}' AS variable, round(sum(sign(a.x - b.x) * sign(a.y - b.y)) / (sqrt(sum(abs(sign(a.x - b.x)))) * sqrt(sum(abs(sign(a.y - b.y))))), 6) AS correlation
    FROM (SELECT event_id AS i, {q(c)} AS x, value AS y FROM features) a JOIN (SELECT event_id AS i, {q(c)} AS x, value AS y FROM features) b ON a.i < b.i""" for c in ("k", "load"))


@query("dr13_kendall_with_target", ctes("features") + PAIRS_SQL)
def dr13b(spark, root):
    return corr.kendall_with_target(fx.features(spark, root), ["k", "load"], "value")


def anova_sql(c):
    return f"""SELECT '{c}' AS variable, k AS num_categories, f, f * (k - 1) / (f * (k - 1) + n - k) AS eta, max_diff, n FROM (SELECT k, n, max_diff, (ssb / (k - 1)) / (ssw / (n - k)) AS f FROM (
    SELECT count(*) AS k, CAST(sum(n) AS BIGINT) AS n, sum(n * v) AS ssw, sum(n * pow(m - gm, 2)) AS ssb, max(m) - min(m) AS max_diff FROM (
    SELECT {c}, count(value) AS n, avg(value) AS m, var_pop(value) AS v, (SELECT avg(value) FROM features) AS gm FROM features GROUP BY 1)))"""


@query("dr14_anova", ctes("features") + f"""SELECT variable, num_categories, round(f, 4) AS f_statistic, round(eta, 4) AS eta_squared, round(max_diff, 4) AS max_diff, n
    FROM ({anova_sql('category')} UNION ALL {anova_sql('zone')})""", digits=4)
def dr14(spark, root):
    return corr.anova(fx.features(spark, root), ["category", "zone"], "value").drop("p_value")


@query("dr14_anova_p_values")
def dr14p(spark, root):
    return corr.anova(fx.features(spark, root), ["category", "zone"], "value").select("variable", "p_value")


@query("dr15_nonlinearity", ctes("features", extra="""e AS (SELECT list_sort(list_distinct(quantile_cont(k, [0.0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS edges FROM features),
    b AS (SELECT value, greatest(len(list_filter(edges, lambda x: x < k)) - 1, 0) AS bin FROM features, e), g AS (SELECT bin, avg(value) AS y, (row_number() OVER (ORDER BY bin) - 1)::DOUBLE AS x FROM b GROUP BY bin),
    s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2, sum(y*y) AS yy, regr_r2(y, x) AS lin FROM g),
    d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s),
    c AS (SELECT *, (t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det AS c0, (n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det AS c1,
    (n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det AS c2 FROM d)""") + """SELECT 'k' AS variable, round(lin, 5) AS linear_r_squared,
    round(1 - (yy - c0*t0 - c1*t1 - c2*t2) / (yy - t0*t0/n), 5) AS quadratic_r_squared, round(1 - (yy - c0*t0 - c1*t1 - c2*t2) / (yy - t0*t0/n) - lin, 5) AS improvement, CAST(n AS BIGINT) AS bin_count FROM c""", digits=5)
def dr15(spark, root):
    return corr.nonlinearity(fx.features(spark, root), ["k"], "value")


@query("dr16_correlation_matrix", ctes("features") + " UNION ALL ".join(
    f"SELECT '{a}' AS feature_a, '{b}' AS feature_b, " + ("1.0::DOUBLE" if a == b else f"round(corr({q(a)}, {q(b)}), 6)") + " AS correlation" + (" FROM features" if a != b else "")
    for a in COLS for b in COLS))
def dr16(spark, root):
    return corr.correlation_matrix(fx.features(spark, root), COLS)


@query("dr17_mann_whitney", ctes("segments", extra=f"r AS (SELECT kind, {rank_sql('level')} AS r FROM segments), t AS (SELECT sum(pow(n, 3) - n) AS t FROM (SELECT count(*)::DOUBLE AS n FROM segments GROUP BY level))") + """,
    g AS (SELECT sum(r) FILTER (kind = 'BLAVA') AS ra, count(*) FILTER (kind = 'BLAVA') AS n1, count(*) FILTER (kind = 'VERDA') AS n2 FROM r),
    u AS (SELECT ra - n1 * (n1 + 1) / 2 AS u, n1, n2, sqrt(n1::DOUBLE * n2 / 12 * (n1 + n2 + 1 - t / ((n1 + n2)::DOUBLE * (n1 + n2 - 1)))) AS sd FROM g, t)
    SELECT round(u, 6)::DOUBLE AS u_statistic, round((abs(u - n1::DOUBLE * n2 / 2) - 0.5) / sd, 6) AS z, n1, n2 FROM u""")
def dr17(spark, root):
    return corr.mann_whitney(fx.segments(spark, root), "kind", "BLAVA", "VERDA", "level").drop("p_value")


@query("dr17_mann_whitney_p")
def dr17p(spark, root):
    return corr.mann_whitney(fx.segments(spark, root), "kind", "BLAVA", "VERDA", "level").select("p_value")


@query("dr18_kruskal_wallis", ctes("segments", extra=f"""ok AS (SELECT kind, {H} AS h FROM segments GROUP BY 1, 2 HAVING count(DISTINCT level) > 1),
    s AS (SELECT g.kind, g.h, level FROM (SELECT kind, {H} AS h, level FROM segments) g JOIN ok ON ok.kind = g.kind AND ok.h = g.h),
    r AS (SELECT kind, h, {rank_sql('level', 's', 'kind')} AS r, count(*) OVER (PARTITION BY kind) AS n FROM s),
    q AS (SELECT kind, sum(rr * rr / m) AS q, any_value(n)::DOUBLE AS n, count(*) AS groups FROM (SELECT kind, h, sum(r)::DOUBLE AS rr, count(*) AS m, any_value(n) AS n FROM r GROUP BY 1, 2) GROUP BY 1),
    t AS (SELECT kind, sum(pow(c, 3) - c) AS t FROM (SELECT kind, level, count(*)::DOUBLE AS c FROM s GROUP BY 1, 2) GROUP BY 1)""") + """SELECT kind,
    round((12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)), 4) AS h_statistic, groups, CAST(n AS BIGINT) AS n FROM q JOIN t USING (kind)""", digits=4)
def dr18(spark, root):
    return corr.kruskal_wallis(fx.segments(spark, root), F.hour("timestamp"), "level", ["kind"]).drop("p_value")


@query("dr18_kruskal_wallis_p")
def dr18p(spark, root):
    return corr.kruskal_wallis(fx.segments(spark, root), F.hour("timestamp"), "level", ["kind"]).select("kind", "p_value")


TARIFF = "sg AS (SELECT kind, level, CAST(regexp_extract(tariff, '([0-9.]+)', 1) AS DOUBLE) AS price FROM segments)"


@query("dr19_spearman_test", ctes("segments", extra=TARIFF + f", r AS (SELECT kind, {rank_sql('level', 'sg', 'kind')} AS a, {rank_sql('price', 'sg', 'kind')} AS b FROM sg)") + """
    SELECT kind, round(corr(a, b), 6) AS correlation, count(*) AS n FROM r GROUP BY 1""")
def dr19(spark, root):
    from tidemark.operators.shaping import tariff_number

    s = fx.segments(spark, root).withColumn("price", tariff_number(F.col("tariff")))
    return corr.spearman_test(s, "level", "price", ["kind"]).drop("p_value")


@query("dr19_spearman_p")
def dr19p(spark, root):
    from tidemark.operators.shaping import tariff_number

    s = fx.segments(spark, root).withColumn("price", tariff_number(F.col("tariff")))
    return corr.spearman_test(s, "level", "price", ["kind"]).select("kind", "p_value")


@query("dr20_utilization_interval", ctes("segments") + """SELECT kind, count(*) FILTER (level > 0) AS successes, count(*) AS total,
    round(count(*) FILTER (level > 0) / count(*)::DOUBLE, 6) AS utilization_rate FROM segments GROUP BY 1""")
def dr20(spark, root):
    return corr.utilization_interval(fx.segments(spark, root), ["kind"], "level").drop("ci_low", "ci_high")


@query("dr20_utilization_bounds")
def dr20b(spark, root):
    return corr.utilization_interval(fx.segments(spark, root), ["kind"], "level").select("kind", "ci_low", "ci_high")


@query("dr21_hourly_trend", ctes("segments", extra=f"""g AS (SELECT {H}::DOUBLE AS x, avg(level) AS y FROM segments GROUP BY 1),
    s AS (SELECT count(*)::DOUBLE AS n, sum(x) AS s1, sum(x*x) AS s2, sum(x*x*x) AS s3, sum(x*x*x*x) AS s4, sum(y) AS t0, sum(x*y) AS t1, sum(x*x*y) AS t2 FROM g),
    d AS (SELECT *, n*(s2*s4-s3*s3) - s1*(s1*s4-s2*s3) + s2*(s1*s3-s2*s2) AS det FROM s)""") + """SELECT CAST(n AS BIGINT) AS points, round((t0*(s2*s4-s3*s3) - s1*(t1*s4-s3*t2) + s2*(t1*s3-s2*t2)) / det, 6) AS c0,
    round((n*(t1*s4-s3*t2) - t0*(s1*s4-s3*s2) + s2*(s1*t2-t1*s2)) / det, 6) AS c1, round((n*(s2*t2-t1*s3) - s1*(s1*t2-t1*s2) + t0*(s1*s3-s2*s2)) / det, 6) + 0.0 AS c2 FROM d""")
def dr21(spark, root):
    return corr.hourly_trend(fx.segments(spark, root), "timestamp", "level").select("points", "c0", "c1", "c2")
