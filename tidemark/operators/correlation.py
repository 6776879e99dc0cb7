"""Correlations, rank tests and analysis of variance from aggregates."""

from __future__ import annotations

from collections.abc import Sequence
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.stats import binomial_high, binomial_low, chi2_p, f_p, normal_p, t_p
from tidemark.operators.aggs import bin_stats, quantile_bins
from tidemark.plans.ordered import average_ranks, frequencies, running
from tidemark.plans.scalars import with_row


def _rows(one: DataFrame, entries: Sequence[Column]) -> DataFrame:
    return one.select(F.explode(F.array(*entries)).alias("r")).select("r.*")


def _corr_sums(x: Column, y: Column, w: Column | None = None) -> tuple[Column, ...]:
    """Sums a weighted correlation needs, over rows where both are known."""
    both = x.isNotNull() & y.isNotNull()
    w = F.lit(1.0) if w is None else w.cast("double")
    pick = [w, w * x, w * y, w * x * x, w * y * y, w * x * y]
    return tuple(F.sum(F.when(both, p)) for p in pick)


def _corr_from(n: Column, sx: Column, sy: Column, sxx: Column, syy: Column, sxy: Column) -> Column:
    cov, vx, vy = sxy - sx * sy / n, sxx - sx * sx / n, syy - sy * sy / n
    return F.when((vx > 0) & (vy > 0), F.try_divide(cov, F.sqrt(vx * vy)))


def _safe_corr(x: Column, y: Column) -> Column:
    """Pearson correlation; null instead of an error when a side has no variance."""
    both = x.isNotNull() & y.isNotNull()
    a, b = F.when(both, x), F.when(both, y)
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def pearson_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    """(variable, correlation) for every column in one pass."""
    one = df.agg(*[_safe_corr(F.col(c).cast("double"), F.col(target).cast("double")).alias(c) for c in cols])
    return _rows(one, [F.struct(F.lit(c).alias("variable"), F.col(c).alias("correlation")) for c in cols])


def correlation_pairs(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """(feature_a, feature_b, correlation) for every pair of columns in one pass."""
    pairs = list(combinations(cols, 2))
    one = df.agg(*[_safe_corr(F.col(a).cast("double"), F.col(b).cast("double")).alias(f"c{i}") for i, (a, b) in enumerate(pairs)])
    return _rows(one, [F.struct(F.lit(a).alias("feature_a"), F.lit(b).alias("feature_b"), F.col(f"c{i}").alias("correlation"))
                       for i, (a, b) in enumerate(pairs)])


def correlation_matrix(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Full square matrix in long form."""
    half = correlation_pairs(df, cols)
    mirror = half.select(F.col("feature_b").alias("feature_a"), F.col("feature_a").alias("feature_b"), "correlation")
    diag = df.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in cols])).alias("feature_a"))
    return half.unionByName(mirror).unionByName(diag.select("feature_a", F.col("feature_a").alias("feature_b"), F.lit(1.0).alias("correlation")))


def _pair_ranks(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Distinct (x, y) with their row count and the average rank of either side."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    counts = pairs.groupBy(*keys, x, y).agg(F.count(F.lit(1)).alias("pair_n"))
    rx = average_ranks(pairs, x, keys).select(*keys, x, F.col("rank").alias("rank_x"))
    ry = average_ranks(pairs, y, keys).select(*keys, y, F.col("rank").alias("rank_y"))
    return counts.join(rx, [*keys, x]).join(ry, [*keys, y])


def spearman(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation and the number of pairs, from counts of distinct pairs."""
    r = _pair_ranks(df, x, y, keys)
    names = ["n", "sx", "sy", "sxx", "syy", "sxy"]
    # ranks around their mean keep the sums small
    mid = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*keys).agg(((F.count(F.lit(1)) + 1) / 2).alias("__mid"))
    r = r.join(mid, list(keys)) if keys else with_row(r, mid, "__m").withColumn("__mid", F.col("__m.__mid"))
    s = r.groupBy(*keys).agg(*[c.alias(n) for n, c in zip(names, _corr_sums(
        F.col("rank_x") - F.col("__mid"), F.col("rank_y") - F.col("__mid"), F.col("pair_n")))])
    return s.select(*keys, _corr_from(*[F.col(n) for n in names]).alias("correlation"), F.col("n").cast("bigint").alias("n"))


def spearman_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    out = None
    for c in cols:
        one = spearman(df, c, target).select(F.lit(c).alias("variable"), "correlation")
        out = one if out is None else out.unionByName(one)
    return out


def spearman_test(df: DataFrame, x: str, y: str, keys: Sequence[str] = ()) -> DataFrame:
    """Rank correlation with the two-sided p-value of its t approximation."""
    s = spearman(df, x, y, keys)
    dof = (F.col("n") - 2).cast("double")
    t = F.col("correlation") * F.sqrt(F.try_divide(dof, 1 - F.col("correlation") * F.col("correlation")))
    return s.withColumn("p_value", t_p(t, dof))


def kendall(df: DataFrame, x: str, y: str, cells: int = 64) -> DataFrame:
    """Exact tau-b without pairing rows.

    Distinct pairs are numbered by x; inside each of a hierarchy of x blocks the concordant pairs are
    those between the block's two halves, counted by running sums in the order of y. Every level is one
    grouped pass, so the work is (distinct pairs) x (levels) and no two rows are joined."""
    pairs = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(x, y).agg(F.count(F.lit(1)).alias("n"))
    # dense position of x among its distinct values
    xs = running(pairs.select(x).distinct().withColumn("n", F.lit(1)), x).select(x, F.col("n_below").alias("__xi"), F.col("n_total").alias("__xn"))
    placed = pairs.join(xs, x)
    bits = max(1, placed.agg(F.max("__xn")).first()[0] - 1).bit_length()
    levels = F.explode(F.array(*[F.lit(b) for b in range(bits)]))
    lv = placed.select("*", levels.alias("__lv"))
    lv = lv.withColumn("__blk", F.expr("shiftright(__xi, __lv + 1)")).withColumn("__half", F.expr("shiftright(__xi, __lv) & 1"))
    low = F.when(F.col("__half") == 0, F.col("n")).otherwise(0)
    f = lv.groupBy("__lv", "__blk", y).agg(F.sum(low).alias("lo"), F.sum(F.col("n") - low).alias("hi"))
    r = running(f, y, ["__lv", "__blk"], ["lo"])
    # low-half rows with a smaller y are concordant with a high-half row, those with a larger y discordant
    hi = F.col("hi").cast("double")  # products of counts pass the range of a long
    conc = F.sum(hi * F.col("lo_below"))
    disc = F.sum(hi * (F.col("lo_total") - F.col("lo_below") - F.col("lo")))
    s = r.agg(conc.cast("double").alias("c"), disc.cast("double").alias("d"))

    def tied(frame: DataFrame, by: Sequence[str]) -> DataFrame:
        g = frame.groupBy(*by).agg(F.sum("n").alias("t"))
        return g.agg(F.sum(F.col("t").cast("double") * (F.col("t") - 1) / 2).alias("v"))

    total = pairs.agg(F.sum("n").alias("n"))
    s = with_row(with_row(with_row(s, tied(pairs, [x]), "__tx"), tied(pairs, [y]), "__ty"), total, "__n")
    n0 = F.col("__n.n").cast("double") * (F.col("__n.n") - 1) / 2
    tau = F.try_divide(F.col("c") - F.col("d"), F.sqrt(n0 - F.col("__tx.v")) * F.sqrt(n0 - F.col("__ty.v")))
    return s.select(tau.alias("correlation"), F.col("__n.n").alias("n"))


def kendall_with_target(df: DataFrame, cols: Sequence[str], target: str) -> DataFrame:
    out = None
    for c in cols:
        one = kendall(df, c, target).select(F.lit(c).alias("variable"), "correlation")
        out = one if out is None else out.unionByName(one)
    return out


def anova(df: DataFrame, cols: Sequence[str], value: str) -> DataFrame:
    """One-way F, effect size and largest difference of means per category column."""
    long = df.where(F.col(value).isNotNull()).select(
        *[F.col(c).cast("string").alias(c) for c in cols], F.col(value).cast("double").alias("__value")).unpivot(
        ["__value"], list(cols), "variable", "category")
    g = long.where(F.col("category").isNotNull()).groupBy("variable", "category").agg(
        F.count("__value").alias("n"), F.avg("__value").alias("m"), F.var_pop("__value").alias("v"))
    s = g.groupBy("variable").agg(
        F.count(F.lit(1)).alias("num_categories"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("v")).alias("ssw"),
        F.sum(F.col("n") * F.col("m")).alias("t"), F.sum(F.col("n") * F.col("m") * F.col("m")).alias("tt"),
        (F.max("m") - F.min("m")).alias("max_diff"))
    k, n = F.col("num_categories"), F.col("n")
    ssb = F.col("tt") - F.col("t") * F.col("t") / n
    fstat = F.when(k > 1, F.try_divide(ssb / (k - 1), F.col("ssw") / (n - k)))
    eta = F.try_divide(fstat * (k - 1), fstat * (k - 1) + (n - k))
    out = s.select("variable", "num_categories", fstat.alias("f_statistic"), eta.alias("eta_squared"), "max_diff", n.alias("n"))
    return out.withColumn("p_value", f_p("f_statistic", (k - 1).cast("double"), (n - k).cast("double")))


def polynomial_fit(points: DataFrame, x: Column, y: Column, keys: Sequence[str] = ()) -> DataFrame:
    """Least-squares line and parabola per key from power sums: coefficients and R² of both."""
    powers = [F.sum(F.pow(x, F.lit(float(i)))).alias(f"s{i}") for i in range(5)]
    moments = [F.sum(F.pow(x, F.lit(float(i))) * y).alias(f"t{i}") for i in range(3)]
    g = points.groupBy(*keys).agg(*powers, *moments, F.sum(y * y).alias("yy"))
    s = [F.col(f"s{i}") for i in range(5)]
    t = [F.col(f"t{i}") for i in range(3)]

    def det(m):
        (a, b, c), (d, e, f), (h, i, j) = m
        return a * (e * j - f * i) - b * (d * j - f * h) + c * (d * i - e * h)

    rows = [[s[0], s[1], s[2]], [s[1], s[2], s[3]], [s[2], s[3], s[4]]]
    base = det(rows)
    quad = [F.try_divide(det([[t[r] if c == k else rows[r][c] for c in range(3)] for r in range(3)]), base) for k in range(3)]
    slope = F.try_divide(s[0] * t[1] - s[1] * t[0], s[0] * s[2] - s[1] * s[1])
    inter = (t[0] - slope * s[1]) / s[0]
    g = g.withColumns({"c0": quad[0], "c1": quad[1], "c2": quad[2], "slope": slope, "intercept": inter})
    total = F.col("yy") - t[0] * t[0] / s[0]
    q = (F.col("c0"), F.col("c1"), F.col("c2"))
    fit2 = q[0] * t[0] + q[1] * t[1] + q[2] * t[2]
    fit1 = F.col("intercept") * t[0] + F.col("slope") * t[1]
    return g.select(*keys, F.col("s0").cast("bigint").alias("points"), "c0", "c1", "c2", "slope", "intercept",
                    F.try_divide(total - (F.col("yy") - fit1), total).alias("linear_r_squared"),
                    F.try_divide(total - (F.col("yy") - fit2), total).alias("quadratic_r_squared"))


def nonlinearity(df: DataFrame, cols: Sequence[str], value: str, bins: int = 10) -> DataFrame:
    """Linear against quadratic fit of the decile means of `value` over the bin number."""
    out = None
    for c in cols:
        stats = bin_stats(quantile_bins(df, c, bins), value)
        # bins are numbered by the ones that hold rows
        numbered = stats.withColumn("__i", (F.row_number().over(Window.orderBy("bin")) - 1).cast("double"))
        one = polynomial_fit(numbered, F.col("__i"), F.col("mean")).select(
            F.lit(c).alias("variable"), "linear_r_squared", "quadratic_r_squared",
            (F.col("quadratic_r_squared") - F.col("linear_r_squared")).alias("improvement"), F.col("points").alias("bin_count"))
        out = one if out is None else out.unionByName(one)
    return out


def mann_whitney(df: DataFrame, group: str, a: str, b: str, value: str) -> DataFrame:
    """U of the first group and the two-sided p-value with tie and continuity correction."""
    two = df.where(F.col(group).isin(a, b) & F.col(value).isNotNull())
    na = F.sum(F.when(F.col(group) == a, 1).otherwise(0)).alias("na")
    f = two.groupBy(value).agg(F.count(F.lit(1)).alias("n"), na)
    r = running(f, value)
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    s = r.agg(F.sum(F.col("na") * rank).alias("ra"), F.sum("na").cast("double").alias("n1"),
              (F.sum("n") - F.sum("na")).cast("double").alias("n2"),
              F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"))
    n1, n2 = F.col("n1"), F.col("n2")
    n = n1 + n2
    u = F.col("ra") - n1 * (n1 + 1) / 2
    sd = F.sqrt(n1 * n2 / 12 * (n + 1 - F.col("ties") / (n * (n - 1))))
    z = F.try_divide(F.abs(u - n1 * n2 / 2) - 0.5, sd)
    return s.select(u.alias("u_statistic"), z.alias("z"), F.least(normal_p(F.greatest(z, F.lit(0.0))), F.lit(1.0)).alias("p_value"),
                    n1.cast("bigint").alias("n1"), n2.cast("bigint").alias("n2"))


def kruskal_wallis(df: DataFrame, group: Column, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """H over the groups with variation, tie corrected, with its p-value, per key."""
    g = df.where(F.col(value).isNotNull()).withColumn("__g", group)
    counts = g.groupBy(*keys, "__g", value).agg(F.count(F.lit(1)).alias("n"))
    varied = counts.groupBy(*keys, "__g").agg(F.count(F.lit(1)).alias("values")).where(F.col("values") > 1).select(*keys, "__g")
    kept = counts.join(varied, [*keys, "__g"])
    ranks = running(kept.groupBy(*keys, value).agg(F.sum("n").alias("n")), value, keys)
    ranked = kept.withColumnRenamed("n", "cell").join(ranks, [*keys, value])
    rank = F.col("n_below") + (F.col("n") + 1) / 2
    per = ranked.groupBy(*keys, "__g").agg(F.sum(F.col("cell") * rank).alias("r"), F.sum("cell").alias("m"), F.max("n_total").alias("total"))
    n = F.col("total").cast("double")
    h = per.groupBy(*keys).agg(F.sum(F.col("r") * F.col("r") / F.col("m")).alias("q"), F.max("total").alias("total"), F.count(F.lit(1)).alias("groups"))
    ties = ranks.groupBy(*keys).agg(F.sum(F.pow(F.col("n").cast("double"), F.lit(3.0)) - F.col("n")).alias("ties"))
    h = h.join(ties, list(keys)) if keys else with_row(h, ties, "__t").withColumn("ties", F.col("__t.ties"))
    stat = (12 / (n * (n + 1)) * F.col("q") - 3 * (n + 1)) / (1 - F.col("ties") / (n * n * n - n))
    out = h.where(F.col("groups") > 1).select(*keys, stat.alias("h_statistic"), F.col("groups").alias("groups"), F.col("total").alias("n"))
    return out.withColumn("p_value", chi2_p("h_statistic", (F.col("groups") - 1).cast("double")))


def utilization_interval(df: DataFrame, keys: Sequence[str], value: str, level: float = 0.95) -> DataFrame:
    """Share of positive values with its exact binomial interval; none for a constant share."""
    g = df.groupBy(*keys).agg(F.count_if(F.col(value) > 0).alias("successes"), F.count(F.lit(1)).alias("total"))
    k, n = F.col("successes").cast("double"), F.col("total").cast("double")
    varied = (F.col("successes") > 0) & (F.col("successes") < F.col("total"))
    return g.withColumn("utilization_rate", k / n).withColumn("ci_low", F.when(varied, binomial_low(k, n, F.lit(level)))).withColumn(
        "ci_high", F.when(varied, binomial_high(k, n, F.lit(level))))


def hourly_trend(df: DataFrame, time: str, value: str) -> DataFrame:
    """Parabola through the hourly means."""
    h = df.groupBy(F.hour(time).cast("double").alias("h")).agg(F.avg(value).alias("m"))
    return polynomial_fit(h, F.col("h"), F.col("m"))
