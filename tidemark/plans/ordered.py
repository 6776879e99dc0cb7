"""Exact order statistics that never put a whole group into one task.

Rows are first collapsed to one row per distinct value (map-side combined), so ties and hot values
cost nothing. Distinct values are then cut into slices at approximate quantiles of the value column
(one number per slice on the driver). Running counts are local to a slice plus the totals of
the slices below, so a single hot key still spreads over all slices.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.session import cut

SLICE = "__slice"
#: Distinct values that a slice should hold at most; one task sorts a slice.
SLICE_ROWS = 1_000_000


def frequencies(df: DataFrame, value: str, keys: Sequence[str] = (), weight: Column | None = None) -> DataFrame:
    """One row per (keys, value) with its row count `n`; nulls are left out."""
    n = F.count(F.lit(1)) if weight is None else F.sum(weight)
    return df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(n.alias("n"))


def sliced(df: DataFrame, value: str) -> DataFrame:
    """Add a slice number that is monotone in `value`: as many slices as shuffle partitions, more where a slice would pass SLICE_ROWS."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-df.count() // SLICE_ROWS))
    num = "__num"
    df = df.withColumn(num, F.col(value).cast("double"))
    cuts = df.approxQuantile(num, [i / parts for i in range(1, parts)], 0.1 / parts)
    edges = sorted({c for c in cuts if c is not None})
    if not edges:
        return df.withColumn(SLICE, F.lit(0.0)).drop(num)
    cutter = Bucketizer(splits=[float("-inf"), *edges, float("inf")], inputCol=num, outputCol=SLICE, handleInvalid="keep")
    return cutter.transform(df).drop(num)


def running(freq: DataFrame, value: str, keys: Sequence[str] = (), counts: Sequence[str] = ("n",)) -> DataFrame:
    """Add for every count column c: `c_below` (sum over smaller values of the key) and `c_total`.

    The frequencies are read twice (for the slice edges and for the counts), so they are written once."""
    parted = sliced(cut(freq), value)
    per_slice = parted.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(f"{c}_slice") for c in counts])
    # at most one row per slice and key
    lower = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    lead = per_slice.select(
        *keys,
        SLICE,
        F.lit(0).alias("__kind"),
        *[F.coalesce(F.sum(f"{c}_slice").over(lower), F.lit(0)).alias(f"{c}_before") for c in counts],
        *[F.sum(f"{c}_slice").over(whole).alias(f"{c}_all") for c in counts],
    )
    # one leading row per slice and key brings the counts of the slices below
    flow = parted.withColumn("__kind", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    order = Window.partitionBy(*keys, SLICE).orderBy("__kind", value)
    smaller, first = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(Window.unboundedPreceding, 0)
    out = flow
    for c in counts:
        inside = F.coalesce(F.sum(c).over(smaller), F.lit(0))
        out = out.withColumn(f"{c}_below", F.first(f"{c}_before", ignorenulls=True).over(first) + inside).withColumn(
            f"{c}_total", F.first(f"{c}_all", ignorenulls=True).over(first))
    return out.where(F.col("__kind") == 1).drop(SLICE, "__kind", *[f"{c}_{x}" for c in counts for x in ("before", "all")])


def quantiles(df: DataFrame, value: str, probs: Sequence[float], keys: Sequence[str] = ()) -> DataFrame:
    """Linear-interpolated exact quantiles: one row per key with an array `q` in the order of probs."""
    r = running(frequencies(df, value, keys), value, keys)
    n, below, total = F.col("n"), F.col("n_below"), F.col("n_total")
    picks = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (total - 1)
        for tag, rank in (("lo", F.floor(pos)), ("hi", F.ceil(pos))):
            hit = (rank >= below) & (rank < below + n)
            picks.append(F.max(F.when(hit, F.col(value))).alias(f"{tag}{i}"))
    g = r.groupBy(*keys).agg(F.max("n_total").alias("n_total"), *picks)
    out = []
    for i, p in enumerate(probs):
        pos = F.lit(float(p)) * (F.col("n_total") - 1)
        lo, hi = F.col(f"lo{i}").cast("double"), F.col(f"hi{i}").cast("double")
        out.append(lo + (hi - lo) * (pos - F.floor(pos)))
    return g.select(*keys, F.col("n_total").alias("n"), F.array(*out).alias("q"))


def nth(df: DataFrame, value: str, ranks: dict[str, Column], keys: Sequence[str] = ()) -> DataFrame:
    """Values at 0-based ranks; a rank may use the column `n_total`."""
    r = running(frequencies(df, value, keys), value, keys)
    picks = []
    for name, rank in ranks.items():
        hit = (rank >= F.col("n_below")) & (rank < F.col("n_below") + F.col("n"))
        picks.append(F.max(F.when(hit, F.col(value))).alias(name))
    return r.groupBy(*keys).agg(F.max("n_total").alias("n"), *picks)


def average_ranks(df: DataFrame, value: str, keys: Sequence[str] = ()) -> DataFrame:
    """One row per distinct value with its average rank (1-based) and the tie size `n`."""
    r = running(frequencies(df, value, keys), value, keys)
    return r.select(*keys, value, "n", "n_total", (F.col("n_below") + (F.col("n") + 1) / 2).alias("rank"))


def sorted_codes(df: DataFrame, col: str, out: str) -> DataFrame:
    """One row per distinct non-null value with its 0-based position in sorted order.

    The distinct values are range-partitioned and checkpointed, which fixes the partitions; each
    partition is numbered on its own and shifted by the sizes of the ones before it."""
    parts = max(2, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    values = df.select(col).where(F.col(col).isNotNull()).distinct()
    fixed = cut(values.repartitionByRange(parts, col)).withColumn("__part", F.spark_partition_id())
    sizes = fixed.groupBy("__part").agg(F.count(F.lit(1)).alias("__size"))
    # one row per partition
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    local = F.row_number().over(Window.partitionBy("__part").orderBy(col))
    return fixed.join(offsets, "__part").select(col, (F.col("__offset") + local - 1).alias(out))


def with_group_stats(df: DataFrame, keys: Sequence[str], **aggs: Column) -> DataFrame:
    """Statistics of each row's group next to the row: aggregate (map-side combined), then join the
    one-row-per-group result back, so a hot group never sits in one task."""
    stats = df.groupBy(*[F.col(k).alias(f"__g{i}") for i, k in enumerate(keys)]).agg(*[c.alias(n) for n, c in aggs.items()])
    on = None
    for i, k in enumerate(keys):
        same = F.col(k).eqNullSafe(F.col(f"__g{i}"))
        on = same if on is None else on & same
    return df.join(stats, on, "left").drop(*[f"__g{i}" for i in range(len(keys))])
