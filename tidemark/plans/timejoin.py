"""Joins on time: nearest as-of and interval cover.

All work on the distinct left keys and join the result back, so the size of a hot hour or a hot
location does not enter the candidate step.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.plans.series import running_counts, with_known
from tidemark.plans.slices import needed
from tidemark.session import cut


def asof_nearest(left: DataFrame, right: DataFrame, time: str, right_time: str, cols: Sequence[str],
                 keys: Sequence[str] = ()) -> DataFrame:
    """Left join to the right row nearest in time (a tie takes the earlier row). Right times must be
    unique per key; a right row whose values are null is still a candidate."""
    moments = left.select(*keys, F.col(time).alias("__t")).where(F.col("__t").isNotNull()).distinct()
    payload = F.struct(*[F.col(c) for c in cols])
    marks = right.select(*keys, F.col(right_time).alias("__t"), payload.alias("__v"), F.lit(0).alias("__side"))
    asks = moments.select(*keys, "__t", F.lit(None).cast(marks.schema["__v"].dataType).alias("__v"),
                          F.lit(1).alias("__side"))
    both = asks.unionByName(marks)
    known = with_known(both, keys, "__t", {"m": (F.col("__side") == 0, [F.col("__v")])}, ["__side"])
    gap_back = F.unix_micros("__t") - F.unix_micros(F.col("m_prev")["at"])
    gap_on = F.unix_micros(F.col("m_next")["at"]) - F.unix_micros("__t")
    take_prev = F.col("m_next").isNull() | (gap_back <= gap_on)
    hit = F.when(F.col("m_prev").isNotNull() & take_prev, F.col("m_prev")).otherwise(F.col("m_next"))
    found = (
        known.where(F.col("__side") == 1)
        .select(*keys, F.col("__t").alias(time), hit.alias("__hit"))
        .select(*keys, time, F.col("__hit.at").alias(f"matched_{right_time}"),
                *[F.col("__hit")["p0"][c].alias(c) for c in cols])
    )
    return left.join(found, [*keys, time], "left")


def running_cover_product(left: DataFrame, intervals: DataFrame, time: str, start: str, end: str, factor: Column, name: str,
                          span: str = "hour", log_name: str | None = None) -> DataFrame:
    """Add `name`: the product of `factor` (a column of the intervals) over all intervals with
    start <= time <= end, 1 if none; with `log_name` also the product's logarithm (null for a negative product).

    No pair of time and interval is formed: an interval multiplies from its start and divides after its
    end. The product is carried as the sum of logarithms with counts of negative and zero factors, each
    a running sum inside a time span plus the totals of the spans before."""
    covered = intervals.where((F.col(start) <= F.col(end)) & factor.isNotNull()).select(F.col(start).alias("s"), F.col(end).alias("e"), factor.alias("f"))
    size = F.when(F.col("f") != 0, F.log(F.abs("f"))).otherwise(0.0)
    edge = [("__log", size), ("__neg", (F.col("f") < 0).cast("bigint")), ("__zero", (F.col("f") == 0).cast("bigint"))]
    opens = covered.select(F.col("s").alias(time), F.lit(False).alias("__ask"), *[c.alias(n) for n, c in edge])
    closes = covered.select((F.col("e") + F.expr("interval 1 microsecond")).alias(time), F.lit(False).alias("__ask"), *[(-c).alias(n) for n, c in edge])
    asks = left.select(time).where(F.col(time).isNotNull()).distinct().select(
        time, F.lit(True).alias("__ask"), F.lit(0.0).alias("__log"), F.lit(0).cast("bigint").alias("__neg"), F.lit(0).cast("bigint").alias("__zero"))
    flow = asks.unionByName(opens).unionByName(closes).withColumn("__span", F.date_trunc(span, time))
    names = [n for n, _ in edge]
    totals = flow.groupBy("__span").agg(*[F.sum(n).alias(f"{n}_t") for n in names])
    # one row per time span
    before = Window.orderBy("__span").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("__span", *[F.coalesce(F.sum(f"{n}_t").over(before), F.lit(0)).alias(f"{n}_o") for n in names])
    upto = Window.partitionBy("__span").orderBy(F.unix_micros(time)).rangeBetween(Window.unboundedPreceding, 0)
    r = flow.join(offsets, "__span").withColumns({n: F.sum(n).over(upto) + F.col(f"{n}_o") for n in names}).where("__ask")
    sign = F.when(F.col("__neg") % 2 == 0, 1.0).otherwise(-1.0)
    product = F.when(F.col("__zero") > 0, 0.0).otherwise(sign * F.exp("__log"))
    if not log_name:
        return left.join(r.select(time, product.alias(name)), time, "left").withColumn(name, F.coalesce(name, F.lit(1.0)))
    log = F.when(F.col("__zero") > 0, F.lit(float("-inf"))).when(sign > 0, F.col("__log"))
    found = r.select(time, product.alias(name), log.alias(log_name), F.lit(True).alias("__found"))
    out = left.join(found, time, "left").withColumns({name: F.coalesce(name, F.lit(1.0)), log_name: F.when(F.col("__found").isNull(), 0.0).otherwise(F.col(log_name))})
    return out.drop("__found")


#: Steps of a logarithm's fixed point: sums are exact, so what enters and leaves again is gone, in whatever order rows come.
FIXED = 1e15


def cover_product(left: DataFrame, intervals: DataFrame, time: str, start: str, end: str, factor: Column,
                  name: str, keys: Sequence[str] = (), bucket: str = "hour") -> DataFrame:
    """Add `name`: the product of `factor` over all intervals with start <= time <= end (1 if none).
    `factor` may use the columns of both sides; `keys` are the left columns it needs.

    Pairs of a time and the intervals that share its bucket are formed only if they are fewer than the pairs of keys and intervals.
    Else an interval multiplies at each key from its start and divides after its end, so no time meets an interval."""
    asks = left.select(time, *keys).where(reduce(lambda x, y: x & y, [F.col(c).isNotNull() for c in (time, *keys)])).distinct()
    spread = intervals.where(F.col(start) <= F.col(end))
    times, places, many = _sizes(asks, spread, time, start, end, keys, bucket)
    if times <= 2 * places * many:
        product = _paired(asks, spread, time, start, end, factor, name, keys, bucket)
    else:
        product = _carried(cut(asks), spread, time, start, end, factor, name, keys)
    return left.join(product, [time, *keys], "left").withColumn(name, F.coalesce(name, F.lit(1.0)))


def _sizes(asks: DataFrame, spread: DataFrame, time: str, start: str, end: str, keys: Sequence[str], bucket: str) -> tuple[int, int, int]:
    """Pairs of asks and intervals in one bucket, different keys, intervals. The pairs come from counts per bucket."""
    step = F.expr(f"interval 1 {bucket}")
    edge = lambda at, n: F.struct(at.alias("b"), F.lit(n).cast("bigint").alias("n"))
    edges = spread.select(F.explode(F.array(edge(F.date_trunc(bucket, start), 1), edge(F.date_trunc(bucket, end) + step, -1))).alias("x"))
    flow = edges.select("x.b", "x.n", F.lit(0).cast("bigint").alias("a")).unionByName(asks.select(F.date_trunc(bucket, time).alias("b"), F.lit(0).cast("bigint").alias("n"), F.lit(1).cast("bigint").alias("a")))
    # one row per bucket
    upto = Window.orderBy("b").rowsBetween(Window.unboundedPreceding, 0)
    per = flow.groupBy("b").agg(F.sum("n").alias("n"), F.sum("a").alias("a")).withColumn("n", F.sum("n").over(upto))
    times = per.agg(F.sum(F.col("n").cast("double") * F.col("a")).alias("s")).first()["s"] or 0
    return int(times), asks.select(*keys).distinct().count() if keys else 1, spread.count()


def _paired(asks: DataFrame, spread: DataFrame, time: str, start: str, end: str, factor: Column, name: str, keys: Sequence[str], bucket: str) -> DataFrame:
    hours = F.sequence(F.date_trunc(bucket, start), F.date_trunc(bucket, end), F.expr(f"interval 1 {bucket}"))
    hits = asks.withColumn("__bucket", F.date_trunc(bucket, time)).join(spread.withColumn("__bucket", F.explode(hours)), "__bucket")
    return hits.where(F.col(time).between(F.col(start), F.col(end))).groupBy(time, *keys).agg(F.product(factor).alias(name))


def _carried(asks: DataFrame, spread: DataFrame, time: str, start: str, end: str, factor: Column, name: str, keys: Sequence[str]) -> DataFrame:
    """The product at each ask from sums per key over the edges of intervals: of logarithms, and of factors that have none."""
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    deals = 4 * int(asks.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    places = asks.select(*keys).distinct().withColumn("__deal", F.explode(F.sequence(F.lit(0), F.lit(deals - 1))))
    dealt = spread.withColumn("__deal", F.pmod(F.xxhash64(*[F.col(f"`{c}`") for c in spread.columns]), F.lit(deals)).cast("int"))
    f, size = F.col("__f"), F.abs(F.col("__f"))
    each = dealt.join(places, "__deal").select(*keys, us(start).alias("__from"), (us(end) + 1).alias("__to"), factor.cast("double").alias("__f")).where(f.isNotNull())
    plain = ~F.isnan(f) & (size > 0) & (size < float("inf"))
    parts = {"__log": F.when(plain, F.round(F.log(size) * FIXED)).otherwise(0.0), "__neg": f < 0, "__zero": f == 0, "__nan": F.isnan(f), "__inf": size == float("inf")}
    kinds = {c: "decimal(20, 0)" if c == "__log" else "bigint" for c in parts}
    each = each.select(*keys, "__from", "__to", *[x.cast("bigint").cast(kinds[c]).alias(c) for c, x in parts.items()])
    edge = lambda at, sign: F.struct(F.col(at).alias("__at"), *[(F.col(c) * sign).cast(k).alias(c) for c, k in kinds.items()])
    edges = each.select(*keys, F.explode(F.array(edge("__from", 1), edge("__to", -1))).alias("x")).select(*keys, "x.*", F.lit(False).alias("__ask"))
    flow = edges.unionByName(asks.select(*keys, us(time).alias("__at"), *[F.lit(0).cast(k).alias(c) for c, k in kinds.items()], F.lit(True).alias("__ask")))
    flow = cut(flow.groupBy(*keys, "__at").agg(*[F.sum(c).alias(c) for c in kinds], F.bool_or("__ask").alias("__ask")))
    r = running_counts(flow, keys, "__at", list(kinds), needed(flow, keys), F.col("__ask"))
    sign = F.when(F.col("__neg") % 2 == 0, 1.0).otherwise(-1.0)
    product = (F.when((F.col("__nan") > 0) | ((F.col("__inf") > 0) & (F.col("__zero") > 0)), float("nan")).when(F.col("__zero") > 0, 0.0)
               .when(F.col("__inf") > 0, sign * float("inf")).otherwise(sign * F.exp(F.col("__log").cast("double") / FIXED)))
    found = r.select(*keys, F.col("__at").alias("__us"), product.alias(name))
    return asks.withColumn("__us", us(time)).join(found, [*keys, "__us"]).select(time, *keys, name)
