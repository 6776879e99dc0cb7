"""Slices of the order (time, ties) at places that the data decide.

Window functions sort a partition in one task. A key may hold any share of the rows, and any share of those may have one time, so
neither the key nor a fixed span of time bounds a task. Where a key has more than SLICE_ROWS rows, the order is cut at quantiles of
the time; where several quantiles fall on one instant, that instant is cut at sampled values of the tie columns. Every slice then
holds about SLICE_ROWS rows of all keys together, and what lies before a slice reaches it as one leading row per key."""

from __future__ import annotations

from collections import Counter
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, functions as F, types as T

SLICE = "__slice"
#: Rows that a task should sort at most.
SLICE_ROWS = 1_000_000
#: Rows sampled per cut of an instant.
SAMPLE = 50
LEAST = -(1 << 63)


def number(df: DataFrame, time: str) -> Column:
    """The time as a long that keeps its order; null is the least."""
    kind = df.schema[time].dataType
    c = F.col(time)
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        c = F.unix_micros(c.cast("timestamp"))
    elif isinstance(kind, T.DateType):
        c = F.unix_date(c)
    return F.coalesce(c.cast("bigint"), F.lit(LEAST))


def largest(df: DataFrame, keys: Sequence[str]) -> tuple[int, int]:
    """Rows of the largest key and of the whole frame: one pass over the key columns, combined before the shuffle."""
    one = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n").alias("most"), F.sum("n").alias("all")).first()
    return one["most"] or 0, one["all"] or 0


def needed(df: DataFrame, keys: Sequence[str]) -> int:
    """How many slices the order needs: 1 if every key fits into a task."""
    most, rows = largest(df, keys)
    return 1 if most <= SLICE_ROWS else -(-rows // SLICE_ROWS)


def _picked(rows: list[tuple], parts: int) -> list[tuple]:
    """Up to parts - 1 different rows that cut a sorted sample into equal parts; nulls come first."""
    rows = sorted(rows, key=lambda r: [(v is not None, v) if v is not None else (False,) for v in r])
    cuts = [rows[len(rows) * i // parts] for i in range(1, parts)] if rows else []
    return [c for i, c in enumerate(cuts) if c != rows[0] and (i == 0 or c != cuts[i - 1])]


def with_slice(df: DataFrame, time: str, ties: Sequence[str] | None, slices: int) -> DataFrame:
    """Add SLICE, a number that grows with (time, ties); without ties (None) rows of one time share a slice. The driver gets one time per slice and SAMPLE rows per cut of an instant."""
    at = number(df, time)
    if slices <= 1:
        return df.withColumn(SLICE, F.lit(0).cast("bigint"))
    found = df.agg(F.percentile_approx(at, [i / slices for i in range(1, slices)], max(10_000, 10 * slices)).alias("q"), F.count(F.lit(1)).alias("n")).first()
    quantiles = found["q"] or []
    times = sorted(set(quantiles))
    crowded = {t: c for t, c in Counter(quantiles).items() if c > 1 and ties is not None}
    tied = [F.col(t) for t in ties or ()] or [F.xxhash64(*[F.col(f"`{c}`") for c in df.columns])]
    order = F.struct(*[c.alias(f"t{i}") for i, c in enumerate(tied)])
    inside: dict[int, list[Column]] = {}
    if crowded:
        share = min(1.0, SAMPLE * slices / found["n"])
        sample: dict[int, list[tuple]] = {}
        for r in df.where(at.isin(list(crowded))).select(at.alias("at"), order.alias("o")).sample(share, seed=11).collect():
            sample.setdefault(r["at"], []).append(tuple(r["o"]))
        kinds = df.select(order.alias("o")).schema["o"].dataType.fields
        for t, c in crowded.items():
            picked = _picked(sample.get(t, []), c + 1)
            if picked:
                inside[t] = [F.struct(*[F.lit(v).cast(k.dataType).alias(k.name) for v, k in zip(row, kinds)]) for row in picked]
    cutter = Bucketizer(splits=[float("-inf"), *map(float, times), float("inf")], inputCol="__slice_num", outputCol="__slice_i", handleInvalid="keep")
    out = cutter.transform(df.withColumn("__slice_at", at).withColumn("__slice_num", F.col("__slice_at").cast("double")))
    i = F.col("__slice_i").cast("bigint")
    if not inside:
        return out.withColumn(SLICE, i).drop("__slice_at", "__slice_num", "__slice_i")
    before, total = [0], 0
    for t in times:
        before.append(total)
        total += len(inside.get(t, []))
    local = F.lit(0)
    for t, cuts in inside.items():
        here = F.size(F.filter(F.array(*cuts), lambda b: b <= order))
        local = F.when(F.col("__slice_i") == times.index(t) + 1, F.when(F.col("__slice_at") == t, here).otherwise(len(cuts))).otherwise(local)
    return out.withColumn(SLICE, i + F.element_at(F.array(*[F.lit(b) for b in before]), (i + 1).cast("int")) + local).drop("__slice_at", "__slice_num", "__slice_i")
