"""Window computations over long series without one task per key.

A key may hold a large share of all rows, so no window here is partitioned by the key alone unless every key fits into a task:

* `with_ordinal` numbers the rows of a key through the counts of slices (see plans.slices),
* `row_frame` runs row-bounded frames inside blocks of consecutive rows plus a halo,
* `sliding` gives sums, extremes and first values of trailing time frames in one growing pass: rows
  enter at their time and leave one span later, so the cost per row does not depend on the frame,
* `running_counts` gives totals of all earlier rows,
* `with_known` carries the last / next known value across slices.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.ml.feature import Bucketizer
from pyspark.sql import Column, DataFrame, Window, WindowSpec, functions as F

from tidemark.plans import slices
from tidemark.plans.slices import SLICE, needed, with_slice

ORDINAL = "__ordinal"
BLOCK = "__block"
HOME = "__home"
BLOCK_ROWS = 1_000_000


def with_ordinal(df: DataFrame, keys: Sequence[str], time: str, ties: Sequence[str] = (), name: str = ORDINAL,
                 parts: int | None = None) -> DataFrame:
    """0-based position of each row in its key's order (time, ties). `parts`: slices, if already known.

    Every slice of a key gets one leading row that brings the number of rows before it, so one shuffle does it and rows without a
    key or a time stay."""
    parts = needed(df, keys) if parts is None else parts
    if parts == 1:
        return df.withColumn(name, F.row_number().over(Window.partitionBy(*keys).orderBy(time, *ties)) - 1)
    cut_up = with_slice(df, time, ties, parts)
    sizes = cut_up.groupBy(*keys, SLICE).agg(F.count(F.lit(1)).alias("__size"))
    # at most one row per slice and key
    before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    lead = sizes.select(*keys, SLICE, F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"), F.lit(0).alias("__kind"))
    flow = cut_up.withColumn("__kind", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    local = Window.partitionBy(*keys, SLICE).orderBy("__kind", time, *ties)
    position = F.first("__offset", ignorenulls=True).over(local.rowsBetween(Window.unboundedPreceding, 0)) + F.row_number().over(local) - 2
    return flow.withColumn(name, position).where(F.col("__kind") == 1).drop("__offset", "__kind", SLICE)


def row_frame(df: DataFrame, keys: Sequence[str], time: str, compute: Callable[[WindowSpec], dict[str, Column]], ties: Sequence[str] = (),
              before: int = 1, after: int = 0, block_rows: int | None = None) -> DataFrame:
    """Add row-frame columns. `compute` gets a window ordered inside a block; its frames may reach at
    most `before` rows back and `after` rows ahead, which the halo of each block covers. Without
    `block_rows`, keys that fit into a task are one block."""
    parts = needed(df, keys)
    if parts == 1 and block_rows is None:
        return df.withColumns(compute(Window.partitionBy(*keys).orderBy(time, *ties)))
    size = max(block_rows or min(BLOCK_ROWS, slices.SLICE_ROWS), before, after, 1)
    o = with_ordinal(df, keys, time, ties, parts=parts)
    pos = F.col(ORDINAL)
    o = o.withColumn(HOME, F.floor(pos / size))
    homes = F.array_distinct(
        F.array(F.col(HOME), F.floor((pos + before) / size), F.greatest(F.floor((pos - after) / size), F.lit(0)))
    )
    o = o.withColumn(BLOCK, F.explode(homes))
    w = Window.partitionBy(*keys, BLOCK).orderBy(ORDINAL)
    return o.withColumns(compute(w)).where(F.col(BLOCK) == F.col(HOME)).drop(ORDINAL, HOME, BLOCK)


def whole(x: Column, width: int) -> Column:
    """Exact integer floor(x / width) of a long column."""
    return ((x - F.pmod(x, F.lit(width))) / width).cast("bigint")


def alike(keys: Sequence[str], prefix: str) -> Column:
    """Equal keys, nulls too; the other side's are named with the prefix."""
    return reduce(lambda x, y: x & y, [F.col(k).eqNullSafe(F.col(f"{prefix}{i}")) for i, k in enumerate(keys)], F.lit(True))


def offsets_of(df: DataFrame, reach: int, parts: int) -> list[int]:
    """Starts of `parts` pieces of a span, at quantiles of the rows' places inside their span, so that the pieces hold alike many rows."""
    q = df.agg(F.percentile_approx(F.pmod(F.col("__us"), F.lit(reach)), [i / parts for i in range(1, parts)], max(10_000, 10 * parts)).alias("q")).first()["q"]
    return [0, *sorted({x for x in q or [] if x > 0})]


def sliding(
    df: DataFrame,
    keys: Sequence[str],
    time: str,
    seconds: int,
    sums: dict[str, Column],
    leaving: dict[str, Column] | None = None,
    extremes: dict[str, tuple[Column, str]] | None = None,
    firsts: dict[str, Column] | None = None,
    open_left: bool = True,
    parts: int = 1,
) -> DataFrame:
    """Add trailing-frame results over (t - span, t] (or [t - span, t]) at constant cost per row.

    Time is cut into spans, and every span at the same places into `parts` blocks. A frame is what is left of the oldest block, the
    whole blocks between, and the current block up to the row. Each block starts with one opening row (totals of the blocks before
    it); each row of the oldest block is a leaving row at the moment it drops out. All results are then running sums, running extremes,
    or the last value seen, inside a block of one key. `leaving` replaces a sum's expression for rows of the span before.

    Rows of one time have one result. If a key does not fit into a task, they are therefore collapsed to one row first, the places
    of the cuts are taken from the data, and the results are joined back."""
    extremes, firsts = extremes or {}, firsts or {}
    reach = seconds * 1_000_000 + (0 if open_left else 1)
    pick = {"min": F.min, "max": F.max}
    base = df.withColumn("__us", F.unix_micros(time))
    gone = {n: (leaving or {}).get(n, c) for n, c in sums.items()}
    most, rows = slices.largest(df, keys)
    own = {f"__d_{n}": F.coalesce(c, F.lit(0)) for n, c in sums.items()} | {f"__g_{n}": F.coalesce(c, F.lit(0)) for n, c in gone.items()}
    own |= {f"__v_{n}": c for n, (c, _) in extremes.items()} | {f"__v_{n}": c for n, c in firsts.items()}
    if most <= slices.SLICE_ROWS:
        width = -(-reach // parts)
        done = _slid(base.withColumns(own), keys, reach, list(range(0, reach, width)), list(sums), {n: how for n, (_, how) in extremes.items()}, list(firsts))
        return done.select(*df.columns, *[F.col(f"__o_{n}").alias(n) for n in (*sums, *extremes, *firsts)])
    # one row per key and time; its parts of the results are combined before the shuffle
    how = {f"__v_{n}": pick[h] for n, (_, h) in extremes.items()}
    instants = base.where(F.col("__us").isNotNull()).withColumns(own).groupBy(*keys, "__us").agg(*[how.get(c, F.min if c.startswith("__v_") else F.sum)(c).alias(c) for c in own])
    # as many pieces as the largest key would need if all its rows lay in one span
    cuts = offsets_of(base, reach, max(parts, -(-rows // slices.SLICE_ROWS)))
    done = _slid(instants, keys, reach, cuts, list(sums), {n: h for n, (_, h) in extremes.items()}, list(firsts))
    done = done.select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], F.col("__us").alias("__at"), *[F.col(f"__o_{n}").alias(n) for n in (*sums, *extremes, *firsts)])
    return base.join(done, (F.col("__us") == F.col("__at")) & alike(keys, "__k"), "left").drop("__us", "__at", *[f"__k{i}" for i in range(len(keys))])


def _slid(base: DataFrame, keys: Sequence[str], reach: int, cuts: list[int], sums: list[str], extremes: dict[str, str], firsts: list[str]) -> DataFrame:
    """`sliding` over rows with columns __us, __d_ and __g_ (a sum's part in its own span and in the next), __v_; adds __o_.

    cuts: where a span's blocks begin, the first one at 0."""
    m = len(cuts)
    pick = {"min": F.min, "max": F.max}
    span = whole(F.col("__us"), reach)
    if m == 1:
        base = base.withColumn(BLOCK, span)
    else:
        cutter = Bucketizer(splits=[*map(float, cuts), float("inf")], inputCol="__in", outputCol="__piece", handleInvalid="keep")
        base = cutter.transform(base.withColumn("__in", F.pmod(F.col("__us"), F.lit(reach)).cast("double")))
        base = base.withColumn(BLOCK, span * m + F.col("__piece").cast("bigint")).drop("__in", "__piece")
    entering = base.withColumn("__at", F.col("__us")).withColumn("__kind", F.lit(1))

    later = Window.partitionBy(*keys, BLOCK).orderBy(-F.col("__us")).rangeBetween(Window.unboundedPreceding, -1)
    leave = base.select(
        *keys, (F.col(BLOCK) + m).alias(BLOCK), (F.col("__us") + reach).alias("__at"), F.lit(0).alias("__kind"),
        *[(-F.col(f"__g_{n}")).alias(f"__d_{n}") for n in sums],
        *[F.struct(pick[how](f"__v_{n}").over(later).alias("v")).alias(f"__s_{n}") for n, how in extremes.items()],
        *[F.struct(F.last(f"__v_{n}").over(later).alias("v")).alias(f"__s_{n}") for n in firsts])

    # opening rows: block totals handed to the blocks of the next span's length
    totals = base.groupBy(*keys, BLOCK).agg(
        *[F.sum(f"__{x}_{n}").alias(f"__t{x}_{n}") for n in sums for x in "dg"],
        *[pick[how](f"__v_{n}").alias(f"__t_{n}") for n, how in extremes.items()],
        *[F.min_by(f"__v_{n}", "__us").alias(f"__t_{n}") for n in firsts])
    given = totals.withColumn("__from", F.col(BLOCK)).withColumn(BLOCK, F.explode(F.sequence(F.col(BLOCK) + 1, F.col(BLOCK) + m)))
    oldest = F.col("__from") == F.col(BLOCK) - m
    same = whole(F.col("__from"), m) == whole(F.col(BLOCK), m)

    def between(c: Column) -> Column:
        return F.when(~oldest, c)

    opening = given.groupBy(*keys, BLOCK).agg(
        *[F.sum(F.when(same, F.col(f"__td_{n}")).otherwise(F.col(f"__tg_{n}"))).alias(f"__d_{n}") for n in sums],
        *[F.struct(pick[how](F.when(oldest, F.col(f"__t_{n}"))).alias("v")).alias(f"__s_{n}") for n, how in extremes.items()],
        *[pick[how](between(F.col(f"__t_{n}"))).alias(f"__m_{n}") for n, how in extremes.items()],
        *[F.struct(F.max(F.when(oldest, F.col(f"__t_{n}"))).alias("v")).alias(f"__s_{n}") for n in firsts],
        *[F.min_by(f"__t_{n}", between(F.col("__from"))).alias(f"__m_{n}") for n in firsts])
    start = whole(F.col(BLOCK), m) * reach + F.element_at(F.array(*[F.lit(c).cast("bigint") for c in cuts]), (F.pmod(F.col(BLOCK), F.lit(m)) + 1).cast("int"))
    opening = opening.withColumn("__at", start - 1).withColumn("__kind", F.lit(0))

    flow = entering.unionByName(leave, allowMissingColumns=True).unionByName(opening, allowMissingColumns=True)
    upto = Window.partitionBy(*keys, BLOCK).orderBy("__at").rangeBetween(Window.unboundedPreceding, 0)
    out = {n: F.sum(f"__d_{n}").over(upto) for n in sums}
    for n, how in extremes.items():
        rest = F.last(f"__s_{n}", ignorenulls=True).over(upto)["v"]
        out[n] = (F.least if how == "min" else F.greatest)(
            pick[how](f"__v_{n}").over(upto), F.first(f"__m_{n}", ignorenulls=True).over(upto), rest)
    for n in firsts:
        rest = F.last(f"__s_{n}", ignorenulls=True).over(upto)["v"]
        out[n] = F.coalesce(rest, F.first(f"__m_{n}", ignorenulls=True).over(upto), F.first(f"__v_{n}", ignorenulls=True).over(upto))
    return flow.withColumns({f"__o_{n}": c for n, c in out.items()}).where(F.col("__kind") == 1)


def running_counts(flow: DataFrame, keys: Sequence[str], at: str, counts: Sequence[str], parts: int, keep: Column) -> DataFrame:
    """The rows that `keep`, with each count column replaced by its total over all rows of the key up to and including theirs, by `at`.

    `at` is a long; rows of one key and place are expected to be few (collapsed). Order is cut into `parts` slices."""
    cut_up = with_slice(flow, at, None, parts) if parts > 1 else flow.withColumn(SLICE, F.lit(0).cast("bigint"))
    if parts > 1:
        totals = cut_up.groupBy(*keys, SLICE).agg(*[F.sum(c).alias(c) for c in counts])
        before = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        lead = totals.select(*keys, SLICE, *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(c) for c in counts], F.lit(slices.LEAST).alias(at))
        cut_up = cut_up.withColumn("__kept", keep).unionByName(lead.withColumn("__kept", F.lit(False)), allowMissingColumns=True)
    else:
        cut_up = cut_up.withColumn("__kept", keep)
    upto = Window.partitionBy(*keys, SLICE).orderBy(at).rangeBetween(Window.unboundedPreceding, 0)
    return cut_up.withColumns({c: F.coalesce(F.sum(c).over(upto), F.lit(0)) for c in counts}).where("__kept").drop("__kept", SLICE)


def with_known(df: DataFrame, keys: Sequence[str], time: str, known: dict[str, tuple[Column, Sequence[Column]]],
               ties: Sequence[str] = ()) -> DataFrame:
    """For every entry name -> (condition, payload columns) add `name_prev` and `name_next`: structs
    (at, payload p0, p1 ...) of the last / first row of the key, in order (time, ties) and including
    the row itself, that fulfils the condition."""
    marks = {
        name: F.when(cond, F.struct(F.col(time).alias("at"), *[F.col(t).alias(f"t{i}") for i, t in enumerate(ties)],
                                    *[c.alias(f"p{i}") for i, c in enumerate(payload)]))
        for name, (cond, payload) in known.items()
    }
    parts = needed(df, keys)
    marked = df.withColumns({f"__m_{n}": c for n, c in marks.items()})
    # growing frames in both directions: each row is visited once
    if parts == 1:
        upto = Window.partitionBy(*keys).orderBy(time, *ties).rowsBetween(Window.unboundedPreceding, 0)
        onward = Window.partitionBy(*keys).orderBy(F.col(time).desc(), *[F.col(t).desc() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
        seen = {f"{n}_prev": F.last(f"__m_{n}", ignorenulls=True).over(upto) for n in known} | {f"{n}_next": F.last(f"__m_{n}", ignorenulls=True).over(onward) for n in known}
        return marked.withColumns(seen).drop(*[f"__m_{n}" for n in known])
    s = with_slice(df, time, ties, parts).withColumns({f"__m_{n}": c for n, c in marks.items()})
    per_slice = s.groupBy(*keys, SLICE).agg(
        *[F.max(f"__m_{n}").alias(f"__hi_{n}") for n in known], *[F.min(f"__m_{n}").alias(f"__lo_{n}") for n in known]
    )
    earlier = Window.partitionBy(*keys).orderBy(F.col(SLICE).asc()).rowsBetween(Window.unboundedPreceding, -1)
    later = Window.partitionBy(*keys).orderBy(F.col(SLICE).desc()).rowsBetween(Window.unboundedPreceding, -1)
    lead = per_slice.select(
        *keys,
        SLICE,
        F.lit(0).alias("__kind"),
        *[F.last(f"__hi_{n}", ignorenulls=True).over(earlier).alias(f"__before_{n}") for n in known],
        *[F.last(f"__lo_{n}", ignorenulls=True).over(later).alias(f"__after_{n}") for n in known],
    )
    flow = s.withColumn("__kind", F.lit(1)).unionByName(lead, allowMissingColumns=True)
    part = Window.partitionBy(*keys, SLICE)
    upto = part.orderBy("__kind", time, *ties).rowsBetween(Window.unboundedPreceding, 0)
    onward = part.orderBy(F.col("__kind"), F.col(time).desc(), *[F.col(t).desc() for t in ties]).rowsBetween(Window.unboundedPreceding, 0)
    # the leading row of a slice holds what the other slices know; a mark inside the slice overrides it
    out = flow.withColumns(
        {f"{n}_prev": F.last(F.coalesce(f"__m_{n}", f"__before_{n}"), ignorenulls=True).over(upto) for n in known}
        | {f"{n}_next": F.last(F.coalesce(f"__m_{n}", f"__after_{n}"), ignorenulls=True).over(onward) for n in known}
    )
    return out.where(F.col("__kind") == 1).drop("__kind", SLICE, *[f"__{p}_{n}" for n in known for p in ("m", "before", "after")])


def fill_forward_back(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str], ties: Sequence[str] = (),
                      back_first: bool = False) -> DataFrame:
    """Last known value, else next known one (or the reverse), per key."""
    k = with_known(df, keys, time, {c: (F.col(c).isNotNull(), [F.col(c)]) for c in cols}, ties)
    sides = ("next", "prev") if back_first else ("prev", "next")
    filled = {c: F.coalesce(*[F.col(f"{c}_{s}")["p0"] for s in sides]) for c in cols}
    return k.withColumns(filled).drop(*[f"{c}_{s}" for c in cols for s in sides])


def interpolate_time(df: DataFrame, keys: Sequence[str], time: str, cols: Sequence[str],
                     ties: Sequence[str] = ()) -> DataFrame:
    """Time-weighted linear interpolation per key: leading nulls stay, trailing ones hold the last value."""
    k = with_known(df, keys, time, {c: (F.col(c).isNotNull(), [F.col(c).cast("double")]) for c in cols}, ties)
    at = F.unix_micros(time)
    filled = {}
    for c in cols:
        p, n = F.col(f"{c}_prev"), F.col(f"{c}_next")
        t0, t1 = F.unix_micros(p["at"]), F.unix_micros(n["at"])
        share = F.try_divide((at - t0).cast("double"), (t1 - t0).cast("double"))
        line = p["p0"] + (n["p0"] - p["p0"]) * share
        filled[c] = (
            F.when(F.col(c).isNotNull(), F.col(c).cast("double"))
            .when(p.isNull(), F.lit(None).cast("double"))
            .when(n.isNull(), p["p0"])
            .otherwise(F.coalesce(line, p["p0"]))
        )
    return k.withColumns(filled).drop(*[f"{c}_{s}" for c in cols for s in ("prev", "next")])
