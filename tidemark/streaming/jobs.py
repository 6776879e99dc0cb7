"""Structured Streaming jobs over metric, operation, health and observation streams.

Each builder takes a streaming frame and returns a streaming frame or a started query's writer, so the
same job runs from files, Kafka or any other source. `drain` runs a job over what is available."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.functions import rules
from tidemark.operators import features as feats
from tidemark.operators import quality, repair
from tidemark.session import cut
from tidemark.sources.tables import Table
from tidemark.sources.writers import scratch


def read_files(spark: SparkSession, path: str, schema, per_trigger: int = 1, pattern: str | None = None) -> DataFrame:
    """File stream of parquet files, oldest first."""
    r = spark.readStream.schema(schema).option("maxFilesPerTrigger", per_trigger)
    if pattern:
        r = r.option("pathGlobFilter", pattern)
    return r.parquet(path)


def drain(stream: DataFrame, name: str, mode: str = "append", path: str | None = None) -> DataFrame:
    """Run a stream over everything available into a parquet table and return the table."""
    spark = stream.sparkSession
    out = path or scratch(spark, name)
    q = (stream.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", f"{out}-state")
         .trigger(availableNow=True).start())
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(out)


def drain_batches(stream: DataFrame, name: str, handle: Callable[[DataFrame, int], None]) -> None:
    """Run a stream over everything available, one call of `handle` per micro-batch."""
    state = scratch(stream.sparkSession, f"{name}-state")
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", state).trigger(availableNow=True).start().awaitTermination()


def drain_windows(stream: DataFrame, name: str, keys: list[str], path: str | None = None, buckets: int = 4) -> Table:
    """Run a windowed aggregation over everything available into a stored table that always has every window's newest values.

    The stream runs in update mode: each micro-batch gives the windows it changed, open ones too, and they replace their rows in the
    table. The batch's number is part of the table's version, so a batch that is repeated after a failure is applied once."""
    spark = stream.sparkSession
    out = path or scratch(spark, name)
    table = Table(spark, out)
    if not table.exists():
        Table.create(spark.createDataFrame([], stream.schema), out, keys, buckets)

    def handle(batch: DataFrame, batch_id: int) -> None:
        table.upsert(batch.persist(), token=(name, batch_id))
        batch.unpersist()
        table.vacuum(10)

    q = stream.writeStream.outputMode("update").foreachBatch(handle).option("checkpointLocation", f"{out}-state").trigger(availableNow=True).start()
    q.awaitTermination()
    return table


def write_batch(df: DataFrame, path: str, batch_id: int) -> None:
    """One folder per micro-batch, overwritten when the batch is repeated: each batch counts once."""
    df.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")


def extract_metrics(stream: DataFrame, good: str, bad: str, as_of: str) -> None:
    """Validate arriving metric records; accepted rows to `good`, rejected ones with reasons to `bad`."""

    def handle(batch: DataFrame, batch_id: int) -> None:
        v = quality.validate_metrics(batch, as_of).persist()
        write_batch(v.where(F.size("reasons") == 0).drop("reasons"), good, batch_id)
        write_batch(v.where(F.size("reasons") > 0), bad, batch_id)
        v.unpersist()

    drain_batches(stream, "extract", handle)


RUNNING = "metric_name string, count long, last_value double, last_us long, rate_of_change double"
PARTIAL = "metric_name string, n long, first_us long, last_us long, last_value double"


def running_metrics(stream: DataFrame) -> DataFrame:
    """State per metric across micro-batches: rows so far, last value and time, and the change per hour
    against the last value of the batch before.

    Arrow batches are first reduced to one row per metric, so a hot metric sends few rows to its state."""

    def partial(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            s = pdf.sort_values("us")
            g = s.groupby("metric_name", sort=False)
            yield pd.DataFrame({"metric_name": g.size().index, "n": g.size().to_numpy(), "first_us": g["us"].first().to_numpy(),
                                "last_us": g["us"].last().to_numpy(), "last_value": g["value"].last().to_numpy()})

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        count, last_us, last_value = state.get if state.exists else (0, None, None)
        n, new_us, new_value = 0, None, None
        for f in frames:
            n += int(f["n"].sum())
            i = f["last_us"].idxmax()
            if new_us is None or f["last_us"][i] > new_us:
                new_us, new_value = int(f["last_us"][i]), float(f["last_value"][i])
        rate = None
        if last_us is not None and new_us > last_us:
            rate = (new_value - last_value) / ((new_us - last_us) / 3.6e9)
        if last_us is None or new_us >= last_us:
            last_us, last_value = new_us, new_value
        state.update((count + n, last_us, last_value))
        yield pd.DataFrame({"metric_name": [key[0]], "count": [count + n], "last_value": [last_value], "last_us": [last_us],
                            "rate_of_change": pd.array([rate], dtype="float64")})

    rows = stream.select("metric_name", F.unix_micros("timestamp").alias("us"), "value").mapInPandas(partial, PARTIAL)
    return rows.groupBy("metric_name").applyInPandasWithState(update, RUNNING, "count long, last_us long, last_value double", "append",
                                                              GroupStateTimeout.NoTimeout)


def operation_monitor(stream: DataFrame, window: str = "24 hours", slide: str = "6 hours", late: str = "1 hour") -> DataFrame:
    """Counts, errors and p95 of each operation over sliding windows."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window, slide), "operation").agg(
        F.count(F.lit(1)).alias("query_count"), F.count_if("is_error").alias("error_count"),
        F.percentile_approx("duration_ms", 0.95, 10_000).alias("p95_ms")).select(
        F.col("window.start").alias("window_start"), F.col("window.end").alias("window_end"), "operation", "query_count", "error_count", "p95_ms")


def error_rates(stream: DataFrame, window: str = "5 minutes", late: str = "1 hour") -> DataFrame:
    """Requests, error rate and mean latency per model and tumbling window."""
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window), "model_id").agg(
        F.count(F.lit(1)).alias("request_count"), F.avg(F.col("is_error").cast("double")).alias("error_rate"),
        F.avg("duration_ms").alias("mean_latency_ms")).select(F.col("window.start").alias("window_start"), "model_id", "request_count", "error_rate", "mean_latency_ms")


SEVERITY = ["healthy", "unknown", "degraded", "critical"]


def health_rollup(stream: DataFrame, window: str = "1 hour", late: str = "1 hour") -> DataFrame:
    """Worst status and sample count per window."""
    rank = F.array_position(F.array(*[F.lit(s) for s in SEVERITY]), F.coalesce(F.col("status"), F.lit("unknown")))
    worst = F.element_at(F.array(*[F.lit(s) for s in SEVERITY]), F.greatest(F.max(rank), F.lit(1)).cast("int"))
    return stream.withWatermark("timestamp", late).groupBy(F.window("timestamp", window)).agg(
        F.count(F.lit(1)).alias("samples"), worst.alias("overall_status")).select(F.col("window.start").alias("window_start"), "samples", "overall_status")


def score_arrivals(stream: DataFrame) -> DataFrame:
    """Rule-model score of each observation on arrival."""
    return feats.rule_scores(stream)


# The time columns of the records.
TIMES = {"feature": ["timestamp"], "raw": ["timestamp"], "prediction": ["prediction_timestamp", "predicted_for_timestamp"]}

#: Rows of a micro-batch per task, from which on it is spread over the cores.
TASK_ROWS = 250_000


def validate_and_load(stream: DataFrame, kind: str, loaded: str, aside: str, fix: bool = False, as_of: str | None = None, known: DataFrame | None = None) -> None:
    """Validate each micro-batch; valid rows are loaded, invalid ones set aside, or repaired and loaded.

    Predictions: `as_of` stands for a missing time, and what stands for missing values comes from the table `known`, so that the
    result does not depend on how files arrive (without it, from the micro-batch, as for the other kinds)."""
    if kind == "prediction" and fix and as_of is None:
        raise ValueError("repaired predictions need as_of")
    # found once and written, as a batch would read the whole table for it
    fills = cut(repair.prediction_fills(known)) if kind == "prediction" and fix and known is not None else None
    mend = {"feature": repair.fix_features, "raw": repair.fix_raw, "prediction": lambda d: repair.fix_predictions(d, as_of, fills=fills)}
    cores = stream.sparkSession.sparkContext.defaultParallelism

    def handle(batch: DataFrame, batch_id: int) -> None:
        # a batch is a few files, and a file may be one task
        parts = min(cores, -(-batch.count() // TASK_ROWS))
        v = quality.validate(batch.repartition(parts) if parts > 1 else batch, kind).persist()
        bad = F.size("reasons") > 0
        write_batch(v.where(bad), aside, batch_id)
        if fix:
            write_batch(mend[kind](v.drop("reasons")), loaded, batch_id)
        else:
            good = v.where(~bad).drop("reasons").withColumns({c: rules.parse_time(F.col(c)) for c in TIMES[kind]})
            write_batch(good, loaded, batch_id)
        v.unpersist()

    drain_batches(stream, "load", handle)


KEPT = "model_id string, metric_name string, us long, current_value double"


def throttle_alerts(alerts: DataFrame, cooldown_minutes: int = 15, per_hour: int = 10) -> DataFrame:
    """Alerts that pass the rules: per model and metric none within the cooldown of the last one passed,
    and at most `per_hour` per model and clock hour. Alerts are taken in time order inside a micro-batch."""
    gap = cooldown_minutes * 60_000_000
    hour_us = 3_600_000_000

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        hour, sent, names, times = state.get if state.exists else (-1, 0, [], [])
        last = dict(zip(names, times))
        rows = pd.concat(list(frames)).sort_values(["us", "metric_name", "current_value"])
        keep = []
        for r in rows.itertuples():
            h = r.us // hour_us
            if h > hour:
                hour, sent = h, 0
            if r.us - last.get(r.metric_name, -gap) < gap or sent >= per_hour:
                continue
            last[r.metric_name] = r.us
            sent += 1
            keep.append((key[0], r.metric_name, r.us, r.current_value))
        state.update((int(hour), int(sent), list(last), [int(t) for t in last.values()]))
        yield pd.DataFrame(keep, columns=["model_id", "metric_name", "us", "current_value"])

    rows = alerts.select("model_id", "metric_name", F.unix_micros("timestamp").alias("us"), "current_value")
    return rows.groupBy("model_id").applyInPandasWithState(
        update, KEPT, "hour long, sent long, names array<string>, times array<long>", "append", GroupStateTimeout.NoTimeout)
