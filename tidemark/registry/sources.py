"""Queries of the source and sink family: tables are written in a format and read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import quality, windows
from tidemark.registry.core import query
from tidemark.registry.features import TS
from tidemark.registry.quality import RAW, joined
from tidemark.sources import readers, writers
from tidemark.sources.tables import Table
from tidemark.sources.writers import scratch


def obs_csv(spark, root):
    late = F.col("event_id") % 4 == 0
    text = F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS")
    return fx.obs(spark, root).select("event_id", "location_id", F.when(~late, text).alias("timestamp"), F.when(late, text).alias("date"), "occupancy", "capacity")


@query("src1_csv_scan", ctes("obs") + f"SELECT event_id, location_id, {TS}, round(occupancy, 6) AS occupancy, capacity FROM obs WHERE {TS} BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-28 00:00:00'")
def src1(spark, root):
    path = scratch(spark, "csv")
    writers.write_csv(obs_csv(spark, root), path)
    return readers.read_csv(spark, path, start="2024-01-02 00:00:00", end="2024-01-28 00:00:00")


@query("src2_json_lines", ctes("op_log") + f"SELECT event_id, operation, duration_ms, {TS} FROM op_log")
def src2(spark, root):
    path = scratch(spark, "jsonl")
    writers.append_log(fx.op_log(spark, root).select("event_id", "operation", "duration_ms", "timestamp"), path)
    return readers.read_json_lines(spark, path, "event_id bigint, operation string, duration_ms double, timestamp timestamp")


@query("src3_metric_documents", ctes("metrics") + f"SELECT {TS}, metric_name, value FROM metrics")
def src3(spark, root):
    # documents of five hundred runs
    path = scratch(spark, "history")
    runs = fx.metrics(spark, root).select(
        F.floor(F.col("event_id") / 500).alias("doc"),
        F.struct(F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("timestamp"), F.create_map("metric_name", "value").alias("metrics")).alias("r"))
    docs = runs.groupBy("doc").agg(F.collect_list("r").alias("history"))
    docs.write.partitionBy("doc").json(path)
    return readers.read_metric_history(spark, path + "/*")


@query("src3_profile_document", ctes("features") + " UNION ALL ".join(
    f"SELECT '{c}' AS feature, round(avg(\"{c}\"), 6) AS mean, round(stddev_samp(\"{c}\"), 6) AS std, round(quantile_cont(\"{c}\", 0.25), 6) AS q25, round(quantile_cont(\"{c}\", 0.5), 6) AS q50, round(quantile_cont(\"{c}\", 0.75), 6) AS q75 FROM features"
    for c in ("value", "k", "load")))
def src3b(spark, root):
    from tidemark.operators.drift import baseline_profile

    path = scratch(spark, "profile")
    p = baseline_profile(fx.features(spark, root), ["value", "k", "load"])

    def as_map(c):
        return F.map_from_entries(F.collect_list(F.struct("feature", c)))

    doc = p.agg(as_map("mean").alias("mean"), as_map("std").alias("std"),
                F.create_map(F.lit("0.25"), as_map("q25"), F.lit("0.5"), as_map("q50"), F.lit("0.75"), as_map("q75")).alias("quantiles"))
    doc.write.json(path)
    return readers.read_profile(spark, path)


@query("src4_facility_documents", ctes("facilities") + """SELECT round(latitude, 6) AS latitude, round(longitude, 6) AS longitude, CASE WHEN facility_id % 5 = 0 THEN 'Unknown' ELSE parking_type END AS parking_type,
    CASE WHEN facility_id % 7 = 0 THEN 0 ELSE capacity END::DOUBLE AS capacity, facility_name AS name FROM facilities WHERE facility_id % 9 <> 0""")
def src4(spark, root):
    path = scratch(spark, "facilities")
    n = F.col("facility_id")
    place = F.when(n % 9 != 0, F.concat_ws(",", F.round("longitude", 6).cast("string"), F.round("latitude", 6).cast("string"))).otherwise("somewhere")
    rec = F.struct(place.alias("Coordenades"), F.when(n % 7 == 0, "n/a").otherwise(F.col("capacity").cast("string")).alias("places"),
                   F.when(n % 5 != 0, F.col("parking_type")).alias("tipus_estacionament"), F.col("facility_name").alias("nom"))
    # documents of a hundred records
    docs = fx.facilities(spark, root).select(F.floor(n / 100).alias("page"), rec.alias("r")).groupBy("page").agg(F.struct(F.collect_list("r").alias("records")).alias("result"))
    docs.write.partitionBy("page").json(path)
    return readers.read_facilities(spark, path + "/*")


@query("src5_store_scan", f"SELECT event_id, value, ts AS ts FROM events WHERE event_type = 'purchase' AND user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-02 00:00:00' AND TIMESTAMP '2024-01-29 00:00:00'")
def src5(spark, root):
    e = readers.read_store(spark, f"{root}/events.parquet", equals={"event_type": "purchase", "user_id": 7}, time="ts",
                           start="2024-01-02 00:00:00", end="2024-01-29 00:00:00")
    return e.select("event_id", "value", "ts")


@query("src6_dated_results", ctes("features") + f"""SELECT category AS feature, round(avg(value), 6) AS statistic, CAST(date_trunc('day', {TS}) AS TIMESTAMP) AS result_time FROM features
    WHERE {TS} >= TIMESTAMP '2024-01-24 00:00:00' GROUP BY 1, 3""")
def src6(spark, root):
    path = scratch(spark, "results")
    d = fx.features(spark, root).groupBy(F.col("category").alias("feature"), F.concat(F.lit("drift_result_"), F.date_format("timestamp", "yyyyMMdd"), F.lit("_000000")).alias("file")).agg(
        F.avg("value").alias("statistic"))
    d.write.partitionBy("file").json(path)
    return readers.read_dated_results(spark, path, "feature string, statistic double", "2024-01-31 00:00:00", 7)


@query("snk1_csv_sink", ctes("obs_hourly") + f"SELECT location_id, {TS}, round(occupancy, 6) AS occupancy, capacity FROM obs_hourly")
def snk1(spark, root):
    path = scratch(spark, "hourly")
    writers.write_csv(fx.obs_hourly(spark, root).select("location_id", "timestamp", "occupancy", "capacity"), path)
    return spark.read.schema("location_id string, timestamp timestamp, occupancy double, capacity bigint").option("header", True).csv(path)


@query("snk2_csv_to_json_lines", ctes("obs") + "SELECT event_id, location_id, round(occupancy, 6) AS occupancy FROM obs")
def snk2(spark, root):
    a, b = scratch(spark, "csv"), scratch(spark, "json")
    writers.write_csv(fx.obs(spark, root).select("event_id", "location_id", "occupancy"), a)
    schema = "event_id bigint, location_id string, occupancy double"
    writers.csv_to_json_lines(spark, a, b, schema)
    return readers.read_json_lines(spark, b, schema)


@query("snk3_sink_by_suffix", ctes("obs") + "SELECT 'parquet' AS kind, event_id, k FROM obs UNION ALL SELECT 'csv', event_id, k FROM obs")
def snk3(spark, root):
    o = fx.obs(spark, root).select("event_id", "k")
    a, b = scratch(spark, "o") + ".parquet", scratch(spark, "o") + ".csv"
    writers.write_by_suffix(o, a)
    writers.write_by_suffix(o, b)
    back = spark.read.schema("event_id bigint, k bigint").option("header", True).csv(b).withColumn("kind", F.lit("csv"))
    return spark.read.parquet(a).withColumn("kind", F.lit("parquet")).unionByName(back)


@query("snk4_append_log", ctes("scored_metrics") + """SELECT model_id, count(*) AS events, count(*) FILTER (value < 1) AS successes, min(round(value, 6)) AS lowest, TIMESTAMP '2024-02-01 00:00:00' AS "timestamp" FROM (
    SELECT * FROM scored_metrics UNION ALL SELECT * FROM scored_metrics WHERE metric_name = 'rmse') GROUP BY 1""")
def snk4(spark, root):
    path = scratch(spark, "log")
    m = fx.scored_metrics(spark, root).select("model_id", (F.col("value") < 1).alias("success"), "value", "metric_name")
    writers.append_log(writers.retraining_events(m, "2024-02-01 00:00:00"), path)
    writers.append_log(writers.retraining_events(m.where(F.col("metric_name") == "rmse"), "2024-02-01 00:00:00"), path)
    log = readers.read_json_lines(spark, path, "model_id string, timestamp timestamp, success boolean, details string")
    value = F.get_json_object("details", "$.value").cast("double")
    return log.groupBy("model_id", "timestamp").agg(F.count(F.lit(1)).alias("events"), F.count_if("success").alias("successes"), F.min(value).alias("lowest"))


@query("snk5_insert_once", ctes("obs") + "SELECT event_id, location_id FROM obs")
def snk5(spark, root):
    o = fx.obs(spark, root).select("event_id", "location_id")
    table = Table.create(o.where(F.col("event_id") % 3 == 0), scratch(spark, "insert"), "event_id", 4)
    table.insert_once(o)
    table.insert_once(o.where(F.col("event_id") % 2 == 0))  # a repeated load
    return table.read()


@query("snk6_verified_backup", ctes("metrics") + f"SELECT CAST({TS} AS DATE) AS \"date\", hour({TS}) AS hour, count(*) AS rows, TRUE AS verified FROM metrics GROUP BY 1, 2")
def snk6(spark, root):
    return writers.backup(fx.metrics(spark, root), scratch(spark, "backup"))


@query("snk7_validation_export", ctes("raw_dirty", extra=f"v AS (SELECT record_id, {joined(RAW)} AS r FROM raw_dirty)") + """SELECT (SELECT count(*) FROM v)::DOUBLE AS total_count, (SELECT count(*) FROM v WHERE r <> '')::DOUBLE AS invalid_count, count(*) AS listed, max(record_id) AS last_listed
    FROM (SELECT record_id FROM v WHERE r <> '' ORDER BY record_id LIMIT 10)""")
def snk7(spark, root):
    path = scratch(spark, "export")
    writers.export_validation(quality.validate(fx.raw_dirty(spark, root), "raw").select("record_id", "reasons"), path, "record_id")
    d = readers.read_json_lines(spark, path, "summary map<string, double>, invalid_records array<struct<record_id: bigint, reasons: array<string>>>")
    return d.select(F.col("summary")["total_count"].alias("total_count"), F.col("summary")["invalid_count"].alias("invalid_count"),
                    F.size("invalid_records").cast("bigint").alias("listed"), F.array_max("invalid_records.record_id").alias("last_listed"))
