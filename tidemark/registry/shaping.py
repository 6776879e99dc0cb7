"""Queries of the projection and filter family."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidemark import fixtures as fx
from tidemark.fixtures import ctes
from tidemark.operators import shaping as op
from tidemark.registry.core import query


@query("pf1_date_range", ctes("obs") + """SELECT event_id, location_id, "timestamp", round(occupancy, 6) AS occupancy FROM obs
    WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-05 00:00:00' AND TIMESTAMP '2024-01-20 12:00:00'""")
def pf1(spark, root):
    return op.date_range(fx.obs(spark, root), "timestamp", "2024-01-05 00:00:00", "2024-01-20 12:00:00").select(
        "event_id", "location_id", "timestamp", "occupancy")


@query("pf2_relative_range", ctes("metrics") + """SELECT '7d' AS range_name, * FROM metrics
    WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-23 12:00:00' AND TIMESTAMP '2024-01-30 12:00:00'
        AND metric_name IN ('view', 'click')
    UNION ALL SELECT 'custom', * FROM metrics
    WHERE "timestamp" BETWEEN TIMESTAMP '2024-01-03 00:00:00' AND TIMESTAMP '2024-01-04 00:00:00'""")
def pf2(spark, root):
    m = fx.metrics(spark, root)
    as_of = datetime(2024, 1, 30, 12)
    week = op.relative_range(m, "timestamp", "7d", as_of, name_col="metric_name", names=["view", "click"])
    custom = op.relative_range(m, "timestamp", "custom", as_of, datetime(2024, 1, 3), datetime(2024, 1, 4))
    return week.withColumn("range_name", F.lit("7d")).unionByName(custom.withColumn("range_name", F.lit("custom")))


@query("pf3_schema_check", ctes("obs") + """SELECT v.column_name, v.is_present, v.type_ok, n.has_rows FROM
    (VALUES ('timestamp', TRUE, TRUE), ('location_id', TRUE, TRUE), ('occupancy', TRUE, TRUE), ('capacity', TRUE, FALSE),
        ('tariff', FALSE, FALSE)) v(column_name, is_present, type_ok), (SELECT count(*) > 0 AS has_rows FROM obs) n""")
def pf3(spark, root):
    return op.schema_report(fx.obs(spark, root), ["timestamp", "location_id", "occupancy", "capacity", "tariff"],
                            {"occupancy": "double", "capacity": "double"})


@query("pf4_predicates", ctes("raw_dirty") + """SELECT record_id,
    coalesce(occupancy_rate BETWEEN 0 AND 1, FALSE) AS rate_ok, coalesce(total_spots > 0, FALSE) AS spots_ok,
    coalesce(record_id / 100.0 BETWEEN -90 AND 90, FALSE) AND coalesce(record_id / 50.0 BETWEEN -180 AND 180, FALSE)
        AS coordinates_ok FROM raw_dirty""")
def pf4(spark, root):
    r = fx.raw_dirty(spark, root)
    return r.select("record_id", op.in_range(F.col("occupancy_rate"), 0, 1).alias("rate_ok"),
                    op.positive(F.col("total_spots")).alias("spots_ok"),
                    op.valid_coordinates(F.col("record_id") / 100, F.col("record_id") / 50).alias("coordinates_ok"))


@query("pf5_alias_mapping", ctes("segments") + """SELECT segment_id AS location_id, "timestamp" AS observed_at, level AS occupancy,
    event_id, kind FROM segments""")
def pf5(spark, root):
    return op.map_aliases(
        fx.segments(spark, root).drop("tariff"),
        {"location_id": ["zone_id", "segment_id"], "observed_at": ["datetime", "timestamp"],
         "occupancy": ["occupancy_level", "level"], "humidity": ["rel_humidity"]})


@query("pf6_export_form", ctes("obs_hourly", extra="""g AS (SELECT o.event_id, o."timestamp", h.occupancy,
    CASE WHEN o.event_id % 3 <> 0 THEN o.raw_value / 5 END AS temperature,
    CASE WHEN o.event_id % 4 <> 0 THEN CAST(o.k AS DOUBLE) END AS precipitation FROM obs o
    LEFT JOIN obs_hourly h ON o.location_id = h.location_id AND o."timestamp" = h."timestamp")""") + """
    SELECT event_id, strftime("timestamp", '%Y-%m-%dT%H:%M:%SZ') AS "timestamp", round(coalesce(occupancy, -999), 6) AS occupancy,
    round(coalesce(temperature, -999), 6) AS temperature, coalesce(precipitation, 0.0::DOUBLE) AS precipitation FROM g""")
def pf6(spark, root):
    o, h = fx.obs(spark, root), fx.obs_hourly(spark, root)
    g = o.drop("occupancy").join(h.select("location_id", "timestamp", "occupancy"), ["location_id", "timestamp"], "left").select(
        "event_id", "timestamp", "occupancy", F.when(F.col("event_id") % 3 != 0, F.col("raw_value") / 5).alias("temperature"),
        F.when(F.col("event_id") % 4 != 0, F.col("k").cast("double")).alias("precipitation"))
    return op.export_form(g)


@query("pf7_bounding_box", ctes("points") + """SELECT point_id, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude
    FROM points WHERE latitude BETWEEN 41.36 AND 41.42 AND longitude BETWEEN 2.12 AND 2.2""")
def pf7(spark, root):
    return op.bounding_box(fx.points(spark, root), "latitude", "longitude", 41.36, 41.42, 2.12, 2.2)


@query("pf8_numeric_coercion", """SELECT o_orderkey AS record_id, TRY_CAST(CASE WHEN o_orderkey % 7 = 0 THEN 'n/a'
    WHEN o_orderkey % 11 = 0 THEN NULL ELSE CAST(o_custkey AS VARCHAR) || '.5' END AS DOUBLE) AS reading FROM orders
    WHERE NOT (o_orderkey % 7 = 0 OR o_orderkey % 11 = 0)""")
def pf8(spark, root):
    o = fx.read_table(spark, root, "orders")
    text = F.when(F.col("o_orderkey") % 7 == 0, "n/a").when(
        F.col("o_orderkey") % 11 != 0, F.concat(F.col("o_custkey").cast("string"), F.lit(".5")))
    return op.coerce_numeric(o.select(F.col("o_orderkey").alias("record_id"), text.alias("reading")), ["reading"])


@query("pf9_parse_coordinates", """WITH t AS (SELECT c_custkey AS point_id, CASE c_custkey % 4
    WHEN 0 THEN CAST(c_custkey AS VARCHAR) || '.25,' || (c_custkey % 90) || '.5'
    WHEN 1 THEN '[' || c_custkey || '.5, ' || (c_custkey % 90) || '.75]'
    WHEN 2 THEN 'unknown' ELSE CAST(c_custkey AS VARCHAR) END AS s FROM customer),
    p AS (SELECT point_id, string_split(translate(s, '[]()', ''), ',') AS a FROM t),
    q AS (SELECT point_id, TRY_CAST(trim(a[1]) AS DOUBLE) AS x, TRY_CAST(trim(a[2]) AS DOUBLE) AS y FROM p)
    SELECT point_id, CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN x END AS lon,
    CASE WHEN x IS NOT NULL AND y IS NOT NULL THEN y END AS lat FROM q""")
def pf9(spark, root):
    c = fx.read_table(spark, root, "customer")
    key, s = F.col("c_custkey"), F.col("c_custkey").cast("string")
    deg = (F.col("c_custkey") % 90).cast("string")
    text = (F.when(key % 4 == 0, F.concat(s, F.lit(".25,"), deg, F.lit(".5")))
            .when(key % 4 == 1, F.concat(F.lit("["), s, F.lit(".5, "), deg, F.lit(".75]")))
            .when(key % 4 == 2, "unknown").otherwise(s))
    lon, lat = op.parse_pair(text)
    return c.select(key.alias("point_id"), lon.alias("lon"), lat.alias("lat"))


@query("pf10_tariff", ctes("segments") + """SELECT event_id, CAST(regexp_extract(replace(replace(tariff, '.', ','), ',', '.'),
    '([0-9.]+)', 1) AS DOUBLE) AS tariff_numeric FROM segments""")
def pf10(spark, root):
    s = fx.segments(spark, root).withColumn("tariff", F.replace("tariff", F.lit("."), F.lit(",")))
    return s.select("event_id", op.tariff_number(F.col("tariff")).alias("tariff_numeric"))


@query("pf11_normalize_occupancy", ctes("obs") + """, s AS (SELECT max(raw_value) AS top FROM obs)
    SELECT 'by_capacity' AS how, event_id, round(least(greatest(CASE WHEN top > 100 THEN raw_value / capacity * 100
        ELSE raw_value END, 0.0), 100.0), 6) AS occupancy FROM obs, s
    UNION ALL SELECT 'by_max', event_id, round(least(greatest(CASE WHEN top > 100 THEN raw_value / top * 100 ELSE raw_value END,
        0.0), 100.0), 6) FROM obs, s""")
def pf11(spark, root):
    o = fx.obs(spark, root).drop("occupancy").withColumnRenamed("raw_value", "occupancy")
    a = op.normalize_occupancy(o).select(F.lit("by_capacity").alias("how"), "event_id", "occupancy")
    b = op.normalize_occupancy(o, capacity=None).select(F.lit("by_max").alias("how"), "event_id", "occupancy")
    return a.unionByName(b)


@query("pf12_min_max_scale", ctes("obs") + """SELECT event_id, round((raw_value - lo) / (hi - lo) * 10 - 5, 6) AS scaled
    FROM obs, (SELECT min(raw_value) AS lo, max(raw_value) AS hi FROM obs)""")
def pf12(spark, root):
    return op.min_max_scale(fx.obs(spark, root), "raw_value", "scaled", -5.0, 5.0).select("event_id", "scaled")


@query("pf13_flatten_health", ctes("op_log") + """SELECT "timestamp", event_id AS operations_total_count,
    CASE WHEN is_error THEN 0.0 ELSE 1.0 END::DOUBLE AS operations_success_rate, duration_ms AS latency_avg_ms,
    round(duration_ms * 2, 6) AS latency_p95_ms, NULL::DOUBLE AS latency_p99_ms,
    CASE WHEN is_error THEN 1.0 ELSE 0.0 END::DOUBLE AS error_rate, event_id % 7 AS connection_attempts,
    event_id % 3 AS connection_failures, 0.5::DOUBLE AS connection_success_rate, duration_ms AS connection_avg_latency_ms
    FROM op_log""")
def pf13(spark, root):
    log = fx.op_log(spark, root)
    ok = F.when(F.col("is_error"), 0.0).otherwise(1.0)
    doc = F.to_json(F.struct(
        F.struct(F.col("event_id").alias("total_count"), ok.alias("success_rate")).alias("operations"),
        F.struct(F.col("duration_ms").alias("latency_avg_ms"), (F.col("duration_ms") * 2).alias("latency_p95_ms"),
                 (1 - ok).alias("error_rate")).alias("performance"),
        F.struct((F.col("event_id") % 7).alias("attempts"), (F.col("event_id") % 3).alias("failures"),
                 F.lit(0.5).alias("success_rate"), F.col("duration_ms").alias("avg_latency_ms")).alias("connection")))
    return op.flatten_health(log.select("timestamp", doc.alias("doc")), "doc")


@query("pf14_column_kinds", """SELECT v.column_name, v.kind, n.non_null FROM (VALUES ('event_id', 'numeric'), ('value', 'numeric'),
    ('k', 'numeric'), ('load', 'numeric'), ('category', 'categorical'), ('zone', 'categorical')) v(column_name, kind),
    (SELECT count(*) AS non_null FROM events) n""")
def pf14(spark, root):
    f = fx.features(spark, root)
    numeric, other = op.split_columns(f)
    kinds = {c: "numeric" for c in numeric} | {c: "categorical" for c in other}
    counts = f.agg(*[F.count(c).alias(c) for c in kinds])
    rows = [F.struct(F.lit(c).alias("column_name"), F.lit(k).alias("kind"), F.col(c).alias("non_null")) for c, k in kinds.items()]
    return counts.select(F.explode(F.array(*rows)).alias("r")).select("r.*")


@query("pf15_split_assignment", ctes("features") + """SELECT event_id, CASE WHEN p < n * 0.7::DOUBLE THEN 'train'
    WHEN p < n * 0.85::DOUBLE THEN 'test' ELSE 'validation' END AS split_type FROM (SELECT event_id,
    row_number() OVER (ORDER BY "timestamp", event_id) - 1 AS p, count(*) OVER () AS n FROM features)""")
def pf15(spark, root):
    return op.assign_split(fx.features(spark, root), "timestamp", ["event_id"]).select("event_id", "split_type")


@query("pf16_training_listing", ctes("obs") + """SELECT event_id, location_id, "timestamp", round(occupancy, 6) AS occupancy FROM obs
    WHERE location_id = 'LOC_3' AND "timestamp" BETWEEN TIMESTAMP '2024-01-04 00:00:00' AND TIMESTAMP '2024-01-25 23:59:59'
    ORDER BY "timestamp" DESC, event_id LIMIT 100""")
def pf16(spark, root):
    tables = {"raw": fx.obs(spark, root).select("event_id", "location_id", "timestamp", "occupancy"),
              "hourly": fx.obs_hourly(spark, root)}
    return op.listing(tables, "raw", location="LOC_3", start="2024-01-04", end="2024-01-25", ties=["event_id"])


@query("pf17_drift_rows", ctes("features") + """SELECT sha256('m1|' || category || '|2024-02-01 00:00:00') AS id, 'm1' AS model_id,
    category AS feature, round(greatest(ks, dd / 100), 6) AS drift_score, round(ks, 6) AS ks_statistic,
    round(dd, 6) AS distribution_difference, TIMESTAMP '2024-02-01 00:00:00' AS "timestamp" FROM
    (SELECT category, max(k) / 100 AS ks, avg(value) AS dd FROM features GROUP BY 1)""")
def pf17(spark, root):
    d = fx.features(spark, root).groupBy(F.col("category").alias("feature")).agg(
        (F.max("k") / 100).alias("ks_statistic"), F.avg("value").alias("distribution_difference"))
    return op.drift_rows(d, "m1", "2024-02-01 00:00:00").drop("metadata")
