"""Exact nearest neighbours on the sphere by equi-joins on grid cells.

Cells are squares of 360 / 2^zoom degrees. Coordinates are made distinct first (a sensor reports
many times from one place), and every coordinate searches at the finest zoom whose 3 x 3 block
already holds enough targets: that block bounds the distance of the k-th neighbour, so the cells
within that bound hold the exact answer. Dense and sparse areas thus cost about the same, and no
pair outside the bound is formed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidemark.functions.geo import EARTH_M, haversine

ZOOMS = tuple(range(22, 1, -2))
#: Parts that the sites of one coordinate are dealt into.
PLACE_PARTS = 64
METRES_PER_DEGREE = 111_194.92664455873  # 6 371 000 m * pi / 180


def _cell(deg: Column, offset: float, zoom: Column) -> Column:
    return F.floor((deg + offset) * F.pow(F.lit(2.0), zoom) / 360.0)


def _wrap(x: Column, zoom: Column) -> Column:
    return F.pmod(x, F.pow(F.lit(2.0), zoom).cast("bigint"))


def _zooms() -> Column:
    return F.explode(F.array(*[F.lit(z) for z in ZOOMS]))


def first_of_place(sites: DataFrame, k: int) -> DataFrame:
    """The k smallest ids of every coordinate: no more of them can be among the k nearest of any point. Ids are dealt into parts
    first, so that a coordinate with very many sites is cut down in many tasks."""
    place = ["__tlat", "__tlon"]
    if k == 1:
        return sites.groupBy(*place).agg(F.min("__id").alias("__id"))
    for parts in ([F.pmod(F.xxhash64("__id"), F.lit(PLACE_PARTS))], []):
        nth = F.row_number().over(Window.partitionBy(*place, *parts).orderBy("__id"))
        sites = sites.withColumn("__nth", nth).where(F.col("__nth") <= k).drop("__nth")
    return sites


def nearest(points: DataFrame, targets: DataFrame, k: int = 1, lat: str = "latitude", lon: str = "longitude",
            target_id: str = "facility_id", target_lat: str = "latitude", target_lon: str = "longitude", within_m: float | None = None) -> DataFrame:
    """Distinct coordinates of `points` with their k nearest targets: columns (lat, lon, target_id,
    distance_m, rank), rank from 1, ties broken by target id. With `within_m`, targets at that distance or farther are not looked
    for, so that a point far from everything meets nothing."""
    coords = points.select(lat, lon).where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).distinct()
    sites = targets.select(
        F.col(target_id).alias("__id"), F.col(target_lat).alias("__tlat"), F.col(target_lon).alias("__tlon")
    ).where(F.col("__tlat").isNotNull() & F.col("__tlon").isNotNull())
    sites = first_of_place(sites, k)

    # targets per 3 x 3 block and zoom
    z = F.col("__z")
    home = sites.select(_zooms().alias("__z"), "__tlat", "__tlon").select(
        "__z", _wrap(_cell(F.col("__tlon"), 180.0, z), z).alias("__x"), _cell(F.col("__tlat"), 90.0, z).alias("__y")
    )
    per_cell = home.groupBy("__z", "__x", "__y").agg(F.count(F.lit(1)).alias("__n"))
    around_x = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _wrap(F.col("__x") + d, z)))
    blocks = (
        per_cell.select("__z", F.explode(around_x).alias("__bx"), "__y", "__n")
        .select("__z", "__bx", F.explode(F.sequence(F.col("__y") - 1, F.col("__y") + 1)).alias("__by"), "__n")
        .groupBy("__z", F.col("__bx").alias("__x"), F.col("__by").alias("__y"))
        .agg(F.sum("__n").alias("__n"))
    )
    need = F.least(F.lit(k), sites.agg(F.count(F.lit(1)).alias("n")).scalar())

    # finest zoom with enough targets around the coordinate
    probes = coords.select(lat, lon, _zooms().alias("__z")).select(
        lat, lon, "__z", _wrap(_cell(F.col(lon), 180.0, z), z).alias("__x"), _cell(F.col(lat), 90.0, z).alias("__y")
    )
    level = (
        probes.join(blocks, ["__z", "__x", "__y"])
        .withColumn("__need", need)
        .where(F.col("__n") >= F.col("__need"))
        .groupBy(lat, lon)
        .agg(F.max("__z").alias("__level"))
    )
    placed = coords.join(level, [lat, lon], "left").withColumn("__level", F.coalesce("__level", F.lit(min(ZOOMS))))

    limit = None if within_m is None else 1.001 * within_m / METRES_PER_DEGREE
    if limit is not None:
        # cells no larger than the distance asks for: with a side of the limit or more, three of them cover it
        fits = [z for z in ZOOMS if 360.0 / 2 ** (z - 1) >= limit]
        placed = placed.withColumn("__level", F.greatest("__level", F.lit(max(fits, default=min(ZOOMS)))))

    # every cell within the bound, one zoom coarser
    side = 360.0 / F.pow(F.lit(2.0), F.col("__level"))
    # diagonal of two cells with a margin; for huge cells the sum of both legs
    reach = F.when(side > 0.5, 4.0 * side).otherwise(2.9 * side)
    if limit is not None:
        reach = F.lit(limit)
    coarse = F.col("__level") - 1
    polar = F.abs(F.col(lat)) + F.col("__reach") >= 89.9
    lon_reach = F.when(polar, F.lit(180.0)).otherwise(
        F.degrees(F.asin(F.least(F.sin(F.radians("__reach")) / F.cos(F.radians(lat)), F.lit(1.0))))
    )
    reached = placed.withColumn("__reach", reach).withColumn("__z", coarse).withColumn("__lonreach", lon_reach)
    xs = F.array_distinct(
        F.transform(
            F.sequence(_cell(F.col(lon) - F.col("__lonreach"), 180.0, z), _cell(F.col(lon) + F.col("__lonreach"), 180.0, z)),
            lambda c: _wrap(c, z),
        )
    )
    ys = F.sequence(_cell(F.col(lat) - F.col("__reach"), 90.0, z), _cell(F.col(lat) + F.col("__reach"), 90.0, z))
    searched = reached.select(lat, lon, "__z", F.explode(xs).alias("__x"), ys.alias("__ys")).select(
        lat, lon, "__z", "__x", F.explode("__ys").alias("__y")
    )
    coarse_sites = sites.select("*", F.explode(F.array(*[F.lit(q - 1) for q in ZOOMS])).alias("__z")).select(
        "__id", "__tlat", "__tlon", "__z",
        _wrap(_cell(F.col("__tlon"), 180.0, z), z).alias("__x"), _cell(F.col("__tlat"), 90.0, z).alias("__y"),
    )
    dist = haversine(F.col(lat), F.col(lon), F.col("__tlat"), F.col("__tlon"), EARTH_M)
    pairs = searched.join(coarse_sites, ["__z", "__x", "__y"]).select(lat, lon, "__id", dist.alias("distance_m"))
    if within_m is not None:
        pairs = pairs.where(F.col("distance_m") < within_m)
    if k == 1:
        best = pairs.groupBy(lat, lon).agg(F.min(F.struct("distance_m", "__id")).alias("m"))
        return best.select(lat, lon, F.col("m.__id").alias(target_id), F.col("m.distance_m").alias("distance_m"),
                           F.lit(1).cast("bigint").alias("rank"))
    order = Window.partitionBy(lat, lon).orderBy("distance_m", "__id")
    return (
        pairs.withColumn("rank", F.row_number().over(order).cast("bigint"))
        .where(F.col("rank") <= k)
        .select(lat, lon, F.col("__id").alias(target_id), "distance_m", "rank")
    )
