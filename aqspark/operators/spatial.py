"""Distance joins on a grid: equal cells first, exact distance second."""

import math
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.functions.scalars import half_degree, haversine_km


def _cells_per_circle(km: float) -> int:
    """Grid columns round the globe; a cell is about a radius wide, 0.05° at least."""
    return int(360 / max(km / 100.0, 0.05))


# points of a cell that meet their places in one part
CROWD = 20_000
# cells of a grid of which those with many points may be broadcast
MOST_CELLS = 200_000
# parts into which the hours of a cell are dealt
HOUR_PARTS = 32


def crowded_cells(cells: DataFrame, crowd: int = CROWD, keys=("_row", "_col")) -> DataFrame:
    """(_row, _col, _parts): the cells of more than ``crowd`` points, and into how many parts of that size they split."""
    counts = cells.groupBy(*keys).agg(F.count("*").alias("_n")).where(F.col("_n") > crowd)
    return counts.select(*keys, F.ceil(F.col("_n") / crowd).cast("int").alias("_parts"))


def _circle_cells(df: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Each row once for every cell that its circle touches (_row, _col), with ``_width``, the circle's widest longitude offset."""
    columns = _cells_per_circle(km)
    size = 360.0 / columns
    reach = math.degrees(km / fixed.EARTH_KM) + 1e-6
    # all round where the circle holds a pole
    ratio = F.lit(math.sin(km / fixed.EARTH_KM)) / F.cos(F.radians(F.col(lat)))
    width = F.when(F.abs(F.col(lat)) + reach < 90, F.degrees(F.asin(ratio)) + 1e-6)
    width = F.coalesce(width, F.lit(180.0))

    def cell(x):
        return F.floor(x / size)

    rows = F.sequence(cell(F.col(lat) - reach), cell(F.col(lat) + reach))
    cols = F.array_distinct(F.transform(
        F.sequence(cell(F.col(lon) - width), cell(F.col(lon) + width)),
        lambda c: F.pmod(c, F.lit(columns))))
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .withColumn("_width", width)
            .withColumn("_row", F.explode(rows))
            .withColumn("_col", F.explode(cols)))


def _own_cell(df: DataFrame, km: float, lat: str, lon: str) -> DataFrame:
    """Each row with the cell it lies in."""
    columns = _cells_per_circle(km)
    size = 360.0 / columns
    return (df.filter(F.col(lat).isNotNull() & F.col(lon).isNotNull())
            .withColumn("_row", F.floor(F.col(lat) / size))
            .withColumn("_col", F.pmod(F.floor(F.col(lon) / size), F.lit(columns))))


def _near_pairs(pairs: DataFrame, km: float, strict, lat, lon, p_lat, p_lon) -> DataFrame:
    """Those of the candidate pairs that are at most ``km`` apart, with ``distance_km``."""
    reach = math.degrees(km / fixed.EARTH_KM) + 1e-6
    # the box of the circle is cheap to test, and two thirds of the candidates miss it
    apart = F.abs(F.col(p_lon) - F.col(lon))
    in_box = ((F.abs(F.col(p_lat) - F.col(lat)) <= reach)
              & (F.least(apart, 360 - apart) <= F.col("_width")))
    pairs = pairs.filter(in_box).withColumn("distance_km", haversine_km(lat, lon, p_lat, p_lon))
    within = F.col("distance_km") < km if strict else F.col("distance_km") <= km
    return pairs.filter(within)


# points of a part that a crowd of pairs alone makes
FEWEST = 100


def _pair_parts(near: DataFrame, located: DataFrame, crowd: int, parts: int) -> DataFrame:
    """(_row, _col, _parts): the cells that have both places and points, and into how many parts their points are split.

    All cells together have about ``parts`` parts more than there are cells, each cell by its share of the candidate pairs. Places are copied
    for each part, so for that share no part has less than ``FEWEST`` points: copies stay few beside pairs. None has many more than ``crowd``.
    """
    key = ["_row", "_col"]
    cells = (located.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("_n"))
             .join(near.groupBy(key).agg(F.count(F.lit(1)).cast("double").alias("_m")), key))
    whole = F.broadcast(cells.agg(F.sum(F.col("_n") * F.col("_m")).alias("_all")))
    share = F.least(F.ceil(F.col("_n") / FEWEST), F.ceil(F.col("_n") * F.col("_m") * parts / F.col("_all")))
    return cells.crossJoin(whole).select(*key, F.greatest(share, F.ceil(F.col("_n") / crowd)).cast("int").alias("_parts"))


def _on_sphere(df: DataFrame, lat: str, lon: str, prefix: str) -> DataFrame:
    """With what the pairs need of a row that has a place: latitude, longitude, cosine of the latitude, point on the unit sphere.

    They are computed once per row, and marked as never null, so that pairs are not tested for it.
    """
    phi, theta = F.radians(F.col(lat)), F.radians(F.col(lon))
    made = {"lat": F.col(lat).cast("double"), "lon": F.col(lon).cast("double"), "cos": F.cos(phi), "x": F.cos(phi) * F.cos(theta),
            "y": F.cos(phi) * F.sin(theta), "z": F.sin(phi)}
    return df.withColumns({prefix + name: F.coalesce(value, F.lit(0.0)) for name, value in made.items()})


def _sphere_pairs(pairs: DataFrame, km: float, strict) -> DataFrame:
    """``_near_pairs`` of sides from ``_on_sphere``: most pairs are judged by their chord, only those at the edge by the distance itself."""
    reach = math.degrees(km / fixed.EARTH_KM) + 1e-6
    apart = F.abs(F.col("_plon") - F.col("_qlon"))
    in_box = ((F.abs(F.col("_plat") - F.col("_qlat")) <= reach)
              & (F.least(apart, 360 - apart) <= F.col("_width")))
    x, y, z = (F.col(f"_p{c}") - F.col(f"_q{c}") for c in "xyz")
    chord = x * x + y * y + z * z
    edge = 4 * math.sin(min(km / fixed.EARTH_KM, math.pi) / 2) ** 2
    distance = haversine_km("_qlat", "_qlon", "_plat", "_plon", cosines=("_qcos", "_pcos"))
    within = distance < km if strict else distance <= km
    # far wider than what the chord can be wrong by
    inside, outside = chord <= edge * (1 - 1e-6) - 1e-15, chord > edge * (1 + 1e-6) + 1e-15
    return pairs.filter(in_box & (inside | (~outside & within))).withColumn("distance_km", distance)


def radius_join(places: DataFrame, points: DataFrame, km: float, strict=False,
                lat="lat", lon="lon", p_lat="latitude", p_lon="longitude",
                salts: int | None = None, crowd: int = CROWD, few=False) -> DataFrame:
    """Every (place, point) pair at most ``km`` apart, with ``distance_km``.

    A point lies in one cell and a place lists each cell its circle touches once, so
    no pair comes twice. Cells are counted first: one with more than ``crowd`` points is split into parts of about
    that many, one with many pairs into more, and only the places near it are copied for each part. Both sides are dealt out by part, so that the
    tasks follow the pairs. With ``few`` places or points they stay where they are and the optimizer may broadcast the small side. A stream can't
    be counted, its cells are split into 8 parts each; ``salts`` sets another fixed number.
    """
    columns = _cells_per_circle(km)
    near = _circle_cells(places, km, lat, lon)
    located = _own_cell(points, km, p_lat, p_lon)
    counted = salts is None and not points.isStreaming
    spread = counted and not few and not places.isStreaming
    tasks = 4 * int(points.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    if counted:
        crowded = _pair_parts(near, located, crowd, 4 * tasks) if spread else crowded_cells(located, crowd)
        # no more rows than the grid has cells
        if columns * columns // 2 <= MOST_CELLS:
            crowded = F.broadcast(crowded)
        near, located = (side.join(crowded, ["_row", "_col"], "inner" if spread else "left")
                         .withColumn("_parts", F.coalesce("_parts", F.lit(1))) for side in (near, located))
    else:
        near, located = (side.withColumn("_parts", F.lit(salts or 8)) for side in (near, located))
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    located = located.withColumn("_salt", F.pmod(F.xxhash64(*points.columns), F.col("_parts")).cast("int")).drop("_parts")
    key = ["_row", "_col", "_salt"]
    if not spread:
        pairs = _near_pairs(located.join(near, key), km, strict, lat, lon, p_lat, p_lon)
        return pairs.drop(*key, "_width")
    near, located = (side.repartition(tasks, *key) for side in (near, located))
    near, located = _on_sphere(near, lat, lon, "_q"), _on_sphere(located, p_lat, p_lon, "_p")
    # a table of the points of a task: no sort of the copied places, and no side that the driver collects
    pairs = _sphere_pairs(located.hint("shuffle_hash").join(near, key), km, strict)
    return pairs.drop(*key, "_width", *(side + name for side in ("_q", "_p") for name in ("lat", "lon", "cos", "x", "y", "z")))


def nearest_join(points: DataFrame, refs: DataFrame, key="station", max_km=fixed.CITY_RADIUS_KM,
                 labels=("city", "state"), order="ord", unknown="Unknown") -> DataFrame:
    """Label each point with its nearest reference less than ``max_km`` + 1 away.

    Of equally near references the earlier one wins; points without any become
    ``unknown``. Points without coordinates keep the labels they have.
    """
    located = points.select(key, F.col("lat").alias("latitude"), F.col("lon").alias("longitude"))
    pairs = radius_join(refs.select("lat", "lon", order, *labels), located,
                        max_km + 1, strict=True, few=True)
    best = (pairs.groupBy(key)
            .agg(F.min(F.struct("distance_km", order, *labels)).alias("_best")))
    known = {c: F.coalesce(F.col(f"_best.{c}"), F.lit(unknown)) for c in labels}
    has_place = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    out = points.join(best, key, "left")
    out = out.withColumns({
        c: F.when(has_place, known[c]).otherwise(F.col(c) if c in points.columns else F.lit(None))
        for c in labels})
    return out.drop("_best")


def nearest_sensor(stations: DataFrame, locations: DataFrame, km=5.0) -> DataFrame:
    """Give stations without sensors the sensor of the nearest location within ``km``.

    ``locations`` has ``lat``, ``lon`` and ``sensor_id``; the lower id breaks ties.
    """
    bare = stations.filter(F.col("sensor_id").isNull()
                           & (F.coalesce(F.size("sensor_ids"), F.lit(0)) < 1))
    sensors = locations.select(F.col("lat").alias("latitude"), F.col("lon").alias("longitude"),
                               F.col("sensor_id").alias("_id"))
    pairs = radius_join(bare.select("station", "lat", "lon"), sensors, km, salts=1)
    found = (pairs.groupBy("station")
             .agg(F.min(F.struct("distance_km", "_id")).alias("_f"))
             .select("station", F.col("_f._id").alias("_found")))
    return (stations.join(found, "station", "left")
            .withColumn("sensor_id", F.coalesce("sensor_id", "_found"))
            .drop("_found"))


def assign_cell(df: DataFrame, lat="lat", lon="lon") -> DataFrame:
    """Half-degree weather cell of each row."""
    return df.withColumns({"cell_lat": half_degree(lat), "cell_lon": half_degree(lon)})


def shared_sites(stations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(_site, lat, lon, _times) and (_site, station): stations of the same place, or list of places, share a site.

    What is within reach is then found once per site. A row that comes ``_times`` times counts as often.
    """
    placed = stations.filter(F.col("lat").isNotNull() & F.col("lon").isNotNull())
    lists = (placed.groupBy("station", "lat", "lon").agg(F.count(F.lit(1)).alias("_times"))
             .groupBy("station").agg(F.sort_array(F.collect_list(F.struct("lat", "lon", "_times"))).alias("_places"))
             .withColumn("_site", F.col("_places").cast("string")))
    sites = lists.select("_site", "_places").distinct().select("_site", F.inline("_places"))
    return sites, lists.select("_site", "station")


def site_hours(sites: DataFrame, spots: DataFrame, km: float, hour="timestamp", crowd: int = CROWD) -> DataFrame:
    """Every pair of a site and a spot (latitude, longitude, ``hour``) at most ``km`` apart.

    A site lies in one cell and a spot lists the cells that its circle touches; the hours of a cell are dealt into ``HOUR_PARTS``
    parts. So all pairs of a site and hour meet in one task, and sums by site and hour leave it as one row. Only where a part has
    more than ``crowd`` spots is it split further, by their counts; a stream can't be counted, its parts are split into 8.
    """
    key = ["_row", "_col", "_part"]
    near = _own_cell(sites, km, "lat", "lon").withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HOUR_PARTS - 1))))
    cells = _circle_cells(spots, km, "latitude", "longitude").withColumn(
        "_part", F.pmod(F.xxhash64(hour), F.lit(HOUR_PARTS)).cast("int"))
    if spots.isStreaming:
        near, cells = (side.withColumn("_parts", F.lit(8)) for side in (near, cells))
    else:
        # at most one row for each ``crowd`` spots
        crowded = F.broadcast(crowded_cells(cells, crowd, key))
        near, cells = (side.join(crowded, key, "left").withColumn("_parts", F.coalesce("_parts", F.lit(1))) for side in (near, cells))
    near = near.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    cells = cells.withColumn("_salt", F.pmod(F.xxhash64("latitude", "longitude"), F.col("_parts")).cast("int")).drop("_parts")
    # few bytes make many pairs, so the number of tasks must not follow the bytes
    tasks = int(spots.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    near, cells = (side.repartition(tasks, *key, "_salt") for side in (near, cells))
    pairs = _near_pairs(cells.join(_unsent(near, spots), [*key, "_salt"]), km, False, "latitude", "longitude", "lat", "lon")
    return pairs.drop(*key, "_salt", "_width", "distance_km")


def _unsent(side: DataFrame, stream: DataFrame) -> DataFrame:
    """``side``, to be joined with ``stream`` in place: if that is a stream, neither is collected by the driver for a broadcast.

    A batch without new rows is planned as empty, but all hours that it closes leave the state; and no estimate knows of the copies that
    an ``explode`` makes. Streams have no adaptive execution to correct either.
    """
    return side.hint("merge") if stream.isStreaming else side


def station_hours(sums: DataFrame, members: DataFrame, hour="timestamp") -> DataFrame:
    """Rows by site and hour as rows of all its stations. The hours are dealt into parts, so that no task holds all of a large site."""
    parts = 8
    sums = sums.withColumn("_part", F.pmod(F.xxhash64(hour), F.lit(parts)).cast("int"))
    members = members.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    return sums.join(_unsent(members, sums), ["_site", "_part"]).drop("_site", "_part")


BANDS = ["bright_ti4", "bright_ti5"]


def spot_sums(bands=BANDS) -> list[Column]:
    """Aggregates of the detections of one spot and hour."""
    return [F.count("frp").alias("_n"), F.sum("frp").alias("_sum"), F.max("frp").alias("_max"),
            *[F.sum(b).alias(f"_{b}") for b in bands],
            *[F.count(b).alias(f"_{b}_n") for b in bands]]


def fire_measures(bands=BANDS) -> list[Column]:
    """Aggregates of the spots near a site: its fire measures."""
    def total(c):
        return F.sum(F.col(c) * F.col("_times"))

    def band_mean(b):
        if b not in bands:
            return F.lit(0.0).alias(f"{b}_mean")
        return F.try_divide(total(f"_{b}"), total(f"_{b}_n")).alias(f"{b}_mean")

    return [total("_n").alias("fire_count"), total("_sum").alias("frp_sum"),
            (total("_sum") / total("_n")).alias("frp_mean"), F.max("_max").alias("frp_max"),
            *[band_mean(b) for b in BANDS]]


class SiteFires(NamedTuple):
    """Fire measures by site and hour (_site, timestamp), and the site of each station (_site, station)."""
    sums: DataFrame
    members: DataFrame


def fire_hourly(stations: DataFrame, fires: DataFrame, km=fixed.FIRE_RADIUS_KM, shared=False,
                hours: DataFrame | None = None) -> DataFrame | SiteFires:
    """Fire measures per station and hour over detections within ``km``.

    Detections of one place and hour are summed up before they meet the stations, and stations of one place meet them once.
    With ``shared`` they stay by site, for ``join_fires``: stations times hours are many more rows than readings may be.
    Of ``hours`` (timestamp), if given, the detections of other hours are left out.
    """
    bands = [b for b in BANDS if b in fires.columns]
    known = fires.filter(F.col("frp").isNotNull()).withColumn("timestamp", F.date_trunc("hour", "timestamp"))
    if hours is not None:
        # bounded by the calendar
        known = known.join(F.broadcast(hours.select("timestamp").distinct()), "timestamp", "left_semi")
    spots = known.groupBy("timestamp", "latitude", "longitude").agg(*spot_sums(bands))
    sites, members = shared_sites(stations)
    sums = site_hours(sites, spots, km).groupBy("_site", "timestamp").agg(*fire_measures(bands))
    if shared:
        return SiteFires(sums.select("_site", "timestamp", *fixed.FIRE_MEASURES), members)
    return station_hours(sums, members).select("station", "timestamp", *fixed.FIRE_MEASURES)
