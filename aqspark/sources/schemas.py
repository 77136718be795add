"""Schemas of everything that is read. Nothing is inferred."""

from aqspark.functions import fixed

LOCATIONS = """
    results array<struct<
        id: bigint, name: string, locality: string, city: string,
        coordinates: struct<latitude: double, longitude: double>,
        providers: array<struct<name: string>>,
        sensors: array<struct<id: bigint, parameter: struct<name: string>>>>>
"""

MEASUREMENTS = """
    sensor_id bigint,
    location_id bigint,
    parameter struct<name: string>,
    results array<struct<
        value: double,
        period: struct<datetimeFrom: struct<utc: string>, dateFrom: struct<utc: string>>>>
"""

WEATHER = ("cell_lat double, cell_lon double, hourly struct<time: array<string>, "
           + ", ".join(f"{c}: array<double>" for c in fixed.WEATHER) + ">")

FIRES = ("latitude double, longitude double, bright_ti4 double, bright_ti5 double, "
         "frp double, acq_date string, acq_time string")

ARTICLES = "articles array<struct<title: string, description: string, publishedAt: string>>"

REGISTRY = """
    station string, location_id bigint, sensor_id bigint, sensor_ids array<bigint>,
    lat double, lon double, city string, state string, name string, owner string,
    data_start string, data_end string
"""

READINGS = "sensor_id bigint, station string, ts timestamp, pm25 double"

FIRE_EVENTS = ("timestamp timestamp, latitude double, longitude double, frp double, "
               "bright_ti4 double, bright_ti5 double")

ARTICLE_ROWS = "timestamp timestamp, text string"

PARAMS = "feature string, center double, scale double"
