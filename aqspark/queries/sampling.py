"""Sorts, limits and samples K1–K8."""

from pyspark.sql import functions as F

from aqspark.operators import ranks
from aqspark.queries.aggregates import SITES, sites
from aqspark.queries.base import query
from aqspark.sources import writers
from aqspark.storage import new_path


@query("k01_sort_for_storage", "station:s timestamp:t pm25:f", views="hourly",
       sql="SELECT * FROM hourly")
def storage_order(t):
    """Written in station order and read back."""
    path = new_path(t.spark, "hourly")
    writers.write_dataset(t.hourly(), path)
    return ranks.sort_for_storage(t.spark.read.parquet(path))


@query("k02_top_cities", "city:s n:i", sql="""
SELECT n_name AS city, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey
GROUP BY 1 ORDER BY n DESC, city LIMIT 7""")
def top_cities(t):
    customers = t.table("customer").join(
        t.table("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return ranks.top_counts(customers.withColumnRenamed("n_name", "city"), "city", 7)


@query("k03_newest_sensors", "sensor_id:i station:s", sql=f"""
SELECT sensor_id, min(station) AS station FROM (SELECT station, unnest(ids) AS sensor_id
FROM {SITES}) GROUP BY 1 ORDER BY 1 DESC LIMIT 60""")
def newest(t):
    return ranks.newest_sensors(sites(t))


@query("k04_first_stations", "station:s city:s", views="places", sql="""
SELECT station, city FROM places ORDER BY station LIMIT 5""")
def first(t):
    return ranks.first_stations(t.places())


def drawn_sql(seed):
    """The digest that orders random draws of hour rows."""
    return f"md5(station || '|' || strftime(timestamp, '%Y-%m-%d %H:%M:%S') || '|{seed}')"


@query("k05_cap_per_station", "station:s timestamp:t pm25:f", views="hourly", sql=f"""
SELECT station, timestamp, pm25 FROM (SELECT *, row_number() OVER (PARTITION BY station
  ORDER BY {drawn_sql(42)}, timestamp) AS rn FROM hourly)
WHERE rn <= greatest(1, 4000 // (SELECT count(DISTINCT station) FROM hourly))""")
def capped(t):
    hourly = t.hourly()
    return ranks.cap_per_key(hourly, ranks.cap_for_total(hourly, 4000))


@query("k06_epoch_sample", "station:s timestamp:t pm25:f", views="hourly", sql=f"""
SELECT * FROM hourly ORDER BY {drawn_sql(3 * 1337 + 42)}, station, timestamp LIMIT 500""")
def epoch(t):
    return ranks.epoch_sample(t.hourly(), 500, epoch=3)


@query("k07_scaler_sample", "station:s timestamp:t pm25:f", views="hourly", sql=f"""
SELECT * FROM hourly ORDER BY {drawn_sql(42)}, station, timestamp LIMIT 5000""")
def sample(t):
    return ranks.scaler_sample(t.hourly(), 5000)


@query("k07_scaler_first_rows", "station:s timestamp:t pm25:f", views="hourly",
       sql="SELECT * FROM hourly ORDER BY timestamp, station LIMIT 1000")
def first_rows(t):
    return ranks.scaler_sample(t.hourly(), 1000, how="first")


@query("k08_shuffle_rows", "station:s timestamp:t pm25:f", views="hourly",
       sql="SELECT * FROM hourly")
def shuffled(t):
    return ranks.shuffle_rows(t.hourly())
