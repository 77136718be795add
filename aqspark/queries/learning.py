"""Learning sets, scoring and forecast documents: M1, M2, M6, F25, S14."""

import numpy as np
from pyspark.sql import functions as F

from aqspark.functions import fixed
from aqspark.operators import metrics, ranks, scaling, spatial
from aqspark.operators.clean import ensure_columns
from aqspark.operators.blocks import block_examples
from aqspark.operators.windows import add_targets
from aqspark.plans import features, forecast, learning, linear
from aqspark.queries.base import query
from aqspark.queries.joining import cell_weather, features_sql
from aqspark.queries.scalars import bands_sql
from aqspark.sources import writers
from aqspark.storage import new_path

W = "WINDOW w AS (PARTITION BY station ORDER BY timestamp)"


def rows_with_features(t):
    """Hour rows with every feature column, most of them constant."""
    df = t.hourly().withColumns({
        "is_monsoon": (F.hour("timestamp") % 2).cast("double"),
        "news_calamity": F.hour("timestamp") / 100.0})
    return ensure_columns(df, dict.fromkeys(fixed.FEATURES, 0.0))


# Every station with 72 rows: newest reading, repeated for all hours ahead
SCORED = f"""(SELECT station, pm25, timestamp AS ts, round_even(CAST(pm25 AS DECIMAL(18,6)), 1) AS near
FROM (SELECT *, row_number() OVER (PARTITION BY station ORDER BY timestamp DESC) AS rn,
  count(*) OVER (PARTITION BY station) AS n FROM hourly) WHERE rn = 1 AND n >= 72)"""


def persistence_documents(t):
    params = {"pm25": (0.0, 64.0)}
    load = forecast.persistence(fixed.FEATURES.index("pm25"))
    return forecast.score(rows_with_features(t), load, params, (0.0, 64.0),
                          ids=ranks.station_ids(t.hourly()))


SHOWN = "round(CAST(CAST(pm25 AS FLOAT) AS DOUBLE), 1)"


@query("m01_score", "station:s current_pm25:f2 current_aqi:s data_ts:s step:s value:f2 aqi:s color:s change:f2 "
       "confidence:f", views="hourly", sql=f"""
SELECT station, near AS current_pm25, {bands_sql('pm25', 2, 'Severe')} AS current_aqi,
  strftime(ts, '%Y-%m-%d %H:%M:%S') || '+00:00' AS data_ts, '+' || CAST(h AS VARCHAR) || 'h' AS step,
  {SHOWN} AS value, {bands_sql(SHOWN, 2, 'Severe')} AS aqi, {bands_sql(SHOWN, 4, '[MAROON]')} AS color,
  round(near - pm25, 1) AS change,
  CASE WHEN h = 7 THEN 0.83 ELSE round_even(0.90::DOUBLE - (h - 1) / 24.0::DOUBLE * 0.30::DOUBLE, 2)
    END AS confidence FROM (SELECT *, unnest(range(1, 25)) AS h FROM {SCORED})""")
def score(t):
    """Every step of every document."""
    docs = persistence_documents(t)
    return docs.select("station", "current_pm25", "current_aqi", "data_ts", F.explode("forecast").alias("step", "f")).select(
        "*", F.col("f.pm25").alias("value"), F.col("f.aqi").alias("aqi"), F.col("f.aqi_color").alias("color"),
        F.col("f.delta").alias("change"), F.col("f.confidence").alias("confidence"))


@query("m02_score_all", "station:s forecasts:i lowest:f2 highest:f2", views="hourly", sql=f"""
SELECT station, 24 AS forecasts, CAST(pm25 AS FLOAT) AS lowest, CAST(pm25 AS FLOAT) AS highest
FROM {SCORED}""")
def score_all(t):
    values = forecast.forecast_values(
        rows_with_features(t), forecast.persistence(fixed.FEATURES.index("pm25")),
        {"pm25": (0.0, 64.0)}, (0.0, 64.0))
    return values.select("station", F.size("forecast").alias("forecasts"),
                         F.array_min("forecast").alias("lowest"),
                         F.array_max("forecast").alias("highest"))


@query("f25_forecast_document", "station:s step:s arrow:s confidence:f", views="hourly", sql=f"""
SELECT station, '+' || CAST(h AS VARCHAR) || 'h' AS step,
  CASE WHEN d > 0 THEN '↑' WHEN d < 0 THEN '↓' ELSE '→' END AS arrow,
  CASE WHEN h = 7 THEN 0.83 ELSE round_even(0.90::DOUBLE - (h - 1) / 24.0::DOUBLE * 0.30::DOUBLE, 2)
    END AS confidence
FROM (SELECT station, unnest(range(1, 25)) AS h, round(near - pm25, 1) AS d FROM {SCORED})""")
def document(t):
    return forecast.forecast_rows(persistence_documents(t))


@query("f25_document_signals", "station:s signal:s strength:f", views="hourly", sql=f"""
SELECT station, 'is_monsoon' AS signal, 1 AS strength FROM {SCORED} WHERE hour(ts) % 2 = 1
UNION ALL SELECT station, 'news_calamity', hour(ts) / 100.0 FROM {SCORED} WHERE hour(ts) > 10""")
def document_signals(t):
    docs = persistence_documents(t)
    return docs.select("station", F.explode("signals").alias("signal", "strength"))


@query("s14_write_forecast", "station:s now:f2 later:f2", views="hourly", sql=f"""
SELECT station, round(pm25, 1) AS now, round(CAST(CAST(pm25 AS FLOAT) AS DOUBLE), 1) AS later
FROM {SCORED}""")
def write_forecast(t):
    path = new_path(t.spark, "forecast")
    writers.write_forecast(persistence_documents(t), path)
    schema = "station string, current_pm25 double, forecast map<string, struct<pm25: double>>"
    return t.spark.read.schema(schema).json(path).select(
        "station", F.col("current_pm25").alias("now"),
        F.col("forecast")["+5h"]["pm25"].alias("later"))


def feature_rows(t):
    """All 59 features and 24 targets of the hours whose last target is known."""
    hours = spatial.fire_hourly(t.stations(), t.fires(), shared=True)
    rows = features.build_features(t.hourly(), t.stations(), cell_weather(t), hours)
    return rows.dropna(subset=fixed.TARGETS)


def learning_set(t):
    return learning.prepare(feature_rows(t))


SPLIT = f"""SELECT *, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN i < floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY timestamp, station) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT *, {", ".join(f"0 AS {c}" for c in fixed.NEWS_SIGNALS)} FROM ({features_sql()}))
    WHERE target_24h IS NOT NULL)"""


def filled_sql(c):
    """Last known value of a station's split, else the next, else 0."""
    order = "OVER (PARTITION BY station, split ORDER BY timestamp ROWS BETWEEN "
    return (f"coalesce(last_value({c} IGNORE NULLS) {order} UNBOUNDED PRECEDING AND CURRENT ROW), "
            f"first_value({c} IGNORE NULLS) {order} CURRENT ROW AND UNBOUNDED FOLLOWING), 0)")


@query("m06_learning_set", "station:s timestamp:t split:s station_id:i "
       + " ".join(f"{c}:f6" for c in fixed.FEATURES), views="hourly weather fires stations", sql=f"""
WITH parts AS MATERIALIZED ({SPLIT}),
scales AS MATERIALIZED (SELECT {", ".join(
    f"coalesce(quantile_cont({c}::DOUBLE, 0.5), 0) AS m_{c}, coalesce(nullif(quantile_cont({c}::DOUBLE, 0.75)"
    f" - quantile_cont({c}::DOUBLE, 0.25), 0), 1) AS w_{c}" for c in fixed.FEATURES)}
  FROM parts WHERE split = 'train')
SELECT station, timestamp, split, station_id, {", ".join(
    f"({filled_sql(c)} - m_{c}) / w_{c} AS {c}" for c in fixed.FEATURES)}
FROM parts JOIN (SELECT station, row_number() OVER (ORDER BY station) AS station_id
  FROM (SELECT DISTINCT station FROM parts)) USING (station), scales""")
def prepared(t):
    return learning_set(t).rows


SCALES = f"""scales AS MATERIALIZED (SELECT {", ".join(
    f"coalesce(quantile_cont({c}::DOUBLE, 0.5), 0) AS m_{c}, coalesce(nullif(quantile_cont({c}::DOUBLE, 0.75)"
    f" - quantile_cont({c}::DOUBLE, 0.25), 0), 1) AS w_{c}" for c in fixed.FEATURES)}
  FROM parts WHERE split = 'train')"""


@query("m06_learning_sequences", "station:s split:s timestamp:t row:i x_sum:f4 y_sum:f4", views="hourly weather fires stations", sql=f"""
WITH parts AS MATERIALIZED ({SPLIT}), {SCALES},
digests AS MATERIALIZED (SELECT station, split, timestamp,
    {" + ".join(f"{j + 1} / 59.0::DOUBLE * (({filled_sql(c)} - m_{c}) / w_{c})" for j, c in enumerate(fixed.FEATURES))} AS d,
    {" + ".join(f"{h} * target_{h}h" for h in range(1, 25))} AS y_sum FROM parts, scales)
SELECT station, split, timestamp, row, list_sum(list_transform(x, lambda v, k: v * k / 72.0::DOUBLE)) AS x_sum, y_sum
FROM (SELECT *, row_number() OVER w - 1 AS row, list(d) OVER (w ROWS BETWEEN 72 PRECEDING AND 1 PRECEDING) AS x,
    count(*) OVER (PARTITION BY station, split) AS n FROM digests WINDOW w AS (PARTITION BY station, split ORDER BY timestamp))
WHERE row >= 72 AND row <= n - 24""")
def learning_sequences(t):
    """Every example, each with sums in which every value has a weight of its own by its place."""
    found = learning_set(t)
    path = new_path(t.spark, "blocks")
    learning.learning_blocks(found.rows, kind="double").write.parquet(path)
    blocks = t.spark.read.parquet(path).withColumn("station", F.struct("station", "split"))
    center, scale = scaling.params_on_driver(found.scaler)["target"]

    def digests(x, y):
        features, rows, heads = (np.arange(1, n + 1) for n in (x.shape[2], x.shape[1], y.shape[1]))
        return {"x_sum": np.einsum("erf,f->er", x, features / 59.0) @ (rows / 72.0), "y_sum": (y * scale + center) @ heads}

    return block_examples(blocks, each=(digests, "x_sum double, y_sum double")).select(
        "station.station", "station.split", "timestamp", "row", "x_sum", "y_sum")


def on_test(t, found, features_, keep=(), **options):
    """Test rows with the forecasts of models fitted on the training rows, in reading units; columns to ``keep`` as they are."""
    center, scale = scaling.params_on_driver(found.scaler)["target"]
    models = linear.fit_linear(found.rows.filter("split = 'train'"), features=features_, stored=True, **options)
    pairs = linear.predict_linear(models, found.rows.filter("split = 'test'"), features_, keep)
    return scaling.robust_unscale(pairs, dict.fromkeys(["y_true", "y_pred"], (center, scale)))


HOUR_SPLIT = f"""(SELECT *, CASE WHEN i < floor(n * 0.70::DOUBLE) THEN 'train'
  WHEN i < floor(n * (0.70::DOUBLE + 0.15::DOUBLE)) THEN 'val' ELSE 'test' END AS split
  FROM (SELECT *, row_number() OVER (ORDER BY timestamp, station) - 1 AS i, count(*) OVER () AS n
    FROM (SELECT *, {", ".join(f"lead(pm25, {h}) OVER w AS target_{h}h" for h in range(1, 25))} FROM hourly {W})
    WHERE target_24h IS NOT NULL))"""


def straight_line_sql(h):
    """Errors of the least-squares line from the reading to the one h rows later."""
    return f"""SELECT {h} AS horizon, count(*) AS n, avg(abs(y - p)) AS mae, sqrt(avg((y - p) * (y - p))) AS rmse,
  1 - avg((y - p) * (y - p)) / var_pop(y) AS r2
FROM (SELECT target_{h}h AS y, slope * pm25 + start AS p FROM parts, (SELECT regr_slope(target_{h}h, pm25) AS slope,
  regr_intercept(target_{h}h, pm25) AS start FROM parts WHERE split = 'train') WHERE split = 'test')"""


@query("m06_linear_forecast", "horizon:i n:i mae:f4 rmse:f4 r2:f4", views="hourly",
       sql=f"WITH parts AS MATERIALIZED {HOUR_SPLIT} " + " UNION ALL ".join(
           straight_line_sql(h) for h in range(1, fixed.HORIZONS + 1)))
def least_squares(t):
    """Least squares on the reading alone, which SQL can fit too."""
    dataset = add_targets(t.hourly()).dropna(subset=fixed.TARGETS)
    found = learning.prepare(dataset, ["pm25"])
    return metrics.horizon_metrics(on_test(t, found, ["pm25"], loss="squaredError", ridge=0.0))


# Huber's loss with its own scale, by reweighting: every round sums over the training rows by horizon
ROBUST_LINES = f"""train AS MATERIALIZED (SELECT pm25::DOUBLE AS x, unnest([{", ".join(f"target_{h}h" for h in range(1, 25))}])::DOUBLE AS y,
    unnest(range(1, 25)) AS horizon FROM parts WHERE split = 'train'),
rounds AS (
  SELECT 0 AS round, horizon, start, slope, sqrt(mse) AS scale FROM (
    SELECT horizon, any_value(start) AS start, any_value(slope) AS slope, avg((y - start - slope * x) ** 2) AS mse
    FROM train JOIN (SELECT horizon, regr_slope(y, x) AS slope, regr_intercept(y, x) AS start FROM train GROUP BY horizon) USING (horizon)
    GROUP BY horizon)
  UNION ALL
  SELECT round + 1, horizon, (sy - slope * sx) / sw, slope, scale FROM (
    SELECT round, horizon, sum(w) AS sw, sum(w * x) AS sx, sum(w * y) AS sy,
      (sum(w) * sum(w * x * y) - sum(w * x) * sum(w * y)) / (sum(w) * sum(w * x * x) - sum(w * x) ** 2) AS slope,
      sqrt(sum(CASE WHEN r <= 1.35 * scale THEN r * r ELSE 0 END) / (count(*) - 1.35 ** 2 * count(*) FILTER (r > 1.35 * scale))) AS scale
    FROM (SELECT *, CASE WHEN r <= 1.35 * scale THEN 1 ELSE 1.35 * scale / r END AS w
          FROM (SELECT *, abs(y - start - slope * x) AS r FROM rounds JOIN train USING (horizon) WHERE round < 30))
    GROUP BY round, horizon)),
lines AS MATERIALIZED (SELECT horizon, start, slope FROM rounds WHERE round = 30)"""


@query("m06_robust_line", "station:s timestamp:t horizon:i y_true:f y_pred:f3", views="hourly", sql=f"""
WITH RECURSIVE parts AS MATERIALIZED {HOUR_SPLIT}, {ROBUST_LINES}
SELECT station, timestamp, horizon, y AS y_true, start + slope * pm25 AS y_pred
FROM (SELECT station, timestamp, pm25, unnest(range(1, 25)) AS horizon, unnest([{", ".join(f"target_{h}h" for h in range(1, 25))}]) AS y
  FROM parts WHERE split = 'test') JOIN lines USING (horizon)""")
def robust_line(t):
    """Every forecast of the robust fit on the reading alone, which SQL can repeat round by round."""
    dataset = add_targets(t.hourly()).dropna(subset=fixed.TARGETS)
    found = learning.prepare(dataset, ["pm25"])
    return on_test(t, found, ["pm25"], ridge=0.0, max_iter=30, tolerance=0.0)


@query("m06_kept_models", "station:s horizon:i y_pred:f4", views="hourly", sql=f"""
WITH parts AS MATERIALIZED {HOUR_SPLIT}, newest AS (SELECT * FROM (SELECT station, pm25, row_number() OVER (PARTITION BY station
    ORDER BY timestamp DESC) AS rn, count(*) OVER (PARTITION BY station) AS n FROM parts) WHERE rn = 1 AND n >= 72)
{" UNION ALL ".join(f"""SELECT station, {h} AS horizon, least(greatest(slope * pm25 + start, 0), 1500) AS y_pred FROM newest,
  (SELECT regr_slope(target_{h}h, pm25) AS slope, regr_intercept(target_{h}h, pm25) AS start FROM parts WHERE split = 'train')""" for h in range(1, 25))}""")
def kept_models(t):
    """Fitted, written, read again and used as the predictor of the newest rows."""
    found = learning.prepare(add_targets(t.hourly()).dropna(subset=fixed.TARGETS), ["pm25"])
    path = new_path(t.spark, "models")
    linear.write_linear(t.spark, linear.fit_linear(found.rows.filter("split = 'train'"), features=["pm25"], loss="squaredError", ridge=0.0),
                        path, ["pm25"])
    params = scaling.params_on_driver(found.scaler)
    raw = scaling.robust_unscale(found.rows.select("station", "timestamp", "pm25"), {"pm25": params["pm25"]})
    values = forecast.forecast_values(raw, linear.linear_predictor(linear.read_linear(t.spark, path, ["pm25"])),
                                      {"pm25": params["pm25"]}, params["target"], ["pm25"])
    return values.select("station", F.posexplode("forecast").alias("at", "y_pred")).withColumn("horizon", F.col("at") + 1)


@query("m06_robust_forecast", "horizon:i n:i better:i", views="hourly weather fires stations", sql=f"""
SELECT unnest(range(1, 25)) AS horizon, n, 1 AS better FROM (SELECT count(*) AS n FROM ({SPLIT}) WHERE split = 'test')""")
def robust(t):
    """The robust models on all features, against repeating the reading: what SQL can tell is
    over how many rows, and that the models err less."""
    found = learning_set(t)
    # the reading goes with its forecasts, so the long pairs are counted up where they are made
    pairs = on_test(t, found, fixed.FEATURES, keep=["pm25"])
    center, scale = scaling.params_on_driver(found.scaler)["pm25"]
    errors = pairs.withColumn("now", F.col("pm25") * scale + center).groupBy("horizon").agg(
        F.count(F.lit(1)).alias("n"), F.avg(F.abs(F.col("y_true") - F.col("y_pred"))).alias("mae"),
        F.avg(F.abs(F.col("y_true") - F.col("now"))).alias("naive"))
    return errors.withColumn("better", (F.col("mae") < F.col("naive")).cast("int"))
