"""The three batch jobs in a row, from landed files to forecast documents."""

import gzip
import json
import math
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from aqspark.jobs import (
    build_dataset, build_history, build_news, build_registry, evaluate, prepare_learning, score_dataset, score_live, stream_live)
from aqspark.operators.blocks import block_examples
from aqspark.plans.linear import read_linear
from aqspark.sources import schemas
from aqspark.streaming.changes import latest_rows

START = datetime(2024, 1, 1)


def test_jobs_end_to_end(spark, tmp_path):
    def page(sensor, n):
        results = [{"value": 60 + 40 * math.sin(h / 6) + h % 5, "period": {"datetimeFrom": {
            "utc": (START + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")}}}
            for h in range(n)]
        return json.dumps({"sensor_id": sensor, "results": results})
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text(page(1, 400) + "\n" + page(2, 100))
    (tmp_path / "reg.json").write_text("\n".join(json.dumps(s) for s in (
        {"station": "delhi_a", "sensor_id": 1, "sensor_ids": [1], "lat": 28.6, "lon": 77.2,
         "city": "Delhi"},
        {"station": "short", "sensor_id": 2, "sensor_ids": [2], "lat": 20.0, "lon": 77.0,
         "city": "Unknown"})))
    (tmp_path / "f.csv").write_text(
        "latitude,longitude,bright_ti4,bright_ti5,frp,acq_date,acq_time\n"
        "28.7,77.3,300,290,5.5,2024-01-05,630\n")

    out = str(tmp_path / "dataset")
    build_dataset.run(spark, build_dataset.arguments([
        "--measurements", str(tmp_path / "m"), "--registry", str(tmp_path / "clean.json"),
        str(tmp_path / "reg.json"), "--fires", str(tmp_path / "f.csv"), "--out", out,
        "--start", "2024-01-01"]))
    rows = spark.read.parquet(f"{out}/rows")
    assert rows.select("station").distinct().collect() == [("delhi_a",)]
    assert rows.count() == 400 - 48
    assert rows.filter("fire_count = 1").count() == 1
    assert spark.read.json(f"{out}/meta").first().n_stations == 1

    learn = str(tmp_path / "learn")
    prepare_learning.run(spark, prepare_learning.arguments([
        "--dataset", f"{out}/rows", "--out", learn, "--blocks", "--sequences", "--max-rows", "50"]))
    assert block_examples(spark.read.parquet(f"{learn}/blocks").filter("split = 'train'")).count() == int((400 - 48) * 0.7) - 95
    examples = spark.read.parquet(f"{learn}/sequences/train")
    assert examples.count() == 50
    first = examples.first()
    assert len(first.x) == 72 and len(first.x[0]) == 59 and len(first.y) == 24

    documents = str(tmp_path / "documents")
    score_dataset.run(spark, score_dataset.arguments([
        "--dataset", f"{out}/rows", "--params", f"{learn}/params", "--out", documents,
        "--station", "DELHI"]))
    got = spark.read.json(documents).first()
    assert got.station == "delhi_a"
    assert abs(got.forecast["+1h"].pm25 - got.current_pm25) < 0.11

    # the same forecast straight from the readings
    live = str(tmp_path / "live")
    score_live.run(spark, score_live.arguments([
        "--measurements", str(tmp_path / "m"), "--registry", str(tmp_path / "reg.json"),
        "--params", f"{learn}/params", "--out", live]))
    fresh = {d.station: d for d in spark.read.json(live).collect()}
    assert fresh["delhi_a"].current_pm25 == pytest.approx(60 + 40 * math.sin(399 / 6) + 399 % 5, abs=0.06)

    errors = str(tmp_path / "errors")
    evaluate.run(spark, evaluate.arguments([
        "--learning", learn, "--out", errors, "--horizons", "2", "--max-iter", "10"]))
    linear = {r.horizon: r.mae for r in spark.read.json(f"{errors}/linear").collect()}
    naive = {r.horizon: r.mae for r in spark.read.json(f"{errors}/persistence").collect()}
    assert set(linear) == set(naive) == {"t+1h", "t+2h"} and linear["t+2h"] < naive["t+2h"]

    # the models are kept, and score both the table and a stream of landed readings
    models = ["--models", f"{errors}/models", "--params", f"{learn}/params"]
    score_dataset.run(spark, score_dataset.arguments(["--dataset", f"{out}/rows", "--out", documents, *models]))
    kept = spark.read.json(documents).first()
    fitted = read_linear(spark, f"{errors}/models")
    assert sorted(fitted) == [1, 2] and kept.forecast["+1h"].pm25 != kept.forecast["+2h"].pm25 == kept.forecast["+9h"].pm25
    landing = str(tmp_path / "landing")
    spark.createDataFrame([(1, "delhi_a", START + timedelta(hours=h), 60 + 40 * math.sin(h / 6) + h % 5) for h in range(400)],
                          schemas.READINGS).write.parquet(landing)
    streamed = str(tmp_path / "streamed")
    stream_live.run(spark, stream_live.arguments([
        "--landing", landing, "--registry", str(tmp_path / "reg.json"), "--out", streamed, "--checkpoint", str(tmp_path / "state"),
        "--compact", *models])).awaitTermination()
    latest = latest_rows(spark, streamed, stream_live.DOCUMENTS, "json").first()
    assert latest.station == "delhi_a" and latest.current_pm25 == fresh["delhi_a"].current_pm25
    assert latest.forecast["+1h"].pm25 != latest.forecast["+2h"].pm25


def test_registry_history_and_bounded_dataset(spark, tmp_path):
    def lines(name, *documents):
        (tmp_path / name).mkdir()
        (tmp_path / name / "a.json").write_text("\n".join(json.dumps(d) for d in documents))
        return str(tmp_path / name)

    def readings(n, **ids):
        return {**ids, "results": [{"value": 50.0 + h % 7, "period": {"datetimeFrom": {
            "utc": (START + timedelta(hours=h)).strftime("%Y-%m-%dT%H:%M:%SZ")}}} for h in range(n)]}

    def place(i, sensor, lat):
        return {"id": i, "name": "x" * 60, "coordinates": {"latitude": lat, "longitude": 77.2},
                "sensors": [{"id": sensor, "parameter": {"name": "pm25"}}]}

    measured = lines("m", readings(400, sensor_id=3_000_000), readings(400, sensor_id=3_000_001))
    reg = str(tmp_path / "reg")
    build_registry.run(spark, build_registry.arguments([
        "--locations", lines("l", {"results": [place(1, 3_000_000, 28.6), place(2, 3_000_001, 28.7), place(3, 5, 28.6)]}),
        "--measurements", measured, "--out", reg]))
    stations = spark.read.json(f"{reg}/registry").collect()
    # one long name, but two stations
    assert len({s.station for s in stations}) == 2 and {s.city for s in stations} == {"Delhi"}

    path = tmp_path / "archive" / "locationid=1" / "year=2023" / "month=12" / "a.csv.gz"
    path.parent.mkdir(parents=True)
    path.write_bytes(gzip.compress(b"utc,value\n2023-12-31T05:00:00Z,12\n"))
    out = str(tmp_path / "history")
    build_history.run(spark, build_history.arguments([
        "--archive", str(tmp_path / "archive"), "--registry", f"{reg}/registry", "--out", out]))
    assert [(r.location_id, r.pm25) for r in spark.read.parquet(out).collect()] == [(1, 12.0)]
    # hours at hand stay as they are, others are added
    path.write_bytes(gzip.compress(b"utc,value\n2023-12-31T05:00:00Z,99\n2023-12-31T06:00:00Z,14\n"))
    for _ in range(2):
        build_history.run(spark, build_history.arguments([
            "--archive", str(tmp_path / "archive"), "--registry", f"{reg}/registry", "--out", out, "--append"]))
    assert sorted(r.pm25 for r in spark.read.parquet(out).collect()) == [12.0, 14.0]

    articles = lines("n", {"articles": [{"title": "Dust storm over Delhi", "publishedAt": "2024-01-06T05:10:00Z"}]})
    gases = lines("g", {**readings(400, location_id=1), "parameter": {"name": "no2"}})
    data = str(tmp_path / "dataset")
    build_dataset.run(spark, build_dataset.arguments([
        "--measurements", measured, "--registry", f"{reg}/registry", "--pollutants", gases, "--articles", articles,
        "--end", "2024-01-14", "--out", data]))
    rows = spark.read.parquet(f"{data}/rows")
    assert rows.agg(F.max("date")).first()[0].isoformat() <= "2024-01-14"
    by_station = {r.station: r for r in rows.groupBy("station").agg(
        F.max("no2").alias("no2"), F.max("news_dust_storm").alias("dust"), F.count("*").alias("n")).collect()}
    assert sorted(r.no2 for r in by_station.values()) == [0.0, 56.0]
    assert all(r.dust > 0 for r in by_station.values())


def test_news_and_calendar_tables(spark, tmp_path):
    (tmp_path / "n").mkdir()
    (tmp_path / "n" / "a.json").write_text(json.dumps({"articles": [
        {"title": "Dust storm over Delhi", "publishedAt": "2024-01-06T05:10:00Z"}]}))
    out, plain = str(tmp_path / "news"), str(tmp_path / "calendar")
    days = ["--start", "2024-01-06", "--end", "2024-01-07"]
    build_news.run(spark, build_news.arguments([*days, "--articles", str(tmp_path / "n"), "--out", out]))
    news = spark.read.parquet(out)
    cities = news.select("city").distinct().count()
    assert cities > 1 and news.count() == cities * 48
    (row,) = news.filter("news_dust_storm > 0").collect()
    assert (row.city, row.timestamp) == ("Delhi", datetime(2024, 1, 6, 5))
    # one more day, and the same again
    for _ in range(2):
        build_news.run(spark, build_news.arguments([
            "--start", "2024-01-06", "--end", "2024-01-08", "--articles", str(tmp_path / "n"), "--out", out, "--append"]))
    assert spark.read.parquet(out).count() == cities * 72
    build_news.run(spark, build_news.arguments([*days, "--out", plain]))
    table = spark.read.parquet(plain)
    assert table.count() == cities * 48 and set(news.columns) == set(table.columns)
