import gzip
import json
import pathlib
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from aqspark.plans.history import build_history
from aqspark.sources import readers, schemas, writers
from aqspark.storage import new_path, shared_dir


def land(tmp_path, name, *documents):
    path = tmp_path / name
    path.write_text("\n".join(json.dumps(d) for d in documents))
    return str(path)


def test_locations_with_missing_parts(spark, tmp_path):
    path = land(tmp_path, "l.json", {"results": [
        {"id": 1, "name": "x", "coordinates": {"latitude": 1.0, "longitude": 2.0},
         "providers": [{"name": "p"}], "sensors": [{"id": 3, "parameter": {"name": "pm25"}}]},
        {"id": 2}]}, {"results": []})
    got = {r.location_id: r for r in readers.read_locations(spark, path).collect()}
    assert got[1].owner == "p" and got[1].lat == 1.0
    assert got[2].owner == "" and got[2].lat is None and got[2].sensors is None


def test_measurements_under_both_names(spark, tmp_path):
    page = {"sensor_id": 4, "results": [
        {"value": 1.5, "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}},
        {"value": 2.5, "period": {"dateFrom": {"utc": "2024-01-01T01:00:00Z"}}},
        {"value": None, "period": {"dateFrom": {"utc": "2024-01-01T02:00:00Z"}}},
        {"value": 3.5, "period": {"dateFrom": {"utc": "soon"}}}, {"value": 4.5}]}
    out = readers.read_hourly_measurements(spark, land(tmp_path, "m.json", page))
    assert sorted((r.ts.hour, r.value) for r in out.collect()) == [(0, 1.5), (1, 2.5)]


def test_weather_series(spark, tmp_path):
    doc = {"cell_lat": 1.0, "cell_lon": 2.0, "hourly": {
        "time": ["2024-01-01T00:00", "2024-01-01T01:00"], "temperature_2m": [3.0, None],
        "cloud_cover": [5.0, 6.0]}}
    path = land(tmp_path, "w.json", doc, {"hourly": None})
    batch = readers.read_weather(spark, path).collect()
    assert [(r.temperature_2m, r.cloud_cover, r.precipitation, r.boundary_layer_height)
            for r in batch] == [(3.0, 5.0, None, 0.0)]
    assert readers.read_weather(spark, path, require_temperature=False).count() == 2


def test_fires_csv(spark, tmp_path):
    path = tmp_path / "f.csv"
    path.write_text("latitude,longitude,bright_ti4,bright_ti5,frp,acq_date,acq_time\n"
                    "1,2,300,290,5.5,2024-01-01,5\n1,2,300,290,,2024-01-01,0012\n")
    got = readers.read_fires(spark, str(path)).collect()
    assert [(r.timestamp, r.frp) for r in got] == [(datetime(2024, 1, 1), 5.5)]


def test_archive_layouts(spark, tmp_path):
    files = {
        "locationid=1/year=2023/month=1/a.csv.gz":
            "datetime,value,parameter\n2023-01-01T00:10:00Z,10,pm25\n"
            "2023-01-01T00:50:00Z,3000,PM2.5\n2023-01-01T00:20:00Z,x,pm25\n"
            "bad,5,pm25\n2023-01-01T00:30:00Z,7,no2\n",
        "locationid=1/year=2023/month=2/a.csv.gz":
            "unit,average,utc\nug,-4,2023-02-03T01:00:00Z\nug,NaN,2023-02-03T02:00:00Z\n",
        "locationid=1/year=2023/month=3/a.csv.gz": "datetime,parameter\n2023-03-01T00:00:00Z,pm25\n",
        "locationid=2/year=2023/month=1/a.csv.gz": "utc,value\n2023-01-01T00:00:00Z,1\n",
        "locationid=1/year=2024/month=1/a.csv.gz": "utc,value\n2024-01-01T00:00:00Z,1\n",
    }
    for name, body in files.items():
        path = tmp_path / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(gzip.compress(body.encode()))
    stations = spark.createDataFrame([(1, "a", "Delhi", 28.0, 77.0), (None, "b", "x", 1.0, 1.0)],
                                     "location_id bigint, station string, city string, "
                                     "lat double, lon double")
    rows = readers.read_archive(spark, str(tmp_path), stations, "2023-01-01", "2023-12-31")
    got = build_history(rows, stations).orderBy("timestamp").collect()
    assert [(r.station, r.timestamp, r.pm25) for r in got] == [
        ("a", datetime(2023, 1, 1), 755.0), ("a", datetime(2023, 2, 3, 1), 0.0)]


def test_articles_with_bad_dates(spark, tmp_path):
    path = land(tmp_path, "a.json", {"articles": [
        {"title": "Smog", "publishedAt": "2024-01-01T05:30:00+05:30"},
        {"title": "x", "publishedAt": "today"}, {"title": "y"}]})
    got = readers.read_articles(spark, path).collect()
    assert [(r.timestamp, r.text) for r in got] == [(datetime(2024, 1, 1), "Smog")]


def test_registry_fallback_order(spark, tmp_path):
    path = land(tmp_path, "r.json", {"station": "a", "lat": 1.0})
    missing = str(tmp_path / "none.json")
    assert readers.read_registry(spark, missing, path).first().station == "a"
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        readers.read_registry(spark, missing)


def test_append_new_twice(spark, hours):
    path = new_path(spark, "append")
    first = hours([("a", 0, 1.0), ("a", 1, 1.0)])
    writers.append_new(first, path)
    writers.append_new(first.unionAll(hours([("b", 0, 2.0)])), path)
    writers.append_new(first, path)
    assert spark.read.parquet(path).groupBy("station").count().orderBy("station").collect() == [
        ("a", 2), ("b", 1)]


def files_by_day(path):
    out = {}
    for file in pathlib.Path(path).glob("date=*/*.parquet"):
        out.setdefault(file.parent.name[5:], set()).add(file.name)
    return out


def test_a_broken_off_append_is_completed(spark, hours):
    whole = hours([(s, h, h + 0.5) for s in "abc" for h in range(72)])
    path, other = new_path(spark, "hours"), new_path(spark, "hours")
    # what a stopped run may leave: its work folder, and part of its files
    (pathlib.Path(path) / "_temporary" / "0").mkdir(parents=True)
    assert writers.missing_hours(whole, path).count() == 216
    writers.append_hours(whole.filter("station = 'a' AND hour(timestamp) < 7 AND day(timestamp) < 3"), path)
    assert spark.read.parquet(path).count() == 14
    writers.append_hours(whole, path)
    writers.append_hours(whole, other)
    back, want = (spark.read.parquet(p) for p in (path, other))
    assert back.count() == want.count() == 216
    assert back.exceptAll(want).count() == 0


def test_append_leaves_stored_files_alone(spark, hours):
    path = new_path(spark, "hours")
    writers.append_hours(hours([("a", h, 1.0) for h in range(72)]), path)
    before = files_by_day(path)
    # one stored hour with another value, one new hour twice, rows without keys
    more = hours([("a", 30, 9.0), ("b", 30, 5.0), ("b", 30, 4.0)]).unionByName(
        spark.sql("SELECT CAST(NULL AS STRING) AS station, CAST(NULL AS TIMESTAMP) AS timestamp, 7D AS pm25"))
    writers.append_hours(more, path)
    writers.append_hours(more, path)
    after = files_by_day(path)
    assert {day: names for day, names in after.items() if day != "2024-01-02" and day[:2] == "20"} == {
        day: names for day, names in before.items() if day != "2024-01-02"}
    assert before["2024-01-02"] < after["2024-01-02"]
    rows = spark.read.parquet(path)
    assert rows.count() == 74 and rows.filter("station = 'b'").first().pm25 == 4.0
    assert rows.filter("station IS NULL AND timestamp IS NULL").count() == 1
    assert rows.filter("station = 'a' AND pm25 <> 1").count() == 0


def test_append_reads_only_the_days_in_question(spark, hours, capsys):
    path = new_path(spark, "hours")
    writers.append_hours(hours([("a", h, 1.0) for h in range(24 * 20)]), path)
    writers.missing_hours(hours([("b", 30, 5.0)]), path).explain("formatted")
    plan = capsys.readouterr().out
    scan = plan[plan.index("PartitionFilters"):]
    assert "2024-01-02" in scan.splitlines()[0] and "2024-01-03" not in scan.splitlines()[0]
    assert "ReadSchema: struct<station:string,timestamp:timestamp>" in plan


def test_dataset_by_day(spark, hours):
    path = new_path(spark, "daily")
    writers.write_dataset(hours([("a", h, 1.0) for h in range(50)]), path)
    back = spark.read.parquet(path)
    assert back.filter(F.col("date") == "2024-01-02").count() == 24 and back.count() == 50


def test_shared_folder_is_the_named_one(spark):
    named = spark.conf.get("spark.checkpoint.dir", None)
    assert shared_dir(spark) == (named or spark.sparkContext.getCheckpointDir()) or named is None


def test_a_torn_page_stops_the_job_or_is_listed(spark, tmp_path):
    page = {"sensor_id": 4, "results": [
        {"value": 1.5, "period": {"datetimeFrom": {"utc": "2024-01-01T00:00:00Z"}}}]}
    path = tmp_path / "m.json"
    path.write_text(json.dumps(page) + "\n" + json.dumps(page)[:40] + "\n")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST"):
        readers.read_hourly_measurements(spark, str(path)).collect()
    assert readers.read_hourly_measurements(spark, str(path), broken="skip").count() == 1
    broken = readers.broken_documents(spark, str(path), schemas.MEASUREMENTS).collect()
    assert [r.document for r in broken] == [json.dumps(page)[:40]]
    with pytest.raises(ValueError):
        readers.read_hourly_measurements(spark, str(path), broken="ignore")


def test_archive_of_any_width_with_quoted_cells(spark, tmp_path):
    path = tmp_path / "locationid=1/year=2023/month=1/a.csv.gz"
    path.parent.mkdir(parents=True)
    notes = ",".join(f"note{i}" for i in range(20))
    cells = ",".join('"a, ""b"""' for _ in range(20))
    path.write_bytes(gzip.compress(
        f"{notes},\"value\",datetime\n{cells},7.5,2023-01-01T00:10:00Z\n\n{cells},8.5,\"2023-01-01T01:10:00Z\"\n".encode()))
    got = readers.read_archive(spark, str(tmp_path)).orderBy("timestamp").collect()
    assert [(r.pm25, r.timestamp, r.parameter) for r in got] == [
        ("7.5", "2023-01-01T00:10:00Z", None), ("8.5", "2023-01-01T01:10:00Z", None)]


def test_registry_as_one_indented_list(spark, tmp_path):
    path = tmp_path / "r.json"
    path.write_text(json.dumps([{"station": "a", "lat": 1.0}, {"station": "b", "lat": 2.0}], indent=2))
    assert sorted((r.station, r.lat) for r in readers.read_registry(spark, str(path)).collect()) == [
        ("a", 1.0), ("b", 2.0)]


def test_live_rows_need_no_targets(spark, hours):
    path = new_path(spark, "live")
    writers.write_dataset(hours([("a", h, 1.0) for h in range(72)]), path)
    assert readers.read_live(spark, path).count() == 72
    assert readers.read_live(spark, path, since="2024-01-03").count() == 24
    assert readers.read_dataset(spark, path).count() == 0
