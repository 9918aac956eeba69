import datetime as dt
import json

import pytest

from fieldspan import plans, sources, streaming


def test_request_keys():
    a = plans.Request((148.36265, -33.52606, 148.38265, -33.50606), dt.date(2024, 1, 1), dt.date(2024, 1, 21), stub="x")
    b = plans.Request(a.bbox, dt.date(2024, 2, 1), dt.date(2024, 2, 21))
    assert a.place_hash == b.place_hash and a.time_hash != b.time_hash and a.name == "x" and len(b.name) == 64
    assert plans.Request.around(-35.0, 148.9, 2, a.start, a.end).centre == pytest.approx((-35.0, 148.9))


def test_stage_cache(spark, tmp_path):
    path, built = str(tmp_path / "s"), []

    def build():
        built.append(1)
        return spark.range(3)

    assert not plans.is_complete(spark, path)
    assert plans.cached(spark, path, build).count() == 3 and plans.is_complete(spark, path)
    plans.cached(spark, path, build)
    assert len(built) == 1
    (tmp_path / "s" / "_SUCCESS").unlink()
    plans.cached(spark, path, build)
    plans.cached(spark, path, build, reload=True)
    assert len(built) == 3


def test_graph_raises_the_first_error():
    g = plans.Graph([plans.Stage("a", lambda c: 1 / 0), plans.Stage("b", lambda c: 1, ("a",)), plans.Stage("c", lambda c: 2)])
    with pytest.raises(ZeroDivisionError):
        g.run()
    assert g.status == {"a": "error", "b": "skipped", "c": "done"}


def test_geojson(spark, tmp_path):
    ring = [[0, 0], [1, 0], [1, 1], [0, 0]]
    f = tmp_path / "z.geojson"
    f.write_text(json.dumps({"features": [{"geometry": {"type": "Polygon", "coordinates": [ring]}, "properties": {"title": "A"}}, {"geometry": {"type": "MultiPolygon", "coordinates": [[ring], [ring]]}, "properties": {"title": "B"}}]}))
    assert sorted(r.zone for r in sources.read_geojson(spark, str(f), "title").collect()) == ["A", "B", "B"]
    assert len(sources.read_geojson(spark, str(f)).first().ring) == 4
    with pytest.raises(ValueError):
        sources.read_geojson(spark, "x.gpkg")


def test_scenes(spark):
    m = spark.createDataFrame([("a", 0.0, 0.0, 1.0, 1.0, dt.datetime(2024, 1, 5), 10.0), ("b", 0.0, 0.0, 1.0, 1.0, dt.datetime(2024, 1, 6), 30.0)], "scene string, west double, south double, east double, north double, time timestamp_ntz, cloud double")
    assert [r.scene for r in sources.scenes(m, 0.5, 0.5, 2, 2, "2024-01-01", "2024-01-31").collect()] == ["a"]
    with pytest.raises(RuntimeError):
        sources.scenes(m, 5, 5, 6, 6, "2024-01-01", "2024-01-31")


def test_stream_bins(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    s = streaming.binned(streaming.observations(spark, sf, schema, "events.parquet"), ["event_type"], "value", 10)
    q = s.writeStream.outputMode("complete").format("memory").queryName("bins").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("bins").agg({"n": "sum"}).first()[0] == spark.read.parquet(f"{sf}/events.parquet").where("value IS NOT NULL").count()
