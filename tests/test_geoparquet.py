"""GeoParquet: footers read by a reader that knows only them, and the other way round; appended, overwritten and pruned files."""

import json
import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from reliefgrid.operators.polylines import line_wkb
from reliefgrid.sources import geoparquet as G
from reliefgrid.sources.storage import crs_of

A, B, C = line_wkb([[(1.0, 2.0)]]), line_wkb([[(5.0, 6.0), (9.0, 7.0)]]), line_wkb([[(100.0, 100.0)], [(101.0, 103.0)]])


def rows(df):
    return sorted((r.id, None if r.g is None else bytes(r.g)) for r in df.collect())


def test_files_written_here_tell_of_themselves(spark, tmp_path):
    path = f"{tmp_path}/out"
    d = spark.createDataFrame([(1, A), (2, B), (3, None)], "id long, g binary").coalesce(1)
    G.write_geoparquet(d, path, "g", "EPSG:6668")
    (name,) = [f for f in os.listdir(path) if f.endswith(".parquet")]
    geo = json.loads(pq.read_metadata(f"{path}/{name}").metadata[b"geo"])
    column = geo["columns"][geo["primary_column"]]
    assert geo["primary_column"] == "g" and column["encoding"] == "WKB" and column["crs"]["id"] == {"authority": "EPSG", "code": 6668}
    assert column["bbox"] == [1.0, 2.0, 9.0, 7.0] and column["geometry_types"] == ["LineString", "Point"]
    assert pq.read_table(f"{path}/{name}").column("id").to_pylist() == [1, 2, 3]
    back = G.read_geoparquet(spark, path)
    assert rows(back) == [(1, A), (2, B), (3, None)] and crs_of(back, "g") == "EPSG:6668"
    more = spark.createDataFrame([(4, C)], "id long, g binary")
    G.write_geoparquet(more, path, "g", "EPSG:6668")
    assert [i for i, _ in rows(G.read_geoparquet(spark, path, ["id", "g"]))] == [1, 2, 3, 4]
    assert [i for i, _ in rows(G.read_geoparquet(spark, path, bounds=(90.0, 90.0, 200.0, 200.0)))] == [4]
    assert rows(G.read_geoparquet(spark, path, bounds=(-9.0, -9.0, -8.0, -8.0))) == []
    G.write_geoparquet(more, path, "g", "EPSG:6668", "overwrite")
    assert rows(G.read_geoparquet(spark, path)) == [(4, C)]


def test_only_what_tasks_report_stays(tmp_path):
    """A second attempt of a task, and one that fails, leave no rows; files of others stay."""
    path = f"{tmp_path}/out"
    schema = type("Schema", (), {"names": ["id", "g"]})
    batch = pa.RecordBatch.from_pydict({"id": [1], "g": [A]})
    old = G.Writer(path, "g", "EPSG:6668", schema, False)
    old.commit([old.write(iter([batch]))])
    w = G.Writer(path, "g", "EPSG:6668", schema, False)
    w.write(iter([batch]))  # of an executor that was lost
    kept = w.write(iter([batch]))
    assert w.write(iter([])).file is None
    w.commit([kept, None])
    assert len(os.listdir(path)) == 2 and kept.file in os.listdir(path)
    failed = G.Writer(path, "g", "EPSG:6668", schema, False)
    failed.write(iter([batch]))
    failed.abort([None])
    assert len(os.listdir(path)) == 2


def test_files_written_elsewhere(spark, tmp_path):
    path = str(tmp_path)
    for k, geo in enumerate([{"primary_column": "g", "columns": {"g": {"encoding": "WKB"}}}] * 2):
        t = pa.table({"id": [k], "g": pa.array([A], pa.binary())}).replace_schema_metadata({"geo": json.dumps(geo)})
        pq.write_table(t, f"{path}/{k}.parquet")
    d = G.read_geoparquet(spark, path, bounds=(0.0, 0.0, 1.0, 1.0))  # files without bounds are read
    assert rows(d) == [(0, A), (1, A)] and crs_of(d, "g") == "OGC:CRS84"
    pq.write_table(pa.table({"id": [9], "g": pa.array([A], pa.binary())}), f"{path}/plain.parquet")
    with pytest.raises(ValueError, match="no one geometry column"):
        G.read_geoparquet(spark, path)
