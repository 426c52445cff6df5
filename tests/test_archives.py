"""Archives of unlike GeoJSON members: inventory, features of the named ones, one schema."""

import json
import zipfile

from reliefgrid.sources import archives as A


def collection(*features):
    return json.dumps({"type": "FeatureCollection", "features": [{"type": "Feature", "properties": p, "geometry": g} for p, g in features]}, ensure_ascii=False)


def test_archives(spark, tmp_path):
    point = {"type": "Point", "coordinates": [1, 2]}
    with zipfile.ZipFile(tmp_path / "a.zip", "w") as z:
        z.writestr("road/20260807_1000.geojson", "﻿" + collection(({"id": 1, "name": "国道", "open": True}, point), ({"id": 2}, None)))
        z.writestr("road/20260807_1100.geojson", collection(({"id": 2.5, "name": "x", "depth": {"m": 1}}, point)))
        z.writestr("readme.txt", "no features")
        z.writestr("empty/", "")
    with zipfile.ZipFile(tmp_path / "b.zip", "w") as z:
        z.writestr("road/plain.geojson", collection(({"id": "A7", "open": None}, point)))
        z.writestr("road/broken.geojson", "{")
        z.writestr("road/latin.geojson", b"\xff\xfe\xff")
    (tmp_path / "c.zip").write_bytes(b"no archive")
    m = A.archive_members(spark, str(tmp_path), r"^road/.*\.geojson$")
    got = {(r.archive.rsplit("/", 1)[1], r.member): r for r in m.collect()}
    assert len(got) == 7 and ("c.zip", None) in got
    assert got["a.zip", "readme.txt"].bytes == 11 and got["a.zip", "readme.txt"].value is None
    assert len(got["b.zip", "road/latin.geojson"].sha256) == 64
    f = A.archive_features(m)
    schema = A.property_schema(f)
    rows = {(r.member.rsplit("/", 1)[1], r.feature_index): r for r in A.typed_features(f, schema).collect()}
    assert len(rows) == 4
    first = rows["20260807_1000.geojson", 0]
    assert (first.properties.id, first.properties.name, first.properties.open, first.properties.depth) == ("1", "国道", True, None)
    assert rows["20260807_1000.geojson", 1].properties.name is None and rows["20260807_1000.geojson", 1].geometry is None
    assert str(first.snapshot_time) == "2026-08-07 10:00:00" and json.loads(first.geometry) == point
    assert rows["20260807_1100.geojson", 0].properties.depth.m == 1
    plain = rows["plain.geojson", 0]
    assert plain.properties.id == "A7" and plain.snapshot_time is None
    one = A.archive_features(A.archive_members(spark, str(tmp_path), "1000"))
    assert {r.member for r in one.collect()} == {"road/20260807_1000.geojson"}
    assert A.property_schema(one.where("false")) == "STRUCT<>"
    assert "BIGINT" in A.property_schema(one)
