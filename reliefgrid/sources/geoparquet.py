"""GeoParquet files: the `geo` footer that says of the geometry column's encoding, system, types and bounds.

Files are written by a Python data source (`df.write.format("geoparquet")`), a file a task, each with its footer. What a task writes
counts once the whole write is committed: files of attempts that failed, or ran twice, are removed then. Rows are read by Spark's
own Parquet reader, with all its pushing down; footers are read on the executors, a row a file, and files beyond asked bounds
aren't read at all. Geometries are well-known binary. Paths are those that pyarrow's file systems know.
"""

from __future__ import annotations

import json
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from reliefgrid.operators.polylines import parse_wkb
from reliefgrid.sources.storage import with_crs

# Fixed values of the format: its version, and names of geometry types by their number in well-known binary.
VERSION = "1.0.0"
TYPES = {1: "Point", 2: "LineString", 3: "Polygon", 4: "MultiPoint", 5: "MultiLineString", 6: "MultiPolygon", 7: "GeometryCollection"}


def geometry_type(data: bytes) -> str | None:
    if len(data) < 5:
        return None
    (kind,) = struct.unpack_from("<I" if data[0] == 1 else ">I", data, 1)
    return TYPES.get((kind & 0xFF) if kind & 0xE0000000 else kind % 1000)


def geo_footer(geometry: str, crs: str, geometries: list[bytes | None]) -> dict:
    """The footer of a file with these geometries; without any it has no bounds. crs: an authority's code, such as EPSG:6668."""
    authority, code = crs.split(":")
    parts = [p for g in geometries if g for p in parse_wkb(g) or []]
    column = {"encoding": "WKB", "geometry_types": sorted({t for g in geometries if g and (t := geometry_type(g))}), "crs": {"type": "CRS", "name": crs, "id": {"authority": authority, "code": int(code)}}}
    if parts:
        xy = np.concatenate(parts)
        column["bbox"] = [*map(float, xy.min(0)), *map(float, xy.max(0))]
    return {"version": VERSION, "primary_column": geometry, "columns": {geometry: column}}


def footer_crs(geo: dict) -> str | None:
    """The code of the primary column's system; by the format's rule, longitude and latitude of OGC:CRS84 where none is named."""
    crs = geo["columns"][geo["primary_column"]].get("crs", {"id": {"authority": "OGC", "code": "CRS84"}})
    return f"{crs['id']['authority']}:{crs['id']['code']}" if crs and "id" in crs else None


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


@dataclass
class Written(WriterCommitMessage):
    file: str | None


class GeoParquet(DataSource):
    """Writes only; options: path, geometry, crs."""

    @classmethod
    def name(cls) -> str:
        return "geoparquet"

    def schema(self) -> str:
        raise NotImplementedError("read_geoparquet reads these files")

    def writer(self, schema, overwrite: bool) -> Writer:
        return Writer(self.options["path"], self.options["geometry"], self.options["crs"], schema, overwrite)


class Writer(DataSourceArrowWriter):
    def __init__(self, path: str, geometry: str, crs: str, schema, overwrite: bool):
        if geometry not in schema.names:
            raise ValueError(f"no column {geometry}")
        self.path, self.geometry, self.crs, self.names, self.overwrite = path, geometry, crs, schema.names, overwrite
        self.run = uuid.uuid4().hex  # of this write, in its files' names

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        batches = [b for b in iterator if b.num_rows]
        if not batches:
            return Written(None)
        table = pa.Table.from_batches(batches).rename_columns(self.names)
        at = table.schema.get_field_index(self.geometry)
        table = table.set_column(at, self.geometry, table.column(at).cast(pa.binary()))
        geo = geo_footer(self.geometry, self.crs, table.column(at).to_pylist())
        table = table.replace_schema_metadata({"geo": json.dumps(geo)})
        store, root = _open(self.path)
        store.create_dir(root)
        name = f"part-{self.run}-{uuid.uuid4().hex}.parquet"
        with store.open_output_stream(f"{root}/{name}") as out:
            pq.write_table(table, out, compression="zstd")
        return Written(name)

    def _files(self) -> list[str]:
        store, root = _open(self.path)
        return [f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True)) if f.base_name.endswith(".parquet")]

    def commit(self, messages: list[Written | None]) -> None:
        """Files of this write that no task's message names go, and with overwrite all that were there before."""
        store, root = _open(self.path)
        mine = {m.file for m in messages if m and m.file}
        for name in self._files():
            if name not in mine and (self.overwrite or name.startswith(f"part-{self.run}-")):
                store.delete_file(f"{root}/{name}")

    def abort(self, messages: list[Written | None]) -> None:
        store, root = _open(self.path)
        for name in self._files():
            if name.startswith(f"part-{self.run}-"):
                store.delete_file(f"{root}/{name}")


def write_geoparquet(df: DataFrame, path: str, geometry: str, crs: str, mode: str = "append") -> None:
    """df with its geometry as well-known binary in files with a `geo` footer; mode: append or overwrite."""
    df.sparkSession.dataSource.register(GeoParquet)
    df.write.format("geoparquet").option("geometry", geometry).option("crs", crs).mode(mode).save(path)


def geo_footers(spark: SparkSession, path: str) -> DataFrame:
    """file, geometry, crs, types, x0, y0, x1, y1 of each file's footer; nulls where a file has no `geo`, or its column no bounds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for name in batch.column("file").to_pylist():
                store, at = _open(name)
                with store.open_input_file(at) as f:
                    raw = (pq.read_metadata(f).metadata or {}).get(b"geo")
                geo = json.loads(raw) if raw else None
                column = geo["columns"][geo["primary_column"]] if geo else {}
                box = column.get("bbox") or [None] * 4
                rows.append([name, geo and geo["primary_column"], geo and footer_crs(geo), column.get("geometry_types"), *box[:2], *box[len(box) // 2 :][:2]])
            kinds = [pa.string()] * 3 + [pa.list_(pa.string())] + [pa.float64()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds, strict=True)], ["file", "geometry", "crs", "types", "x0", "y0", "x1", "y1"])

    files = spark.createDataFrame([(f,) for f in sorted(spark.read.parquet(path).inputFiles())], "file string")
    return files.mapInArrow(run, "file string, geometry string, crs string, types array<string>, x0 double, y0 double, x1 double, y1 double")


def read_geoparquet(spark: SparkSession, path: str, columns: list[str] | None = None, bounds: tuple[float, float, float, float] | None = None) -> DataFrame:
    """The files' rows, the geometry column's metadata saying of its system. bounds (x0, y0, x1, y1): only files whose own bounds
    meet these, or that tell of none. Files without a `geo` footer, or of unlike columns or systems, are an error."""
    found = geo_footers(spark, path)
    kinds = [tuple(r) for r in found.select("geometry", "crs").distinct().limit(2).collect()]
    if len(kinds) != 1 or None in kinds[0]:
        raise ValueError(f"the files under {path} tell of no one geometry column and system: {kinds}")
    d = spark.read.parquet(path)
    if bounds is not None:
        x0, y0, x1, y1 = bounds
        files = [r.file for r in found.where(f"x0 IS NULL OR (x0 <= {x1!r} AND x1 >= {x0!r} AND y0 <= {y1!r} AND y1 >= {y0!r})").select("file").collect()]
        d = spark.read.schema(d.schema).parquet(*files) if files else d.where("false")
    geometry, crs = kinds[0]
    return with_crs(d if columns is None else d.select(*columns), geometry, crs)
