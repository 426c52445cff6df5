"""ZIP archives of GeoJSON: an inventory of all members, features of those asked for, and one schema for unlike properties.

An archive is read as one value of one row, and its members become rows of their own at once; features are exploded by Spark.
"""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def archive_members(spark: SparkSession, path: str, wanted: str | None = None) -> DataFrame:
    """archive, member, bytes, sha256, value for each file in the archives: value is the text of members whose name fits `wanted` (a
    regular expression; not given: none), null for all others and for what isn't UTF-8. What is no archive gives one row without
    a member."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["archive", "member", "bytes", "sha256", "value"]
        kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()]
        for batch in batches:
            for archive, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                rows = []
                try:
                    with zipfile.ZipFile(io.BytesIO(content)) as z:
                        for m in z.infolist():
                            if not m.is_dir():
                                data = z.read(m)
                                rows.append((archive, m.filename, len(data), hashlib.sha256(data).hexdigest(), _text(data) if wanted and re.search(wanted, m.filename) else None))
                except zipfile.BadZipFile:
                    rows.append((archive, None, None, None, None))
                for r in rows:  # a batch a member: members may be large
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(r, kinds, strict=True)], names)

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(run, "archive string, member string, bytes long, sha256 string, value string")


def _text(data: bytes) -> str | None:
    try:
        return data.decode("utf-8-sig")
    except UnicodeDecodeError:
        return None


def archive_features(members: DataFrame) -> DataFrame:
    """archive, member, snapshot_time (from the member's name), feature_index, properties and geometry as JSON, of the members that have
    a text; a text that is no feature collection has no rows."""
    found = F.from_json("value", "features array<struct<properties: string, geometry: string>>")["features"]
    at = F.try_to_timestamp(F.regexp_extract("member", r"(\d{8}_\d{4})", 1), F.lit("yyyyMMdd_HHmm"))
    d = members.where("value IS NOT NULL").select("archive", "member", at.alias("snapshot_time"), F.posexplode(found).alias("feature_index", "x"))
    return d.select("archive", "member", "snapshot_time", "feature_index", "x.properties", "x.geometry")


def property_schema(features: DataFrame) -> str:
    """One schema for the properties of all features, as DDL: all names, types widened until they hold all values, text where they are
    of unlike kinds or never known. One aggregation, the first pass over the features."""
    merged = features.agg(F.schema_of_variant_agg(F.try_parse_json("properties"))).first()[0]
    ddl = re.sub(r"\b(VARIANT|VOID)\b", "STRING", re.sub(r"\bOBJECT<", "STRUCT<", merged or ""))
    return ddl if ddl.startswith("STRUCT<") else "STRUCT<>"


def typed_features(features: DataFrame, schema: str) -> DataFrame:
    """features with `properties` as a struct of the schema; a property that a feature doesn't have is null."""
    return features.withColumn("properties", F.from_json("properties", schema))
