"""Reading tables, and cutting lineage in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster shares; one is made only for a local session that names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def checkpoint(df: DataFrame) -> DataFrame:
    shared_dir(df.sparkSession)
    return df.checkpoint()


def stored(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again. Unlike a checkpoint's, its size is that of its files: the plan of
    a loop that joins a table with itself keeps sound estimates."""
    path = f"{shared_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """df's rows dealt over all cores, for work that is long for each row: a small file would be one task's."""
    return df.repartition(4 * df.sparkSession.sparkContext.defaultParallelism)


def csv_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV file with a header, as text columns of the given names; a byte order mark is dropped with the header line."""
    return spark.read.csv(path, header=True, schema=schema, enforceSchema=True, encoding="UTF-8", multiLine=True)


def geojson_features(spark: SparkSession, path: str) -> DataFrame:
    """One row for each feature of the files: file, snapshot time from the file's name, properties and geometry as JSON."""
    text = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("file_name"))
    f = F.from_json("value", "features array<struct<properties: map<string, string>, geometry: string>>")
    at = F.try_to_timestamp(F.regexp_extract("file_name", r"(\d{8}_\d{4})", 1), F.lit("yyyyMMdd_HHmm"))
    return text.select("file_name", at.alias("snapshot_time"), F.posexplode(f["features"]).alias("feature_index", "x")).select("file_name", "snapshot_time", "feature_index", "x.properties", "x.geometry")


def file_rows(spark: SparkSession, path: str) -> DataFrame:
    """Parquet rows with their place: `_file` and `_row`, the row's number in it, from 0. So the order of a file stays known however
    its rows are dealt to tasks."""
    return spark.read.parquet(path).select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def file_manifest(spark: SparkSession, path: str) -> DataFrame:
    """relative_path, bytes, sha256 of each file."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("relative_path"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def geojson_text(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One JSON feature a row, for a text sink."""
    return df.select(F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("value"))


def keyed_lookup(rows: DataFrame, lookup: DataFrame, keys: list[str], order: list[str] = []) -> DataFrame:  # noqa: B006
    """rows with the columns of the lookup's first row of their keys; rows that it doesn't hold keep nulls. First is the least by
    `order` (such as a file's line numbers), then by the other columns in turn, so that reruns agree; nulls come first."""
    rest = [c for c in lookup.columns if c not in keys]
    if not rest:
        return rows.join(lookup.distinct(), keys, "left")
    first = lookup.groupBy(*keys).agg(F.min(F.struct(*order, *[c for c in rest if c not in order])).alias("first_"))
    return rows.join(first.select(*keys, *[F.col("first_").getField(c).alias(c) for c in rest]), keys, "left")


def with_crs(df: DataFrame, geometry: str, crs: str) -> DataFrame:
    """df with the geometry's reference system in the column's metadata, which Parquet files written from it carry."""
    return df.withMetadata(geometry, {**df.schema[geometry].metadata, "crs": crs})


def crs_of(df: DataFrame, geometry: str) -> str | None:
    return df.schema[geometry].metadata.get("crs")


def require_crs(df: DataFrame, geometry: str, crs: str) -> DataFrame:
    """df, or an error if its geometry is of another system or says of none."""
    if crs_of(df, geometry) != crs:
        raise ValueError(f"{geometry} is of {crs_of(df, geometry)}, not of {crs}")
    return df


def geo_table(spark: SparkSession, path: str, columns: list[str], geometry: str, crs: str) -> DataFrame:
    """Some columns of a geometry table, whose system has to be crs; geometries stay as they are stored."""
    return require_crs(spark.read.parquet(path).select(*columns), geometry, crs)


def write_geo(df: DataFrame, path: str, geometry: str, crs: str) -> None:
    with_crs(df, geometry, crs).write.option("compression", "zstd").parquet(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Files with a header; nulls are empty, quotes are doubled."""
    df.write.option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def write_audit(df: DataFrame, path: str) -> None:
    """One JSON object a row, nulls kept; a later audit of the same path replaces it."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def feature_collections(df: DataFrame, by: list[str], geometry: str, properties: list[str]) -> DataFrame:
    """by, value: one FeatureCollection for each value of by, features in order of their properties. Its features go into one row."""
    f = df.select(*by, F.struct(*properties).alias("order_"), F.concat(F.lit('{"type":"Feature","geometry":'), F.coalesce(geometry, F.lit("null")), F.lit(',"properties":'), F.to_json(F.struct(*properties)), F.lit("}")).alias("f"))
    each = F.transform(F.array_sort(F.collect_list(F.struct("order_", "f"))), lambda x: x["f"])
    return f.groupBy(*by).agg(F.concat(F.lit('{"type":"FeatureCollection","features":['), F.array_join(each, ","), F.lit("]}")).alias("value"))


def table_shape(spark: SparkSession, path: str) -> tuple[int, int]:
    """Rows and columns; the count comes from the files' footers."""
    d = spark.read.parquet(path)
    return d.count(), len(d.columns)


def markdown_section(text: Column, title: str) -> Column:
    """The lines under a heading, up to the next heading of any level; null without it."""
    found = F.regexp_extract(text, rf"(?ms)^#+ \Q{title}\E[ \t]*\n(.*?)(?=^#+ |\z)", 1)
    return F.when(text.rlike(rf"(?m)^#+ \Q{title}\E[ \t]*$"), F.btrim(found, F.lit(" \t\n")))


def markdown_rows(df: DataFrame) -> DataFrame:
    """value: each row as a line of a markdown table, bars escaped; `markdown_head` gives the two lines above."""
    cells = [F.coalesce(F.replace(F.col(c).cast("string"), F.lit("|"), F.lit("\\|")), F.lit("")) for c in df.columns]
    return df.select(F.concat(F.lit("| "), F.concat_ws(" | ", *cells), F.lit(" |")).alias("value"))


def markdown_head(df: DataFrame) -> list[str]:
    return ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
