"""Reference systems of layers: degrees and the Japanese plane systems, both ways, for geometries of any depth.

A system is named by its code. Every change goes over degrees of the geographic system: planes to degrees by the inverse of the
transverse Mercator series, degrees to planes by `formats.plane_xy`. EPSG:4326 and EPSG:6668 are taken as the same degrees,
as the published transformation between them has no shift. There and back agrees to well under a millimetre within some degrees of a
plane's meridian.

Geometries are structs with x (longitude or easting) and y (latitude or northing), or arrays of such, at any depth: points, lines, lines of
parts, polygons of rings. Nulls stay null; other fields of a struct stay as they are.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StructType

from reliefgrid.functions.formats import GRS80_A, GRS80_F, PLANE_SCALE, plane_xy
from reliefgrid.functions.nulls import _col, bound
from reliefgrid.sources.storage import crs_of, with_crs

# Geographic systems, and the origins (longitude, latitude) of the plane systems I to XIX, EPSG:6669 to EPSG:6687.
GEOGRAPHIC = ("EPSG:4326", "EPSG:6668")
ORIGINS = (
    (129.5, 33.0), (131.0, 33.0), (132 + 10 / 60, 36.0), (133.5, 33.0), (134 + 20 / 60, 36.0), (136.0, 36.0), (137 + 10 / 60, 36.0),
    (138.5, 36.0), (139 + 50 / 60, 36.0), (140 + 50 / 60, 40.0), (140.25, 44.0), (142.25, 44.0), (144.25, 44.0), (142.0, 26.0),
    (127.5, 26.0), (124.0, 26.0), (131.0, 26.0), (136.0, 20.0), (154.0, 26.0),
)
PLANES = {f"EPSG:{6669 + k}": o for k, o in enumerate(ORIGINS)}


def lonlat(x, y, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Longitude and latitude in degrees of a place in a plane system: the inverse of `plane_xy`, by series to the fourth order of n."""
    n = GRS80_F / (2 - GRS80_F)
    scale = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * PLANE_SCALE
    beta = (
        n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440,
        17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280,
    )
    delta = (
        2 * n - 2 * n**2 / 3 - 2 * n**3 + 116 * n**4 / 45, 7 * n**2 / 3 - 8 * n**3 / 5 - 227 * n**4 / 45,
        56 * n**3 / 15 - 136 * n**4 / 35, 4279 * n**4 / 630,
    )
    # the origin's northing, as plane_xy has it
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    s0 = math.sin(math.radians(lat0))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    start = xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1))
    xi, eta = _col(y) / scale + start, _col(x) / scale
    north, east = xi, eta
    for j, b in enumerate(beta, 1):
        north = north - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    chi = F.asin(F.sin(north) / F.cosh(east))
    lat = chi
    for j, d in enumerate(delta, 1):
        lat = lat + d * F.sin(2 * j * chi)
    return F.degrees(F.atan2(F.sinh(east), F.cos(north))) + lon0, F.degrees(lat)


def _known(*systems: str) -> None:
    if bad := [s for s in systems if s not in GEOGRAPHIC and s not in PLANES]:
        raise ValueError(f"no such reference systems here: {bad}")


def convert(place: Column, source: str, target: str) -> Column:
    """A struct with x and y, from one system to another, as struct<x, y>; null if a coordinate is."""
    _known(source, target)
    struct = lambda xy: F.struct(xy[0].alias("x"), xy[1].alias("y"))
    p = struct((place["x"].cast("double"), place["y"].cast("double")))
    if source in PLANES and source != target:
        p = bound(p, lambda q: struct(lonlat(q["x"], q["y"], *PLANES[source])))
    if target in PLANES and source != target:
        p = bound(p, lambda q: struct(plane_xy(q["x"], q["y"], *PLANES[target])))
    return F.when(place["x"].isNotNull() & place["y"].isNotNull(), p)


def reproject(geometry: Column, kind: DataType, source: str, target: str) -> Column:
    """A geometry of this type, each of its places converted; the depth stays."""
    if isinstance(kind, ArrayType):
        return F.transform(geometry, lambda g: reproject(g, kind.elementType, source, target))
    if not isinstance(kind, StructType) or not {"x", "y"} <= set(kind.names):
        raise ValueError(f"no geometry: {kind.simpleString()}")
    moved = bound(convert(geometry, source, target), lambda p: F.struct(*[(p[c] if c in ("x", "y") else geometry[c]).alias(c) for c in kind.names]))
    return F.when(geometry.isNotNull(), moved)


def reproject_layer(df: DataFrame, geometry: str, target: str, source: str | None = None) -> DataFrame:
    """df with its geometry in the target system, of which the column's metadata then tells. source: the layer's own system unless its
    metadata has it; if both are there they have to agree."""
    own = crs_of(df, geometry)
    if own is None and source is None:
        raise ValueError(f"{geometry} says of no reference system")
    if own and source and own != source:
        raise ValueError(f"{geometry} is of {own}, not of {source}")
    source = own or source
    return with_crs(df.withColumn(geometry, reproject(F.col(geometry), df.schema[geometry].dataType, source, target)), geometry, target)
