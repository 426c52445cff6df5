"""Formats of tables and messages, mixed timestamps, geometry texts and point encodings, and plane coordinates."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from reliefgrid.functions.nulls import _col, bound

# Fixed values of the GRS80 ellipsoid and of the Japanese plane coordinate systems.
GRS80_A, GRS80_F, PLANE_SCALE = 6378137.0, 1 / 298.257222101, 0.9999


def markdown_cell(c, longest: int = 60) -> Column:
    """A table cell: bars escaped, line ends as blanks, cut to `longest` with three dots."""
    c = F.replace(F.replace(_col(c), F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    return F.when(F.length(c) > longest, F.concat(F.left(c, F.lit(longest - 3)), F.lit("..."))).otherwise(c)


def thousands(c, digits: int = 0) -> Column:
    return F.format_number(_col(c), digits)


def percent(c, digits: int = 1) -> Column:
    return F.concat(F.format_number(_col(c) * 100, digits), F.lit("%"))


def translate_exact(c, words: dict[str, str]) -> Column:
    """The translation of a text; one that isn't listed is an error when the row is read, null stays null."""
    c = _col(c)
    m = F.create_map(*[F.lit(x) for kv in words.items() for x in kv])
    return F.when(c.isNull(), None).otherwise(F.coalesce(m[c], F.raise_error(F.concat(F.lit("no translation of "), c))))


def mixed_timestamp(c, formats: tuple[str, ...], zone: str) -> Column:
    """The first format that fits gives the local time in the zone, brought to UTC."""
    return F.to_utc_timestamp(F.coalesce(*[F.try_to_timestamp(_col(c), F.lit(f)) for f in formats]), zone)


def valid_geometry(c) -> Column:
    """The text itself if it is a JSON object with a type, else null."""
    c = _col(c)
    return F.when(F.get_json_object(c, "$.type").isNotNull(), c)


def geometry_type(c) -> Column:
    return F.get_json_object(_col(c), "$.type")


def _hex_double(h: Column) -> Column:
    """The double that 16 hexadecimal digits, highest first, encode."""
    part = lambda a, n: F.conv(F.substring(h, a, n), 16, 10).cast("double")
    share = (part(4, 5) * 2.0**32 + part(9, 8)) / 2.0**52

    def value(head: Column) -> Column:
        sign, power = F.when(head >= 2048, -1.0).otherwise(1.0), F.pmod(head, F.lit(2048))
        return sign * F.when(power == 0, share * F.pow(F.lit(2.0), F.lit(-1022.0))).otherwise((1 + share) * F.pow(F.lit(2.0), (power - 1023).cast("double")))

    return bound(F.conv(F.substring(h, 1, 3), 16, 10).cast("int"), value)


def point_from_wkb(c) -> tuple[Column, Column]:
    """x and y of a point in well-known binary, of either byte order; anything else gives nulls."""
    h = F.hex(_col(c))
    little = F.substring(h, 1, 2) == "01"
    byte = lambda at: F.substring(h, 2 * at + 1, 2)
    word = lambda at, n: F.when(little, F.concat(*[byte(at + n - 1 - k) for k in range(n)])).otherwise(F.substring(h, 2 * at + 1, 2 * n))
    is_point = (F.length(h) >= 42) & (F.substring(word(1, 4), 7, 2) == "01")
    return tuple(F.when(is_point, bound(word(at, 8), _hex_double)) for at in (5, 13))


def _double_hex(x: Column) -> Column:
    """The 16 hexadecimal digits, highest first, that encode a finite double."""
    v, two = F.abs(x), lambda k: F.pow(F.lit(2.0), k.cast("double"))
    near = lambda g: F.greatest(F.when(two(g) > v, g - 1).when(two(g + 1) <= v, g + 1).otherwise(g), F.lit(-1022))

    def digits(s: Column) -> Column:
        whole = F.when(v == 0, F.lit(0)).otherwise((v / two(s) * 2.0**52).cast("long"))  # exact: 53 bits at most
        head = F.when(whole >= 1 << 52, s + 1023).otherwise(F.lit(0)) + F.when(x < 0, 2048).otherwise(0)
        return F.concat(F.lpad(F.hex(head), 3, "0"), F.lpad(F.hex(whole.bitwiseAND(F.lit((1 << 52) - 1))), 13, "0"))

    return bound(bound(F.coalesce(F.floor(F.log2(v)), F.lit(-1022)), near), digits)


def point_wkb(x, y) -> Column:
    """A point in well-known binary, low byte first; null unless both coordinates are finite."""
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    turned = lambda h: F.concat(*[F.substring(h, 15 - 2 * k, 2) for k in range(8)])
    x, y = _col(x).cast("double"), _col(y).cast("double")
    return F.when(fine(x) & fine(y), F.unhex(F.concat(F.lit("0101000000"), bound(_double_hex(x), turned), bound(_double_hex(y), turned))))


def graticule(low, high, step: float) -> Column:
    """The multiples of the step from low to high, both included."""
    first, last = F.ceil(_col(low) / step), F.floor(_col(high) / step)
    steps = F.when(first <= last, F.sequence(first, last)).otherwise(F.array().cast("array<bigint>"))
    return F.transform(steps, lambda k: k * F.lit(step))


def plane_xy(lon, lat, lon0: float, lat0: float) -> tuple[Column, Column]:
    """Easting and northing in metres by the transverse Mercator projection (Krueger's series, to the fourth order of n).

    Degrees on GRS80, as in the geographic system that the plane systems start from; lon0, lat0: the system's origin.
    """
    n = GRS80_F / (2 - GRS80_F)
    scale = GRS80_A / (1 + n) * (1 + n**2 / 4 + n**4 / 64) * PLANE_SCALE
    alpha = (
        n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440,
        61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280,
    )
    e = 2 * math.sqrt(n) / (1 + n)
    s0 = math.sin(math.radians(lat0))
    xi0 = math.atan(math.sinh(math.atanh(s0) - e * math.atanh(e * s0)))
    start = xi0 + sum(a * math.sin(2 * j * xi0) for j, a in enumerate(alpha, 1))
    s, dl = F.sin(F.radians(_col(lat))), F.radians(_col(lon) - lon0)
    t = F.sinh(F.atanh(s) - e * F.atanh(e * s))
    xi, eta = F.atan2(t, F.cos(dl)), F.atanh(F.sin(dl) / F.sqrt(1 + t * t))
    north, east = xi, eta
    for j, a in enumerate(alpha, 1):
        north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
    return east * scale, (north - start) * scale


def plane_ring(ring, lon0: float, lat0: float) -> Column:
    """A ring of degrees (x: longitude, y: latitude) in metres of a plane system."""

    def corner(p: Column) -> Column:
        x, y = plane_xy(p["x"], p["y"], lon0, lat0)
        return F.struct(x.alias("x"), y.alias("y"))

    return F.transform(_col(ring), corner)
