"""Text parsing for incident reports, and the names of facilities."""

from __future__ import annotations

import unicodedata
from html.parser import HTMLParser
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, StringType, StructField, StructType

from reliefgrid.functions.nulls import _col

# What the names of facilities are brought to, in this order.
FACILITY_RULES = (("コミセン", "コミュニティセンター"), ("小学校体育館", "小学校"), ("中学校体育館", "中学校"))
# Fixed input formats of reports: opening hours, report times, status times of the water section.
TIME_RANGE = r"(\d{1,2}):(\d{2})\s*[~〜～-]\s*(\d{1,2}):(\d{2})"
REPORT_TIME = r"(\d{4})年\s*(\d{1,2})月\s*(\d{1,2})日\s*(\d{1,2}):(\d{2})"
WATER_TIME = r"■水道\((\d{1,2})/(\d{1,2})\s+(\d{1,2}):(\d{2})\s*時点\)"


@pandas_udf(StringType())
def nfkc(s: pd.Series) -> pd.Series:
    return s.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x))


def facility_name(c, halls: bool = True) -> Column:
    """NFKC, no blanks, dots and brackets, long names for short ones; null becomes empty. Without halls only the first rule."""
    c = F.regexp_replace(nfkc(F.coalesce(_col(c), F.lit(""))), r"[\s　・･()（）]", "")
    for old, new in FACILITY_RULES if halls else FACILITY_RULES[:1]:
        c = F.replace(c, F.lit(old), F.lit(new))
    return c


def facility_name_short(c) -> Column:
    """NFKC, no blanks, dots and brackets, and the first rule only; null stays null."""
    c = F.regexp_replace(nfkc(_col(c)), r"[\s　・･()（）]", "")
    return F.replace(c, F.lit(FACILITY_RULES[0][0]), F.lit(FACILITY_RULES[0][1]))


def without_prefix(c, prefix: str) -> Column:
    """A facility's full name without the name of its town in front, if it stands there."""
    c = facility_name(c)
    return F.when(c.startswith(prefix), F.substring(c, F.lit(len(prefix) + 1), F.length(c))).otherwise(c)


def route_name(c) -> Column:
    """NFKC, no blanks, dots and brackets; a blank name is null."""
    c = _col(c)
    return F.when(F.trim(F.regexp_replace(c, r"[\s　]+", "")) != "", F.regexp_replace(nfkc(c), r"[\s　・･()（）]", ""))


def time_range(c) -> tuple[Column, Column]:
    """Opening and closing time, HH:MM, of a text such as 8:30~17:00, full-width ones too; null if there is none."""
    c = nfkc(_col(c))
    part = lambda k: F.nullif(F.regexp_extract(c, TIME_RANGE, k), F.lit(""))
    return tuple(F.concat(F.lpad(part(k), 2, "0"), F.lit(":"), part(k + 1)) for k in (1, 3))


def minutes_between(opening, closing) -> Column:
    """Minutes from one HH:MM to another, null unless positive."""
    at = lambda c: F.split_part(_col(c), F.lit(":"), F.lit(1)).try_cast("int") * 60 + F.split_part(_col(c), F.lit(":"), F.lit(2)).try_cast("int")
    m = at(closing) - at(opening)
    return F.when(m > 0, m)


def household_count(c) -> Column:
    """The count in a text, as a double: a dot before three digits at the end, like a comma, divides thousands."""
    bare = F.regexp_replace(nfkc(_col(c)), r"[^0-9.,]", "")
    return F.when(bare.rlike(r"^\d{1,3}\.\d{3}$"), F.replace(bare, F.lit("."), F.lit(""))).otherwise(F.replace(bare, F.lit(","), F.lit(""))).try_cast("double")


def _time_parts(c: Column, pattern: str, n: int) -> list[Column]:
    return [F.nullif(F.regexp_extract(c, pattern, k), F.lit("")).cast("int") for k in range(1, n + 1)]


def japanese_timestamp(c) -> Column:
    """A report's time in Japan, brought to UTC; blanks and full-width digits don't matter."""
    return F.to_utc_timestamp(F.make_timestamp(*_time_parts(nfkc(_col(c)), REPORT_TIME, 5), F.lit(0)), "Asia/Tokyo")


def water_status_time(c, reported) -> Column:
    """When the water section of a report was written (month/day hour:minute, of the report's year, in Japan), in UTC; if it
    doesn't say, the report's time."""
    month, day, hour, minute = _time_parts(_col(c), WATER_TIME, 4)
    year = F.year(F.from_utc_timestamp(_col(reported), "Asia/Tokyo"))
    return F.coalesce(F.to_utc_timestamp(F.make_timestamp(year, month, day, hour, minute, F.lit(0)), "Asia/Tokyo"), _col(reported))


def iso_local(c, zone: str) -> Column:
    """A timestamp with offset as local time of the zone; null if it isn't one."""
    return F.from_utc_timestamp(_col(c).try_cast("timestamp"), zone)


def collapse(c) -> Column:
    return F.trim(F.regexp_replace(_col(c), r"\s+", " "))


def has_japanese(c) -> Column:
    return _col(c).rlike("[぀-ヿ㐀-鿿]")


class _Text(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.found: list[str] = []

    def handle_data(self, data: str) -> None:
        if data := " ".join(data.split()):
            self.found.append(data)


@pandas_udf(ArrayType(StringType()))
def html_chunks(s: pd.Series) -> pd.Series:
    """The texts between tags, blanks collapsed, empty ones left out, in the document's order."""

    def parse(x):
        p = _Text()
        p.feed(x or "")
        p.close()
        return p.found

    return s.map(parse)


class _Anchors(HTMLParser):
    """Links and their texts. A link without an end before the next one begins, or before the page ends, is none."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.open: tuple[str, list[str]] | None = None
        self.found: list[tuple[str, str]] = []

    def handle_starttag(self, tag, attrs):
        if tag == "a":
            href = dict(attrs).get("href")
            self.open = None if href is None else (href, [])

    def handle_data(self, data):
        if self.open:
            self.open[1].append(data)

    def handle_endtag(self, tag):
        if tag == "a" and self.open:
            self.found.append((self.open[0], " ".join(" ".join(self.open[1]).split())))
            self.open = None


@pandas_udf(ArrayType(StructType([StructField("url", StringType()), StructField("label", StringType())])))
def html_anchors(html: pd.Series, base: pd.Series) -> pd.Series:
    """The links of a page in its order: absolute by the page's address (a page without one: as they stand), texts with blanks
    collapsed. An address that can't be joined (brackets of a bad host) is left out; a page without HTML has no links."""

    def parse(x, at):
        p, out = _Anchors(), []
        p.feed(x or "")
        p.close()
        for href, label in p.found:
            try:
                out.append({"url": urljoin(at or "", href), "label": label})
            except ValueError:
                continue
        return out

    return pd.Series([parse(x, at) for x, at in zip(html, base, strict=True)])


def forward_fill(df: DataFrame, keys: list[str], order: list[str], value: str, out: str) -> DataFrame:
    """The last value that isn't null, up to and with each row: a scanner's state as a window."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn(out, F.last(value, ignorenulls=True).over(w))
