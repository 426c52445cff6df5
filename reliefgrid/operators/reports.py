"""Rows out of incident reports: sections between markers, their lines, and lists of places in web pages.

Reports are (report_id, text), one row an id; pages are chunks (page_id, place, chunk) in the order of `place`. All work is done by
built-in string functions. A row of a table starts on a line of its own, but blanks between its values may be line ends: where
rows start is found line by line, by joining the lines' first words with the names of municipalities (a table); what a row says is
read from there on.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.functions.text import collapse, household_count, html_anchors, time_range
from reliefgrid.operators.keys import top_by

# Fixed input formats: markers of sections, and lines of the outage, tanker and shelter tables.
WATER, TANKERS, SEWAGE = "■水道", "○給水車の派遣状況", "■下水道"
OUTAGE_ROW = r"(?md)\A\s*(\S+)\s+(約\s*[\d,.]+|[\d,.]+|不明)\s+(約\s*[\d,.]+|[\d,.]+※?|不明)\s+(\S+)(.*)$"
TANKER_ROW = r"(?md)\A\s*(\S+)\s+([0-9\s]+)$"
JOINT_OPERATOR = r"(?s)八代(?:生活)?環境事務組合.{0,260}?(?:甲佐町|宇城市)"
SHELTER_ROW = r"(?md)^\s*(\d+)\s+(.+?)\s+(\S+)\s+([\d,]+)\s+(\d+)\s+(\d+)\s+([○〇△×])\s+([○〇△×])\s+([○〇△×])\s+(\d+)\s+(\d+)\s*$"
# What the symbols of a shelter table stand for.
SYMBOLS = {"○": "available", "△": "partially available", "×": "unavailable"}
YES_NO = {"有": True, "無": False}


def recode(c: Column, values: dict) -> Column:
    """The listed meaning of a value, blanks around it left out; null for what isn't listed."""
    return F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[F.trim(c)]


def section(text: Column, start: str, *ends: str) -> Column:
    """The text from the first `start` up to the first of the ends that follows, asked in their order; null without a start."""
    begin = F.locate(start, text)
    tail = F.when(begin > 0, F.substring(text, begin, F.length(text)))
    cuts = [F.nullif(F.locate(e, tail, len(start) + 1), F.lit(0)) for e in ends]
    return F.left(tail, F.coalesce(*cuts, F.length(tail) + 1) - 1)


def _named(reports: DataFrame, text: Column, pattern: str, names: DataFrame) -> DataFrame:
    """report_id, unit, row: of each report and name (names: unit) the text of the first row that starts with the name, as the first word
    of its line, and fits the pattern from there on. The pattern's first group is the name."""
    lines = reports.select("report_id", F.split(text, "\n").alias("lines_")).where(F.col("lines_").isNotNull())
    starts = lines.select("report_id", F.posexplode("lines_").alias("line_no", "line"))
    starts = starts.select("report_id", "line_no", F.regexp_extract("line", r"^\s*(\S+)", 1).alias("unit")).join(names.select("unit").distinct(), "unit", "left_semi")
    rest = F.array_join(F.slice("lines_", F.col("line_no") + 1, F.size("lines_")), "\n")
    row = F.regexp_extract(rest, pattern, 0)
    found = starts.join(lines, "report_id").select("report_id", "unit", "line_no", row.alias("row")).where("row <> ''")
    return top_by(found, ["report_id", "unit"], ["line_no"])


def outage_rows(reports: DataFrame, names: DataFrame) -> DataFrame:
    """report_id, unit, most and current outage households, period, damage, raw line: the municipalities of the water section."""
    rows = _named(reports, section(F.col("text"), WATER, TANKERS, SEWAGE), OUTAGE_ROW, names)
    part = lambda k: F.regexp_extract("row", OUTAGE_ROW, k)
    return rows.select("report_id", "unit", household_count(part(2)).alias("most_households"), household_count(part(3)).alias("current_households"), part(4).alias("period"), F.btrim(part(5), F.lit(" ・")).alias("damage"), collapse("row").alias("raw_line"))


def tanker_rows(reports: DataFrame, names: DataFrame, joint: str = "八代環境事務組合") -> DataFrame:
    """report_id, unit, total, mlit, jwwa, sdf, parse_status: four numbers are complete, else the first is the total; the joint
    operator's block, whose numbers stand on lines of their own, is a unit named `joint`."""
    text = section(F.col("text"), TANKERS[1:], SEWAGE)
    numbers = lambda c: F.transform(F.regexp_extract_all(c, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("long"))
    rows = _named(reports, text, TANKER_ROW, names).withColumn("n", numbers(F.regexp_extract("row", TANKER_ROW, 2)))
    full = F.size("n") == 4
    one = rows.select("report_id", "unit", F.get("n", F.lit(0)).alias("total"), *[F.when(full, F.get("n", F.lit(k))).alias(c) for k, c in ((1, "mlit"), (2, "jwwa"), (3, "sdf"))], F.when(full, "complete").when(F.size("n") > 0, "total only").otherwise("unparsed").alias("parse_status"))
    block = reports.select("report_id", F.regexp_extract(text, JOINT_OPERATOR, 0).alias("block"))
    block = block.withColumn("by_line", F.filter(F.transform(F.split("block", "\n"), numbers), lambda n: F.size(n) > 0))
    main, single = F.filter("by_line", lambda n: F.size(n) >= 3), F.filter("by_line", lambda n: F.size(n) == 1)
    block = block.withColumn("main", F.get(main, F.lit(0))).withColumn("single", F.get(F.get(single, F.lit(0)), F.lit(0))).where("main IS NOT NULL")
    both = block.select("report_id", F.lit(joint).alias("unit"), *[F.get("main", F.lit(k)).alias(c) for k, c in ((0, "total"), (1, "mlit"), (2, "jwwa"))], F.col("single").alias("sdf"), F.when(F.col("single").isNotNull(), "complete").otherwise("partial").alias("parse_status"))
    return one.unionByName(both)


def shelter_rows(reports: DataFrame) -> DataFrame:
    """report_id and the columns of each row of a shelter table, symbols as their meaning."""
    rows = reports.select("report_id", F.explode(F.regexp_extract_all("text", F.lit(SHELTER_ROW), F.lit(0))).alias("row"))
    part = lambda k: F.regexp_extract("row", SHELTER_ROW, k)
    number = lambda k: F.replace(part(k), F.lit(","), F.lit("")).cast("long")
    state = lambda k: recode(F.replace(part(k), F.lit("〇"), F.lit("○")), SYMBOLS)
    return rows.select("report_id", number(1).alias("shelter_number"), F.trim(part(2)).alias("shelter_name"), part(3).alias("district"), number(4).alias("capacity"), number(5).alias("households"), number(6).alias("people"), state(7).alias("water"), state(8).alias("electricity"), state(9).alias("air_conditioning"), number(10).alias("toilets"), number(11).alias("portable_toilets"))


def _bounds(chunks: DataFrame, start: Column, end: Column | None, most: int | None = None) -> DataFrame:
    """The chunks of each page from the first that fits `start` (not itself), up to the first later one that fits `end`, or `most`
    chunks with the first."""
    w = Window.partitionBy("page_id")
    d = chunks.withColumn("begin_", F.min(F.when(start, F.col("place"))).over(w)).where("place >= begin_")
    if most is not None:
        return d.where(F.col("place") < F.col("begin_") + most).drop("begin_")
    d = d.withColumn("end_", F.min(F.when(end & (F.col("place") > F.col("begin_")), F.col("place"))).over(w))
    return d.where("place > begin_ AND place < end_").drop("begin_", "end_")


def points_by_time(chunks: DataFrame, gate: str, bullet: str = "・") -> DataFrame:
    """page_id, place, name, opening, closing: bulleted places under the last time range, once a chunk with the gate's text has
    followed that range; a new range shuts the gate."""
    opening, closing = time_range("chunk")
    d = chunks.withColumn("range_", F.when(opening.isNotNull(), F.struct(opening.alias("opening"), closing.alias("closing"), F.col("place").alias("at"))))
    up_to = Window.partitionBy("page_id").orderBy("place").rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("now", F.last("range_", ignorenulls=True).over(up_to)).withColumn("gate_", F.max(F.when(F.contains("chunk", F.lit(gate)), F.col("place"))).over(up_to))
    rows = d.where(F.col("range_").isNull() & F.col("chunk").startswith(bullet) & (F.col("gate_") > F.col("now.at")))
    return rows.select("page_id", "place", F.trim(F.regexp_replace("chunk", f"^{bullet}+", "")).alias("name"), F.col("now.opening").alias("opening"), F.col("now.closing").alias("closing"))


def names_between(chunks: DataFrame, opener: str, start: str, end: str, excluded: list[str], tokens: list[str]) -> DataFrame:
    """page_id, place, name: chunks after the first `start` that follows `opener`, up to `end`; bullets are stripped, excluded
    chunks, notes (※) and chunks with one of the tokens left out."""
    w = Window.partitionBy("page_id")
    opened = chunks.withColumn("open_", F.min(F.when(F.col("chunk") == opener, F.col("place"))).over(w)).where("place >= open_").drop("open_")
    rows = _bounds(opened, F.col("chunk") == start, F.col("chunk") == end)
    rows = rows.withColumn("name", F.trim(F.regexp_replace("chunk", "^[・•]+", "")))
    return without_tokens(rows.where((F.col("name") != "") & ~F.col("name").isin(excluded) & ~has_prefix(F.col("name"), "※")), "name", tokens).select("page_id", "place", "name")


def listed_places(chunks: DataFrame, marker: str, most: int = 25) -> DataFrame:
    """page_id, name, opening, closing: the places on the line that starts with 場所: among the `most` chunks from the marker on,
    with the first time range there."""
    rows = _bounds(chunks, F.col("chunk") == marker, None, most)
    opening, closing = time_range("chunk")
    line = F.regexp_extract("chunk", r"^場所[:：]\s*(.*)$", 1)
    one = rows.groupBy("page_id").agg(F.min_by(F.struct(opening.alias("opening"), closing.alias("closing")), F.when(opening.isNotNull(), F.col("place"))).alias("range"), F.min_by(line, F.when(F.col("chunk").rlike("^場所[:：]"), F.col("place"))).alias("line"))
    names = F.filter(F.transform(F.split("line", "[、,]"), lambda x: F.trim(x)), lambda x: x != "")
    return one.select("page_id", F.explode(names).alias("name"), F.col("range.opening").alias("opening"), F.col("range.closing").alias("closing"))


def has_prefix(c: Column, prefix: str) -> Column:
    """Whether a text starts with the prefix; false for null."""
    return F.coalesce(c.startswith(prefix), F.lit(False))


def without_tokens(df: DataFrame, c: str, tokens: list[str]) -> DataFrame:
    """df without the rows whose text has one of the tokens; rows without a text stay."""
    if not tokens:
        return df
    found = F.exists(F.array(*[F.lit(x) for x in tokens]), lambda x: F.contains(F.col(c), x))
    return df.where(~F.coalesce(found, F.lit(False)))


def report_links(anchors: DataFrame, keyword: str) -> DataFrame:
    """page_id, url, link_id: the absolute links (page_id, base, href, label) to PDF files whose label or address has the keyword,
    each once, with the report's number (第n報) from the label or 1."""
    base = F.regexp_extract("base", r"^(https?://[^/]+)", 1)
    folder = F.regexp_replace("base", r"[^/]*$", "")
    url = F.when(F.col("href").rlike("^https?://"), F.col("href")).when(F.col("href").startswith("/"), F.concat(base, F.col("href"))).otherwise(F.concat(folder, F.col("href")))
    d = anchors.withColumn("url", url).where(F.lower("url").endswith(".pdf") & (F.contains("label", F.lit(keyword)) | F.contains("url", F.lit(keyword))))
    number = F.coalesce(F.nullif(F.regexp_extract("label", r"第\s*(\d+)\s*報", 1), F.lit("")).cast("int"), F.lit(1))
    return d.groupBy("page_id", "url").agg(F.min(number).alias("number")).select("page_id", "url", F.format_string("report_%02d", F.col("number")).alias("link_id"))


def page_links(pages: DataFrame) -> DataFrame:
    """page_id, place, url, label: the links of pages (page_id, url, html), numbered from 0 in each page's order. A page is parsed whole
    in one task."""
    return pages.select("page_id", F.posexplode(html_anchors("html", "url")).alias("place", "x")).select("page_id", "place", "x.url", "x.label")


def linked_reports(links: DataFrame, keywords: list[str], prefix: str) -> DataFrame:
    """page_id, report_id, relative_path, url, label: of `page_links` those to PDF files (by the address's path) whose text has one of the
    keywords, a page's address once: its first such link. A report's number is that of its text (第n報), of two digits at least, or
    1; two addresses may have one number, and both stay."""
    path = F.regexp_extract("url", r"^(?:[A-Za-z][A-Za-z0-9+.-]*:)?(?://[^/?#]*)?([^?#;]*)", 1)
    fits = F.exists(F.array(*[F.lit(k) for k in keywords]), lambda k: F.contains(F.col("label"), k)) if keywords else F.lit(False)
    one = top_by(links.where(F.lower(path).endswith(".pdf") & fits), ["page_id", "url"], [F.asc("place")])
    digits = F.translate(F.regexp_extract("label", r"(?U)第\s*([0-9０-９]+)\s*報", 1), "０１２３４５６７８９", "0123456789")
    number = F.coalesce(F.nullif(digits, F.lit("")).try_cast("long"), F.lit(1))
    stem = F.concat(F.lit("report_"), F.when(number < 10, F.concat(F.lit("0"), number.cast("string"))).otherwise(number.cast("string")))
    return one.select("page_id", F.concat(F.lit(f"{prefix}_"), stem).alias("report_id"), F.concat(F.lit(f"{prefix}_reports/"), stem, F.lit(".pdf")).alias("relative_path"), "url", "label")
