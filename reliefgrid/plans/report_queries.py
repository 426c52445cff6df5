"""Registered queries of report texts and page lists: texts are made from the tables, so that SQL knows what has to come out."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.functions import formats, text
from reliefgrid.operators import reports
from reliefgrid.sources.storage import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _say(*parts) -> Column:
    return F.concat(*[F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts])


def _key() -> Column:
    return F.col("c_custkey")


def _reports(spark: SparkSession, sf: str) -> DataFrame:
    body = _say(
        "第1報 ２０２６年 8月 7日 １０：", (_key() % 50 + 10), "\n■水道(8/", (_key() % 9 + 1), "  9:30 時点)\n  八代市 約 ", (_key() % 900 + 1), ".", (_key() % 900 + 100), " ", (_key() % 77 + 1), "※ 8/3～ 断水 中 ・\n宇城市\t不明 ", (_key() % 5 + 1), ",", (_key() % 800 + 100),
        " 8/4～\n山鹿市 5 5 x\n八代市 1 1 y\n○給水車の派遣状況\n八代市 ", (_key() % 7 + 6), " ", (_key() % 3), " 2 1\n宇土市 ", (_key() % 4 + 1), "\n八代生活環境事務組合\n ", (_key() % 6), " 1 2\n 7\n甲佐町 3\n■下水道\n宇城市 9 9 9 9\n",
    )
    return table(spark, sf, "customer").select(_key().alias("report_id"), body.alias("text"))


def _names(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(x,) for x in ("八代市", "宇城市", "宇土市", "甲佐町")], "unit string")


@query("""SELECT c_custkey AS report_id, '八代市' AS unit, ((c_custkey % 900 + 1) * 1000 + c_custkey % 900 + 100)::DOUBLE AS most_households, (c_custkey % 77 + 1)::DOUBLE AS current_households, '8/3～' AS period, '断水 中' AS damage FROM customer
UNION ALL SELECT c_custkey, '宇城市', NULL, ((c_custkey % 5 + 1) * 1000 + c_custkey % 800 + 100)::DOUBLE, '8/4～', '' FROM customer""")
def report_outage_rows(spark, sf):
    return reports.outage_rows(_reports(spark, sf), _names(spark)).drop("raw_line")


@query("""SELECT c_custkey AS report_id, '八代市' AS unit, c_custkey % 7 + 6 AS total, c_custkey % 3 AS mlit, 2::BIGINT AS jwwa, 1::BIGINT AS sdf, 'complete' AS parse_status FROM customer
UNION ALL SELECT c_custkey, '宇土市', c_custkey % 4 + 1, NULL, NULL, NULL, 'total only' FROM customer UNION ALL SELECT c_custkey, '甲佐町', 3, NULL, NULL, NULL, 'total only' FROM customer
UNION ALL SELECT c_custkey, '八代環境事務組合', c_custkey % 6, 1, 2, 7, 'complete' FROM customer""")
def report_tanker_rows(spark, sf):
    return reports.tanker_rows(_reports(spark, sf), _names(spark))


@query("""SELECT c_custkey AS report_id, make_timestamp(2026, 8, 7, 1, c_custkey % 50 + 10, 0) AS report_time, make_timestamp(2026, 8, c_custkey % 9 + 1, 0, 30, 0) AS status_time, CASE WHEN c_custkey % 2 = 0 THEN make_timestamp(2026, 8, 7, 19, 0, 5) END AS local_time FROM customer""")
def report_times(spark, sf):
    d = _reports(spark, sf).withColumn("report_time", text.japanese_timestamp("text"))
    iso = F.when(F.col("report_id") % 2 == 0, "2026-08-07T10:00:05+00:00").otherwise("until superseded")
    ntz = lambda c: c.cast("timestamp_ntz")
    return d.select("report_id", ntz(F.col("report_time")).alias("report_time"), ntz(text.water_status_time("text", "report_time")).alias("status_time"), ntz(text.iso_local(iso, "Asia/Tokyo")).alias("local_time"))


@query("""SELECT s_suppkey AS report_id, s_suppkey % 40 + 1 AS shelter_number, '第' || s_suppkey || ' 小学校' AS shelter_name, '麦島' AS district, 1000 + s_suppkey % 500 AS capacity, s_suppkey % 20 AS households, s_suppkey % 60 AS people, 'available' AS water, 'partially available' AS electricity,
CASE s_suppkey % 2 WHEN 0 THEN 'unavailable' ELSE 'available' END AS air_conditioning, 4::BIGINT AS toilets, s_suppkey % 3 AS portable_toilets FROM supplier""")
def shelter_table_rows(spark, sf):
    k = F.col("s_suppkey")
    body = _say("番号 名称\n ", (k % 40 + 1), " 第", k, " 小学校 麦島 1,", F.lpad((k % 500).cast("string"), 3, "0"), " ", (k % 20), " ", (k % 60), " 〇 △ ", F.when(k % 2 == 0, "×").otherwise("○"), " 4 ", (k % 3), " \n1 短い 行\n")
    return reports.shelter_rows(table(spark, sf, "supplier").select(k.alias("report_id"), body.alias("text")))


def _chunks(spark: SparkSession, sf: str, *parts) -> DataFrame:
    return table(spark, sf, "customer").select(_key().alias("page_id"), F.posexplode(F.array(*[_say(*p) if isinstance(p, tuple) else F.lit(p) for p in parts])).alias("place", "chunk"))


@query("""SELECT c_custkey AS page_id, 4 AS place, '公園' || c_custkey AS name, lpad(c_custkey % 10 || '', 2, '0') || ':00' AS opening, '17:30' AS closing FROM customer
UNION ALL SELECT c_custkey, 8, '校庭', '09:15', '12:00' FROM customer""")
def page_points_by_time(spark, sf):
    c = _chunks(spark, sf, "・早い", (_key() % 10, "：00〜17:30"), "・閉", "場所（以下順不同）", ("・公園", _key()), "9:15-12:00", "・まだ", "場所（以下順不同） 次", "・校庭", "注意")
    return reports.points_by_time(c, "場所（以下順不同）")


@query("""SELECT c_custkey AS page_id, 4 AS place, '会館' || c_custkey AS name FROM customer UNION ALL SELECT c_custkey, 8, '広場' FROM customer""")
def page_names_between(spark, sf):
    c = _chunks(spark, sf, "場所", "給水について", "日時", "場所", ("・会館", _key()), "※ 注", "日付", "断水が解消 した所", "•広場", "留意事項", "・後")
    return reports.names_between(c, "給水について", "場所", "留意事項", ["場所", "留意事項", "日時", "日付", "時間"], ["断水が解消"])


@query("""SELECT c_custkey AS page_id, unnest(['役場', '公民館' || c_custkey]) AS name, '08:30' AS opening, '19:00' AS closing FROM customer WHERE 4 + c_custkey % 30 < 1 + 25""")
def page_listed_places(spark, sf):
    """The list stands up to 29 chunks after the marker: pages on which it stands beyond the window have no names."""
    fill = F.array_repeat(F.lit("・"), (_key() % 30).cast("int"))
    body = F.concat(F.array(F.lit("前"), F.lit("給水車による応急給水について"), F.lit("8:30～19:00"), F.lit("9:00～10:00")), fill, F.array(_say("場所：役場、 公民館", _key(), " ,")))
    c = table(spark, sf, "customer").select(_key().alias("page_id"), F.posexplode(body).alias("place", "chunk"))
    return reports.listed_places(c, "給水車による応急給水について")


# rows of which the blanks are line ends, by the key: on one line, on two, on three with an empty one


def _wrapped(spark: SparkSession, sf: str) -> DataFrame:
    gap = F.when(_key() % 3 == 0, " ").when(_key() % 3 == 1, "\n  ").otherwise("\n\n ")
    body = _say(
        "■水道\n宇城市 順調\n八代市", gap, (_key() % 900 + 1), gap, (_key() % 77 + 1), gap, "8/3～ 断水 中 ・\n 宇城市 不明", gap, (_key() % 50 + 1), "※ 8/4～\n甲佐町 5\n宇土市", gap, "約 ", (_key() % 90 + 1), ",000 7 8/5～ 復旧\n",
        "○給水車の派遣状況\n八代市 6", gap, (_key() % 3), " 2", gap, "1\n 宇土市", gap, (_key() % 4 + 1), " 9\n宇城市 なし\n宇城市", gap, (_key() % 8 + 1), "\n■下水道\n",
    )
    return stored(table(spark, sf, "customer").select(_key().alias("report_id"), body.alias("text")))  # or the text's making is repeated in all that reads it


@query("""SELECT c_custkey AS report_id, '八代市' AS unit, (c_custkey % 900 + 1)::DOUBLE AS most_households, (c_custkey % 77 + 1)::DOUBLE AS current_households, '8/3～' AS period, '断水 中' AS damage, '八代市 ' || (c_custkey % 900 + 1) || ' ' || (c_custkey % 77 + 1) || ' 8/3～ 断水 中 ・' AS raw_line FROM customer
UNION ALL SELECT c_custkey, '宇城市', NULL, (c_custkey % 50 + 1)::DOUBLE, '8/4～', '', '宇城市 不明 ' || (c_custkey % 50 + 1) || '※ 8/4～' FROM customer
UNION ALL SELECT c_custkey, '宇土市', ((c_custkey % 90 + 1) * 1000)::DOUBLE, 7, '8/5～', '復旧', '宇土市 約 ' || (c_custkey % 90 + 1) || ',000 7 8/5～ 復旧' FROM customer""")
def wrapped_outage_rows(spark, sf):
    return reports.outage_rows(_wrapped(spark, sf), _names(spark))


@query("""SELECT c_custkey AS report_id, '八代市' AS unit, 6::BIGINT AS total, c_custkey % 3 AS mlit, 2::BIGINT AS jwwa, 1::BIGINT AS sdf, 'complete' AS parse_status FROM customer
UNION ALL SELECT c_custkey, '宇土市', c_custkey % 4 + 1, NULL, NULL, NULL, 'total only' FROM customer UNION ALL SELECT c_custkey, '宇城市', c_custkey % 8 + 1, NULL, NULL, NULL, 'total only' FROM customer""")
def wrapped_tanker_rows(spark, sf):
    return reports.tanker_rows(_wrapped(spark, sf), _names(spark))


@query("""SELECT c_custkey AS report_id, i AS shelter_number, '第' || i || ' 小学校' AS shelter_name, '麦島' AS district, 1000 + c_custkey % 500 AS capacity, c_custkey % 20 AS households, i AS people, 'available' AS water, 'partially available' AS electricity, 'unavailable' AS air_conditioning, 4::BIGINT AS toilets, c_custkey % 3 AS portable_toilets
FROM customer, (SELECT unnest([1, 2, 3]::BIGINT[]) AS i)""")
def wrapped_shelter_rows(spark, sf):
    gap = F.when(_key() % 3 == 0, " ").when(_key() % 3 == 1, "\n  ").otherwise(" \n")
    row = lambda i, g: [f" {i}", g, f"第{i} 小学校 麦島", g, "1,", F.lpad((_key() % 500).cast("string"), 3, "0"), " ", (_key() % 20), g, f"{i} 〇 △", g, "× 4 ", (_key() % 3), "\n"]
    body = _say("番号 名称\n", *row(1, F.lit(" ")), *row(2, gap), *row(3, gap), "短い 行\n")
    return reports.shelter_rows(table(spark, sf, "customer").select(_key().alias("report_id"), body.alias("text")))


@query("""SELECT s_suppkey AS page_id, 'https://host.example/a/r' || s_suppkey || '.pdf' AS url, 'report_' || lpad((s_suppkey % 30 + 1) || '', 2, '0') AS link_id FROM supplier
UNION ALL SELECT s_suppkey, 'https://host.example/x/' || s_suppkey || '.PDF', 'report_01' FROM supplier""")
def page_report_links(spark, sf):
    k = F.col("s_suppkey")
    link = lambda href, label: F.struct(href.alias("href"), label.alias("label"))
    a = F.array(link(_say("r", k, ".pdf"), _say("被害状況 第", (k % 30 + 1), "報")), link(_say("r", k, ".pdf"), _say("被害状況 第 ", (k % 30 + 1), " 報")), link(_say("/x/", k, ".PDF"), F.lit("被害状況")), link(F.lit("other.pdf"), F.lit("気象")), link(F.lit("a.html"), F.lit("被害状況")))
    d = table(spark, sf, "supplier").select(k.alias("page_id"), F.lit("https://host.example/a/index.html").alias("base"), F.inline(a))
    return reports.report_links(d, "被害状況")


@query("""SELECT p_partkey, 'コミュニティセンター' || p_partkey AS full_name, '第一小学校' || p_size AS hall, 'コミュニティセンター' || p_partkey AS short_name, '松高小学校' AS no_town, CASE WHEN p_partkey % 4 > 0 THEN '国道' || p_partkey || '号' END AS route,
CASE p_partkey % 4 WHEN 0 THEN 'available' WHEN 1 THEN 'partially available' WHEN 2 THEN 'unavailable' END AS state, CASE p_partkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS detour, p_partkey % 2 = 0 AS matched,
'a b c' AS blanks, p_partkey % 5 = 0 AS japanese, CASE p_partkey % 2 WHEN 0 THEN 'station' ELSE 'hydrant' END AS kind, CASE WHEN p_partkey % 6 > 0 THEN p_partkey % 6 * 60.0::DOUBLE + 30 END AS minutes, (p_partkey % 50 + 0.5)::DOUBLE AS people FROM part""")
def normalised_values(spark, sf):
    k = F.col("p_partkey")
    pick = lambda n, *x: F.get(F.array(*[F.lit(v) for v in x]), (k % n).cast("int"))
    hour = lambda h: _say(h, ":30")
    return table(spark, sf, "part").select(
        "p_partkey", text.facility_name(_say("コミセン（", k, "）")).alias("full_name"), text.facility_name(_say("第一 小学校体育館・", F.col("p_size"))).alias("hall"), text.facility_name_short(_say("ｺﾐｾﾝ ", k)).alias("short_name"),
        text.without_prefix(F.lit("八代市立 松高小学校体育館"), "八代市立").alias("no_town"), text.route_name(F.when(k % 4 > 0, _say("国道 （", k, "）・号")).otherwise(" 　")).alias("route"),
        reports.recode(pick(4, " ○", "△", "× ", "?"), reports.SYMBOLS).alias("state"), reports.recode(pick(3, "有 ", "無", "-"), reports.YES_NO).alias("detour"), reports.has_prefix(F.when(k % 2 == 0, "matched_primary"), "matched").alias("matched"),
        text.collapse(F.lit(" a \n b\t c ")).alias("blanks"), text.has_japanese(F.when(k % 5 == 0, "x水").otherwise("x")).alias("japanese"), formats.translate_exact(pick(2, "消防署", "消火栓"), {"消防署": "station", "消火栓": "hydrant"}).alias("kind"),
        text.minutes_between(F.lit("08:00"), hour(F.lit(8) + k % 6)).alias("m"), text.household_count(_say("約 ", (k % 50), ".5 人")).alias("people"),
    ).withColumn("minutes", F.when(F.col("p_partkey") % 6 > 0, F.col("m").cast("double"))).drop("m")


HOST = "regexp_extract(url, '^https?://[^/?#]+')"


@query(f"""WITH a AS (SELECT page_id, {HOST} AS host, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 1)) AS href, unnest(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>', 2)) AS label,
unnest(range(0, len(regexp_extract_all(html, '<a href="([^"]*)">([^<]*)</a>'))))::INT AS place FROM pages) SELECT page_id, place, host || href AS url, label FROM a""")
def page_anchors(spark, sf):
    return reports.page_links(table(spark, sf, "pages"))


@query(f"""SELECT page_id, 'ministry_report_' || lpad((page_id % 120 + 1) || '', CASE WHEN page_id % 120 < 99 THEN 2 ELSE 3 END, '0') AS report_id, 'ministry_reports/report_' || lpad((page_id % 120 + 1) || '', CASE WHEN page_id % 120 < 99 THEN 2 ELSE 3 END, '0') || '.pdf' AS relative_path,
{HOST} || '/docs/r' || page_id || '.pdf?v=1' AS url, '災害 被害状況等について 第 ' || (page_id % 120 + 1) || ' 報' AS label FROM pages
UNION ALL SELECT page_id, 'ministry_report_01', 'ministry_reports/report_01.pdf', regexp_extract(url, '^https?://[^?#]*/') || 'x.PDF', '熊本県熊本地方を震源 & 地震' FROM pages WHERE page_id % 3 = 0""")
def linked_reports(spark, sf):
    """Each page's own links, and reports linked at its end."""
    k = F.col("page_id")
    more = _say('<p><a href="/docs/r', k, '.pdf?v=1"><b>災害\n 被害状況等について</b> 第 ', (k % 120 + 1), ' 報</a> <a href="/docs/r', k, '.pdf?v=1">被害状況等について 第7報</a><a href="/docs/r.pdf">気象</a><a href="/docs/r.html?a.pdf">被害状況等について</a><a>被害状況等について</a>')
    other = F.when(k % 3 == 0, '<A HREF="x.PDF">熊本県熊本地方を震源 &amp; 地震</A>').otherwise("")
    pages = table(spark, sf, "pages").withColumn("html", F.concat("html", more, other))
    return reports.linked_reports(reports.page_links(pages), ["被害状況等について", "熊本県熊本地方を震源"], "ministry")
