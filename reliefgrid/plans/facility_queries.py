"""Registered queries of facilities, matching and formats. Vectors' first components stand for plane coordinates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.functions import formats, projections
from reliefgrid.operators import facilities, linkage, matching, polygons, polylines
from reliefgrid.sources.storage import spread, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


def _vectors(spark: SparkSession, sf: str) -> DataFrame:
    e = lambda k, m: F.element_at("embedding", k).cast("double") * m
    return table(spark, sf, "embeddings").select("vec_id", "label", *[e(k, m).alias(f"e{k}_{m}") for k in (1, 2, 3, 4) for m in (1000, 4000)])


V = "v AS (SELECT vec_id, label, " + ", ".join(f"embedding[{k}]::DOUBLE * {m} AS e{k}_{m}" for k in (1, 2, 3, 4) for m in (1000, 4000)) + " FROM embeddings)"


# --- restrictions and edges


def _sql_to_segment(x: str, y: str, s: str) -> str:
    dx, dy = f"({s}.bx - {s}.ax)", f"({s}.by - {s}.ay)"
    t = f"greatest(0, least(1, coalesce((({x} - {s}.ax) * {dx} + ({y} - {s}.ay) * {dy}) / nullif({dx} * {dx} + {dy} * {dy}, 0), 0)))"
    return f"sqrt(({x} - ({s}.ax + {t} * {dx})) ** 2 + ({y} - ({s}.ay + {t} * {dy})) ** 2)"


def _sql_side(s: str, x: str, y: str) -> str:
    return f"(({s}.bx - {s}.ax) * ({y} - {s}.ay) - ({s}.by - {s}.ay) * ({x} - {s}.ax))"


DISTANCE = f"""CASE WHEN {_sql_side('o', 'e.ax', 'e.ay')} * {_sql_side('o', 'e.bx', 'e.by')} < 0 AND {_sql_side('e', 'o.ax', 'o.ay')} * {_sql_side('e', 'o.bx', 'o.by')} < 0 THEN 0
ELSE least({_sql_to_segment('e.ax', 'e.ay', 'o')}, {_sql_to_segment('e.bx', 'e.by', 'o')}, {_sql_to_segment('o.ax', 'o.ay', 'e')}, {_sql_to_segment('o.bx', 'o.by', 'e')}) END"""
LINES = """o AS (SELECT vec_id AS oid, vec_id % 2 = 0 AS is_point, nullif(label, 3) AS route, e3_4000 AS ax, e4_4000 AS ay,
  e3_4000 + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE vec_id * 29 % 83 END AS bx, e4_4000 + CASE WHEN vec_id % 2 = 0 THEN 0 ELSE vec_id * 31 % 89 END AS by FROM v),
e AS (SELECT vec_id AS edge_id, nullif(label, 4) AS route, e1_4000 AS ax, e2_4000 AS ay, e1_4000 + vec_id * 37 % 101 - 50 AS bx, e2_4000 + vec_id * 53 % 97 - 48 AS by FROM v)"""


def _lines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    v = _vectors(spark, sf)
    point = F.col("vec_id") % 2 == 0
    step = lambda a, b: F.when(point, 0).otherwise(F.col("vec_id") * a % b)
    o = v.select(F.col("vec_id").alias("oid"), point.alias("is_point"), F.nullif("label", F.lit(3)).alias("route"), F.col("e3_4000").alias("ax"), F.col("e4_4000").alias("ay"), (F.col("e3_4000") + step(29, 83)).alias("bx"), (F.col("e4_4000") + step(31, 89)).alias("by"))
    e = v.select(F.col("vec_id").alias("edge_id"), F.nullif("label", F.lit(4)).alias("route"), F.col("e1_4000").alias("ax"), F.col("e2_4000").alias("ay"), (F.col("e1_4000") + F.col("vec_id") * 37 % 101 - 50).alias("bx"), (F.col("e2_4000") + F.col("vec_id") * 53 % 97 - 48).alias("by"))
    return o, e


@query(f"""WITH {V}, {LINES}, c AS (SELECT oid, is_point, o.route AS ro, edge_id, e.route AS re, {DISTANCE} AS d FROM o, e),
n AS (SELECT *, d <= CASE WHEN is_point THEN 100 ELSE 50 END AS pri FROM c WHERE d <= 250),
m AS (SELECT *, count(*) FILTER (WHERE pri) OVER w AS np, count(*) OVER w AS na, row_number() OVER (PARTITION BY oid ORDER BY d, edge_id) AS k FROM n WINDOW w AS (PARTITION BY oid)),
s AS (SELECT * FROM m WHERE CASE WHEN np > 0 THEN pri ELSE k = 1 END)
SELECT o.oid, edge_id, round(d, 4) AS distance, ro = re AS route_agreement, CASE WHEN edge_id IS NULL THEN 0 WHEN np > 0 THEN np ELSE na END::BIGINT AS candidates,
CASE WHEN edge_id IS NULL THEN 'none' WHEN np = 0 THEN 'nearest_edge_250m_fallback' WHEN o.is_point THEN 'point_nearest_100m' ELSE 'line_buffer_50m' END AS method,
CASE WHEN edge_id IS NULL THEN 'unmatched' WHEN np > 0 THEN 'matched_primary' ELSE 'matched_fallback' END AS status FROM o LEFT JOIN s USING (oid)""")
def restriction_edge_match(spark, sf):
    return matching.match_restrictions(*_lines(spark, sf)).withColumn("distance", F.round("distance", 4))


# lines of several segments: the lines of an order in turn are the places of a road; restrictions are points, lines and lines of two parts
ROAD_X, ROAD_Y = "(l_orderkey % 173) * 40.137::DOUBLE", "(l_orderkey % 191) * 40.291::DOUBLE"
POLYLINES = f"""places AS (SELECT l_orderkey AS edge_id, l_linenumber AS k, {ROAD_X} + sum(floor(l_quantity) - 20) OVER w AS x, {ROAD_Y} + sum(l_linenumber * 7 + l_partkey % 23 - 20) OVER w AS y
  FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber)),
steps AS (SELECT edge_id, x AS ax, y AS ay, lead(x) OVER w AS bx, lead(y) OVER w AS by, count(*) OVER (PARTITION BY edge_id) AS n FROM places WINDOW w AS (PARTITION BY edge_id ORDER BY k)),
e AS (SELECT edge_id, ax, ay, coalesce(s.bx, s.ax) AS bx, coalesce(s.by, s.ay) AS by FROM steps s WHERE s.bx IS NOT NULL OR s.n = 1),
base AS (SELECT c_custkey AS oid, c_custkey % 4 AS kind, (c_custkey % 311) * 23.713::DOUBLE AS x, (c_custkey % 257) * 29.171::DOUBLE AS y, c_custkey % 61 - 30 AS u, c_custkey % 53 - 26 AS w FROM customer),
o AS (SELECT oid, x AS ax, y AS ay, x AS bx, y AS by FROM base WHERE kind = 0 UNION ALL SELECT oid, x, y, x + 3 * u, y + 2 * w FROM base WHERE kind IN (1, 2)
  UNION ALL SELECT oid, x + 3 * u, y + 2 * w, x + 5 * u, y + 70 FROM base WHERE kind IN (1, 2) UNION ALL SELECT oid, x - 90, y - 110, x - 90 + w, y - 110 + u FROM base WHERE kind = 2)"""


def _polylines(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    l = table(spark, sf, "lineitem")
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber")
    x = F.col("l_orderkey") % 173 * 40.137 + F.sum(F.floor("l_quantity") - 20).over(w)
    y = F.col("l_orderkey") % 191 * 40.291 + F.sum(F.col("l_linenumber") * 7 + F.col("l_partkey") % 23 - 20).over(w)
    places = l.select(F.col("l_orderkey").alias("edge_id"), F.struct(F.col("l_linenumber").alias("k"), x.alias("x"), y.alias("y")).alias("p"))
    part = F.transform(F.array_sort(F.collect_list("p")), lambda p: F.struct(p["x"].alias("x"), p["y"].alias("y")))
    edges = places.groupBy("edge_id").agg(F.array(part).alias("line")).withColumn("route", F.col("edge_id") % 5)
    k = F.col("c_custkey")
    x, y, u, v = k % 311 * 23.713, k % 257 * 29.171, k % 61 - 30, k % 53 - 26
    at = lambda x, y: F.array(x, y)
    way = F.array(at(x, y), at(x + u * 3, y + v * 2), at(x + u * 5, y + 70))
    other = F.array(at(x - 90, y - 110), at(x - 90 + v, y - 110 + u))
    text = lambda kind, c: F.to_json(F.struct(F.lit(kind).alias("type"), c.alias("coordinates")))
    shape = F.when(k % 4 == 0, text("Point", at(x, y))).when(k % 4 == 1, text("LineString", way)).when(k % 4 == 2, text("MultiLineString", F.array(way, other)))
    return table(spark, sf, "customer").select(k.alias("oid"), polylines.line_from_geojson(shape).alias("line"), F.nullif(k % 5, F.lit(3)).alias("route")), edges


@query(f"""WITH {POLYLINES},
eb AS (SELECT edge_id, min(least(ax, bx)) AS x0, min(least(e.ay, e.by)) AS y0, max(greatest(ax, bx)) AS x1, max(greatest(e.ay, e.by)) AS y1 FROM e GROUP BY 1),
ob AS (SELECT oid, min(least(ax, bx)) AS x0, min(least(o.ay, o.by)) AS y0, max(greatest(ax, bx)) AS x1, max(greatest(o.ay, o.by)) AS y1 FROM o GROUP BY 1),
boxed AS (SELECT oid, edge_id FROM ob JOIN eb ON eb.x0 <= ob.x1 + 250 AND eb.x1 >= ob.x0 - 250 AND eb.y0 <= ob.y1 + 250 AND eb.y1 >= ob.y0 - 250),
c AS (SELECT oid, edge_id, min({DISTANCE}) AS d FROM boxed JOIN o USING (oid) JOIN e USING (edge_id) GROUP BY 1, 2 HAVING d <= 250),
n AS (SELECT *, d <= CASE WHEN oid % 4 = 0 THEN 100 ELSE 50 END AS pri FROM c),
m AS (SELECT *, count(*) FILTER (WHERE pri) OVER w AS np, count(*) OVER w AS na, row_number() OVER (PARTITION BY oid ORDER BY d, edge_id) AS k FROM n WINDOW w AS (PARTITION BY oid)),
s AS (SELECT * FROM m WHERE CASE WHEN np > 0 THEN pri ELSE k = 1 END)
SELECT c_custkey AS oid, edge_id, round(d, 4) AS distance, nullif(c_custkey % 5, 3) = edge_id % 5 AS route_agreement, CASE WHEN edge_id IS NULL THEN 0 WHEN np > 0 THEN np ELSE na END::BIGINT AS candidates,
CASE WHEN edge_id IS NULL THEN 'none' WHEN np = 0 THEN 'nearest_edge_250m_fallback' WHEN c_custkey % 4 = 0 THEN 'point_nearest_100m' ELSE 'line_buffer_50m' END AS method,
CASE WHEN edge_id IS NULL THEN 'unmatched' WHEN np > 0 THEN 'matched_primary' ELSE 'matched_fallback' END AS status FROM customer LEFT JOIN s ON oid = c_custkey""")
def restriction_line_match(spark, sf):
    return matching.match_lines(*_polylines(spark, sf)).withColumn("distance", F.round("distance", 4))


def matched_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Which observations `restriction_line_match` has an edge for."""
    return matching.matched_lines(*_polylines(spark, sf))


# --- cells and areas


@query(f"""WITH {V}, c AS (SELECT vec_id AS cid, e1_1000 AS x0, e2_1000 AS y0, e1_1000 + 25 AS x1, e2_1000 + 25 AS y1 FROM v),
a AS (SELECT vec_id AS gid, e3_1000 AS u0, e4_1000 AS w0, e3_1000 + 40 + vec_id % 30 AS u1, e4_1000 + 30 + vec_id % 20 AS w1 FROM v),
m AS (SELECT cid, gid, (x0 + x1) / 2 BETWEEN u0 AND u1 AND (y0 + y1) / 2 BETWEEN w0 AND w1 AS hit, round((least(x1, u1) - greatest(x0, u0)) * (least(y1, w1) - greatest(y0, w0)), 6) AS area
  FROM c, a WHERE least(x1, u1) > greatest(x0, u0) AND least(y1, w1) > greatest(y0, w0)),
h AS (SELECT *, count(*) FILTER (WHERE hit) OVER (PARTITION BY cid) AS hits FROM m),
b AS (SELECT * FROM h WHERE CASE WHEN hits = 1 THEN hit ELSE area > 0 END QUALIFY row_number() OVER (PARTITION BY cid ORDER BY area DESC, gid) = 1)
SELECT cid, gid, CASE WHEN gid IS NULL THEN 'unmatched' WHEN hits = 1 THEN 'point_unique' ELSE 'maximum_overlap' END AS link_status FROM c LEFT JOIN b USING (cid)""")
def cell_area_link(spark, sf):
    v = _vectors(spark, sf)
    cells = v.select(F.col("vec_id").alias("cid"), F.col("e1_1000").alias("x0"), F.col("e2_1000").alias("y0"), (F.col("e1_1000") + 25).alias("x1"), (F.col("e2_1000") + 25).alias("y1"))
    at = lambda x, y: F.struct((F.col("e3_1000") + x).alias("x"), (F.col("e4_1000") + y).alias("y"))
    w, h = 40 + F.col("vec_id") % 30, 30 + F.col("vec_id") % 20
    areas = v.select(F.col("vec_id").alias("gid"), F.array(at(F.lit(0), F.lit(0)), at(w, F.lit(0)), at(w, h), at(F.lit(0), h)).alias("ring"))
    return matching.link_cells(cells, areas, 50.0)


# --- union of areas: customers are squares of a lattice 40 wide, in two groups by nation

SQUARES = """sq AS (SELECT c_nationkey % 2 AS grp, c_custkey % 40 AS i, c_custkey // 40 AS j FROM customer),
steps AS (SELECT grp, i AS x, j AS y, 0 AS d FROM sq UNION ALL SELECT grp, i + 1, j, 1 FROM sq UNION ALL SELECT grp, i + 1, j + 1, 2 FROM sq UNION ALL SELECT grp, i, j + 1, 3 FROM sq),
ended AS (SELECT *, x + CASE d WHEN 0 THEN 1 WHEN 2 THEN -1 ELSE 0 END AS x1, y + CASE d WHEN 1 THEN 1 WHEN 3 THEN -1 ELSE 0 END AS y1 FROM steps),
border AS (SELECT *, row_number() OVER (ORDER BY grp, x, y, x1, y1) AS id FROM ended a WHERE NOT EXISTS (SELECT 1 FROM ended b WHERE b.grp = a.grp AND b.x = a.x1 AND b.y = a.y1 AND b.x1 = a.x AND b.y1 = a.y)),
go AS (SELECT a.id, b.id AS next, a.x * b.y - b.x * a.y AS twice FROM border a JOIN border b ON a.grp = b.grp AND a.x1 = b.x AND a.y1 = b.y QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY (a.d - b.d + 5) % 4) = 1),
walk(head, pos, k, twice) AS (SELECT id, next, 1, twice FROM go UNION ALL SELECT w.head, g.next, w.k + 1, w.twice + g.twice FROM walk w JOIN go g ON g.id = w.pos WHERE w.pos > w.head),
rings AS (SELECT grp, x * 10.0::DOUBLE AS x, y * 10.0::DOUBLE AS y, k AS places, twice * 50.0::DOUBLE AS area FROM walk JOIN border ON id = walk.head WHERE pos = walk.head)"""


def _squares(spark: SparkSession, sf: str) -> DataFrame:
    k = F.col("c_custkey")
    at = lambda u, v: F.struct(((k % 40 + u) * 10).cast("double").alias("x"), ((F.floor(k / 40) + v) * 10).cast("double").alias("y"))
    ring = F.array(at(0, 0), at(1, 0), at(1, 1), at(0, 1), at(0, 0))
    turned = F.when(k % 3 == 0, F.reverse(ring)).otherwise(ring)  # sources agree in no direction
    return spread(table(spark, sf, "customer").select("c_custkey", "c_nationkey")).select((F.col("c_nationkey") % 2).alias("grp"), F.array(turned).alias("rings"))


@query(f"WITH RECURSIVE {SQUARES} SELECT grp, x, y, places, area FROM rings")
def union_rings(spark, sf):
    d = polygons.dissolve_rings(_squares(spark, sf), "grp", 40.0)
    return d.select("grp", F.col("ring")[0]["x"].alias("x"), F.col("ring")[0]["y"].alias("y"), F.size("ring").alias("places"), "area")


@query(f"""WITH RECURSIVE {SQUARES} SELECT grp, (SELECT count(*) FROM sq WHERE sq.grp = rings.grp) AS parts, count(*) FILTER (WHERE area > 0)::INT AS polygons, count(*) FILTER (WHERE area < 0)::INT AS holes, sum(area) AS area FROM rings GROUP BY grp""")
def union_areas(spark, sf):
    squares = _squares(spark, sf)
    d = polygons.dissolve_polygons(squares, "grp", 40.0)
    d = d.groupBy("grp").agg(F.count(F.lit(1)).cast("int").alias("polygons"), F.sum(F.size("rings") - 1).cast("int").alias("holes"), F.sum("area").alias("area"))
    return squares.groupBy("grp").agg(F.count(F.lit(1)).alias("parts")).join(d, "grp", "left").select("grp", "parts", "polygons", "holes", "area")


@query(f"""WITH {V}, c AS (SELECT vec_id, label, greatest(1, floor(abs(e1_1000))) AS w, 2 + vec_id % 7 * 2 AS h FROM v)
SELECT vec_id, CASE WHEN label % 2 = 0 THEN w * 1.5 ELSE w * 2 END AS x, h * CASE WHEN label % 2 = 0 THEN 0.625::DOUBLE ELSE 0.5 END AS y FROM c""")
def surface_points(spark, sf):
    """Of a U, and of a frame with a hole left of its middle: the middle of the right arm."""
    v = _vectors(spark, sf)
    w, h = F.greatest(F.lit(1.0), F.floor(F.abs("e1_1000")).cast("double")), (2 + F.col("vec_id") % 7 * 2).cast("double")
    ring = lambda *p: F.array(*[F.struct(F.lit(x).cast("double").alias("x"), F.lit(y).cast("double").alias("y")) for x, y in p])
    o = F.lit(0.0)
    u = F.array(ring((o, o), (w * 2, o), (w * 2, h), (w, h), (w, h / 4), (w / 2, h / 4), (w / 2, h), (o, h)))
    frame = F.array(ring((o, o), (w * 2.5, o), (w * 2.5, h), (o, h)), ring((w * 0.5, h / 4), (w * 1.5, h / 4), (w * 1.5, h * 0.75), (w * 0.5, h * 0.75)))
    at = polygons.point_on_surface(F.when(F.col("label") % 2 == 0, u).otherwise(frame))
    return v.select("vec_id", at.alias("p")).select("vec_id", "p.x", "p.y")


# --- layers in other reference systems


@query("""SELECT c_custkey AS id, k, round(131 + c_custkey % 997 / 1000.0 + k / 100.0, 9)::DOUBLE AS lon, round(32.5 + c_custkey % 613 / 1000.0 - k / 50.0, 9)::DOUBLE AS lat, true AS far FROM customer, (SELECT unnest([0, 1, 2]) AS k)""")
def layer_round_trip(spark, sf):
    """Lines of three places: degrees, plane system II, system I, and degrees again; `far` tells that the planes' places were not the degrees."""
    k = F.col("c_custkey")
    place = lambda i: F.struct((131 + k % 997 / 1000 + i / 100).alias("x"), (32.5 + k % 613 / 1000 - i / 50).alias("y"))
    d = spread(table(spark, sf, "customer").select("c_custkey")).select(k.alias("id"), F.array(F.array(*[place(i) for i in range(3)])).alias("line"))
    plane = projections.reproject_layer(d, "line", "EPSG:6670", "EPSG:4326").withColumn("plane", F.col("line"))
    back = projections.reproject_layer(projections.reproject_layer(plane, "line", "EPSG:6669"), "line", "EPSG:6668")
    far = F.forall(F.col("plane")[0], lambda p: F.abs(p["x"] - 131) + F.abs(p["y"] - 33) > 10)
    d = back.select("id", far.alias("far"), F.posexplode(F.col("line")[0]).alias("k", "p"))
    return d.select("id", "k", F.round("p.x", 9).alias("lon"), F.round("p.y", 9).alias("lat"), "far")


# --- facilities


@query(f"""WITH {V}, p AS (SELECT vec_id AS pid, e1_1000 AS x, e2_1000 AS y FROM v WHERE label <> 0), n AS (SELECT vec_id AS nid, e1_1000 AS x, e2_1000 AS y FROM v WHERE label = 0),
near AS (SELECT pid, nid, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) AS d FROM p, n WHERE sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) <= 60 QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, nid) = 1),
ends AS (SELECT l_partkey AS nid, l_orderkey * 10 + l_linenumber AS edge_id, 0.0::DOUBLE AS fraction FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey * 10 + l_linenumber, 1.0 FROM lineitem),
least AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY nid ORDER BY edge_id, fraction) = 1)
SELECT pid, near.nid, round(d, 6) AS distance, near.nid IS NOT NULL AS accepted, edge_id, fraction FROM p LEFT JOIN near USING (pid) LEFT JOIN least ON least.nid = near.nid""")
def network_snap(spark, sf):
    v = _vectors(spark, sf)
    at = lambda d, c: d.select(F.col("vec_id").alias(c), F.col("e1_1000").alias("x"), F.col("e2_1000").alias("y"))
    edges = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return facilities.snap_to_network(at(v.where("label <> 0"), "pid"), at(v.where("label = 0"), "nid"), edges, 60.0).withColumn("distance", F.round("distance", 6))


@query(f"""WITH {V}, p AS (SELECT vec_id AS pid, e1_4000 + label * 500 AS x, e2_4000 AS y FROM v WHERE label <> 0), n AS (SELECT vec_id AS nid, e1_1000 AS x, e2_1000 AS y FROM v WHERE label = 0),
near AS (SELECT pid, nid, sqrt((p.x - n.x) ** 2 + (p.y - n.y) ** 2) AS d FROM p, n QUALIFY row_number() OVER (PARTITION BY pid ORDER BY d, nid) = 1),
ends AS (SELECT l_partkey AS nid, l_orderkey * 10 + l_linenumber AS edge_id, 0.0::DOUBLE AS fraction FROM lineitem UNION ALL SELECT l_suppkey, l_orderkey * 10 + l_linenumber, 1.0 FROM lineitem),
least AS (SELECT * FROM ends QUALIFY row_number() OVER (PARTITION BY nid ORDER BY edge_id, fraction) = 1)
SELECT pid, CASE WHEN d <= 60 THEN near.nid END AS nid, round(d, 6) AS distance, d <= 60 AS accepted, edge_id, fraction FROM near LEFT JOIN least ON least.nid = near.nid AND d <= 60""")
def network_snap_distances(spark, sf):
    """As `network_snap`, with the distances of the points that are refused."""
    v = _vectors(spark, sf)
    points = v.where("label <> 0").select(F.col("vec_id").alias("pid"), (F.col("e1_4000") + F.col("label") * 500).alias("x"), F.col("e2_4000").alias("y"))
    nodes = v.where("label = 0").select(F.col("vec_id").alias("nid"), F.col("e1_1000").alias("x"), F.col("e2_1000").alias("y"))
    edges = table(spark, sf, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), F.col("l_partkey").alias("a"), F.col("l_suppkey").alias("b"))
    return facilities.attach_nearest_node(points, nodes, edges, 60.0).withColumn("distance", F.round("distance", 6))


@query("""SELECT c_custkey AS shelter, floor(abs(c_acctbal))::DOUBLE AS evacuees, demand_case, floor(abs(c_acctbal)) * litres AS demand, 'separate_not_added' AS ledger_status
FROM customer, (VALUES ('minimum', 3.0::DOUBLE), ('basic', 10.0), ('extended', 20.0)) l(demand_case, litres)""")
def shelter_ledger(spark, sf):
    return facilities.shelter_ledger(table(spark, sf, "customer").select(F.col("c_custkey").alias("shelter"), F.floor(F.abs("c_acctbal")).cast("double").alias("evacuees")))


@query("""WITH b AS (SELECT l_orderkey AS unit, min(l_extendedprice) AS d0 FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1), a AS (SELECT l_orderkey AS unit, min(l_extendedprice) AS d1 FROM lineitem WHERE l_returnflag <> 'A' GROUP BY 1)
SELECT unit, CASE WHEN d0 <= 20000 AND d1 <= 20000 THEN 'retained' WHEN d1 <= 20000 THEN 'gained' WHEN d0 <= 20000 THEN 'lost' ELSE 'not_covered' END AS status FROM b FULL JOIN a USING (unit)""")
def recovered_coverage(spark, sf):
    l = table(spark, sf, "lineitem")
    at = lambda c: l.where(c).groupBy(F.col("l_orderkey").alias("unit")).agg(F.min("l_extendedprice").alias("distance"))
    return facilities.recovered_coverage(at("l_returnflag = 'R'"), at("l_returnflag <> 'A'"), "unit", 20000.0)


@query("""SELECT c_nationkey AS grp, sum(floor(abs(c_acctbal))) AS people_total, coalesce(sum(floor(abs(c_acctbal))) FILTER (WHERE c_acctbal <= 4000), 0) AS people_covered,
sum(floor(abs(c_acctbal))) - coalesce(sum(floor(abs(c_acctbal))) FILTER (WHERE c_acctbal <= 4000), 0) AS people_gap,
round(coalesce(sum(floor(abs(c_acctbal))) FILTER (WHERE c_acctbal <= 4000), 0) / sum(floor(abs(c_acctbal))) * 100, 6) AS people_pct FROM customer GROUP BY 1""")
def municipality_access_gaps(spark, sf):
    u = table(spark, sf, "customer").select(F.col("c_nationkey").alias("grp"), F.floor(F.abs("c_acctbal")).cast("double").alias("people"), F.col("c_acctbal").alias("distance"))
    return facilities.access_gaps(u, "grp", "distance", [("people", 4000.0)]).withColumn("people_pct", F.round("people_pct", 6))


@query("""SELECT 'WATER::' || s_suppkey AS site_id, 'announced' AS kind, s_acctbal AS capacity FROM supplier UNION ALL SELECT 'STAGING::' || c_custkey, 'staging', c_acctbal FROM customer""")
def site_inventory(spark, sf):
    one = lambda t, k: table(spark, sf, t).select(F.col(f"{k}key").alias("id"), F.col(f"{k[0]}_acctbal").alias("capacity"))
    return facilities.site_inventory(one("supplier", "s_supp"), one("customer", "c_cust"), ["capacity"])


# --- names within addresses: nations, and the names of every seventh customer, in addresses made of both

ADDRESSES = """a AS (SELECT c_custkey AS id, n_name || ' ' || c_name || CASE WHEN c_custkey % 3 = 0 THEN ' / ' || lag(c_name, 1, '') OVER (ORDER BY c_custkey) ELSE '' END AS address, 'hall ' || c_custkey % 211 AS hall, c_custkey * 2.5::DOUBLE AS x FROM customer JOIN nation ON n_nationkey = c_nationkey),
names AS (SELECT n_name AS name FROM nation UNION SELECT c_name FROM customer WHERE c_custkey % 7 = 0)"""


def _addresses(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    c, n = table(spark, sf, "customer"), table(spark, sf, "nation")
    k = F.col("c_custkey")
    other = c.select((k + 1).alias("c_custkey"), F.concat(F.lit(" / "), "c_name").alias("before"))
    a = c.join(n, F.col("n_nationkey") == F.col("c_nationkey")).join(other, "c_custkey", "left")
    address = F.concat("n_name", F.lit(" "), "c_name", F.when(k % 3 == 0, F.coalesce("before", F.lit(" / "))).otherwise(""))
    a = a.select(k.alias("id"), address.alias("address"), F.concat(F.lit("hall "), (k % 211).cast("string")).alias("hall"), (k * 2.5).alias("x"))
    return a, n.select(F.col("n_name").alias("name")).union(c.where(k % 7 == 0).select("c_name"))


@query(f"WITH {ADDRESSES} SELECT id, name FROM a JOIN names ON contains(address, name)")
def names_in_addresses(spark, sf):
    a, names = _addresses(spark, sf)
    return linkage.names_in_texts(a, "id", "address", names, "name")


@query(f"WITH {ADDRESSES} SELECT name, hall, min(x) AS x FROM a JOIN names ON contains(address, name) GROUP BY name, hall HAVING count(*) = 1")
def unique_halls_by_name(spark, sf):
    a, names = _addresses(spark, sf)
    return linkage.unique_within(a, "id", "address", "hall", names, "name", ["x"])


# --- formats


@query("""SELECT p_partkey, CASE WHEN length(replace(p_name, '|', '\\|')) > 12 THEN replace(p_name, '|', '\\|')[1:9] || '...' ELSE replace(p_name, '|', '\\|') END AS cell,
format('{:,.2f}', p_retailprice) AS price, format('{:,}', p_size) AS size FROM part""")
def table_cells(spark, sf):
    return table(spark, sf, "part").select("p_partkey", formats.markdown_cell("p_name", 12).alias("cell"), formats.thousands("p_retailprice", 2).alias("price"), formats.thousands("p_size").alias("size"))
