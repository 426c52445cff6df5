"""Registered queries of routes: parts and suppliers are road nodes, order lines roads and their minutes, suppliers refill points,
customers sites, and urgent orders bases."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators import network, routes
from reliefgrid.sources.storage import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

# Hours of a shift, minutes of service at each refill, trips a shift.
HOURS, SERVICE, TRIPS = 0.5, 2.0, 5


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


ROADS = "roads AS (SELECT l_orderkey, l_linenumber, l_partkey AS a, l_suppkey + 100000000 AS b, l_quantity AS w, l_returnflag, l_linestatus FROM lineitem)"
NODES = "known AS (SELECT p_partkey AS node FROM part WHERE p_size <= 40 UNION SELECT s_suppkey + 100000000 FROM supplier WHERE s_acctbal > -500)"


def _roads(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100000000).alias("b"), F.col("l_quantity").alias("w"), "l_returnflag", "l_linestatus")


@query(f"""WITH {ROADS}, {NODES} SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM roads WHERE l_returnflag <> 'R' AND nullif(l_linestatus, 'O') = 'F' AND w IS NOT NULL
AND a IN (SELECT node FROM known) AND b IN (SELECT node FROM known) GROUP BY 1, 2""")
def eligible_road_graph(spark, sf):
    nodes = table(spark, sf, "part").where("p_size <= 40").select(F.col("p_partkey").alias("node")).union(table(spark, sf, "supplier").where("s_acctbal > -500").select(F.col("s_suppkey") + 100000000))
    roads = _roads(spark, sf).withColumn("available", F.col("l_returnflag") != "R").withColumn("eligible", F.nullif("l_linestatus", F.lit("O")) == "F")
    return network.build_graph(network.eligible_edges(roads, nodes, "a", "b", "available", "eligible"), "a", "b", "w")


CHAIN = f"""{ROADS}, e0 AS (SELECT a, b, min(2 * w) AS w FROM roads GROUP BY 1, 2), e AS (SELECT a, b, w FROM e0 UNION ALL SELECT b, a, w FROM e0),
spot AS (SELECT p_partkey AS nid, embedding[1]::DOUBLE * 4000 AS x, embedding[2]::DOUBLE * 4000 AS y FROM part JOIN embeddings ON vec_id = p_partkey),
ref AS (SELECT s_suppkey AS refill, embedding[3]::DOUBLE * 4000 AS x, embedding[4]::DOUBLE * 4000 AS y, s_acctbal > 0 AS historical, row_number() OVER (ORDER BY nullif(s_nationkey, 3) NULLS LAST, s_suppkey) AS no
  FROM supplier LEFT JOIN embeddings ON vec_id = s_suppkey),
snapped AS (SELECT refill, no, nid AS node, sqrt((ref.x - spot.x) ** 2 + (ref.y - spot.y) ** 2) AS snap, coalesce(historical AND sqrt((ref.x - spot.x) ** 2 + (ref.y - spot.y) ** 2) <= 250, false) AS ok
  FROM ref LEFT JOIN spot ON ref.x IS NOT NULL QUALIFY row_number() OVER (PARTITION BY refill ORDER BY sqrt((ref.x - spot.x) ** 2 + (ref.y - spot.y) ** 2), nid) = 1),
cand AS (SELECT o_orderkey AS base, 2 * w AS minutes, a, b, o_custkey % 5 / 4.0::DOUBLE AS f, o_custkey % 7 * 50.0::DOUBLE AS snap, row_number() OVER (ORDER BY o_custkey, o_orderkey) AS no
  FROM orders JOIN roads ON l_orderkey = o_orderkey AND l_linenumber = 1 WHERE o_orderpriority = '1-URGENT' AND o_orderstatus <> 'P'),
bases AS (SELECT base, no, CASE WHEN f <= 0.5 THEN a ELSE b END AS node, snap / 1000 / 20 * 60 + least(f, 1 - f) * minutes AS off FROM cand),
way(refill, node, dist) USING KEY (refill, node) AS (SELECT refill, node, 0.0::DOUBLE FROM snapped WHERE ok
  UNION SELECT p.refill, e.b, min(p.dist + e.w) FROM way p JOIN e ON p.node = e.a LEFT JOIN recurring.way r ON r.refill = p.refill AND r.node = e.b WHERE p.dist + e.w <= {30 * HOURS} AND (r.dist IS NULL OR p.dist + e.w < r.dist) GROUP BY 1, 2),
near AS (SELECT refill, arg_min(base, (dist + off, no)) AS base, min(dist + off) AS m FROM way JOIN bases USING (node) GROUP BY 1),
points AS (SELECT s.*, CASE WHEN 2 * (m + snap / 1000 / 20 * 60) <= {60 * HOURS} THEN base END AS base, CASE WHEN 2 * (m + snap / 1000 / 20 * 60) <= {60 * HOURS} THEN m + snap / 1000 / 20 * 60 END AS base_minutes FROM snapped s LEFT JOIN near USING (refill)),
sites AS (SELECT c_custkey AS site, p_partkey AS node, c_custkey % 4 * 100.0::DOUBLE AS connector FROM customer JOIN part ON p_partkey = c_custkey),
legs AS (SELECT site, refill, no, base, base_minutes, dist + connector / 1000 / 20 * 60 + snap / 1000 / 20 * 60 AS leg FROM points JOIN way USING (refill) JOIN sites ON sites.node = way.node WHERE ok AND base IS NOT NULL),
timed AS (SELECT *, least({TRIPS}, floor(({60 * HOURS} - 2 * base_minutes) / (2 * leg + {SERVICE})))::INT AS trips, 2 * leg + {SERVICE} AS cycle FROM legs),
best AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY cycle + 2 * base_minutes / {TRIPS}, no)::INT AS route_rank FROM timed WHERE trips >= 1 QUALIFY route_rank <= 3)"""


def _chain(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    roads = _roads(spark, sf).withColumn("minutes", F.col("w") * 2)
    e = lambda k: F.element_at("embedding", k).cast("double") * 4000
    places = table(spark, sf, "embeddings")
    nodes = table(spark, sf, "part").join(places, F.col("vec_id") == F.col("p_partkey")).select(F.col("p_partkey").alias("nid"), e(1).alias("x"), e(2).alias("y"))
    points = table(spark, sf, "supplier").join(places, F.col("vec_id") == F.col("s_suppkey"), "left")
    points = points.select(F.col("s_suppkey").alias("refill"), e(3).alias("x"), e(4).alias("y"), (F.col("s_acctbal") > 0).alias("historical"), F.nullif("s_nationkey", F.lit(3)).alias("name"))
    k = F.col("o_custkey")
    bases = table(spark, sf, "orders").select(F.col("o_orderkey").alias("base"), (F.col("o_orderpriority") == "1-URGENT").alias("candidate"), (F.col("o_orderstatus") != "P").alias("accepted"), F.col("o_orderkey").alias("edge_id"), (k % 5 / 4.0).alias("fraction"), (k % 7 * 50.0).alias("snap"), k.alias("name"))
    edges = roads.where("l_linenumber = 1").select(F.col("l_orderkey").alias("edge_id"), "a", "b", "minutes")
    sites = table(spark, sf, "customer").join(table(spark, sf, "part"), F.col("c_custkey") == F.col("p_partkey")).select(F.col("c_custkey").alias("site"), F.col("p_partkey").alias("node"), (F.col("c_custkey") % 4 * 100.0).alias("connector"))
    graph = network.build_graph(roads.select("a", "b", F.col("minutes").alias("w")), "a", "b", "w")
    return routes.route_productivity(graph, sites, routes.snapped_refills(points, nodes, ["name"]), stored(routes.base_nodes(bases, edges, ["name"])), HOURS, SERVICE, TRIPS)


@query(f"WITH RECURSIVE {CHAIN} SELECT refill, no, node, round(snap, 6) AS snap, ok AND base IS NOT NULL AS accepted, base, round(base_minutes, 6) AS base_minutes FROM points")
def refill_points(spark, sf):
    return _chain(spark, sf)[1].withColumn("snap", F.round("snap", 6)).withColumn("base_minutes", F.round("base_minutes", 6))


@query(f"WITH RECURSIVE {CHAIN} SELECT site, route_rank, refill, base, trips, round(leg, 6) AS leg_minutes, round(base_minutes, 6) AS base_minutes, round(cycle, 6) AS cycle, round(cycle + 2 * base_minutes / {TRIPS}, 6) AS minutes FROM best")
def route_productivity(spark, sf):
    d = _chain(spark, sf)[0]
    return d.select("site", "route_rank", "refill", "base", "trips", *[F.round(c, 6).alias(c) for c in ("leg_minutes", "base_minutes", "cycle", "minutes")])
