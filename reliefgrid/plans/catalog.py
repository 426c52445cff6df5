"""Registered queries over the driver's tables, each with SQL that gives the same rows.

Customers stand for demand units, nations for municipalities, orders for incident snapshots, suppliers for sites and
parts and suppliers for road nodes that lineitem's rows join.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from reliefgrid.functions import nulls, stats, text
from reliefgrid.operators import geo, keys, linkage, network, scenarios, tanker
from reliefgrid.plans import facility_queries, municipal_queries, report_queries, route_queries, screening_queries
from reliefgrid.sources.storage import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {**facility_queries.QUERIES, **municipal_queries.QUERIES, **report_queries.QUERIES, **route_queries.QUERIES, **screening_queries.QUERIES}
ORACLES: dict[str, str] = {**facility_queries.ORACLES, **municipal_queries.ORACLES, **report_queries.ORACLES, **route_queries.ORACLES, **screening_queries.ORACLES}
FLAGSHIP = "weighted_coverage_thresholds"


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


# --- scans, projections, predicates


@query("""SELECT p_partkey AS part_id, trim(p_name) AS part_name, nullif(p_size, 0) AS size, try_cast(replace(p_brand, 'Brand#', '') AS BIGINT) AS brand_no,
round(least(greatest(p_retailprice / 1000, 0), 1), 6) AS price_share, 'tpch' AS provider FROM part""")
def scan_rename_coerce(spark, sf):
    p = table(spark, sf, "part")
    return p.select(F.col("p_partkey").alias("part_id"), nulls.strip("p_name").alias("part_name"), nulls.zero_to_null("p_size").alias("size"), nulls.try_number(F.replace("p_brand", F.lit("Brand#"), F.lit("")), "bigint").alias("brand_no"), F.round(nulls.null_clip(F.col("p_retailprice") / 1000, 0.0, 1.0), 6).alias("price_share"), F.lit("tpch").alias("provider"))


UNITS = "SELECT c_custkey AS unit, c_nationkey AS grp, floor(abs(c_acctbal))::DOUBLE AS people, floor(abs(c_acctbal) / 3)::DOUBLE AS households FROM customer"
OUTAGES = """SELECT n_nationkey AS grp, sum(out)::DOUBLE AS out FROM (
  SELECT c_nationkey AS n_nationkey, floor(o_totalprice / 100) AS out FROM orders JOIN customer ON o_custkey = c_custkey
  WHERE o_orderpriority = '1-URGENT' AND c_nationkey % 3 <> 0) GROUP BY 1"""


def units(spark, sf):
    b = F.abs("c_acctbal")
    return table(spark, sf, "customer").select(F.col("c_custkey").alias("unit"), F.col("c_nationkey").alias("grp"), F.floor(b).cast("double").alias("people"), F.floor(b / 3).cast("double").alias("households"))


def outages(spark, sf):
    o = table(spark, sf, "orders").where("o_orderpriority = '1-URGENT'").join(table(spark, sf, "customer").where("c_nationkey % 3 <> 0"), F.col("o_custkey") == F.col("c_custkey"))
    return o.groupBy(F.col("c_nationkey").alias("grp")).agg(F.sum(F.floor(F.col("o_totalprice") / 100)).cast("double").alias("out"))


HOUSEHOLDS = f"""WITH u AS ({UNITS}), o AS ({OUTAGES}),
h AS (SELECT u.*, o.out AS observed, sum(households) OVER (PARTITION BY u.grp) AS gh FROM u LEFT JOIN o USING (grp)),
r AS (SELECT *, households / nullif(gh, 0) AS share, coalesce(observed, 0) AS out, least(greatest(coalesce(observed, 0) / nullif(gh, 0), 0), 1) AS ratio,
  CASE WHEN observed IS NULL THEN 'assumed_zero_no_official_outage_listing' WHEN observed > gh THEN 'reported_positive_ratio_capped' WHEN observed > 0 THEN 'reported_positive' ELSE 'reported_zero' END AS status FROM h)"""


@query(HOUSEHOLDS + " SELECT unit, grp, round(share, 9) AS share, round(ratio, 9) AS ratio, status FROM r")
def household_share_and_ratio(spark, sf):
    d = scenarios.household_outages(units(spark, sf), outages(spark, sf), "grp")
    return d.select("unit", "grp", F.round("share", 9).alias("share"), F.round("ratio", 9).alias("ratio"), "status")


P90 = """q AS (SELECT grp, people / households AS size, households AS w FROM r WHERE households > 0),
c AS (SELECT grp, size, sum(w) OVER (PARTITION BY grp ORDER BY size) AS c, sum(w) OVER (PARTITION BY grp) AS t FROM q),
p AS (SELECT grp, min(size) AS p90 FROM c WHERE c >= t * 0.9::DOUBLE GROUP BY grp)"""
CASES = """s AS (SELECT r.unit, r.grp, r.status, x.population_case, x.affected, y.demand_case, x.affected * y.q AS demand FROM r LEFT JOIN p USING (grp),
  LATERAL (SELECT 'lower_one_person_per_household' AS population_case, CASE WHEN out * share IS NOT NULL THEN least(people, out * share) END AS affected
    UNION ALL SELECT 'proportional_central', people * ratio UNION ALL SELECT 'upper_p90_household_size', CASE WHEN out * share * p90 IS NOT NULL THEN least(people, out * share * p90) END) x,
  (VALUES ('minimum', 3.0::DOUBLE), ('basic', 10.0::DOUBLE), ('extended', 20.0::DOUBLE)) y(demand_case, q))"""


@query(HOUSEHOLDS + ", " + P90 + " SELECT grp, round(p90, 6) AS p90 FROM p")
def weighted_p90_by_group(spark, sf):
    u = units(spark, sf).where("households > 0").withColumn("size", F.col("people") / F.col("households"))
    return stats.weighted_quantile(u, ["grp"], "size", "households", 0.9, "p90").select("grp", F.round("p90", 6).alias("p90"))


def _demand(spark, sf):
    return scenarios.demand_scenarios(units(spark, sf), outages(spark, sf), "grp", "unit")


@query(HOUSEHOLDS + ", " + P90 + ", " + CASES + " SELECT unit, grp, status, population_case, demand_case, round(affected, 6) AS affected, round(demand, 6) AS demand FROM s")
def population_demand_scenarios(spark, sf):
    return _demand(spark, sf).select("unit", "grp", "status", "population_case", "demand_case", F.round("affected", 6).alias("affected"), F.round("demand", 6).alias("demand"))


@query(HOUSEHOLDS + ", " + P90 + ", " + CASES + """ SELECT grp, population_case, demand_case, count(*) AS units, round(coalesce(sum(affected), 0), 3) AS affected, round(sum(demand), 3) AS demand,
arg_min(status, unit) AS status FROM s GROUP BY ALL""")
def municipal_rollup(spark, sf):
    return scenarios.roll_up(_demand(spark, sf), "grp").withColumn("affected", F.round("affected", 3)).withColumn("demand", F.round("demand", 3))


# --- latest snapshots


@query("""SELECT user_id, event_id, event_type FROM events WHERE date_trunc('day', ts) = (SELECT max(date_trunc('day', ts)) FROM events)
QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) = 1""")
def latest_snapshot_per_unit(spark, sf):
    e = table(spark, sf, "events").withColumn("day", F.date_trunc("day", "ts"))
    return keys.latest_snapshot(e, ["user_id"], "day", ["ts", "event_id"]).select("user_id", "event_id", "event_type")


@query("""WITH l AS (SELECT o_custkey, sum(o_totalprice) AS v FROM orders WHERE year(o_orderdate) = (SELECT max(year(o_orderdate)) FROM orders) GROUP BY 1)
SELECT c_custkey, round(coalesce(v, 0), 2) AS v, CASE WHEN v IS NULL THEN 'assumed_zero' ELSE 'reported' END AS status FROM customer LEFT JOIN l ON o_custkey = c_custkey""")
def assumed_zero_fill(spark, sf):
    o = table(spark, sf, "orders").withColumn("y", F.year("o_orderdate"))
    last = o.join(F.broadcast(o.agg(F.max("y").alias("top"))), F.col("y") == F.col("top")).groupBy("o_custkey").agg(F.sum("o_totalprice").alias("v"))
    d = table(spark, sf, "customer").join(last, F.col("c_custkey") == F.col("o_custkey"), "left")
    return d.select("c_custkey", F.round(F.coalesce("v", F.lit(0.0)), 2).alias("v"), F.when(F.col("v").isNull(), "assumed_zero").otherwise("reported").alias("status"))


# --- linkage


@query("""SELECT n_name AS unit, CASE WHEN n_nationkey % 5 = 4 THEN NULL ELSE n_nationkey END AS code,
CASE WHEN n_name = 'NATION_1' THEN 'joint_operator_unallocated' WHEN n_name = 'NATION_2' THEN 'outside_study_area' WHEN n_nationkey % 5 <> 4 THEN 'exact' ELSE 'unmatched' END AS match_status FROM nation
WHERE n_name NOT IN ('NATION_1', 'NATION_2')
UNION ALL SELECT n_name, NULL, CASE n_name WHEN 'NATION_1' THEN 'joint_operator_unallocated' ELSE 'outside_study_area' END FROM nation WHERE n_name IN ('NATION_1', 'NATION_2')""")
def crosswalk_match_status(spark, sf):
    n = table(spark, sf, "nation")
    known = n.where("n_nationkey % 5 <> 4").select(F.col("n_name").alias("unit"), F.col("n_nationkey").alias("code"))
    return linkage.crosswalk(n.select(F.col("n_name").alias("unit")), known, ["NATION_1"], ["NATION_2"])


@query("""WITH f AS (SELECT p_type, count(*) AS records, count(DISTINCT p_size) AS vals, min(p_size) AS one FROM part GROUP BY 1), g AS (SELECT DISTINCT p_brand, p_type FROM part)
SELECT p_brand, p_type, records, vals AS "values", CASE WHEN vals = 1 THEN one END AS matched FROM g JOIN f USING (p_type)""")
def unique_name_match(spark, sf):
    p = table(spark, sf, "part")
    return linkage.unique_match(p.select("p_brand", "p_type").distinct(), p, "p_type", "p_size")


@query("""SELECT c_custkey, coalesce(a.v, b.v) AS v, CASE WHEN a.v IS NOT NULL THEN 'supplier' WHEN b.v IS NOT NULL THEN 'part' ELSE 'unmatched' END AS matched_by
FROM customer LEFT JOIN (SELECT s_suppkey AS c_custkey, s_acctbal AS v FROM supplier WHERE s_acctbal > 0) a USING (c_custkey)
LEFT JOIN (SELECT p_partkey AS c_custkey, p_retailprice AS v FROM part WHERE p_size > 20) b USING (c_custkey)""")
def hierarchy_fallback(spark, sf):
    s = table(spark, sf, "supplier").where("s_acctbal > 0").select(F.col("s_suppkey").alias("c_custkey"), F.col("s_acctbal").alias("v"))
    p = table(spark, sf, "part").where("p_size > 20").select(F.col("p_partkey").alias("c_custkey"), F.col("p_retailprice").alias("v"))
    return linkage.fallback(table(spark, sf, "customer").select("c_custkey"), [("supplier", s), ("part", p)], "c_custkey", "v")


@query("""WITH n AS (SELECT DISTINCT lower(c_mktsegment) AS s FROM customer)
SELECT conv_id, turn, len(list_filter((SELECT list(s) FROM n), lambda x: contains(lower(text), x)))::INT AS hits FROM conversations""")
def name_contains_lookup(spark, sf):
    c = table(spark, sf, "conversations").withColumn("t", F.lower("text"))
    names = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("s"))
    return linkage.names_within(c, "t", names, "s").select("conv_id", "turn", F.size("names_found").alias("hits"))


@query("""SELECT component, total, success, total - success AS unmatched, round(success / total::DOUBLE, 6) AS rate FROM (
SELECT 'customers' AS component, count(*) AS total, count(*) FILTER (WHERE c_acctbal > 0) AS success FROM customer
UNION ALL SELECT 'suppliers', count(*), count(*) FILTER (WHERE s_acctbal > 0) FROM supplier UNION ALL SELECT 'orders', count(*), count(*) FILTER (WHERE o_orderstatus = 'F') FROM orders)""")
def linkage_audit(spark, sf):
    return linkage.audit([("customers", table(spark, sf, "customer"), "c_acctbal > 0"), ("suppliers", table(spark, sf, "supplier"), "s_acctbal > 0"), ("orders", table(spark, sf, "orders"), "o_orderstatus = 'F'")])


# --- network

EDGES = "SELECT l_partkey AS a, l_suppkey + 100000000 AS b, l_quantity AS w, l_orderkey * 10 + l_linenumber AS edge_id, l_returnflag FROM lineitem"
GRAPH = f"g AS (SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM ({EDGES}) WHERE edge_id NOT IN (SELECT edge_id FROM ({EDGES}) WHERE l_returnflag = 'R') GROUP BY 1, 2)"


def roads(spark, sf):
    return table(spark, sf, "lineitem").select(F.col("l_partkey").alias("a"), (F.col("l_suppkey") + 100000000).alias("b"), F.col("l_quantity").alias("w"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("edge_id"), "l_returnflag", "l_orderkey")


def open_graph(spark, sf):
    """Rows of returned orders are closed roads."""
    r = roads(spark, sf)
    return network.build_graph(r, "a", "b", "w", closed=r.where("l_returnflag = 'R'"), edge_id="edge_id")


@query(f"SELECT least(a, b) AS a, greatest(a, b) AS b, min(w) AS w FROM ({EDGES}) GROUP BY 1, 2")
def parallel_edge_min(spark, sf):
    return network.build_graph(roads(spark, sf), "a", "b", "w")


REACH = f"""WITH RECURSIVE {GRAPH}, e AS (SELECT a, b, w FROM g UNION ALL SELECT b, a, w FROM g),
path(n, dist) USING KEY (n) AS (SELECT s_suppkey + 100000000 AS n, 0.0::DOUBLE AS dist FROM supplier
  UNION SELECT e.b, min(p.dist + e.w) FROM path p JOIN e ON p.n = e.a LEFT JOIN recurring.path r ON r.n = e.b WHERE r.dist IS NULL OR p.dist + e.w < r.dist GROUP BY e.b)"""


def _dist(spark, sf, graph):
    seeds = table(spark, sf, "supplier").select((F.col("s_suppkey") + 100000000).alias("node"), F.lit(0.0).alias("offset"))
    return network.nearest_distance(graph, seeds)


@query(REACH + " SELECT n AS node, dist FROM path")
def nearest_source_distance(spark, sf):
    return _dist(spark, sf, open_graph(spark, sf))


UNIT_DIST = """, u AS (SELECT c_custkey AS unit, c_nationkey AS grp, abs(c_acctbal) AS w, c_custkey % 7 * 10.0 AS snap, c_custkey % 7 < 6 AS accepted, c_custkey % 5 / 4.0::DOUBLE AS fraction,
  x.a, x.b, x.length FROM customer LEFT JOIN (SELECT a, b, w AS length, row_number() OVER (ORDER BY a, b) AS no FROM g) x ON x.no = c_custkey),
d AS (SELECT u.*, CASE WHEN accepted THEN least(coalesce(pa.dist, 1e300) + fraction * length, coalesce(pb.dist, 1e300) + (1 - fraction) * length) + snap END AS raw
  FROM u LEFT JOIN path pa ON pa.n = u.a LEFT JOIN path pb ON pb.n = u.b),
f AS (SELECT *, CASE WHEN raw < 1e200 THEN raw END AS distance FROM d)"""


def _unit_distances(spark, sf):
    no = keys.number_rows(open_graph(spark, sf), ["a", "b"], "edge_id").withColumnRenamed("w", "length")
    k = F.col("c_custkey")
    u = table(spark, sf, "customer").select(k.alias("unit"), F.col("c_nationkey").alias("grp"), F.abs("c_acctbal").alias("w"), (k % 7 * 10.0).alias("snap"), (k % 7 < 6).alias("accepted"), (k % 5 / F.lit(4.0)).alias("fraction"), k.alias("edge_id"))
    return network.attach_unit_distance(u, no, _dist(spark, sf, no.withColumnRenamed("length", "w")))


@query(REACH + UNIT_DIST + " SELECT unit, round(distance, 6) AS distance FROM f")
def access_edge_interpolation(spark, sf):
    return _unit_distances(spark, sf).select("unit", F.round("distance", 6).alias("distance"))


@query(REACH + UNIT_DIST + """ SELECT grp, round(sum(w), 2) AS total_weight, round(coalesce(sum(w) FILTER (WHERE distance <= 50), 0) / sum(w), 6) AS within_50,
round(coalesce(sum(w) FILTER (WHERE distance <= 100), 0) / sum(w), 6) AS within_100, round(coalesce(sum(w) FILTER (WHERE distance <= 200), 0) / sum(w), 6) AS within_200 FROM f GROUP BY grp""")
def weighted_coverage_thresholds(spark, sf):
    c = stats.weighted_coverage(_unit_distances(spark, sf), ["grp"], "distance", "w", [50, 100, 200])
    return c.select("grp", F.round("total_weight", 2).alias("total_weight"), *[F.round(x, 6).alias(x) for x in ("within_50", "within_100", "within_200")])


@query(REACH + UNIT_DIST + """ SELECT k * 5.0::DOUBLE AS threshold, round((SELECT coalesce(sum(w), 0) FROM f WHERE distance <= k * 5) / (SELECT sum(w) FROM f), 6) AS share FROM range(0, 61) t(k)""")
def coverage_curve(spark, sf):
    c = stats.coverage_curve(_unit_distances(spark, sf), "distance", "w", 5.0, 300.0)
    return c.select("threshold", F.round("share", 6).alias("share"))


@query(REACH + UNIT_DIST + """ SELECT band, count(*) AS units FROM (SELECT CASE WHEN distance IS NULL THEN 'unreachable' WHEN distance <= 50 THEN 'up to 50' WHEN distance <= 100 THEN 'up to 100'
WHEN distance <= 200 THEN 'up to 200' ELSE 'unreachable' END AS band FROM f) GROUP BY band""")
def distance_bands(spark, sf):
    b = stats.distance_band(F.col("distance"), [50, 100, 200], ["up to 50", "up to 100", "up to 200", "unreachable"])
    return _unit_distances(spark, sf).groupBy(b.alias("band")).agg(F.count(F.lit(1)).alias("units"))


# --- sites, routes, packing

ARCS = "arcs AS (SELECT l_orderkey AS unit, l_suppkey AS site, min(l_extendedprice) AS distance, sum(l_quantity) AS demand FROM lineitem GROUP BY 1, 2)"


def arcs(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("unit"), F.col("l_suppkey").alias("site")).agg(F.min("l_extendedprice").alias("distance"), F.sum("l_quantity").alias("demand"))


NEAREST = ARCS + ", nearest AS (SELECT unit, arg_min(site, (distance, site)) AS site, min(distance) AS distance FROM arcs GROUP BY unit)"


@query(f"WITH {NEAREST} SELECT * FROM nearest")
def nearest_site_assignment(spark, sf):
    return tanker.nearest_site(arcs(spark, sf), "unit", "distance", "site")


LOAD = NEAREST + ", loads AS (SELECT s_suppkey AS site, coalesce(sum(distance), 0) AS load FROM supplier LEFT JOIN nearest ON site = s_suppkey GROUP BY 1)"


def _load(spark, sf):
    near = tanker.nearest_site(arcs(spark, sf), "unit", "distance", "site")
    return tanker.site_load(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site")), near, "site", "distance")


@query(f"WITH {LOAD} SELECT site, round(load, 2) AS load FROM loads")
def site_load(spark, sf):
    return _load(spark, sf).select("site", F.round("load", 2).alias("load"))


@query(f"WITH {LOAD}, f AS (SELECT site FROM loads ORDER BY load DESC, site LIMIT 1) SELECT unit, arg_min(site, (distance, site)) AS site, min(distance) AS distance FROM arcs WHERE site NOT IN (SELECT site FROM f) GROUP BY unit")
def high_load_failure(spark, sf):
    gone = tanker.heaviest_site(_load(spark, sf), "site").select("site")
    return tanker.nearest_site(arcs(spark, sf).join(F.broadcast(gone), "site", "left_anti"), "unit", "distance", "site")


ROUTES = """routes AS (SELECT s_suppkey AS site, n_nationkey AS refill, abs(s_acctbal) % 60 + n_nationkey AS base, (s_suppkey * 7 + n_nationkey * 13) % 90 + 5.0::DOUBLE AS leg FROM supplier, nation),
trips AS (SELECT *, greatest(0, least(5, floor((600.0::DOUBLE - 2 * base) / (2 * leg + 60))))::INT AS trips FROM routes),
timed AS (SELECT *, 2 * leg + 60 + 2 * base / greatest(trips, 1) AS minutes FROM trips WHERE trips >= 1)"""


def routes(spark, sf):
    n = table(spark, sf, "nation").agg(F.collect_list("n_nationkey").alias("ns"))  # the refill points: 25 rows
    r = table(spark, sf, "supplier").join(F.broadcast(n)).select(F.col("s_suppkey").alias("site"), F.explode("ns").alias("refill"), F.abs("s_acctbal").alias("bal"))
    r = r.select("site", "refill", (F.col("bal") % 60 + F.col("refill")).alias("base"), ((F.col("site") * 7 + F.col("refill") * 13) % 90 + 5.0).alias("leg"))
    r = r.withColumn("trips", tanker.feasible_trips(10, F.col("base"), F.col("leg"), 60.0, 5))
    return r.where("trips >= 1").withColumn("minutes", tanker.effective_minutes(F.col("base"), F.col("leg"), 60.0, F.col("trips")))


@query(f"WITH {ROUTES} SELECT site, refill, trips, round(minutes, 6) AS minutes FROM timed")
def feasible_trips(spark, sf):
    return routes(spark, sf).select("site", "refill", "trips", F.round("minutes", 6).alias("minutes"))


@query(f"WITH {ROUTES} SELECT site, refill, route_rank::INT AS route_rank FROM (SELECT *, row_number() OVER (PARTITION BY site ORDER BY minutes, refill) AS route_rank FROM timed) WHERE route_rank <= 3")
def top3_routes(spark, sf):
    return tanker.cheapest_routes(routes(spark, sf), "site", "minutes", "refill").select("site", "refill", "route_rank")


@query(f"WITH {ROUTES} SELECT site, refill, trips FROM timed QUALIFY row_number() OVER (PARTITION BY site ORDER BY trips DESC, minutes, refill) = 1")
def best_route(spark, sf):
    return tanker.best_route(routes(spark, sf), "site", "trips", "minutes", "refill").select("site", "refill", "trips")


@query(f"WITH {ROUTES} SELECT refill, median(trips) AS median_trips, min(trips) AS least, max(trips) AS most, ceil(sum(leg) / nullif(100 * median(trips), 0))::BIGINT AS fleets FROM timed GROUP BY refill")
def median_trips_and_fleets(spark, sf):
    m = F.median("trips")
    return routes(spark, sf).groupBy("refill").agg(m.alias("median_trips"), F.min("trips").alias("least"), F.max("trips").alias("most"), F.ceil(F.try_divide(F.sum("leg"), m * 100)).cast("long").alias("fleets"))


PACK = """u AS (SELECT site, unit, distance, demand FROM arcs),
listed AS (SELECT site, f.fleet, list({{'d': distance, 'u': unit, 'q': demand}} ORDER BY distance, unit) AS us FROM u, (VALUES (1), (5), (10)) f(fleet) GROUP BY ALL),
packed AS (SELECT site, fleet, fleet * 20.0::DOUBLE AS capacity, list_reduce(list_prepend({{'d': 0.0::DOUBLE, 'u': 0::BIGINT, 'q': 0.0::DOUBLE}}, us),
  lambda s, x: CASE WHEN x.q <= fleet * 20.0::DOUBLE - s.q + 1e-9 THEN {{'d': s.d + x.d, 'u': s.u + 1, 'q': s.q + x.q}} ELSE s END) AS r FROM listed)"""


def _packed(spark, sf):
    u = arcs(spark, sf).withColumn("fleet", F.explode(F.array(F.lit(1), F.lit(5), F.lit(10))))
    return tanker.pack_units(u, ["site", "fleet"], ["distance", "unit"], "demand", F.col("fleet") * 20.0, "distance")


@query(f"WITH {ARCS}, {PACK.replace('{{', '{').replace('}}', '}')} SELECT site, fleet, capacity, r.q AS delivered, round(r.d, 2) AS served, r.u AS units FROM packed")
def greedy_unit_packing(spark, sf):
    return _packed(spark, sf).withColumn("served", F.round("served", 2))


@query(f"""WITH {ARCS}, {PACK.replace('{{', '{').replace('}}', '}')}, t AS (SELECT site, sum(demand) AS total FROM arcs GROUP BY 1)
SELECT site, fleet, round(r.q / total, 6) AS share, round((r.q / total - lag(r.q / total) OVER w) / (fleet - lag(fleet) OVER w) * 100, 6) AS marginal_gain FROM packed JOIN t USING (site) WINDOW w AS (PARTITION BY site ORDER BY fleet)""")
def resource_curve_marginal_gain(spark, sf):
    t = arcs(spark, sf).groupBy("site").agg(F.sum("demand").alias("total"))
    w = Window.partitionBy("site").orderBy("fleet")
    d = _packed(spark, sf).join(t, "site").withColumn("share", F.col("delivered") / F.col("total"))
    gain = (F.col("share") - F.lag("share").over(w)) / (F.col("fleet") - F.lag("fleet").over(w)) * 100
    return d.withColumn("marginal_gain", F.round(gain, 6)).select("site", "fleet", F.round("share", 6).alias("share"), "marginal_gain")


@query(f"""WITH {ARCS}, {PACK.replace('{{', '{').replace('}}', '}')}, t AS (SELECT site, sum(demand) AS total FROM arcs GROUP BY 1)
SELECT site, round(max(r.q) FILTER (WHERE fleet = 10) / any_value(total), 6) AS baseline, round(greatest(0, max(r.q) FILTER (WHERE fleet = 10) - max(r.q) FILTER (WHERE fleet = 5)) / any_value(total) * 100, 6) AS loss_pp,
round(least(max(r.q) FILTER (WHERE fleet = 1), max(r.q) FILTER (WHERE fleet = 10)) / any_value(total), 6) AS combined FROM packed JOIN t USING (site) GROUP BY site""")
def robustness_summary(spark, sf):
    t = arcs(spark, sf).groupBy("site").agg(F.sum("demand").alias("total"))
    at = lambda k: F.max(F.when(F.col("fleet") == k, F.col("delivered")))
    d = _packed(spark, sf).groupBy("site").agg(at(10).alias("x"), at(5).alias("y"), at(1).alias("z")).join(t, "site")
    return d.select("site", F.round(F.col("x") / F.col("total"), 6).alias("baseline"), F.round(F.greatest(F.lit(0.0), F.col("x") - F.col("y")) / F.col("total") * 100, 6).alias("loss_pp"), F.round(F.least("x", "z") / F.col("total"), 6).alias("combined"))


@query(f"WITH {LOAD} SELECT site, round(load, 2) AS load, row_number() OVER (ORDER BY load DESC, site)::INT AS place FROM loads ORDER BY load DESC, site LIMIT 20")
def priority_top_n(spark, sf):
    top = _load(spark, sf).orderBy(F.desc("load"), "site").limit(20)
    return top.withColumn("place", F.row_number().over(Window.orderBy(F.desc("load"), "site"))).withColumn("load", F.round("load", 2))


@query()
def allocation_solution(spark, sf):
    cap = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site"), F.floor(F.abs("s_acctbal")).cast("double").alias("capacity"))
    return tanker.allocate(arcs(spark, sf), cap, "site", "unit", "demand", "distance")


# --- geometry

XY = "SELECT vec_id, label, embedding[1]::DOUBLE * 1000 AS x, embedding[2]::DOUBLE * 1000 AS y FROM embeddings"


def xy(spark, sf):
    e = lambda k: F.element_at("embedding", k).cast("double") * 1000
    return table(spark, sf, "embeddings").select("vec_id", "label", e(1).alias("x"), e(2).alias("y"))


@query(f"""WITH p AS ({XY}), j AS (SELECT a.vec_id AS pid, arg_min(b.vec_id, (sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2), b.vec_id)) AS nid, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS d
FROM p a JOIN p b ON b.label = 0 AND sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2) <= 25 WHERE a.label <> 0 GROUP BY 1) SELECT vec_id AS pid, nid, round(d, 6) AS distance FROM p LEFT JOIN j ON pid = vec_id WHERE label <> 0""")
def knn_snap(spark, sf):
    p = xy(spark, sf)
    got = geo.nearest_within(p.where("label <> 0").select(F.col("vec_id").alias("pid"), "x", "y"), p.where("label = 0").select(F.col("vec_id").alias("nid"), "x", "y"), 25.0)
    return got.withColumn("distance", F.round("distance", 6))


@query(f"WITH p AS ({XY}) SELECT a.vec_id AS pid, b.vec_id AS gid FROM p a JOIN p b ON b.label = 1 AND abs(a.x - b.x) + abs(a.y - b.y) < 20 WHERE a.label <> 1")
def point_in_polygon(spark, sf):
    p = xy(spark, sf)
    corner = lambda dx, dy: F.struct((F.col("x") + dx).alias("x"), (F.col("y") + dy).alias("y"))
    g = p.where("label = 1").select(F.col("vec_id").alias("gid"), F.array(corner(20, 0), corner(0, 20), corner(-20, 0), corner(0, -20)).alias("ring"))
    return geo.points_in_polygons(p.where("label <> 1").select(F.col("vec_id").alias("pid"), "x", "y"), g, 20.0)


# --- text, JSON, reshaping


@query(r"""SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, md5(props) AS props_md5 FROM events""")
def json_property(spark, sf):
    return table(spark, sf, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("bigint").alias("k"), F.md5("props").alias("props_md5"))


@query()
def html_text_chunks(spark, sf):
    return table(spark, sf, "pages").select("page_id", F.posexplode(text.html_chunks("html")).alias("place", "chunk"))


@query(r"""SELECT c_custkey, lpad(c_custkey % 12 || '', 2, '0') || ':30' AS opening, CASE WHEN c_custkey % 100 < 10 THEN NULL ELSE 1 END AS flag, ((c_custkey % 900 + 100) * 1000 + 234)::DOUBLE AS households FROM customer""")
def parsed_report_text(spark, sf):
    k = F.col("c_custkey")
    c = table(spark, sf, "customer").select("c_custkey", F.concat((k % 12).cast("string"), F.lit("：30 〜 "), (k % 12 + 3).cast("string"), F.lit(":00")).alias("t"), F.concat(F.lit("約 "), (k % 900 + 100).cast("string"), F.lit(".234 戸")).alias("h"))
    a, _ = text.time_range("t")
    return c.select("c_custkey", a.alias("opening"), F.when(k % 100 >= 10, 1).alias("flag"), text.household_count("h").alias("households"))


@query("""SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS since FROM events""")
def forward_fill_scanner(spark, sf):
    e = table(spark, sf, "events").withColumn("mark", F.when(F.col("event_type") == "purchase", F.col("event_id")))
    return text.forward_fill(e, ["user_id"], ["ts", "event_id"], "mark", "since").select("event_id", "since")


@query("""SELECT coalesce(a.k, b.k) AS k, a.n AS customers, b.n AS suppliers FROM (SELECT c_nationkey AS k, count(*) AS n FROM customer WHERE c_acctbal > 9000 GROUP BY 1) a
FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_acctbal > 0 GROUP BY 1) b ON a.k = b.k""")
def full_outer_units(spark, sf):
    a = table(spark, sf, "customer").where("c_acctbal > 9000").groupBy(F.col("c_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("customers"))
    b = table(spark, sf, "supplier").where("s_acctbal > 0").groupBy(F.col("s_nationkey").alias("k")).agg(F.count(F.lit(1)).alias("suppliers"))
    return a.join(b, "k", "full_outer")


@query("SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_returnflag = 'R' EXCEPT SELECT l_suppkey FROM lineitem WHERE l_quantity > 49.5")
def set_difference(spark, sf):
    r = table(spark, sf, "lineitem")
    return r.where("l_returnflag = 'R'").select(F.col("l_suppkey").alias("k")).distinct().join(r.where("l_quantity > 49.5").select(F.col("l_suppkey").alias("k")), "k", "left_anti")


@query("""SELECT column_name, n AS non_null, round((t - n) * 100.0::DOUBLE / t, 4) AS null_pct FROM (SELECT count(*) AS t, count(o_orderkey) AS o_orderkey, count(o_custkey) AS o_custkey, count(o_orderstatus) AS o_orderstatus, count(o_totalprice) AS o_totalprice,
count(o_orderdate) AS o_orderdate, count(o_orderpriority) AS o_orderpriority FROM orders) UNPIVOT (n FOR column_name IN (o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority))""")
def column_profile(spark, sf):
    return keys.column_profile(table(spark, sf, "orders"))


@query("""WITH m AS (SELECT l_returnflag AS f, count(*)::DOUBLE AS n, sum(l_quantity) AS q FROM lineitem GROUP BY 1) SELECT indicator, max(v) FILTER (WHERE f = 'A') AS "A", max(v) FILTER (WHERE f = 'N') AS "N", max(v) FILTER (WHERE f = 'R') AS "R"
FROM (SELECT f, 'n' AS indicator, n AS v FROM m UNION ALL SELECT f, 'q', q FROM m) GROUP BY indicator""")
def transpose_indicators(spark, sf):
    m = table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("f")).agg(F.count(F.lit(1)).cast("double").alias("n"), F.sum("l_quantity").alias("q"))
    return keys.transpose(m, "f", ["n", "q"], ["A", "N", "R"])


@query("""SELECT l_suppkey, coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'F'), 0) AS "F", coalesce(sum(l_quantity) FILTER (WHERE l_linestatus = 'O'), 0) AS "O" FROM lineitem GROUP BY 1""")
def pivot_volume(spark, sf):
    return table(spark, sf, "lineitem").groupBy("l_suppkey").pivot("l_linestatus", ["F", "O"]).agg(F.sum("l_quantity")).fillna(0.0)


# --- the audit of all linkages: what other queries link, record by record

AUDIT = (
    ("reporting units", "crosswalk_match_status", "match_status = 'exact'", "the official name, exactly", ()),
    ("cells by municipality", "cell_area_link", "link_status <> 'unmatched'", "the one area around its middle, else the largest overlap", ()),
    ("cells by road", "access_edge_interpolation", "distance IS NOT NULL", "an accepted snap, and an end of its edge that a source reaches", ()),
    ("groups of older people by road", "group_representative_access", "snap > 0", "the snap of its access row", ()),
    ("announced points", "resolved_locations", "location_status <> 'unresolved'", "a place of its own, or one that all facilities of its name share", ()),
    ("shelters", "shelter_ledger", "evacuees > 0", "evacuees in its ledger, three rows a shelter", ("shelter",)),
    ("staging sites by road", "network_snap", "accepted", "a node within the limit", ()),
    ("bases by road", "network_snap_distances", "accepted AND edge_id IS NOT NULL", "a node within the limit, and an edge there", ()),
    ("restrictions by road", "restriction_line_match", "status <> 'unmatched'", "an edge within the limits of a point or a line, or the nearest", ("oid",)),
)


@query(" UNION ALL ".join(f"""SELECT {place} AS place, '{name}' AS component, total, success, total - success AS unmatched, success / total::DOUBLE AS rate, '{rule}' AS rule FROM (SELECT count(*) AS total, count(*) FILTER (WHERE ok) AS success
FROM (SELECT {f"{', '.join(by)}, bool_or({ok}) AS ok" if by else f"{ok} AS ok"} FROM ({ORACLES[source]}) {f"GROUP BY {', '.join(by)}" if by else ''}))""" for place, (name, source, ok, rule, by) in enumerate(AUDIT)))
def linkage_coverage_audit(spark, sf):
    rows = {"restriction_line_match": facility_queries.matched_lines}  # a row an observation, not one for each of its edges
    linked = {"restriction_line_match": "matched"}
    return linkage.coverage_audit([linkage.Component(name, rows.get(source, QUERIES[source])(spark, sf), F.expr(linked.get(source, ok)), rule, by) for name, source, ok, rule, by in AUDIT])
