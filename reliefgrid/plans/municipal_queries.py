"""Registered queries of municipalities. Customers stand for cells (each seventeenth lies in no municipality), nations for municipalities
and orders for rows of their reports, a report a quarter."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from reliefgrid.operators import linkage, municipal
from reliefgrid.sources.storage import stored, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], ORACLES[f.__name__] = f, sql
        return f

    return add


LATEST = """reports AS (SELECT n_nationkey AS code, o_orderkey AS report, date_trunc('quarter', o_orderdate)::DATE AS status_time, floor(o_totalprice / 10)::DOUBLE AS most,
  (CASE WHEN c_nationkey % 6 = 0 THEN 0 WHEN c_nationkey % 7 = 1 THEN floor(o_totalprice) * 1000 ELSE floor(o_totalprice / 100) END)::DOUBLE AS out,
  o_orderkey % 7 + o_orderkey % 5 + o_orderkey % 3 AS tankers, o_orderkey % 7 AS tankers_ministry, o_orderkey % 5 AS tankers_waterworks, o_orderkey % 3 AS tankers_defence
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE n_nationkey % 5 <> 4),
latest AS (SELECT * FROM reports WHERE status_time = (SELECT max(status_time) FROM reports) QUALIFY row_number() OVER (PARTITION BY code ORDER BY report DESC) = 1)"""

TABLE = f"""{LATEST},
cells AS (SELECT c_custkey AS unit, CASE WHEN c_custkey % 17 > 0 THEN c_nationkey END AS code, CASE WHEN c_custkey % 17 > 0 THEN n_name END AS name,
  floor(abs(c_acctbal))::DOUBLE AS people, floor(abs(c_acctbal) / 3)::DOUBLE AS households FROM customer JOIN nation ON c_nationkey = n_nationkey),
h AS (SELECT cells.*, l.out AS observed, l.status_time AS reported_at, sum(households) OVER (PARTITION BY cells.code) AS gh FROM cells LEFT JOIN latest l USING (code)),
r AS (SELECT *, CASE WHEN code IS NOT NULL THEN households / nullif(gh, 0) END AS share, CASE WHEN code IS NOT NULL THEN coalesce(observed, 0) END AS out,
  CASE WHEN code IS NOT NULL AND gh <> 0 THEN least(greatest(coalesce(observed, 0) / gh, 0), 1) END AS ratio,
  CASE WHEN code IS NOT NULL THEN coalesce(reported_at, (SELECT max(status_time) FROM reports)) END AS snapshot_time,
  CASE WHEN code IS NULL THEN 'unmatched_geography' WHEN observed IS NULL THEN 'assumed_zero_no_official_outage_listing' WHEN observed > gh THEN 'reported_positive_ratio_capped'
    WHEN observed > 0 THEN 'reported_positive' ELSE 'reported_zero' END AS status FROM h),
c AS (SELECT code, people / households AS size, sum(households) OVER (PARTITION BY code ORDER BY people / households) AS c, sum(households) OVER (PARTITION BY code) AS t FROM r WHERE households > 0 AND code IS NOT NULL),
p AS (SELECT code, min(size) AS p90 FROM c WHERE c >= t * 0.9::DOUBLE GROUP BY code),
s AS (SELECT r.*, x.population_case, x.affected, y.demand_case, y.litres, x.affected * y.litres AS demand FROM r LEFT JOIN p USING (code),
  LATERAL (SELECT 'lower_one_person_per_household' AS population_case, CASE WHEN out * share IS NOT NULL THEN least(people, out * share) END AS affected
    UNION ALL SELECT 'proportional_central', people * ratio UNION ALL SELECT 'upper_p90_household_size', CASE WHEN out * share * p90 IS NOT NULL THEN least(people, out * share * p90) END) x,
  (VALUES ('minimum', 3.0::DOUBLE), ('basic', 10.0::DOUBLE), ('extended', 20.0::DOUBLE)) y(demand_case, litres)),
rolled AS (SELECT code, name, population_case, demand_case, litres, sum(people) AS people, sum(households) AS households, max(snapshot_time) AS snapshot_time, max(out) AS out,
  arg_min(status, unit) AS status, max(ratio) AS ratio, sum(affected) AS affected, sum(demand) AS demand FROM s GROUP BY ALL),
areas AS (SELECT n_nationkey AS code, 'area ' || n_regionkey AS geometry FROM nation WHERE n_nationkey % 7 < 6),
tab AS (SELECT rolled.* EXCLUDE (snapshot_time), geometry, report, coalesce(status_time, snapshot_time) AS status_time, most, tankers, tankers_ministry, tankers_waterworks, tankers_defence
  FROM rolled LEFT JOIN latest USING (code) LEFT JOIN areas USING (code))"""


def _latest(spark: SparkSession, sf: str) -> DataFrame:
    k, n, price = F.col("o_orderkey"), F.col("c_nationkey"), F.col("o_totalprice")
    nation = table(spark, sf, "nation").select(F.col("n_name").alias("unit"), F.col("n_nationkey").alias("n_nationkey"))
    o = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(nation, n == F.col("n_nationkey"))
    out = F.when(n % 6 == 0, F.lit(0)).when(n % 7 == 1, F.floor(price) * 1000).otherwise(F.floor(price / 100)).cast("double")
    reports = o.select("unit", k.alias("report"), F.trunc("o_orderdate", "quarter").alias("status_time"), F.floor(price / 10).cast("double").alias("most"), out.alias("out"), (k % 7 + k % 5 + k % 3).alias("tankers"), (k % 7).alias("tankers_ministry"), (k % 5).alias("tankers_waterworks"), (k % 3).alias("tankers_defence"))
    known = nation.where("n_nationkey % 5 <> 4").select("unit", F.col("n_nationkey").alias("code"))
    return municipal.latest_reports(reports, linkage.crosswalk(nation.select("unit"), known, [], []), ["unit"])


def _table(spark: SparkSession, sf: str) -> DataFrame:
    inside, b = F.col("c_custkey") % 17 > 0, F.abs("c_acctbal")
    c = table(spark, sf, "customer").join(table(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    cells = c.select(F.col("c_custkey").alias("unit"), F.when(inside, F.col("c_nationkey")).alias("code"), F.when(inside, F.col("n_name")).alias("name"), F.floor(b).cast("double").alias("people"), F.floor(b / 3).cast("double").alias("households"))
    areas = table(spark, sf, "nation").where("n_nationkey % 7 < 6").select(F.col("n_nationkey").alias("code"), F.concat(F.lit("area "), F.col("n_regionkey").cast("string")).alias("geometry"))
    latest = stored(_latest(spark, sf))  # a row a municipality, used three times
    return municipal.demand_table(municipal.municipal_roll_up(municipal.cell_scenarios(cells, latest)), latest, areas)


@query(f"WITH {LATEST} SELECT code, report, status_time, most, out, tankers, tankers_ministry, tankers_waterworks, tankers_defence FROM latest")
def latest_municipal_reports(spark, sf):
    return _latest(spark, sf)


@query(f"WITH {TABLE} SELECT * REPLACE (round(ratio, 9) AS ratio, round(affected, 3) AS affected, round(demand, 3) AS demand) FROM tab")
def municipal_demand_table(spark, sf):
    return _table(spark, sf).withColumn("ratio", F.round("ratio", 9)).withColumn("affected", F.round("affected", 3)).withColumn("demand", F.round("demand", 3))


@query(f"""WITH {TABLE} SELECT row_number() OVER (ORDER BY any_value(out) DESC, name, code) AS place, name, any_value(out) AS out, round(any_value(ratio), 9) AS ratio,
{', '.join(f"round(max(affected) FILTER (WHERE population_case = '{case}'), 3) AS {c}" for case, c in municipal.PEOPLE)},
{', '.join(f"round(max(demand) FILTER (WHERE population_case = 'proportional_central' AND demand_case = '{level}'), 3) AS {c}" for level, c in municipal.WATER)} FROM tab WHERE status = 'reported_positive' GROUP BY code, name""")
def positive_outage_table(spark, sf):
    d = municipal.positive_table(_table(spark, sf))
    return d.select("place", "name", "out", F.round("ratio", 9).alias("ratio"), *[F.round(c, 3).alias(c) for _, c in (*municipal.PEOPLE, *municipal.WATER)])
