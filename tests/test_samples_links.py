"""Anchors and linked reports, samples of columns, announced points in file order, agreement of reruns."""

import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import allocation, facilities, keys, reports
from reliefgrid.sources.storage import file_rows

PAGE = "page_id long, url string, html string"


def test_anchors(spark):
    html = """<!-- <a href="c.pdf">comment</a> --><script>var a = '<a href="s.pdf">s</a>'</script><a href="one.pdf">A <b>b</b>
  c</a><a name=x>no address</a><A HREF='../two.pdf?x=1#y'>&lt;2&gt;</A><a href="lost.pdf">never <a href="//other.example/z">closed</a><a href="http://[bad/x">bad</a><a href="">self</a><a href="end.pdf">open"""
    pages = spark.createDataFrame([(1, "https://h.example/a/b/i.html", html), (2, None, '<a href="r.pdf">r</a>'), (3, "https://h.example/", None), (4, "https://h.example/", ""), (None, "https://h.example/", "<p>none</p>")], PAGE)
    got = [(r.page_id, r.place, r.url, r.label) for r in reports.page_links(pages).orderBy("page_id", "place").collect()]
    h = "https://h.example/a/"
    assert got == [(1, 0, h + "b/one.pdf", "A b c"), (1, 1, h + "two.pdf?x=1#y", "<2>"), (1, 2, "https://other.example/z", "closed"), (1, 3, h + "b/i.html", "self"), (2, 0, "r.pdf", "r")]


def test_linked_reports(spark):
    u = "https://h.example/"
    rows = [
        (1, 0, u + "a.pdf", "気象 第3報"), (1, 1, u + "a.pdf", "状況 第 12 報"), (1, 2, u + "a.pdf", "状況 第13報"), (1, 3, u + "b.PDF?v=a", "状況"), (1, 4, u + "x?y=b.pdf", "状況"), (1, 5, u + "x#b.pdf", "状況"),
        (1, 6, u + "c.pdf", "状況 第７報"), (1, 7, u + "d.pdf", "震源 第123報"), (1, 8, u + "e.pdf;v=1", "状況 第0報"), (2, 0, u + "a.pdf", "状況 第1報"), (3, 0, u, None), (3, 1, None, "状況"),
    ]
    links = spark.createDataFrame(rows, "page_id long, place int, url string, label string").repartition(3)
    got = sorted((r.page_id, r.report_id, r.url.removeprefix(u)) for r in reports.linked_reports(links, ["状況", "震源"], "m").collect())
    assert got == [(1, "m_report_00", "e.pdf;v=1"), (1, "m_report_01", "b.PDF?v=a"), (1, "m_report_07", "c.pdf"), (1, "m_report_12", "a.pdf"), (1, "m_report_123", "d.pdf"), (2, "m_report_01", "a.pdf")]
    assert reports.linked_reports(links, [], "m").count() == 0


def test_column_samples(spark):
    rows = [(k, None if k < 5 else f"v|{k}\n", b"x" if k > 7 else None, None, "y" * 80) for k in range(9)]
    d = spark.createDataFrame(rows, "_row int, a string, b binary, c double, `long.text` string").withColumnRenamed("long.text", "d").repartition(4)
    got = {r.column_name: (r.type, r.non_null, r.null_pct, r.samples) for r in keys.column_samples(d, ["_row"]).collect()}
    long = "y" * 57 + "..."
    assert got == {"a": ("string", 4, 55.56, "v\\|5 , v\\|6 , v\\|7 "), "b": ("binary", 1, 88.89, "<binary>"), "c": ("double", 0, 100.0, ""), "d": ("string", 9, 0.0, ", ".join([long] * 3))}
    none = {r.column_name: (r.non_null, r.null_pct, r.samples) for r in keys.column_samples(d.where("false"), ["_row"], 1).collect()}
    assert none == dict.fromkeys("abcd", (0, None, ""))


def test_announced_points_keep_the_order_of_their_file(spark, tmp_path):
    water = [(f"p{k}" if k else None, None if k == 3 else k % 4 > 0 or k == 0, 50 - k if k != 5 else None, str(k * 1.5) if k != 7 else None) for k in range(30)]
    spark.createDataFrame(water, "name string, accepted boolean, node long, snap string").coalesce(1).write.parquet(str(tmp_path / "w"))
    nodes = spark.createDataFrame([(k,) for k in range(20, 51)] * 2, "node long")
    read = file_rows(spark, str(tmp_path / "w")).repartition(5)
    got = facilities.announced_points(read, nodes, ["_file", "_row"]).orderBy("index").collect()
    want = [r for r in water if r[1] and r[2] is not None]
    assert [(r["index"], r.site_id, r.name, r.node, r.connector, r.temporary) for r in got] == [(k, f"WATER::{k}", n, v, None if s is None else float(s), False) for k, (n, _, v, s) in enumerate(want)]
    assert facilities.announced_points(read.where("false"), nodes, ["_file", "_row"]).count() == 0
    with pytest.raises(Exception, match="unknown node"):
        facilities.announced_points(read, nodes.where("node < 40"), ["_file", "_row"]).collect()
    with pytest.raises(Exception, match="no number"):
        facilities.announced_points(read.withColumn("snap", F.lit("far")), nodes, ["_file", "_row"]).collect()


def test_agreement_of_reruns(spark):
    units = spark.createDataFrame([(k, k % 3 if k % 5 else None, 2.0, "served") for k in range(20)], "unit long, site long, demand double, status string")
    sites = spark.createDataFrame([(0, 7, 2, 9.0), (1, 7, 1, 9.0), (2, 8, 0, 9.0)], "site long, refill long, trips long, minutes double")
    vehicles = spark.createDataFrame([(7, 1), (8, 0)], "refill long, vehicles long")
    total = lambda v: spark.createDataFrame([(v, 40.0)], "delivered double, bound double")
    first = allocation.plan_parts((units, sites, vehicles, total(32.0)))
    same = allocation.plan_parts((units.repartition(6), sites.where("trips > 0"), vehicles, total(32.0 + 1e-9)))
    assert {r.part: (r.n, r.agrees) for r in keys.agreement(first, same).collect()} == {"assignments": (16, True), "routes": (2, True), "vehicles": (1, True), "delivered": (1, True)}
    other = allocation.plan_parts((units.withColumn("site", F.when(F.col("unit") == 4, 2).otherwise(F.col("site"))), sites, vehicles, total(33.0)))
    other.pop("vehicles")
    assert {r.part: r.agrees for r in keys.agreement(first, other).collect()} == {"assignments": False, "routes": True, "vehicles": False, "delivered": False}
