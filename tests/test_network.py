"""Searches part by part against Dijkstra: grids, hubs, cut-offs, several sources, isolated nodes, text nodes."""

import heapq
import random

import pytest
from pyspark.sql import functions as F

from reliefgrid.operators import network as N


def dijkstra(edges, seeds, cutoff=float("inf")):
    near = {}
    for a, b, w in edges:
        near.setdefault(a, []).append((b, w))
        near.setdefault(b, []).append((a, w))
    dist, heap = {}, []
    for node, d in seeds:
        if d <= cutoff and d < dist.get(node, float("inf")):
            dist[node] = d
            heapq.heappush(heap, (d, node))
    while heap:
        d, v = heapq.heappop(heap)
        if d > dist[v]:
            continue
        for u, w in near.get(v, []):
            if d + w <= cutoff and d + w < dist.get(u, float("inf")):
                dist[u] = d + w
                heapq.heappush(heap, (d + w, u))
    return dist


def grid(r, n):
    at = lambda i, j: i * n + j
    edges = [(at(i, j), at(i, j + 1), r.randint(1, 9) / 2) for i in range(n) for j in range(n - 1)]
    return edges + [(at(i, j), at(i + 1, j), r.randint(1, 9) / 2) for i in range(n - 1) for j in range(n)]


def graph(spark, edges):
    return N.build_graph(spark.createDataFrame([(int(a), int(b), float(w)) for a, b, w in edges], "x long, y long, w double"), "x", "y", "w")


@pytest.mark.parametrize("part_edges, cutoff", [(1 << 19, None), (400, None), (400, 15.0)])
def test_matrix_of_a_grid(spark, part_edges, cutoff):
    r = random.Random(3)
    edges = grid(r, 24) + [(10_000, k * 4, 3.5) for k in range(140)] + [(20_000, 20_001, 1.0)]  # a hub, and a part of its own
    split = N.split_graph(graph(spark, edges), "w", part_edges, 30)
    assert (split.homes is None) == (part_edges > 1000)
    if split.homes is not None:
        assert split.homes.where("node = 10000").count() > 1  # the hub's edges lie in several parts
        assert split.edges.groupBy("part").count().agg(F.max("count")).first()[0] < 1200
    starts = [("p", 0, 0.0), ("p", 575, 2.0), ("q", 300, 0.0), ("q", 300, 9.0), (None, 20_000, 0.5), ("far", 99_999, 1.0), ("late", 5, 99.0)]
    seeds = spark.createDataFrame(starts, "site string, node int, offset double")
    got = {(x.site, x.node): x.dist for x in N.nearest_distance(split, seeds, cutoff=cutoff, by=["site"]).collect()}
    want = {}
    for site in {s for s, *_ in starts}:
        found = dijkstra(edges, [(n, d) for s, n, d in starts if s == site], cutoff or float("inf"))
        want |= {(site, n): d for n, d in found.items()}
    assert got == want
    one = N.nearest_distance(split, seeds.where("site = 'p'").select("node", "offset"), cutoff=cutoff)
    assert {x.node: x.dist for x in one.collect()} == {n: d for (s, n), d in want.items() if s == "p"}


def test_rounds_are_parts_and_not_edges(spark):
    """A chain of 120 edges is crossed in fewer rounds."""
    edges = [(k, k + 1, 1.0) for k in range(120)]
    split = N.split_graph(graph(spark, edges), "w", 120, 24)
    assert split.parts == 2
    seeds = spark.createDataFrame([(0, 0, 0.0)], "source long, node long, dist double")
    found, rounds = N.search(split, seeds)
    assert {x.node: x.dist for x in found.collect()} == {k: float(k) for k in range(121)}
    assert rounds <= 30


def test_text_nodes_and_empty_graphs(spark):
    d = spark.createDataFrame([("a", "b", 1.0), ("b", "c", 2.0)], "x string, y string, w double")
    g = N.build_graph(d, "x", "y", "w")
    seeds = spark.createDataFrame([("a", 0.0), (None, 0.0), ("b", None)], "node string, offset double")
    assert {x.node: x.dist for x in N.nearest_distance(g, seeds).collect()} == {"a": 0.0, "b": 1.0, "c": 3.0}
    assert [tuple(x) for x in N.nearest_distance(g.where("false"), seeds).collect()] == [("a", 0.0)]
    assert N.nearest_distance(g, seeds.where("false")).collect() == []
    assert N.nearest_distance(g, seeds.where("false").withColumn("site", F.lit(1)), by=["site"]).collect() == []


def test_components_are_parts_of_their_own(spark):
    """Eight grids apart from each other: each lies in one part whole, several parts are used, and one round finds all."""
    r = random.Random(5)
    edges = [(1000 * g + a, 1000 * g + b, w) for g in range(8) for a, b, w in grid(r, 12)]
    split = N.split_graph(graph(spark, edges), "w", 1200, 16)
    assert split.open is None and split.parts > 2
    at = split.homes.groupBy(F.floor(F.col("node") / 1000).alias("g")).agg(F.count_distinct("part").alias("n"), F.count_distinct("node").alias("nodes"))
    assert [(x.n, x.nodes) for x in at.collect()] == [(1, 144)] * 8
    seeds = spark.createDataFrame([(g, 1000 * g + 5, 0.0) for g in range(8)] + [(0, 7000, 1.0), (3, 99_999, 2.0)], "source long, node long, dist double")
    found, rounds = N.search(split, seeds, 12.0, 8)
    assert rounds == 1
    want = {}
    for g in range(8):
        want |= {(g, n): d for n, d in dijkstra(edges, [(1000 * g + 5, 0.0)] + [(7000, 1.0)] * (g == 0) + [(99_999, 2.0)] * (g == 3), 12.0).items()}
    assert {(x.source, x.node): x.dist for x in found.collect()} == want


def test_a_part_is_searched_in_few_bytes_an_edge():
    import tracemalloc

    import numpy as np
    import pyarrow as pa

    rng = np.random.default_rng(1)
    a, b, w = rng.integers(0, 30000, 1 << 20), rng.integers(30000, 32000, 1 << 20), rng.integers(1, 51, 1 << 20).astype(float)
    edges = pa.table({"part": np.zeros(2 << 20, np.int32), "node": np.concatenate((a, b)), "to": np.concatenate((b, a)), "w": np.concatenate((w, w))})
    found = pa.table({"source": np.zeros(5, np.int64), "node": np.arange(30000, 30005), "dist": np.zeros(5), "old": np.zeros(5, bool)})
    tracemalloc.start()
    got = N._search_part(float("inf"))(edges, found)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got.num_rows == 32000 and most < 32 * edges.num_rows


def test_edges_of_whole_components_are_written_once_by_part(spark, monkeypatch):
    """The clusters of both ends are no columns of the edges, and a node of a whole component has one home."""
    written, write = [], N.stored
    monkeypatch.setattr(N, "stored", lambda df: written.append(df.columns) or write(df))
    edges = [(100 * c + k, 100 * c + k + 1, 1.0) for c in range(12) for k in range(20)]
    split = N.split_graph(graph(spark, edges), "w", 120, 8)
    assert split.open is None and split.parts > 1 and split.homes.count() == split.homes.select("node").distinct().count() == 12 * 21
    assert split.edges.join(split.homes.withColumnRenamed("part", "home"), "node").where("part <> home").isEmpty() and split.edges.count() == 480
    assert not [c for c in written if "w" in c and any("cluster" in x for x in c)]


def test_edges_go_to_as_many_tasks_as_there_are_cores_for(spark, monkeypatch):
    """And not to more with more sources and nodes; a task goes through its sources in slices."""
    from pyspark.sql.classic.dataframe import DataFrame

    groups, deal = [], DataFrame.repartitionByRange
    monkeypatch.setattr(DataFrame, "repartitionByRange", lambda d, *a: groups.append(a[0]) or deal(d, *a))
    monkeypatch.setattr(N, "TASK_CELLS", 300)
    edges = grid(random.Random(7), 12)
    split = N.split_graph(graph(spark, edges), "w")
    starts = [(k, k, 0.0) for k in range(144)] + [(144, 999, 1.0)]
    found = N.search(split, spark.createDataFrame(starts, "source long, node long, dist double"), 4.0, 145)[0]
    assert {(x.source, x.node): x.dist for x in found.collect()} == {(k, n): d for k in range(144) for n, d in dijkstra(edges, [(k, 0.0)], 4.0).items()} | {(144, 999): 1.0}
    assert groups and max(groups) <= 2 * spark.sparkContext.defaultParallelism


@pytest.mark.parametrize("part_edges, whole", [(1 << 19, None), (1200, 0), (300, 0)])
def test_ends_beyond_nodes(spark, part_edges, whole):
    """The least over an end's rows of distance and rest, in one part, in components of their own and in parts that share nodes."""
    r = random.Random(9)
    edges = [(1000 * g + a, 1000 * g + b, w) for g in range(3) for a, b, w in grid(r, 12)]
    split = N.split_graph(graph(spark, edges), "w", part_edges, 16, whole)
    rows = [(1000 * r.randrange(3) + r.randrange(144), f"u{k % 90}", r.choice([0.0, 0.5, 2.0])) for k in range(200)] + [(9999, "u0", 0.25), (9999, "alone", 0.0), (3, None, 0.0), (3, "u1", None)]
    starts = [("p", 5, 0.0), ("p", 1005, 1.0), ("q", 2100, 0.0), ("far", 9999, 0.5)]
    got = N.nearest_distance(split, spark.createDataFrame(starts, "site string, node long, offset double"), cutoff=9.0, by=["site"], ends=spark.createDataFrame(rows, "node long, end string, rest double"), most=8.0)
    want = {}
    for site in ("p", "q", "far"):
        found = dijkstra(edges, [(n, d) for s, n, d in starts if s == site], 9.0)
        for node, end, rest in rows:
            if end and rest is not None and node in found and found[node] + rest <= 8.0:
                want[site, end] = min(want.get((site, end), 99.0), found[node] + rest)
    assert len(want) > 20
    assert sorted((x.site, x.end, x.dist) for x in got.collect()) == sorted((s, e, d) for (s, e), d in want.items())


def test_shortest_edges_first(spark):
    """Of a graph that is too large for a task the shortest edges are searched first, and what they don't reach from there: a grid with long
    edges to a second grid, which has a seed of its own with an offset, a part that nothing reaches, and an offset below 0."""
    r = random.Random(13)
    edges = grid(r, 14) + [(1000 + a, 1000 + b, w + 3) for a, b, w in grid(r, 8)] + [(k, 1000 + k, 20.0) for k in range(5)] + [(5000, 5001, 1.0)]
    for starts, whole in (([(0, 0.0), (1063, 30.0), (77777, 2.0)], 600), ([(0, -2.0), (100, 1.0)], 1 << 12)):
        seeds = spark.createDataFrame(starts, "node long, offset double")
        got = N._nearest_anywhere(graph(spark, edges), seeds, "w", None, 0.0, whole)
        assert {x.node: x.dist for x in got.collect()} == dijkstra(edges, starts), (starts, whole)
