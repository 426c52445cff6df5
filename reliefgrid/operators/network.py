"""Road graphs and shortest distances: parts of a graph are searched whole, and only what leaves a part is exchanged.

A graph is edges (a, b, w) with a <= b, parallel edges brought to the least w. Nodes are dealt to parts of about PART_EDGES
edges: components that fit whole, and clusters of neighbours of larger ones. Parts of whole components are searched in one round,
and only by the sources that start there; a small graph is one part. With a cut-off, edges beyond it are left out first. A round gives each part the distances that other parts have found for its nodes,
and the part relaxes its edges by buckets of distance until nothing falls, for all sources of a slice at once. So rounds are as
many as the parts that a shortest path enters, and not as many as its edges; a round reads and writes the active parts'
distances only. Sources are dealt in slices, so that a task holds and gives TASK_CELLS distances at most (or one source's). The edges of a
node with more than a quarter of a part's edges lie with their other ends, and such a node's distance goes to all these parts.
Tables between rounds are written to the shared folder. Unreachable nodes have no row.

Parts that share nothing are searched by about as many tasks as there are cores for: each takes a part's edges once, packed, goes through
its sources slice by slice, and gives their rows as it finds them. A graph of REACH_EDGES edges within the cutoff is such a part.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.keys import number_rows
from reliefgrid.sources.storage import stored

#: Edges of a part (both ways), and distances (sources x nodes of the part) that a task holds.
PART_EDGES, TASK_CELLS = 1 << 21, 1 << 22
#: Edges (both ways, none beyond the cutoff) that a task holds whole, for all its sources.
REACH_EDGES = 1 << 24
#: A graph of one WHOLE-th of a part's edges is one part; components go together into parts of one CLOSED-th.
WHOLE, CLOSED = 4, 16
#: Nodes around one mark, about, and rounds in which marks spread.
CLUSTER, SPREAD = 512, 64
#: Edges that are relaxed in one pass.
PASS = 1 << 18


def build_graph(edges: DataFrame, a: str, b: str, *weights: str, closed: DataFrame | None = None, edge_id: str | None = None) -> DataFrame:
    """Edges without nulls and closed ones; of several weights each takes its own least."""
    if closed is not None:
        edges = edges.join(closed.select(edge_id).distinct(), edge_id, "left_anti")
    keep = edges.dropna(subset=[a, b, *weights])
    return keep.groupBy(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).agg(*[F.min(w).alias(w) for w in weights])


def eligible_edges(edges: DataFrame, nodes: DataFrame, a: str, b: str, available: str, eligible: str) -> DataFrame:
    """The edges that are available and eligible (unknown: no), and whose ends both are among the nodes (node, may repeat)."""
    known = nodes.select("node").where("node IS NOT NULL").distinct()
    kept = edges.where(F.col(available) & F.col(eligible))
    return kept.join(known, kept[a] == known["node"], "left_semi").join(known.withColumnRenamed("node", "node_"), F.col(b) == F.col("node_"), "left_semi")


class SplitGraph(NamedTuple):
    """edges: part, node, to, w (both ways), stored; homes: node, part, each part with edges from the node, or None if there is
    one part; parts, nodes: how many; open: the numbers from which on parts share nodes or edges with others (None: no part does)."""

    edges: DataFrame
    homes: DataFrame | None
    parts: int
    nodes: int
    open: int | None = None


def node_clusters(both: DataFrame, cluster: int = CLUSTER, spread: int = SPREAD) -> DataFrame:
    """node, cluster: clusters of neighbouring nodes, each named by one of its nodes. One node in `cluster`, by hash, is a mark;
    marks spread from node to node, the least mark first, for `spread` rounds at most; a node that none reaches is a cluster of
    its own."""
    # dealt by node once: each round shuffles the new marks, and not the edges
    parts = int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    both = both.select("node", "to").repartition(parts, "node").persist(StorageLevel.DISK_ONLY)
    nodes = both.select("node").distinct()
    mark = F.when(F.pmod(F.xxhash64("node"), F.lit(cluster)) == 0, F.col("node"))
    at = stored(nodes.select("node", mark.alias("mark"), mark.isNotNull().alias("new")))
    for _ in range(spread):
        got = at.where("new").select("node", "mark").join(both.select("node", "to"), "node").groupBy(F.col("to").alias("node")).agg(F.min("mark").alias("got"))
        took = F.col("mark").isNull() & F.col("got").isNotNull()
        at = stored(at.drop("new").join(got, "node", "left").select("node", F.coalesce("mark", "got").alias("mark"), took.alias("new")))
        if at.where("new").isEmpty():
            break
    both.unpersist()
    return at.select("node", F.coalesce("mark", "node").alias("cluster"))


def _components(pairs: DataFrame, rounds: int = SPREAD) -> tuple[DataFrame, bool]:
    """cluster, label: the same for clusters that pairs (c, d; both ways, and c with itself) connect, and whether that was reached in
    `rounds`; each round takes the least label of the neighbours, and then that label's own."""
    at = stored(pairs.select(F.col("c").alias("cluster"), F.col("c").alias("label")).distinct())
    for _ in range(rounds):
        least = pairs.join(at.select(F.col("cluster").alias("d"), "label"), "d").groupBy(F.col("c").alias("cluster")).agg(F.min("label").alias("least"))
        least = stored(least)
        now = least.join(least.select(F.col("cluster").alias("least"), F.col("least").alias("next")), "least").select("cluster", F.least("least", "next").alias("now"))
        now = stored(at.join(now, "cluster").select("cluster", F.least("label", "now").alias("label"), (F.col("now") < F.col("label")).alias("fell")))
        at = now.select("cluster", "label")
        if now.where("fell").isEmpty():
            return at, True
    return at, False


def split_graph(graph: DataFrame, weight: str = "w", part_edges: int = PART_EDGES, cluster: int = CLUSTER, whole: int | None = None) -> SplitGraph:
    """whole: up to how many edges (both ways) the graph is one part; one WHOLE-th of part_edges unless given."""
    both = graph.select(F.col("a").alias("node"), F.col("b").alias("to"), F.col(weight).cast("double").alias("w"))
    both = stored(both.union(both.select(F.col("to").alias("node"), F.col("node").alias("to"), "w")))
    n, nodes = both.agg(F.count(F.lit(1)), F.count_distinct("node")).first()
    if n <= (part_edges // WHOLE if whole is None else whole):
        return SplitGraph(both.select(F.lit(0).alias("part"), "node", "to", "w"), None, 1, nodes)
    parts, small = max(1, math.ceil(n / part_edges)), max(1, math.ceil(n * CLOSED / part_edges))
    degree = stored(both.groupBy("node").agg((F.count(F.lit(1)) > part_edges // 4).alias("hub")))
    hubs = degree.where("hub").select("node")  # marks don't spread over hubs, or all would be one cluster
    plain = both if hubs.isEmpty() else stored(both.join(hubs, "node", "left_anti").join(hubs.withColumnRenamed("node", "to"), "to", "left_anti").select("node", "to"))
    owner = stored(degree.join(node_clusters(plain, cluster), "node", "left").select("node", "hub", F.coalesce("cluster", "node").alias("cluster")))
    end = lambda c: owner.select(F.col("node").alias(c), F.col("cluster").alias(f"{c}_cluster"))
    # clusters of a node's neighbours, each once a node, before the node's own cluster is known
    near = both.select("node", "to").join(end("to"), "to").groupBy("node", "to_cluster").agg(F.count(F.lit(1)).alias("n"))
    pairs = stored(near.join(end("node"), "node").groupBy(F.col("node_cluster").alias("c"), F.col("to_cluster").alias("d")).agg(F.sum("n").alias("n")))
    own = pairs.groupBy("c").agg(F.sum("n").alias("n"))
    labels, known = _components(pairs.select("c", "d").union(own.select("c", F.col("c").alias("d"))))
    size = own.join(labels, F.col("c") == F.col("cluster")).groupBy("label").agg(F.sum("n").alias("n"))
    whole = (F.col("n") <= part_edges) & F.lit(known)
    # a hash of its own: that of marks is a multiple of `cluster`
    deal = lambda c, k: F.pmod(F.xxhash64(c, F.lit("part")), F.lit(k)).cast("int")
    # components that fit go into parts of their own; the clusters of others are dealt to parts after these
    dealt = stored(labels.join(size, "label").select("cluster", whole.alias("whole"), F.when(whole, deal("label", small)).otherwise(small + deal("cluster", parts)).alias("part")))
    far = dealt.where("NOT whole").isEmpty()
    if far and dealt.select("part").distinct().count() == 1:
        return SplitGraph(both.select(F.lit(0).alias("part"), "node", "to", "w"), None, 1, nodes)
    # a node's edges lie in its part; only a hub's, if it is of no whole component, ask for their other ends
    placed = stored(owner.join(dealt, "cluster").select("node", (F.col("hub") & ~F.col("whole")).alias("hub"), "part"))
    d = both.join(placed, "node")
    edges = d.where("NOT hub").select("part", "node", "to", "w")
    spread_ = placed.where("hub").select("node")
    if not spread_.isEmpty():
        to = placed.select(F.col("node").alias("to"), F.col("hub").alias("to_hub"), F.col("part").alias("to_part"))
        at = F.when(~F.col("to_hub"), F.col("to_part")).otherwise(small + F.pmod(F.xxhash64("node", "to"), F.lit(parts)).cast("int"))
        edges = edges.union(both.join(spread_, "node", "left_semi").join(to, "to").select(at.alias("part"), "node", "to", "w"))
    edges = stored(edges)
    if far:  # each node has one home
        homes = placed.select("node", "part")
        return SplitGraph(edges, homes, homes.select("part").distinct().count(), nodes, None)
    homes = stored(edges.select("node", "part").distinct())
    return SplitGraph(edges, homes, homes.select("part").distinct().count(), nodes, small)


def _by_node(code: np.ndarray, n: int, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where each node's edges begin when they stand by node and weight, and the edges in that order."""
    return np.concatenate(([0], np.cumsum(np.bincount(code, minlength=n)))), np.lexsort((w, code)).astype(np.int32)


def _within(first: np.ndarray, w: np.ndarray, v: np.ndarray, room: np.ndarray) -> np.ndarray:
    """How many of each node's edges, which stand by weight, are at most `room` long, or a hair more."""
    low, high = first[v], first[v + 1]
    room = room + 1e-9 * np.abs(room) + 1e-9
    for _ in range(int((high - low).max(initial=0)).bit_length()):
        mid = (low + high) >> 1
        more = (low < high) & (w[np.minimum(mid, len(w) - 1)] <= room)
        low, high = np.where(more, mid + 1, low), np.where(more, high, mid)
    return low - first[v]


def relax(first: np.ndarray, to: np.ndarray, w: np.ndarray, n: int, dist: np.ndarray, start: np.ndarray, cutoff: float) -> None:
    """Lowers dist, distances of sources x n nodes one after another, along edges (those of node v: first[v] to first[v + 1], by
    weight) until none falls. start: the places whose distance is new. Nearest buckets go first."""
    if not len(start):
        return
    width = (4 * float(np.median(w)) if len(w) else 0.0) if cutoff == float("inf") else cutoff / 16
    waits = np.zeros(len(dist), bool)
    waits[start] = True
    while len(start):
        d = dist[start]
        now = d <= d.min() + width
        cur, start = start[now], start[~now]
        waits[cur] = False
        many = first[cur % n + 1] - first[cur % n] if cutoff == float("inf") else _within(first, w, cur % n, cutoff - dist[cur])
        cuts = np.flatnonzero(np.diff(np.cumsum(many) // PASS)) + 1
        for piece, many in zip(np.split(cur, cuts), np.split(many, cuts), strict=True):
            v = piece % n
            e = np.arange(many.sum()) + np.repeat(first[v] - np.cumsum(many) + many, many)
            at, got = np.repeat(piece - v, many) + to[e], np.repeat(dist[piece], many) + w[e]
            less = (got < dist[at]) & (got <= cutoff)
            at, got = at[less], got[less]
            np.minimum.at(dist, at, got)
            at = np.unique(at)
            at = at[~waits[at]]
            waits[at] = True
            start = np.concatenate((start, at))


def _search_part(cutoff: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(edges: pa.Table, found: pa.Table) -> pa.Table:
        """found: source, node, dist, old. Gives what fell (or was new), by source and node."""
        if not found.num_rows:
            return pa.table({"part": pa.array([], pa.int32()), "source": pa.array([], pa.int64()), "node": pa.array([], found.schema.field("node").type), "dist": pa.array([], pa.float64())})
        ends = pa.chunked_array([*edges.column("node").chunks, *edges.column("to").chunks, *found.column("node").chunks]).combine_chunks().dictionary_encode()
        m, n, names = edges.num_rows, len(ends.dictionary), ends.dictionary
        code = ends.indices.to_numpy()  # 32 bits: a part's edges are the most that a task holds
        at, w = code[2 * m :].astype(np.int64), edges.column("w").to_numpy()
        first, order = _by_node(code[:m], n, w)
        to, w = code[m : 2 * m][order], w[order]
        del ends, code, order
        sources, s = np.unique(found.column("source").to_numpy(), return_inverse=True)
        d, old = found.column("dist").to_numpy(), found.column("old").to_numpy()
        by_source = np.argsort(s, kind="stable")
        s, at, d, old = s[by_source], at[by_source], d[by_source], old[by_source]
        held, out = max(1, TASK_CELLS // max(n, 1)), []
        for k in range(0, len(sources), held):  # of a slice's sources as many at once as TASK_CELLS holds
            now, own = slice(*np.searchsorted(s, [k, k + held])), sources[k : k + held]
            place, dist = (s[now] - k) * n + at[now], np.full(len(own) * n, np.inf)
            np.minimum.at(dist, place[old[now]], d[now][old[now]])
            before = dist.copy()
            np.minimum.at(dist, place[~old[now]], d[now][~old[now]])
            relax(first, to, w, n, dist, np.flatnonzero(dist < before), cutoff)
            fell = np.flatnonzero(dist < before)
            out.append((own[fell // n], fell % n, dist[fell]))
        source, node, dist = (np.concatenate(x) for x in zip(*out, strict=True))
        part = np.full(len(source), edges.column("part")[0].as_py() if m else -1, np.int32)
        return pa.table({"part": pa.array(part), "source": pa.array(source), "node": names.take(pa.array(node)), "dist": pa.array(dist)})

    return run


def _packed(edges: DataFrame, *columns: str) -> DataFrame:
    """edges (part, *columns) with arrays for columns: a row for each part among some thousands of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                b = batch.sort_by("part")
                part = b.column("part").to_numpy()
                begins = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
                at = pa.array(np.append(begins, len(part)).astype(np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(part[begins]), *[pa.ListArray.from_arrays(at, b.column(c)) for c in columns]], ["part", *columns])

    kinds = [f"`{c}` array<{edges.schema[c].dataType.simpleString()}>" for c in columns]
    return edges.select("part", *columns).mapInArrow(run, ", ".join(["part int", *kinds]))


def _search_whole(cutoff: float, ends: bool, most: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Of a part that shares nothing and some of its sources (rows of arrays: edges have `to`, ends have `end`, seeds have `source`; w is
    the edge's weight, the end's rest or the seed's distance) the distances, or with ends the least of distance and rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, dict[str, list]] = {k: {c: [] for c in ("node", "w", k)} for k in ("to", "end", "source")}
        for batch in batches:
            for k, columns in kept.items():
                own = batch.filter(batch.column(k).is_valid())
                for c, held in columns.items():
                    held.append(own.column(c).flatten())
        one = lambda k, c: pa.chunked_array(kept[k].pop(c))
        numbers = lambda k, c: one(k, c).to_numpy()
        node = {k: one(k, "node") for k in kept}
        if not len(node["source"]):
            return
        names = pa.compute.unique(pa.chunked_array([c for x in node.values() for c in x.chunks]))
        code = lambda x: pa.compute.index_in(x, value_set=names).to_numpy()
        n, w = len(names), numbers("to", "w")
        first, order = _by_node(code(node.pop("to")), n, w)
        to, w = code(one("to", "to"))[order], w[order]
        del order
        found_at = names
        if ends:
            rest = numbers("end", "w")
            at_first, order = _by_node(code(node.pop("end")), n, rest)
            end = one("end", "end").combine_chunks().dictionary_encode()
            end = end.combine_chunks() if isinstance(end, pa.ChunkedArray) else end
            of, rest, found_at = end.indices.to_numpy()[order].astype(np.int64), rest[order], end.dictionary
        place, d = code(node.pop("source")).astype(np.int64), numbers("source", "w")
        sources, s = np.unique(numbers("source", "source"), return_inverse=True)
        by_source = np.argsort(s, kind="stable")
        s, place, d = s[by_source], place[by_source], d[by_source]
        held = max(1, TASK_CELLS // n)
        for k in range(0, len(sources), held):
            now, own = slice(*np.searchsorted(s, [k, k + held])), sources[k : k + held]
            start, dist = (s[now] - k) * n + place[now], np.full(len(own) * n, np.inf)
            np.minimum.at(dist, start, d[now])
            relax(first, to, w, n, dist, np.unique(start), cutoff)
            found = np.flatnonzero(dist < np.inf)
            at, dist = found // n, dist[found]
            found = found % n
            if ends:
                many = _within(at_first, rest, found, most - dist)
                e = np.arange(many.sum()) + np.repeat(at_first[found] - np.cumsum(many) + many, many)
                at, dist, found = np.repeat(at, many), np.repeat(dist, many) + rest[e], of[e]
                order = np.lexsort((dist, found, at))
                at, dist, found = at[order], dist[order], found[order]
                least = np.append(True, (at[1:] != at[:-1]) | (found[1:] != found[:-1]))[: len(at)] & (dist <= most)
                at, dist, found = at[least], dist[least], found[least]
            yield pa.RecordBatch.from_arrays([pa.array(own[at]), found_at.take(pa.array(found)), pa.array(dist)], ["source", "node", "dist"])

    return run


def _search_closed(graph: SplitGraph, seeds: DataFrame, limit: float, ends: DataFrame | None, most: float) -> DataFrame:
    """(source, node, dist) in parts that share nothing, for seeds (source, node, dist); with ends (node, end, rest): (source, node: the
    end, dist). Each task has a part whole, so that a part goes to as many tasks as its share of the work is of the cores."""
    tasks = 2 * seeds.sparkSession.sparkContext.defaultParallelism
    homes = (lambda d: d.withColumn("part", F.lit(0))) if graph.homes is None else (lambda d: d.join(graph.homes, "node"))
    seeds_in = stored(homes(seeds))
    nodes = F.lit(graph.nodes) if graph.homes is None else F.col("n")
    work = seeds_in.groupBy("part").agg(F.count_distinct("source").alias("s"))
    work = work if graph.homes is None else work.join(graph.homes.groupBy("part").agg(F.count(F.lit(1)).alias("n")), "part")
    work = stored(work.select("part", "s", (F.col("s") * nodes).cast("double").alias("work")))
    total = work.agg(F.sum("work")).first()[0] or 1.0
    share = F.greatest(F.lit(1), F.least(F.col("s"), F.ceil(F.col("work") * tasks / F.lit(total)))).cast("long")
    slices = F.broadcast(work.select("part", share.alias("slices")))  # a row a part
    groups = max(1, work.agg(F.sum(share)).first()[0] or 1)
    kind = graph.edges.schema["node"].dataType.simpleString()
    none = lambda c, t: F.lit(None).cast(f"array<{t}>").alias(c)
    to_all = F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1)).alias("slice")
    own = "string" if ends is None else ends.schema["end"].dataType.simpleString()
    whole = lambda d, *c: stored(_packed(d, *c)).join(slices, "part").select("part", to_all, *c)
    rows = whole(graph.edges, "node", "to", "w").select("*", none("end", own), none("source", "long"))
    if ends is not None:
        rows = rows.union(whole(homes(ends.withColumnRenamed("rest", "w")), "node", "end", "w").select("part", "slice", "node", none("to", kind), "w", "end", none("source", "long")))
    place = F.pmod(F.xxhash64("source"), F.col("slices")).alias("slice")
    rows = rows.union(seeds_in.join(slices, "part").select("part", place, F.array("node"), none("to", kind), F.array("dist"), none("end", own), F.array("source")))
    dealt = rows.repartitionByRange(groups, "part", "slice")
    found = dealt.groupBy("part", "slice").applyInArrow(_search_whole(limit, ends is not None, most), f"source long, node {kind if ends is None else own}, dist double")
    if graph.homes is None:
        return found
    alone = seeds.join(graph.homes, "node", "left_anti")  # nodes without an edge
    if ends is None:
        return found.unionByName(alone)
    found = found.unionByName(_at_ends(alone, ends, most))
    # a source that starts in several parts may have an end in each
    several = not seeds_in.groupBy("source").agg(F.count_distinct("part").alias("k")).where("k > 1").isEmpty() or not alone.isEmpty()
    return found.groupBy("source", "node").agg(F.min("dist").alias("dist")) if several else found


def _at_ends(found: DataFrame, ends: DataFrame, most: float) -> DataFrame:
    d = found.join(ends, "node").groupBy("source", F.col("end").alias("node")).agg(F.min(F.col("dist") + F.col("rest")).alias("dist"))
    return d.where(F.col("dist") <= most)


def _slices(graph: SplitGraph, sources: int) -> DataFrame:
    """part, slices: in how many slices a part's sources are dealt, so that a task gives TASK_CELLS distances at most (or one source's)."""
    n = graph.homes.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    return stored(n.select("part", F.greatest(F.lit(1), F.ceil(F.lit(sources) * F.col("n") / TASK_CELLS)).cast("long").alias("slices")))


def search(graph: SplitGraph, seeds: DataFrame, cutoff: float | None = None, sources: int = 1, ends: DataFrame | None = None, most: float = math.inf) -> tuple[DataFrame, int]:
    """(source, node, dist) for seeds (source: long, node, dist), and the number of rounds. With ends (node, end, rest) instead of all nodes
    the ends, as node, with the least of distance and rest over their rows, if it is at most `most`."""
    kind = graph.edges.schema["node"].dataType.simpleString()
    limit = float("inf") if cutoff is None else float(cutoff)
    seeds = seeds.withColumn("node", F.col("node").cast(kind))
    if ends is not None:
        ends = ends.select(F.col("node").cast(kind).alias("node"), "end", F.col("rest").cast("double").alias("rest")).dropna()
    inbox = stored(seeds.groupBy("source", "node").agg(F.min("dist").alias("dist")).where(F.col("dist") <= limit))
    if inbox.isEmpty():
        return (inbox if ends is None else _at_ends(inbox, ends, most)), 0
    if graph.open is None:  # no part gives another anything: each source and node has one row
        return _search_closed(graph, inbox, limit, ends, most), 1
    homes = lambda d: d.join(graph.homes, "node")
    slices = F.broadcast(_slices(graph, sources))  # a row a part
    cut = lambda d: d.join(slices, "part").withColumn("slice", F.pmod("source", "slices"))
    first, fallen, rounds = inbox, [], 0
    while rounds == 0 or not inbox.isEmpty():
        rounds += 1
        new = stored(cut(homes(inbox)).select("part", "slice", "source", "node", "dist", F.lit(False).alias("old")))
        active = new.select(F.col("part").alias("part"), F.col("slice").alias("slice")).distinct()  # columns of their own
        if rounds > 1:
            # what a part has found itself, or been given in earlier rounds: its own rows of what fell
            have = cut(_union(fallen).groupBy("part", "source", "node").agg(F.min("dist").alias("dist")))
            new = new.union(have.join(active, ["part", "slice"], "left_semi").select("part", "slice", "source", "node", "dist", F.lit(True)))
        edges = graph.edges.join(F.broadcast(active), "part").select("part", "slice", "node", "to", "w")  # a row a task of the round
        by = ["part", "slice"]
        fell = edges.groupBy(*by).cogroup(new.groupBy(*by)).applyInArrow(_search_part(limit), f"part int, source long, node {kind}, dist double")
        fell = stored(fell)
        fallen.append(fell)
        out = fell.where(F.col("part") >= graph.open).join(graph.homes.withColumnRenamed("part", "home"), "node").where("home <> part")
        inbox = stored(out.groupBy("source", "node").agg(F.min("dist").alias("dist")))
    found = _union([first, *[d.select("source", "node", "dist") for d in fallen]]).groupBy("source", "node").agg(F.min("dist").alias("dist"))
    return (found if ends is None else _at_ends(found, ends, most)), rounds


def _union(tables: list[DataFrame]) -> DataFrame:
    out = tables[0]
    for t in tables[1:]:
        out = out.unionByName(t)
    return out


def nearest_distance(graph: DataFrame | SplitGraph, seeds: DataFrame, weight: str = "w", cutoff: float | None = None, by: list[str] = [], ends: DataFrame | None = None, most: float = math.inf) -> DataFrame:  # noqa: B006
    """(*by, node, dist): least distance from any seed (*by, node, offset); several seeds of a node start from the least offset.

    With `by`, each of its values is a search of its own: the source x node matrix, as rows within the cutoff. A graph that is
    searched several times can be given as split once.

    ends (node, end, rest): places beyond some nodes, such as units on an edge. Then (*by, end, dist) comes instead, the least of a
    node's distance (within the cutoff) and the rest over the end's rows, if that is at most `most`.
    """
    if isinstance(graph, SplitGraph):
        split = graph
    elif cutoff is None and not by:
        return _nearest_anywhere(graph, seeds, weight, ends, most)
    elif cutoff is None:
        split = split_graph(graph, weight)
    else:  # no way within the cutoff has an edge beyond it
        split = split_graph(graph.where(F.col(weight) <= cutoff), weight, whole=REACH_EDGES if by else None)
    name = "node" if ends is None else "end"
    start = seeds.select(*by, "node", F.col("offset").cast("double").alias("dist")).where("node IS NOT NULL AND dist IS NOT NULL")
    if not by:
        found = search(split, start.select(F.lit(0).cast("long").alias("source"), "node", "dist"), cutoff, 1, ends, most)[0]
        return found.select(F.col("node").alias(name), "dist")
    own = [f"by{k}_" for k in range(len(by))]  # whatever the caller's columns are called
    names = stored(number_rows(start.select(*[F.col(c).alias(o) for c, o in zip(by, own, strict=True)]).distinct(), own, "source"))
    same = [start[c].eqNullSafe(names[o]) for c, o in zip(by, own, strict=True)]
    found = search(split, start.join(names, same).select(names["source"], start["node"], start["dist"]), cutoff, names.count(), ends, most)[0]
    return found.join(names, "source").select(*[F.col(o).alias(c) for c, o in zip(by, own, strict=True)], F.col("node").alias(name), "dist")


def _nearest_anywhere(graph: DataFrame, seeds: DataFrame, weight: str, ends: DataFrame | None, most: float, whole: int | None = None) -> DataFrame:
    """`nearest_distance` without a cutoff, of one search. A graph of at most `whole` edges (both ways; REACH_EDGES unless given) is searched in one
    task. Of a larger one the shortest edges, `whole` of them, are: no way as long as the longest of these has another edge. What that
    reaches is final, and the other nodes are searched from there, over edges between them."""
    whole = REACH_EDGES if whole is None else whole
    edges = stored(graph.select("a", "b", F.col(weight).cast("double").alias("w")))
    start = stored(seeds.select("node", F.col("offset").cast("double").alias("dist")).where("node IS NOT NULL AND dist IS NOT NULL"))
    least = min(start.agg(F.min("dist")).first()[0] or 0.0, 0.0)

    def searched(split: SplitGraph, start: DataFrame, cutoff: float | None = None) -> DataFrame:
        return search(split, start.select(F.lit(0).cast("long").alias("source"), "node", "dist"), cutoff)[0].select("node", "dist")

    n = edges.count()
    if 2 * n <= whole:
        found = searched(split_graph(edges, whole=whole), start)
    else:
        upto = edges.agg(F.percentile_approx("w", F.lit(0.9 * whole / (2 * n)), F.lit(10000))).first()[0]
        if 2 * edges.where(F.col("w") <= upto).count() > whole:  # many edges are equal: those below
            upto = edges.where(F.col("w") < upto).agg(F.max("w")).first()[0]
        first = None
        if upto is not None and 2 * edges.where(F.col("w") <= upto).count() <= whole:
            first = stored(searched(split_graph(edges.where(F.col("w") <= upto), whole=whole), start, upto + least))
        if first is None or first.isEmpty():
            found = searched(split_graph(edges), start)
        else:
            known = first.select("node")
            open_ = stored(edges.select(F.col("a").alias("node")).union(edges.select("b")).distinct().join(known, "node", "left_anti"))
            at = lambda c: open_.select(F.col("node").alias(c), F.lit(True).alias(f"open_{c}"))
            left = stored(edges.join(at("a"), "a", "left").join(at("b"), "b", "left").where("open_a OR open_b"))
            side = lambda c, d: left.where(f"open_{c} IS NULL").select(F.col(c).alias("node"), F.col(d).alias("to"), "w")
            across = side("a", "b").union(side("b", "a")).join(first, "node").select(F.col("to").alias("node"), (F.col("dist") + F.col("w")).alias("dist"))
            again = across.union(start.join(known, "node", "left_anti").select("node", "dist"))
            found = first.union(searched(split_graph(left.where("open_a AND open_b").select("a", "b", "w"), whole=whole), again))
    if ends is None:
        return found
    return _at_ends(found.withColumn("source", F.lit(0)), ends, most).select(F.col("node").alias("end"), "dist")


def along_edge(from_dist: Column, to_dist: Column, length: Column, fraction: Column) -> Column:
    """Distance of a point on an edge: over the nearer end; one unreachable end leaves the other."""
    return F.least(from_dist + fraction * length, to_dist + (1 - fraction) * length)


def attach_unit_distance(units: DataFrame, edges: DataFrame, dist: DataFrame) -> DataFrame:
    """units (edge_id, fraction, snap, accepted) with `distance` over their access edges (edge_id, a, b, length); null if
    the snap isn't accepted or no end is reached."""
    d = lambda end: dist.select(F.col("node").alias(end), F.col("dist").alias(f"{end}_dist"))
    u = units.join(edges, "edge_id", "left").join(d("a"), "a", "left").join(d("b"), "b", "left")
    path = along_edge(F.col("a_dist"), F.col("b_dist"), F.col("length"), F.col("fraction")) + F.col("snap")
    return u.withColumn("distance", F.when(F.coalesce("accepted", F.lit(False)), path)).drop("a_dist", "b_dist")
