"""Geometry by grid cells: nearest points in cells and by a tree of cells, and points in polygons as equi-joins over cells."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.operators.polylines import MOST, BoxTree, box_distance, dealt_cells
from reliefgrid.sources.storage import stored

#: Times that the radius doubles up to the limit when a point's nearest node is sought, and pairs that a pass looks at.
RADII, PAIRS = 6, 1 << 22
#: Nodes of a cell that isn't split, and times that a cell is halved at most.
LEAF, HALVINGS = 256, 40


class CellTree:
    """Nodes (nid, x, y; of equal places the least nid) in a tree of square cells: cells of `width` and, of those with more than LEAF
    nodes, halves of halves; above them cells twice as wide, up to four that hold all. A cell is (level, cx, cy), widths being
    width * 2 ** level, with the box of its nodes. Level by level, each a table: `cells` (level, cx, cy, x0, y0, x1, y1, leaf)."""

    def __init__(self, nodes: DataFrame, width: float, leaf: int = LEAF):
        self.width = width
        at = nodes.where("x IS NOT NULL AND y IS NOT NULL AND nid IS NOT NULL").groupBy(F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y")).agg(F.min("nid").alias("nid"))
        at = self._at(at, 0).withColumn("level", F.lit(0))
        cell = ["level", "cx", "cy"]
        self.lowest, split = 0, []
        for k in range(HALVINGS):
            large = stored(at.where(F.col("level") == -k).groupBy(*cell).agg(F.count("nid").alias("n_")).where(F.col("n_") > leaf).select(*cell))
            if large.isEmpty():
                break
            split.append(large)
            down = self._at(at.join(large, cell, "left_semi"), -k - 1).withColumn("level", F.lit(-k - 1))
            at = stored(at.join(large, cell, "left_anti").unionByName(down))
            self.lowest = -k - 1
        self.nodes = stored(at)
        box = [F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1")]
        leaves = self.nodes.groupBy(*cell).agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max("x").alias("x1"), F.max("y").alias("y1")).withColumn("leaf", F.lit(True))
        self.levels: dict[int, DataFrame] = {}
        below = None
        level = self.lowest
        while True:
            own = leaves.where(F.col("level") == level) if level <= 0 else None
            if below is not None:
                up = below.groupBy(F.floor(F.col("cx") / 2).alias("cx"), F.floor(F.col("cy") / 2).alias("cy")).agg(*box).select(F.lit(level).alias("level"), "cx", "cy", "x0", "y0", "x1", "y1", F.lit(False).alias("leaf"))
                own = up if own is None else own.unionByName(up)
            below = self.levels[level] = stored(own)
            if level >= 0:
                x0, x1, y0, y1 = below.agg(F.min("cx"), F.max("cx"), F.min("cy"), F.max("cy")).first()
                if x0 is None or (x1 - x0 <= 1 and y1 - y0 <= 1):
                    break
            level += 1
        self.top = level

    def _at(self, df: DataFrame, level: int) -> DataFrame:
        w = self.width * 2.0**level
        return df.withColumn("cx", F.floor(F.col("x") / w)).withColumn("cy", F.floor(F.col("y") / w))

    def nearest(self, points: DataFrame) -> DataFrame:
        """pid, nid, distance: the nearest node of each point (pid, x, y: no nulls), ties to the smaller nid. From the top, a point keeps
        the cells that may be nearer than the farthest corner of the one that is best by that; no cell is looked at by its nodes
        before it is a leaf that may hold the nearest."""
        top = [tuple(r) for r in self.levels[self.top].select("cx", "cy").collect()]  # four at most
        start = F.array(*[F.struct(F.lit(a).cast("long").alias("cx"), F.lit(b).cast("long").alias("cy")) for a, b in top]) if top else F.array().cast("array<struct<cx: bigint, cy: bigint>>")
        open_ = points.select("pid", F.col("x").cast("double").alias("px"), F.col("y").cast("double").alias("py"), F.lit(math.inf).alias("most"), F.explode(start).alias("c")).select("pid", "px", "py", "most", "c.cx", "c.cy")
        leaves = []
        for level in range(self.top, self.lowest - 1, -1):
            d = open_.join(self.levels[level].drop("level"), ["cx", "cy"])
            side = lambda c, lo, hi: F.greatest(F.lit(0.0), F.col(lo) - F.col(c), F.col(c) - F.col(hi))
            far = lambda c, lo, hi: F.greatest(F.abs(F.col(c) - F.col(lo)), F.abs(F.col(c) - F.col(hi)))
            d = d.withColumn("near", F.hypot(side("px", "x0", "x1"), side("py", "y0", "y1"))).withColumn("far", F.hypot(far("px", "x0", "x1"), far("py", "y0", "y1")))
            d = d.withColumn("most", F.least(F.col("most"), F.min("far").over(Window.partitionBy("pid")))).where(F.col("near") <= F.col("most") * (1 + 1e-12))
            d = stored(d.select("pid", "px", "py", "most", "near", "cx", "cy", "leaf"))
            leaves.append(d.where("leaf").select("pid", "px", "py", "near", F.lit(level).alias("level"), "cx", "cy", "most"))
            kid = F.array(*[F.struct((F.col("cx") * 2 + a).alias("cx"), (F.col("cy") * 2 + b).alias("cy")) for a in (0, 1) for b in (0, 1)])
            open_ = d.where("NOT leaf").select("pid", "px", "py", "most", F.explode(kid).alias("c")).select("pid", "px", "py", "most", "c.cx", "c.cy")
        found = leaves[0]
        for d in leaves[1:]:
            found = found.unionByName(d)
        found = found.withColumn("most", F.min("most").over(Window.partitionBy("pid"))).where(F.col("near") <= F.col("most") * (1 + 1e-12))
        d = found.join(self.nodes, ["level", "cx", "cy"]).select("pid", "nid", F.hypot(F.col("px") - F.col("x"), F.col("py") - F.col("y")).alias("distance"))
        return d.groupBy("pid").agg(F.min(F.struct("distance", "nid")).alias("b")).select("pid", F.col("b.nid").alias("nid"), F.col("b.distance").alias("distance"))


def nearest_node(points: DataFrame, nodes: DataFrame, limit: float, leaf: int = LEAF) -> DataFrame:
    """points (pid, x, y) with the nearest node (nid, x, y) however far it is, ties to the smaller nid, and `accepted`, whether it is
    within the limit. A point without coordinates, or without any node, has nulls. pid: one row each.

    Points search a tree of cells from its top; cells with many nodes are halved, so that no task holds a dense place whole.
    """
    tree = CellTree(nodes, limit, leaf)
    whole = points.where("x IS NOT NULL AND y IS NOT NULL").select("pid", "x", "y")
    found = tree.nearest(whole)
    return points.select("pid").join(found, "pid", "left").select("pid", "nid", "distance", (F.col("distance") <= limit).alias("accepted"))


def _nearest_in(limit: float) -> Callable[[pa.Table, pa.Table], pa.Table]:
    def run(a: pa.Table, b: pa.Table) -> pa.Table:
        """Of a group's points (a) and nodes (b) each point's nearest node. The radius doubles until a point has a node within it."""
        place = lambda d: np.stack([d.column(c).to_numpy() for c in "xyxy"], 1)
        p, n = place(a), place(b)
        order = pa.compute.sort_indices(b.column("nid")).to_numpy()
        rank = np.empty(len(n), np.int64)
        rank[order] = np.arange(len(n))
        best, who = np.full(len(p), np.inf), np.full(len(p), -1)
        tree = BoxTree(n) if len(n) else None
        for k in range(RADII, -1, -1) if tree else ():
            for at in np.array_split(np.flatnonzero(who < 0), 1 + len(p) * len(n) // PAIRS if k == 0 else 1 + len(p) // 1024):
                i, j = tree.within(p[at], limit / 2**k)
                i = at[i]
                d = box_distance(p[i], n[j])
                o = np.lexsort((rank[j], d, i))
                o = o[np.append(True, i[o][1:] != i[o][:-1])] if len(o) else o
                best[i[o]], who[i[o]] = d[o], j[o]
        got = np.flatnonzero(who >= 0)
        return pa.table([a.column("pid").take(pa.array(got)), b.column("nid").take(pa.array(who[got])), pa.array(best[got])], names=["pid", "nid", "distance"])

    return run


def nearest_within(points: DataFrame, nodes: DataFrame, limit: float, most: int = MOST) -> DataFrame:
    """points (pid, x, y) with the nearest node (nid, x, y) within the limit, ties to the smaller nid; else null. Places that aren't finite
    are none.

    Cells are two limits wide, and a node stands in all that it is within the limit of. A task gives a row for each of its points,
    not for each pair; a cell of more than `most` points or nodes is dealt in blocks.
    """
    w = 2 * limit
    finite = lambda d, key: d.where(F.abs(F.col("x") + F.col("y")) < math.inf).select(key, F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    p = stored(finite(points, "pid").withColumn("cx", F.floor(F.col("x") / w)).withColumn("cy", F.floor(F.col("y") / w)))
    span = lambda c: F.explode(F.sequence(F.floor((F.col(c) - limit) / w), F.floor((F.col(c) + limit) / w)))
    n = stored(finite(nodes.where("nid IS NOT NULL"), "nid").withColumn("cx", span("x")).withColumn("cy", span("y")))
    kind = [d.schema[k].dataType.simpleString() for d, k in ((p, "pid"), (n, "nid"))]
    by = ["cx", "cy", "lb", "rb"]
    l, r = dealt_cells(p, n, (["pid"], ["nid"]), most)
    met = l.groupBy(*by).cogroup(r.groupBy(*by)).applyInArrow(_nearest_in(limit), f"pid {kind[0]}, nid {kind[1]}, distance double")
    best = met.groupBy("pid").agg(F.min(F.struct("distance", "nid")).alias("b"))
    return points.join(best, "pid", "left").select("pid", F.col("b.nid").alias("nid"), F.col("b.distance").alias("distance"))


def in_ring(x: Column, y: Column, ring: Column) -> Column:
    """Ray casting over an array of (x, y), each the edge's start to the next one."""
    n = F.size(ring)
    at = lambda i: F.element_at(ring, (F.pmod(i, n) + 1).cast("int"))

    def crosses(i):
        a, b = at(i), at(i + 1)
        return ((a["y"] > y) != (b["y"] > y)) & (x < F.try_divide((b["x"] - a["x"]) * (y - a["y"]), b["y"] - a["y"]) + a["x"])

    return F.size(F.filter(F.sequence(F.lit(0), n - 1), crosses)) % 2 == 1


def points_in_polygons(points: DataFrame, polygons: DataFrame, cell: float) -> DataFrame:
    """(pid, gid) for each point (pid, x, y) inside a polygon (gid, ring: array of x, y)."""
    low = lambda c: F.floor(F.array_min(F.transform("ring", lambda v: v[c])) / cell)
    high = lambda c: F.floor(F.array_max(F.transform("ring", lambda v: v[c])) / cell)
    g = polygons.withColumn("cx", F.explode(F.sequence(low("x"), high("x")))).withColumn("cy", F.explode(F.sequence(low("y"), high("y"))))
    p = points.withColumn("cx", F.floor(F.col("x") / cell)).withColumn("cy", F.floor(F.col("y") / cell))
    return p.join(g, ["cx", "cy"]).where(in_ring(F.col("x"), F.col("y"), F.col("ring"))).select("pid", "gid")


def overlap_area(a: Column, b: Column) -> Column:
    """Of two boxes (x0, y0, x1, y1)."""
    side = lambda lo, hi: F.greatest(F.lit(0.0), F.least(a[hi], b[hi]) - F.greatest(a[lo], b[lo]))
    return side("x0", "x1") * side("y0", "y1")
