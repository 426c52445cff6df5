"""SimHash near-dedup: fingerprints of word shingles, and groups of fingerprints within a Hamming radius, found in BK-trees.

A document's fingerprint has bit k set if over half of its shingles' XXH64 have it; documents with equal fingerprints are
one entry from here on.

1. Two fingerprints that differ in at most `radius` bits agree in one of radius + 1 bands of bits at least. An entry stands
   in a bucket for each band; a bucket of more than MOST entries is dealt again, by bands of its remaining bits. So a search
   is about as long as the entries that agree with it in a band, and not as long as the corpus.
2. Buckets are gathered in shards by hash. A shard's BK-trees (one a bucket: children are keyed by the Hamming distance to
   their parent) are built once, packed in one row, and stored.
3. A shard's tree is sent to every task that searches a slice of its entries: one, or more as its buckets' work asks. A
   search enters children whose edge differs from its own distance to the parent by no more than the radius, and skips
   subtrees of which all nodes are in its own group already. A task joins the groups it finds as it goes, so that a
   bucket of n variants gives fewer than n links.

The size of a shard is bounded by MOST and SHARD but for buckets that all bands have dealt (at most 2^20 entries for a radius
of 3); trees go to the tasks of their shard and aren't broadcast to all executors, for all trees have no bound.

Nulls: a null text, and one without words, has no shingles and fingerprint 0, which links like any other. A row without a
doc_id is a document like others, with a null doc_id; a component_id is the least doc_id that a row has, null if no row of
the component has one. Rows that repeat a doc_id are rows of their own. Ties have no influence. An empty table gives an
empty table. Other columns are not read. Texts are never cut.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import chunks, materialize, row_keys, signed
from reliefgrid.llm.links import components

SEED = 42
#: Shingles whose bits are counted in one numpy pass.
SLICE = 1 << 16
#: Entries of a bucket beyond which it is dealt again, and of a shard's buckets together, about.
MOST, SHARD = 4096, 2048
#: Times that a bucket is dealt at most.
LEVELS = 3
#: Pairs of searches and nodes that a task holds at once; about those that one task looks at.
FRONTIER, TASK_PAIRS = 1 << 21, 1 << 29
_hash = functools.partial(xxhash.xxh64_intdigest, seed=SEED)


def fingerprint(text: str | None, n: int = 3) -> int:
    """The fingerprint of one text, unsigned."""
    words = (text or "").encode().lower().split()  # of bytes: A-Z alone, and the six blanks
    if not words:
        return 0
    shingles = map(b" ".join, zip(*[words[k:] for k in range(n)], strict=False)) if len(words) >= n else [b" ".join(words)]
    hashes = np.fromiter(map(_hash, shingles), np.uint64)
    bits = np.zeros(64, np.int64)
    for at in range(0, len(hashes), SLICE):
        part = hashes[at : at + SLICE].astype("<u8").view(np.uint8).reshape(-1, 8)
        bits += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, n: int = 3) -> DataFrame:
    """doc_id, fp (the fingerprint as a signed long) for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            found = np.fromiter((fingerprint(t, n) for t in batch.column("text").to_pylist()), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(signed(found))], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


# --- bands


def band_masks(radius: int, levels: int = LEVELS) -> list[int]:
    """The bits that agree within a bucket, by band. Band b is dealt again into bands (radius + 1) * (b + 1) + j."""
    parts, masks = radius + 1, []

    def cut(held: int) -> list[int]:
        free = [k for k in range(64) if not held >> k & 1]
        return [held | sum(1 << k for k in free[j * len(free) // parts : (j + 1) * len(free) // parts]) for j in range(parts)]

    level = [0]
    for _ in range(levels):
        level = [m for held in level for m in cut(held)]
        masks += level
    return masks


def _dealt(entries: DataFrame, bands: Column, masks: list[int]) -> DataFrame:
    """fp, band, key: a row for each of an entry's bands."""
    mask = F.array(*[F.lit(m - (1 << 64) if m >> 63 else m) for m in masks])
    return entries.select("fp", F.explode(bands).alias("band")).select("fp", "band", F.col("fp").bitwiseAND(F.element_at(mask, F.col("band") + 1)).alias("key"))


def buckets(entries: DataFrame, radius: int, most: int = MOST, levels: int = LEVELS) -> DataFrame:
    """fp, band, key: entries (fp) by buckets (band, key), such that any two within the radius meet in one."""
    parts, masks = radius + 1, band_masks(radius, levels)
    out = _dealt(entries, F.sequence(F.lit(0), F.lit(radius)), masks)
    first = 0
    for _ in range(levels - 1):
        large = materialize(out.where(F.col("band") >= first).groupBy("band", "key").agg(F.count("fp").alias("n")).where(F.col("n") > most).select("band", "key"))
        if large.isEmpty():
            break
        again = out.join(large, ["band", "key"], "left_semi").select("fp", ((F.col("band") + 1) * parts).alias("to"))
        again = _dealt(again.withColumn("bands", F.sequence(F.col("to"), F.col("to") + radius)), F.col("bands"), masks)
        out = materialize(out.join(large, ["band", "key"], "left_anti").unionByName(again))
        first = (first + 1) * parts
    return out


# --- trees


class Forest(NamedTuple):
    """BK-trees of a shard's buckets, level by level: children of a node are neighbours, by rising edge."""

    fp: np.ndarray
    parent: np.ndarray
    edge: np.ndarray
    #: Of each node's tree: the root, and how many nodes it has.
    root: np.ndarray
    size: np.ndarray

    def pack(self) -> list[bytes]:
        return [self.fp.tobytes(), self.parent.astype(np.int32).tobytes(), self.edge.astype(np.uint8).tobytes(), self.root.astype(np.int32).tobytes()]

    @staticmethod
    def unpack(fp: bytes, parent: bytes, edge: bytes, root: bytes) -> Forest:
        of = np.frombuffer(root, np.int32).astype(np.int64)
        return Forest(np.frombuffer(fp, np.uint64), np.frombuffer(parent, np.int32).astype(np.int64), np.frombuffer(edge, np.uint8).astype(np.int64), of, np.bincount(of, minlength=len(of))[of])


def plant(fp: np.ndarray, bucket: np.ndarray) -> Forest:
    """The BK-trees of all buckets at once, a level at a time. Entries of a bucket are distinct; buckets of one entry have no tree."""
    order = np.lexsort((fp, bucket))
    fp, bucket = fp[order], bucket[order]
    start = np.append(True, bucket[1:] != bucket[:-1]) if len(fp) else np.zeros(0, bool)
    tree = np.cumsum(start) - 1
    keep = np.bincount(tree)[tree] > 1 if len(fp) else start
    fp, tree = fp[keep], np.unique(tree[keep], return_inverse=True)[1]
    left, group = np.arange(len(fp)), tree
    parents = np.full(int(tree[-1]) + 1 if len(fp) else 0, -1)
    edges = np.zeros(len(parents), np.int64)
    nodes, up, by, of, placed = [], [], [], [], 0
    while len(left):
        first = np.append(True, group[1:] != group[:-1])
        head = left[first]
        nodes.append(fp[head])
        up.append(parents)
        by.append(edges)
        of.append(tree[head])
        far = np.bitwise_count(fp[left[~first]] ^ fp[head[group[~first]]]).astype(np.int64)
        key = group[~first] * 65 + far
        order = np.argsort(key, kind="stable")
        left, key = left[~first][order], key[order]
        new, group = np.unique(key, return_inverse=True)
        parents, edges = placed + new // 65, new % 65
        placed += len(head)
    if not nodes:
        none = np.zeros(0, np.int64)
        return Forest(none.view(np.uint64), none, none, none, none)
    root = np.concatenate(of)  # trees are numbered as their roots, which come first
    return Forest(np.concatenate(nodes), np.concatenate(up), np.concatenate(by), root, np.bincount(root)[root])


class Groups:
    """Joined groups of a forest's nodes; those that an edge within the radius joins to their parent are joined from the start."""

    def __init__(self, forest: Forest, radius: int):
        self.forest = forest
        self.of = np.arange(len(forest.fp))
        self.own = np.flatnonzero((forest.parent >= 0) & (forest.edge <= radius))
        self.join(self.own, forest.parent[self.own])

    def join(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of the pairs (a, b) joined two groups; the least node of a group names it."""
        up, made = {}, np.zeros(len(a), bool)

        def top(x: int) -> int:
            while (y := up.get(x, x)) != x:
                up[x] = x = up.get(y, y)
            return x

        for k, (x, y) in enumerate(zip(self.of[a].tolist(), self.of[b].tolist(), strict=True)):
            x, y = top(x), top(y)
            if x != y:
                made[k] = True
                up[max(x, y)] = min(x, y)
        if up:
            to = np.arange(len(self.of))
            low = np.fromiter(up, np.int64, len(up))
            to[low] = [top(x) for x in low.tolist()]
            self.of = to[self.of]
        self._mark()
        return made

    def _mark(self) -> None:
        """even: nodes whose subtree is all of one group."""
        parent, self.even = self.forest.parent, np.ones(len(self.of), bool)
        odd = np.flatnonzero((parent >= 0) & (self.of != self.of[parent]))
        while len(odd):
            above = np.unique(parent[odd])
            above = above[self.even[above]]
            self.even[above] = False
            odd = above[parent[above] >= 0]


def search(forest: Forest, radius: int, part: int = 0, parts: int = 1) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (two arrays of fingerprints) that join what is within the radius, for each part-th of parts of the nodes."""
    groups = Groups(forest, radius)
    fp, parent = forest.fp, forest.parent
    if part == 0:
        yield fp[groups.own], fp[parent[groups.own]]
    key = np.where(parent >= 0, parent * 128 + forest.edge, -1)
    inner = np.zeros(len(fp), bool)
    inner[parent[parent >= 0]] = True
    asked = np.arange(part, len(fp), parts)
    step = np.cumsum(forest.size[asked]) // FRONTIER
    for some in np.split(asked, np.flatnonzero(np.diff(step)) + 1):
        # the nodes of a level that a search meets, with the node that searches
        q, at = some, forest.root[some]
        found = []
        while len(q):
            differ = groups.of[q] != groups.of[at]
            open_ = differ | ~groups.even[at]
            q, at, differ = q[open_], at[open_], differ[open_]
            far = np.bitwise_count(fp[q] ^ fp[at]).astype(np.int64)
            hit = (far <= radius) & differ
            if hit.any():
                found.append(np.unique(np.stack((groups.of[q[hit]], groups.of[at[hit]], q[hit], at[hit])), axis=1))
            down = inner[at]
            q, at, far = q[down], at[down], far[down]
            lo = np.searchsorted(key, at * 128 + np.maximum(far - radius, 0))
            hi = np.searchsorted(key, at * 128 + far + radius, "right")
            many = hi - lo
            q = np.repeat(q, many)
            at = np.arange(len(q)) - np.repeat(np.cumsum(many) - many, many) + np.repeat(lo, many)
        if found:
            x = np.concatenate(found, axis=1)
            lo, hi = np.minimum(x[0], x[1]), np.maximum(x[0], x[1])
            pick = np.unique(lo * len(fp) + hi, return_index=True)[1]
            a, b = x[2][pick], x[3][pick]
            made = groups.join(a, b)
            yield fp[a[made]], fp[b[made]]


TREE = "shard long, slices int, fp binary, parent binary, edge binary, root binary"


def _build(table: pa.Table) -> pa.Table:
    band, key = table.column("band").to_numpy(), table.column("key").to_numpy()
    bucket = np.unique(np.stack((band.astype(np.int64), key)), axis=1, return_inverse=True)[1].ravel()
    forest = plant(table.column("fp").to_numpy().view(np.uint64), bucket)
    slices = 1 + int(forest.size.sum()) // TASK_PAIRS
    columns = [pa.array([x], pa.binary()) for x in forest.pack()]
    return pa.table([table.column("shard").slice(0, 1), pa.array([slices], pa.int32()), *columns], names=["shard", "slices", "fp", "parent", "edge", "root"])


def trees(entries: DataFrame, radius: int, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """A row for each shard with its packed trees, and in how many slices it is to be searched. entries: fp, distinct, stored."""
    shards = max(1, entries.count() * (radius + 1) // shard)
    dealt = buckets(entries, radius, most).withColumn("shard", F.pmod(F.xxhash64("band", "key"), F.lit(shards).cast("long")))
    return dealt.groupBy("shard").applyInArrow(_build, TREE)


def near_links(entries: DataFrame, radius: int = 3, most: int = MOST, shard: int = SHARD) -> DataFrame:
    """a, b: links between fingerprints (fp, distinct, stored) within the radius, enough of them to join all that are linked."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                forest = Forest.unpack(r["fp"], r["parent"], r["edge"], r["root"])
                for a, b in search(forest, radius, r["slice"], r["slices"]):
                    yield pa.RecordBatch.from_arrays([pa.array(signed(a)), pa.array(signed(b))], ["a", "b"])

    held = materialize(trees(entries, radius, most, shard))
    parts = int(entries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = held.withColumn("slice", F.explode(F.sequence(F.lit(0), F.col("slices") - 1))).repartition(parts, "shard", "slice")
    return tasks.mapInArrow(run, "a long, b long")


def link_documents(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for each row: documents link if their fingerprints differ in at most
    `radius` bits."""
    rows = materialize(fingerprints(docs, n))
    entries = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    groups = components(near_links(entries.select("fp"), radius)).withColumnRenamed("id", "fp")
    entries = entries.join(groups, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root"), "least")
    least = entries.groupBy("root").agg(F.min("least").alias("component_id"))
    named = entries.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def dedup_documents(docs: DataFrame, n: int = 3, radius: int = 3) -> DataFrame:
    """docs, same columns, with one document of each component: that of the smallest doc_id, of equal ones that of the smallest text."""
    keyed = row_keys(docs)
    if keyed is None:
        keyed = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("row_"), F.struct(*docs.columns).alias("doc"))
    groups = link_documents(keyed.select(F.col("row_").alias("doc_id"), F.col("doc.text").alias("text")), n, radius)
    gone = groups.where("doc_id <> component_id").select(F.col("doc_id").alias("row_"))
    return keyed.join(gone, "row_", "left_anti").select(*[F.col("doc").getField(c).alias(c) for c in docs.columns])
