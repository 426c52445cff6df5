"""Word spans, word hashes and shared storage, used by the operators of this subpackage.

Texts reach Python as Arrow columns and are handled as one byte buffer with offsets, so that a whole
batch of documents is split into words and hashed with a fixed number of numpy passes.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.operators.keys import number_rows

#: The words of the contracts: runs of anything but these six bytes.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256)
LOWER[65:91] += 32
#: Text bytes that one numpy pass takes; a longer single text is a pass of its own.
CHUNK_BYTES = 2 << 20

_STEP = np.uint64(0x9E3779B97F4A7C15)
_BACK = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_BYTES = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def checkpoint_dir(spark) -> str:
    """The folder that the cluster shares; one is made only for a local session that names none."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        named = spark.conf.get("spark.checkpoint.dir", None)
        if not named and not sc.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that all executors share")
        sc.setCheckpointDir(named or tempfile.mkdtemp(prefix="spark-checkpoint-"))
    return sc.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """df, written to the shared folder as Parquet and read again: lineage ends there."""
    path = f"{checkpoint_dir(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def row_keys(docs: DataFrame, below: int | None = None) -> DataFrame | None:
    """`row_`, a number for each row by (doc_id, text), and `doc`, the row itself as a struct, if several rows share a doc_id
    or have none, or, with below, if an id isn't in 0..below - 1; else None."""
    n = docs.groupBy("doc_id").count()
    bad = F.col("count") > 1
    if below is not None:
        bad = bad | F.col("doc_id").isNull() | (F.col("doc_id") < 0) | (F.col("doc_id") >= below)
    if n.where(bad).isEmpty():
        return None
    return number_rows(docs.select(F.struct(*docs.columns).alias("doc")), ["doc.doc_id", "doc.text"], "row_")


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective finaliser over 64 bits."""
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def chunks(batches: Iterator[pa.RecordBatch], text: str = "text", most_bytes: int = CHUNK_BYTES) -> Iterator[pa.RecordBatch]:
    """The batches' rows in slices of about most_bytes bytes of text."""
    for batch in batches:
        if not batch.num_rows:
            continue
        size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        at = 0
        while at < batch.num_rows:
            done = size[at - 1] if at else 0
            to = max(int(np.searchsorted(size, done + most_bytes, "right")), at + 1)
            yield batch.slice(at, to - at)
            at = to


def column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    """A long column; null is the smallest long."""
    return pc.fill_null(batch.column(name).cast(pa.int64()), -(1 << 63)).to_numpy(zero_copy_only=False)


def runs(keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Each distinct key with the places that hold it, in order: the work is that of the keys present."""
    if not len(keys):
        return
    order = np.argsort(keys, kind="stable")
    heads = np.flatnonzero(np.append(True, keys[order][1:] != keys[order][:-1]))
    for a, b in zip(heads, np.append(heads[1:], len(keys)), strict=True):
        yield int(keys[order[a]]), order[a:b]


def text_bytes(batch: pa.RecordBatch, name: str = "text") -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all rows and each row's offsets; null counts as empty."""
    a = pc.fill_null(batch.column(name), "").cast(pa.large_string())
    _, at, data = a.buffers()
    at = np.frombuffer(at, np.int64, len(a) + 1, a.offset * 8)
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8), at - at[0]


def word_spans(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and row of each word. No word crosses from a row to the next."""
    if not len(data):
        return (np.zeros(0, np.int64),) * 3
    inside, edge = ~SPACE[data], np.zeros(len(data) + 1, bool)
    edge[at] = True
    before, after = np.empty_like(inside), np.empty_like(inside)
    before[0], before[1:], after[-1], after[:-1] = False, inside[:-1], False, inside[1:]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(at, starts, "right") - 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of the words data[starts:ends]: differences of one running polynomial, shifted to 0 and mixed."""
    n = len(data) + 1
    if len(_POWERS[0]) < n:
        for k, step in enumerate((_STEP, _BACK)):
            p = np.full(n, step, np.uint64)
            p[0] = 1
            _POWERS[k] = np.cumprod(p)
    table = _BYTES[LOWER] if lower else _BYTES
    run = np.zeros(n, np.uint64)
    np.cumsum(table[data] * _POWERS[0][: n - 1], out=run[1:])
    return mix((run[ends] - run[starts]) * _POWERS[1][starts] + (ends - starts).astype(np.uint64))


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """A hash for each run of n words, of which there are len(words) - n + 1; the caller drops those that cross rows."""
    if len(words) < n:
        return np.zeros(0, np.uint64)
    out = np.full(len(words) - n + 1, n, np.uint64)
    for k in range(n):
        out = (out ^ words[k : len(words) - n + 1 + k]) * _STEP + np.uint64(k + 1)
        out ^= out >> np.uint64(29)
    return mix(out)


def signed(h: np.ndarray) -> np.ndarray:
    return h.view(np.int64)
