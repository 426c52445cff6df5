"""Language ID: multinomial naive Bayes over hashed character n-grams.

Texts are lower-cased, runs of anything but letters become one blank, and runs of 1 to 3 characters are hashed into
2**BITS features. Training counts every labelled text in numpy, task by task, and Spark adds the counts up; the matrix
of log-probabilities (languages x features, at most MAX_LANGUAGES rows) is broadcast, and scoring adds up, for the
features that a text has, the matrix's entries.

Nulls: a null text, and one without letters, is `und` with score 0; rows with a null label don't train. A null doc_id
stays null, and rows that repeat a doc_id are each a document. Texts of any length are read whole, about CHUNK_BYTES of
them at a time. Ties go to the language whose name sorts first. Without a single labelled text every text is `und`. An empty table gives an empty
table. Columns other than the id, the text and (in training) the label are not read.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import chunks

BITS = 15
#: Bound of the broadcast matrix's rows; more labels than that are an error, not a cut.
MAX_LANGUAGES = 512
SMOOTHING = 0.5


@functools.cache
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def features(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of all texts, and the text that each belongs to."""
    low = [(t or "").lower() for t in texts]
    code = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) + 1 for t in low])
    letter = _letters()[code]
    held = letter.copy()
    held[1:] |= letter[:-1]
    code, row = np.where(letter, code, np.uint32(32))[held], row[held]
    hashes, rows = [], []
    for n in (1, 2, 3):
        if len(code) < n:
            break
        h = np.full(len(code) - n + 1, n * 0x27D4EB2F, np.uint32)
        for k, by in enumerate((0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D)[:n]):
            h += code[k : len(code) - n + 1 + k] * np.uint32(by)
        h ^= h >> np.uint32(15)
        h *= np.uint32(0x2C1B3C6D)
        whole = row[: len(h)] == row[n - 1 :]
        hashes.append((h >> np.uint32(32 - BITS))[whole])
        rows.append(row[: len(h)][whole])
    return (np.concatenate(hashes), np.concatenate(rows)) if hashes else (np.zeros(0, np.uint32), np.zeros(0, np.int64))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for batch in chunks(batches):
        coded = batch.column("lang").dictionary_encode()
        names, label = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        f, row = features(batch.column("text").to_pylist())
        counts = np.bincount((label[row].astype(np.int64) << BITS) + f, minlength=len(names) << BITS).reshape(len(names), -1)
        docs = np.bincount(label, minlength=len(names))
        for k, name in enumerate(names):
            total[name] = total.get(name, 0) + np.append(counts[k], docs[k])
    for name, c in total.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(c[at])], ["lang", "feature", "n"])


class Model:
    """Languages in order of their names, and their log-probabilities by feature and overall."""

    def __init__(self, languages: list[str], counts: np.ndarray, docs: np.ndarray):
        self.languages = languages
        self.log_p = np.log(counts + SMOOTHING) - np.log(counts.sum(1, keepdims=True) + SMOOTHING * counts.shape[1])
        self.prior = np.log(docs + 1) - np.log(max(1, (docs + 1).sum()))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        f, row = features(texts)
        n = np.bincount(row, minlength=len(texts))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        sums = np.stack([np.bincount(row, p[f], len(texts)) for p in self.log_p], 1) + self.prior
        sums -= sums.max(1, keepdims=True)
        odds = np.exp(sums)
        best = odds.argmax(1)
        score = np.where(n > 0, odds[np.arange(len(texts)), best] / odds.sum(1), 0.0)
        return [self.languages[b] if k else "und" for b, k in zip(best, n, strict=True)], score


def train(labelled: DataFrame) -> Model:
    """A model of (text, lang); rows with nulls are left out. The driver gets one row a language, of 2**BITS sums at most."""
    rows = labelled.where("text IS NOT NULL AND lang IS NOT NULL").select("text", "lang").mapInArrow(_count, "lang string, feature int, n long")
    sums = rows.groupBy("lang", "feature").agg(F.sum("n").alias("n"))
    packed = sums.groupBy("lang").agg(F.collect_list(F.struct("feature", "n")).alias("x")).select("lang", "x.feature", "x.n").orderBy("lang").limit(MAX_LANGUAGES + 1)
    got = packed.toArrow()
    languages = got.column("lang").to_pylist()
    if len(languages) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    m = np.zeros((len(languages), 2**BITS + 1))
    for k, (feature, n) in enumerate(zip(got.column("feature"), got.column("n"), strict=True)):
        m[k, feature.values.to_numpy()] = n.values.to_numpy()
    return Model(languages, m[:, :-1], m[:, -1])


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score for each row."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            lang, p = held.value.predict(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(lang, pa.string()), pa.array(p)], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, "doc_id long, lang_pred string, score double")


def relabel(docs: DataFrame, model: Model, sure: float = 0.5) -> DataFrame:
    """docs, same columns, with the predicted language as `lang`, without those that the model can't place: texts that are
    null or have no letter (`und`), and those whose score is less than `sure`. A model without languages places none, and
    then all texts with letters stay as they are."""
    held = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("lang")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches):
            texts = batch.column("text").to_pylist()
            if held.value.languages:
                lang, score = held.value.predict(texts)
                yield batch.set_column(at, batch.schema.field(at), pa.array(lang, pa.string())).filter(pa.array([x != "und" and p >= sure for x, p in zip(lang, score.tolist(), strict=True)], pa.bool_()))
            else:
                yield batch.filter(pa.array(np.bincount(features(texts)[1], minlength=len(texts)) > 0))

    return docs.mapInArrow(place, docs.schema)
