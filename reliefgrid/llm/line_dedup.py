"""Line dedup: fuzzy lines by MinHash. DataFrame functions only.

A line's shingles are the runs of SHINGLE characters that start at each of its characters, and the line itself if it is
shorter. Its signature has BANDS * ROWS picks by one permutation: a shingle's 64-bit hash names one of as many bins and a
value, and a bin's least value is its pick; an empty bin takes the pick of the first bin that isn't empty in an order of its
own. Two lines agree in a pick with the probability of their Jaccard similarity. Lines that agree in all ROWS picks of a
band share a bucket; pairs from buckets that agree in AGREE picks or more are verified by the exact Jaccard similarity of all their shingles, links are
joined by a distributed union-find, and of each component the line that comes first (doc_id, line number) stays. At a
similarity of 0.8 a pair of lines shares a bucket with a probability of 1 - (1 - 0.8**3)**6 = 0.987, and fails AGREE with one of 0.016.

Equal lines are one line to all of this: they are brought together by their hash before anything else, so that a line
that stands in a third of all documents costs one row a task. Lines are compared without blanks around them; blank lines
stay. Nulls: a null text has no lines and stays null; a null doc_id sorts first. Rows that repeat a doc_id are documents of
their own, in order of their texts. Ties: equal lines of one document stay once, the first of them. A line of any length
is taken whole. An empty table gives an empty table. Other columns are only passed on, whatever their names.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.llm.common import materialize, row_keys
from reliefgrid.llm.links import linked_groups, sized_buckets

SHINGLE, BANDS, ROWS, SIMILARITY = 8, 6, 3, 0.8
#: Picks of BANDS * ROWS, by their last byte, in which a pair agrees that is verified.
AGREE = 11
#: Longs that hold these bytes.
WORDS = -(-BANDS * ROWS // 8)
#: A line's place is its document's number, below 2**36, followed by LINE bits of line number.
LINE = 27
#: Lines to fetch that are broadcast, at about 24 bytes each; more are joined by a shuffle.
FETCH = 1 << 20


def split_lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def bare(line: Column) -> Column:
    return F.btrim(line, F.lit(" \t\r\f\v"))


def _starts(code: Column) -> Column:
    """Bytes (from 1) at which the shingles of a line start; code is the line in UTF-32, four bytes a character."""
    return F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(code) - (4 * SHINGLE - 1)), F.lit(4))


def _shingle_hash(code: Column, start: Column) -> Column:
    return F.xxhash64(F.substring(code, start, F.lit(SHINGLE * 4)))


def _hashes(lines: DataFrame, *names: str) -> DataFrame:
    """names, i, h: the hash of each shingle of each line, with its place i."""
    code = lines.select(*names, F.encode("line", "UTF-32").alias("code"))
    return code.select(*names, "code", F.explode(_starts(F.col("code"))).alias("i")).select(*names, "i", _shingle_hash(F.col("code"), F.col("i")).alias("h"))


def shingle_set(line: Column) -> Column:
    """The hashes of a line's shingles, each once."""
    each = F.transform(F.array(F.encode(line, "UTF-32")), lambda code: F.transform(_starts(code), lambda i: _shingle_hash(code, i)))
    return F.array_distinct(F.element_at(each, 1))


def lines(docs: DataFrame) -> DataFrame:
    """line, id, at: the lines that aren't blank, without blanks around, their hashes and places. docs: row_, text."""
    d = docs.select("row_", F.posexplode(split_lines(F.col("text"))).alias("line_no", "line"))
    d = d.select(bare(F.col("line")).alias("line"), F.shiftleft("row_", LINE).bitwiseOR(F.col("line_no").cast("long")).alias("at")).where("line <> ''")
    return d.withColumn("id", F.xxhash64("line"))


def signatures(docs: DataFrame) -> DataFrame:
    """id, at (the first place), bands (a bucket for each band), picks0, ... (their last bytes, eight in a long) of each distinct line. Texts aren't shuffled: each task's
    picks are, and of these the least is taken."""
    n = BANDS * ROWS
    each = _hashes(lines(docs), "id", "at").withColumn("bin", F.shiftrightunsigned("h", 33) % n).withColumn("v", F.col("h").bitwiseAND(F.lit((1 << 32) - 1)))
    picks = each.groupBy("id").agg(F.expr("min(at) FILTER (WHERE i = 1)").alias("at"), *[F.expr(f"min(v) FILTER (WHERE bin = {k})").alias(f"m{k}") for k in range(n)])
    # another order of the bins for each: steps that have no factor in common with their number. Only short lines have empty bins;
    # a chain of conditions for all would be too long a method to be compiled
    steps = [s for s in range(1, n) if math.gcd(s, n) == 1]
    orders = F.array(*[F.array(*[F.lit((k + s * steps[k % len(steps)]) % n) for s in range(n)]) for k in range(n)])
    every = F.array(*[F.col(f"m{k}") for k in range(n)])
    filled = F.transform(orders, lambda order: F.get(F.filter(F.transform(order, lambda k: F.get("every", k)), lambda v: v.isNotNull()), F.lit(0)))
    picks = picks.select("id", "at", every.alias("every")).select("id", "at", F.when(F.forall("every", lambda v: v.isNotNull()), F.col("every")).otherwise(filled).alias("p"))
    p = [F.get("p", F.lit(k)) for k in range(n)]
    bands = [F.xxhash64(F.lit(b), *p[b * ROWS : (b + 1) * ROWS]) for b in range(BANDS)]
    return picks.select("id", "at", F.array(*bands).alias("bands"), *[_packed(p[8 * w : 8 * w + 8]).alias(f"picks{w}") for w in range(WORDS)])


def _packed(picks: list[Column]) -> Column:
    """The last bytes of up to eight picks in one long."""
    return reduce(Column.bitwiseOR, [F.shiftleft(x.bitwiseAND(F.lit(255)), 8 * i) for i, x in enumerate(picks)])


def _agreeing(x: list[Column], y: list[Column]) -> Column:
    """In how many of BANDS * ROWS bytes the longs x and y are equal: a byte's bits are gathered in its last one."""
    def unlike(a: Column, b: Column) -> Column:
        d = a.bitwiseXOR(b)
        for k in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    return F.lit(BANDS * ROWS) - reduce(Column.__add__, [unlike(a, b) for a, b in zip(x, y, strict=True)])


def _fetch(docs: DataFrame, asked: DataFrame) -> DataFrame:
    """id, line of the lines asked for (id, at): only the documents that hold any are split."""
    by_row = asked.select("id", F.shiftright("at", LINE).alias("row_"), F.col("at").bitwiseAND(F.lit((1 << LINE) - 1)).cast("int").alias("line_no"))
    by_row = by_row.groupBy("row_").agg(F.collect_list(F.struct("id", "line_no")).alias("asked"))
    if asked.count() <= FETCH:
        by_row = F.broadcast(by_row)
    d = docs.join(by_row, "row_").select(split_lines(F.col("text")).alias("all"), "asked")
    got = F.transform("asked", lambda x: F.struct(x["id"].alias("id"), F.get("all", x["line_no"]).alias("line")))
    return d.select(F.inline(got)).select("id", bare(F.col("line")).alias("line"))


def line_groups(docs: DataFrame, signed: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """(id, root) for each line hash that is linked with another. signed: signatures, stored."""
    words = [f"picks{w}" for w in range(WORDS)]
    sized = materialize(sized_buckets(signed.select("id", *words, F.explode("bands").alias("bucket"))).select("bucket", "id", *words, "n"))

    def features(ids: DataFrame) -> DataFrame:
        return _fetch(docs, materialize(signed.join(ids, "id", "left_semi").select("id", "at"))).withColumnRenamed("line", "f")

    num, den = round(similarity * 1000), 1000

    def same(x: Column, y: Column) -> Column:
        sizes = F.least(F.size(x), F.size(y)) * den >= F.greatest(F.size(x), F.size(y)) * num
        return sizes & (F.size(F.array_intersect(x, y)) * (den + num) >= (F.size(x) + F.size(y)) * num)

    def may(l, r) -> Column:
        return _agreeing([l(w) for w in words], [r(w) for w in words]) >= AGREE

    return linked_groups(sized, features, same, may, unpack=shingle_set)


def kept_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """row_, kept (sorted line numbers): the lines that stay, of documents that keep any. docs: row_ (0..2**36), text."""
    signed = materialize(signatures(docs))
    groups = line_groups(docs, signed, similarity)
    first = signed.select("id", "at").join(groups, "id", "left").groupBy(F.coalesce("root", "id").alias("root")).agg(F.min("at").alias("at"))
    line_no = F.col("at").bitwiseAND(F.lit((1 << LINE) - 1)).cast("int")
    return first.groupBy(F.shiftright("at", LINE).alias("row_")).agg(F.array_sort(F.collect_list(line_no)).alias("kept"))


def _with_kept(docs: DataFrame, similarity: float) -> DataFrame:
    """doc (docs' columns as one struct), kept (sorted line numbers) for each row of docs."""
    d = row_keys(docs, 1 << (63 - LINE))
    if d is None:
        d = docs.select(F.col("doc_id").cast("long").alias("row_"), F.struct(*docs.columns).alias("doc"))
    d = d.join(kept_lines(d.select("row_", F.col("doc.text").alias("text")), similarity), "row_", "left")
    return d.select("doc", F.coalesce("kept", F.array().cast("array<int>")).alias("kept"))


def line_decisions(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """doc_id, n_lines (blank ones not counted), n_removed, kept_lines for each row."""
    n = F.coalesce(F.size(F.filter(split_lines(F.col("text")), lambda x: bare(x) != "")), F.lit(0))
    counted = lambda d: d.select("row_", "doc_id", F.when(F.col("text").isNull(), 0).otherwise(n).cast("long").alias("n_lines"))
    keyed = row_keys(docs.select("doc_id", "text"), 1 << (63 - LINE))
    own = docs.select(F.col("doc_id").cast("long").alias("row_"), F.col("doc_id").cast("long").alias("doc_id"), "text") if keyed is None else keyed.select("row_", F.col("doc.doc_id").cast("long").alias("doc_id"), F.col("doc.text").alias("text"))
    d = counted(own).join(kept_lines(own.select("row_", "text"), similarity), "row_", "left").withColumn("kept", F.coalesce("kept", F.array().cast("array<int>")))
    return d.select("doc_id", "n_lines", (F.col("n_lines") - F.size("kept")).cast("long").alias("n_removed"), F.col("kept").alias("kept_lines"))


def dedup_lines(docs: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """docs, same columns and rows, with the lines that aren't kept taken out of the text (and n_chars set anew)."""
    text = F.col("doc.text")
    stays = F.filter(split_lines(text), lambda x, i: (bare(x) == "") | F.array_contains("kept", i))
    d = _with_kept(docs, similarity).withColumn("new_text", F.when(text.isNotNull(), F.array_join(stays, "\n")))
    put = {"text": F.col("new_text"), "n_chars": F.length("new_text").cast("long")}
    return d.select(*[(put[c] if c in put else F.col("doc").getField(c)).alias(c) for c in docs.columns])
