"""Document fingerprints: a homomorphic multiset hash over paragraphs. DataFrame functions only.

A text is cut into paragraphs: lines, and within them the clauses that end in one of . , ; : ! ? | before a blank.
Each paragraph is hashed to a wide vector, and a text's fingerprint is the sum of its paragraphs' vectors, lane by lane,
modulo powers of two: 8 lanes modulo 2**32 that tell texts apart, and LANES lanes of +1 or -1 modulo 2**16 whose sums
also estimate how much two multisets share. The order of paragraphs is of no account; adding or taking away a
paragraph adds or subtracts its vector (`combine`).

likeness(a, b) = 1 - |a - b|^2 / (|a|^2 + |b|^2) over the +-1 lanes, held to 0..1: about the shared part of two multisets.
It is 1 for equal fingerprints.

Edited texts: documents are ordered by descending doc_id (null last, ties by text), the next of the last is the first.
The order is global but no task sees it whole: doc_id ranges from quantiles give buckets of about equal size, and each
bucket also gets the first document of the next one.

Nulls: a null text is empty. Empty texts have the fingerprint of no paragraphs. A single document is its own next. An
empty table gives an empty table. Only doc_id and text are read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

LANES = 64
PARAGRAPH = r"\n+|(?<=[.,;:!?|])[ \t]+"
BUCKET_BYTES = 24 << 20
#: Buckets are looked up in three steps of FAN: there are FAN**3 at most, beyond 6 TB of text they hold more than BUCKET_BYTES.
FAN = 64
#: Ids of which the buckets' bounds are quantiles.
SAMPLE = 1 << 22
_LOW = 0xFFFFFFFF
#: Two +-1 lanes share a long: their counts of ones stay apart up to 2**31 paragraphs.
_PAIR = 0x0000000100000001


def paragraphs(text: Column) -> Column:
    return F.filter(F.split(text, PARAGRAPH), lambda p: p != "")


def lane_sums(paragraph: Column) -> list[Column]:
    """Aggregates of one text's paragraphs (null: none): 8 sums, the number, and LANES / 2 packed sums of bits."""
    one = paragraph.isNotNull()
    h = [F.xxhash64(paragraph, F.lit(k)) for k in range(4)]
    wide = [F.sum(F.when(one, x).otherwise(0)) for w in h for x in (w.bitwiseAND(_LOW), F.shiftrightunsigned(w, 32))]
    bits = F.xxhash64(F.lit("lanes"), paragraph)
    return [*[x.alias(f"w{k}") for k, x in enumerate(wide)], F.count(paragraph).alias("n"), *[F.sum(F.when(one, F.shiftrightunsigned(bits, k).bitwiseAND(_PAIR)).otherwise(0)).alias(f"b{k}") for k in range(LANES // 2)]]


def lanes() -> Column:
    """The +-1 lanes as an array: lane = n - 2 * ones."""
    ones = [x for k in range(LANES // 2) for x in (F.col(f"b{k}").bitwiseAND(_LOW), F.shiftrightunsigned(f"b{k}", 32))]
    return F.transform(F.array(*ones), lambda x: F.col("n") - x * 2)


def fingerprint() -> Column:
    """All lanes in hexadecimal, 8 digits for each wide one and 4 for each +-1 lane."""
    wide = [F.lpad(F.lower(F.hex(F.col(f"w{k}").bitwiseAND(_LOW))), 8, "0") for k in range(8)]
    return F.concat(*wide, F.array_join(F.transform(lanes(), lambda x: F.lpad(F.lower(F.hex(x.bitwiseAND(0xFFFF))), 4, "0")), ""))


def _squares(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x.cast("double") * x)


def likeness(a: Column, b: Column) -> Column:
    """Of two arrays of +-1 lanes."""
    apart, both = _squares(F.zip_with(a, b, lambda x, y: x - y)), _squares(a) + _squares(b)
    return F.when(both == 0, F.lit(1.0)).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - apart / both)))


def signed_lanes(fp: Column) -> Column:
    """A fingerprint's +-1 lanes, read back."""
    each = F.transform(F.sequence(F.lit(0), F.lit(LANES - 1)), lambda k: F.conv(F.substring(fp, k * 4 + 65, F.lit(4)), 16, 10).cast("long"))
    return F.transform(each, lambda x: F.when(x >= 1 << 15, x - (1 << 16)).otherwise(x))


def combine(a: Column, b: Column, sign: int = 1) -> Column:
    """The fingerprint of a's paragraphs together with b's (sign 1), or without them (sign -1)."""
    cut = lambda fp, k, n, at: F.conv(F.substring(fp, k * n + at, F.lit(n)), 16, 10).cast("long")
    add = lambda k, n, at: F.lpad(F.lower(F.hex((cut(a, k, n, at) + cut(b, k, n, at) * sign).bitwiseAND((1 << 4 * n) - 1))), n, "0")
    lane = lambda count, n, at: F.array_join(F.transform(F.sequence(F.lit(0), F.lit(count - 1)), lambda k: add(k, n, at)), "")
    return F.concat(lane(8, 8, 1), lane(LANES, 4, 65))


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint for each row of docs."""
    d = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row_", F.monotonically_increasing_id())
    each = d.select("doc_id", "row_", F.explode_outer(paragraphs(F.col("text"))).alias("p"))
    return each.groupBy("row_", "doc_id").agg(*lane_sums(F.col("p"))).select("doc_id", fingerprint().alias("fingerprint"))


def _cuts(d: DataFrame, n: int, rows: int) -> list[int]:
    """Ids between n buckets of about as many rows, from a sample of SAMPLE ids at most; a poor sample makes uneven buckets."""
    if n == 1 or not rows:
        return []
    ids = d.select("id") if rows <= SAMPLE else d.select("id").sample(SAMPLE / rows, seed=1)
    return sorted({int(x) for x in ids.approxQuantile("id", [k / n for k in range(1, n)], max(0.2 / n, 1e-5))})


def _bucket(c: Column, cuts: list[int]) -> Column:
    """How many cuts are less than c: found in steps of FAN, from coarse to fine."""
    if len(cuts) <= FAN:
        return F.size(F.filter(F.array(*map(F.lit, cuts)) if cuts else F.array().cast("array<long>"), lambda x: x < c))
    step = FAN if len(cuts) <= FAN**2 else FAN**2
    parts = [cuts[k : k + step - 1] for k in range(0, len(cuts) + 1, step)]
    coarse = cuts[step - 1 :: step]
    table = F.array(*[F.array(*map(F.lit, p)) if p else F.array().cast("array<long>") for p in parts])
    if step == FAN:
        within = lambda k: F.size(F.filter(F.get(table, k), lambda x: x < c))
    else:
        inner = F.array(*[F.array(*[F.array(*map(F.lit, p[j : j + FAN - 1])) if p[j : j + FAN - 1] else F.array().cast("array<long>") for j in range(0, len(p) + 1, FAN)]) for p in parts])
        middle = F.array(*[F.array(*map(F.lit, p[FAN - 1 :: FAN])) if p[FAN - 1 :: FAN] else F.array().cast("array<long>") for p in parts])

        def within(k: Column) -> Column:
            j = F.size(F.filter(F.get(middle, k), lambda x: x < c))
            return j * FAN + F.size(F.filter(F.get(F.get(inner, k), j), lambda x: x < c))

    k = F.size(F.filter(F.array(*map(F.lit, coarse)), lambda x: x < c))
    return k * step + within(k)


def with_next(docs: DataFrame) -> DataFrame:
    """(bucket, place, doc_id, text, next_text, own) in buckets of neighbouring documents; own rows are docs', each once.

    Rows that are not own stand at a bucket's end and lend their text to its last document.
    """
    d = docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("id"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    rows, size = d.agg(F.count("id"), F.sum(F.octet_length("text"))).first()
    n = max(1, min(FAN**3, math.ceil((size or 0) / BUCKET_BYTES)))
    d = d.withColumn("bucket", _bucket(F.col("id"), _cuts(d, n, rows)))
    # the first document of a bucket is lent to the nearest bucket above, that of the topmost to the lowest
    heads = d.groupBy("bucket").agg(F.max("id").alias("top"))  # a row a bucket
    above = F.lead("bucket").over(Window.orderBy("bucket"))
    lent = heads.select("top", F.coalesce(above, F.min("bucket").over(Window.partitionBy())).alias("up"))
    both = d.join(F.broadcast(lent), d.id == lent.top, "left")
    own = F.struct(F.col("bucket").alias("b"), F.lit(0).alias("lent"))
    to = F.filter(F.array(own, F.when(F.col("up").isNotNull(), F.struct(F.col("up").alias("b"), F.lit(1).alias("lent")))), lambda x: x.isNotNull())
    both = both.withColumn("to", F.explode(to))
    both = both.select(F.col("to.b").alias("bucket"), F.col("to.lent").alias("lent"), "id", "doc_id", "text").repartition("bucket")
    w = Window.partitionBy("bucket").orderBy("lent", F.desc("id"), "text")
    both = both.withColumn("place", F.row_number().over(w)).withColumn("next_text", F.lead("text").over(w))
    return both.withColumn("own", F.col("lent") == 0)


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row."""
    d = with_next(docs)
    third = F.floor(F.length("text") / 3).cast("int")
    edited = F.concat(F.expr("left(text, length(text) - cast(floor(length(text) / 3) as int))"), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), third))
    d = d.withColumn("edited", F.when(F.col("own"), edited))
    d = d.select("bucket", "place", "own", "doc_id", F.length("text").cast("long").alias("n_chars"), F.sha2("edited", 256).alias("edited_sha256"), F.array(F.struct(F.lit(0).alias("e"), F.col("text").alias("t")), F.struct(F.lit(1).alias("e"), F.col("edited").alias("t"))).alias("both"))
    keys = ["bucket", "place", "own", "doc_id", "n_chars", "edited_sha256"]
    d = d.select(*keys, F.explode("both").alias("x")).select(*keys, F.col("x.e").alias("e"), F.explode_outer(paragraphs(F.col("x.t"))).alias("p"))
    d = d.groupBy(*keys, "e").agg(*lane_sums(F.col("p"))).select(*keys, "e", fingerprint().alias("f"), lanes().alias("l"))
    w = Window.partitionBy("bucket").orderBy("place", "e")
    d = d.withColumn("ef", F.lead("f", 1).over(w)).withColumn("el", F.lead("l", 1).over(w)).withColumn("nl", F.lead("l", 2).over(w))
    near = lambda x: F.round(likeness(F.col("l"), x), 6)
    return d.where("own AND e = 0").select("doc_id", "n_chars", "edited_sha256", F.col("f").alias("fingerprint"), F.col("ef").alias("edited_fingerprint"), near(F.col("el")).alias("near_edited"), near(F.col("nl")).alias("near_next"))
