"""Picks of lines, packed eight in a long, and groups that later links join."""

import random

from pyspark.sql import functions as F

from reliefgrid.llm import line_dedup as L
from reliefgrid.llm import links


def test_agreeing_bytes_are_counted(spark):
    r = random.Random(4)
    n = L.BANDS * L.ROWS
    rows = []
    for _ in range(200):
        x = [r.randrange(1 << 32) for _ in range(n)]
        rows.append((x, [v if r.random() < 0.6 else v ^ (1 << r.randrange(8)) for v in x]))
    d = spark.createDataFrame(rows, "x array<long>, y array<long>")
    packed = lambda c: [L._packed([F.get(c, F.lit(k)) for k in range(8 * w, min(8 * w + 8, n))]) for w in range(L.WORDS)]
    got = [t.k for t in d.select(L._agreeing(packed("x"), packed("y")).alias("k")).collect()]
    assert got == [sum(a & 255 == b & 255 for a, b in zip(x, y, strict=True)) for x, y in rows]


def test_later_links_join_groups(spark):
    groups = spark.createDataFrame([(1, 1), (4, 1), (2, 2), (7, 2), (5, 5), (6, 5)], "id long, root long")
    new = spark.createDataFrame([(4, 7), (6, 9), (10, 11), (7, 4)], "a long, b long")
    got = dict(links._joined(groups, new).collect())
    assert got == {1: 1, 4: 1, 2: 1, 7: 1, 5: 5, 6: 5, 9: 5, 10: 10, 11: 10}
