"""Of several rows of a key the first by an order, whatever the partitions."""

from reliefgrid.operators.tables import complete_by_unit
from reliefgrid.sources.storage import keyed_lookup


def test_the_first_row_of_a_key(spark):
    rows = spark.createDataFrame([(1,), (2,), (9,)], "k long")
    lookup = spark.createDataFrame([(1, "b", 3), (1, "a", 7), (2, None, 1), (2, "z", 0)] * 5, "k long, name string, line long").repartition(7)
    got = lambda d: sorted(((r.k, r.name, r.line) for r in d.collect()), key=lambda r: r[0])
    assert got(keyed_lookup(rows, lookup, ["k"])) == [(1, "a", 7), (2, None, 1), (9, None, None)]
    assert got(keyed_lookup(rows, lookup, ["k"], ["line"])) == [(1, "b", 3), (2, "z", 0), (9, None, None)]
    assert keyed_lookup(rows, lookup.select("k"), ["k"]).count() == 3


def test_the_first_row_of_a_unit(spark):
    units = spark.createDataFrame([(1,), (2,)], "u long")
    rows = spark.createDataFrame([(1, 5.0), (1, 4.0), (2, None), (2, 8.0)] * 3, "u long, v double").repartition(5)
    assert sorted(tuple(r) for r in complete_by_unit(units, rows, "u", ["v"]).collect()) == [(1, 4.0), (2, 8.0)]
