"""Names within texts by joined stretches, against trying every name: shared beginnings, short names, repeats, nulls."""

import random

import pytest

from reliefgrid.operators import linkage


@pytest.mark.parametrize("most", [64, 2])
def test_names_in_texts(spark, most):
    r = random.Random(most)
    names = ["".join(r.choice("abé市") for _ in range(r.randint(1, 9))) for _ in range(150)] + ["aaaaaaaa" + x for x in "abcdefgh"] + ["aaaaaaaa", "b", "長い名前の町"]
    texts = ["".join(r.choice("abé市 ") for _ in range(r.randint(0, 60))) for _ in range(80)] + ["aaaaaaaaaaaaa", "xx長い名前の町", None, "", "b"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    n = spark.createDataFrame([(x,) for x in [*names, names[0], None, ""]], "name string")
    got = linkage.names_in_texts(rows, "id", "t", n, "name", most).collect()
    want = {(i, x) for i, t in enumerate(texts) if t for x in set(names) if x in t}
    assert {(x.id, x.name) for x in got} == want and len(got) == len(want)
    assert linkage.names_in_texts(rows, "id", "t", n.where("false"), "name").collect() == []


def test_only_one_facility_of_a_name_is_accepted(spark):
    rows = spark.createDataFrame([(1, "熊本市中央区", "hall", 1.0), (2, "熊本市北区", "hall", 2.0), (3, "熊本市北区", "gym", 3.0), (4, "宇土市 北区", "hall", 4.0), (5, "宇土市", None, 5.0)], "id long, t string, label string, x double")
    names = spark.createDataFrame([("熊本市",), ("宇土市",), ("北区",)], "name string")
    got = sorted(tuple(x) for x in linkage.unique_within(rows, "id", "t", "label", names, "name", ["x"]).collect())
    assert got == [("北区", "gym", 3.0), ("宇土市", "hall", 4.0), ("熊本市", "gym", 3.0)]


def test_rows_of_a_small_file_are_dealt_over_all_cores(spark):
    from reliefgrid.plans import facility_queries
    from reliefgrid.sources.storage import spread

    cores = spark.sparkContext.defaultParallelism
    assert spread(spark.range(10).coalesce(1)).rdd.getNumPartitions() >= cores
    assert facility_queries.layer_round_trip(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= cores
