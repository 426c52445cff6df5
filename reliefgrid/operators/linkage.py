"""Deterministic linkage: every input row stays, with a status."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reliefgrid.sources.storage import spread, stored

#: Bound of a list of names that is carried to the executors with the plan.
NAMES = 5000
#: Characters of a name that are joined with texts, and names that may share them.
HEAD, SHARED = 4, 64


def crosswalk(units: DataFrame, known: DataFrame, joint: list[str], outside: list[str]) -> DataFrame:
    """units (unit) with a match status: joint operator, outside the area, exact, or unmatched. known: (unit, code)."""
    d = units.join(known, "unit", "left")
    status = F.when(F.col("unit").isin(joint), "joint_operator_unallocated").when(F.col("unit").isin(outside), "outside_study_area").when(F.col("code").isNotNull(), "exact").otherwise("unmatched")
    return d.withColumn("match_status", status).withColumn("code", F.when(F.col("match_status") == "exact", F.col("code")))


def unique_match(rows: DataFrame, facilities: DataFrame, name: str, value: str) -> DataFrame:
    """rows with the value of the facility of that name, if all facilities of the name agree on it, and how many there are."""
    names = facilities.groupBy(name).agg(F.count(F.lit(1)).alias("records"), F.count_distinct(value).alias("values"), F.min(value).alias("only"))
    d = rows.join(names, name, "left")
    return d.select(*rows.columns, F.coalesce("records", F.lit(0)).alias("records"), F.coalesce("values", F.lit(0)).alias("values"), F.when(F.col("values") == 1, F.col("only")).alias("matched"))


def fallback(rows: DataFrame, sources: list[tuple[str, DataFrame]], key: str, value: str) -> DataFrame:
    """The value of the first source, in their order, that has the key; `matched_by` names it, or is 'unmatched'."""
    d, found, by = rows, F.lit(None), F.lit("unmatched")
    for k, (label, s) in enumerate(sources):
        d = d.join(s.select(F.col(key), F.col(value).alias(f"v{k}_")), key, "left")
    for k, (label, _) in reversed(list(enumerate(sources))):
        found = F.coalesce(F.col(f"v{k}_"), found)
        by = F.when(F.col(f"v{k}_").isNotNull(), F.lit(label)).otherwise(by)
    return d.select(*rows.columns, found.alias(value), by.alias("matched_by"))


def names_within(rows: DataFrame, text: str, names: DataFrame, name: str) -> DataFrame:
    """rows with `names_found`: which of the names, at most NAMES, stand in the text. The names go with the plan, not a join."""
    got = [r[0] for r in names.select(name).where(F.col(name).isNotNull()).distinct().orderBy(name).limit(NAMES + 1).collect()]
    if len(got) > NAMES:
        raise ValueError(f"more than {NAMES} names")
    return rows.withColumn("names_found", F.filter(F.array(*[F.lit(x) for x in got]), lambda n: F.contains(F.col(text), n)))


def names_in_texts(rows: DataFrame, key: str, text: str, names: DataFrame, name: str, most: int = SHARED) -> DataFrame:
    """(key, name): which of the names stand in each text, once each; letter by letter, as SQL's contains. Any number of names: a join on
    their first HEAD characters with the texts' own stretches of this length; names of which more than `most` share these are
    joined on twice as many, and so on. Names and texts that are null or empty take no part; rows of one key are taken together."""
    n = names.select(F.col(name).alias("name_")).where("name_ <> ''").distinct().withColumn("size_", F.least(F.length("name_"), F.lit(HEAD)))
    head = F.left("name_", F.col("size_"))
    n = stored(n.withColumn("head_", head))
    while True:
        shared = stored(n.groupBy("head_").agg(F.count(F.lit(1)).alias("n_"), F.max(F.length("name_") > F.col("size_")).alias("more_")).where((F.col("n_") > most) & F.col("more_")).select("head_"))
        if shared.isEmpty():
            break
        longer = n.join(shared, "head_", "left_semi").withColumn("size_", F.least(F.length("name_"), F.col("size_") * 2)).withColumn("head_", head)
        n = stored(n.join(shared, "head_", "left_anti").unionByName(longer))
    sizes = [(r[0], r[1]) for r in n.groupBy("size_").agg(F.max(F.length("name_"))).collect()]  # a few lengths
    t = spread(rows.select(F.col(key).alias("key_"), F.col(text).alias("text_")).where("text_ <> ''"))
    at = lambda k, longest: F.when(F.length("text_") >= k, F.transform(F.sequence(F.lit(1), F.length("text_") - (k - 1)), lambda i: F.struct(F.substring("text_", i, F.lit(k)).alias("head_"), F.substring("text_", i, F.lit(longest)).alias("rest_")))).otherwise(F.array().cast("array<struct<head_: string, rest_: string>>"))
    if not sizes:
        return t.select(F.col("key_").alias(key), F.col("text_").alias(name)).where("false")
    stretches = t.select("key_", F.explode(F.array_distinct(F.concat(*[at(k, longest) for k, longest in sizes]))).alias("x")).select("key_", "x.*")
    found = stretches.join(n, "head_").where(F.startswith("rest_", F.col("name_")))
    return found.select(F.col("key_").alias(key), F.col("name_").alias(name)).distinct()


def unique_within(rows: DataFrame, key: str, text: str, label: str, names: DataFrame, name: str, values: list[str]) -> DataFrame:
    """(name, label, *values): for each name the rows whose text has it (`key` is unique), and of these the labels that one row alone
    has, with its values. A label that two rows of a name share isn't accepted; nulls have no label."""
    met = names_in_texts(rows, key, text, names, name).join(rows.select(key, label, *values), key).where(F.col(label).isNotNull())
    one = met.groupBy(name, label).agg(F.count(F.lit(1)).alias("n_"), *[F.min(v).alias(v) for v in values])
    return one.where("n_ = 1").drop("n_")


def audit(parts: list[tuple[str, DataFrame, str]]) -> DataFrame:
    """component, total, success, unmatched, rate: one row for each (name, table, condition)."""
    rows = [d.agg(F.count(F.lit(1)).alias("total"), F.count_if(F.expr(ok)).alias("success")).select(F.lit(n).alias("component"), "*") for n, d, ok in parts]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("component", "total", "success", (F.col("total") - F.col("success")).alias("unmatched"), F.round(F.try_divide(F.col("success") * 1.0, F.col("total")), 6).alias("rate"))


class Component(NamedTuple):
    """A part of an audit: its rows, when one counts as linked (unknown: it doesn't), the rule in words, and the keys of its records if
    they have several rows, of which one counts (`first` picks it; without it, a record is linked if any row is)."""

    name: str
    rows: DataFrame
    linked: Column
    rule: str
    keys: tuple[str, ...] = ()
    first: Column | None = None


def coverage_audit(components: list[Component]) -> DataFrame:
    """place, component, total, success, unmatched, rate, rule: a row for each component, in their order. Rows of one record (nulls are a
    key as others) are brought together in each task first. A component without rows has no rate."""
    rows = []
    for place, c in enumerate(components):
        ok = F.coalesce(c.linked, F.lit(False)).alias("ok_")
        d = c.rows.select(ok, *([] if c.first is None else [c.first.alias("first_")]), *c.keys)
        if c.keys:
            d = d.groupBy(*c.keys).agg((F.max("ok_") if c.first is None else F.min(F.struct("first_", "ok_"))["ok_"]).alias("ok_"))
        rows.append(d.agg(F.count(F.lit(1)).alias("total"), F.count_if("ok_").alias("success")).select(F.lit(place).alias("place"), F.lit(c.name).alias("component"), "total", "success", F.lit(c.rule).alias("rule")))
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out.select("place", "component", "total", "success", (F.col("total") - F.col("success")).alias("unmatched"), F.try_divide(F.col("success").cast("double"), F.col("total")).alias("rate"), "rule")
