"""From buckets of possible partners to groups, without all pairs of a bucket as rows. DataFrame functions only.

`components` is a distributed union-find (alternating large-star and small-star steps). `linked_groups` finds what
links the members of buckets: small buckets compare all pairs; a large one first compares all its members with its most
central one and a few others. What these links join needs no more comparing, for groups are all that is asked for. Members of a bucket
that are still apart are then compared in full, in blocks: a row holds two blocks, and only links come out of it. So no
link between different groups is lost, and a large group of variants never becomes rows for all its pairs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from reliefgrid.llm.common import materialize


def once(value: Column, f: Callable[[Column], Column]) -> Column:
    """f(value), with value worked out once however often f names it: the optimiser can't copy it into f."""
    return F.element_at(F.transform(F.array(value), f), 1)


SMALL_BUCKET, BLOCK = 8, 48
#: Blocks of one bucket that a task compares with all those outside the bucket's largest group.
TOGETHER = 4
#: Members of buckets whose members are compared with a block of the largest group before they are compared with all.
HUGE = 128
#: Members of a large bucket that all others are compared with first: the most central one and some chosen by hash.
CENTRES = 4


def components(links: DataFrame) -> DataFrame:
    """(id, root) for each id that links (a, b: long) name; root is the least id of the group."""
    edges = materialize(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    while True:
        # done when no id has two smaller ones and none that is smaller has one itself
        ends = edges.select(F.col("u").alias("x"), F.lit(1).alias("k")).union(edges.select("v", F.lit(0)))
        ends = ends.groupBy("x").agg(F.sum("k").alias("k"), F.min("k").alias("least"))
        if ends.where("k > 1 OR (k = 1 AND least = 0)").isEmpty():
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).union(edges.select("v", "v").distinct())
        both = edges.union(edges.select("v", "u"))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = materialize(small.union(least).distinct())


def linked_groups(sized: DataFrame, features: Callable[[DataFrame], DataFrame], same: Callable[[Column, Column], Column], may: Callable[[Callable, Callable], Column], enough: Callable[[Callable, Callable, Column], Column] | None = None, small: int = SMALL_BUCKET, unpack: Callable[[Column], Column] = lambda f: f) -> DataFrame:
    """(id, root) for each linked id.

    sized: bucket, id, n (the bucket's members) and what `may` needs, stored, without buckets of one; rows (bucket, id)
    are distinct. features(ids): (id, f) for these ids; unpack(f) is what `same` compares: whether two members link. f is
    what is stored and shuffled.
    may(l, r): a condition that no linked pair fails, l and r giving the columns of both members by name. enough(l, r, n):
    the same, given that the pair shares n buckets or fewer.

    The most central member of a bucket is the one whose buckets have the most members: among variants of one text
    that is the text itself.
    """
    named = [c for c in sized.columns if c not in ("bucket", "n")]
    weight = sized.select("id", "n").groupBy("id").agg(F.sum("n").alias("weight"), F.count_if(F.col("n") > small).alias("large"))
    sized = sized.join(weight, "id")
    many, few = sized.where(F.col("n") > small), sized.where(F.col("n") <= small)
    side = lambda d, s, *more: d.select("bucket", *[F.col(c).alias(f"{s}_{c}") for c in [*named, *more]])
    l, r = (lambda c: F.col(f"l_{c}")), (lambda c: F.col(f"r_{c}"))
    one = F.struct(*named)
    centre = many.groupBy("bucket").agg(F.array_distinct(F.array(F.max_by(one, F.struct("weight", "id")), *[F.max_by(one, F.xxhash64(F.lit(k), "id")) for k in range(CENTRES - 1)])).alias("x"))
    centre = centre.select("bucket", F.explode("x").alias("x")).select("bucket", "x.*")
    near = side(few, "l", "large").join(side(few, "r", "large"), "bucket").where("l_id < r_id").where(may(l, r))
    if enough is not None:
        # what all small buckets say of a pair, and at most so many large ones
        own = [c for c in near.columns if c != "bucket" and not c.endswith("place")]
        near = near.groupBy(*own).agg(F.count("bucket").alias("shared_")).where(enough(l, r, F.col("shared_") + F.least("l_large", "r_large")))
    star = side(many, "l").join(side(centre, "r"), "bucket").where(may(l, r))
    pair = lambda d: d.select(F.least("l_id", "r_id").alias("a"), F.greatest("l_id", "r_id").alias("b"))
    near = materialize(pair(near).union(pair(star)).where("a < b").distinct())
    features = materialize(features(near.select(F.col("a").alias("id")).union(near.select("b")).union(many.select("id")).distinct()))
    near = near.join(features.select(F.col("id").alias("a"), F.col("f").alias("x")), "a").join(features.select(F.col("id").alias("b"), F.col("f").alias("y")), "b")
    sets = F.struct(unpack(F.col("x")).alias("x"), unpack(F.col("y")).alias("y"))
    # a generator keeps both sets as values, of which `same` is compiled; within a lambda it would be interpreted
    links = materialize(near.select("a", "b", F.explode_outer(F.array(sets)).alias("s")).where(same(F.col("s.x"), F.col("s.y"))).select("a", "b"))
    groups = components(links)

    for whole in (False, True):
        new = _between_groups(many, groups, features, named, same, may, unpack, whole)
        if new is not None and not new.isEmpty():
            groups = _joined(groups, new)
    return groups


def _joined(groups: DataFrame, links: DataFrame) -> DataFrame:
    """groups (id, root) with what these links join: only roots are linked anew."""
    root = lambda c: groups.select(F.col("id").alias(c), F.col("root").alias(f"root_{c}"))
    d = links.join(root("a"), "a", "left").join(root("b"), "b", "left")
    new = components(d.select(F.coalesce("root_a", "a").alias("a"), F.coalesce("root_b", "b").alias("b")))
    moved = groups.join(new.select(F.col("id").alias("root"), F.col("root").alias("to")), "root", "left").select("id", F.coalesce("to", "root").alias("root"))
    return materialize(moved.union(new.join(groups, "id", "left_anti")))


def _between_groups(many: DataFrame, groups: DataFrame, features: DataFrame, named: list[str], same: Callable, may: Callable, unpack: Callable, whole: bool) -> DataFrame | None:
    """Links of members of one bucket that are in different groups so far: all of them if whole, else those of the members of
    HUGE buckets with about BLOCK members of the bucket's largest group, which leaves less to compare. None if no bucket is open."""
    apart = many.join(groups, "id", "left").withColumn("root", F.coalesce("root", "id"))
    open_ = apart.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("id").alias("m"), F.mode("root").alias("top"))
    open_ = open_.where("lo <> hi" if whole else f"lo <> hi AND m >= {HUGE}").select("bucket", "m", "top")
    apart = materialize(apart.join(open_, "bucket"))
    if apart.isEmpty():
        return None
    mine = apart.groupBy("id").agg(F.array_sort(F.collect_set("bucket")).alias("buckets"))
    held = apart.join(mine, "id").join(features, "id").withColumn("block", F.pmod(F.xxhash64("id"), F.floor(F.col("m") / BLOCK) + 1))
    # a pair of two groups has a member outside the bucket's largest one: these go left, all members right
    packed = lambda d: d.groupBy("bucket", "block").agg(F.max("m").alias("m"), F.max("top").alias("top"), F.collect_list(F.struct(*named, "root", "buckets", "f")).alias("of"))
    # a bucket's pairs of blocks are dealt by the right block; the left ones, of which there are fewer, go to each deal. The
    # deals keep the session's number of partitions: there is more to compare than to read
    deals, parts = F.floor(F.col("m") / (BLOCK * TOGETHER)), int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    left = packed(held.where("root <> top")).select("bucket", "top", F.col("of").alias("ls"), F.explode(F.sequence(F.lit(0).cast("long"), deals)).alias("deal"))
    right = packed(held if whole else held.where("block = 0 AND root = top")).select("bucket", F.col("of").alias("rs"), F.pmod("block", deals + 1).alias("deal"))
    two = left.repartition(parts, "bucket", "deal").join(right.repartition(parts, "bucket", "deal"), ["bucket", "deal"])
    each = lambda c: F.transform(c, lambda m: F.struct(*[m[k].alias(k) for k in (*named, "root", "buckets", "f")], unpack(m["f"]).alias("u")))

    def linked(l: Column, r: Column) -> Column:
        apart = (r["root"] == F.col("top")) | (l["id"] < r["id"])
        first = F.element_at(F.array_intersect(l["buckets"], r["buckets"]), 1) == F.col("bucket")  # a pair is compared in one of its buckets
        return apart & (l["root"] != r["root"]) & may(lambda c: l[c], lambda c: r[c]) & first & same(l["u"], r["u"])

    both = F.struct(each("ls").alias("ls"), each("rs").alias("rs"))
    found = once(both, lambda s: F.flatten(F.transform(s["ls"], lambda l: F.transform(F.filter(s["rs"], lambda r: linked(l, r)), lambda r: F.struct(l["id"].alias("a"), r["id"].alias("b"))))))
    return materialize(two.select(F.explode(found).alias("x")).select("x.a", "x.b"))


def sized_buckets(members: DataFrame) -> DataFrame:
    """members (bucket, id, ...) with n, their number in the bucket, without buckets of one. Counts are added up by task
    first and joined back, so that a large bucket is no window of one task. members is read twice: it should be stored."""
    n = members.groupBy("bucket").agg(F.count("id").alias("n")).where("n > 1")
    return members.join(n, "bucket")


def sized_in_place(members: DataFrame) -> DataFrame:
    """The same for members that aren't stored, rows (bucket, id) that repeat taken once: one shuffle by bucket, and a window over
    each bucket that spills. All rows of one bucket pass through one task."""
    m = members.repartition("bucket").dropDuplicates(["bucket", "id"])
    return m.withColumn("n", F.count("id").over(Window.partitionBy("bucket"))).where("n > 1")
