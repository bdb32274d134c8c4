"""Links and connected groups for the operators that look for copies."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pagelore.llm.common import cut

MAX_ROUNDS = 60
#: Members of a key's largest group, and as many of its others, that those outside it meet in a round.
LEADERS = 8
#: Most rounds of leaders, and the least even where they merge nothing.
ROUNDS, LEAST_ROUNDS = 5, 2


def components(links: DataFrame) -> DataFrame:
    """``id``, ``root`` (least id of its group) of every id in ``links`` (``a``, ``b``), by large and small stars.

    Each round is two joins on narrow rows, written to the checkpoint folder.  A hot node's links are a
    joined side that adaptive execution splits; its minimum is combined before the shuffle.
    """
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct())
    mark = None
    for _ in range(MAX_ROUNDS):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = cut(small.unionByName(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == mark:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
        mark = now
    raise RuntimeError(f"groups did not settle in {MAX_ROUNDS} rounds")


def linked_groups(postings: DataFrame, nodes: DataFrame, passes: Callable[[Callable, Callable], Column],
                  verify: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """Groups of the ids that share a key, pass the cheap test and are verified; ``id``, ``root`` as in ``components``.

    ``postings``: ``key``, ``id``; ``nodes``: one row per id with what the test reads and ``weight``.  Pairs are
    never listed within a key.  First each member meets the key's most shared, weightiest member.  Then, round by
    round, members outside the key's largest group meet a few leaders of it and a few of their own, other ones each
    round, so that several groups in one key grow by a few links a member and not by their pairs.  Rounds go on while
    they merge groups, up to a few.  At last members outside the largest group meet all that are not in their own, so every
    candidate pair is verified or already in one group.
    """
    # one exchange of the postings: the count of a key comes from a window over it
    members = cut(postings.select("key", "id", F.count(F.lit(1)).over(Window.partitionBy("key")).alias("n")).filter("n > 1"))
    popular = members.groupBy("id").agg(F.sum("n").alias("popularity")).join(nodes.select("id", "weight"), "id")
    ranked = members.select("key", "id").join(popular.select("id", F.struct("weight", "popularity", "id").alias("rank")), "id")
    attributes = [c for c in nodes.columns if c != "id"]

    leaders = ranked.groupBy("key").agg(F.max("rank").alias("top")).select("key", F.col("top.id").alias("leader"))
    led = members.join(leaders, "key").filter("id <> leader").select("id", "leader").distinct()
    side = lambda name: nodes.select(F.col("id").alias(name), F.struct(*attributes).alias(f"_{name}"))
    led = led.select(F.col("id").alias("a"), F.col("leader").alias("b")).join(side("a"), "a").join(side("b"), "b")
    tested = cut(led.filter(passes(lambda c: F.col(f"_a.{c}"), lambda c: F.col(f"_b.{c}"))).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    first = cut(verify(tested))

    def outside(some: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame, int]:
        """Of ``some`` the members of keys that hold more than one group (``main``: of the largest); those outside it; the groups of these keys.

        Rows written are narrow: what the test reads is fetched for those that meet.
        """
        placed = some.select("key", "id").join(components(links), "id", "left").select("key", "id", F.coalesce("root", "id").alias("group"))
        sizes = placed.groupBy("key", "group").agg(F.count(F.lit(1)).alias("n"))
        open_ = cut(sizes.groupBy("key").agg(F.count(F.lit(1)).alias("groups"), F.max(F.struct("n", "group")).alias("top")).filter("groups > 1").select("key", "groups", F.col("top.group").alias("largest")))
        rest = cut(placed.join(open_.drop("groups"), "key").select("key", "id", "group", (F.col("group") == F.col("largest")).alias("main")))
        return rest, rest.filter("NOT main"), open_.agg(F.sum("groups")).first()[0] or 0

    def meet(x: DataFrame, y: DataFrame, when: Column) -> DataFrame:
        x, y = x.join(nodes, "id").alias("x"), y.join(nodes, "id").alias("y")
        met = x.join(y, (F.col("x.key") == F.col("y.key")) & (F.col("x.group") != F.col("y.group")) & when & passes(lambda c: F.col(f"x.{c}"), lambda c: F.col(f"y.{c}")))
        return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    links = first
    rest, others, groups = outside(members, links)
    for turn in range(ROUNDS):
        if not groups:
            break
        place = F.row_number().over(Window.partitionBy("key", "main").orderBy(F.xxhash64("id", F.lit(turn)), "id"))
        few = rest.withColumn("place", place).filter(F.col("place") <= LEADERS)
        more = cut(meet(others, few, F.lit(True)).join(tested, ["a", "b"], "left_anti"))
        before = groups
        if not more.isEmpty():
            links, tested = cut(links.unionByName(verify(more))), cut(tested.unionByName(more))
            rest, others, groups = outside(rest, links)  # a key with one group stays so
        if groups == before and turn + 1 >= LEAST_ROUNDS:
            break

    once = F.col("y.main") | (F.col("x.id") < F.col("y.id"))
    pairs = cut(meet(others, rest, once).join(tested, ["a", "b"], "left_anti"))
    return components(links if pairs.isEmpty() else links.unionByName(verify(pairs)))
