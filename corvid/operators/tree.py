"""Execution trees: (id, left, right, kind, line), root id 1, 0 for no child."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corvid.staging import stage

#: Branch kinds by code.
BRANCHES = {0: "Conditional", 1: "Indirect", 2: "Switch", 3: "Call", 4: "MemOp", 5: "ResolvePointer", 6: "Alloc", 7: "Realloc", 8: "Free", 9: "GetVal"}


def leaf(left: str = "left", right: str = "right") -> Column:
    return (F.col(left) == 0) & (F.col(right) == 0)


def children(tree: DataFrame) -> DataFrame:
    return tree.select("id", F.explode(F.array("left", "right")).alias("child")).filter("child <> 0")


def _one_less(doublings: int) -> int:
    """A chain of n nodes ends after log2(n) doublings; a longer one is a loop."""
    if not doublings:
        raise ValueError("the tree has a loop")
    return doublings - 1


def with_depth(tree: DataFrame) -> DataFrame:
    """tree with depth (root: 1), by pointer doubling: log2(depth) joins instead of one per level."""
    up = children(tree).select(F.col("child").alias("id"), F.col("id").alias("up"), F.lit(1).alias("d"))
    at = stage(tree.select("id").join(up, "id", "left").select("id", "up", F.coalesce("d", F.lit(0)).alias("d")))
    doublings = tree.count().bit_length() + 1
    while not at.filter("up IS NOT NULL").isEmpty():
        doublings = _one_less(doublings)
        over = at.select(F.col("id").alias("up"), F.col("up").alias("up2"), F.col("d").alias("d2"))
        at = stage(at.join(over, "up", "left").select("id", F.col("up2").alias("up"), (F.col("d") + F.coalesce("d2", F.lit(0))).alias("d")))
    return tree.join(at.select("id", (F.col("d") + 1).alias("depth")), "id")


def branch_counts(tree: DataFrame) -> DataFrame:
    return tree.filter(~leaf()).groupBy("kind").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "kind")


def termination_counts(tree: DataFrame) -> DataFrame:
    return tree.filter(leaf()).groupBy("kind").agg(F.count("*").alias("n")).orderBy("kind")


def depth_histogram(tree: DataFrame) -> DataFrame:
    return with_depth(tree).filter(leaf()).groupBy("depth").agg(F.count("*").alias("n"))


def tree_info(tree: DataFrame) -> DataFrame:
    d = with_depth(tree)
    n, leaves = F.count("*"), F.count_if(leaf())
    return d.agg(n.alias("nodes"), leaves.alias("leaves"), (leaves == F.floor(n / 2) + 1).alias("is_binary"), F.max("depth").alias("max_depth"), F.avg(F.when(leaf(), F.col("depth"))).alias("mean_leaf_depth"))


def instruction_summary(tree: DataFrame) -> DataFrame:
    """Per line: branches, terminations, and `kind(n);` of the terminations in code order."""
    by = tree.groupBy("line", "kind", leaf().alias("is_leaf")).agg(F.count("*").alias("n"))
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col("is_leaf"), F.struct("kind", "n")))), lambda x: F.concat(x["kind"].cast("string"), F.lit("("), x["n"].cast("string"), F.lit(");"))), "")
    return by.groupBy("line").agg(F.sum(F.when(~F.col("is_leaf"), F.col("n")).otherwise(0)).alias("branches"), F.sum(F.when(F.col("is_leaf"), F.col("n")).otherwise(0)).alias("terminations"), listed.alias("kinds"))


def tree_violations(tree: DataFrame, branch_kinds: list[int], leaf_kinds: list[int]) -> DataFrame:
    """(rule, id) of all that is wrong with a tree."""
    kids = children(tree)
    top = tree.agg(F.max("id").alias("top"))
    rule = lambda name, df: df.select(F.lit(name).alias("rule"), F.col("id"))
    return reduce(
        DataFrame.unionByName,
        [
            rule("id_zero", tree.filter("id = 0")),
            rule("child_beyond_max", kids.crossJoin(F.broadcast(top)).filter("child > top").select("id").distinct()),  # one row
            rule("one_child", tree.filter("(left = 0) <> (right = 0)")),
            rule("visited_twice", kids.groupBy(F.col("child").alias("id")).count().filter("count > 1")),
            rule("root_is_child", kids.filter("child = 1").select(F.col("child").alias("id")).distinct()),
            rule("undefined", kids.select(F.col("child").alias("id")).distinct().join(tree.select("id"), "id", "left_anti")),
            rule("unknown_branch", tree.filter(~leaf() & ~F.col("kind").isin(branch_kinds))),
            rule("unknown_termination", tree.filter(leaf() & ~F.col("kind").isin(leaf_kinds))),
        ],
    )


def compress_tree(tree: DataFrame) -> DataFrame:
    """The tree without its single-child nodes: each child pointer goes on to the next node with two or no children."""
    one = tree.filter("(left = 0) <> (right = 0)").select("id", F.greatest("left", "right").alias("to"))
    hop = stage(one)
    doublings = hop.count().bit_length() + 1
    while True:
        doublings = _one_less(doublings)
        far = hop.select(F.col("id").alias("to"), F.col("to").alias("to2"))
        new = stage(hop.join(far, "to", "left").select("id", F.coalesce("to2", "to").alias("to"), F.col("to2").isNotNull().alias("moved")))
        if new.filter("moved").isEmpty():
            break
        hop = new.drop("moved")
    keep = tree.join(one.select("id"), "id", "left_anti")
    for c in ("left", "right"):
        keep = keep.join(hop.select(F.col("id").alias(c), F.col("to").alias("_to")), c, "left").withColumn(c, F.coalesce("_to", c)).drop("_to")
    return keep.select(tree.columns)
