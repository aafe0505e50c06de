"""Constraint queries over bounded domains, slicing by shared cells, set containment and caches."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.operators.graph import components
from corvid.staging import stage


def constraint_components(footprints: DataFrame) -> DataFrame:
    """(constraint, component) by shared cells, transitively; footprints: (constraint, cell)."""
    links = footprints.select(F.concat(F.lit("c"), F.col("constraint").cast("string")).alias("a"), F.concat(F.lit("x"), F.col("cell").cast("string")).alias("b")).distinct()
    return components(links).filter("node LIKE 'c%'").select(F.expr("substring(node, 2)").alias("constraint"), F.expr("substring(label, 2)").alias("component"))


def relevant_constraints(footprints: DataFrame, cells: DataFrame) -> DataFrame:
    """Constraints that touch the query's cells, directly or through other constraints."""
    near = stage(cells.select("cell").distinct())
    have = stage(footprints.select("constraint").limit(0))
    while True:
        hit = stage(footprints.join(near, "cell", "left_semi").select("constraint").distinct().join(have, "constraint", "left_anti"))
        if hit.isEmpty():
            return have
        have = have.unionByName(hit)
        near = footprints.join(hit, "constraint", "left_semi").select("cell").distinct()


#: Ids of one piece of a class, and pairs that one key of the last join of contained_sets brings about at most.
PIECE, WORK = 1024, 1 << 24
#: Pairs of classes that one key of the first join of contained_sets compares, about.
TESTS = 1 << 20


def _classes(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(classes, pieces) of sets with equal items: (items, n: number of ids) and (items, piece, ids: at most some PIECE ones)."""
    sets = stage(df)
    classes = stage(sets.groupBy("items").agg(F.count("*").alias("n")))
    piece = F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / PIECE)).alias("piece")
    none = F.array(F.lit(None).cast(df.schema["id"].dataType))
    ids = F.concat(F.collect_list("id"), F.when(F.bool_or(F.col("id").isNull()), none).otherwise(F.slice(none, F.lit(1), F.lit(0))))
    return classes, sets.join(classes, "items").groupBy("items", piece).agg(ids.alias("ids"))


def _bits(items: str) -> Column:
    """64 bits of the items' hashes: a bit that another set lacks shows an item that it lacks."""
    return F.expr(f"aggregate({items}, 0L, (s, x) -> s | shiftleft(1L, CAST(pmod(xxhash64(x), 64) AS INT)))")


def contained_sets(a: DataFrame, b: DataFrame, predicate: Column | None = None) -> DataFrame:
    """(a, b) where a's set is part of b's: rows (id, item); the predicate sees columns a and b. A null item equals none.

    Sets with equal items are compared once, as a class: those of a meet the ones of b that have their rarest item.
    Pairs of ids come last, from pieces of both classes, and are neither shuffled nor grouped.
    """
    sets = lambda df: df.groupBy("id").agg(F.array_sort(F.collect_set("item")).alias("items"), F.bool_or(F.col("item").isNull()).alias("_null"))
    classes_a, pieces_a = _classes(sets(a).filter("id IS NOT NULL AND NOT _null").select("id", "items"))
    classes_b, pieces_b = _classes(sets(b).filter("size(items) > 0").select("id", "items"))
    index = classes_b.select(F.col("items").alias("items_b"), F.col("n").alias("n_b"), _bits("items").alias("bits_b"), F.explode("items").alias("item"))
    best = F.min(F.struct("df", "item")).alias("best")
    rarest = stage(classes_a.select("items", "n", F.explode("items").alias("item")).join(index.groupBy("item").agg(F.count("*").alias("df")), "item").groupBy("items", "n").agg(best).select("items", "n", "best.*"))
    tests = rarest.groupBy("item").agg(F.ceil(F.count("*") * F.max("df") / TESTS).alias("salts"))
    asked = rarest.join(tests, "item").select("items", "n", _bits("items").alias("bits"), "item", F.pmod(F.xxhash64("items"), "salts").alias("salt"))
    tasks = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # given as a number, so that few bytes with much work stay apart
    index = index.join(tests, "item").withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1))).drop("salts")
    may = asked.repartition(tasks, "item", "salt").join(index.repartition(tasks, "item", "salt"), ["item", "salt"])
    if a.schema["item"].dataType == b.schema["item"].dataType:  # equal values of two types have two hashes
        may = may.filter(F.col("bits").bitwiseAND(F.bitwise_not("bits_b")) == 0)
    pairs = stage(may.filter(F.size(F.array_except("items", "items_b")) == 0).select("items", "n", "items_b", "n_b"))
    salts = stage(pairs.groupBy("items", "n").agg(F.ceil(F.sum("n_b") * F.col("n") / WORK).alias("salts")).drop("n"))
    left = pairs.select("items", "items_b").join(salts, "items").join(pieces_b.toDF("items_b", "piece", "ids_b"), "items_b").select("items", F.pmod(F.xxhash64("items_b", "piece"), "salts").alias("salt"), "ids_b")
    right = pieces_a.join(salts, "items").select("items", F.explode(F.sequence(F.lit(0).cast("long"), F.col("salts") - 1)).alias("salt"), F.col("ids").alias("ids_a"))
    ones = left.join(right, ["items", "salt"]).select("ids_a", F.explode("ids_b").alias("b"))
    # No partition is merged by so many; coalesce ends the generated code, which else holds all pairs of two pieces at once.
    out = ones.coalesce(1 << 20).select(F.explode("ids_a").alias("a"), "b")
    return out.filter(predicate) if predicate is not None else out


def assignments(spark: SparkSession, domains: dict[str, int]) -> DataFrame:
    """All assignments of variables to 0 .. size - 1: numbers of one range in mixed radix, so that nothing is crossed."""
    total = 1
    for n in domains.values():
        total *= n
    df, below = spark.range(total), 1
    for name, n in domains.items():
        df = df.withColumn(name, F.floor(F.col("id") / below).cast("bigint") % n)
        below *= n
    return df.drop("id")


def solve_bounded(spark: SparkSession, domains: dict[str, int], constraints: Column, expr: Column) -> DataFrame:
    """One row: validity (VALID, INVALID), three_valued (True, False, Unknown) of a condition, and a least counterexample."""
    rows = assignments(spark, domains).filter(constraints).withColumn("_ok", expr)
    row = F.struct(*domains)
    out = rows.agg(F.coalesce(F.bool_and("_ok"), F.lit(True)).alias("all"), F.coalesce(F.bool_or("_ok"), F.lit(False)).alias("any"), F.min(F.when(~F.col("_ok"), row)).alias("counterexample"))
    return out.select(F.when(F.col("all"), "VALID").otherwise("INVALID").alias("validity"), F.when(F.col("all"), "True").when(F.col("any"), "Unknown").otherwise("False").alias("three_valued"), "counterexample")


def value_range(spark: SparkSession, domains: dict[str, int], constraints: Column, expr: Column) -> DataFrame:
    """Least and greatest value of an expression under constraints, and the value of the least assignment."""
    rows = assignments(spark, domains).filter(constraints).withColumn("_v", expr)
    return rows.agg(F.min("_v").alias("lo"), F.max("_v").alias("hi"), F.min_by("_v", F.struct(*domains)).alias("value"))


def cached_validity(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """Answers of queries (id, key, negated: text of q and of its negation) from a cache by canonical key.

    The lesser text is the key; a query that is stored under its negation gets the negated answer.
    """
    canonical = F.least("key", "negated")
    q = queries.withColumn("_k", canonical).withColumn("_neg", F.col("key") != canonical)
    return q.join(cache.select(F.col("key").alias("_k"), "answer"), "_k", "left").select("id", F.when(F.col("_neg"), ~F.col("answer")).otherwise(F.col("answer")).alias("answer"))


def reuse_assignments(queries: DataFrame, cache: DataFrame) -> DataFrame:
    """How a constraint set (id, item) is answered from cached ones (id, item, sat): exact, sat_superset, unsat_subset or none."""
    sets = cache.select("id", "item")
    verdict = cache.select(F.col("id").alias("c"), "sat").distinct()
    size = lambda df, n: df.groupBy("id").agg(F.count_distinct("item").alias(n))
    up = contained_sets(queries, sets).withColumnsRenamed({"a": "id", "b": "c"}).join(verdict, "c").join(size(queries, "n"), "id").join(size(sets, "m").withColumnRenamed("id", "c"), "c")
    down = contained_sets(sets, queries).withColumnsRenamed({"a": "c", "b": "id"}).join(verdict, "c")
    found = up.select("id", F.when(F.col("n") == F.col("m"), 1).when(F.col("sat"), 2).alias("p")).unionByName(down.select("id", F.when(~F.col("sat"), 3).alias("p"))).groupBy("id").agg(F.min("p").alias("p"))
    how = F.coalesce(F.element_at(F.create_map(F.lit(1), F.lit("exact"), F.lit(2), F.lit("sat_superset"), F.lit(3), F.lit("unsat_subset")), F.col("p")), F.lit("none"))
    return queries.select("id").distinct().join(found, "id", "left").select("id", how.alias("how"))


def cross_check(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of either result that the other lacks."""
    return a.exceptAll(b).withColumn("side", F.lit("a")).unionByName(b.exceptAll(a).withColumn("side", F.lit("b")))


def solver_counts(results: DataFrame) -> DataFrame:
    return results.agg(F.count("*").alias("queries"), F.count_if(F.col("validity") == "VALID").alias("valid"), F.count_if(F.col("validity") == "INVALID").alias("invalid"), F.count_if("has_model").alias("counterexamples"))
