"""Run-statistics, execution-tree and counter queries over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import stats as S
from corvid.operators import tree as X
from corvid.plans.registry import query
from corvid.session import table
from corvid.sources.files import tree_dot


def runs(spark, d):
    """One run per user; a sample per event."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("t_us"), "event_type", F.col("value").alias("mem"), (F.col("event_id") % 17).alias("states"))


_R = "r AS (SELECT user_id AS run, event_id AS seq, epoch_us(ts) AS t_us, event_type, value AS mem, event_id % 17 AS states FROM events)"
_LAST = f"WITH {_R} SELECT run, seq, mem, states FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY seq DESC) AS k FROM r) WHERE k = 1"


@query("limit_last1", _LAST)
@query("win_last_record", _LAST)
def win_last_record(spark, d):
    return S.last_record(runs(spark, d)).select("run", "seq", "mem", "states")


@query("agg_max_avg", f"WITH {_R} SELECT run, max(mem) AS max_mem, round(avg(mem), 6) AS avg_mem, max(states) AS max_states, round(avg(states), 6) AS avg_states FROM r GROUP BY run")
def agg_max_avg(spark, d):
    return S.run_aggregates(runs(spark, d)).select("run", "max_mem", F.round("avg_mem", 6).alias("avg_mem"), "max_states", F.round("avg_states", 6).alias("avg_states"))


_BUCKET = f"WITH {_R}, b AS (SELECT run, t_us // 86400000000 AS bucket, round(avg(mem), 6) AS mean, count(*) AS n FROM r GROUP BY ALL)"


@query("agg_time_bucket", f"{_BUCKET} SELECT * FROM b")
def agg_time_bucket(spark, d):
    return S.time_buckets(runs(spark, d), 86_400_000_000, "mem").withColumn("mean", F.round("mean", 6))


_FIRST = f"{_BUCKET} SELECT run, bucket, mean, n FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY bucket) AS k FROM b) WHERE k <= 3"


@query("limit_points", _FIRST)
@query("stream_live_query", _FIRST)
def limit_points(spark, d):
    return S.time_buckets(runs(spark, d), 86_400_000_000, "mem", limit=3).withColumn("mean", F.round("mean", 6))


@query("filter_stats_range", f"WITH {_R} SELECT run, seq FROM r WHERE t_us BETWEEN (SELECT min(t_us) + 86400000000 FROM r) AND (SELECT min(t_us) + 3 * 86400000000 FROM r)")
def filter_stats_range(spark, d):
    r = runs(spark, d)
    t0 = r.agg(F.min("t_us")).first()[0]
    return S.stats_between(r, t0 + 86_400_000_000, t0 + 3 * 86_400_000_000).select("run", "seq")


@query("time_epoch", "SELECT event_id, epoch_us(ts) AS us, greatest(0, epoch_us(ts) // 1000000 - 1704067200) AS rel FROM events")
def time_epoch(spark, d):
    us = F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)")
    return table(spark, d, "events").select("event_id", us.alias("us"), F.greatest(F.lit(0), F.floor(us / 1_000_000) - 1_704_067_200).alias("rel"))


@query("win_delta_time", f"WITH {_R} SELECT run, seq, t_us - lag(t_us) OVER (PARTITION BY run ORDER BY t_us, seq) AS delta FROM r")
def win_delta_time(spark, d):
    return S.deltas(runs(spark, d), "run", ["t_us", "seq"], "t_us").select("run", "seq", "delta")


@query("win_insts_since_cov", f"WITH {_R}, m AS (SELECT *, sum(CASE WHEN states = 0 THEN 1 ELSE 0 END) OVER (PARTITION BY run ORDER BY seq) AS g FROM r) SELECT run, seq, CASE WHEN g > 0 THEN row_number() OVER (PARTITION BY run, g ORDER BY seq) - 1 END AS since FROM m")
def win_insts_since_cov(spark, d):
    return S.since_flag(runs(spark, d), "run", ["seq"], F.col("states") == 0).select("run", "seq", "since")


@query("win_carry_forward", f"WITH {_R} SELECT run, seq, last_value(CASE WHEN event_type = 'purchase' THEN seq END IGNORE NULLS) OVER (PARTITION BY run ORDER BY seq ROWS UNBOUNDED PRECEDING) AS current FROM r")
def win_carry_forward(spark, d):
    from pyspark.sql.window import Window

    w = Window.partitionBy("run").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return runs(spark, d).select("run", "seq", F.last(F.when(F.col("event_type") == "purchase", F.col("seq")), ignorenulls=True).over(w).alias("current"))


@query("win_weighted_pick", "SELECT o_orderkey FROM (SELECT o_orderkey, w, sum(w) OVER (ORDER BY o_orderkey) AS hi, sum(w) OVER () AS t FROM (SELECT o_orderkey, CAST(floor(o_totalprice) AS BIGINT) AS w FROM orders)) WHERE hi > 0.37 * t AND hi - w <= 0.37 * t")
def win_weighted_pick(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.floor("o_totalprice").cast("bigint").alias("w"))
    return S.weighted_pick(o, "w", "o_orderkey", 0.37).select("o_orderkey")


def wide(spark, d):
    """Wide statistics per order status: one run each."""
    li = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    s = lambda e: F.sum(e).cast("bigint")
    return li.groupBy(F.col("o_orderpriority").alias("Path")).agg(
        s(F.lit(1)).alias("Instructions"), s(F.col("l_linenumber") * 1000).alias("WallTime"), s(F.col("l_linenumber") * 400).alias("UserTime"), s(F.col("l_linenumber") * 300).alias("SolverTime"),
        s(F.lit(1 << 20)).alias("MallocUsage"), F.count_if(F.col("l_returnflag") == "A").alias("CoveredInstructions"), F.count_if(F.col("l_returnflag") != "A").alias("UncoveredInstructions"),
        F.count_if(F.col("l_linestatus") == "F").alias("FullBranches"), F.count_if(F.col("l_linenumber") == 1).alias("PartialBranches"), s(F.lit(2)).alias("NumBranches"),
    )


_W = """w AS (SELECT o_orderpriority AS "Path", count(*) AS n, sum(l_linenumber) AS l, count(*) FILTER (l_returnflag = 'A') AS a, count(*) FILTER (l_linestatus = 'F') AS f, count(*) FILTER (l_linenumber = 1) AS one FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL)"""


@query("proj_derived_stats", f"WITH {_W} SELECT \"Path\", round(l * 0.001::DOUBLE, 6) AS wall_s, round(l * 0.0004::DOUBLE, 6) AS user_s, n::DOUBLE AS mem_mib, n AS icount, round(100.0::DOUBLE * a / n, 6) AS icov, round(100.0::DOUBLE * (2 * f + one) / (4 * n), 6) AS bcov, 40.0::DOUBLE AS rel_user FROM w")
def proj_derived_stats(spark, d):
    x = S.with_derived(wide(spark, d))
    r = lambda c, n: F.round(c, 6).alias(n)
    return x.select("Path", r("WallTime", "wall_s"), r("UserTime", "user_s"), r("MallocUsage", "mem_mib"), F.col("ICount").alias("icount"), r("ICov", "icov"), r("BCov", "bcov"), r("RelUserTime", "rel_user"))


@query("proj_rename_legend", f"WITH {_W} SELECT \"Path\", n AS \"Instrs\", CAST(l * 1000 AS BIGINT) AS \"Time(s)\" FROM w")
def proj_rename_legend(spark, d):
    return S.rename_legend(wide(spark, d)).select("Path", "Instrs", "`Time(s)`")


@query("proj_preset_columns", f"WITH {_W} SELECT \"Path\", n AS \"Instrs\", round(l * 0.001::DOUBLE, 6) AS \"Time(s)\", round(100.0::DOUBLE * a / n, 6) AS \"ICov(%)\", round(100.0::DOUBLE * (2 * f + one) / (4 * n), 6) AS \"BCov(%)\", n AS \"ICount\", 30.0::DOUBLE AS \"TSolver(%)\" FROM w")
def proj_preset_columns(spark, d):
    x = S.rename_legend(S.select_preset(S.with_derived(wide(spark, d)), "default"))
    return x.select(*[F.round(F.col(f"`{c}`"), 6).alias(c) if t == "double" else F.col(f"`{c}`") for c, t in x.dtypes])


@query("proj_user_columns", f"WITH {_W} SELECT n AS \"Instructions\", \"Path\" FROM w")
def proj_user_columns(spark, d):
    return S.select_user(wide(spark, d), ["Instructions", "Path"])


@query("sort_headers", f"WITH {_W} SELECT \"Path\", n AS \"Instrs\", CAST(2 * n AS BIGINT) AS \"Branches\" FROM w")
@query("except_columns", f"WITH {_W} SELECT \"Path\", n AS \"Instrs\", CAST(2 * n AS BIGINT) AS \"Branches\" FROM w")
def sort_headers(spark, d):
    return S.order_headers(S.rename_legend(wide(spark, d)).select("Branches", "Path", "Instrs"))


@query("limit_schema", "SELECT unnest(['r_regionkey', 'r_name']) AS \"column\", unnest([0, 1]) AS pos")
def limit_schema(spark, d):
    return spark.createDataFrame([(c, i) for i, c in enumerate(table(spark, d, "region").columns)], "column string, pos int")


@query("agg_summary_row", f"WITH {_R}, g AS (SELECT CAST(run AS VARCHAR) AS run, count(*) AS \"N\", max(mem) AS \"MaxMem\", round(avg(mem), 6) AS \"AvgMem\", CASE WHEN run % 3 > 0 THEN 50.0::DOUBLE END AS \"Cov(%)\" FROM r GROUP BY r.run) SELECT run, \"N\", \"MaxMem\", round(\"AvgMem\", 4) AS \"AvgMem\", round(\"Cov(%)\", 4) AS \"Cov(%)\" FROM g UNION ALL SELECT 'Total', CAST(sum(\"N\") AS BIGINT), max(\"MaxMem\"), round(sum(\"AvgMem\") / count(*), 4), round(sum(\"Cov(%)\") / count(*), 4) FROM g")
def agg_summary_row(spark, d):
    g = runs(spark, d).groupBy("run").agg(F.count("*").alias("N"), F.max("mem").alias("MaxMem"), F.round(F.avg("mem"), 6).alias("AvgMem"))
    g = g.withColumn("Cov(%)", F.when(F.col("run") % 3 > 0, 50.0)).withColumn("run", F.col("run").cast("string"))
    out = S.with_summary(g, "run")
    return out.select("run", "N", "MaxMem", F.round("AvgMem", 4).alias("AvgMem"), F.round("`Cov(%)`", 4).alias("Cov(%)"))


@query("union_ragged", "SELECT r_regionkey AS k, r_name AS a, NULL::VARCHAR AS b FROM region UNION ALL SELECT n_nationkey, NULL, n_name FROM nation")
def union_ragged(spark, d):
    r = table(spark, d, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("a"))
    return S.union_runs([r, table(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_name").alias("b"))])


@query("proj_common_prefix", "SELECT event_id, event_type || '/' || user_id AS path FROM events")
def proj_common_prefix(spark, d):
    e = table(spark, d, "events").select("event_id", F.concat_ws("/", F.lit("/data/runs"), "event_type", "user_id").alias("path"))
    return S.strip_common_prefix(e, "path")


@query("agg_coverage_counters", "WITH v AS (SELECT l_partkey AS b, max(CASE WHEN l_returnflag = 'A' THEN 1 ELSE 0 END) AS t, max(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END) AS f FROM lineitem GROUP BY 1) SELECT count(*) AS branches, count(*) FILTER (t = 1 AND f = 1) AS \"full\", count(*) FILTER (t + f = 1) AS partial FROM v")
def agg_coverage_counters(spark, d):
    li = table(spark, d, "lineitem").select(F.col("l_partkey").alias("branch"), (F.col("l_returnflag") == "A").alias("taken_true"), (F.col("l_returnflag") == "R").alias("taken_false"))
    return S.coverage(li)


_COUNT = "SELECT event_type, count(*) AS n FROM events GROUP BY 1"


@query("agg_fork_ratio", _COUNT)
@query("agg_counter_increment", _COUNT)
def count_events(spark, d):
    return S.count_events(table(spark, d, "events"), "event_type")


@query("agg_test_pass_rate", "WITH t AS (SELECT o_orderpriority AS grp, o_orderstatus AS outcome, 'case_' || lpad(CAST(o_orderkey AS VARCHAR), 9, '0') AS name, o_orderstatus = 'F' AS passed FROM orders), r AS (SELECT *, row_number() OVER (PARTITION BY grp, outcome ORDER BY name) AS k FROM t) SELECT grp, outcome, count(*) AS n, list(name ORDER BY name) FILTER (k <= 5) AS samples, count(*) FILTER (passed) AS passed, round(100.0::DOUBLE * sum(count(*) FILTER (passed)) OVER (PARTITION BY grp) / sum(count(*)) OVER (PARTITION BY grp), 6) AS pass_pct FROM r GROUP BY grp, outcome")
def agg_test_pass_rate(spark, d):
    from pyspark.sql.window import Window

    t = table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("outcome"), F.concat(F.lit("case_"), F.lpad(F.col("o_orderkey").cast("string"), 9, "0")).alias("name"), (F.col("o_orderstatus") == "F").alias("passed"))
    t = t.withColumn("rank", F.row_number().over(Window.partitionBy("grp", "outcome").orderBy("name")))
    return S.pass_rate(t).withColumn("pass_pct", F.round("pass_pct", 6))


def _istats(spark, d):
    return table(spark, d, "lineitem").filter("l_linenumber <= 3").select(F.col("l_linenumber").alias("run"), (F.col("l_partkey") % 50).alias("pos"), F.col("l_suppkey").alias("I"), (F.col("l_orderkey") % 7).alias("Icov"), (F.col("l_orderkey") % 11 + 1).alias("Iuncov"))


_MERGE = "SELECT l_partkey % 50 AS pos, CAST(sum(l_suppkey) AS BIGINT) AS \"I\", max(l_orderkey % 7) AS \"Icov\", min(l_orderkey % 11 + 1) AS \"Iuncov\", true AS agrees FROM lineitem WHERE l_linenumber <= 3 GROUP BY 1"


@query("equal_all_inputs", _MERGE)
@query("join_istats_merge", _MERGE)
@query("agg_istats_merge", _MERGE)
def agg_istats_merge(spark, d):
    return S.merge_istats(_istats(spark, d))


@query("agg_istats_sum", "WITH f AS (SELECT l_suppkey AS file, l_returnflag AS event, sum(l_partkey) AS total FROM lineitem GROUP BY ALL) SELECT event, CAST(sum(total) AS BIGINT) AS \"sum\", count(*) AS files, CAST(sum(total) // count(*) AS BIGINT) AS mean FROM f GROUP BY event")
def agg_istats_sum(spark, d):
    return S.sum_istats(table(spark, d, "lineitem").select(F.col("l_suppkey").alias("file"), F.col("l_returnflag").alias("event"), F.col("l_partkey").alias("value")))


def heap(spark, d):
    """A heap-shaped binary tree over the orders: the k-th has the children 2k and 2k + 1."""
    o = table(spark, d, "orders")
    n = o.count()
    own = o.select((F.col("o_orderkey")).alias("k"), "o_orderstatus")
    from pyspark.sql.window import Window

    at = own.select(F.row_number().over(Window.orderBy("k")).cast("long").alias("id"), "o_orderstatus")
    full = n if n % 2 else n - 1  # an odd number of nodes has no single child
    at = at.filter(F.col("id") <= full)
    child = lambda c: F.when(c <= full, c).otherwise(F.lit(0)).cast("long")
    kind = F.when(F.col("o_orderstatus") == "F", 0).when(F.col("o_orderstatus") == "O", 2).otherwise(7)
    return at.select("id", child(2 * F.col("id")).alias("left"), child(2 * F.col("id") + 1).alias("right"), kind.alias("kind"), (F.col("id") % 40).alias("line"))


_H = """n AS (SELECT count(*) - 1 + count(*) % 2 AS n FROM orders), t AS (SELECT id, CASE WHEN 2 * id <= n THEN 2 * id ELSE 0 END AS l, CASE o_orderstatus WHEN 'F' THEN 0 WHEN 'O' THEN 2 ELSE 7 END AS kind, id % 40 AS line, 2 * id > n AS leaf, length(bin(id)) AS depth
FROM (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_orderstatus FROM orders), n WHERE id <= n)"""


@query("ext_dfs_callbacks", f"WITH {_H} SELECT id, CAST(depth AS INTEGER) AS depth FROM t")
@query("tree_dfs", f"WITH {_H} SELECT id, CAST(depth AS INTEGER) AS depth FROM t")
def tree_dfs(spark, d):
    return X.with_depth(heap(spark, d)).select("id", "depth")


@query("sort_count_desc", f"WITH {_H} SELECT kind, count(*) AS n FROM t WHERE NOT leaf GROUP BY kind")
@query("agg_branch_types", f"WITH {_H} SELECT kind, count(*) AS n FROM t WHERE NOT leaf GROUP BY kind")
def agg_branch_types(spark, d):
    return X.branch_counts(heap(spark, d))


@query("agg_termination_types", f"WITH {_H} SELECT kind, count(*) AS n FROM t WHERE leaf GROUP BY kind")
def agg_termination_types(spark, d):
    return X.termination_counts(heap(spark, d))


@query("agg_depths", f"WITH {_H} SELECT CAST(depth AS INTEGER) AS depth, count(*) AS n FROM t WHERE leaf GROUP BY depth")
def agg_depths(spark, d):
    return X.depth_histogram(heap(spark, d))


@query("agg_tree_info", f"WITH {_H} SELECT count(*) AS nodes, count(*) FILTER (leaf) AS leaves, count(*) FILTER (leaf) = count(*) // 2 + 1 AS is_binary, CAST(max(depth) AS INTEGER) AS max_depth, round(avg(depth) FILTER (leaf), 6) AS mean_leaf_depth FROM t")
def agg_tree_info(spark, d):
    return X.tree_info(heap(spark, d)).withColumn("mean_leaf_depth", F.round("mean_leaf_depth", 6))


@query("agg_instructions", f"WITH {_H}, g AS (SELECT line, kind, leaf, count(*) AS n FROM t GROUP BY ALL) SELECT line, CAST(sum(CASE WHEN leaf THEN 0 ELSE n END) AS BIGINT) AS branches, CAST(sum(CASE WHEN leaf THEN n ELSE 0 END) AS BIGINT) AS terminations, coalesce(string_agg(kind || '(' || n || ');', '' ORDER BY kind) FILTER (leaf), '') AS kinds FROM g GROUP BY line")
def agg_instructions(spark, d):
    return X.instruction_summary(heap(spark, d))


@query("validate_exec_tree", f"WITH {_H} SELECT 'unknown_branch' AS rule, id FROM t WHERE NOT leaf AND kind = 7 UNION ALL SELECT 'unknown_termination', id FROM t WHERE leaf AND kind = 0")
def validate_exec_tree(spark, d):
    return X.tree_violations(heap(spark, d), [0, 2], [2, 7])


@query("tree_compress", f"WITH {_H} SELECT id, l AS \"left\" FROM t")
def tree_compress(spark, d):
    return X.compress_tree(heap(spark, d)).select("id", "left")


@query("sink_exec_tree_dot", f"WITH {_H} SELECT 'n' || id || CASE WHEN leaf THEN ' [color=red];' ELSE ' [color=green];' END AS line FROM t UNION ALL SELECT 'n' || id || ' -> n' || l || ';' FROM t WHERE NOT leaf UNION ALL SELECT 'n' || id || ' -> n' || (l + 1) || ';' FROM t WHERE NOT leaf")
def sink_exec_tree_dot(spark, d):
    return tree_dot(heap(spark, d)).select("line")
