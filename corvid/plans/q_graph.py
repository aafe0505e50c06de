"""Graph, interval and containment queries over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.operators import constraints as C
from corvid.operators import graph as G
from corvid.operators import intervals as I
from corvid.operators import triage
from corvid.plans.registry import query
from corvid.session import table


def nation_graph(spark, d):
    """Calls between nations: customers' to suppliers', of large discounted lines; every fifth pair weighs as a guess."""
    li = table(spark, d, "lineitem").filter("l_quantity >= 50 AND l_discount >= 0.10").select("l_orderkey", "l_suppkey")
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_custkey").alias("c_custkey"))
    c = table(spark, d, "customer").select("c_custkey", "c_nationkey")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    e = li.join(o, "l_orderkey").join(c, "c_custkey").join(s, "l_suppkey").select("c_nationkey", "s_nationkey").distinct()
    guess = (F.col("c_nationkey") + F.col("s_nationkey")) % 5 == 0
    return e.select(F.col("c_nationkey").cast("string").alias("src"), F.col("s_nationkey").cast("string").alias("dst"), F.when(guess, "IndirectCall").otherwise("DirectCall").alias("type"), F.when(guess, G.INDIRECT).otherwise(1.0).alias("weight"))


def nation_queries(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select(k.cast("long").alias("query_id"), k.cast("string").alias("src"), ((k * 7 + 3) % 25).cast("string").alias("dst"))


_E = """e AS (SELECT DISTINCT CAST(c_nationkey AS VARCHAR) AS src, CAST(s_nationkey AS VARCHAR) AS dst,
  CASE WHEN (c_nationkey + s_nationkey) % 5 = 0 THEN 1000000.0::DOUBLE ELSE 1.0::DOUBLE END AS weight
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey
  WHERE l_quantity >= 50 AND l_discount >= 0.10)"""
_Q = "q AS (SELECT CAST(n_nationkey AS BIGINT) AS query_id, CAST(n_nationkey AS VARCHAR) AS src, CAST((n_nationkey * 7 + 3) % 25 AS VARCHAR) AS dst FROM nation)"
_COST = f"""WITH RECURSIVE {_E}, {_Q}, r(src, node, cost, hops) AS (
  SELECT DISTINCT src, src, 0.0::DOUBLE, 0 FROM q UNION SELECT r.src, e.dst, r.cost + CASE WHEN {{unit}} THEN 1.0::DOUBLE ELSE e.weight END, hops + 1 FROM r JOIN e ON e.src = r.node WHERE hops < 12)"""
_WEIGHTED = _COST.format(unit="false") + " SELECT q.query_id, q.src, q.dst, min(cost) AS cost FROM q JOIN r ON r.src = q.src AND r.node = q.dst GROUP BY ALL"
_HOPS = _COST.format(unit="true") + " SELECT q.query_id, q.src, q.dst, min(cost) AS cost FROM q JOIN r ON r.src = q.src AND r.node = q.dst GROUP BY ALL"


@query("multi_query_paths", _WEIGHTED)
@query("dijkstra_path", _WEIGHTED)
def dijkstra_path(spark, d):
    return G.run_queries(nation_graph(spark, d), nation_queries(spark, d)).select("query_id", "src", "dst", "cost")


@query("bfs_path", _HOPS)
def bfs_path(spark, d):
    return G.shortest_hops(nation_graph(spark, d), nation_queries(spark, d)).select("query_id", "src", "dst", "cost")


@query("bfs_reachable", _HOPS.replace("SELECT q.query_id, q.src, q.dst, min(cost) AS cost FROM q JOIN r", "SELECT q.query_id, count(r.node) > 0 AS reachable FROM q LEFT JOIN r"))
def bfs_reachable(spark, d):
    q = nation_queries(spark, d)
    seen = G.min_distances(nation_graph(spark, d), q.select("query_id", F.col("src").alias("node")))
    hit = seen.select("query_id", F.col("node").alias("dst"), F.lit(True).alias("_hit"))
    return q.join(hit, ["query_id", "dst"], "left").select("query_id", F.coalesce("_hit", F.lit(False)).alias("reachable"))


@query("min_distances", _COST.format(unit="true") + " SELECT q.query_id, node, CAST(min(cost) AS INTEGER) AS distance FROM q JOIN r ON r.src = q.src GROUP BY ALL")
def min_distances(spark, d):
    return G.min_distances(nation_graph(spark, d), nation_queries(spark, d).select("query_id", F.col("src").alias("node")))


_K = f"""WITH RECURSIVE {_E}, {_Q}, r(query_id, node, goal, cost, nodes) AS (
  SELECT query_id, src, dst, 0.0::DOUBLE, [src] FROM q UNION ALL SELECT r.query_id, e.dst, goal, cost + weight, list_append(nodes, e.dst) FROM r JOIN e ON e.src = r.node
  WHERE len(nodes) <= 3 AND NOT list_contains(nodes, e.dst) AND r.node <> goal)
SELECT query_id, CAST(k AS INTEGER) AS rank, cost FROM (SELECT query_id, cost, row_number() OVER (PARTITION BY query_id ORDER BY cost, len(nodes), nodes) AS k FROM r WHERE node = goal AND len(nodes) > 1) WHERE k <= 3"""


@query("topk_paths", _K)
@query("yen_k_paths", _K)
def k_paths(spark, d):
    return G.k_shortest(nation_graph(spark, d), nation_queries(spark, d), 3, 3).select("query_id", "rank", "cost")


@query("path_weight", _WEIGHTED.replace("min(cost) AS cost", "min(cost) AS total"))
def path_weight(spark, d):
    p = G.shortest_weighted(nation_graph(spark, d), nation_queries(spark, d))
    weights = F.transform("edges", lambda e: F.when(e == "IndirectCall", F.lit(G.INDIRECT)).otherwise(F.lit(1.0)))
    return p.select("query_id", "src", "dst", G.path_weight(weights).alias("total"))


@query("win_path_edges")
def win_path_edges(spark, d):
    return G.path_edges(G.shortest_weighted(nation_graph(spark, d), nation_queries(spark, d)))


@query("str_path_render")
def str_path_render(spark, d):
    p = G.shortest_weighted(nation_graph(spark, d), nation_queries(spark, d))
    return p.select("query_id", G.render_path(F.col("nodes"), F.col("edges")).alias("path"), G.render_path(F.col("nodes"), F.col("edges"), True).alias("call_path"))


@query("join_node_props")
def join_node_props(spark, d):
    names = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"), F.col("n_name").alias("label"))
    return triage.decorate_paths(G.shortest_weighted(nation_graph(spark, d), nation_queries(spark, d)), names)


@query("sink_graph_csv")
def sink_graph_csv(spark, d):
    return triage.reach_csv(G.shortest_weighted(nation_graph(spark, d), nation_queries(spark, d)))[0]


@query("candidate_path", "SELECT c || '/' || p AS query_id, src, dst FROM (SELECT CAST(n_regionkey AS VARCHAR) AS c, CAST(n_nationkey AS VARCHAR) AS p, '0:' || n_nationkey AS src, '0:' || lead(n_nationkey) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) AS dst FROM nation) WHERE dst IS NOT NULL")
def candidate_path(spark, d):
    n = table(spark, d, "nation")
    return G.candidate_queries(n.select(F.col("n_regionkey").alias("candidate"), F.col("n_nationkey").alias("pos"), F.col("n_name").alias("name")), n.select(F.lit(0).alias("mid"), F.col("n_nationkey").alias("nid"), F.col("n_name").alias("name")))


_BACK = f"""WITH RECURSIVE {_E}, r(node, d) AS (SELECT '7', 0 UNION SELECT e.src, d + 1 FROM r JOIN e ON e.dst = r.node WHERE d < 25), m AS (SELECT node, min(d) AS distance FROM r GROUP BY node)"""


def _distmap(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("node"))
    seven = n.filter("node = '7'")
    return G.distmap(n, nation_graph(spark, d), seven, seven)


@query("distmap_blacklist", _BACK + " SELECT node, CAST(distance AS INTEGER) AS distance FROM m")
def distmap_blacklist(spark, d):
    return _distmap(spark, d)[0]


@query("anti_blacklist", _BACK + " SELECT CAST(n_nationkey AS VARCHAR) AS node FROM nation ANTI JOIN m ON m.node = CAST(n_nationkey AS VARCHAR)")
def anti_blacklist(spark, d):
    return _distmap(spark, d)[1]


@query("prune_unreachable_states", _BACK + " SELECT n_nationkey AS state FROM nation WHERE CAST(n_nationkey AS VARCHAR) NOT IN (SELECT node FROM m WHERE distance <= 1) AND CAST((n_nationkey + 1) % 25 AS VARCHAR) NOT IN (SELECT node FROM m WHERE distance <= 1)")
def prune_unreachable_states(spark, d):
    s = table(spark, d, "nation").select(F.col("n_nationkey").alias("state"), F.array(F.col("n_nationkey").cast("string"), ((F.col("n_nationkey") + 1) % 25).cast("string")).alias("blocks"))
    return G.prune_states(s, _distmap(spark, d)[0].filter("distance <= 1"))


_MINDIST = f"""WITH RECURSIVE {_E}, r(node, dist, hops) AS (SELECT CAST(n_nationkey AS VARCHAR), 0.0::DOUBLE, 0 FROM nation WHERE n_nationkey % 10 = 3 UNION SELECT e.src, dist + weight, hops + 1 FROM r JOIN e ON e.dst = r.node WHERE hops < 12) SELECT node, min(dist) AS dist FROM r GROUP BY node"""


@query("fixpoint_min_dist_return", _MINDIST)
@query("fixpoint_min_dist_uncovered", _MINDIST)
def fixpoint(spark, d):
    goals = table(spark, d, "nation").filter("n_nationkey % 10 = 3").select(F.col("n_nationkey").cast("string").alias("node"), F.lit(0.0).alias("dist"))
    return G.min_dist_fixpoint(nation_graph(spark, d), goals)


@query("call_targets_inverse", f"WITH {_E} SELECT dst AS callee, src AS caller FROM e")
def call_targets_inverse(spark, d):
    return nation_graph(spark, d).select(F.col("dst").alias("callee"), F.col("src").alias("caller"))


@query("graph_add_edge", f"WITH {_E} SELECT src, dst, weight FROM e")
def graph_add_edge(spark, d):
    g = nation_graph(spark, d)
    return G.dedup_edges(g.unionByName(g)).select("src", "dst", "weight")


@query("agg_graph_counts", f"WITH {_E} SELECT (SELECT count(*) FROM nation) AS n_nodes, (SELECT count(*) FROM e) AS n_edges")
def agg_graph_counts(spark, d):
    return G.graph_counts(table(spark, d, "nation"), nation_graph(spark, d))


@query("semi_contains_node", f"WITH {_E} SELECT n_nationkey FROM nation SEMI JOIN e ON src = CAST(n_nationkey AS VARCHAR)")
def semi_contains_node(spark, d):
    g = nation_graph(spark, d).select(F.col("src").cast("int").alias("n_nationkey"))
    return table(spark, d, "nation").join(g, "n_nationkey", "left_semi").select("n_nationkey")


# A program: a region is a module, nations are functions, customers are blocks and orders are call instructions.
def program(spark, d):
    n = table(spark, d, "nation")
    c = table(spark, d, "customer").join(n, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey")
    o = table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "n_regionkey", "n_nationkey")
    text = lambda x: F.lit(x).cast("string")
    long = lambda x: F.col(x).cast("long")
    cols = "mid nid type name linkage call_type function_type address_taken source_file ord".split()
    functions = n.select(long("n_regionkey"), long("n_nationkey"), text("Function"), F.concat(F.lit("f"), F.col("n_nationkey") % 20), F.when(F.col("n_nationkey") % 2 == 0, "ExternalLinkage").otherwise("Other"), text(None), F.concat(F.lit("sig"), F.col("n_nationkey") % 3), F.col("n_nationkey") % 4 == 0, text("a.c"), F.lit(None).cast("long")).toDF(*cols)
    blocks = c.select(long("n_regionkey"), F.col("c_custkey") + 1000, text("BasicBlock"), *[text(None)] * 4, F.lit(None).cast("boolean"), text(None), F.lit(None).cast("long")).toDF(*cols)
    calls = o.select(long("n_regionkey"), F.col("o_orderkey") + 10_000_000, text("Instruction"), text(None), text(None), F.when(F.col("o_orderstatus") == "F", "Direct").when(F.col("o_orderstatus") == "P", "Indirect"), F.concat(F.lit("sig"), F.col("o_orderkey") % 3), F.lit(None).cast("boolean"), text(None), F.col("o_orderkey")).toDF(*cols)
    e = lambda df, s, t, k: df.select(long("n_regionkey").alias("mid"), s.cast("long").alias("src"), t.cast("long").alias("dst"), F.lit(k).alias("kind"))
    contains = e(o, F.col("o_custkey") + 1000, F.col("o_orderkey") + 10_000_000, "Contains")
    called = e(o.filter("o_orderstatus = 'F'"), F.col("o_orderkey") + 10_000_000, F.col("n_regionkey") + 5 * (F.col("o_orderkey") % 5), "Calls")
    entry = e(c.groupBy("n_regionkey", "n_nationkey").agg(F.min("c_custkey").alias("c")), F.col("n_nationkey"), F.col("c") + 1000, "EntryPoint")
    w = Window.partitionBy("n_nationkey").orderBy("c_custkey")
    flow = e(c.withColumn("next", F.lead("c_custkey").over(w)).filter("next IS NOT NULL"), F.col("c_custkey") + 1000, F.col("next") + 1000, "ControlFlowTo")
    return functions.unionByName(blocks).unionByName(calls), contains.unionByName(called).unionByName(entry).unionByName(flow)


_P = """c AS (SELECT c_custkey, n_nationkey, n_regionkey FROM customer JOIN nation ON c_nationkey = n_nationkey),
o AS (SELECT o_orderkey, o_custkey, o_orderstatus, n_regionkey, n_nationkey FROM orders JOIN c ON o_custkey = c_custkey),
f AS (SELECT n_regionkey AS mid, n_nationkey AS nid, 'f' || (n_nationkey % 20) AS name, n_nationkey % 2 = 0 AS ext, 'sig' || (n_nationkey % 3) AS sig, n_nationkey % 4 = 0 AS taken FROM nation),
entry AS (SELECT n_regionkey || ':' || n_nationkey AS src, n_regionkey || ':' || (min(c_custkey) + 1000) AS dst, 'Contains' AS type, 1.0::DOUBLE AS weight FROM c GROUP BY n_regionkey, n_nationkey),
flow AS (SELECT n_regionkey || ':' || (c_custkey + 1000) AS src, n_regionkey || ':' || (nx + 1000) AS dst, 'Succ' AS type, 1.0::DOUBLE AS weight FROM (SELECT *, lead(c_custkey) OVER (PARTITION BY n_nationkey ORDER BY c_custkey) AS nx FROM c) WHERE nx IS NOT NULL),
direct AS (SELECT n_regionkey || ':' || (o_custkey + 1000) AS src, n_regionkey || ':' || (n_regionkey + 5 * (o_orderkey % 5)) AS dst, 'DirectCall' AS type, 1.0::DOUBLE AS weight FROM o WHERE o_orderstatus = 'F'),
indirect AS (SELECT n_regionkey || ':' || (o_custkey + 1000) AS src, mid || ':' || nid AS dst, 'IndirectCall' AS type, 1000000.0::DOUBLE AS weight FROM o JOIN f ON sig = 'sig' || (o_orderkey % 3) AND taken WHERE o_orderstatus = 'P'),
ei AS (SELECT n_regionkey || ':' || (o_custkey + 1000) AS src, mid || ':' || nid AS dst, 'ExternIndirectCall' AS type, 1000000.0::DOUBLE AS weight FROM o JOIN f ON sig = 'sig' || (o_orderkey % 3) AND ext WHERE o_orderstatus = 'P'),
ext AS (SELECT a.mid || ':' || a.nid AS src, b.mid || ':' || b.nid AS dst, 'Extern' AS type, 1000000.0::DOUBLE AS weight FROM f a JOIN f b ON a.name = b.name AND a.ext AND b.ext AND (a.mid, a.nid) <> (b.mid, b.nid))"""
_COLS = "src, dst, type, weight"


@query("join_calls_hash", f"WITH {_P} SELECT {_COLS} FROM direct")
def join_calls_hash(spark, d):
    return G.edges_direct(*program(spark, d))


@query("join_bb_calls", f"WITH {_P} SELECT n_regionkey AS mid, o_custkey + 1000 AS block, o_orderkey + 10000000 AS call FROM o WHERE o_orderstatus IN ('F', 'P')")
def join_bb_calls(spark, d):
    return G.call_sites(*program(spark, d)).select("mid", "block", "call")


@query("join_indirect_by_signature", f"WITH {_P} SELECT {_COLS} FROM indirect")
def join_indirect(spark, d):
    return G.edges_indirect(*program(spark, d))


@query("join_pthread_special", f"WITH {_P} SELECT n_regionkey || ':' || (o_custkey + 1000) AS src, f.mid || ':' || f.nid AS dst, 'IndirectCall' AS type, 1000000.0::DOUBLE AS weight FROM o JOIN f c ON c.mid = n_regionkey AND c.nid = n_regionkey + 5 * (o_orderkey % 5) AND c.name = 'f6' JOIN f ON f.taken AND f.sig = 'sig0' WHERE o_orderstatus = 'F'")
def join_pthread_special(spark, d):
    nodes, edges = program(spark, d)
    as_thread = nodes.withColumn("name", F.when(F.col("name") == "f6", "pthread_create").otherwise(F.col("name"))).withColumn("function_type", F.when(F.col("function_type") == "sig0", G.THREAD_SIGNATURE).otherwise(F.col("function_type")))
    return G.edges_thread(as_thread, edges)


@query("join_extern_indirect", f"WITH {_P} SELECT ei.* FROM ei JOIN f ON ei.dst = f.mid || ':' || f.nid WHERE f.name IN ('f2', 'f4', 'f10')")
def join_extern_indirect(spark, d):
    nodes, edges = program(spark, d)
    return G.edges_extern_indirect(nodes, edges, spark.createDataFrame([("f2", "a"), ("f4", "a"), ("f10", "b"), ("f3", "b")], "symbol string, library string"))


@query("join_extern_self", f"WITH {_P} SELECT {_COLS} FROM ext")
def join_extern_self(spark, d):
    return G.edges_extern(program(spark, d)[0])


@query("join_loaded_symbols", f"WITH {_P} SELECT mid, nid FROM f WHERE name IN ('f2', 'f3')")
def join_loaded_symbols(spark, d):
    return G.loaded_functions(program(spark, d)[0], spark.createDataFrame([("f2", "a"), ("f3", "b"), ("f3", "c")], "symbol string, library string")).select("mid", "nid")


_CFG = f"WITH {_P} SELECT * FROM entry UNION SELECT * FROM flow UNION SELECT * FROM direct UNION SELECT * FROM indirect UNION SELECT * FROM ext UNION SELECT * FROM ei"


@query("union_edges", _CFG)
@query("ext_graph_builder_registry", _CFG)
@query("graph_cfg", _CFG)
def graph_cfg(spark, d):
    return G.GRAPHS["cfg"](*program(spark, d), dynlink=True)


@query("graph_instr_cfg")
def graph_instr_cfg(spark, d):
    return G.GRAPHS["instr_cfg"](*program(spark, d))


_ORDER = "SELECT n_regionkey AS mid, o_custkey + 1000 AS block, o_orderkey + 10000000 AS ins, lead(o_orderkey + 10000000) OVER w AS next, row_number() OVER w = 1 AS is_first, lead(o_orderkey) OVER w IS NULL AS is_last FROM o WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderkey)"


@query("win_first_last", f"WITH {_P} {_ORDER}")
@query("win_succ_pairs", f"WITH {_P} {_ORDER}")
def block_order(spark, d):
    return G.block_order(*program(spark, d)).select("mid", "block", "ins", "next", "is_first", "is_last")


@query("validate_facts", f"WITH {_P} SELECT 'edge_dst_unknown' AS rule, n_regionkey || ':' || (n_nationkey + 500) AS id FROM nation WHERE n_nationkey % 2 = 1")
def validate_facts(spark, d):
    nodes, edges = program(spark, d)
    wrong = table(spark, d, "nation").filter("n_nationkey % 2 = 1").select(F.col("n_regionkey").cast("long").alias("mid"), F.col("n_nationkey").cast("long").alias("src"), (F.col("n_nationkey") + 500).cast("long").alias("dst"), F.lit("References").alias("kind"))
    return G.fact_violations(nodes, edges.unionByName(wrong))


@query("join_module_name", "SELECT n_regionkey AS mid, n_nationkey AS nid, CASE WHEN EXISTS (SELECT 1 FROM nation m WHERE m.n_regionkey = nation.n_regionkey AND m.n_nationkey = nation.n_regionkey) THEN 'm' || n_regionkey END AS module_file FROM nation")
def join_module_name(spark, d):
    n = table(spark, d, "nation").select(F.col("n_regionkey").alias("mid"), F.col("n_nationkey").alias("nid"), F.concat(F.lit("m"), F.col("n_regionkey")).alias("source_file"))
    return triage.with_module_file(n).select("mid", "nid", "module_file")


@query("union_modules", "SELECT n_regionkey AS mid, min(n_nationkey) AS first_nid FROM nation GROUP BY ALL")
def union_modules(spark, d):
    w = Window.partitionBy("n_regionkey").orderBy("n_nationkey")
    return table(spark, d, "nation").withColumn("_r", F.row_number().over(w)).filter("_r = 1").select(F.col("n_regionkey").alias("mid"), F.col("n_nationkey").alias("first_nid"))


@query("callpath_rollup", "SELECT site, callee, sum(v) AS inclusive FROM (SELECT 's' || o_orderstatus AS site, 'p' || substr(o_orderpriority, 1, 1) AS callee, o_custkey AS v FROM orders UNION ALL SELECT 'root', 'main', o_custkey FROM orders) GROUP BY ALL")
def callpath_rollup(spark, d):
    frame = lambda s, c: F.struct(s.alias("site"), c.alias("callee"))
    main, own = frame(F.lit("root"), F.lit("main")), frame(F.concat(F.lit("s"), F.col("o_orderstatus")), F.concat(F.lit("p"), F.substring("o_orderpriority", 1, 1)))
    p = table(spark, d, "orders").select(F.array(main, own, own).alias("path"), F.col("o_custkey").alias("value"))
    return G.rollup_callpaths(p)


@query("callpath_fold_recursion", "SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN ['a', 'b'] WHEN 'O' THEN ['a'] ELSE ['a', 'b', 'c'] END AS path FROM orders")
def callpath_fold_recursion(spark, d):
    raw = F.when(F.col("o_orderstatus") == "F", F.split(F.lit("a,b,c,b"), ",")).when(F.col("o_orderstatus") == "O", F.split(F.lit("a,b,a"), ",")).otherwise(F.split(F.lit("a,b,c"), ","))
    return G.fold_recursion(table(spark, d, "orders").select("o_orderkey", raw.alias("path")))


_CELLS = "fp AS (SELECT DISTINCT l_orderkey AS c, l_partkey % 1009 * 7 + l_suppkey % 7 AS x FROM lineitem WHERE l_quantity >= 48 AND l_discount >= 0.09)"


def _footprints(spark, d):
    return table(spark, d, "lineitem").filter("l_quantity >= 48 AND l_discount >= 0.09").select(F.col("l_orderkey").alias("constraint"), (F.col("l_partkey") % 1009 * 7 + F.col("l_suppkey") % 7).alias("cell")).distinct()


@query("connected_constraints", f"WITH RECURSIVE {_CELLS}, r(c, k) AS (SELECT c, c FROM fp UNION SELECT a.c, r.k FROM r JOIN fp b ON b.c = r.c JOIN fp a ON a.x = b.x) SELECT c AS \"constraint\", min(k) AS component FROM r GROUP BY c")
def connected_constraints(spark, d):
    out = C.constraint_components(_footprints(spark, d)).select(F.col("constraint").cast("long").alias("constraint"), "component")
    return out.join(out.groupBy("component").agg(F.min("constraint").alias("least")), "component").select("constraint", F.col("least").alias("component"))


@query("relevant_constraints", f"WITH RECURSIVE {_CELLS}, r(c) AS (SELECT c FROM fp WHERE x % 50 = 0 UNION SELECT a.c FROM r JOIN fp b ON b.c = r.c JOIN fp a ON a.x = b.x) SELECT c AS \"constraint\" FROM r")
def relevant_constraints(spark, d):
    f = _footprints(spark, d)
    return C.relevant_constraints(f, f.filter("cell % 50 = 0").select("cell"))


_SETS = "s AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 40 AS item FROM lineitem WHERE l_quantity > {q})"


def _sets(spark, d, q=None):
    lines = table(spark, d, "lineitem")
    return (lines if q is None else lines.filter(f"l_quantity > {q}")).select(F.col("l_orderkey").alias("id"), (F.col("l_suppkey") % 40).alias("item")).distinct()


_SUB = f"WITH a AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 40 AS item FROM lineitem WHERE l_quantity > 47 AND l_orderkey % 20 = 0), b AS (SELECT DISTINCT l_orderkey AS id, l_suppkey % 40 AS item FROM lineitem WHERE l_quantity > 40), n AS (SELECT id, count(*) AS n FROM a GROUP BY id) SELECT a.id AS a, b.id AS b FROM a JOIN b USING (item) JOIN n ON n.id = a.id GROUP BY a.id, b.id, n.n HAVING count(*) = n.n"


#: The same over all lines: asked are the ids divisible by 20, each with its whole set, against the whole sets of all ids.
_SUBSET = _SUB.replace("l_quantity > 47 AND ", "").replace(" WHERE l_quantity > 40", "")


@query("join_set_subset", _SUBSET)
def join_set_subset(spark, d):
    return C.contained_sets(_sets(spark, d).filter("id % 20 = 0"), _sets(spark, d))


@query("join_set_superset", _SUB.replace("a.id AS a, b.id AS b", "a.id AS b, b.id AS a").replace("HAVING", "HAVING a.id < b.id AND"))
@query("ext_predicate_templates", _SUB.replace("a.id AS a, b.id AS b", "a.id AS b, b.id AS a").replace("HAVING", "HAVING a.id < b.id AND"))
def join_set_superset(spark, d):
    found = C.contained_sets(_sets(spark, d, 47).filter("id % 20 = 0"), _sets(spark, d, 40), F.col("a") < F.col("b"))
    return found.select(F.col("b").alias("a"), F.col("a").alias("b"))


_I = "i AS (SELECT doc_id, sum(n_chars + 16) OVER (ORDER BY doc_id) - n_chars - 16 AS base, n_chars AS size FROM documents), p AS (SELECT event_id AS probe, event_id * 977 % 3000000 AS addr FROM events)"


def _intervals(spark, d):
    w = Window.orderBy("doc_id")
    return table(spark, d, "documents").select("doc_id", "n_chars").withColumn("base", F.sum(F.col("n_chars") + 16).over(w) - F.col("n_chars") - 16).select("doc_id", "base", F.col("n_chars").alias("size"))


def _probes(spark, d):
    return table(spark, d, "events").select(F.col("event_id").alias("probe"), (F.col("event_id") * 977 % 3_000_000).alias("addr"))


@query("join_interval_floor", f"WITH {_I} SELECT probe, addr, base, size FROM p LEFT JOIN i ON addr BETWEEN base AND base + size")
def join_interval_floor(spark, d):
    return I.lookup_interval(_probes(spark, d), _intervals(spark, d))


@query("join_interval_tiered", f"WITH {_I} SELECT probe, addr, CASE doc_id % 3 WHEN 0 THEN 'stack' WHEN 1 THEN 'heap' WHEN 2 THEN 'globals' END AS tier, base, size FROM p LEFT JOIN i ON addr BETWEEN base AND base + size")
def join_interval_tiered(spark, d):
    i = _intervals(spark, d)
    return I.lookup_tiered(_probes(spark, d), {n: i.filter(f"doc_id % 3 = {k}") for k, n in enumerate(("stack", "heap", "globals"))})


@query("state_heap_table", "SELECT CAST(user_id AS VARCHAR) AS owner, base, size FROM (SELECT user_id, event_id % 5 AS base, event_id AS size, event_type, row_number() OVER (PARTITION BY user_id, event_id % 5 ORDER BY event_id DESC) AS k FROM events) WHERE k = 1 AND event_type <> 'logout'")
def state_heap_table(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "logout", "free").otherwise("alloc").alias("op"), (F.col("event_id") % 5).alias("base"), F.col("event_id").alias("size"))
    return I.heap_state(e)


@query("state_stack_reconcile")
def state_stack_reconcile(spark, d):
    e = table(spark, d, "events").select(F.col("user_id").cast("string").alias("owner"), F.col("event_id").alias("seq"), F.when(F.col("event_id") % 4 == 0, "free").otherwise("alloc").alias("op"), (F.col("event_id") * 13 % 200).alias("base"), (F.col("event_id") % 30 + 1).alias("size"))
    return I.track_stack(e)
