"""Program graphs from node and edge tables, and batched searches over them.

nodes: mid, nid, type, name, linkage, call_type, function_type, address_taken, source_file, ord.
edges: mid, src, dst, kind. Graphs: src, dst, type, weight, with src and dst as "mid:nid" text.
Searches advance all queries at once; each step joins the frontier with the edges and is written out.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.staging import stage

#: Weight of calls whose target is a guess.
INDIRECT = 1e6
THREAD_SIGNATURE = "ptr (ptr)"


def node_id(mid: Column | str, nid: Column | str) -> Column:
    return F.concat_ws(":", mid, nid)


def _of(edges: DataFrame, kind: str) -> DataFrame:
    return edges.filter(F.col("kind") == kind).select("mid", "src", "dst")


def _typed(df: DataFrame, kind: str, weight: float = 1.0) -> DataFrame:
    return df.select("src", "dst", F.lit(kind).alias("type"), F.lit(weight).alias("weight"))


def dedup_edges(graph: DataFrame) -> DataFrame:
    return graph.dropDuplicates(["src", "dst", "type", "weight"])


def edges_entry(edges: DataFrame) -> DataFrame:
    """Function to its entry block."""
    return _typed(_of(edges, "EntryPoint").select(node_id("mid", "src").alias("src"), node_id("mid", "dst").alias("dst")), "Contains")


def edges_flow(edges: DataFrame) -> DataFrame:
    """Block to the blocks that may follow."""
    return _typed(_of(edges, "ControlFlowTo").select(node_id("mid", "src").alias("src"), node_id("mid", "dst").alias("dst")), "Succ")


def call_sites(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Call instructions with the block that contains them: mid, block, call, call_type, function_type."""
    blocks = nodes.filter("type = 'BasicBlock'").select("mid", F.col("nid").alias("block"))
    calls = nodes.filter("call_type IS NOT NULL").select("mid", F.col("nid").alias("call"), "call_type", "function_type")
    inside = _of(edges, "Contains").select("mid", F.col("src").alias("block"), F.col("dst").alias("call"))
    return inside.join(blocks, ["mid", "block"]).join(calls, ["mid", "call"])


def callees(edges: DataFrame) -> DataFrame:
    """One callee per call site: the least, where a site has several."""
    return _of(edges, "Calls").groupBy("mid", F.col("src").alias("call")).agg(F.min("dst").alias("callee"))


def edges_direct(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    sites = call_sites(nodes, edges).filter("call_type = 'Direct'").join(callees(edges), ["mid", "call"])
    return _typed(sites.select(node_id("mid", "block").alias("src"), node_id("mid", "callee").alias("dst")), "DirectCall")


def _targets(nodes: DataFrame) -> DataFrame:
    return nodes.filter("type = 'Function' AND address_taken").select(node_id("mid", "nid").alias("dst"), "function_type")


def edges_indirect(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Indirect call sites to the address-taken functions of equal signature."""
    sites = call_sites(nodes, edges).filter("call_type = 'Indirect'").select(node_id("mid", "block").alias("src"), "function_type")
    return _typed(sites.join(_targets(nodes), "function_type"), "IndirectCall", INDIRECT)


def edges_thread(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Blocks that start threads to the functions a thread can run."""
    starts = nodes.filter("type = 'Function' AND name = 'pthread_create'").select("mid", F.col("nid").alias("callee"))
    sites = call_sites(nodes, edges).join(callees(edges), ["mid", "call"]).join(starts, ["mid", "callee"], "left_semi")
    sites = sites.select(node_id("mid", "block").alias("src"), F.lit(THREAD_SIGNATURE).alias("function_type"))
    return _typed(sites.join(_targets(nodes), "function_type"), "IndirectCall", INDIRECT)


def loaded_functions(nodes: DataFrame, symbols: DataFrame) -> DataFrame:
    """Functions whose name a run has loaded; the library does not count."""
    return nodes.filter("type = 'Function'").join(symbols.select(F.col("symbol").alias("name")).distinct(), "name", "left_semi")


def edges_extern_indirect(nodes: DataFrame, edges: DataFrame, symbols: DataFrame | None = None) -> DataFrame:
    """Indirect call sites to external functions of equal signature, of the loaded symbols where these are known."""
    functions = nodes.filter("type = 'Function' AND linkage = 'ExternalLinkage'")
    if symbols is not None:
        functions = loaded_functions(functions, symbols)
    sites = call_sites(nodes, edges).filter("call_type = 'Indirect'").select(node_id("mid", "block").alias("src"), "function_type")
    return _typed(sites.join(functions.select(node_id("mid", "nid").alias("dst"), "function_type"), "function_type"), "ExternIndirectCall", INDIRECT)


def edges_extern(nodes: DataFrame) -> DataFrame:
    """All ordered pairs of external names that are equal, functions and variables alike."""
    outer = nodes.filter("linkage = 'ExternalLinkage'").select("name", node_id("mid", "nid").alias("id"))
    return _typed(outer.withColumnRenamed("id", "src").join(outer.withColumnRenamed("id", "dst"), "name").filter("src <> dst"), "Extern", INDIRECT)


def build_cfg(nodes: DataFrame, edges: DataFrame, dynlink: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """The interprocedural graph over functions and blocks, edges in the direction of control."""
    parts = [edges_entry(edges), edges_flow(edges), edges_direct(nodes, edges), edges_indirect(nodes, edges), edges_thread(nodes, edges), edges_extern(nodes)]
    if dynlink:
        parts.append(edges_extern_indirect(nodes, edges, symbols))
    return dedup_edges(reduce(DataFrame.unionByName, parts))


def block_order(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Instructions of each block with the next one, and whether they are first or last; `ord` orders them."""
    ins = nodes.filter("type = 'Instruction'").select("mid", F.col("nid").alias("ins"), "ord")
    own = _of(edges, "Contains").select("mid", F.col("src").alias("block"), F.col("dst").alias("ins")).join(ins, ["mid", "ins"])
    w = Window.partitionBy("mid", "block").orderBy("ord", "ins")
    return own.withColumn("next", F.lead("ins").over(w)).withColumn("is_first", F.row_number().over(w) == 1).withColumn("is_last", F.col("next").isNull())


def build_instr_cfg(nodes: DataFrame, edges: DataFrame, dynlink: bool = False, symbols: DataFrame | None = None) -> DataFrame:
    """The graph over instructions: straight lines within blocks, block flow from last to first, and calls."""
    order = stage(block_order(nodes, edges))
    line = order.filter("next IS NOT NULL").select(node_id("mid", "ins").alias("src"), node_id("mid", "next").alias("dst"))
    first = order.filter("is_first").select(node_id("mid", "block").alias("block"), node_id("mid", "ins").alias("ins"))
    last = order.filter("is_last").select(node_id("mid", "block").alias("block"), node_id("mid", "ins").alias("ins"))
    flow = edges_flow(edges).select(F.col("src").alias("a"), F.col("dst").alias("b"))
    jumps = flow.join(last.toDF("a", "src"), "a").join(first.toDF("b", "dst"), "b").select("src", "dst")
    entry = edges_entry(edges).select("src", F.col("dst").alias("b")).join(first.toDF("b", "dst"), "b").select("src", "dst")
    calls = [edges_direct(nodes, edges), edges_indirect(nodes, edges), edges_thread(nodes, edges)]
    if dynlink:
        calls.append(edges_extern_indirect(nodes, edges, symbols))
    sites = call_sites(nodes, edges).select(node_id("mid", "block").alias("src"), node_id("mid", "call").alias("call")).distinct()
    at_call = [c.join(sites, "src").select(F.col("call").alias("src"), "dst", "type", "weight") for c in calls]
    return dedup_edges(reduce(DataFrame.unionByName, [_typed(line, "Succ"), _typed(jumps, "Succ"), _typed(entry, "Contains"), *at_call, edges_extern(nodes)]))


#: Graph builders by name.
GRAPHS = {"cfg": build_cfg, "instr_cfg": build_instr_cfg}


def path_weight(weights: Column) -> Column:
    return F.aggregate(weights, F.lit(0.0), lambda a, w: a + w)


def min_distances(graph: DataFrame, sources: DataFrame, max_steps: int = 10_000, within: int | None = None) -> DataFrame:
    """(query_id, node, distance) in edges from each query's `node`, for all that it reaches, or only for those `within` so many edges."""
    hops = graph.select("src", "dst").distinct()
    seen = stage(sources.select("query_id", "node", F.lit(0).alias("distance")).distinct())
    front = seen
    for d in range(1, max_steps + 1):
        if within is not None and d > within:
            break
        front = stage(front.join(hops, front["node"] == hops["src"]).select("query_id", F.col("dst").alias("node")).distinct().join(seen, ["query_id", "node"], "left_anti").withColumn("distance", F.lit(d)))
        if front.isEmpty():
            break
        seen = seen.unionByName(front)
        if d % 8 == 0:  # else plans and reads grow with the steps
            seen = stage(seen)
    else:
        raise RuntimeError(f"not done after {max_steps} steps")
    return seen


def _hops(graph: DataFrame) -> DataFrame:
    """The lightest edge of each (src, dst)."""
    return graph.groupBy("src", "dst").agg(F.min(F.struct("weight", "type")).alias("e")).select("src", "dst", "e.weight", "e.type")


def _lightest(hops: DataFrame, starts: DataFrame, max_steps: int) -> DataFrame:
    """(query_id, node, b) of the best path to each node that goes on from the path b of starts (query_id, node, b, banned: next nodes not to take)."""
    starts = stage(starts)
    best = front = starts.drop("banned")
    for i in range(max_steps):
        moved = (front if i else starts).join(hops, F.col("node") == hops["src"]).filter(~F.array_contains("b.nodes", F.col("dst")))
        moved = moved if i else moved.filter(~F.array_contains("banned", F.col("dst")))
        grown = F.struct((F.col("b.cost") + F.col("weight")).alias("cost"), (F.col("b.hops") + 1).alias("hops"), F.array_append("b.nodes", F.col("dst")).alias("nodes"), F.array_append("b.edges", F.col("type")).alias("edges"))
        found = moved.select("query_id", F.col("dst").alias("node"), grown.alias("b")).groupBy("query_id", "node").agg(F.min("b").alias("b"))
        old = best.withColumnRenamed("b", "old")
        front = stage(found.join(old, ["query_id", "node"], "left").filter("old IS NULL OR b < old").select("query_id", "node", "b"))
        if front.isEmpty():
            break
        best = stage(best.join(front.select("query_id", "node"), ["query_id", "node"], "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"not done after {max_steps} steps")
    return best


def shortest_weighted(graph: DataFrame, queries: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """query_id, src, dst, cost, nodes and edges of each query's lightest path; of equal ones the shorter, then the least nodes.

    Label-correcting: each step keeps the best path per query and node, and only improved ones go on.
    """
    hops = _hops(graph)
    start = F.struct(F.lit(0.0).alias("cost"), F.lit(0).alias("hops"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    best = _lightest(hops, queries.select("query_id", F.col("src").alias("node"), start.alias("b"), F.array().cast("array<string>").alias("banned")), max_steps)
    return queries.join(best, (queries["query_id"] == best["query_id"]) & (queries["dst"] == best["node"])).select(queries["query_id"], "src", "dst", "b.cost", "b.nodes", "b.edges")


def shortest_hops(graph: DataFrame, queries: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """As shortest_weighted, with every edge at weight 1."""
    return shortest_weighted(graph.withColumn("weight", F.lit(1.0)), queries, max_steps)


def yen(graph: DataFrame, queries: DataFrame, k: int, max_steps: int = 10_000) -> DataFrame:
    """The k lightest loopless paths of each query, of any length: query_id, rank, cost, nodes and edges.

    Yen: the next path is the best of those that leave a path found before at one of its nodes by an edge
    that no found path with the same beginning takes. All spurs of all queries are searched at once.
    """
    hops, goals = _hops(graph), queries.filter("src <> dst").select("query_id", F.col("dst").alias("goal"))
    first = shortest_weighted(graph, queries.filter("src <> dst"), max_steps)
    last = stage(first.select("query_id", F.struct("cost", (F.size("nodes") - 1).alias("hops"), "nodes", "edges").alias("b")))
    done, open_ = last.withColumn("rank", F.lit(1)), None
    for rank in range(2, k + 1):
        each = lambda df: df.select("query_id", "b", F.explode(F.sequence(F.lit(1), F.col("b.hops"))).alias("i")).select("query_id", "b", "i", F.slice("b.nodes", F.lit(1), F.col("i")).alias("root"))
        taken = each(done).select("query_id", "root", F.element_at("b.nodes", F.col("i") + 1).alias("n")).groupBy("query_id", "root").agg(F.collect_set("n").alias("banned"))
        spurs = each(last)
        edges = F.slice("b.edges", F.lit(1), F.col("i") - 1)
        weights = hops.select(F.col("src").alias("_u"), F.col("dst").alias("_v"), "weight")
        steps = spurs.select("query_id", "i", F.explode(F.sequence(F.lit(1), F.col("i"))).alias("_k"), "root")
        cost = steps.filter("_k < i").select("query_id", "i", F.element_at("root", F.col("_k")).alias("_u"), F.element_at("root", F.col("_k") + 1).alias("_v")).join(weights, ["_u", "_v"]).groupBy("query_id", "i").agg(F.sum("weight").alias("_cost"))
        b = F.struct(F.coalesce("_cost", F.lit(0.0)).alias("cost"), (F.col("i") - 1).alias("hops"), F.col("root").alias("nodes"), edges.alias("edges"))
        starts = spurs.join(cost, ["query_id", "i"], "left").join(taken, ["query_id", "root"]).select(F.struct("query_id", "i").alias("query_id"), F.element_at("root", -1).alias("node"), b.alias("b"), "banned")
        ends = _lightest(hops, starts, max_steps).select("query_id.query_id", "node", "b").join(goals, "query_id").filter("node = goal").select("query_id", "b")
        open_ = stage((ends if open_ is None else open_.unionByName(ends)).distinct())
        last = stage(open_.groupBy("query_id").agg(F.min("b").alias("b")))
        if last.isEmpty():
            break
        open_ = open_.join(last, ["query_id", "b"], "left_anti")
        done = stage(done.unionByName(last.withColumn("rank", F.lit(rank))))
    return done.select("query_id", "rank", "b.cost", "b.nodes", "b.edges")


def k_shortest(graph: DataFrame, queries: DataFrame, k: int, max_hops: int | None = None) -> DataFrame:
    """Up to k lightest loopless paths per query, exactly, with their rank; with max_hops only those of at most so many edges.

    Without max_hops by yen(); with it paths that cannot reach their target in the edges left are dropped by the distance to it.
    """
    if max_hops is None:
        return yen(graph, queries, k)
    hops = _hops(graph)
    back = stage(min_distances(hops.select(F.col("dst").alias("src"), F.col("src").alias("dst")), queries.select("query_id", F.col("dst").alias("node")), within=max_hops))
    front = queries.select("query_id", F.col("src").alias("node"), F.col("dst").alias("goal"), F.lit(0.0).alias("cost"), F.array("src").alias("nodes"), F.array().cast("array<string>").alias("edges"))
    done = []
    for i in range(1, max_hops + 1):
        moved = front.join(hops, front["node"] == hops["src"]).filter(~F.array_contains("nodes", F.col("dst"))).filter("node <> goal")
        grown = moved.select("query_id", F.col("dst").alias("node"), "goal", (F.col("cost") + F.col("weight")).alias("cost"), F.array_append("nodes", F.col("dst")).alias("nodes"), F.array_append("edges", F.col("type")).alias("edges"))
        front = stage(grown.join(back, ["query_id", "node"]).filter(F.col("distance") <= max_hops - i).drop("distance"))
        done.append(front.filter("node = goal"))
        if front.isEmpty():
            break
    w = Window.partitionBy("query_id").orderBy("cost", F.size("nodes"), "nodes")
    return reduce(DataFrame.unionByName, done).withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).select("query_id", "rank", "cost", "nodes", "edges")


def run_queries(graph: DataFrame, queries: DataFrame, k: int = 1, max_hops: int | None = None) -> DataFrame:
    """All queries on one graph; with k over 1 the k lightest paths."""
    return shortest_weighted(graph, queries).withColumn("rank", F.lit(1)) if k == 1 else k_shortest(graph, queries, k, max_hops)


def candidate_queries(names: DataFrame, functions: DataFrame) -> DataFrame:
    """Consecutive pairs of named functions (candidate, pos, name): one query per step; the least id of a name counts."""
    ids = functions.groupBy("name").agg(F.min(node_id("mid", "nid")).alias("id"))
    w = Window.partitionBy("candidate").orderBy("pos")
    return names.join(ids, "name").withColumn("dst", F.lead("id").over(w)).filter("dst IS NOT NULL").select(F.concat_ws("/", "candidate", "pos").alias("query_id"), F.col("id").alias("src"), "dst")


def distmap(instructions: DataFrame, graph: DataFrame, target: DataFrame, inside: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(distances, blacklist): distance from each instruction `node` to `target`, 0 for those `inside` it; the rest cannot reach it."""
    back = graph.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    found = min_distances(back, target.select(F.lit(0).alias("query_id"), "node")).select("node", "distance")
    zero = inside.select("node", F.lit(0).alias("distance"))
    all_ = stage(found.unionByName(zero).groupBy("node").agg(F.min("distance").alias("distance")).join(instructions.select("node"), "node", "left_semi"))
    return all_, instructions.select("node").join(all_, "node", "left_anti")


def prune_states(states: DataFrame, distances: DataFrame) -> DataFrame:
    """States (state, blocks: next and resume points) with no block that reaches the target."""
    each = states.select("state", F.explode("blocks").alias("node"))
    return states.select("state").join(each.join(distances.select("node"), "node", "left_semi").select("state"), "state", "left_anti")


def graph_counts(nodes: DataFrame, graph: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("n_nodes")).crossJoin(graph.agg(F.count("*").alias("n_edges")))  # one row each


def min_dist_fixpoint(graph: DataFrame, goals: DataFrame, max_steps: int = 10_000) -> DataFrame:
    """(node, dist) of the least weight from each node to a goal (node, dist), where any is reached."""
    best = stage(goals.select("node", F.col("dist").cast("double").alias("dist")).groupBy("node").agg(F.min("dist").alias("dist")))
    front = best
    hops = graph.select("src", "dst", "weight")
    for _ in range(max_steps):
        near = front.join(hops, front["node"] == hops["dst"]).groupBy(F.col("src").alias("node")).agg(F.min(F.col("dist") + F.col("weight")).alias("dist"))
        front = stage(near.join(best.withColumnRenamed("dist", "old"), "node", "left").filter("old IS NULL OR dist < old").select("node", "dist"))
        if front.isEmpty():
            break
        best = stage(best.join(front.select("node"), "node", "left_anti").unionByName(front))
    else:
        raise RuntimeError(f"not done after {max_steps} steps")
    return best


def components(links: DataFrame) -> DataFrame:
    """(node, label): the least node of each component of (a, b), by label propagation with pointer jumping."""
    both = stage(links.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(links.select(F.col("b").alias("u"), F.col("a").alias("v"))).distinct())
    label = stage(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("label")))
    while True:
        near = both.join(label.withColumnsRenamed({"node": "v", "label": "l"}), "v").groupBy(F.col("u").alias("node")).agg(F.min("l").alias("l"))
        lower = label.join(near, "node").select("node", F.least("label", "l").alias("label"))
        jump = lower.withColumnsRenamed({"node": "n2", "label": "l2"})
        new = stage(lower.join(jump, lower["label"] == jump["n2"]).select("node", F.least("label", "l2").alias("label")))
        if new.join(label.withColumnRenamed("label", "old"), "node").filter("label <> old").isEmpty():
            return new
        label = new


def rollup_callpaths(paths: DataFrame) -> DataFrame:
    """Inclusive totals per (call site, callee) from paths (path: array of struct<site, callee>, value): each frame of a path counts once."""
    frames = paths.select("value", F.explode(F.array_distinct("path")).alias("f"))
    return frames.groupBy("f.site", "f.callee").agg(F.sum("value").alias("inclusive"))


def fold_recursion(paths: DataFrame, path: str = "path") -> DataFrame:
    """Paths in which a frame that is on the path already returns to its nearest earlier place."""

    def step(acc: Column, f: Column) -> Column:
        at = F.array_position(acc, f)
        return F.when(at > 0, F.slice(acc, F.lit(1), at.cast("int"))).otherwise(F.array_append(acc, f))

    kind = paths.schema[path].dataType
    return paths.withColumn(path, F.aggregate(path, F.array().cast(kind), step))


def path_edges(paths: DataFrame) -> DataFrame:
    """(query_id, pos, src, edge, dst) of each step of a path."""
    steps = F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1).alias("src"), F.col("edges").alias("edge"), F.slice("nodes", F.lit(2), F.size("nodes")).alias("dst"))
    return paths.select("query_id", F.posexplode(steps).alias("pos", "s")).select("query_id", "pos", "s.src", "s.edge", "s.dst")


def render_path(nodes: Column, edges: Column, calls_only: bool = False) -> Column:
    """`a -> edge -> b ...`; calls_only leaves out Succ and Contains."""
    steps = F.zip_with(edges, F.slice(nodes, F.lit(2), F.greatest(F.size(nodes) - 1, F.lit(0))), lambda e, n: F.struct(e.alias("e"), n.alias("n")))
    if calls_only:
        steps = F.filter(steps, lambda s: ~s["e"].isin("Succ", "Contains"))
    return F.concat(F.element_at(nodes, 1), F.array_join(F.transform(steps, lambda s: F.concat(F.lit(" -> "), s["e"], F.lit(" -> "), s["n"])), ""))


def fact_violations(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(rule, id): edges whose ends do not exist, and required attributes that are missing."""
    known = nodes.select("mid", F.col("nid"))
    end = lambda c: edges.select("mid", F.col(c).alias("nid")).distinct().join(known, ["mid", "nid"], "left_anti").select(F.lit(f"edge_{c}_unknown").alias("rule"), node_id("mid", "nid").alias("id"))
    rule = lambda name, cond: nodes.filter(cond).select(F.lit(name).alias("rule"), node_id("mid", "nid").alias("id"))
    wrong = _of(edges, "EntryPoint").join(nodes.filter("type = 'Function'").select("mid", F.col("nid").alias("src")), ["mid", "src"], "left_anti")
    return reduce(
        DataFrame.unionByName,
        [end("src"), end("dst"), rule("function_without_name", "type = 'Function' AND name IS NULL"), rule("call_without_signature", "call_type = 'Indirect' AND function_type IS NULL"), wrong.select(F.lit("entry_of_no_function").alias("rule"), node_id("mid", "src").alias("id"))],
    )
