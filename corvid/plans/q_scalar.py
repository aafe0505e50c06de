"""Scalar functions, bit-vectors and bounded constraint queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.functions import bitvec as B
from corvid.functions import text as X
from corvid.operators import constraints as C
from corvid.plans.registry import query
from corvid.session import table

_L = "l AS (SELECT l_orderkey AS k, l_linenumber AS n, (l_partkey * 31) & 255 AS a, (l_suppkey * 17) & 255 AS b FROM lineitem)"


def _bv(spark, d, **columns):
    li = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), (F.col("l_partkey") * 31).bitwiseAND(F.lit(255).cast("bigint")).alias("a"), (F.col("l_suppkey") * 17).bitwiseAND(F.lit(255).cast("bigint")).alias("b"))
    return li.select("k", "n", *[f(F.col("a"), F.col("b")).alias(name) for name, f in columns.items()])


_S = "(CASE WHEN {0} >= 128 THEN {0} - 256 ELSE {0} END)"
_SA, _SB = _S.format("a"), _S.format("b")


def _sql(*items):
    return f"WITH {_L} SELECT k, n, {', '.join(f'CAST({e} AS {t}) AS {n}' for n, e, t in items)} FROM l"


@query("bv_add", _sql(("x", "(a + b) % 256", "BIGINT"), ("y", "(a - b + 256) % 256", "BIGINT"), ("z", "(a * b) % 256", "BIGINT")))
def bv_arith(spark, d):
    return _bv(spark, d, x=lambda a, b: B.bv_add(a, b, 8), y=lambda a, b: B.bv_sub(a, b, 8), z=lambda a, b: B.bv_mul(a, b, 8))


@query("bv_udiv", _sql(("x", "CASE WHEN b > 0 THEN a // b END", "BIGINT"), ("y", "CASE WHEN b > 0 THEN a % b END", "BIGINT"), ("z", f"CASE WHEN b > 0 THEN ({_SA} // {_SB} + 256) % 256 END", "BIGINT"), ("w", f"CASE WHEN b > 0 THEN ({_SA} % {_SB} + 256) % 256 END", "BIGINT")))
def bv_div(spark, d):
    return _bv(spark, d, x=lambda a, b: B.bv_udiv(a, b, 8), y=lambda a, b: B.bv_urem(a, b, 8), z=lambda a, b: B.bv_sdiv(a, b, 8), w=lambda a, b: B.bv_srem(a, b, 8))


@query("bv_and", _sql(("x", "a & b", "BIGINT"), ("y", "a | b", "BIGINT"), ("z", "xor(a, b)", "BIGINT"), ("w", "255 - a", "BIGINT")))
def bv_logic(spark, d):
    return _bv(spark, d, x=lambda a, b: B.bv_and(a, b, 8), y=lambda a, b: B.bv_or(a, b, 8), z=lambda a, b: B.bv_xor(a, b, 8), w=lambda a, _: B.bv_not(a, 8))


@query("bv_shl", _sql(("x", "CASE WHEN b % 12 < 8 THEN (a * CAST(2 ** (b % 12) AS BIGINT)) % 256 ELSE 0 END", "BIGINT"), ("y", "CASE WHEN b % 12 < 8 THEN a // CAST(2 ** (b % 12) AS BIGINT) ELSE 0 END", "BIGINT"), ("z", f"CASE WHEN b % 12 < 8 THEN (CAST(floor({_SA} / 2 ** (b % 12)) AS BIGINT) + 256) % 256 ELSE 0 END", "BIGINT")))
def bv_shift(spark, d):
    return _bv(spark, d, x=lambda a, b: B.bv_shl(a, b % 12, 8), y=lambda a, b: B.bv_lshr(a, b % 12, 8), z=lambda a, b: B.bv_ashr(a, b % 12, 8))


@query("bv_eq", _sql(("x", "a < b", "BOOLEAN"), ("y", f"{_SA} < {_SB}", "BOOLEAN"), ("z", "a >= b", "BOOLEAN"), ("w", "a <> b", "BOOLEAN")))
def bv_cmp(spark, d):
    return _bv(spark, d, x=lambda a, b: B.bv_compare("ult", a, b, 8), y=lambda a, b: B.bv_compare("slt", a, b, 8), z=lambda a, b: B.bv_compare("uge", a, b, 8), w=lambda a, b: B.bv_compare("ne", a, b, 8))


@query("bv_zext", _sql(("x", "a", "BIGINT"), ("y", f"({_SA} + 65536) % 65536", "BIGINT"), ("z", "(a // 8) % 8", "BIGINT"), ("w", "a * 256 + b", "BIGINT")))
def bv_width(spark, d):
    return _bv(spark, d, x=lambda a, _: B.bv_zext(a, 8, 16), y=lambda a, _: B.bv_sext(a, 8, 16), z=lambda a, _: B.bv_extract(a, 3, 3), w=lambda a, b: B.bv_concat(a, b, 8, 16))


@query("bv_select", _sql(("x", "CASE WHEN a < b THEN a ELSE b END", "BIGINT"), ("y", "a = 0", "BOOLEAN"), ("z", "NOT (a < b) OR b > 0", "BOOLEAN"), ("w", "(256 - a) % 256", "BIGINT")))
@query("bv_implies", _sql(("x", "CASE WHEN a < b THEN a ELSE b END", "BIGINT"), ("y", "a = 0", "BOOLEAN"), ("z", "NOT (a < b) OR b > 0", "BOOLEAN"), ("w", "(256 - a) % 256", "BIGINT")))
def bv_misc(spark, d):
    return _bv(spark, d, x=lambda a, b: B.bv_select(a < b, a, b), y=lambda a, _: B.bv_is_zero(a, 8), z=lambda a, b: B.bv_implies(a < b, b > 0), w=lambda a, _: B.bv_neg(a, 8))


_READ = _sql(("x", "CASE WHEN a % 6 = 2 THEN 99 WHEN a % 6 < 4 THEN (a % 6 + 1) * 10 END", "BIGINT"), ("y", "CASE a % 2 WHEN 0 THEN 10 + 256 * 20 ELSE 20 + 256 * 99 END", "BIGINT"), ("z", "CASE a % 2 WHEN 0 THEN 10 * 256 + 20 ELSE 20 * 256 + 99 END", "BIGINT"))


@query("bv_read", _READ)
@query("bv_read_lsb", _READ)
def bv_read(spark, d):
    array, over = F.array(*[F.lit(x).cast("bigint") for x in (10, 20, 30, 40)]), F.create_map(F.lit(2).cast("bigint"), F.lit(99).cast("bigint"))
    return _bv(spark, d, x=lambda a, _: B.bv_read(array, over, a % 6), y=lambda a, _: B.bv_read_bytes(array, over, a % 2, 2), z=lambda a, _: B.bv_read_bytes(array, over, a % 2, 2, True))


@query("range_eval", _sql(("lo", "CASE WHEN a + b + 20 > 255 THEN 0 ELSE a + b END", "BIGINT"), ("hi", "CASE WHEN a + b + 20 > 255 THEN 255 ELSE a + b + 20 END", "BIGINT")))
def range_eval(spark, d):
    r = lambda i: lambda a, b: B.range_binary("add", (a, a + 10), (b, b + 10), 8)[i].cast("bigint")
    return _bv(spark, d, lo=r(0), hi=r(1))


# Bounded queries: x and y of 6 bits.
_XY = "xy AS (SELECT x, y FROM range(64) a(x), range(64) b(y) WHERE x < y)"
_DOM = {"x": 64, "y": 64}


@query("q_validity", f"WITH {_XY} SELECT CASE WHEN bool_and((x + y) % 64 > x) THEN 'VALID' ELSE 'INVALID' END AS validity, CASE WHEN bool_and((x + y) % 64 > x) THEN 'True' WHEN bool_or((x + y) % 64 > x) THEN 'Unknown' ELSE 'False' END AS three_valued FROM xy")
@query("q_three_valued", f"WITH {_XY} SELECT CASE WHEN bool_and((x + y) % 64 > x) THEN 'VALID' ELSE 'INVALID' END AS validity, CASE WHEN bool_and((x + y) % 64 > x) THEN 'True' WHEN bool_or((x + y) % 64 > x) THEN 'Unknown' ELSE 'False' END AS three_valued FROM xy")
def q_validity(spark, d):
    return C.solve_bounded(spark, _DOM, F.col("x") < F.col("y"), B.bv_add(F.col("x"), F.col("y"), 6) > F.col("x")).select("validity", "three_valued")


@query("q_model", f"WITH {_XY} SELECT x, y FROM xy WHERE NOT ((x + y) % 64 > x) ORDER BY x, y LIMIT 1")
def q_model(spark, d):
    return C.solve_bounded(spark, _DOM, F.col("x") < F.col("y"), B.bv_add(F.col("x"), F.col("y"), 6) > F.col("x")).select("counterexample.*")


@query("q_range", f"WITH {_XY} SELECT min((x * y) % 64) AS lo, max((x * y) % 64) AS hi, arg_min((x * y) % 64, x * 64 + y) AS value FROM xy")
@query("q_value", f"WITH {_XY} SELECT min((x * y) % 64) AS lo, max((x * y) % 64) AS hi, arg_min((x * y) % 64, x * 64 + y) AS value FROM xy")
def q_range(spark, d):
    return C.value_range(spark, _DOM, F.col("x") < F.col("y"), B.bv_mul(F.col("x"), F.col("y"), 6))


@query("q_cache", "SELECT n_nationkey AS id, CASE n_nationkey % 3 WHEN 0 THEN true WHEN 1 THEN false END AS answer FROM nation")
def q_cache(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("id"), F.concat(F.when(F.col("n_nationkey") % 3 == 1, "n").otherwise("a"), F.col("n_nationkey")).alias("key"), F.concat(F.when(F.col("n_nationkey") % 3 == 1, "a").otherwise("n"), F.col("n_nationkey")).alias("negated"))
    return C.cached_validity(n, n.filter("id % 3 < 2").select(F.least("key", "negated").alias("key"), F.lit(True).alias("answer")))


@query("q_cex_cache", "SELECT n_nationkey AS id, CASE WHEN n_nationkey % 5 = 0 THEN 'exact' WHEN n_nationkey % 5 = 1 THEN 'sat_superset' WHEN n_nationkey % 5 = 2 THEN 'unsat_subset' ELSE 'none' END AS how FROM nation")
def q_cex_cache(spark, d):
    n, k = table(spark, d, "nation"), F.col("n_nationkey")
    items = lambda *xs: F.explode(F.array(*[k * 10 + x for x in xs]))
    q = n.select(k.alias("id"), items(1, 2).alias("item"))
    cache = n.filter("n_nationkey % 5 = 0").select(k.alias("id"), items(1, 2).alias("item"), F.lit(True).alias("sat"))
    cache = cache.unionByName(n.filter("n_nationkey % 5 = 1").select(k.alias("id"), items(1, 2, 3).alias("item"), F.lit(True).alias("sat")))
    cache = cache.unionByName(n.filter("n_nationkey % 5 = 2").select(k.alias("id"), items(1).alias("item"), F.lit(False).alias("sat")))
    return C.reuse_assignments(q, cache)


@query("q_validate", "SELECT n_nationkey, 'a' AS side FROM nation WHERE n_nationkey > 20 UNION ALL SELECT n_nationkey, 'b' FROM nation WHERE n_nationkey < 5")
def q_validate(spark, d):
    n = table(spark, d, "nation").select("n_nationkey")
    return C.cross_check(n.filter("n_nationkey >= 5"), n.filter("n_nationkey <= 20"))


@query("agg_solver_counters", "SELECT count(*) AS queries, count(*) FILTER (o_orderstatus = 'F') AS valid, count(*) FILTER (o_orderstatus = 'O') AS invalid, count(*) FILTER (o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS counterexamples FROM orders")
def agg_solver_counters(spark, d):
    o = table(spark, d, "orders").select(F.when(F.col("o_orderstatus") == "F", "VALID").when(F.col("o_orderstatus") == "O", "INVALID").otherwise("FAIL").alias("validity"), ((F.col("o_orderstatus") == "O") & (F.col("o_orderkey") % 2 == 0)).alias("has_model"))
    return C.solver_counts(o)


# Text.
@query("str_version_extract", "SELECT page_id, nullif(regexp_extract(url || ' v' || page_id || '.2.' || page_id % 7, '\\d+\\.\\d+(?:\\.\\d+)*'), '') AS version FROM pages")
def str_version_extract(spark, d):
    return table(spark, d, "pages").select("page_id", X.extract_version(F.concat("url", F.lit(" v"), "page_id", F.lit(".2."), F.col("page_id") % 7)).alias("version"))


@query("str_cpe_build", "SELECT p_partkey, 'cpe:2.3:a:*:' || split_part(p_name || ':x', ':', 1) || ':1.' || p_size AS cpe FROM part")
def str_cpe_build(spark, d):
    return table(spark, d, "part").select("p_partkey", X.cpe_string(F.concat("p_name", F.lit(":x")), F.concat(F.lit("1."), "p_size")).alias("cpe"))


@query("str_split", "SELECT p_partkey, string_split(p_type, ' ') AS parts FROM part")
def str_split(spark, d):
    return table(spark, d, "part").select("p_partkey", F.split("p_type", " ").alias("parts"))


@query("str_split_first", "SELECT p_partkey, split_part(p_type, ' ', 1) AS a, substr(p_type, strpos(p_type || ' ', ' ') + 1) AS b FROM part WHERE contains(p_type, ' ')")
def str_split_first(spark, d):
    s = F.split("p_type", " ", 2)
    return table(spark, d, "part").filter(F.contains("p_type", F.lit(" "))).select("p_partkey", s[0].alias("a"), s[1].alias("b"))


@query("str_cwe_num", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN CAST(s_suppkey AS VARCHAR) WHEN 1 THEN CAST(s_suppkey AS VARCHAR) END AS cwe FROM supplier")
def str_cwe_num(spark, d):
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select("s_suppkey", X.cwe_number(F.when(k % 3 == 0, k.cast("string")).when(k % 3 == 1, F.concat(F.lit("CWE-"), k)).otherwise("NVD-CWE-noinfo")).alias("cwe"))


@query("str_response_split", "SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 'a.c' END AS file, CASE s_suppkey % 3 WHEN 0 THEN 'f' || s_suppkey END AS function FROM supplier")
def str_response_split(spark, d):
    k = F.col("s_suppkey")
    loc = X.split_location(F.when(k % 3 == 0, F.concat(F.lit("a.c:f"), k)).when(k % 3 == 1, "N/A").otherwise("a:b:c"))
    return table(spark, d, "supplier").select("s_suppkey", loc["file"].alias("file"), loc["function"].alias("function"))


@query("str_safe_text", "SELECT doc_id, regexp_replace(text, '[^\\x20-\\x7E]', '.', 'g') AS t FROM documents")
def str_safe_text(spark, d):
    return table(spark, d, "documents").select("doc_id", X.safe_text(F.col("text")).alias("t"))


@query("str_escape", "SELECT n_nationkey, n_name || '\\x0A' AS t FROM nation")
def str_escape(spark, d):
    return table(spark, d, "nation").select("n_nationkey", X.escape_text(F.concat("n_name", F.lit("\n"))).alias("t"))


@query("bin_hex_int", "SELECT n_nationkey, lower(hex(chr(CAST(65 + n_nationkey AS INTEGER)))) || '0100' || '00' AS hex, CAST(65 + n_nationkey + 256 AS BIGINT) AS uint FROM nation")
def bin_hex_int(spark, d):
    r = X.render_object(F.unhex(F.concat(F.hex(65 + F.col("n_nationkey")), F.lit("010000"))))
    return table(spark, d, "nation").select("n_nationkey", r["hex"].alias("hex"), r["uint"].cast("bigint").alias("uint"))


@query("str_id_parse", "SELECT s_suppkey, CASE WHEN s_suppkey % 4 < 3 THEN s_suppkey END AS mid, CASE WHEN s_suppkey % 4 < 3 THEN 7 END AS nid FROM supplier")
def str_id_parse(spark, d):
    k = F.col("s_suppkey")
    p = X.parse_id(F.when(k % 4 == 0, F.concat(F.lit("("), k, F.lit(",7)"))).when(k % 4 == 1, F.concat(F.lit(" ( "), k, F.lit(" , 7 ) "))).when(k % 4 == 2, F.concat(k, F.lit(",7"))).otherwise(F.concat(F.lit("("), k, F.lit(",7)x"))))
    return table(spark, d, "supplier").select("s_suppkey", p["mid"].alias("mid"), p["nid"].cast("int").alias("nid"))


@query("str_function_regex", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'fn_' || n_nationkey END AS name FROM nation")
def str_function_regex(spark, d):
    line = F.when(F.col("n_nationkey") % 2 == 0, F.concat(F.lit("static int *fn_"), F.col("n_nationkey"), F.lit("(char *p) {"))).otherwise("return f(x);")
    return table(spark, d, "nation").select("n_nationkey", X.function_name(line).alias("name"))


@query("str_node_label", "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'd' WHEN 1 THEN 'n' WHEN 2 THEN CAST(n_nationkey AS VARCHAR) ELSE '' END AS label FROM nation")
def str_node_label(spark, d):
    k = F.col("n_nationkey")
    return table(spark, d, "nation").select("n_nationkey", X.node_label(F.when(k % 4 == 0, "d"), F.when(k % 4 <= 1, "n"), F.when(k % 4 == 2, k).otherwise(0)).alias("label"))


@query("pred_name_match", "SELECT p_partkey FROM part WHERE contains(p_name, 'a') OR p_type = 'x'")
def pred_name_match(spark, d):
    return table(spark, d, "part").filter(X.name_matches(F.col("p_name"), F.lit("x"), F.lit("a"))).select("p_partkey")


@query("pred_suffix_match", "SELECT p_partkey FROM part WHERE p_type LIKE '%L'")
def pred_suffix_match(spark, d):
    return table(spark, d, "part").filter(F.col("p_type").endswith("L")).select("p_partkey")


@query("pred_skip_patterns", "SELECT p_partkey, CASE WHEN contains(p_type, 'TIN') THEN 'TIN' WHEN contains(p_type, 'STEEL') THEN 'STEEL' END AS reason FROM part")
def pred_skip_patterns(spark, d):
    return table(spark, d, "part").select("p_partkey", X.skip_reason(F.col("p_type"), ["TIN", "STEEL"]).alias("reason"))


@query("pred_version_in_range", "SELECT p_partkey, p_size >= 10 AND p_size < 30 AS inside FROM part")
def pred_version_in_range(spark, d):
    return table(spark, d, "part").select("p_partkey", X.version_in_range(F.lit("vers:generic/>=1.10|<1.30"), F.concat(F.lit("1."), "p_size")).alias("inside"))


@query("time_parse_span", "SELECT event_id, (event_id % 5) * 3600000000 + (event_id % 60) * 60000000 + 5000000 AS us FROM events")
def time_parse_span(spark, d):
    k = F.col("event_id")
    return table(spark, d, "events").select("event_id", X.parse_span_us(F.concat(k % 5, F.lit("h"), k % 60, F.lit("min5s"))).alias("us"))


@query("time_to_hms", "SELECT event_id, event_id * 977 // 3600 AS h, event_id * 977 // 60 % 60 AS m, event_id * 977 % 60 AS s FROM events")
def time_to_hms(spark, d):
    t = X.to_hms(F.col("event_id") * 977_000_000)
    return table(spark, d, "events").select("event_id", t["h"].alias("h"), t["m"].alias("m"), t["s"].alias("s"))


@query("math_percent", "SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber > 1 THEN round(100.0::DOUBLE * l_suppkey / (l_linenumber - 1), 6) END AS pct FROM lineitem")
def math_percent(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.round(X.pct(F.col("l_suppkey"), F.col("l_linenumber") - 1), 6).alias("pct"))


_WEIGHTS = "SELECT event_id, (event_id % 9)::DOUBLE AS depth, round(0.5::DOUBLE ** (event_id % 9), 9) AS random_path, round(1 / greatest(value, 0.1::DOUBLE), 9) AS query_cost, round(1.0::DOUBLE / greatest(event_id % 7, 1) / greatest(event_id % 7, 1), 9) AS min_dist FROM events"


@query("ext_searchers", _WEIGHTS)
@query("math_weights", _WEIGHTS)
def math_weights(spark, d):
    k = F.col("event_id")
    w = lambda kind: F.round(X.search_weight(kind, k % 9, k % 7, F.col("value"), k % 7), 9).alias(kind)
    return table(spark, d, "events").select("event_id", w("depth"), w("random_path"), w("query_cost"), w("min_dist"))


@query("array_ops", "SELECT p_partkey, list_reverse(string_split(p_type, ' ')) AS r, len(string_split(p_type, ' ')) AS n FROM part")
@query("map_ops", "SELECT p_partkey, list_reverse(string_split(p_type, ' ')) AS r, len(string_split(p_type, ' ')) AS n FROM part")
def array_ops(spark, d):
    s = F.split("p_type", " ")
    return table(spark, d, "part").select("p_partkey", F.reverse(s).alias("r"), F.size(s).cast("long").alias("n"))


@query("intersect_footprint", "SELECT p_partkey, p_size % 3 = 0 AS meets FROM part")
def intersect_footprint(spark, d):
    return table(spark, d, "part").select("p_partkey", F.arrays_overlap(F.array(F.col("p_size") % 3, F.lit(7)), F.array(F.lit(0), F.lit(9))).alias("meets"))


@query("filter_query_time", "SELECT event_id FROM events WHERE value * 1000 >= 50000 OR event_type = 'error'")
def filter_query_time(spark, d):
    from corvid.sources.files import slow_queries

    e = table(spark, d, "events").select("event_id", (F.col("value") * 1000).alias("elapsed_us"), F.when(F.col("event_type") == "error", "TIMEOUT").otherwise("OK").alias("outcome"))
    return slow_queries(e, 50_000).select("event_id")


@query("read_props", "SELECT n_nationkey, n_name FROM nation WHERE n_nationkey IN (SELECT r_regionkey FROM region)")
def read_props(spark, d):
    ids = table(spark, d, "region").select(F.col("r_regionkey").alias("n_nationkey"))
    return table(spark, d, "nation").join(ids, "n_nationkey", "left_semi").select("n_nationkey", "n_name")
