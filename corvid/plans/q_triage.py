"""Findings, CVE and test queries over projections of the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from corvid.operators import triage as T
from corvid.plans.registry import query
from corvid.session import table


def cves(spark, d):
    e = table(spark, d, "events")
    score = F.when(F.col("event_id") % 6 == 0, None).when(F.col("event_id") % 6 == 1, 0.0).otherwise((F.col("event_id") % 100) / 10)
    return e.select(F.col("event_id").cast("string").alias("id"), score.alias("score"), F.when(F.col("event_type") == "click", F.array(F.lit("disputed"))).otherwise(F.array().cast("array<string>")).alias("tags"), F.when(F.col("event_id") % 9 == 0, "Deferred").when(F.col("event_id") % 9 == 1, "Rejected").otherwise("Analyzed").alias("status"))


@query("filter_cve_chain", "SELECT CAST(event_id AS VARCHAR) AS id FROM events WHERE event_id % 6 > 1 AND event_id % 100 >= 50 AND event_type <> 'click' AND event_id % 9 > 1")
def filter_cve_chain(spark, d):
    return T.filter_cves(cves(spark, d), min_score=5.0, allow_disputed=False, allow_deferred=False).select("id")


@query("anti_missing_ids", "SELECT CAST(o_orderkey AS VARCHAR) AS id FROM orders WHERE o_orderkey NOT IN (SELECT event_id FROM events WHERE event_id % 3 = 0)")
def anti_missing_ids(spark, d):
    ids = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("id"))
    return T.unmatched_ids(ids, cves(spark, d).filter("CAST(id AS BIGINT) % 3 = 0"))


@query("pred_v3_score", "SELECT event_id, CASE WHEN event_id % 3 = 0 THEN value WHEN event_id % 3 = 1 THEN value + 1 END AS score FROM events")
def pred_v3_score(spark, d):
    entry = lambda c: F.array(F.struct(F.struct(c.alias("baseScore")).alias("cvssData")))
    v31, v30 = F.when(F.col("event_id") % 3 == 0, entry(F.col("value"))), F.when(F.col("event_id") % 3 < 2, entry(F.col("value") + 1))
    m = table(spark, d, "events").select("event_id", F.struct(v31.alias("cvssMetricV31"), v30.alias("cvssMetricV30")).alias("m"))
    return m.select("event_id", T.v3_score(F.col("m")).alias("score"))


@query("pred_description_en", "SELECT event_id, CASE event_id % 3 WHEN 0 THEN 'en' || event_id WHEN 1 THEN 'de' || event_id END AS description FROM events")
def pred_description_en(spark, d):
    one = lambda lang: F.struct(F.lit(lang).alias("lang"), F.concat(F.lit(lang), F.col("event_id")).alias("value"))
    ds = F.when(F.col("event_id") % 3 == 0, F.array(one("de"), one("en"))).when(F.col("event_id") % 3 == 1, F.array(one("de"), one("fr"))).otherwise(F.slice(F.array(one("de")), 2, 1))
    return table(spark, d, "events").select("event_id", T.description_en(ds).alias("description"))


@query("agg_distinct_deps", "SELECT DISTINCT p_brand AS name, p_size % 5 || '.0' AS version FROM part")
def agg_distinct_deps(spark, d):
    return T.distinct_deps(table(spark, d, "part").select(F.col("p_brand").alias("name"), F.concat((F.col("p_size") % 5).cast("string"), F.lit(".0")).alias("version")))


@query("join_dep_cve", "SELECT DISTINCT p_brand || ':x' AS name, p_size % 5 || '.0' AS version, n_name AS id FROM part JOIN nation ON 'Brand#' || (n_nationkey % 5 + 1) || (n_nationkey // 5 + 1) = p_brand AND p_size % 5 = n_nationkey % 5")
def join_dep_cve(spark, d):
    deps = T.distinct_deps(table(spark, d, "part").select(F.concat("p_brand", F.lit(":x")).alias("name"), F.concat((F.col("p_size") % 5).cast("string"), F.lit(".0")).alias("version")))
    k = F.col("n_nationkey")
    cpes = table(spark, d, "nation").select(F.concat(F.lit("Brand#"), k % 5 + 1, F.floor(k / 5) + 1).alias("product"), F.concat((k % 5).cast("string"), F.lit(".0")).alias("version"), F.col("n_name").alias("id"))
    return T.match_dependencies(deps, cpes)


def weaknesses(spark, d):
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("id"), F.col("l_linenumber").alias("pos"), F.when(F.col("l_suppkey") % 7 > 0, (F.col("l_suppkey") % 30).cast("string")).alias("cwe_id"))


def cwe_dim(spark, d):
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("string").alias("cwe_id"), F.col("n_name").alias("cwe_name"))


_CWE = "w AS (SELECT l_orderkey AS id, l_linenumber AS pos, CASE WHEN l_suppkey % 7 > 0 THEN CAST(l_suppkey % 30 AS VARCHAR) END AS cwe_id FROM lineitem), j AS (SELECT w.*, n_name AS cwe_name FROM w LEFT JOIN nation ON CAST(n_nationkey AS VARCHAR) = cwe_id)"


@query("scan_cwe_dim", f"WITH {_CWE} SELECT * FROM j")
@query("join_cve_cwe", f"WITH {_CWE} SELECT * FROM j")
def join_cve_cwe(spark, d):
    return T.attach_cwe(weaknesses(spark, d), cwe_dim(spark, d)).select("id", "pos", "cwe_id", "cwe_name")


@query("agg_cwe_dedup", f"WITH {_CWE} SELECT id, coalesce(cwe_id, 'UNKNOWN') AS cwe_id, coalesce(max(cwe_name), 'UNKNOWN') AS cwe_name FROM j GROUP BY 1, 2")
def agg_cwe_dedup(spark, d):
    return T.findings_from_cves(T.attach_cwe(weaknesses(spark, d), cwe_dim(spark, d)))


@query("join_vcpkg_version", "SELECT p_brand AS package, p_partkey, CASE WHEN p_brand LIKE 'Brand#1%' THEN 'o' WHEN p_brand LIKE 'Brand#2%' THEN 'r' END AS version FROM part")
def join_vcpkg_version(spark, d):
    p = table(spark, d, "part").select(F.col("p_brand").alias("package"), "p_partkey")
    brands = p.select("package").distinct()
    over = brands.filter("package LIKE 'Brand#1%'").select(F.lit("overlay").alias("kind"), "package", F.lit("o").alias("version"))
    root = brands.filter("package LIKE 'Brand#1%' OR package LIKE 'Brand#2%'").select(F.lit("root").alias("kind"), "package", F.lit("r").alias("version"))
    return T.attach_package_version(p, over.unionByName(root))


@query("join_cwe_patch", "WITH m AS (SELECT unnest([121, 122, 123, 125, 131, 190, 369, 476, 590, 787, 1335, 0, 0, 0, 0, 0, 0]) AS cwe, unnest([0, 0, 0, 0, 0, 4, 3, 1, 2, 0, 5, 0, 1, 2, 3, 4, 5]) AS flag), k AS (SELECT [0, 121, 122, 124, 190, 369, 476, 590, 787, 1335] AS l), s AS (SELECT s_suppkey, l[s_suppkey % 10 + 1] AS cwe FROM supplier, k) SELECT s_suppkey, s.cwe, flag FROM s LEFT JOIN m ON m.cwe = s.cwe")
def join_cwe_patch(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.get(F.array(*[F.lit(c) for c in (0, 121, 122, 124, 190, 369, 476, 590, 787, 1335)]), (F.col("s_suppkey") % 10).cast("int")).alias("cwe"))
    return T.sanitizer_flags(s)


def _functions(spark, d):
    return table(spark, d, "part").select(F.lit(0).alias("mid"), F.col("p_partkey").alias("nid"), F.concat(F.lit("f"), F.col("p_partkey") % 300).alias("name"), F.concat(F.lit("ns::g"), F.col("p_partkey") % 7, F.lit("()")).alias("demangled"), F.concat(F.lit("src/"), F.col("p_size"), F.lit(".c")).alias("source_file"))


def _findings(spark, d):
    fn = F.when(F.col("s_suppkey") % 3 == 0, F.concat(F.lit("f"), F.col("s_suppkey"))).when(F.col("s_suppkey") % 3 == 1, F.concat(F.lit("g"), F.col("s_suppkey") % 9)).otherwise("none")
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("finding"), fn.alias("function"), F.lit("src/").alias("file"))


_RES = """f AS (SELECT p_partkey AS nid, 'f' || (p_partkey % 300) AS name, 'ns::g' || (p_partkey % 7) || '()' AS demangled FROM part),
s AS (SELECT s_suppkey AS finding, CASE s_suppkey % 3 WHEN 0 THEN 'f' || s_suppkey WHEN 1 THEN 'g' || (s_suppkey % 9) ELSE 'none' END AS fn FROM supplier),
m AS (SELECT finding, 1 AS tier, min(nid) AS nid, count(*) AS candidates FROM s JOIN f ON name = fn GROUP BY finding),
z AS (SELECT finding, 2 AS tier, min(nid) AS nid, count(*) AS candidates FROM s JOIN f ON contains(demangled, fn) WHERE finding NOT IN (SELECT finding FROM m) GROUP BY finding),
a AS (SELECT * FROM m UNION ALL SELECT * FROM z)"""
_MATCHED = f"WITH {_RES} SELECT s.finding, a.nid, CAST(a.tier AS INTEGER) AS tier, a.candidates FROM s LEFT JOIN a ON a.finding = s.finding"


@query("pred_exact_then_fuzzy", _MATCHED)
@query("win_first_match", _MATCHED)
@query("join_sink_function", _MATCHED)
def join_sink_function(spark, d):
    return T.match_functions(_findings(spark, d), _functions(spark, d)).select("finding", "nid", "tier", "candidates")


@query("sink_reach_report", f"WITH {_RES} SELECT s.finding, CASE WHEN a.nid IS NULL THEN 'NOT_FOUND' WHEN s.finding % 5 = 0 THEN 'NOT_VULNERABLE' WHEN s.finding % 4 = 0 THEN 'UNKNOWN' WHEN s.finding % 2 = 1 THEN 'REACHABLE' ELSE 'NOT_REACHABLE' END AS status FROM s LEFT JOIN a ON a.finding = s.finding")
def sink_reach_report(spark, d):
    r = T.match_functions(_findings(spark, d), _functions(spark, d))
    return T.classify(r.withColumns({"vulnerable": F.col("finding") % 5 > 0, "searched": F.col("finding") % 4 > 0, "n_paths": F.col("finding") % 2})).select("finding", "status")


@query("join_results_by_dst", "SELECT n_nationkey AS dst, ['p' || m] AS nodes FROM nation LEFT JOIN (SELECT c_nationkey, max(c_custkey) AS m FROM customer WHERE c_nationkey % 2 = 0 GROUP BY 1) ON c_nationkey = n_nationkey WHERE m IS NOT NULL UNION ALL SELECT n_nationkey, NULL FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_nationkey % 2 = 0)")
def join_results_by_dst(spark, d):
    p = table(spark, d, "customer").filter("c_nationkey % 2 = 0").select(F.col("c_nationkey").alias("dst"), F.col("c_custkey").alias("seq"), F.array(F.concat(F.lit("p"), F.col("c_custkey"))).alias("nodes"), F.array(F.lit("e")).alias("edges"))
    return T.attach_paths(table(spark, d, "nation").select(F.col("n_nationkey").alias("dst")), p).select("dst", "nodes")


@query("agg_test_grouping", "SELECT test, CAST(regexp_extract(test, '_(\\d+)$', 1) AS INTEGER) AS \"index\", count(*) AS files FROM (SELECT 'case_' || (p_partkey % 90) AS test FROM part) GROUP BY test")
@query("sort_tests", "SELECT test, CAST(regexp_extract(test, '_(\\d+)$', 1) AS INTEGER) AS \"index\", count(*) AS files FROM (SELECT 'case_' || (p_partkey % 90) AS test FROM part) GROUP BY test")
def agg_test_grouping(spark, d):
    return T.group_tests(table(spark, d, "part").select(F.concat(F.lit("case_"), F.col("p_partkey") % 90, F.lit("a.c")).alias("name"))).orderBy("index")


@query("limit_tests", "SELECT o_orderpriority AS grp, o_orderkey FROM (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_orderkey) AS k FROM orders) WHERE k <= 200")
def limit_tests(spark, d):
    return T.first_tests(table(spark, d, "orders").select(F.col("o_orderpriority").alias("grp"), "o_orderkey"), "grp", ["o_orderkey"]).select("grp", "o_orderkey")


@query("agg_group_by_key", "SELECT n_regionkey AS k, list(n_nationkey ORDER BY n_nationkey) AS items FROM nation GROUP BY 1")
def agg_group_by_key(spark, d):
    return table(spark, d, "nation").groupBy(F.col("n_regionkey").alias("k")).agg(F.array_sort(F.collect_list("n_nationkey")).alias("items"))


def _documents(spark, d):
    key = lambda i: F.lit(("cve-id", "cve-description", "package-name", "package-version", "cwe-id", "cwe-name", "affected-function", "affected-file")[i])
    k = F.col("s_suppkey")
    values = [F.lit("x"), F.when(k % 5 == 0, " ").otherwise("d"), F.lit("p"), F.lit("1"), F.when(k % 7 == 0, "CWE-121").otherwise("121"), F.lit("n"), F.lit("f"), F.lit("a.c")]
    m = F.map_from_arrays(F.array(*[key(i) for i in range(8)]), F.array(*values))
    m = F.map_filter(m, lambda a, _: (k % 3 > 0) | (a != "package-name"))
    m = F.map_concat(m, F.when(k % 11 == 0, F.create_map(F.lit("remediation-strategy"), F.lit("jump"))).otherwise(F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<string>"))))
    return table(spark, d, "supplier").select(k.alias("index"), F.to_json(m).alias("doc"))


_DOCS = "SELECT s_suppkey AS \"index\", 'missing_key' AS rule FROM supplier WHERE s_suppkey % 3 = 0 UNION ALL SELECT s_suppkey, 'empty_cve-description' FROM supplier WHERE s_suppkey % 5 = 0 UNION ALL SELECT s_suppkey, 'cwe_not_numeric' FROM supplier WHERE s_suppkey % 7 = 0 UNION ALL SELECT s_suppkey, 'unknown_strategy' FROM supplier WHERE s_suppkey % 11 = 0"


@query("except_keys", _DOCS)
@query("validate_vuln_doc", _DOCS)
def validate_vuln_doc(spark, d):
    return T.finding_violations(_documents(spark, d))


@query("json_alias_keys", "SELECT CAST(p_partkey AS VARCHAR) AS cve_id, CASE p_size % 3 WHEN 0 THEN 'EXIT' ELSE 'CONTINUE' END AS strategy, true AS gated FROM part")
@query("map_strategy", "SELECT CAST(p_partkey AS VARCHAR) AS cve_id, CASE p_size % 3 WHEN 0 THEN 'EXIT' ELSE 'CONTINUE' END AS strategy, true AS gated FROM part")
def map_strategy(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_partkey") % 2 == 0, F.col("p_partkey")).alias("cve-id"), F.when(F.col("p_partkey") % 2 == 1, F.col("p_partkey")).alias("cve_id"), F.when(F.col("p_size") % 3 == 0, "exit").when(F.col("p_size") % 3 == 1, "other").alias("remediation-strategy"))
    return T.normalise_findings(p).select("cve_id", F.col("remediation_strategy").alias("strategy"), "gated")


@query("sink_vulnerabilities", "SELECT count(*) AS n FROM part")
def sink_vulnerabilities(spark, d):
    from corvid.sources.files import findings_json

    doc = findings_json(table(spark, d, "part").select(F.col("p_partkey").alias("cve_id")))
    return doc.select(F.json_array_length(F.get_json_object("value", "$.vulnerabilities")).cast("long").alias("n"))
