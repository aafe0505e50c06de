"""Findings: validation, matching to functions, enrichment from dependencies and CVE records, reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.functions.text import STRATEGIES, strategy
from corvid.staging import stage

REQUIRED = ("cve-id", "cve-description", "package-name", "package-version", "cwe-id", "cwe-name", "affected-function", "affected-file")
OPTIONAL = ("remediation-strategy", "output", "gated", "undesirable-function")


def normalise_findings(df: DataFrame) -> DataFrame:
    """One column per known key, from its spelling with - or _, with the defaults of optional ones."""
    out = []
    for key in (*REQUIRED, *OPTIONAL):
        name = key.replace("-", "_")
        have = [F.col(f"`{c}`") for c in dict.fromkeys((key, name)) if c in df.columns]
        value = F.coalesce(*have) if have else F.lit(None)
        out.append((strategy(value.cast("string")) if name == "remediation_strategy" else F.coalesce(value.cast("boolean"), F.lit(True)) if name == "gated" else value.cast("string")).alias(name))
    return df.select(*out)


def finding_violations(df: DataFrame) -> DataFrame:
    """(index, rule) for findings (index, doc: JSON object): key sets, empty texts, CWE and strategy."""
    keys = F.coalesce(F.json_object_keys("doc"), F.array().cast("array<string>"))
    value = lambda k: F.get_json_object("doc", f"$['{k}']")
    rule = lambda cond, name: F.when(cond, F.lit(name))
    rules = [
        rule(F.size(F.array_except(F.array(*map(F.lit, REQUIRED)), keys)) > 0, "missing_key"),
        rule(F.size(F.array_except(keys, F.array(*map(F.lit, REQUIRED + OPTIONAL)))) > 0, "unexpected_key"),
        *[rule(F.trim(value(k)) == "", f"empty_{k}") for k in REQUIRED],
        rule(~value("cwe-id").rlike(r"^(\d+|UNKNOWN)$"), "cwe_not_numeric"),
        rule(~F.upper(value("remediation-strategy")).isin(*STRATEGIES), "unknown_strategy"),
    ]
    return df.select("index", F.explode(F.array_compact(F.array(*rules))).alias("rule"))


def v3_score(metrics: Column) -> Column:
    """The first v3.1 base score, else the first v3.0 one, else null."""
    first = lambda name: F.get(metrics[name], F.lit(0))["cvssData"]["baseScore"]
    return F.coalesce(first("cvssMetricV31"), first("cvssMetricV30"))


def description_en(descriptions: Column) -> Column:
    return F.coalesce(F.get(F.filter(descriptions, lambda d: d["lang"] == "en"), F.lit(0))["value"], F.get(descriptions, F.lit(0))["value"])


def filter_cves(df: DataFrame, min_score: float = 0.0, allow_no_score: bool = False, allow_disputed: bool = True, allow_deferred: bool = True, allow_rejected: bool = False, ids: list[str] | None = None) -> DataFrame:
    """CVEs (id, score, tags, status) that pass all predicates.

    A score of null or 0 is no score, which the least score does not judge. Statuses are compared without
    case; no ids, or none in the list, allow all.
    """
    scored = F.col("score").isNotNull() & (F.col("score") != 0)
    keep = F.when(scored, F.col("score") >= min_score).otherwise(F.lit(allow_no_score))
    if not allow_disputed:
        keep = keep & ~F.coalesce(F.array_contains("tags", "disputed"), F.lit(False))
    if ids:
        keep = keep & F.col("id").isin(ids)
    for allowed, status in ((allow_deferred, "deferred"), (allow_rejected, "rejected")):
        if not allowed:
            keep = keep & ~F.lower("status").eqNullSafe(status)
    return df.filter(keep)


def unmatched_ids(ids: DataFrame, cves: DataFrame) -> DataFrame:
    return ids.join(cves.select("id"), "id", "left_anti")


def distinct_deps(df: DataFrame) -> DataFrame:
    return df.select("name", "version").dropDuplicates()


def match_dependencies(deps: DataFrame, cpes: DataFrame) -> DataFrame:
    """Dependencies with the CVEs (product, version, id) of their product and version."""
    return deps.join(cpes, (F.split_part(deps["name"], F.lit(":"), F.lit(1)) == cpes["product"]) & (deps["version"] == cpes["version"])).select(deps["name"], deps["version"], "id")


def attach_cwe(weak: DataFrame, cwe: DataFrame) -> DataFrame:
    """(id, pos, cwe_id) with names from the CWE table, null where unknown."""
    return weak.join(cwe, "cwe_id", "left")


def findings_from_cves(df: DataFrame) -> DataFrame:
    """One finding per CVE and distinct CWE (id, pos, cwe_id, cwe_name): the last name counts; UNKNOWN where there is none."""
    each = df.withColumn("cwe_id", F.coalesce("cwe_id", F.lit("UNKNOWN")))
    return each.groupBy("id", "cwe_id").agg(F.coalesce(F.max_by("cwe_name", "pos"), F.lit("UNKNOWN")).alias("cwe_name"))


def attach_package_version(findings: DataFrame, manifests: DataFrame) -> DataFrame:
    """Findings (package) with the version of their overlay manifest, else of the root manifest (kind, package, version)."""
    of = lambda kind: manifests.filter(F.col("kind") == kind).groupBy("package").agg(F.min("version").alias(f"_{kind}"))
    return findings.join(of("overlay"), "package", "left").join(of("root"), "package", "left").withColumn("version", F.coalesce("_overlay", "_root")).drop("_overlay", "_root")


def _grams(c: Column, sizes: Column) -> Column:
    """The distinct substrings of c of the given sizes; of size 0 the empty one."""
    of = lambda n: F.when(n == 0, F.array(F.lit(""))).when(F.length(c) >= n, F.transform(F.sequence(F.lit(1), F.length(c) - n + 1), lambda i: F.substring(c, i, n))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.flatten(F.transform(sizes, of)))


def contained_texts(parts: DataFrame, texts: DataFrame) -> DataFrame:
    """All (part, text) where the text contains the part, from distinct parts (part) and texts (text).

    Of the 3-grams of a part (the whole part if it is shorter) the one in the fewest texts brings its candidates.
    """
    each = stage(parts.filter("part IS NOT NULL").select("part", F.explode(_grams(F.col("part"), F.array(F.least(F.length("part"), F.lit(3))))).alias("gram")))
    index = stage(texts.select("text", F.explode(_grams(F.col("text"), F.array(*map(F.lit, range(4))))).alias("gram")).join(each.select("gram").distinct(), "gram", "left_semi"))
    rarest = each.join(index.groupBy("gram").agg(F.count("*").alias("n")), "gram").groupBy("part").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"))
    return index.join(rarest, "gram").filter(F.contains("text", F.col("part"))).select("part", "text")


def match_functions(findings: DataFrame, functions: DataFrame) -> DataFrame:
    """finding with its best function: exact name in a file that contains the finding's, else a part of the demangled name; ties by mid, nid.

    Both tiers compare distinct texts, which bring the best and the number of their functions: exact names by an
    equi join, and only for findings without one parts of names, by their grams.
    """
    f = functions.select(F.struct("mid", "nid").alias("_b"), F.col("name").alias("_name"), F.coalesce("demangled", "name").alias("_text"), F.coalesce("source_file", F.lit("")).alias("_file"))
    best = [F.min("_b").alias("_b"), F.sum("_n").alias("_n")]
    of = lambda *keys: f.groupBy(*keys).agg(F.min("_b").alias("_b"), F.count("*").alias("_n"))
    asked = findings.select("finding", F.col("function").alias("_name"), F.coalesce("file", F.lit("")).alias("_part"))
    exact = asked.select("_name", "_part").distinct().join(of("_name", "_file"), "_name").filter(F.contains("_file", F.col("_part"))).groupBy("_name", "_part").agg(*best)
    first = stage(asked.join(exact, ["_name", "_part"]).groupBy("finding").agg(*best))
    rest = stage(asked.join(first, "finding", "left_anti").select("finding", "_name"))
    texts = stage(of("_text"))
    pairs = contained_texts(rest.select(F.col("_name").alias("part")).distinct(), texts.select(F.col("_text").alias("text"))).toDF("_name", "_text")
    second = rest.join(pairs.join(texts, "_text").groupBy("_name").agg(*best), "_name").groupBy("finding").agg(*best)
    found = first.withColumn("tier", F.lit(1)).unionByName(second.withColumn("tier", F.lit(2))).select("finding", "_b.mid", "_b.nid", "tier", F.col("_n").alias("candidates"))
    return findings.join(found, "finding", "left")


def classify(findings: DataFrame) -> DataFrame:
    """status from nid, vulnerable (by version), searched and n_paths: not found comes before not vulnerable, before the search."""
    status = F.when(F.col("nid").isNull(), "NOT_FOUND").when(~F.coalesce("vulnerable", F.lit(True)), "NOT_VULNERABLE").when(~F.coalesce("searched", F.lit(False)), "UNKNOWN").when(F.col("n_paths") > 0, "REACHABLE").otherwise("NOT_REACHABLE")
    return findings.withColumn("status", status)


def attach_paths(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings (dst) with the paths to it; of several results the last (seq) counts."""
    last = paths.groupBy("dst").agg(F.max_by(F.struct("nodes", "edges"), "seq").alias("p"))
    return findings.join(last.select("dst", "p.*"), "dst", "left")


def decorate_paths(paths: DataFrame, labels: DataFrame) -> DataFrame:
    """Paths (query_id, nodes) with each node's label (node, label), in order."""
    each = paths.select("query_id", F.posexplode("nodes").alias("pos", "node")).join(labels, "node", "left")
    return each.groupBy("query_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.coalesce("label", "node").alias("label")))), lambda x: x["label"]).alias("labels"))


def with_module_file(nodes: DataFrame) -> DataFrame:
    """Nodes with the source file of their module, the node whose nid is its mid."""
    m = nodes.filter("nid = mid").select("mid", F.col("source_file").alias("module_file"))
    return nodes.join(m, "mid", "left")


#: Offsets of the sanitizers that a CWE needs; CWE 0 stands for all of them.
SANITIZERS = {0: [0, 1, 2, 3, 4, 5], 121: [0], 122: [0], 123: [0], 125: [0], 131: [0], 190: [4], 369: [3], 476: [1], 590: [2], 787: [0], 1335: [5]}


def sanitizer_flags(findings: DataFrame, cwe: str = "cwe") -> DataFrame:
    """Findings with one row per sanitizer offset of their CWE, a null offset where the CWE has none."""
    table = F.create_map(*[x for k, v in SANITIZERS.items() for x in (F.lit(k), F.array(*[F.lit(i) for i in v]))])
    return findings.withColumn("flag", F.explode_outer(F.try_element_at(table, F.col(cwe))))


def group_tests(files: DataFrame) -> DataFrame:
    """Files by the test they belong to: all up to the last number of the name, and that number as index."""
    key = F.regexp_extract("name", r"^(.*_(\d+))", 1)
    return files.withColumn("test", key).filter("test <> ''").groupBy("test").agg(F.regexp_extract(F.first("name"), r"^.*_(\d+)", 1).cast("int").alias("index"), F.count("*").alias("files"))


def first_tests(tests: DataFrame, group: str, order: list[str], n: int = 200) -> DataFrame:
    return tests.withColumn("rank", F.row_number().over(Window.partitionBy(group).orderBy(*order))).filter(F.col("rank") <= n)


def reach_csv(paths: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with a running id from 0, node properties) of reachable paths for the CSV export."""
    steps = paths.select("query_id", F.posexplode(F.arrays_zip(F.slice("nodes", F.lit(1), F.size("nodes") - 1), "edges", F.slice("nodes", F.lit(2), F.size("nodes")))).alias("pos", "s"))
    flat = steps.select("query_id", "pos", F.col("s")["0"].alias("src"), F.col("s")["edges"].alias("edge"), F.col("s")["2"].alias("dst"))
    start = flat.groupBy("query_id").count().withColumn("_before", F.coalesce(F.sum("count").over(Window.orderBy("query_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("count")
    edges = flat.join(start, "query_id").select((F.col("_before") + F.col("pos")).alias("edge_id"), "src", "edge", "dst")
    return edges, paths.select(F.explode("nodes").alias("node")).distinct()


def violations_union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, parts)
