"""Registered queries against DuckDB on the smallest tables, and formats and state machines by hand."""

import struct

import duckdb
import pytest
from pyspark.sql import functions as F

from corvid.operators import graph as G
from corvid.operators.intervals import reconcile
from corvid.plans import registry
from corvid.session import TABLES
from corvid.sources.files import parse_ktest, read_stream

SF = "/root/testdata/sf0.001"
NAMES = ["proj_preset_columns", "proj_rename_legend", "sort_headers", "join_cwe_patch", "min_distances", "tree_compress", "dijkstra_path", "graph_cfg", "distmap_blacklist", "tree_dfs", "agg_tree_info", "win_last_record", "filter_cve_chain", "join_sink_function", "join_interval_floor", "connected_constraints", "bv_add", "bv_shl", "q_validity", "validate_vuln_doc"]


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return con


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    columns = sorted(df.columns)
    want = duck.sql(registry.oracle_sql()[name])
    assert sorted(want.columns) == columns
    order = [want.columns.index(c) for c in columns]
    got = sorted(repr([plain(v) for v in r]) for r in df.select(*columns).collect())
    assert got == sorted(repr([plain(r[i]) for i in order]) for r in want.fetchall())


def test_every_oracle_has_a_query():
    assert set(registry.oracle_sql()) <= set(registry.queries())


def test_ktest():
    chunk = lambda b: struct.pack(">i", len(b)) + b
    data = b"KTEST" + struct.pack(">ii", 3, 1) + chunk(b"prog") + struct.pack(">iii", 0, 0, 1) + chunk(b"x") + chunk(b"\x01\x00")
    assert parse_ktest(data) == (3, ["prog"], [("x", b"\x01\x00")])
    for bad in (b"OTHER", data[:-1], b"KTEST" + struct.pack(">i", 9)):
        with pytest.raises((ValueError, struct.error)):
            parse_ktest(bad)


def test_stack_reconcile():
    assert reconcile([(0, 10, "alloc"), (4, 2, "alloc")]) == [(0, 4, True), (4, 2, True), (6, 4, True)]
    assert reconcile([(0, 10, "alloc"), (0, 10, "free")]) == [(0, 10, False)]
    assert reconcile([(0, 4, "alloc"), (4, 4, "alloc"), (2, 4, "alloc")]) == [(0, 2, True), (2, 4, True), (6, 2, True)]


def test_read_stream_follows_all_forks(spark):
    rows = []
    for i in range(100):
        rows += [(4 * i, i, None, bytes([i])), (4 * i + 1, i + 1, i, None), (4 * i + 2, i, None, b"late")]
    rows += [(1000, 100, None, b"end"), (1001, 500, None, b"other")]
    kind = "seq long, stream long, fork long, data binary"
    assert bytes(read_stream(spark.createDataFrame(rows, kind), 100).first().data) == bytes(range(100)) + b"end"
    assert bytes(read_stream(spark.createDataFrame(rows, kind), 500).first().data) == b"other"
    with pytest.raises(ValueError, match="cycle"):
        read_stream(spark.createDataFrame([(1, 1, 2, None), (2, 2, 1, None)], kind), 1)


def test_k_lightest_paths_of_any_length(spark):
    """A ring of light edges with heavy chords: the lightest paths have more edges than any bound of a few."""
    n = 12
    light = [(str(i), str((i + 1) % n), "DirectCall", 1.0) for i in range(n)]
    edges = light + [(a, b, "IndirectCall", 1e6) for a, b in (("0", "6"), ("3", "11"), ("5", "11"), ("6", "2"), ("0", "2"))]
    out = {}
    for a, b, _, w in edges:
        out.setdefault(a, {})[b] = w

    def paths(node, goal, cost, nodes):
        if node == goal:
            yield cost, len(nodes), nodes
            return
        for b, w in out[node].items():
            if b not in nodes:
                yield from paths(b, goal, cost + w, [*nodes, b])

    asked = [(1, "0", "11"), (2, "4", "3"), (3, "7", "7")]
    want = [(q, r, c, ns) for q, a, b in asked if a != b for r, (c, _, ns) in enumerate(sorted(paths(a, b, 0.0, [a]))[:3], 1)]
    got = G.run_queries(spark.createDataFrame(edges, "src string, dst string, type string, weight double"), spark.createDataFrame(asked, "query_id long, src string, dst string"), k=3)
    assert sorted((r.query_id, r.rank, r.cost, r.nodes) for r in got.collect()) == sorted(want)


@pytest.mark.parametrize("name", ["topk_paths", "yen_k_paths"])
def test_k_paths_of_few_edges(spark, duck, name):
    """The SQL's bound of three edges, on a graph that has nodes farther than that from their goals."""
    test_query(spark, duck, name)
    chain = spark.createDataFrame([(str(i), str(i + 1), "DirectCall", 1.0) for i in range(7)] + [("0", "3", "DirectCall", 5.0)], "src string, dst string, type string, weight double")
    asked = spark.createDataFrame([(1, "0", "3"), (2, "0", "4"), (3, "0", "5")], "query_id long, src string, dst string")
    got = G.k_shortest(chain, asked, 3, 3)
    assert sorted((r.query_id, r.rank, r.cost, r.nodes) for r in got.collect()) == [(1, 1, 3.0, ["0", "1", "2", "3"]), (1, 2, 5.0, ["0", "3"]), (2, 1, 6.0, ["0", "3", "4"]), (3, 1, 7.0, ["0", "3", "4", "5"])]


def test_filter_cves_defaults(spark):
    """Unscored and rejected ones go, disputed and deferred ones stay; a least score does not judge the unscored."""
    from corvid.operators.triage import filter_cves

    rows = [("a", 7.0, [], "Analyzed"), ("b", None, [], "Analyzed"), ("c", 0.0, [], "Analyzed"), ("d", 3.0, ["disputed"], None), ("e", 9.0, [], "DEFERRED"), ("f", 9.0, [], "rejected")]
    df = spark.createDataFrame(rows, "id string, score double, tags array<string>, status string")
    ids = lambda **k: sorted(r.id for r in filter_cves(df, **k).collect())
    assert ids() == ["a", "d", "e"]
    assert ids(min_score=5.0) == ["a", "e"]
    assert ids(min_score=5.0, allow_no_score=True) == ["a", "b", "c", "e"]
    assert ids(allow_disputed=False, allow_deferred=False, allow_rejected=True) == ["a", "f"]
    assert ids(ids=[]) == ["a", "d", "e"] and ids(ids=["a", "b"]) == ["a"]


def test_match_functions(spark):
    """Against all pairs by hand: both tiers, short, empty and null parts, null files, ties; and no pair of rows is compared that shares no text."""
    from corvid.operators.triage import match_functions

    names = ["main", "run", "a::run(int)", "é::ab", "x", None, "aaa"]
    functions = [(i % 2, i, names[i % 7], names[(i * 3 + 1) % 7] if i % 3 else None, f"src/{i % 4}.c" if i % 5 else None) for i in range(40)]
    asked = ["run", "un(", "é", "ab", "", None, "aaaa", "main", "aa", "::"]
    findings = [(i, asked[i % 10], [None, "src/1", "src/9", ""][i % 4]) for i in range(40)]
    want = []
    for i, fn, file in findings:
        one = [(m, n) for m, n, name, _, src in functions if fn is not None and name == fn and (file or "") in (src or "")]
        two = [(m, n) for m, n, name, text, _ in functions if fn is not None and fn in (text or name or "") and (text or name) is not None]
        best = (min(one), 1, len(one)) if one else (min(two), 2, len(two)) if two else (None, None, None)
        want.append((i, *best))
    f = spark.createDataFrame(functions, "mid int, nid long, name string, demangled string, source_file string")
    got = match_functions(spark.createDataFrame(findings, "finding long, function string, file string"), f)
    assert sorted((r.finding, (r.mid, r.nid) if r.tier else None, r.tier, r.candidates) for r in got.collect()) == want
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_contained_sets(spark):
    """Against all pairs by hand: copies in several pieces and salts, null items and ids; pairs of ids are not grouped."""
    from corvid.operators import constraints as C

    a = [(i, x) for i in range(60) for x in range(3) if (i >> x) & 1 or i % 10 == 0 and x == i % 3] + [(70, None), (70, 1), (71, 99), (None, 1), (72, 1), (72, 1)]
    b = [(100 + i, x) for i in range(90) for x in range(6) if (i >> x) & 1 or x == i % 6] + [(None, 1), (None, 2), (5, 1), (300, None), (301, None), (301, 2)]
    of = lambda rows: {i: {x for j, x in rows if j == i} for i, _ in rows}
    want = [(i, j) for i, x in of(a).items() if i is not None and None not in x for j, y in of(b).items() if x <= y]
    assert len(want) > 1000
    old, (C.PIECE, C.WORK) = (C.PIECE, C.WORK), (4, 50)
    try:
        df = [spark.createDataFrame(rows, "id long, item long") for rows in (a, b)]
        got = C.contained_sets(*df)
        key = lambda r: (r[0], r[1] is None, r[1] or 0)
        assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
        less = C.contained_sets(*df, F.col("a") > F.col("b"))
        assert sorted(map(tuple, less.collect())) == sorted((i, j) for i, j in want if j is not None and i > j)
    finally:
        C.PIECE, C.WORK = old
    assert "keys=[a#" not in got._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("kind", ["long", "int", "double"])
def test_contained_sets_of_one_rarest_item(spark, monkeypatch, kind):
    """All sets meet by one item: compared in several tasks, and pairs of ids are made from one id at a time."""
    from corvid.operators import constraints as C

    a = [(i, x) for i in range(40) for x in (0, i % 36 + 1)]
    b = [(100 + j, x) for j in range(50) for x in range(j >= 20, 41) if x != j % 40 + 1]
    of = lambda rows: {i: {x for j, x in rows if j == i} for i, _ in rows}
    staged, keep = [], C.stage
    monkeypatch.setattr(C, "stage", lambda df: staged.append(df) or keep(df))
    monkeypatch.setattr(C, "TESTS", 4, raising=False)
    first, second = (spark.createDataFrame(rows, "id long, item long") for rows in (a, b))
    got = C.contained_sets(first.withColumn("item", F.col("item").cast(kind)), second)
    assert sorted(map(tuple, got.collect())) == sorted((i, j) for i, x in of(a).items() for j, y in of(b).items() if x <= y)
    pairs = next(df for df in staged if "items_b" in df.columns)
    assert pairs.select(F.spark_partition_id()).distinct().count() > 1
    assert [x for x in got._jdf.queryExecution().sparkPlan().toString().replace("(", " ").split() if x in ("Generate", "Coalesce")][:3] == ["Generate", "Coalesce", "Generate"]


def test_subset_reads_all_lines(spark, tmp_path):
    """join_set_subset: sets have the lines of every quantity, on both sides; equal to all pairs by hand and to the SQL."""
    lines = [(i, 100 + j * (i % 3 + 1), q) for i in [*range(0, 130, 5), 7] for j in range(i // 5 % 4 + 1) for q in ((1.0, 30.0, 44.0, 48.0, None)[(i + j) % 5],)]
    lines += [(20, None, 2.0), (140, 100, 3.0), (140, 140, 49.0), (None, 100, 1.0), (160, 100, None)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double").write.parquet(f"{tmp_path}/lineitem.parquet")
    of = {i: {None if s is None else s % 40 for j, s, _ in lines if j == i} for i, _, _ in lines}
    want = [(i, j) for i, x in of.items() if i is not None and i % 20 == 0 and None not in x for j, y in of.items() if x <= y]
    key = lambda r: (r[0], r[1] is None, r[1] or 0)
    assert (60, 40) in want and (160, None) in want and (140, 160) in want and not any(i == 20 for i, _ in want)
    assert sorted(map(tuple, registry.queries()["join_set_subset"](spark, str(tmp_path)).select("a", "b").collect()), key=key) == sorted(want, key=key)
    con = duckdb.connect()
    con.execute(f"CREATE VIEW lineitem AS SELECT * FROM read_parquet('{tmp_path}/lineitem.parquet/*.parquet')")
    assert sorted(con.sql(registry.oracle_sql()["join_set_subset"]).fetchall(), key=key) == sorted(want, key=key)


def test_loops_and_limits_raise(spark):
    from corvid.operators.tree import compress_tree, with_depth

    loop = spark.createDataFrame([(1, 2, 0), (2, 1, 0)], "id long, left long, right long")
    for f in (compress_tree, with_depth):
        with pytest.raises(ValueError):
            f(loop).count()
    chain = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    with pytest.raises(RuntimeError):
        G.min_distances(chain, spark.createDataFrame([(0, 0)], "query_id long, node long"), max_steps=3)


def test_report_tables():
    from corvid.operators.stats import LEGEND, PRESETS

    assert len(LEGEND) == 58 and LEGEND["NumStates"] == "ActiveStates" and LEGEND["RelSolverTime"] == "TSolver(%)"
    assert all(c == "Path" or c in LEGEND for p in PRESETS.values() for c in p)
