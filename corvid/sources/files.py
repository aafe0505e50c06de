"""Readers and writers of the engine's file formats."""

from __future__ import annotations

import json
import sqlite3
import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from corvid.staging import stage

NODE = "struct<type:string,name:string,linkage:string,call_type:string,idx:long,function_type:string,address_taken:boolean,opcode:string,source_file:string,source_loc:string>"
FACTS = f"struct<modules:map<string,struct<nodes:map<string,{NODE}>,edges:map<string,struct<kinds:array<string>>>>>>"


def scan_facts(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, edges, rejected) of newline-delimited facts; of modules with equal ids the first in line order stays."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.monotonically_increasing_id().alias("line"), F.from_json("value", FACTS).alias("f"))
    modules = lines.select("file", "line", F.explode("f.modules").alias("mid", "m")).withColumn("mid", F.col("mid").cast("long"))
    rank = F.row_number().over(Window.partitionBy("mid").orderBy("file", "line"))
    ranked = modules.withColumn("_r", rank)
    kept = ranked.filter("_r = 1")
    nodes = kept.select("mid", F.explode("m.nodes").alias("nid", "n")).select("mid", F.col("nid").cast("long").alias("nid"), "n.*")
    ends = F.from_json("e", "array<bigint>")
    edges = kept.select("mid", F.explode("m.edges").alias("e", "k")).select("mid", ends[0].alias("src"), ends[1].alias("dst"), F.explode("k.kinds").alias("kind"))
    return nodes, edges, ranked.filter("_r > 1").select("mid", "file", "line")


def facts_json(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """One JSON line per module."""
    attributes = [c for c in nodes.columns if c not in ("mid", "nid")]
    n = nodes.groupBy("mid").agg(F.map_from_entries(F.collect_list(F.struct(F.col("nid").cast("string"), F.struct(*attributes)))).alias("nodes"))
    key = F.concat(F.lit("["), F.col("src").cast("string"), F.lit(","), F.col("dst").cast("string"), F.lit("]"))
    each = edges.groupBy("mid", key.alias("e")).agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    e = each.groupBy("mid").agg(F.map_from_entries(F.collect_list(F.struct("e", F.struct("kinds")))).alias("edges"))
    joined = n.join(e, "mid", "left")
    return joined.select(F.to_json(F.struct(F.map_from_arrays(F.array(F.col("mid").cast("string")), F.array(F.struct("nodes", "edges"))).alias("modules"))).alias("value"))


def scan_dlsym(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.schema("loaded_symbols array<struct<symbol:string,library:string>>").json(path, multiLine=True)
    return rows.select(F.explode("loaded_symbols").alias("s")).select("s.symbol", "s.library").distinct()


def scan_spdx(spark: SparkSession, path: str) -> DataFrame:
    """(name, version) of SPDX 3 elements, or of SPDX 2 packages where a file has none."""
    v3 = "array<struct<element:array<struct<name:string,software_packageVersion:string,type:string>>>>"
    raw = spark.read.text(path, wholetext=True).select(F.from_json("value", f"`@graph` {v3}, packages array<struct<name:string,versionInfo:string>>").alias("d"))
    e = raw.select(F.explode(F.flatten(F.transform(F.col("d")["@graph"], lambda g: g["element"]))).alias("e")).filter("e.software_packageVersion IS NOT NULL").select("e.name", F.col("e.software_packageVersion").alias("version"))
    p = raw.filter(F.col("d")["@graph"].isNull()).select(F.explode("d.packages").alias("p")).select("p.name", F.nullif(F.regexp_extract("p.versionInfo", r"\d+\.\d+(?:\.\d+)*", 0), F.lit("")).alias("version"))
    return e.unionByName(p).dropDuplicates()


CVE_PAGE = (
    "totalResults long, vulnerabilities array<struct<cve:struct<id:string,vulnStatus:string,cveTags:array<struct<tags:array<string>>>,descriptions:array<struct<lang:string,value:string>>,"
    "metrics:struct<cvssMetricV31:array<struct<cvssData:struct<baseScore:double>>>,cvssMetricV30:array<struct<cvssData:struct<baseScore:double>>>>,"
    "weaknesses:array<struct<description:array<struct<lang:string,value:string>>>>>>>"
)


def scan_cve_pages(spark: SparkSession, path: str) -> DataFrame:
    """One row per CVE of stored pages: id, status, tags, descriptions, metrics, weaknesses."""
    c = spark.read.schema(CVE_PAGE).json(path, multiLine=True).select(F.explode("vulnerabilities").alias("v")).select("v.cve.*")
    return c.select("id", F.col("vulnStatus").alias("status"), F.flatten(F.transform("cveTags", lambda t: t["tags"])).alias("tags"), "descriptions", "metrics", "weaknesses")


def scan_findings(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.json(path, multiLine=True).select(F.explode("vulnerabilities").alias("v")).select("v.*")


def findings_json(df: DataFrame) -> DataFrame:
    """One document of all findings."""
    return df.agg(F.to_json(F.struct(F.collect_list(F.struct(*df.columns)).alias("vulnerabilities"))).alias("value"))


def scan_sqlite(spark: SparkSession, path: str, table: str) -> DataFrame:
    """A table of a local SQLite file (there is no JDBC driver): read once on the driver, with seq for the row order. A missing table gives null."""
    with sqlite3.connect(f"file:{path}?mode=ro", uri=True) as con:
        if not con.execute("SELECT 1 FROM sqlite_master WHERE type = 'table' AND name = ?", (table,)).fetchone():
            return None
        cursor = con.execute(f'SELECT rowid AS seq, * FROM "{table}"')
        names = [d[0] for d in cursor.description]
        rows = cursor.fetchall()
    columns = {n: [r[i] for r in rows] for i, n in enumerate(names)}
    return spark.createDataFrame(pa.table({n: pa.array(v, pa.float64() if any(isinstance(x, float) for x in v) else pa.int64() if all(x is None or isinstance(x, int) for x in v) else pa.string()) for n, v in columns.items()}))


def run_dirs(spark: SparkSession, path: str) -> DataFrame:
    """Folders below path that hold both `info` and `run.stats`."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.regexp_extract("path", r"^(.*)/([^/]+)$", 1).alias("dir"), F.regexp_extract("path", r"([^/]+)$", 1).alias("name"))
    return files.groupBy("dir").agg(F.collect_set("name").alias("names")).filter(F.array_contains("names", "info") & F.array_contains("names", "run.stats")).select("dir")


def scan_istats(spark: SparkSession, path: str) -> DataFrame:
    """file, function, pos, line and event values of callgrind-like text; the current fl= and fn= carry to the rows after them."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("run"), F.posexplode(F.split("value", "\n")).alias("n", "l"))
    w = Window.partitionBy("run").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda k: F.last(F.when(F.col("l").startswith(f"{k}="), F.substring("l", len(k) + 2, 1 << 20)), ignorenulls=True).over(w)
    rows = lines.select("run", "n", "l", carry("fl").alias("file"), carry("fn").alias("function"), F.lag("l").over(Window.partitionBy("run").orderBy("n")).startswith("calls=").alias("is_call"))
    parts = F.split("l", " ")
    return rows.filter(F.col("l").rlike(r"^\d+( \d+)+$")).select("run", "n", "file", "function", F.coalesce("is_call", F.lit(False)).alias("is_call"), parts[0].cast("long").alias("pos"), parts[1].cast("long").alias("line"), F.transform(F.slice(parts, F.lit(3), F.size(parts)), lambda x: x.cast("long")).alias("values"))


def parse_ktest(data: bytes) -> tuple[int, list[str], list[tuple[str, bytes]]]:
    """(version, arguments, objects) of a big-endian test-case record."""
    at = 5
    if data[:5] not in (b"KTEST", b"BOUT\n"):
        raise ValueError("not a test case")

    def number() -> int:
        nonlocal at
        at += 4
        return struct.unpack_from(">i", data, at - 4)[0]

    def chunk() -> bytes:
        nonlocal at
        n = number()
        if n < 0 or at + n > len(data):
            raise ValueError("the record ends early")
        at += n
        return data[at - n : at]

    version = number()
    if version > 3:
        raise ValueError(f"version {version} is not known")
    args = [chunk().decode("latin-1") for _ in range(number())]
    if version >= 2:
        number(), number()
    return version, args, [(chunk().decode("latin-1"), chunk()) for _ in range(number())]


def scan_ktest(spark: SparkSession, path: str) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for p, c in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                v, args, objects = parse_ktest(c)
                out += [{"path": p, "version": v, "args": args, "pos": i, "name": n, "data": d} for i, (n, d) in enumerate(objects)]
            if out:
                yield pa.RecordBatch.from_pylist(out, pa.schema([("path", pa.string()), ("version", pa.int64()), ("args", pa.list_(pa.string())), ("pos", pa.int64()), ("name", pa.string()), ("data", pa.binary())]))

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(rows, "path string, version long, args array<string>, pos long, name string, data binary")


def extract_objects(objects: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(objects asked for, names that no object has)."""
    return objects.join(names, "name", "left_semi"), names.join(objects, "name", "left_anti")


def read_stream(frames: DataFrame, stream: int) -> DataFrame:
    """Bytes of one forking stream from frames (seq, stream, fork: parent at a fork or null, data): each ancestor's data up to the fork.

    The chain is followed to its root by pointers that double in length each step; a cycle is an error.
    """
    forks = stage(frames.filter("fork IS NOT NULL").groupBy("stream").agg(F.min(F.struct("seq", "fork")).alias("f")).select("stream", "f.fork", "f.seq"))
    jumps, chain, most = forks.select("stream", "fork"), frames.sparkSession.range(1).select(F.lit(stream).cast("long").alias("stream")), forks.count()
    reach = 1
    while True:
        up = stage(chain.join(jumps, "stream").select(F.col("fork").cast("long").alias("stream")))
        if up.isEmpty():
            break
        if reach > most:
            raise ValueError(f"the forks of stream {stream} form a cycle")
        chain = stage(chain.unionByName(up).distinct())
        far = jumps.select(F.col("stream").alias("fork"), F.col("fork").alias("next"))
        jumps, reach = stage(jumps.join(far, "fork").select("stream", F.col("next").alias("fork"))), 2 * reach
    upto = chain.join(forks, "stream").select(F.col("fork").alias("stream"), F.col("seq").alias("upto"))
    parts = frames.filter("data IS NOT NULL").join(chain, "stream", "left_semi").join(upto, "stream", "left").filter("upto IS NULL OR seq < upto")
    return parts.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", F.hex("data").alias("h")))), lambda x: x["h"]), "").alias("h")).select(F.unhex("h").alias("data"))


RUNTIME = r"^\[(ARG|RET|BB|STACK|HEAP|RESOLVE)\]\s*(.*)$"


def scan_runtime_log(spark: SparkSession, path: str) -> DataFrame:
    """kind and body of tagged lines."""
    return spark.read.text(path).filter(F.col("value").rlike(RUNTIME)).select(F.regexp_extract("value", RUNTIME, 1).alias("kind"), F.regexp_extract("value", RUNTIME, 2).alias("body"))


def scan_query_log(spark: SparkSession, path: str) -> DataFrame:
    """query, type, elapsed_us and outcome of `# Query n -- Type: t, Instructions: i` and `#   OK -- Elapsed: s` lines."""
    lines = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("f"), F.posexplode(F.split("value", "\n")).alias("n", "l"))
    w = Window.partitionBy("f").orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    q = F.last(F.nullif(F.regexp_extract("l", r"Query (\d+)", 1), F.lit("")), ignorenulls=True).over(w)
    t = F.last(F.nullif(F.regexp_extract("l", r"Type: (\w+)", 1), F.lit("")), ignorenulls=True).over(w)
    done = lines.select(q.cast("long").alias("query"), t.alias("type"), "l")
    return done.filter(F.col("l").contains("Elapsed:")).select("query", "type", F.round(F.regexp_extract("l", r"Elapsed: ([\d.]+)", 1).cast("double") * 1e6).cast("long").alias("elapsed_us"), F.regexp_extract("l", r"#\s+(\w+) --", 1).alias("outcome"))


def slow_queries(df: DataFrame, min_us: int, keep_timeouts: bool = True) -> DataFrame:
    return df.filter((F.col("elapsed_us") >= min_us) | (F.lit(keep_timeouts) & (F.col("outcome") == "TIMEOUT")))


def tree_dot(tree: DataFrame) -> DataFrame:
    """DOT lines of an execution tree: nodes coloured by class, then its edges."""
    node = F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(" [color="), F.when((F.col("left") == 0) & (F.col("right") == 0), "red").otherwise("green"), F.lit("];"))
    edge = F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(" -> n"), F.col("child").cast("string"), F.lit(";"))
    kids = tree.select("id", F.explode(F.array("left", "right")).alias("child")).filter("child <> 0")
    return tree.select(F.lit(0).alias("part"), "id", node.alias("line")).unionByName(kids.select(F.lit(1).alias("part"), "id", edge.alias("line")))


def load_json(path: str, **overrides) -> dict:
    """A configuration file under its overrides."""
    with open(path) as f:
        return {**json.load(f), **{k: v for k, v in overrides.items() if v is not None}}
