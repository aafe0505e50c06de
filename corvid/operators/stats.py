"""Run statistics: last records, maxima, derived columns, totals, time buckets and coverage."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: Columns that hold microseconds.
TIMES = ("UserTime", "WallTime", "QueryTime", "SolverTime", "CexCacheTime", "ForkTime", "ResolveTime")
#: Stored columns of each report preset; any other name stands for the default.
PRESETS = {
    "default": ("Path", "Instructions", "WallTime", "ICov", "BCov", "ICount", "RelSolverTime"),
    "reltime": ("Path", "WallTime", "RelUserTime", "RelSolverTime", "RelCexCacheTime", "RelForkTime", "RelResolveTime"),
    "abstime": ("Path", "WallTime", "UserTime", "SolverTime", "CexCacheTime", "ForkTime", "ResolveTime"),
    "more": ("Path", "Instructions", "WallTime", "ICov", "BCov", "ICount", "RelSolverTime", "NumStates", "MaxStates", "MallocUsage", "MaxMem"),
}
#: Report names of stored columns, in the order of the report.
LEGEND = {
    "Instructions": "Instrs",
    "WallTime": "Time(s)",
    "ICov": "ICov(%)",
    "BCov": "BCov(%)",
    "ICount": "ICount",
    "RelSolverTime": "TSolver(%)",
    "CoveredInstructions": "ICovered",
    "UncoveredInstructions": "IUncovered",
    "NumBranches": "Branches",
    "FullBranches": "FullBranches",
    "PartialBranches": "PartialBranches",
    "ExternalCalls": "ExternalCalls",
    "UserTime": "TUser(s)",
    "ResolveTime": "TResolve(s)",
    "RelResolveTime": "TResolve(%)",
    "CexCacheTime": "TCex(s)",
    "RelCexCacheTime": "TCex(%)",
    "QueryTime": "TQuery(s)",
    "SolverTime": "TSolver(s)",
    "States": "States",
    "NumStates": "ActiveStates",
    "MaxStates": "MaxActiveStates",
    "AvgStates": "AvgActiveStates",
    "InhibitedForks": "InhibitedForks",
    "Queries": "Queries",
    "SolverQueries": "SolverQueries",
    "NumQueryConstructs": "SolverQueryConstructs",
    "AvgQC": "AvgSolverQuerySize",
    "QueryCacheMisses": "QCacheMisses",
    "QueryCacheHits": "QCacheHits",
    "QueryCexCacheMisses": "QCexCacheMisses",
    "QueryCexCacheHits": "QCexCacheHits",
    "Allocations": "Allocations",
    "MallocUsage": "Mem(MiB)",
    "MaxMem": "MaxMem(MiB)",
    "AvgMem": "AvgMem(MiB)",
    "BranchesConditional": "BrConditional",
    "BranchesIndirect": "BrIndirect",
    "BranchesSwitch": "BrSwitch",
    "BranchesCall": "BrCall",
    "BranchesMemOp": "BrMemOp",
    "BranchesResolvePointer": "BrResolvePointer",
    "BranchesAlloc": "BrAlloc",
    "BranchesRealloc": "BrRealloc",
    "BranchesFree": "BrFree",
    "BranchesGetVal": "BrGetVal",
    "TerminationExit": "TermExit",
    "TerminationEarly": "TermEarly",
    "TerminationSolverError": "TermSolverErr",
    "TerminationProgramError": "TermProgrErr",
    "TerminationUserError": "TermUserErr",
    "TerminationExecutionError": "TermExecErr",
    "TerminationEarlyAlgorithm": "TermEarlyAlgo",
    "TerminationEarlyUser": "TermEarlyUser",
    "ArrayHashTime": "TArrayHash(s)",
    "ForkTime": "TFork(s)",
    "RelForkTime": "TFork(%)",
    "RelUserTime": "TUser(%)",
}


def last_record(df: DataFrame, run: str = "run", seq: str = "seq") -> DataFrame:
    """The row of the greatest seq per run, by a partial aggregate and not a sort."""
    cols = [c for c in df.columns if c != run]
    return df.groupBy(run).agg(F.max_by(F.struct(*cols), seq).alias("r")).select(run, "r.*")


def run_aggregates(df: DataFrame, run: str = "run") -> DataFrame:
    return df.groupBy(run).agg(F.max("mem").alias("max_mem"), F.avg("mem").alias("avg_mem"), F.max("states").alias("max_states"), F.avg("states").alias("avg_states"))


def with_derived(df: DataFrame) -> DataFrame:
    """Seconds from microseconds, MiB from bytes, instruction and branch coverage, shares of the wall time."""
    have = set(df.columns)
    if "WallTime" in have:
        for c in TIMES:
            if c in have and c != "WallTime":
                df = df.withColumn(f"Rel{c}", 100 * F.try_divide(F.col(c), F.col("WallTime")))
    for c in TIMES:
        if c in have:
            df = df.withColumn(c, F.col(c) / 1_000_000)
    if "MallocUsage" in have:
        df = df.withColumn("MallocUsage", F.col("MallocUsage") / (1 << 20))
    if {"CoveredInstructions", "UncoveredInstructions"} <= have:
        total = F.col("CoveredInstructions") + F.col("UncoveredInstructions")
        df = df.withColumn("ICount", total).withColumn("ICov", 100 * F.try_divide(F.col("CoveredInstructions"), total))
    if {"FullBranches", "PartialBranches", "NumBranches"} <= have:
        df = df.withColumn("BCov", F.when(F.col("NumBranches") == 0, 100.0).otherwise(100 * F.try_divide(2 * F.col("FullBranches") + F.col("PartialBranches"), 2 * F.col("NumBranches"))))
    return df


def select_preset(df: DataFrame, preset: str) -> DataFrame:
    return df if preset == "all" else df.select(*[F.col(f"`{c}`") for c in PRESETS.get(preset, PRESETS["default"]) if c in df.columns])


def select_user(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing or not columns:
        raise ValueError(f"unknown columns: {missing}" if missing else "no columns")
    return df.select(*[F.col(f"`{c}`") for c in columns])


def rename_legend(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({k: v for k, v in LEGEND.items() if k in df.columns})


def order_headers(df: DataFrame) -> DataFrame:
    known = [c for c in LEGEND.values() if c in df.columns]
    return df.select(*[F.col(f"`{c}`") for c in ["Path"] * ("Path" in df.columns) + known + sorted(set(df.columns) - set(known) - {"Path"})])


def union_runs(runs: list[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), runs)


def with_summary(df: DataFrame, key: str, label: str = "Total") -> DataFrame:
    """df and a total row: Avg* and *(%) by sum over rows, nulls counted; Max* by maximum; the rest by sum."""

    def total(c: str) -> Column:
        x = F.col(f"`{c}`")
        if c.startswith("Avg") or c.endswith("(%)"):
            return (F.sum(x) / F.count(F.lit(1))).alias(c)
        return (F.max(x) if c.startswith("Max") else F.sum(x)).alias(c)

    row = df.agg(*[total(c) for c in df.columns if c != key]).withColumn(key, F.lit(label))
    return df.unionByName(row.select(*[F.col(f"`{c}`").cast(df.schema[c].dataType) for c in df.columns]))


def time_buckets(df: DataFrame, interval_us: int, value: str, run: str = "run", limit: int | None = None) -> DataFrame:
    """Mean of value per run and time bucket, the first `limit` buckets of a run where given."""
    out = df.groupBy(run, F.floor(F.col("t_us") / interval_us).cast("bigint").alias("bucket")).agg(F.avg(value).alias("mean"), F.count("*").alias("n"))
    if limit is None:
        return out
    return out.withColumn("_n", F.row_number().over(Window.partitionBy(run).orderBy("bucket"))).filter(F.col("_n") <= limit).drop("_n")


def stats_between(df: DataFrame, t0: int, t1: int) -> DataFrame:
    return df.filter(F.col("t_us").between(t0, t1))


def strip_common_prefix(df: DataFrame, column: str) -> DataFrame:
    """Paths without the leading parts that all share; the shared parts come from the least and the greatest path."""
    ends = df.agg(F.min(F.split(column, "/")).alias("lo"), F.max(F.split(column, "/")).alias("hi"))
    same = F.zip_with("lo", "hi", lambda a, b: a.eqNullSafe(b))
    ends = ends.select(F.coalesce(F.nullif(F.array_position(same, F.lit(False)).cast("int"), F.lit(0)) - 1, F.size("lo") - 1).alias("_k"))
    parts = F.split(column, "/")
    return df.crossJoin(F.broadcast(ends)).withColumn(column, F.array_join(F.slice(parts, F.col("_k") + 1, F.size(parts)), "/")).drop("_k")  # one row


def coverage(events: DataFrame) -> DataFrame:
    """Branches taken both ways, one way and not, from (branch, taken_true, taken_false) visits."""
    each = events.groupBy("branch").agg(F.max(F.col("taken_true").cast("int")).alias("t"), F.max(F.col("taken_false").cast("int")).alias("f"))
    return each.agg(F.count("*").alias("branches"), F.count_if((F.col("t") == 1) & (F.col("f") == 1)).alias("full"), F.count_if(F.col("t") + F.col("f") == 1).alias("partial"))


def deltas(df: DataFrame, run: str, order: list[str], value: str) -> DataFrame:
    w = Window.partitionBy(run).orderBy(*order)
    return df.withColumn("delta", F.col(value) - F.lag(value).over(w))


def since_flag(df: DataFrame, run: str, order: list[str], flag: Column) -> DataFrame:
    """Rows since the last flagged one of the run (0 on it; null before the first)."""
    w = Window.partitionBy(run).orderBy(*order)
    marked = df.withColumn("_island", F.sum(F.when(flag, 1).otherwise(0)).over(w))
    inner = Window.partitionBy(run, "_island").orderBy(*order)
    return marked.withColumn("since", F.when(F.col("_island") > 0, F.row_number().over(inner) - 1)).drop("_island")


def weighted_pick(df: DataFrame, weight: str, key: str, p: float, cells: int = 256) -> DataFrame:
    """The row, by ascending key, whose share of the summed weights holds p in [0, 1).

    Key ranges of about equal size are summed first, so that only one range's rows are put in order.
    """
    cuts = df.stat.approxQuantile(key, [i / cells for i in range(1, cells)], 0.001)
    celled = df.withColumn("_cell", F.size(F.filter(F.array(*[F.lit(c) for c in sorted(set(cuts))]), lambda c: c < F.col(key))) if cuts else F.lit(0))
    sums = celled.groupBy("_cell").agg(F.sum(weight).alias("_w"))  # at most `cells` rows
    upto = Window.orderBy("_cell")
    cell = sums.withColumn("_hi", F.sum("_w").over(upto)).withColumn("_total", F.sum("_w").over(Window.partitionBy())).withColumn("_lo", F.col("_hi") - F.col("_w"))
    chosen = cell.filter((F.col("_hi") > p * F.col("_total")) & (F.col("_lo") <= p * F.col("_total"))).select("_cell", "_lo", "_total")
    own = celled.join(F.broadcast(chosen), "_cell").withColumn("_hi", F.col("_lo") + F.sum(weight).over(Window.partitionBy("_cell").orderBy(key)))
    return own.filter((F.col("_hi") > p * F.col("_total")) & (F.col("_hi") - F.col(weight) <= p * F.col("_total"))).drop("_cell", "_hi", "_lo", "_total")


def count_events(df: DataFrame, kind: str) -> DataFrame:
    return df.groupBy(kind).agg(F.count("*").alias("n"))


def pass_rate(results: DataFrame, samples: int = 5) -> DataFrame:
    """Tests per group and outcome, the first names as samples, and the group's share of passes."""
    by = results.groupBy("grp", "outcome").agg(F.count("*").alias("n"), F.slice(F.array_sort(F.collect_set(F.when(F.col("rank") <= samples, F.col("name")))), 1, samples).alias("samples"), F.count_if("passed").alias("passed"))
    w = Window.partitionBy("grp")
    return by.withColumn("pass_pct", 100 * F.sum("passed").over(w) / F.sum("n").over(w))


def merge_istats(df: DataFrame) -> DataFrame:
    """Per position over all runs: sums, the greatest Icov and the least Iuncov; a position some run lacks is an error there."""
    runs = df.select("run").distinct().count()
    out = df.groupBy("pos").agg(F.sum("I").alias("I"), F.max("Icov").alias("Icov"), F.min("Iuncov").alias("Iuncov"), F.count_distinct("run").alias("_runs"))
    return out.select("pos", "I", "Icov", "Iuncov", F.when(F.col("_runs") == runs, True).otherwise(F.raise_error(F.concat(F.lit("runs differ at "), F.col("pos").cast("string")))).alias("agrees"))


def sum_istats(df: DataFrame) -> DataFrame:
    """Totals per file and event, then their sum, number of files and whole mean."""
    files = df.groupBy("file", "event").agg(F.sum("value").alias("total"))
    return files.groupBy("event").agg(F.sum("total").alias("sum"), F.count("*").alias("files"), F.floor(F.sum("total") / F.count("*")).cast("bigint").alias("mean"))
