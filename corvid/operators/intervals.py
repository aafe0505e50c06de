"""Allocation intervals: lookups of addresses, tables by tiers, and ordered stack reconciliation."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def lookup_interval(probes: DataFrame, intervals: DataFrame, one_past: bool = True, owner: str | None = None, span: int = 1 << 20) -> DataFrame:
    """probes (probe, addr) with base and size of the interval that holds addr, or null.

    The interval of the greatest base at or below addr decides; one_past also accepts its end. Rows are
    carried forward within `span`-sized ranges of addresses (and owners), and each range starts from the
    last base of the ranges before it, so that no one task orders the whole space.
    """
    own = [F.col(owner)] if owner else [F.lit(0)]
    i = intervals.select(own[0].alias("_o"), F.col("base").alias("_at"), F.struct("base", "size").alias("_i"), F.lit(None).cast(probes.schema["probe"].dataType).alias("probe"), F.lit(0).alias("_kind"))
    p = probes.select(own[0].alias("_o"), F.col("addr").alias("_at"), F.lit(None).cast(i.schema["_i"].dataType).alias("_i"), "probe", F.lit(1).alias("_kind"))
    both = i.unionByName(p).withColumn("_range", F.floor(F.col("_at") / span).cast("bigint"))
    ends = both.groupBy("_o", "_range").agg(F.max("_i").alias("_top"))
    carried = ends.withColumn("_from", F.last("_top", ignorenulls=True).over(Window.partitionBy("_o").orderBy("_range").rowsBetween(Window.unboundedPreceding, -1))).drop("_top")
    w = Window.partitionBy("_o", "_range").orderBy("_at", "_kind").rowsBetween(Window.unboundedPreceding, 0)
    seen = both.withColumn("_last", F.last("_i", ignorenulls=True).over(w)).filter("_kind = 1")
    found = seen.join(carried, ["_o", "_range"]).select("probe", F.col("_at").alias("addr"), F.coalesce("_last", "_from").alias("i"))
    end = F.col("i.base") + F.col("i.size")
    hit = F.col("addr") <= end if one_past else F.col("addr") < end
    return found.select("probe", "addr", F.when(hit, F.col("i.base")).alias("base"), F.when(hit, F.col("i.size")).alias("size"))


def lookup_tiered(probes: DataFrame, tiers: dict[str, DataFrame]) -> DataFrame:
    """The first tier, in the given order, that holds each probe."""
    out = probes.select("probe", "addr")
    names = list(tiers)
    for name in names:
        hit = lookup_interval(probes, tiers[name], one_past=True).select("probe", F.col("base").alias(f"_b_{name}"), F.col("size").alias(f"_s_{name}"))
        out = out.join(hit, "probe", "left")
    tier = F.coalesce(*[F.when(F.col(f"_b_{n}").isNotNull(), F.lit(n)) for n in names])
    return out.select("probe", "addr", tier.alias("tier"), F.coalesce(*[F.col(f"_b_{n}") for n in names]).alias("base"), F.coalesce(*[F.col(f"_s_{n}") for n in names]).alias("size"))


def heap_state(events: DataFrame) -> DataFrame:
    """Live allocations after all events (owner, seq, op, base, size): the last event of a base decides."""
    last = events.groupBy("owner", "base").agg(F.max_by(F.struct("op", "size"), "seq").alias("e"))
    return last.filter("e.op = 'alloc'").select("owner", "base", "e.size")


STACK = "owner string, base long, size long, alive boolean"


def reconcile(rows: list[tuple[int, int, str]]) -> list[tuple[int, int, bool]]:
    """Intervals (base, size, alive) after ordered (base, size, op): a new one replaces what it covers and trims what it meets; free marks dead."""
    now: list[tuple[int, int, bool]] = []
    for base, size, op in rows:
        if op == "free":
            now = [(b, s, a and b != base) for b, s, a in now]
            continue
        end, left = base + size, []
        for b, s, a in now:
            e = b + s
            if e <= base or b >= end:
                left.append((b, s, a))
                continue
            if b < base:
                left.append((b, base - b, a))
            if e > end:
                left.append((end, e - end, a))
        now = sorted([*left, (base, size, True)])
    return now


def track_stack(events: DataFrame) -> DataFrame:
    """Stack intervals per owner (a thread) after its ordered events; a thread's stack is bounded by its depth."""

    def run(key: tuple, f: pd.DataFrame) -> pd.DataFrame:
        f = f.sort_values("seq")
        out = reconcile(list(zip(f["base"], f["size"], f["op"], strict=True)))
        return pd.DataFrame([(key[0], b, s, a) for b, s, a in out], columns=["owner", "base", "size", "alive"])

    return events.groupBy("owner").applyInPandas(run, STACK)
