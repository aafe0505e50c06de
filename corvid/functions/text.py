"""Scalar text functions of the triage and reporting queries."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def extract_version(c: Column) -> Column:
    """The first dotted version number, or null."""
    return F.nullif(F.regexp_extract(c, r"\d+\.\d+(?:\.\d+)*", 0), F.lit(""))


def cpe_string(name: Column, version: Column) -> Column:
    return F.concat(F.lit("cpe:2.3:a:*:"), F.split_part(name, F.lit(":"), F.lit(1)), F.lit(":"), version)


def cwe_number(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"^(?:CWE-)?(\d+)$", 1), F.lit(""))


def split_location(c: Column) -> Column:
    """file and function of `file:function`; null for N/A or any other form."""
    parts = F.split(c, ":")
    return F.when((c != "N/A") & (F.size(parts) == 2), F.struct(F.get(parts, F.lit(0)).alias("file"), F.get(parts, F.lit(1)).alias("function")))


def parse_id(c: Column) -> Column:
    """mid and nid of `(m,n)`, brackets and blanks optional; null where anything else is left."""
    pattern = r"^\s*\(?\s*(\d{1,10})\s*,\s*(\d{1,10})\s*\)?\s*$"
    return F.when(c.rlike(pattern), F.struct(F.regexp_extract(c, pattern, 1).cast("bigint").alias("mid"), F.regexp_extract(c, pattern, 2).cast("bigint").alias("nid")))


def safe_text(c: Column) -> Column:
    return F.regexp_replace(c, r"[^\x20-\x7E]", ".")


def escape_text(c: Column) -> Column:
    """Printable ASCII as it is; every other byte as \\xHH."""
    pairs = F.regexp_extract_all(F.hex(c), F.lit("(..)"), F.lit(1))
    code = lambda h: F.conv(h, 16, 10).cast("int")
    return F.array_join(F.transform(pairs, lambda h: F.when(code(h).between(32, 126), F.char(code(h))).otherwise(F.concat(F.lit("\\x"), h))), "")


def function_name(line: Column, pattern: str = r"^\s*(?:[\w*]+\s+)+\**(\w+)\s*\([^;]*$") -> Column:
    return F.nullif(F.regexp_extract(line, pattern, 1), F.lit(""))


def node_label(demangled: Column, name: Column, idx: Column) -> Column:
    """The demangled name, else the name, else a non-zero index, else nothing."""
    return F.coalesce(F.nullif(demangled, F.lit("")), F.nullif(name, F.lit("")), F.nullif(idx, F.lit(0)).cast("string"), F.lit(""))


def name_matches(raw: Column, demangled: Column, target: Column) -> Column:
    """An empty target matches all, ^x$ exactly, anything else as a part, on either name."""
    exact = F.regexp_extract(target, r"^\^(.*)\$$", 1)
    is_exact = target.rlike(r"^\^.*\$$")
    return F.when(target == "", True).when(is_exact, (raw == exact) | (demangled == exact)).otherwise(F.contains(raw, target) | F.contains(demangled, target))


def skip_reason(name: Column, patterns: list[str]) -> Column:
    return F.coalesce(*[F.when(F.contains(name, F.lit(p)), F.lit(p)) for p in patterns], F.lit(None).cast("string"))


def render_object(data: Column) -> Column:
    """hex, text and little-endian numbers of a byte string; numbers for 1, 2, 4 and 8 bytes."""
    rev = F.array_join(F.reverse(F.regexp_extract_all(F.hex(data), F.lit("(..)"), F.lit(1))), "")
    n = F.octet_length(data)
    unsigned = F.when(n.isin(1, 2, 4, 8), F.conv(rev, 16, 10).cast("decimal(20,0)"))
    half, full = F.pow(F.lit(2.0), 8 * n - 1).cast("decimal(20,0)"), F.pow(F.lit(2.0), 8 * n).cast("decimal(20,0)")
    trimmed = F.regexp_replace(F.hex(data), "(00)+$", "")
    return F.struct(F.lower(F.hex(data)).alias("hex"), safe_text(F.decode(data, "ISO-8859-1")).alias("text"), unsigned.alias("uint"), F.when(unsigned >= half, unsigned - full).otherwise(unsigned).cast("decimal(21,0)").alias("int"), F.lower(trimmed).alias("trimmed_hex"))


def parse_span_us(c: Column) -> Column:
    """Microseconds of plain seconds or of parts like 1h30min; null for anything else."""
    units = {"h": 3_600_000_000, "min": 60_000_000, "s": 1_000_000, "ms": 1_000, "us": 1}
    part = lambda u: F.coalesce(F.nullif(F.regexp_extract(c, rf"(?:^|[a-z])(\d+){u}(?![a-z])", 1), F.lit("")).cast("bigint"), F.lit(0))
    total = sum((part(u) * us for u, us in units.items()), F.lit(0).cast("bigint"))
    return F.when(c.rlike(r"^\d+(\.\d+)?$"), F.round(c.cast("double") * 1_000_000).cast("bigint")).when(c.rlike(r"^(\d+h)?(\d+min)?(\d+s)?(\d+ms)?(\d+us)?$") & (c != ""), total)


def to_hms(us: Column) -> Column:
    s = F.floor(us / 1_000_000).cast("bigint")
    return F.struct(F.floor(s / 3600).cast("bigint").alias("h"), (F.floor(s / 60) % 60).cast("bigint").alias("m"), (s % 60).alias("s"))


def pct(a: Column, b: Column) -> Column:
    return 100 * F.try_divide(a, b)


def search_weight(kind: str, depth: Column, n: Column, cost: Column, distance: Column) -> Column:
    """Weight of a state by search kind; costs count as 0.1 at least, distances as 1."""
    inverse = 1 / F.greatest(distance.cast("double"), F.lit(1.0))
    return {"depth": depth.cast("double"), "random_path": F.pow(F.lit(0.5), depth), "query_cost": 1 / F.greatest(cost, F.lit(0.1)), "inst_count": 1 / F.greatest(n.cast("double"), F.lit(1.0)), "callpath_count": 1 / F.greatest(n.cast("double"), F.lit(1.0)), "min_dist": inverse * inverse, "covering_new": inverse * inverse}[kind]


def version_in_range(range_: Column, version: Column) -> Column:
    """Whether a dotted number is in `vers:generic/>=a|<b`: every bound must hold; a plain number or * is allowed."""

    def key(v: Column) -> Column:
        return F.transform(F.regexp_extract_all(v, F.lit(r"(\d+)"), F.lit(1)), lambda x: x.cast("bigint"))

    def holds(bound: Column) -> Column:
        op, want = F.regexp_extract(bound, r"^(>=|<=|!=|>|<|=)?", 1), key(F.regexp_replace(bound, r"^(>=|<=|!=|>|<|=)", ""))
        have = key(version)
        return F.when(bound == "*", True).when(op == ">=", have >= want).when(op == "<=", have <= want).when(op == ">", have > want).when(op == "<", have < want).when(op == "!=", have != want).otherwise(have == want)

    return F.forall(F.split(F.regexp_replace(range_, r"^vers:[^/]*/", ""), r"\|"), holds)


#: Remediation strategies; any other name means CONTINUE.
STRATEGIES = ("EXIT", "RECOVER", "SAT", "WRAP", "WIDEN", "CONTINUE", "NONE")


def strategy(c: Column) -> Column:
    u = F.upper(c)
    return F.when(u.isin(*STRATEGIES), u).otherwise("CONTINUE")
