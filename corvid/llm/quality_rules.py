"""Quality rules as a short-circuit cascade of column expressions.

Each rule's cost and share of rejections is measured on a bounded sample: the least of several runs over
cached rows, less that of a run without the rule. The cascade tries the rules by rejections per cost, and
a CASE expression leaves the rules after the first rejection unevaluated. The order changes the work and
`failed_rule`, never the verdict. report() returns the counts of REPORTED for every document, so that
these are computed first; what the other rules need is computed inside the cascade, as far as it goes.

Words are `[^\x20\x09-\x0D]+`. Defined cases: null or empty text has no words and fails `too_short`;
repeated rows and ids are judged each on its own; columns other than doc_id and text are ignored; an
empty table gives an empty result.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Words of a window in n_repeat_words.
WINDOW = 5


def _text() -> Column:
    return F.coalesce(F.col("text"), F.lit(""))


def _words() -> Column:
    return F.regexp_extract_all(_text(), F.lit("[^\\x20\\x09-\\x0D]+"), F.lit(0))


def _lines() -> Column:
    return F.filter(F.split(_text(), "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]"))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: lambda bodies would compute it again for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _repeated_words(words: Column) -> Column:
    """Words covered by windows that occur twice or more in the text."""

    def covered(pairs: Column) -> Column:
        same = F.filter(pairs, lambda x, k: x["g"].eqNullSafe(F.get(pairs, k - 1)["g"]) | x["g"].eqNullSafe(F.get(pairs, k + 1)["g"]))
        starts = F.array_sort(F.transform(same, lambda x: x["i"]))
        none = F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last"))
        return F.aggregate(starts, none, lambda a, s: F.struct((a["n"] + F.least(F.lit(WINDOW), s - a["last"])).alias("n"), s.alias("last")), lambda a: a["n"])

    def over(w: Column) -> Column:
        grams = F.transform(F.sequence(F.lit(1), F.size(w) - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(w, i, F.lit(WINDOW))))
        rank = lambda g: _bound(F.array_sort(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i")))), covered)
        return F.when(F.size(w) <= WINDOW, 0).otherwise(_bound(grams, lambda g: F.when(F.size(F.array_distinct(g)) == F.size(g), 0).otherwise(rank(g))))

    return _bound(words, over).cast("long")


#: Counts by name: each of the text, or of the words where they are at hand.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda w: F.size(w).cast("long"),
    "word_chars": lambda w: F.length(F.array_join(w, "")).cast("long"),
    "n_symbols": lambda w: F.regexp_count(_text(), F.lit("[#*$%&|<>]")).cast("long"),
    "n_lines": lambda w: F.size(_lines()).cast("long"),
    "n_dup_lines": lambda w: _bound(_lines(), lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"),
    "n_repeat_words": _repeated_words,
    "n_lettered": lambda w: F.size(F.filter(w, lambda x: x.rlike("\\p{L}"))).cast("long"),
    "n_distinct": lambda w: F.size(F.array_distinct(w)).cast("long"),
}
#: Counts that report() returns for every document.
REPORTED = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


@dataclass(frozen=True)
class Rule:
    """rejects: from a function that gives a count by its name, to the condition of a rejection."""

    name: str
    rejects: Callable[[Callable[[str], Column]], Column]


#: too_short and repetitive are the base rules.
BASE = (
    Rule("too_short", lambda c: c("n_words") < 10),
    Rule("repetitive", lambda c: 100 * c("n_repeat_words") > 20 * c("n_words")),
)
RULES = (
    *BASE,
    Rule("symbols", lambda c: 10 * c("n_symbols") > c("n_words")),
    Rule("duplicate_lines", lambda c: 10 * c("n_dup_lines") > 3 * c("n_lines")),
    Rule("few_letters", lambda c: 10 * c("n_lettered") < 6 * c("n_words")),
    Rule("monotonous", lambda c: (c("n_words") >= 50) & (c("n_distinct") < 10)),
    Rule("word_length", lambda c: (c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 15 * c("n_words"))),
)


def measured(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000, runs: int = 3) -> list[tuple[Rule, float, float]]:
    """(rule, seconds, share rejected) on sample_rows documents, best first by rejections per second.

    seconds: the least of `runs` runs, less that of a run which only reads the rows, and at least a hundredth of it.
    """
    sample = docs.select("text").limit(sample_rows).cache()
    n = max(1, sample.count())

    def least(condition: Column) -> tuple[float, int]:
        job, best = sample.agg(F.count_if(condition)), float("inf")
        for _ in range(runs):
            began = time.perf_counter()
            hits = job.first()[0]
            best = min(best, time.perf_counter() - began)
        return best, hits

    bare, _ = least(F.octet_length(_text()) < 0)
    found = []
    for rule in rules:
        seconds, hits = least(rule.rejects(lambda c: COUNTS[c](_words())))
        found.append((rule, max(seconds - bare, bare / 100), hits / n))
    sample.unpersist()
    return sorted(found, key=lambda x: (-x[2] / x[1], x[1]))


def ordered(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> list[Rule]:
    return [rule for rule, _, _ in measured(docs, rules, sample_rows)]


def first_failure(rules: Sequence[Rule], count: Callable[[str], Column]) -> Column:
    """Name of the first rule that rejects, or null; later rules are not evaluated then."""
    verdict = None
    for rule in rules:
        verdict = (F.when if verdict is None else verdict.when)(rule.rejects(count), F.lit(rule.name))
    return F.lit(None).cast("string") if verdict is None else verdict


def cascade(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """docs with failed_rule (null: kept), which replaces a column of that name. Counts are computed inside the cascade, as far as it goes."""
    return docs.withColumn("failed_rule", first_failure(ordered(docs, rules, sample_rows), lambda c: COUNTS[c](_words())))


def report(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 1000) -> DataFrame:
    """doc_id, the counts of REPORTED, base_failed, failed_rule and kept of every document."""
    order = ordered(docs, rules, sample_rows)
    counted = docs.select("doc_id", "text", _words().alias("_w")).select("doc_id", "text", "_w", *[COUNTS[name](F.col("_w")).alias(name) for name in REPORTED])
    base = first_failure(BASE, F.col).isNotNull()
    lazily = lambda c: F.col(c) if c in REPORTED else COUNTS[c](F.col("_w"))
    judged = counted.withColumn("base_failed", base).withColumn("failed_rule", first_failure(order, lazily))
    return judged.withColumn("kept", ~F.col("base_failed") & F.col("failed_rule").isNull()).drop("text", "_w")
