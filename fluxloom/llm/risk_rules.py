"""Quality rules with controlled risk, in DataFrame operations only.

Base facts of a text come from its words (`common.WORD`) and lines. A rule is a ratio of such facts with an upper or
lower cutoff. Cutoffs are not guessed: a fixed path of settings, each a cutoff for every rule, goes from loose to strict,
and in every stratum (the language) the labelled good documents judge the settings. A setting that k of n good documents
fail is safe if

    P(Binomial(n, risk) <= k) <= delta / families,

the exact (Clopper-Pearson) test of "it falsely rejects more than ``risk`` of the good documents", by all rules together.
No rule gets looser along the path, so k never falls and the safe settings come first: such a fixed sequence needs no
correction. The strictest safe one is used.

A stratum with so few good labels that no setting could pass, even if none failed, has no test of its own. All such
strata are pooled into one family, and so are strata without labels: their setting is the strictest one that is safe for
their good documents together. Which strata are pooled depends on the numbers of labels only, not on what the rules find.
``families`` is the number of strata with a test of their own, and one for the pool (Bonferroni), so with probability
1 - delta all chosen settings keep the promise at once. Where no setting is safe, the base rules judge alone.

Facts are counted in one pass over the texts and written (a few numbers per row). The labelled rows are joined once; counts per stratum and setting are aggregated before they are shuffled, and
only one row per family comes back. Repeated words and lines are found inside a row, by sorting the row's own
hashes: no word is shuffled.

A null or empty text has no words: all counts are 0 and it fails the base rules. Ratios of texts without words are
0, and no rule rejects them. Repeated rows and labels: every row is judged alone; a repeated label counts as often as
it is joined. Empty labels: only base rules. Columns of the input cannot clash, only id, text and stratum are read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxloom.llm.common import SPACE, WORD
from fluxloom.session import settle

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
SYMBOLS = "#*$%&|<>"


@dataclass(frozen=True)
class Rule:
    """Rejects where ratio * sign > cutoff * sign; the grid holds the cutoffs of the path's settings, strictest first. A
    rule with a shorter grid keeps its loosest cutoff in the settings beyond."""

    name: str
    top: str
    bottom: str
    sign: int
    grid: tuple[float, ...]


# The path of settings, strictest first. It is fixed before any label is seen, as the test demands.
RULES = (
    Rule("symbols", "n_symbols", "word_chars", 1, (0.02, 0.04, 0.06, 0.08, 0.1, 0.15, 0.2)),
    Rule("shouting", "n_marks", "n_words", 1, (0.1, 0.2, 0.3, 0.4, 0.5, 0.75)),
    Rule("repeats", "n_repeat_words", "n_words", 1, (0.1, 0.15, 0.2, 0.25, 0.3, 0.4)),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", 1, (0.1, 0.2, 0.3, 0.4, 0.5)),
    Rule("long_words", "word_chars", "n_words", 1, (8.0, 9.0, 10.0, 12.0, 15.0, 20.0)),
)


@dataclass(frozen=True)
class Risk:
    total_risk: float = 0.02
    delta: float = 0.05
    rules: tuple[Rule, ...] = RULES


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once: inside a lambda a plain expression would be computed per element."""
    return F.transform(F.array(value), body)[0]


def _repeat_words(words: Column) -> Column:
    """Words in windows of three that occur twice or more in the list, the first occurrence included."""
    n = F.size(words)
    windows = F.transform(
        F.slice(words, 1, F.greatest(n - 2, F.lit(0))),
        lambda word, i: F.struct(F.xxhash64(word, F.get(words, i + 1), F.get(words, i + 2)).alias("h"), i.alias("i")))

    def repeated(ordered: Column) -> Column:
        return F.transform(
            F.filter(ordered, lambda w, k: (F.get(ordered, k - 1)["h"] == w["h"]) | (F.get(ordered, k + 1)["h"] == w["h"])),
            lambda w: w["i"])

    def covered(starts: Column) -> Column:
        """Each window covers three words from its start, but for those the next window covers too."""
        own = F.transform(starts, lambda s, k: F.least(F.lit(3), F.coalesce(F.get(starts, k + 1) - s, F.lit(3))))
        return F.aggregate(own, F.lit(0).cast("bigint"), lambda total, c: total + c)

    found = _let(F.array_sort(windows), repeated)
    return F.when(n < 4, F.lit(0).cast("bigint")).otherwise(_let(F.array_sort(found), covered))


def facts(docs: DataFrame, key: str = "doc_id", text: str = "text", stratum: str = "lang") -> DataFrame:
    """Counts of every text; null counts as empty."""
    plain = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(F.col(key).alias("key"), F.col(stratum).alias("stratum"), plain.alias("text"))
    trimmed = F.regexp_replace("text", rf"^{SPACE}|{SPACE}\z", "")

    def counted(words: Column) -> Column:
        return F.struct(
            F.size(words).cast("bigint").alias("n_words"),
            F.aggregate(words, F.lit(0).cast("bigint"), lambda total, w: total + F.length(w)).alias("word_chars"),
            _repeat_words(words).alias("n_repeat_words"))

    def lined(lines: Column) -> Column:
        return F.struct(
            F.size(lines).cast("bigint").alias("n_lines"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint").alias("n_dup_lines"))

    words = F.when(F.length(trimmed) > 0, F.split(trimmed, SPACE)).otherwise(F.array().cast("array<string>"))
    lines = F.filter(F.split("text", "\n"), lambda line: line.rlike(WORD))
    length = F.length("text")
    return rows.select(
        "key", "stratum", _let(words, counted).alias("w"), _let(lines, lined).alias("l"),
        (length - F.length(F.translate("text", SYMBOLS, ""))).cast("bigint").alias("n_symbols"),
        (length - F.length(F.translate("text", "!", ""))).cast("bigint").alias("n_marks"),
    ).select("key", "stratum", "w.*", "n_symbols", "n_marks", "l.*")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))


def ratio(rule: Rule) -> Column:
    return F.when(F.col(rule.bottom) > 0, F.col(rule.top) / F.col(rule.bottom)).otherwise(F.lit(0.0))


def _tail(n: Column, k: Column, risk: float) -> Column:
    """P(Binomial(n, risk) <= k), term by term in logarithms."""
    odds = F.lit(risk / (1 - risk))
    start = F.struct((n * F.log(F.lit(1 - risk))).alias("log"), F.exp(n * F.log(F.lit(1 - risk))).alias("sum"))

    def add(state: Column, i: Column) -> Column:
        step = state["log"] + F.log((n - i + 1) / i * odds)
        return F.struct(step.alias("log"), (state["sum"] + F.exp(step)).alias("sum"))

    return F.aggregate(F.when(k > 0, F.sequence(F.lit(1).cast("bigint"), k)).otherwise(F.array().cast("array<bigint>")),
                       start, add, lambda state: state["sum"])


def settings(rules: tuple[Rule, ...]) -> list[list[float]]:
    """The cutoffs of all rules at every step of the path, strictest first."""
    return [[rule.grid[min(step, len(rule.grid) - 1)] for rule in rules] for step in range(max(len(rule.grid) for rule in rules))]


def enough(risk: Risk, families: int) -> int:
    """The least number of good labels that can pass a test, if no document fails."""
    return math.ceil(math.log(risk.delta / families) / math.log(1 - risk.total_risk))


def breaks(rule: Rule, cutoff: float | Column) -> Column:
    return ratio(rule) * rule.sign > F.lit(cutoff) * rule.sign


def cutoffs(counted: DataFrame, labels: DataFrame, risk: Risk = Risk(), key: str = "doc_id",
            label: str = "quality") -> DataFrame:
    """The setting of every family, as an array ``cutoffs`` in order of rules (nulls: none is safe): one row per ``stratum``
    with a test of its own, and a row with ``pooled`` true for all others together, if any of them has labels."""
    good = labels.filter(F.col(label) == 1).select(F.col(key).alias("labelled"))
    held = counted.join(good, F.col("key") == F.col("labelled")).filter(~base_failed())
    path = settings(risk.rules)
    failing = [F.sum(reduce(Column.__or__, map(breaks, risk.rules, step)).cast("bigint")).alias(f"k{i}")
               for i, step in enumerate(path)]
    judged = settle(held.groupBy("stratum").agg(F.count(F.lit(1)).alias("n"), *failing), "strata")
    own = F.col("n") >= enough(risk, judged.count() + 1)
    families = judged.groupBy(F.when(own, F.col("stratum")).alias("stratum"), (~own).alias("pooled")).agg(
        *[F.sum(c).alias(c) for c in ("n", *(f"k{i}" for i in range(len(path))))])
    families = settle(families, "families")
    level = risk.delta / max(1, families.count())
    safe = [F.when(_tail(F.col("n"), F.col(f"k{i}"), risk.total_risk) <= level, F.array(*map(F.lit, step)))
            for i, step in enumerate(path)]
    none = F.array(*[F.lit(None).cast("double") for _ in risk.rules])
    return families.select("stratum", "pooled", "n", F.coalesce(*safe, none).alias("cutoffs"))


def judge(docs: DataFrame, labels: DataFrame, risk: Risk = Risk(), key: str = "doc_id", text: str = "text",
          stratum: str = "lang", label: str = "quality") -> DataFrame:
    """Facts of every document, whether the base rules or its family's setting reject it, and the rules that do."""
    counted = settle(facts(docs, key, text, stratum), "facts")
    chosen = settle(cutoffs(counted, labels, risk, key, label), "settings")
    pool = chosen.filter("pooled").first()  # one row at most
    others = F.array(*[F.lit(c).cast("double") for c in (pool["cutoffs"] if pool else [None] * len(risk.rules))])
    own = chosen.filter("not pooled").select(F.col("stratum").alias("of"), "cutoffs")
    judged = counted.join(own, F.col("stratum").eqNullSafe(F.col("of")), "left").withColumn(
        "cutoffs", F.coalesce("cutoffs", others))
    broken = F.array_compact(F.array(*[
        F.when(breaks(rule, F.col("cutoffs")[i]), F.lit(rule.name)) for i, rule in enumerate(risk.rules)]))
    return (judged.withColumn("base_failed", base_failed()).withColumn("rules", broken)
            .withColumn("kept", ~F.col("base_failed") & (F.size("rules") == 0)).drop("of", "cutoffs"))
