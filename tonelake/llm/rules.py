"""Quality rules: learned decision lists over text statistics, as ordered conditional expressions.

All statistics of a text are columns made by Spark's functions within the row. Labelled rows are reduced
to counts per combination of binned statistics. Sequential covering then learns rules for low quality:
a rule grows by the threshold with the best information gain on the growing rows that are not covered
yet, is cut back to the prefix that is most precise on the pruning rows, and is kept while it is precise
there. The list becomes one CASE expression, in the order in which its rules were learned.

The driver sees counts per statistic and bin. No Python runs on the executors.

Defined results: null is the empty text; a text without words fails the base rules; a repeated row is
judged again; unlabelled or empty tables give an empty list, which keeps all that passes the base rules;
other columns are not read. Texts are read whole.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import WORD, documents, fold, labels, settle, words

#: Fixed values of the base rules.
SYMBOLS, MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = "#*$%&|<>", 20, 30, 8


def text_statistics(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id``, the counts of the base rules, and the counts and shares that rules are learned on."""
    text = F.coalesce(docs[text_col], F.lit(""))
    d = docs.select(docs[id_col].alias("doc_id"), text.alias("text"), words(text).alias("ws"))
    lines = F.filter(F.split("text", "\n", -1), lambda line: line.rlike(WORD))
    starts = F.when(F.size("ws") >= WINDOW, F.sequence(F.lit(1), F.size("ws") - (WINDOW - 1)))
    windows = F.transform(starts, lambda i: F.xxhash64(F.slice("ws", i, WINDOW)))
    stripped = lambda chars: F.length("text") - F.length(F.translate("text", chars, ""))
    d = d.select(
        "doc_id", F.size("ws").cast("long").alias("n_words"),
        F.length(F.regexp_replace("text", r"[\x20\x09-\x0D]+", "")).cast("long").alias("word_chars"),
        stripped(SYMBOLS).cast("long").alias("n_symbols"), stripped("!?").alias("n_marks"), stripped("0123456789").alias("n_digits"),
        stripped("ABCDEFGHIJKLMNOPQRSTUVWXYZÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜ").alias("n_capitals"), F.regexp_count("text", F.lit(r"(?<!\S)(\S+)(?=\s+\1(?!\S))")).alias("n_doubled"),
        lines.alias("lines"), windows.alias("windows"),
    )
    again = F.size("windows") > F.size(F.array_distinct("windows"))
    places = F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.select("*", (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"), F.size("lines").alias("n_lines"), F.when(again, places).alias("sorted"))
    near = F.arrays_zip(F.col("sorted").alias("at"), F.slice("sorted", 2, F.size("sorted")).alias("after"), F.concat(F.array(F.lit(None)), "sorted").alias("before"))
    twice = F.filter(near, lambda x: x["at"].isNotNull() & ((x["at"]["h"] == x["after"]["h"]) | (x["at"]["h"] == x["before"]["h"])))
    d = d.select("*", F.sort_array(F.transform(twice, lambda x: x["at"]["i"])).alias("hits"))
    gaps = F.arrays_zip(F.col("hits").alias("a"), F.slice("hits", 2, F.greatest(F.size("hits"), F.lit(1))).alias("b"))
    covered = F.aggregate(gaps, F.lit(0), lambda n, g: n + F.coalesce(F.least(g["b"] - g["a"], F.lit(WINDOW)), F.lit(WINDOW)))
    d = d.select("*", F.coalesce(covered, F.lit(0)).cast("long").alias("n_repeat_words")).drop("lines", "windows", "sorted", "hits")
    share = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1))).cast("double")
    return d.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        share("n_symbols", "word_chars").alias("symbol_share"),
        share("n_marks", "word_chars").alias("mark_share"), share("n_digits", "word_chars").alias("digit_share"),
        share("n_capitals", "word_chars").alias("capital_share"),
        share("n_doubled", "n_words").alias("doubled_share"), share("n_dup_lines", "n_lines").alias("dup_line_share"),
        share("n_repeat_words", "n_words").alias("repeat_share"),
    )


#: Shares only: word and line lengths tell languages and layouts apart rather than quality.
FEATURES = ["symbol_share", "mark_share", "digit_share", "capital_share", "doubled_share", "dup_line_share", "repeat_share"]


@dataclass(frozen=True)
class Condition:
    feature: str
    above: bool
    cut: float

    def column(self) -> Column:
        return F.col(self.feature) > self.cut if self.above else F.col(self.feature) <= self.cut


@dataclass
class DecisionList:
    """Rules for low quality, each a conjunction; what none of them meets is of good quality."""

    rules: list[list[Condition]] = field(default_factory=list)

    def verdict(self) -> Column:
        """True for good quality, as one ordered conditional expression."""
        case = None
        for rule in self.rules:
            test = reduce(lambda a, b: a & b, [c.column() for c in rule])
            case = F.when(test, False) if case is None else case.when(test, False)
        return F.lit(True) if case is None else case.otherwise(True)

    def text(self) -> str:
        return "\n".join(f"{i}. " + " and ".join(f"{c.feature} {'>' if c.above else '<='} {c.cut:.4g}" for c in rule) for i, rule in enumerate(self.rules, 1))


def _gain(p: int, n: int, p0: int, n0: int) -> float:
    return p * (math.log2(p / (p + n)) - math.log2(p0 / (p0 + n0))) if p else 0.0


def learn_rules(rows: DataFrame, features: list[str] = FEATURES, bins: int = 32, max_rules: int = 8, max_conditions: int = 3, min_precision: float = 0.9, min_share: float = 0.002) -> DecisionList:
    """Learn from ``rows``: the features, ``bad`` (1 is low quality) and ``pruning`` (true for pruning rows).

    A rule must be right for ``min_precision`` of the pruning rows it meets and meet ``min_share`` of the
    low-quality rows.
    """
    # Quantiles of either class, so that a rare class has as many cuts as the other.
    ranks = [i / bins for i in range(bins)]
    quantiles = rows.select([F.percentile_approx(F.when(F.col("bad") == k, F.col(f)), ranks, 10000).alias(f"{f}{k}") for f in features for k in (0, 1)]).first()
    cuts = {f: sorted({*(quantiles[f"{f}0"] or []), *(quantiles[f"{f}1"] or [])}) for f in features}
    def bin_of(f: str) -> Column:
        return F.size(F.filter(F.array(*map(F.lit, cuts[f])), lambda c: c < F.col(f))) if cuts[f] else F.lit(0)

    sums = [F.sum("bad").alias("p"), F.sum(1 - F.col("bad")).alias("n")]
    cube = settle(rows.select(*[bin_of(f).alias(f) for f in features], "bad", "pruning").groupBy(*features, "pruning").agg(*sums), "rule-counts")
    total = {r["pruning"]: (r["p"], r["n"]) for r in cube.groupBy("pruning").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect()}
    if False not in total or not total[False][0] or not total[False][1]:
        return DecisionList()

    def binned(c: Condition) -> Column:
        # A value above cut k lies in a bin above k, as a bin counts the cuts below the value.
        k = cuts[c.feature].index(c.cut)
        return F.col(c.feature) > k if c.above else F.col(c.feature) <= k

    def meets(rule: list[Condition]) -> Column:
        return reduce(lambda a, b: a & b, [binned(c) for c in rule], F.lit(True))

    found = DecisionList()
    left = F.lit(True)
    entries = F.explode(F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).alias("bin")) for f in features])).alias("e")
    for _ in range(max_rules):
        rule: list[Condition] = []
        p0 = n0 = None
        while len(rule) < max_conditions:
            inside = cube.filter(~F.col("pruning") & left & meets(rule)).select(entries, "p", "n")
            counts: dict[str, dict[int, tuple[int, int]]] = {f: {} for f in features}
            for r in inside.groupBy("e").agg(F.sum("p").alias("p"), F.sum("n").alias("n")).collect():
                counts[r["e"]["feature"]][r["e"]["bin"]] = (r["p"], r["n"])
            p0, n0 = (sum(v[i] for v in counts[features[0]].values()) for i in (0, 1))
            if not p0 or not n0:
                break
            best, chosen = 1e-9, None
            for f in features:
                p = n = 0
                for k, cut in enumerate(cuts[f]):
                    p, n = p + counts[f].get(k, (0, 0))[0], n + counts[f].get(k, (0, 0))[1]
                    for above, (a, b) in ((False, (p, n)), (True, (p0 - p, n0 - n))):
                        gain = _gain(a, b, p0, n0)
                        if gain > best and a + b < p0 + n0:
                            best, chosen = gain, Condition(f, above, cut)
            if chosen is None:
                break
            rule.append(chosen)
        if not rule:
            break
        checks = [F.sum(F.when(meets(rule[: k + 1]), F.col(c)).otherwise(0)).alias(f"{c}{k}") for k in range(len(rule)) for c in ("p", "n")]
        seen = cube.filter(F.col("pruning") & left).agg(*checks).first()
        met = [(seen[f"p{k}"] or 0, seen[f"n{k}"] or 0) for k in range(len(rule))]
        best = max(range(len(rule)), key=lambda k: ((met[k][0] + 1) / (met[k][0] + met[k][1] + 2), met[k][0]))
        p, n = met[best]
        if not p or p < min_precision * (p + n) or p < min_share * total.get(True, (0, 0))[0]:
            break
        found.rules.append(rule[: best + 1])
        left = left & ~meets(found.rules[-1])
    return _centred(found, rows)


def _centred(found: DecisionList, rows: DataFrame) -> DecisionList:
    """The same list with every cut moved halfway to the next value of ``rows``: they decide alike, others by the nearer side."""
    flat = [c for rule in found.rules for c in rule]
    if not flat:
        return found
    above = rows.agg(*[F.min(F.when(F.col(c.feature) > c.cut, F.col(c.feature))).alias(str(i)) for i, c in enumerate(flat)]).first()
    moved = iter(Condition(c.feature, c.above, (c.cut + (above[i] if above[i] is not None else c.cut)) / 2) for i, c in enumerate(flat))
    return DecisionList([[next(moved) for _ in rule] for rule in found.rules])


def learn_quality_rules(stats: DataFrame, marked: DataFrame, **limits) -> DecisionList:
    """Rules from all labelled documents but those of fold 0; fold 1 prunes. Of several labels the worst counts."""
    worst = marked.filter("quality IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = stats.join(worst, "doc_id").filter(fold(F.col("doc_id")) != 0)
    rows = rows.select(*FEATURES, (F.col("quality") == 0).cast("long").alias("bad"), (fold(F.col("doc_id")) == 1).alias("pruning"))
    return learn_rules(rows, **limits)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = settle(text_statistics(documents(spark, sf_dir)), "text-statistics")
    rules = learn_quality_rules(stats, labels(spark, sf_dir))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return stats.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", failed.alias("base_failed"), (~failed & rules.verdict()).alias("kept"))
