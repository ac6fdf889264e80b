"""Personal data: candidate gradient boosting over spans of fixed formats and of wide generators.

Fixed formats give the base spans, which always stay. Generators of high recall propose more spans, which
may overlap. A candidate that covers a base span of its kind, or nearly so, is a positive example; one
that fails its kind's checks is a negative one; one that passes them in another form is left open, and
only scored. Boosted trees learn from the candidate's format and its context; each kind's
threshold is set on candidates kept apart, where the accepted ones are right at the target precision.
The trees become conditional expressions, so scoring is a projection.

Spans are made, scored and selected within a row by Spark's functions: no shuffle but for the counts of
like candidates, from which trees and thresholds are learned. No Python runs on the executors.

Defined results: null is the empty text; a repeated row is searched again; without candidates, or with
those of one class only, no spans are added; an empty table gives an empty table; other columns are not
read. Offsets count code points. Texts are searched whole; quantifiers are possessive, so no text
makes a pattern run long or deep.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.numbers import let
from tonelake.llm.common import documents, settle

KINDS = ["email", "ip", "card", "phone"]
#: Fixed formats. \G: a match may begin where the last one ended, else only where a run begins.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
NEEDS = {"email": "@", "ip": "[0-9]\\.[0-9]", "card": "[0-9][\\x20-]?[0-9]", "phone": "\\+[0-9]"}
#: Generators: pattern, and what a text needs for it.
WIDE = {
    "mail": (r"(?<!\S)[^\s@<>()\[\]]{1,64}+\s?(?:@|\(at\)|\[at\])\s?[^\s@<>()\[\]]{1,255}+", r"@|\(at\)|\[at\]"),
    "number": (r"(?<![0-9])[+(]?[0-9](?:[\x20().\-/]{0,2}[0-9]){6,}+", r"[0-9]"),
    "dotted": (r"(?<![0-9.:])[0-9]{1,6}+(?:[.:][0-9]{1,6}+){2,}+", r"[0-9][.:][0-9]"),
}
#: Words near a span that speak for a kind.
NEAR = {"mail": r"mail|contact|write|schreib|escrib|courriel|correo", "number": r"phone|tel|call|fax|mobil|whatsapp|numero|nummer", "card": r"card|visa|master|credit|karte|carte|tarjeta|iban|account", "dotted": r"\bip\b|server|host|address|login"}
FEATURES = ["length", "digits", "digit_share", "letters", "groups", "dots", "at", "plus", "luhn", "octets", "domain", "touches", "is_mail", "is_number", "is_dotted", *[f"near_{k}" for k in NEAR]]


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes the checksum."""
    value = F.transform(F.split(F.reverse(digits), ""), lambda c, i: F.when(c == "", 0).otherwise(F.when(i % 2 == 0, F.ascii(c) - 48).otherwise(2 * (F.ascii(c) - 48) - F.when(F.ascii(c) > 52, 9).otherwise(0))))
    return F.aggregate(value, F.lit(0), lambda a, v: a + v) % 10 == 0


def only_digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def octets(s: Column) -> Column:
    return F.forall(F.split(s, "[.:]"), lambda p: p.cast("double") <= 255)


MATCH = "array<struct<start:int,end:int,s:string,before:string,after:string>>"


def matches(text: Column, pattern: str, needs: str) -> Column:
    """The non-overlapping matches of a pattern, leftmost first: start, end, string, what is before (with the last match, 24 at most) and after it.

    Splitting at the matches gives the gaps between them, so places are sums of lengths, whatever
    conditions the pattern sets on what surrounds it.
    """
    both = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.split(text, pattern, -1).alias("gap"))
    sizes = lambda p: sums_before(F.transform(p["m"], lambda m, i: F.length(F.get(p["gap"], i)) + F.length(m)))

    def spans(p: Column) -> Column:
        def one(m: Column, i: Column) -> Column:
            gap = F.get(p["gap"], i)
            start = F.get(p["at"], i) + F.length(gap)
            before = F.right(F.concat(F.coalesce(F.get(p["m"], i - 1), F.lit("")), gap), F.lit(24))
            return F.struct(start.alias("start"), (start + F.length(m)).alias("end"), m.alias("s"), before.alias("before"), F.left(F.get(p["gap"], i + 1), F.lit(1)).alias("after"))

        return F.transform(p["m"], one)

    found = let(let(both, lambda p: F.struct(p["m"].alias("m"), p["gap"].alias("gap"), sizes(p).alias("at"))), spans)
    return F.when(F.contains(text, F.lit(needs)) if needs == "@" else text.rlike(needs), found).otherwise(F.array()).cast(MATCH)


def sums_before(values: Column, block: int = 256) -> Column:
    """For each element of an array of integers the sum of those before it; blocks keep the growing lists short."""
    start = F.struct(F.lit(0).alias("sum"), F.array().cast("array<int>").alias("out"))
    run = lambda of, size: F.aggregate(of, start, lambda a, x: F.struct((a["sum"] + size(x)).alias("sum"), F.concat(a["out"], F.array(a["sum"])).alias("out")))
    cut = lambda v: F.transform(F.sequence(F.lit(0), F.floor(F.size(v) / block).cast("int")), lambda b: run(F.slice(v, b * block + 1, block), lambda x: x))
    whole = lambda parts: F.flatten(F.zip_with(parts, run(parts, lambda x: x["sum"])["out"], lambda w, s: F.transform(w["out"], lambda x: x + s)))
    return let(let(values, cut), whole)


def ends_after(spans: Column, x: Column) -> Column:
    """Index of the first of ``spans``, which lie in order and apart, that ends after ``x``; their number if none does."""
    halves = F.sequence(F.lit(1), F.length(F.bin(F.size(spans))))  # one step for each bit of their number
    middle = lambda a: F.floor((a["low"] + a["high"]) / 2).cast("int")

    def step(a: Column, _: Column) -> Column:
        past = F.get(spans, middle(a))["end"] > x
        low, high = F.when(past, a["low"]).otherwise(middle(a) + 1), F.when(past, middle(a)).otherwise(a["high"])
        open_ = a["low"] < a["high"]
        return F.struct(F.when(open_, low).otherwise(a["low"]).alias("low"), F.when(open_, high).otherwise(a["high"]).alias("high"))

    return F.aggregate(halves, F.struct(F.lit(0).alias("low"), F.size(spans).alias("high")), step, lambda a: a["low"])


def _valid(kind: str, s: Column) -> Column:
    n = F.length(only_digits(s))
    if kind == "ip":
        return octets(s)
    if kind == "card":
        return n.between(13, 19) & luhn(only_digits(s))
    return n.between(9, 15) if kind == "phone" else F.lit(True)


BASE_TYPE = "array<struct<k:int,start:int,end:int>>"


def base_of_kind(text: Column, k: int) -> Column:
    """Base spans of a kind as (k, start, end), k being its place in ``KINDS``, in order."""
    kind = KINDS[k]
    found = F.filter(matches(text, BASE[kind], NEEDS[kind]), lambda m: _valid(kind, m["s"]))
    return F.transform(found, lambda m: F.struct(F.lit(k).alias("k"), m["start"].alias("start"), m["end"].alias("end"))).cast(BASE_TYPE)


def base_spans(text: Column) -> Column:
    return F.concat(*[base_of_kind(text, k) for k in range(len(KINDS))])


def _features(m: Column, generator: str) -> Column:
    s = m["s"]
    before = F.lower(m["before"])
    edges = F.concat(F.right(m["before"], F.lit(1)), F.lit(" "), m["after"])
    digits = F.length(only_digits(s))
    flag = lambda c: F.when(c, 1.0).otherwise(0.0)
    values = [
        F.length(s), digits, digits / F.length(s), F.length(F.regexp_replace(s, "[^A-Za-z]", "")), F.size(F.split(s, "[^0-9]+")),
        F.length(s) - F.length(F.translate(s, ".", "")), flag(F.contains(s, F.lit("@"))), flag(s.startswith("+")),
        flag(digits.between(13, 19) & luhn(only_digits(s))), flag(octets(s)) if generator == "dotted" else F.lit(0.0), flag(s.rlike(r"\.[A-Za-z]{2,}$")),
        flag(edges.rlike("[A-Za-z0-9_]")), *[F.lit(float(generator == g)) for g in WIDE], *[flag(before.rlike(p)) for p in NEAR.values()],
    ]
    return F.array(*[v.cast("double") for v in values])


def candidates(text: Column, base: list[Column]) -> Column:
    """What the generators propose: (k, start, end, f, label, sure, clear).

    ``base``: the base spans of each kind. ``f``: features; ``label``: like a base span; ``sure``: that label is
    known; ``clear``: overlaps no base span. A span that shares half of a candidate covers one of the two
    characters in its middle, so base spans are looked up by place and never run through.
    """
    shared = lambda m, b: F.least(m["end"], b["end"]) - F.greatest(m["start"], b["start"])
    longest = lambda m, b: F.greatest(m["end"] - m["start"], b["end"] - b["start"])

    def alike(m: Column, spans: Column) -> Column:
        middle = F.floor((m["start"] + m["end"]) / 2).cast("int")
        one = lambda x: let(F.get(spans, ends_after(spans, x)), lambda b: b.isNotNull() & (2 * shared(m, b) >= longest(m, b)))
        return F.when(F.size(spans) == 0, F.lit(False)).otherwise(one(middle - 1) | one(middle))

    def meets(m: Column, spans: Column) -> Column:
        first = F.get(spans, ends_after(spans, m["start"]))["start"]
        return F.when(F.size(spans) == 0, F.lit(False)).otherwise(F.coalesce(first < m["end"], F.lit(False)))

    def propose(generator: str, pattern: str, needs: str) -> Column:
        def make(m: Column) -> Column:
            n = F.length(only_digits(m["s"]))
            k = {"mail": F.lit(0), "dotted": F.lit(1)}.get(generator, F.when(n >= 13, 2).otherwise(3))
            like = {"mail": alike(m, base[0]), "dotted": alike(m, base[1])}.get(generator, F.when(n >= 13, alike(m, base[2])).otherwise(alike(m, base[3])))
            clear = ~reduce(lambda a, b: a | b, [meets(m, spans) for spans in base])
            passes = {"mail": m["s"].rlike(r"(?:\(at\)|\[at\]|\s).*\.[A-Za-z]{2,}$"), "dotted": F.lit(False)}.get(generator, n.between(13, 19) & luhn(only_digits(m["s"])) | m["s"].startswith("+") & n.between(9, 15))
            return F.struct(k.alias("k"), m["start"].alias("start"), m["end"].alias("end"), _features(m, generator).alias("f"), like.alias("label"), (like | ~passes).alias("sure"), clear.alias("clear"))

        return F.transform(matches(text, pattern, needs), make)

    return F.concat(*[propose(g, *w) for g, w in WIDE.items()])


def find_candidates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, base, found`` of every row."""
    d = docs.select(docs[id_col].alias("doc_id"), F.coalesce(docs[text_col], F.lit("")).alias("text"))
    names = [f"_base{k}" for k in range(len(KINDS))]
    d = d.select("doc_id", "text", *[base_of_kind(F.col("text"), k).alias(n) for k, n in enumerate(names)])
    return d.select("doc_id", F.concat(*names).alias("base"), candidates(F.col("text"), [F.col(n) for n in names]).alias("found"))


class SpanModel:
    """Trees as conditional expressions, and a threshold for each kind."""

    def __init__(self, trees: list[tuple[float, object]], thresholds: list[float]):
        self.trees, self.thresholds = trees, thresholds

    def score(self, f: Column) -> Column:
        def grow(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            at, cut, low, high = node
            return F.when(f[at] <= cut, grow(low)).otherwise(grow(high))

        margin = reduce(lambda a, b: a + b, [w * grow(t) for w, t in self.trees], F.lit(0.0))
        return 1 / (1 + F.exp(-2 * margin))


def _tree(node) -> object:
    """A fitted tree as nested (feature, cut, low, high)."""
    if node.getClass().getSimpleName() == "LeafNode":
        return float(node.prediction())
    return node.split().featureIndex(), float(node.split().threshold()), _tree(node.leftChild()), _tree(node.rightChild())


def learn_spans(found: DataFrame, trees: int = 12, depth: int = 3, precision: float = 0.98, least: int = 20, seed: int = 3) -> SpanModel:
    """Fit on all sure candidates, two thirds for the trees and one for the thresholds.

    Like candidates become one row with their number as its weight, so the trees see every candidate.
    """
    rows = found.select("doc_id", F.explode(F.filter("found", lambda c: c["sure"])).alias("c"))
    apart = F.pmod(F.xxhash64(F.lit(seed), "doc_id", "c.start", "c.end", "c.k"), F.lit(3)) == 0
    rows = rows.select(apart.alias("apart"), "c.k", "c.f", F.col("c.label").cast("int").alias("label"))
    rows = settle(rows.groupBy("apart", "k", "f", "label").agg(F.count("*").alias("n")), "pii-counts")
    kinds = rows.filter("NOT apart").groupBy("f", "label").agg(F.sum("n").cast("double").alias("n"))
    fit = settle(kinds.select("f", "label", "n"), "pii-weights").select(array_to_vector("f").alias("features"), "label", "n")
    if fit.select("label").distinct().count() < 2:
        return SpanModel([], [2.0] * len(KINDS))
    # With bins up to the root of the rows, Spark looks for cuts in every row and not in some of them.
    bins = max(32, math.isqrt(fit.count()) + 1)
    model = GBTClassifier(labelCol="label", weightCol="n", maxBins=bins, maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed).fit(fit)
    grown = [(float(w), _tree(t._java_obj.rootNode())) for w, t in zip(model.treeWeights, model.trees)]
    out = SpanModel(grown, [2.0] * len(KINDS))
    scored = rows.filter("apart").select("k", "n", "label", F.floor(out.score(F.col("f")) * 200).alias("level"))
    counts = {(r["k"], r["level"]): (r["p"], r["n"]) for r in scored.groupBy("k", "level").agg(F.sum(F.col("label") * F.col("n")).alias("p"), F.sum("n").alias("n")).collect()}
    for k in range(len(KINDS)):
        p = n = 0
        for level in range(200, -1, -1):
            p, n = p + counts.get((k, level), (0, 0))[0], n + counts.get((k, level), (0, 0))[1]
            if (k, level) in counts and n >= least and p >= precision * n:
                out.thresholds[k] = level / 200
    return out


def select_spans(found: DataFrame, model: SpanModel) -> DataFrame:
    """``doc_id, base, spans``: base spans and the candidates that the model accepts.

    One sweep in the order of places: where the next candidate overlaps the last one kept, the better one stays.
    """
    bound = F.array(*[F.lit(t) for t in model.thresholds])
    kind = "struct<start:int,end:int,k:int,low:double>"
    none = F.array().cast(BASE_TYPE)
    span = lambda c: F.struct(c["k"].alias("k"), c["start"].alias("start"), c["end"].alias("end"))
    scored = F.transform(F.filter("found", lambda c: c["clear"]), lambda c: F.struct(c["start"].alias("start"), c["end"].alias("end"), c["k"].alias("k"), (-model.score(c["f"])).alias("low")))
    accepted = F.array_sort(F.filter(scored, lambda c: -c["low"] >= F.element_at(bound, c["k"] + 1)).cast(f"array<{kind}>"))

    def step(a: Column, c: Column) -> Column:
        last = a["last"]
        apart = last.isNull() | (last["end"] <= c["start"])
        out = F.when(apart & last.isNotNull(), F.concat(a["out"], a["at"].cast("string"), F.lit(","))).otherwise(a["out"])
        new = apart | (c["low"] < last["low"])
        return F.struct(F.when(new, c).otherwise(last).alias("last"), F.when(new, a["i"]).otherwise(a["at"]).alias("at"), (a["i"] + 1).alias("i"), out.alias("out"))

    # The places of what stays, as text: appending to it is cheap, however many there are.
    start = F.struct(F.lit(None).cast(kind).alias("last"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit("").alias("out"))
    kept = lambda of: F.aggregate(of, start, step, lambda a: F.when(a["last"].isNull(), a["out"]).otherwise(F.concat(a["out"], a["at"].cast("string"))))
    chosen = let(accepted, lambda of: F.transform(F.filter(F.split(kept(of), ","), lambda x: x != ""), lambda x: span(F.get(of, x.cast("int"))))).cast(BASE_TYPE)
    if not model.trees:
        chosen = none
    return found.select("doc_id", "base", F.array_sort(F.concat("base", chosen)).alias("spans"))


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **fit) -> DataFrame:
    """One row per input row: ``doc_id``, ``base`` and ``spans``, arrays of (k, start, end) by kind and start."""
    found = settle(find_candidates(docs, id_col, text_col), "pii-candidates")
    return select_spans(found, learn_spans(found, **fit))


def redact(text: Column, spans: Column, mask: str = "[PII]") -> Column:
    """``text`` with its spans masked; spans that overlap become one mask each for what is left of them."""
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"))))
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    cut = F.aggregate(ordered, start, lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out"))).otherwise(
        F.struct(s["end"].alias("at"), F.concat(a["out"], F.substring(text, a["at"] + 1, s["start"] - a["at"]), F.lit(mask)).alias("out"))))
    return F.concat(cut["out"], F.substring(text, cut["at"] + 1, F.length(text)))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = find_pii(documents(spark, sf_dir))
    names = F.array(*map(F.lit, KINDS))
    line = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", F.element_at(names, s["k"] + 1), s["start"], s["end"])), ",")
    total = F.size("spans").cast("long").alias("n_spans")
    count = lambda k: F.size(F.filter("base", lambda s: s["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return spans.select("doc_id", *map(count, range(len(KINDS))), F.sha2(line(F.array_sort("base")), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), total)
