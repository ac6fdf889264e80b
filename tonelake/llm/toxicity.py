"""Toxicity: gradient-boosted trees over dense features of whole texts, with isotonic calibration.

Features are densities of lexicon words, how near they are to the second person, capitals, punctuation
and obfuscation. A word counts in its plain form: lower case, outer signs off, look-alike signs as
letters. Beside the fixed lexicon stands a learned one: words and word beginnings that mark
toxic texts, from labelled rows of two folds. Other folds fit the trees and the calibration; fold 0
(crc32 of the id's text modulo 5) is never learned from. At most ``sample`` labelled rows, by hash of the
id, are used for each. Labels, language, source and id are no features.

Defined results: null is the empty text, which is scored like any other; a repeated row gets the same
score again; of several labels of a document the highest counts, labels without a document or a value are
left out; without labels of both kinds the score is the share of toxic labels (0 without any); an empty
table gives an empty table; other columns are kept by ``score_toxicity``. Texts are read whole.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.llm.common import documents, fold, labels, map_batches, settle, texts

LEXICON = frozenset(
    "idiot idiots idiotic moron morons moronic stupid dumb dumbass loser losers scum scumbag trash garbage clown clowns pathetic "
    "worthless disgusting ugly filthy filth retard retarded imbecile cretin fool fools freak freaks jerk bastard bastards bitch "
    "asshole shit crap damn fuck fucking hate hateful vermin parasite coward liar swine nazi "
    "dumm dummkopf trottel arschloch abschaum versager schwein wertlos widerlich hasse "
    "imbécile idiote crétin connard salaud pourriture ordure déchet minable merde stupide "
    "idiota imbécil estúpido estúpida basura escoria patético inútil asqueroso mierda cabrón payaso perdedor".split()
)
SECOND_PERSON = frozenset("you your yours yourself u ur thou thee du dich dir dein deine ihr euch sie tu toi te ton ta tes vous votre tú ti tuyo usted ustedes vos".split())
LOOKALIKES = str.maketrans("013457@$!|", "oieastasii")
SIGNS = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”’…"
FEATURES = ["log_words", "lexicon", "lexicon_log", "learned_best", "learned_sum", "learned", "learned_log", "near_you", "capital_words", "capitals", "marks", "signs", "obfuscated"]
NEAR = 5
PREFIXES = (5, 6)
_LEX, _YOU, _CAPS, _OBFUSCATED = 1, 2, 4, 8


def plain(word: str) -> str:
    return word.strip(SIGNS).lower()


def clear(word: str) -> str:
    """A word behind look-alike signs and inner punctuation."""
    return "".join(c for c in word.lower().rstrip("!?.,;:").translate(LOOKALIKES) if c.isalpha())


class _Words(dict):
    """What is known of a word as written, as bits and a weight; emptied when full."""

    def __init__(self, learned: dict[str, float], limit: int = 120_000):
        super().__init__()
        self.learned, self.limit = learned, limit

    def weight(self, word: str) -> float:
        best = self.learned.get(word, 0.0)
        for n in PREFIXES:
            if len(word) > n:
                best = max(best, self.learned.get(word[:n] + "-", 0.0))
        return best

    def __missing__(self, raw: str) -> int:
        if len(self) >= self.limit:
            self.clear()
        word, open_ = plain(raw), clear(raw)
        hidden = word != open_ and (open_ in LEXICON or open_ in self.learned)
        bits = _LEX * (word in LEXICON or hidden and open_ in LEXICON) + _YOU * (word in SECOND_PERSON)
        bits += _CAPS * (len(word) > 1 and raw.isupper()) + _OBFUSCATED * hidden
        self[raw] = bits + (round(16 * max(self.weight(word), self.weight(open_) if hidden else 0.0)) << 8)
        return self[raw]


def text_features(text: str, known: _Words) -> list[float]:
    raw = text.split()
    n = max(1, len(raw))
    codes = np.fromiter(map(known.__getitem__, raw), np.int64, len(raw))
    weight = (codes >> 8) / 16
    lexicon, learned = int((codes & _LEX > 0).sum()), int((weight >= 2).sum())
    hits = np.flatnonzero((codes & _LEX > 0) | (weight >= 2))
    near = 0
    if len(hits):
        you = np.flatnonzero(codes & _YOU)
        if len(you):
            at = np.searchsorted(you, hits)
            gap = np.minimum(np.abs(you[np.minimum(at, len(you) - 1)] - hits), np.abs(you[np.maximum(at - 1, 0)] - hits))
            near = int((gap <= NEAR).sum())
    size = max(1, len(text))
    signs = sum(text.count(c) for c in "#*$%&@")
    capitals = len(text) - len(text.translate(_NO_CAPITALS))
    return [
        math.log1p(len(raw)), lexicon / n, math.log1p(lexicon), float(weight.max()) if len(raw) else 0.0, float(weight.sum()) / n, learned / n, math.log1p(learned),
        near / n, int((codes & _CAPS > 0).sum()) / n, capitals / size, (text.count("!") + text.count("?")) / size, signs / size, int((codes & _OBFUSCATED > 0).sum()) / n,
    ]


_NO_CAPITALS = {c: None for c in map(ord, "ABCDEFGHIJKLMNOPQRSTUVWXYZ")}


def with_features(docs: DataFrame, learned: dict[str, float], text_col: str, keep: list[str], name: str = "features") -> DataFrame:
    """The ``keep`` columns of ``docs`` with an array of features."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        known = _cached(learned)
        rows = [text_features(t, known) for t in texts(batch, text_col)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(rows, pa.list_(pa.float64()))], [*keep, name])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_batches(docs.select(*dict.fromkeys([*keep, text_col])), run, f"{schema}, `{name}` array<double>")


_KNOWN: dict[int, _Words] = {}


def _cached(learned: dict[str, float]) -> _Words:
    """A worker keeps one table of words for a learned lexicon."""
    key = hash(frozenset(learned.items()))
    if key not in _KNOWN:
        _KNOWN.clear()
        _KNOWN[key] = _Words(learned)
    return _KNOWN[key]


def _sampled(docs: DataFrame, marked: DataFrame, id_col: str, text_col: str, folds: tuple[int, ...], sample: int) -> DataFrame:
    """At most ``sample`` labelled texts of the folds, by hash: ``id, text, toxic``."""
    one = marked.filter("toxic IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    one = one.filter(fold(F.col("doc_id")).isin(*folds)).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample)
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return source.join(F.broadcast(one.withColumnRenamed("doc_id", "id")), "id")


def learn_lexicon(rows: DataFrame, least: int = 4, weight: float = 2.0, size: int = 2000) -> dict[str, float]:
    """Words, and beginnings of longer words, with the log odds of standing in a toxic text.

    ``rows``: text and toxic. A term stands in ``least`` toxic texts; the ``size`` most telling stay.
    """

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        seen: dict[int, Counter] = {0: Counter(), 1: Counter()}
        for text, toxic in zip(texts(batch), batch.column("toxic").to_pylist()):
            terms = {plain(w) for w in text.split()}
            terms |= {w[:n] + "-" for w in terms for n in PREFIXES if len(w) > n}
            seen[toxic].update(terms)
            seen[toxic][""] += 1
        both = seen[0] | seen[1]
        return pa.RecordBatch.from_arrays([pa.array(list(both), pa.string()), pa.array([seen[1][t] for t in both], pa.int64()), pa.array([seen[0][t] for t in both], pa.int64())], ["term", "p", "n"])

    sums = map_batches(rows.select("text", "toxic"), count, "term string, p long, n long").groupBy("term").agg(F.sum("p").alias("p"), F.sum("n").alias("n"))
    sums = settle(sums.filter(F.col("p") >= least), "toxic-terms")
    whole = sums.filter("term = ''").first()
    if whole is None or not whole["n"]:
        return {}
    odds = F.log((F.col("p") + 0.5) / (whole["p"] + 1)) - F.log((F.col("n") + 0.5) / (whole["n"] + 1))
    best = sums.filter("term <> ''").withColumn("w", odds).filter(F.col("w") >= weight).orderBy(F.desc(F.col("p") * F.col("w")), "term").limit(size)
    return {r["term"]: round(min(r["w"], 8.0), 4) for r in best.collect()}


def score_toxicity(docs: DataFrame, train: DataFrame, marked: DataFrame, keep: list[str] | None = None, id_col: str = "doc_id", text_col: str = "text", name: str = "score",
                   sample: int = 12_000, trees: int = 20, depth: int = 4, seed: int = 9) -> DataFrame:
    """``docs`` (or its ``keep`` columns) with a score in 0..1, learned from the texts of ``train`` and the labels ``marked``.

    One pass over the texts; no join, so rows and their ids stay as they are.
    """
    keep = docs.columns if keep is None else keep
    # Kept columns travel as one, so their names meet none of the names made here.
    docs = docs.select(F.struct(*[docs[c] for c in keep]).alias("_row"), docs[text_col].alias("_text"))
    pick = lambda folds: _sampled(train, marked, id_col, text_col, folds, sample)
    learned = learn_lexicon(pick((2, 3)))
    rows = settle(with_features(pick((1, 3, 4)), learned, "text", ["id", "toxic"]), "toxicity-rows")
    fit, calibrate = rows.filter(fold(F.col("id")) != 1), rows.filter(fold(F.col("id")) == 1)
    share = rows.agg(F.avg("toxic")).first()[0]
    scored = with_features(docs, learned, "_text", ["_row"])
    ready = lambda df, column: df.withColumn("_vector", array_to_vector(column))
    if fit.select("toxic").distinct().count() < 2:
        return scored.select("_row.*", F.lit(float(share or 0.0)).alias(name))
    order = fit.repartition(1).sortWithinPartitions("id")
    model = GBTClassifier(featuresCol="_vector", labelCol="toxic", predictionCol="_prediction", maxIter=trees, maxDepth=depth, stepSize=0.3, seed=seed)
    model = model.setRawPredictionCol("_raw").setProbabilityCol("_probability").fit(ready(order, "features"))
    raw = vector_to_array("_probability")[1]
    scored = model.transform(ready(scored, "features")).withColumn("_p", raw)
    known = model.transform(ready(calibrate, "features")).select("id", raw.alias("_p"), F.col("toxic").cast("double").alias("toxic"))
    if calibrate.select("toxic").distinct().count() == 2:
        known = known.repartition(1).sortWithinPartitions("id")
        scored = IsotonicRegression(featuresCol="_p", labelCol="toxic", predictionCol="_calibrated").fit(known).transform(scored)
    else:
        scored = scored.withColumn("_calibrated", F.col("_p"))
    return scored.select("_row.*", F.greatest(F.lit(0.0), F.least(F.lit(1.0), "_calibrated")).alias(name))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    out = score_toxicity(docs, docs, labels(spark, sf_dir), ["doc_id"])
    return out.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
