"""From a prompt to a plan: negation, synonyms, genres, feature and emotion targets, weights.

Each step is a column expression over literal rule tables, so planning any number of prompts is
one narrow projection with no join and no shuffle. Order matters in several rules (first mention
wins); arrays keep it.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tonelake.functions.numbers import let
from tonelake.rules import (
    ACOUSTIC_DOMINANT,
    EMOTION_DOMINANT,
    NEGATION_WORDS,
    SIGNAL_WEIGHTS,
    Rulebook,
    default_rulebook,
    literal,
    words,
)

SIGNALS = list(SIGNAL_WEIGHTS)
DEFAULT_LIMIT = 20


def split_words(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")


def split_negation(prompt: Column) -> tuple[Column, Column]:
    """(clean prompt, negated words): everything after the first negation word is negated."""
    parts = split_words(prompt)
    is_negation = lambda w: F.array_contains(words(NEGATION_WORDS), w)
    first = F.array_position(F.transform(parts, is_negation), F.lit(True)).cast("int")
    clean = F.when(first == 0, parts).otherwise(F.slice(parts, 1, F.greatest(first - 1, F.lit(0))))
    later = F.when(first == 0, F.array().cast("array<string>")).otherwise(
        F.slice(parts, F.greatest(first, F.lit(1)), F.size(parts))
    )
    return F.array_join(clean, " "), F.filter(later, lambda w: ~is_negation(w))


def letter_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z']+"), F.lit(0))


def _names(clean: Column, tokens: Column, term: Column) -> Column:
    """A term is named as a whole token or, if it has a space, as a substring."""
    phrase = F.contains(term, F.lit(" ")) & F.contains(clean, term)
    return F.array_contains(tokens, term) | phrase


def expand_keywords(clean: Column, tokens: Column, rules: Rulebook) -> Column:
    table = literal(
        [{"term": t, "keywords": k} for t, k in rules.synonyms.items()],
        "array<struct<term:string,keywords:array<string>>>",
    )
    named = let(
        F.struct(clean.alias("q"), tokens.alias("t")),
        lambda p: F.filter(table, lambda s: _names(p["q"], p["t"], s["term"])),
    )
    added = F.flatten(F.transform(named, lambda s: s["keywords"]))
    return F.array_distinct(F.concat(F.array(clean), added))


def detect_genres(clean: Column, tokens: Column, rules: Rulebook) -> Column:
    table = literal(
        [{"genre": g, "words": w} for g, w in rules.genres.items()],
        "array<struct<genre:string,words:array<string>>>",
    )
    named = let(
        F.struct(clean.alias("q"), tokens.alias("t")),
        lambda p: F.filter(table, lambda g: F.exists(g["words"], lambda w: _names(p["q"], p["t"], w))),
    )
    return F.transform(named, lambda g: g["genre"])


def _lookup(keywords: Column, table: Column) -> Column:
    """Rule rows of the keywords that have one, in keyword order."""
    found = F.transform(keywords, lambda k: F.try_element_at(table, k))
    return F.filter(found, lambda row: row.isNotNull())


def profile_rows(keywords: Column, rules: Rulebook) -> Column:
    table = literal(
        {
            mood: [{"target": p[f][0], "weight": p[f][1]} if f in p else None for f in rules.features]
            for mood, p in rules.profiles.items()
        },
        "map<string,array<struct<target:double,weight:double>>>",
    )
    return _lookup(keywords, table)


def merge_profile(rows: str, rules: Rulebook) -> Column:
    """Struct of feature -> (target, weight): the largest weight, the earliest keyword on a tie."""
    kind = "struct<target:double,weight:double>"

    def best(i: int) -> str:
        wins = f"r[{i}] IS NOT NULL AND (kept IS NULL OR r[{i}].weight > kept.weight)"
        return f"aggregate({rows}, cast(NULL AS {kind}), (kept, r) -> CASE WHEN {wins} THEN r[{i}] ELSE kept END)"

    return F.expr(f"named_struct({', '.join(f"'{f}', {best(i)}" for i, f in enumerate(rules.features))})")


def emotion_rows(keywords: Column, rules: Rulebook) -> Column:
    table = literal(
        {mood: [p.get(e) for e in rules.emotions] for mood, p in rules.emotion_targets.items()},
        "map<string,array<double>>",
    )
    return _lookup(keywords, table)


def merge_emotions(rows: str, rules: Rulebook) -> Column:
    """Struct of emotion -> target share: the largest over the keywords, NULL if none."""
    top = lambda i: f"array_max(transform({rows}, r -> r[{i}]))"
    return F.expr(f"named_struct({', '.join(f"'{e}', {top(i)}" for i, e in enumerate(rules.emotions))})")


def boosts(keywords: Column) -> tuple[Column, Column]:
    """(emotion boost, acoustic boost)."""
    emotion = F.arrays_overlap(keywords, words(EMOTION_DOMINANT))
    acoustic = F.arrays_overlap(keywords, words(ACOUSTIC_DOMINANT))
    leads = lambda a, b: F.when(a & ~b, 1.4).when(b & ~a, 0.7).otherwise(1.0)
    return leads(emotion, acoustic), leads(acoustic, emotion)


def any_set(struct: str, fields: list[str]) -> str:
    """True if any field of the struct column is set."""
    return "(" + " OR ".join(f"{struct}.{f} IS NOT NULL" for f in fields) + ")"


def plan_prompts(prompts: DataFrame, rules: Rulebook | None = None) -> DataFrame:
    """Plans of ``prompts(query_id, prompt[, limit])``; other columns pass through."""
    rules = rules or default_rulebook()
    limit = F.col("limit") if "limit" in prompts.columns else F.lit(None)
    others = [c for c in prompts.columns if c not in ("query_id", "prompt", "limit")]
    clean, negated = split_negation(F.col("prompt"))
    step = prompts.select(
        "query_id", "prompt", *others, valid_limit(limit).alias("limit"),
        clean.alias("clean_query"), negated.alias("negated"),
    )
    step = step.withColumn("tokens", letter_tokens(F.col("clean_query")))
    step = step.withColumn(
        "keywords", expand_keywords(F.col("clean_query"), F.col("tokens"), rules)
    ).withColumn("genres", detect_genres(F.col("clean_query"), F.col("tokens"), rules))
    step = step.withColumn("_p", profile_rows(F.col("keywords"), rules)).withColumn(
        "_e", emotion_rows(F.col("keywords"), rules)
    )
    emotion_boost, acoustic_boost = boosts(F.col("keywords"))
    return step.select(
        *[c for c in step.columns if c not in ("_p", "_e")],
        merge_profile("_p", rules).alias("profile"),
        merge_emotions("_e", rules).alias("emotions"),
        emotion_boost.alias("emotion_boost"), acoustic_boost.alias("acoustic_boost"),
    )


def prompt_table(spark: SparkSession, prompts: list[str], limit: int | None = None) -> DataFrame:
    """Prompts of a request as a local table, numbered from 0."""
    table = pa.table({
        "query_id": pa.array(range(len(prompts)), pa.int32()), "prompt": pa.array(prompts, pa.string()),
        "limit": pa.array([limit] * len(prompts), pa.int32()),
    })
    return spark.createDataFrame(table)


def valid_limit(limit: Column) -> Column:
    """NULL and 0 mean the default; a negative limit is an error."""
    n = F.coalesce(F.nullif(limit.cast("int"), F.lit(0)), F.lit(DEFAULT_LIMIT))
    return F.when(n < 0, F.raise_error(F.lit("limit must not be negative"))).otherwise(n)


def with_weights(plans: DataFrame, has_clap: str, rules: Rulebook | None = None) -> DataFrame:
    """Add ``weights``: a signal without a target gets 0, the rest is boosted and sums to 1.

    ``has_clap`` is a SQL condition on the plan row.
    """
    rules = rules or default_rulebook()
    on = {
        "semantic": "true",
        "clap": f"({has_clap})",
        "features": any_set("profile", rules.features),
        "genre": "size(genres) > 0",
        "emotion": any_set("emotions", rules.emotions),
    }
    boost = {"clap": "emotion_boost", "emotion": "emotion_boost", "features": "acoustic_boost"}
    raw = {s: f"CASE WHEN {on[s]} THEN {w}D * {boost.get(s, '1D')} ELSE 0D END" for s, w in SIGNAL_WEIGHTS.items()}
    total = f"({' + '.join(raw.values())})"
    return plans.withColumn(
        "weights", F.expr(f"named_struct({', '.join(f"'{s}', {raw[s]} / {total}" for s in SIGNALS)})")
    )
