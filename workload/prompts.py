"""Planning prompts, scoring and ranking."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tonelake.functions.vectors import hashed_words
from tonelake.plans import ranking as rk
from tonelake.plans import signals as sig
from tonelake.plans.prompt import letter_tokens, plan_prompts, prompt_table, split_negation, with_weights
from tonelake.rules import ACOUSTIC_DOMINANT, EMOTION_DOMINANT, FEATURE_SIGMA, NEGATION_WORDS, default_rulebook
from workload.registry import q, query, r, rule, text
from workload.views import PROMPTS, duck

RULES = default_rulebook()
FEATURES, EMOTIONS = RULES.features, RULES.emotions

# ---------------------------------------------------------------- SQL side of the planning

FIXED_PROMPTS = "p(query_id, prompt) AS (VALUES " + ", ".join(f"({i}, '{p}')" for i, p in enumerate(PROMPTS)) + ")"
TABLE_PROMPTS = duck("prompt_rows") + ", p AS (SELECT * FROM prompt_rows)"
NEGATION = f"""
w AS (SELECT query_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT query_id, regexp_split_to_array(trim(lower(prompt)), '\\s+') AS ws FROM p)),
first_no AS (SELECT query_id, min(pos) FILTER (WHERE word IN {text(NEGATION_WORDS)}) AS first FROM w GROUP BY 1),
negated AS (SELECT query_id, word, pos FROM w JOIN first_no USING (query_id)
  WHERE pos > first AND word NOT IN {text(NEGATION_WORDS)}),
neg AS (SELECT p.query_id, p.prompt,
    coalesce((SELECT string_agg(word, ' ' ORDER BY pos) FROM w JOIN first_no USING (query_id)
      WHERE w.query_id = p.query_id AND (first IS NULL OR pos < first)), '') AS clean_query,
    coalesce((SELECT string_agg(word, ' ' ORDER BY pos) FROM negated n WHERE n.query_id = p.query_id), '') AS negated
  FROM p),
tok AS (SELECT query_id, clean_query, regexp_extract_all(clean_query, '[a-z'']+') AS tokens FROM neg)"""
KEYWORDS = rule("synonyms") + """,
kws AS (SELECT query_id, keyword, min(ord) AS ord FROM (
    SELECT query_id, clean_query AS keyword, -1 AS ord FROM tok
    UNION ALL SELECT query_id, keyword, term_ord * 100 + kw_ord FROM tok JOIN synonyms
      ON list_contains(tokens, term) OR (contains(term, ' ') AND contains(clean_query, term))) GROUP BY 1, 2)"""
GENRES = rule("genre_keywords") + """,
targets AS (SELECT DISTINCT query_id, genre, genre_ord FROM tok JOIN genre_keywords
    ON (contains(keyword, ' ') AND contains(clean_query, keyword)) OR (NOT contains(keyword, ' ') AND list_contains(tokens, keyword)))"""
PROFILES = rule("profiles") + """,
prof AS (SELECT query_id, feature, target, weight FROM (
    SELECT query_id, feature, target, weight, row_number() OVER (PARTITION BY query_id, feature ORDER BY weight DESC, ord) AS n
    FROM kws JOIN profiles ON mood = keyword) WHERE n = 1)"""
EMOTION = rule("emotion_targets") + """,
emo AS (SELECT query_id, emotion, max(share) AS share FROM kws JOIN emotion_targets ON mood = keyword GROUP BY 1, 2)"""
BOOST = f"""
hit AS (SELECT query_id, bool_or(keyword IN {text(EMOTION_DOMINANT)}) AS e, bool_or(keyword IN {text(ACOUSTIC_DOMINANT)}) AS a FROM kws GROUP BY 1),
boost AS (SELECT query_id, CASE WHEN e AND NOT a THEN 1.4e0 WHEN a AND NOT e THEN 0.7e0 ELSE 1e0 END AS emotion_boost,
    CASE WHEN a AND NOT e THEN 1.4e0 WHEN e AND NOT a THEN 0.7e0 ELSE 1e0 END AS acoustic_boost FROM hit)"""


def weights_sql(clap: str) -> str:
    return f"""
raw AS (SELECT query_id, 0.22e0 AS w_s, CASE WHEN {clap} THEN 0.3e0 * emotion_boost ELSE 0e0 END AS w_c,
    CASE WHEN query_id IN (SELECT query_id FROM prof) THEN 0.25e0 * acoustic_boost ELSE 0e0 END AS w_f,
    CASE WHEN query_id IN (SELECT query_id FROM targets) THEN 0.1e0 ELSE 0e0 END AS w_g,
    CASE WHEN query_id IN (SELECT query_id FROM emo) THEN 0.13e0 * emotion_boost ELSE 0e0 END AS w_e FROM boost),
weights AS (SELECT query_id, w_s / t AS semantic, w_c / t AS clap, w_f / t AS features, w_g / t AS genre, w_e / t AS emotion
    FROM (SELECT *, w_s + w_c + w_f + w_g + w_e AS t FROM raw))"""


def plan_sql(prompts: str, clap: str = "true") -> str:
    return "WITH " + ",\n".join([prompts, NEGATION, KEYWORDS, GENRES, PROFILES, EMOTION, BOOST, weights_sql(clap)])


# ---------------------------------------------------------------- G: one row per prompt of `part`


@query("G1_negation_split", f"WITH {TABLE_PROMPTS}, {NEGATION} SELECT query_id, clean_query, negated FROM neg")
def g1(t):
    clean, negated = split_negation(F.col("prompt"))
    return t.prompt_rows.select("query_id", clean.alias("clean_query"), F.array_join(negated, " ").alias("negated"))


@query("G2_tokenise", f"WITH {TABLE_PROMPTS} SELECT query_id, array_to_string(regexp_extract_all(lower(prompt), '[a-z'']+'), '|') AS tokens FROM p")
def g2(t):
    return t.prompt_rows.select("query_id", F.array_join(letter_tokens(F.col("prompt")), "|").alias("tokens"))


@query("G3_synonym_expansion", f"WITH {TABLE_PROMPTS}, {NEGATION}, {KEYWORDS} SELECT query_id, string_agg(keyword, '|' ORDER BY ord) AS keywords FROM kws GROUP BY 1")
def g3(t):
    return plan_prompts(t.prompt_rows).select("query_id", F.array_join("keywords", "|").alias("keywords"))


@query("G4_genre_detection", f"WITH {TABLE_PROMPTS}, {NEGATION}, {GENRES} SELECT query_id, coalesce((SELECT string_agg(genre, '|' ORDER BY genre_ord) FROM targets WHERE targets.query_id = tok.query_id), '') AS genres FROM tok")
def g4(t):
    return plan_prompts(t.prompt_rows).select("query_id", F.array_join("genres", "|").alias("genres"))


@query("G5_feature_profile", f"WITH {TABLE_PROMPTS}, {NEGATION}, {KEYWORDS}, {PROFILES} SELECT * FROM prof")
def g5(t):
    rows = [
        F.struct(F.lit(f).alias("feature"), F.col(f"profile.{f}.target").alias("target"), F.col(f"profile.{f}.weight").alias("weight"))
        for f in FEATURES
    ]
    return plan_prompts(t.prompt_rows).select("query_id", F.inline(F.array(*rows))).filter(F.col("weight").isNotNull())


@query("G6_emotion_targets", f"WITH {TABLE_PROMPTS}, {NEGATION}, {KEYWORDS}, {EMOTION} SELECT * FROM emo")
def g6(t):
    rows = [F.struct(F.lit(e).alias("emotion"), F.col(f"emotions.{e}").alias("share")) for e in EMOTIONS]
    return plan_prompts(t.prompt_rows).select("query_id", F.inline(F.array(*rows))).filter(F.col("share").isNotNull())


@query("G7_query_type_boost", f"WITH {TABLE_PROMPTS}, {NEGATION}, {KEYWORDS}, {BOOST} SELECT * FROM boost")
def g7(t):
    return plan_prompts(t.prompt_rows).select("query_id", "emotion_boost", "acoustic_boost")


def _weights(df: DataFrame) -> DataFrame:
    return df.select("query_id", *[r(F.col(f"weights.{s}")).alias(s) for s in ("semantic", "clap", "features", "genre", "emotion")])


_W = "SELECT query_id, " + ", ".join(f"{q(s)} AS {s}" for s in ("semantic", "clap", "features", "genre", "emotion")) + " FROM weights"


@query("G8_weight_plan", plan_sql(TABLE_PROMPTS) + _W)
def g8(t):
    return _weights(with_weights(plan_prompts(t.prompt_rows), "true"))


@query("G8_weight_plan_without_clap", plan_sql(TABLE_PROMPTS, "false") + _W)
def g8_plain(t):
    return _weights(with_weights(plan_prompts(t.prompt_rows), "false"))


# ---------------------------------------------------------------- joins of the planning


@query(
    "J1_keyword_profile_lookup",
    f"WITH {TABLE_PROMPTS}, {NEGATION}, {KEYWORDS}, {rule('profiles')} SELECT query_id, keyword, count(*) AS features, {q('sum(weight)')} AS weight FROM kws JOIN profiles ON mood = keyword GROUP BY 1, 2",
)
def j1(t):
    rules = RULES.frame(t.spark, "profiles")  # a fixed table of a few hundred rows
    rows = plan_prompts(t.prompt_rows).select("query_id", F.explode("keywords").alias("keyword"))
    joined = rows.join(F.broadcast(rules), F.col("keyword") == F.col("mood"))
    return joined.groupBy("query_id", "keyword").agg(F.count("*").alias("features"), r(F.sum("weight")).alias("weight"))


@query(
    "J2_prompt_term_match",
    f"WITH {TABLE_PROMPTS}, {NEGATION}, {rule('synonyms')} SELECT DISTINCT query_id, term FROM tok JOIN synonyms ON list_contains(tokens, term) OR (contains(term, ' ') AND contains(clean_query, term))",
)
def j2(t):
    """Terms a prompt names: tokens meet one-word terms by equality, phrases are looked for in the text."""
    terms = list(RULES.synonyms)
    phrases = F.lit([x for x in terms if " " in x])
    plans = plan_prompts(t.prompt_rows)
    named = F.concat(
        F.array_distinct("tokens"), F.filter(phrases, lambda p: F.contains(F.col("clean_query"), p))
    )
    rows = plans.select("query_id", F.explode_outer(named).alias("term"))
    known = RULES.frame(t.spark, "synonyms").select("term").distinct()
    return rows.join(F.broadcast(known), "term", "left_semi").select("query_id", "term")


# ---------------------------------------------------------------- V: all songs against the prompt batch


def batch_prompts(t, times: int = 1) -> DataFrame:
    """The batch: its prompts are the query's parameters."""
    plans = plan_prompts(prompt_table(t.spark, PROMPTS * times))
    vec = hashed_words(F.col("clean_query"))
    return plans.withColumn("query_vec", vec).withColumn("clap_vec", F.reverse(vec))


def scored(t) -> DataFrame:
    return rk.score_batch(t.songs, rk.Batch(batch_prompts(t)))


VECTORS = """
slots AS (SELECT query_id, CAST('0x' || substr(md5(token), 1, 6) AS INT) % 64 AS slot
  FROM (SELECT query_id, unnest(tokens) AS token FROM tok)),
counts AS (SELECT tok.query_id, d.slot, (SELECT count(*) FROM slots s WHERE s.query_id = tok.query_id AND s.slot = d.slot)::DOUBLE AS n
  FROM tok, (SELECT unnest(range(0, 64)) AS slot) d),
norms AS (SELECT query_id, sqrt(sum(n * n)) + 1e-8 AS size FROM counts GROUP BY 1),
vecs AS (SELECT query_id, list((n / size)::FLOAT::DOUBLE ORDER BY slot) AS vec FROM counts JOIN norms USING (query_id) GROUP BY 1),
pairs AS (SELECT query_id, s.*, vec,
    coalesce(list_dot_product(embedding::DOUBLE[], vec) / nullif(sqrt(list_dot_product(vec, vec)) * sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 0), 0) AS semantic,
    list_dot_product(clap_embedding::DOUBLE[], list_reverse(vec)) AS clap
  FROM songs s, vecs),
bounds AS (SELECT query_id, min(semantic) AS sl, max(semantic) AS sh, min(clap) AS cl, max(clap) AS ch FROM pairs GROUP BY 1),
normed AS (SELECT query_id, id AS song_id, semantic, clap, (semantic - sl) / greatest(sh - sl, 0.08e0) AS norm_semantic,
    coalesce((clap - cl) / greatest(ch - cl, 0.08e0), 0) AS norm_clap FROM pairs JOIN bounds USING (query_id))"""


def _value(f: str) -> str:
    if f.startswith("mfcc"):
        return f"mfccs[{int(f[4])}]"
    if f == "mode_major":
        return "CASE WHEN mode = 'major' THEN 1e0 ELSE 0e0 END"
    if f == "arousal":
        return "coalesce(nullif(arousal, 0), 0.5e0)"
    return f"coalesce({f}, 0e0)"


_SIGMA = ", ".join(f"('{f}', {FEATURE_SIGMA.get(f, FEATURE_SIGMA['mfcc'])}::DOUBLE)" for f in FEATURES)
_UNPIVOT = " UNION ALL ".join(f"SELECT id AS song_id, '{f}' AS feature, {_value(f)} AS v FROM songs" for f in FEATURES)
MATCH = """CASE feature WHEN 'mode_major' THEN CASE WHEN v = target THEN 1e0 ELSE 0e0 END
  WHEN 'valence' THEN exp(-((v - target) ** 2) / (2 * sigma ** 2)) * CASE WHEN (target < -0.1 AND v > 0.1) OR (target > 0.1 AND v < -0.1) THEN 0.15e0 ELSE 1e0 END
  WHEN 'arousal' THEN exp(-((v - target) ** 2) / (2 * sigma ** 2)) * CASE WHEN (target > 0.5 AND v < 0.3) OR (target < 0.3 AND v > 0.5) THEN 0.2e0 ELSE 1e0 END
  ELSE CASE WHEN v > 0 THEN exp(-((v - target) ** 2) / (2 * sigma ** 2)) ELSE 0e0 END END"""
SONG_SIGNALS = f"""
sigmas(feature, sigma) AS (VALUES {_SIGMA}),
vals AS ({_UNPIVOT}),
feat AS (SELECT query_id, song_id, sum({MATCH} * weight) / sum(weight) AS features
  FROM prof JOIN vals USING (feature) JOIN sigmas USING (feature) GROUP BY 1, 2),
mood AS (SELECT profiles.mood, song_id, sum({MATCH} * weight) / sum(weight) AS s
  FROM profiles JOIN vals USING (feature) JOIN sigmas USING (feature)
  WHERE profiles.mood IN (SELECT word FROM negated) GROUP BY 1, 2),
pen AS (SELECT query_id, song_id, avg(0.2e0 * s) AS penalty FROM negated n JOIN mood ON mood.mood = n.word GROUP BY 1, 2),
sg AS (SELECT DISTINCT id AS song_id, k.genre FROM songs s JOIN genre_keywords k
  ON contains(lower(coalesce(s.genre, '')), k.keyword) OR contains(lower(coalesce(s.artist, '')), k.keyword)),
gen AS (SELECT query_id, s.id AS song_id, count(sg.genre)::DOUBLE / count(*) AS genre
  FROM targets CROSS JOIN songs s LEFT JOIN sg ON sg.song_id = s.id AND sg.genre = targets.genre GROUP BY 1, 2),
emos AS (SELECT query_id, id AS song_id, greatest(0e0, 1 - sum(abs(coalesce(emotion_distribution[emotion], 0) - share)) / count(*)) AS emotion
  FROM emo CROSS JOIN songs s WHERE has_lyrics AND cardinality(emotion_distribution) > 0 GROUP BY 1, 2),
signals AS (SELECT n.*, coalesce(f.features, 0) AS features, coalesce(g.genre, 0) AS genre, coalesce(e.emotion, 0) AS emotion, coalesce(p.penalty, 0) AS penalty
  FROM normed n LEFT JOIN feat f USING (query_id, song_id) LEFT JOIN gen g USING (query_id, song_id)
  LEFT JOIN emos e USING (query_id, song_id) LEFT JOIN pen p USING (query_id, song_id)),
scores AS (SELECT s.query_id, song_id, {q('''greatest(0e0, least(100e0, 100 * (w.semantic * norm_semantic + w.clap * norm_clap
    + w.features * s.features + w.genre * s.genre + w.emotion * s.emotion - penalty)))''')} AS score, {q('s.semantic * 100')} AS semantic_score
  FROM signals s JOIN weights w USING (query_id)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, song_id DESC) AS rank FROM scores)"""
SCORING = plan_sql(f"{duck('songs')}, {FIXED_PROMPTS}") + f", {VECTORS}, {SONG_SIGNALS}\n"


def _signal(name: str, column: str, *more: str):
    cols = [column, *more]
    sql = SCORING + "SELECT query_id, song_id, " + ", ".join(f"{q(c)} AS {c}" for c in cols) + " FROM signals"

    @query(name, sql)
    def run(t):
        return scored(t).select("query_id", "song_id", *[r(F.col(c)).alias(c) for c in cols])


_signal("V1_text_similarity", "semantic")
_signal("V2_audio_similarity", "clap")
_signal("V3_min_max_normalise", "norm_semantic", "norm_clap")
_signal("V5_feature_score", "features")
_signal("V7_genre_score", "genre")
_signal("V8_emotion_score", "emotion")
_signal("V9_negation_penalty", "penalty")


def _mood_matches(t, features: list[str]) -> DataFrame:
    """Every song against every mood that sets one of the features."""
    return sig.mood_matches(t.songs, features, RULES).withColumn("match", r(F.col("match")))


def _mood_sql(features: list[str]) -> str:
    return f"""WITH {duck('songs')}, {rule('profiles')}, sigmas(feature, sigma) AS (VALUES {_SIGMA}), vals AS ({_UNPIVOT})
SELECT song_id, mood, feature, {q(MATCH)} AS match FROM profiles JOIN vals USING (feature) JOIN sigmas USING (feature)
WHERE feature IN {text(features)}"""


@query("V4_gaussian_match", _mood_sql(["bpm", "energy", "brightness", "dynamic_range", "spectral_rolloff", "spectral_bandwidth", "mfcc1", "mfcc2", "mode_major"]))
def v4(t):
    return _mood_matches(t, ["bpm", "energy", "brightness", "dynamic_range", "spectral_rolloff", "spectral_bandwidth", "mfcc1", "mfcc2", "mode_major"])


@query("V6_contradiction_gate", _mood_sql(["valence", "arousal"]))
def v6(t):
    return _mood_matches(t, ["valence", "arousal"])


@query("V10_ensemble_score", SCORING + "SELECT query_id, song_id, score, semantic_score FROM scores")
def v10(t):
    return scored(t).select("query_id", "song_id", "score", "semantic_score")


@query("V11_ranked_playlist", SCORING + """SELECT query_id, CAST(rank AS INT) AS rank, song_id, score, semantic_score,
 CASE WHEN score >= 60 THEN 'high' WHEN score >= 35 THEN 'medium' ELSE 'low' END AS match_quality FROM ranked WHERE rank <= 20""")
def v11(t):
    return rk.rank_prompts(t.songs, batch_prompts(t))


@query("J3_vector_alignment", f"""WITH {duck('songs')}, a AS (SELECT id, embedding FROM songs WHERE embedding IS NOT NULL), b AS (SELECT id, clap_embedding FROM songs WHERE clap_embedding IS NOT NULL)
SELECT a.id, len(embedding) AS text_dims, len(clap_embedding) AS audio_dims FROM a LEFT JOIN b USING (id)""")
def j3(t):
    a = t.songs.filter(F.col("embedding").isNotNull()).select("id", F.size("embedding").cast("long").alias("text_dims"))
    b = t.songs.filter(F.col("clap_embedding").isNotNull()).select("id", F.size("clap_embedding").cast("long").alias("audio_dims"))
    return a.join(b, "id", "left")


@query("J7_prompts_by_songs", SCORING + f"SELECT query_id, count(*) AS songs, {q('avg(score)')} AS mean_score, {q('max(score)')} AS best FROM scores GROUP BY 1")
def j7(t):
    sums = rk.score_summary(t.songs, rk.Batch(batch_prompts(t)))
    return sums.select("query_id", "songs", r(F.col("total") / F.col("songs")).alias("mean_score"), r(F.col("best")).alias("best"))


@query("J8_hydrate_results", SCORING + "SELECT k.query_id, k.song_id, CAST(k.rank AS INT) AS rank, s.title, s.artist, s.filepath FROM ranked k JOIN songs s ON s.id = k.song_id WHERE rank <= 20")
def j8(t):
    ranked = rk.rank_prompts(t.songs, batch_prompts(t)).select("query_id", "song_id", "rank")
    return rk.hydrate(ranked, t.songs, ["title", "artist", "filepath"])


@query("O1_top_songs", SCORING + "SELECT song_id, score FROM ranked WHERE query_id = 0 AND rank <= 20")
def o1(t):
    """One prompt is a batch of one: tasks keep its best songs, and a plain top-k follows."""
    vec = hashed_words(F.col("clean_query"))
    plans = plan_prompts(prompt_table(t.spark, PROMPTS[:1])).withColumn("query_vec", vec).withColumn("clap_vec", F.reverse(vec))
    best = rk.best_in_tasks(t.songs, rk.Batch(plans), RULES)
    return best.orderBy(F.desc("score"), F.desc("song_id")).limit(20).select("song_id", "score")


# ---------------------------------------------------------------- windows and sets over plans


@query("Window1_first_occurrence_dedupe", f"""WITH {TABLE_PROMPTS}, x AS (SELECT query_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos FROM (SELECT query_id, regexp_split_to_array(trim(lower(prompt)), '\\s+') AS ws FROM p)),
d AS (SELECT query_id, word, min(pos) AS pos FROM x GROUP BY 1, 2) SELECT query_id, string_agg(word, ' ' ORDER BY pos) AS words FROM d GROUP BY 1""")
def w1(t):
    from tonelake.plans.prompt import split_words

    return t.prompt_rows.select("query_id", F.array_join(F.array_distinct(split_words(F.col("prompt"))), " ").alias("words"))


@query("Window2_best_per_key", f"WITH {rule('profiles')}, e AS (SELECT event_id, user_id, event_type, value, row_number() OVER (PARTITION BY user_id, event_type ORDER BY value DESC, event_id) AS n FROM events) SELECT user_id, event_type, event_id, value FROM e WHERE n = 1")
def w2(t):
    """Best row per key with an ordered tie-break, as an aggregation that combines on the map side."""
    best = F.max_by(F.struct("event_id", "value"), F.struct(F.col("value"), -F.col("event_id")))
    return t.events.groupBy("user_id", "event_type").agg(best.alias("b")).select("user_id", "event_type", "b.event_id", "b.value")


@query("Window4_rank_per_query", SCORING + "SELECT query_id, song_id, CAST(rank AS INT) AS rank FROM ranked WHERE rank <= 5")
def w4(t):
    five = batch_prompts(t).withColumn("limit", F.lit(5))
    return rk.rank_prompts(t.songs, five).select("query_id", "song_id", "rank")


@query("U2_keyword_overlap", f"""WITH {TABLE_PROMPTS}, {NEGATION}, {KEYWORDS} SELECT query_id,
 coalesce(string_agg(keyword, '|' ORDER BY ord) FILTER (WHERE keyword IN {text(EMOTION_DOMINANT)}), '') AS emotion_words,
 coalesce(string_agg(keyword, '|' ORDER BY ord) FILTER (WHERE keyword IN {text(ACOUSTIC_DOMINANT)}), '') AS acoustic_words FROM kws GROUP BY 1""")
def u2(t):
    both = lambda k: F.array_join(F.array_intersect("keywords", F.lit(k)), "|")
    return plan_prompts(t.prompt_rows).select(
        "query_id", both(EMOTION_DOMINANT).alias("emotion_words"), both(ACOUSTIC_DOMINANT).alias("acoustic_words")
    )
