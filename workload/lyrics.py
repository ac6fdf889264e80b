"""Lyrics text, sources, chunks and emotions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions import text as tx
from tonelake.operators import emotion as em
from tonelake.operators import lyrics as ly
from tonelake.rules import BAD_LYRICS, EMOTION_VALENCE, INSTRUMENTAL_ARTISTS
from tonelake.sources import files as fl
from tonelake.sources import lyrics_cache as lc
from workload.registry import q, query, r, rule
from workload.views import duck

# the stand-in lexicon of the checks: words that do occur in the given texts
LEXICON = dict(zip(EMOTION_VALENCE, [["the"], ["and", "le"], ["of", "de"], ["that", "der"], ["in"], ["to", "die"], ["er", "la"]]))
LYRICS = f"WITH {duck('lyrics')}"
TAGS = f"WITH {duck('tags')}"


def S(x: str) -> str:
    return f"regexp_replace({x}, '^\\s+|\\s+$', '', 'g')"


def drop(x: str, patterns: list[str]) -> str:
    for p in patterns:
        x = f"regexp_replace({x}, '{p.replace(chr(39), chr(39) * 2)}', '', 'g')"
    return x


def clean_title_sql(x: str) -> str:
    return S(f"regexp_replace({drop(S(f'coalesce({x}, chr(32))'), [tx.TRACK_NUMBER, *tx.TITLE_TAGS])}, '\\s+', ' ', 'g')")


@query("T1_title_cleaning", TAGS + f" SELECT id, {clean_title_sql('title')} AS title FROM tags")
def t1(t):
    return t.tags.select("id", tx.clean_title(F.col("title")).alias("title"))


@query("T2_artist_cleaning", TAGS + f" SELECT id, {S(drop('artist', tx.ARTIST_TAGS))} AS artist FROM tags")
def t2(t):
    return t.tags.select("id", tx.clean_artist(F.col("artist")).alias("artist"))


def lookup_sql(x: str) -> str:
    return S(f"regexp_split_to_array({drop(f'coalesce({x}, chr(32))', tx.LOOKUP_TAGS)}, '[;/&,]')[1]")


@query("T3_lookup_cleaning", TAGS + f" SELECT id, {lookup_sql('title')} AS title, {lookup_sql('artist')} AS artist FROM tags")
def t3(t):
    return t.tags.select("id", tx.clean_lookup(F.col("title")).alias("title"), tx.clean_lookup(F.col("artist")).alias("artist"))


LINES = f"""
ln AS (SELECT song_id, unnest(string_split(lyrics_text, chr(10))) AS raw, generate_subscripts(string_split(lyrics_text, chr(10)), 1) AS i FROM lyrics),
c1 AS (SELECT song_id, i, {S('raw')} AS x FROM ln),
c2 AS (SELECT song_id, i, {S(f"regexp_replace(x, '{tx.TIMESTAMP}', '', 'g')")} AS x FROM c1 WHERE x <> '' AND NOT regexp_matches(x, '{tx.SECTION_HEADER}')),
c3 AS (SELECT song_id, i, x FROM c2 WHERE length(x) >= 5 AND {' AND '.join(f"NOT regexp_matches(x, '{p}')" for p in tx.LINE_NOISE)}),
cleaned AS (SELECT l.song_id, l.lyrics_text, coalesce(c.t, '') AS t FROM lyrics l LEFT JOIN (SELECT song_id, string_agg(x, chr(10) ORDER BY i) AS t FROM c3 GROUP BY 1) c USING (song_id))"""


@query("T4_lyrics_cleaning", LYRICS + f", {LINES} SELECT song_id, t AS lyrics FROM cleaned")
def t4(t):
    return t.lyrics.select("song_id", tx.clean_lyrics(F.col("lyrics_text")).alias("lyrics"))


@query("T5_lrc_stripping", f"""WITH {duck('lookup_results')}, a AS (SELECT row_number() OVER () AS k, song_id, source, synced FROM lookup_results),
ln AS (SELECT k, unnest(string_split(synced, chr(10))) AS raw, generate_subscripts(string_split(synced, chr(10)), 1) AS i FROM a),
x AS (SELECT k, i, {S(f"regexp_replace(raw, '{tx.LRC_TIMESTAMP}', '', 'g')")} AS x FROM ln WHERE NOT regexp_matches(raw, '{tx.LRC_METADATA}'))
SELECT a.song_id, a.source, (SELECT string_agg(x.x, chr(10) ORDER BY i) FROM x WHERE x.k = a.k AND x.x <> '') AS lyrics FROM a""")
def t5(t):
    return t.lookup_results.select("song_id", "source", tx.strip_lrc(F.col("synced")).alias("lyrics"))


def valid_sql(x: str) -> str:
    bad = " AND ".join(f"NOT contains(left(lower({x}), 200), '{p.replace(chr(39), chr(39) * 2)}')" for p in BAD_LYRICS)
    return f"(length({x}) >= 50 AND len(list_filter(string_split({x}, chr(10)), lambda z: {S('z')} <> '')) >= 3 AND {bad})"


def instrumental_sql(x: str) -> str:
    return "(" + " OR ".join(f"contains(lower(coalesce({x}, '')), '{w}')" for w in INSTRUMENTAL_ARTISTS) + ")"


@query("T6_lyrics_quality", f"WITH {duck('lookup_results')} SELECT song_id, source, text, {valid_sql('text')} AS valid FROM lookup_results")
def t6(t):
    return t.lookup_results.select("song_id", "source", "text", tx.is_valid_lyrics(F.col("text")).alias("valid"))


@query("T7_instrumental_artist", TAGS + f" SELECT id, {instrumental_sql('artist')} AS skip FROM tags")
def t7(t):
    return t.tags.select("id", tx.is_instrumental_artist(F.col("artist")).alias("skip"))


REPEATS = f"""{LINES},
m AS (SELECT song_id, x, row_number() OVER (PARTITION BY song_id ORDER BY i) - 1 AS pos, count(*) OVER (PARTITION BY song_id) AS n FROM c3 WHERE length(x) > 8),
rep AS (SELECT song_id, x, abs(2 * sum(pos) - count(*) * max(n))::DOUBLE / count(*) AS key, min(pos) AS first FROM m GROUP BY 1, 2 HAVING count(*) > 1),
top AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY key, first) AS k FROM rep)"""


SNIPPET = f"""{REPEATS},
a AS (SELECT song_id, string_agg(x, ' ' ORDER BY k) AS s FROM top WHERE k <= 5 GROUP BY 1),
b AS (SELECT song_id, string_agg(x, ' ' ORDER BY pos) AS s FROM m WHERE pos >= greatest(0, n // 2 - 2) AND pos < least(n, n // 2 + 3) GROUP BY 1)
SELECT c.song_id, CASE WHEN length({S('c.lyrics_text')}) < 20 OR length(t) < 20 THEN '' ELSE left(coalesce(a.s, b.s, ''), 600) END AS snippet
FROM cleaned c LEFT JOIN a USING (song_id) LEFT JOIN b USING (song_id)"""


@query("T8_chorus_snippet", LYRICS + f", {SNIPPET}")
def t8(t):
    return ly.with_snippet(t.lyrics).select("song_id", "snippet")


@query("Window3_line_positions", LYRICS + f", {REPEATS} SELECT song_id, x AS line, CAST(pos AS INT) AS pos, {q('pos / n')} AS place FROM m")
def w3(t):
    rows = t.lyrics.select("song_id", F.filter(tx.lyric_lines(F.col("lyrics_text")), lambda x: F.length(x) > 8).alias("m"))
    rows = rows.select("song_id", F.size("m").alias("n"), F.posexplode_outer("m").alias("pos", "line")).filter("pos IS NOT NULL")
    return rows.select("song_id", "line", "pos", r(F.col("pos") / F.col("n")).alias("place"))


@query("O5_chorus_lines", LYRICS + f", {REPEATS} SELECT song_id, CAST(k AS INT) AS rank, x AS line FROM top WHERE k <= 5")
def o5(t):
    """The repeated lines as rows: counted per (song, line), so no song's lines are gathered raw."""
    from pyspark.sql import Window

    rows = t.lyrics.select("song_id", F.filter(tx.lyric_lines(F.col("lyrics_text")), lambda x: F.length(x) > 8).alias("m"))
    rows = rows.select("song_id", F.size("m").alias("n"), F.posexplode_outer("m").alias("pos", "line")).filter("pos IS NOT NULL")
    lines = rows.groupBy("song_id", "line").agg(
        F.count("*").alias("c"), F.sum("pos").alias("s"), F.min("pos").alias("first"), F.first("n").alias("n")
    ).filter(F.col("c") > 1)
    key = F.abs(F.col("s") * 2 - F.col("c") * F.col("n")) / F.col("c")
    w = Window.partitionBy("song_id").orderBy(key, "first")
    return lines.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= 5).select("song_id", "rank", "line")


def chunks_sql(source: str) -> str:
    """Chunks of source(song_id, body), stripped bodies of 10 chars or more."""
    piece = "struct_pack(chunks := []::VARCHAR[], open := '', s := {s}, sep := {sep}, cost := {cost}, flush := {flush})"
    whole = piece.format(s="p", sep="chr(10) || chr(10)", cost=2, flush="false")
    line = piece.format(s="z", sep="chr(10)", cost=1, flush="k = 1")
    add = lambda c, x: f"CASE WHEN {x} = '' THEN {c} ELSE list_append({c}, {S(x)}) END"
    c0 = f"CASE WHEN x.flush THEN {add('a.chunks', 'a.open')} ELSE a.chunks END"
    o0 = "CASE WHEN x.flush THEN '' ELSE a.open END"
    fits = f"length({o0}) + length(x.s) + x.cost <= 2500"
    step = (
        f"struct_pack(chunks := CASE WHEN {fits} THEN {c0} ELSE {add(f'({c0})', f'({o0})')} END, "
        f"open := CASE WHEN {fits} THEN CASE WHEN ({o0}) = '' THEN x.s ELSE ({o0}) || x.sep || x.s END ELSE x.s END, s := '', sep := '', cost := 0, flush := false)"
    )
    return f"""
paras AS (SELECT song_id, body, unnest(string_split(body, chr(10) || chr(10))) AS p, generate_subscripts(string_split(body, chr(10) || chr(10)), 1) AS j FROM {source} WHERE length(body) > 2500),
items AS (SELECT song_id, j, 1 AS k, {whole} AS it FROM paras WHERE length(p) <= 2500
  UNION ALL SELECT song_id, j, k, {line} FROM (SELECT song_id, j, unnest(string_split(p, chr(10))) AS z, generate_subscripts(string_split(p, chr(10)), 1) AS k FROM paras WHERE length(p) > 2500)),
folded AS (SELECT song_id, list_reduce(list_prepend({piece.format(s="''", sep="''", cost=0, flush='false')}, list(it ORDER BY j, k)), lambda a, x: {step}) AS f FROM items GROUP BY 1),
packed AS (SELECT song_id, list_filter({add('f.chunks', S('f.open')).replace("list_append", "list_append")}, lambda c: length(c) >= 30) AS c FROM folded),
chunked AS (SELECT s.song_id, CASE WHEN length(body) <= 2500 THEN [body] WHEN len(c) > 0 THEN c ELSE [left(body, 2500)] END AS c FROM {source} s LEFT JOIN packed USING (song_id)),
chunks AS (SELECT song_id, len(c) AS n_chunks, unnest(c) AS chunk, generate_subscripts(c, 1) - 1 AS chunk_idx FROM chunked)"""


RAW_CHUNKS = f"bodies AS (SELECT song_id, {S('lyrics_text')} AS body FROM lyrics WHERE length({S('lyrics_text')}) >= 10), {chunks_sql('bodies')}"


@query("T9_chunking", LYRICS + f", {RAW_CHUNKS} SELECT song_id, CAST(n_chunks AS INT) AS n_chunks, CAST(chunk_idx AS INT) AS chunk_idx, chunk FROM chunks")
def t9(t):
    return ly.explode_chunks(t.lyrics)


@query("T10_json_decode", """SELECT event_id, TRY_CAST(props ->> 'k' AS DOUBLE) AS k, false AS broken FROM events WHERE event_id % 2 = 0
 UNION ALL SELECT event_id, NULL, true FROM events WHERE event_id % 2 = 1""")
def t10(t):
    """Every second text is cut so that it is no JSON any more."""
    broken = F.when(F.col("event_id") % 2 == 1, F.regexp_replace("props", ".$", "")).otherwise(F.col("props"))
    decoded = em.decode_distribution(broken)
    return t.events.select("event_id", F.try_element_at(decoded, F.lit("k")).alias("k"), decoded.isNull().alias("broken"))


ANALYSED = f"""{LINES},
texts AS (SELECT song_id, CASE WHEN t = '' THEN lyrics_text ELSE t END AS x FROM cleaned),
bodies AS (SELECT song_id, {S('x')} AS body FROM texts WHERE length({S('x')}) >= 10), {chunks_sql('bodies')},
words AS (SELECT song_id, chunk_idx, n_chunks, regexp_extract_all(lower(chunk), '[a-z'']+') AS w FROM chunks),
hits AS (SELECT song_id, chunk_idx, n_chunks, label, len(list_filter(w, lambda z: list_contains(ws, z))) AS n
  FROM words CROSS JOIN (VALUES {', '.join(f"('{k}', {v})" for k, v in LEXICON.items())}) AS lex(label, ws)),
scored AS (SELECT song_id, chunk_idx, n_chunks, label, coalesce(n / nullif(sum(n) OVER (PARTITION BY song_id, chunk_idx), 0), 0)::DOUBLE AS score FROM hits)"""


def scored(t):
    texts = t.lyrics.select("song_id", ly.analysis_text(F.col("lyrics_text")).alias("body"))
    return em.lexicon_scores(ly.explode_chunks(texts, "body"), LEXICON)


@query("T11_chunk_scores", LYRICS + f", {ANALYSED} SELECT song_id, CAST(chunk_idx AS INT) AS chunk_idx, label, {q('score')} AS score FROM scored")
def t11(t):
    return scored(t).select("song_id", "chunk_idx", "label", r(F.col("score")).alias("score"))


def averages_sql(source: str) -> str:
    """Average per label, rounded to nine digits, and its rank."""
    return f"""
{rule('emotion_valence')}, {rule('emotion_words')},
songs_of AS (SELECT song_id, max(n_chunks) AS n FROM {source} GROUP BY 1),
av AS (SELECT s.song_id, v.emotion, v.emotion_ord, v.valence, round(coalesce(sum(c.score), 0) / max(s.n), 9) AS a
  FROM songs_of s CROSS JOIN emotion_valence v LEFT JOIN {source} c ON c.song_id = s.song_id AND c.label = v.emotion GROUP BY 1, 2, 3, 4),
rk AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY a DESC, emotion_ord) AS k FROM av),
summary AS (SELECT song_id, max(emotion) FILTER (WHERE k = 1) AS lyrics_emotion, max(a) FILTER (WHERE k = 1) AS lyrics_emotion_score,
  max(emotion) FILTER (WHERE k = 2) AS second_emotion, max(a) FILTER (WHERE k = 2) AS second_score, {q('sum(a * valence)', 9)} AS lyrics_valence FROM rk GROUP BY 1),
wordy AS (SELECT s.*, concat_ws('|', (SELECT string_agg(word, '|' ORDER BY word_ord) FROM emotion_words e WHERE e.emotion = s.lyrics_emotion AND word_ord < 2),
  CASE WHEN second_score > 0.2 THEN (SELECT word FROM emotion_words e WHERE e.emotion = s.second_emotion AND word_ord = 0) END) AS mood_words FROM summary s)"""


SCORES = f"WITH {duck('chunk_scores')}, {averages_sql('chunk_scores')} "


def summary(t):
    return em.summarise_emotions(em.average_emotions(t.chunk_scores))


@query("A9_emotion_average", SCORES + f"SELECT song_id, emotion, {q('a')} AS average FROM av")
def a9(t):
    rows = [F.struct(F.lit(e).alias("emotion"), r(F.get("avg", F.lit(i))).alias("average")) for i, e in enumerate(em.LABELS)]
    return em.average_emotions(t.chunk_scores).select("song_id", F.inline(F.array(*rows)))


@query("A10_dominant_emotion", SCORES + f"SELECT song_id, lyrics_emotion, {q('lyrics_emotion_score')} AS score, CASE WHEN second_score > 0.2 THEN second_emotion END AS second_emotion FROM summary")
def a10(t):
    second = F.when(F.col("second_score") > em.SECOND_EMOTION, F.col("second_emotion"))
    return summary(t).select("song_id", "lyrics_emotion", r(F.col("lyrics_emotion_score")).alias("score"), second.alias("second_emotion"))


@query("A11_lyrics_valence", SCORES + f"SELECT song_id, {q('lyrics_valence')} AS valence FROM summary")
def a11(t):
    return summary(t).select("song_id", r(F.col("lyrics_valence")).alias("valence"))


@query("T12_mood_words", SCORES + "SELECT song_id, mood_words FROM wordy")
def t12(t):
    return summary(t).select("song_id", F.array_join("mood_words", "|").alias("mood_words"))


@query("A9_emotions_of_texts", LYRICS + f", {ANALYSED}, {averages_sql('scored')} SELECT song_id, lyrics_emotion, {q('lyrics_emotion_score')} AS score, {q('lyrics_valence')} AS valence, mood_words FROM wordy")
def emotions_of_texts(t):
    s = em.summarise_emotions(em.average_emotions(scored(t)))
    return s.select(
        "song_id", "lyrics_emotion", r(F.col("lyrics_emotion_score")).alias("score"),
        r(F.col("lyrics_valence")).alias("valence"), F.array_join("mood_words", "|").alias("mood_words"),
    )


# ---------------------------------------------------------------- sources

_PRI = "CASE source " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in ly.SOURCE_PRIORITY.items()) + " END"


@query("L1_source_resolution", f"""WITH {duck('lyrics_sources')}, lyrics AS (SELECT ordinal AS song_id, song_id AS sid, source, text AS lyrics_text FROM lyrics_sources), {LINES},
x AS (SELECT l.sid, l.song_id AS ordinal, l.source, {_PRI} AS p, CASE source WHEN 'cache' THEN {S('l.lyrics_text')} WHEN 'sidecar_lrc' THEN c.t ELSE l.lyrics_text END AS text FROM lyrics l JOIN cleaned c USING (song_id)),
k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY p, ordinal) AS n FROM x WHERE text <> '' OR starts_with(source, 'sidecar'))
SELECT sid AS song_id, source, nullif(text, '') AS lyrics_text FROM k WHERE n = 1""")
def l1(t):
    return ly.resolve_sources(t.lyrics_sources, ordinal="ordinal")


def _song_texts(t):
    """Songs of which a quarter has a stored text, and what other sources hold for them."""
    stored = F.when(F.col("id") % 4 == 0, F.col("text")).when(F.col("id") % 4 == 1, F.lit(""))
    songs = t.cache_songs.select("id", "filepath", "title", "artist", stored.alias("lyrics_text"))
    return songs, t.lyrics_sources.select(F.col("song_id").alias("id"), "source", "ordinal", "text")


_FOUND = f"""WITH {duck('lyrics_sources', 'cache', 'cache_songs')}, songs AS (SELECT id, filepath, title, artist, CASE id % 4 WHEN 0 THEN text WHEN 1 THEN '' END AS lyrics_text,
  left(md5(concat(filepath, '|', coalesce(title, 'None'), '|', artist)), 16) AS cache_key FROM cache_songs),
waiting AS (SELECT * FROM songs WHERE coalesce(lyrics_text, '') = ''),
lyrics AS (SELECT ordinal AS song_id, song_id AS sid, source, text AS lyrics_text FROM lyrics_sources WHERE source NOT IN ('stored', 'cache')), {LINES},
x AS (SELECT l.sid, l.song_id AS ordinal, l.source, {_PRI} AS p, CASE source WHEN 'sidecar_lrc' THEN c.t ELSE l.lyrics_text END AS text FROM lyrics l JOIN cleaned c USING (song_id)
  UNION ALL SELECT w.id, 0, 'cache', {ly.SOURCE_PRIORITY['cache']}, {S('c.text')} FROM waiting w JOIN cache c USING (cache_key)),
k AS (SELECT *, row_number() OVER (PARTITION BY sid ORDER BY p, ordinal) AS n FROM x WHERE sid IN (SELECT id FROM waiting) AND (text <> '' OR starts_with(source, 'sidecar'))),
found AS (SELECT sid AS id, source, text AS lyrics_text FROM k WHERE n = 1 AND text <> '')"""


@query("L1_lyrics_of_songs", _FOUND + " SELECT id, source, lyrics_text FROM found UNION ALL SELECT id, 'stored', lyrics_text FROM songs WHERE lyrics_text <> ''")
def l1_songs(t):
    songs, others = _song_texts(t)
    return lc.song_lyrics(songs, others, t.cache, "ordinal")


@query("L1_write_back_to_songs", _FOUND + " SELECT s.id, s.filepath, s.title, s.artist, coalesce(f.lyrics_text, s.lyrics_text) AS lyrics_text FROM songs s LEFT JOIN found f USING (id)")
def l1_write_songs(t):
    songs, others = _song_texts(t)
    return lc.write_back(songs, lc.song_lyrics(songs, others, t.cache, "ordinal"))


@query("L1_write_back_to_cache", _FOUND + """ SELECT cache_key, text FROM cache UNION ALL SELECT s.cache_key, min(f.lyrics_text) FROM found f JOIN songs s USING (id)
 WHERE f.source <> 'cache' AND s.cache_key NOT IN (SELECT cache_key FROM cache) GROUP BY 1""")
def l1_write_cache(t):
    songs, others = _song_texts(t)
    return t.cache.unionByName(lc.cache_additions(songs, lc.song_lyrics(songs, others, t.cache, "ordinal"), t.cache))


_LPRI = "CASE source " + " ".join(f"WHEN '{s}' THEN {p}" for s, p in ly.LOOKUP_PRIORITY.items()) + " END"


def lookup_rows_sql(rows: str) -> str:
    """CTEs up to ``k``: usable texts of rows (song_id, source, ordinal, title, artist, text, synced), the first of a song with n = 1."""
    return f"""u AS (SELECT * FROM {rows}),
lrc AS (SELECT ordinal, unnest(string_split(synced, chr(10))) AS raw, generate_subscripts(string_split(synced, chr(10)), 1) AS i FROM u),
z AS (SELECT ordinal, string_agg({S(f"regexp_replace(raw, '{tx.LRC_TIMESTAMP}', '', 'g')")}, chr(10) ORDER BY i) FILTER (WHERE {S(f"regexp_replace(raw, '{tx.LRC_TIMESTAMP}', '', 'g')")} <> '') AS plain
  FROM lrc WHERE NOT regexp_matches(raw, '{tx.LRC_METADATA}') GROUP BY 1),
x AS (SELECT u.song_id, u.ordinal, u.source, u.title, u.artist, {_LPRI.replace('source', 'u.source')} AS p, CASE u.source WHEN 'lrclib' THEN CASE WHEN length(text) > 20 THEN {S('text')} ELSE z.plain END
   WHEN 'musixmatch' THEN {S("string_split(text, '*******')[1]")} ELSE {S('text')} END AS text FROM u LEFT JOIN z USING (ordinal)),
k AS (SELECT *, row_number() OVER (PARTITION BY song_id ORDER BY p, ordinal) AS n FROM x WHERE title <> '' AND NOT {instrumental_sql('artist')}
   AND (source NOT IN ('ovh', 'genius_title') OR {lookup_sql('artist')} <> '') AND {valid_sql('text')})"""


@query("L2_lookup_fallback", f"WITH {duck('lookup_results')}, {lookup_rows_sql('lookup_results')} SELECT song_id, source, text AS lyrics_text FROM k WHERE n = 1")
def l2(t):
    return ly.resolve_lookup(t.lookup_results, ordinal="ordinal")


CACHE = f"WITH {duck('cache', 'cache_songs')}, keyed AS (SELECT *, left(md5(concat(filepath, '|', coalesce(title, 'None'), '|', artist)), 16) AS cache_key FROM cache_songs)"


@query("S8_cache_key", CACHE + " SELECT id, cache_key FROM keyed")
def s8(t):
    return lc.keyed(t.cache_songs).select("id", "cache_key")


@query("S8b_cache_read", CACHE + f" SELECT id, nullif({S('c.text')}, '') AS cached_text FROM keyed k LEFT JOIN cache c USING (cache_key)")
def s8b(t):
    return lc.cached_lyrics(t.cache_songs.drop("text"), t.cache).select("id", "cached_text")


@query("S8b_cache_write_through", CACHE + " SELECT cache_key, text FROM cache UNION ALL SELECT cache_key, text FROM keyed WHERE cache_key NOT IN (SELECT cache_key FROM cache)")
def s8b_write(t):
    return t.cache.unionByName(lc.new_entries(t.cache_songs, t.cache))


@query("S9_cache_stats", "SELECT count(*) AS entries, round(CAST(sum(strlen(text)) AS DOUBLE) / 1048576, 2) AS size_mb FROM documents")
def s9(t):
    return lc.cache_stats(t.documents)


@query("S5_sidecar_lyrics", f"""WITH {duck('tags')}, side AS (SELECT doc_id, concat('/music/Brand#', doc_id % 25, '/', doc_id, '.v2') AS base, CASE WHEN doc_id % 2 = 0 THEN 'sidecar_lrc' ELSE 'sidecar_txt' END AS source, text FROM documents)
SELECT t.id AS song_id, source, text FROM tags t JOIN side ON base = regexp_replace(t.filepath, '\\.[^./]*$', '')""")
def s5(t):
    """Sidecar rows as the file reader gives them, derived from the documents."""
    side = t.documents.select(
        F.concat(F.lit("/music/Brand#"), (F.col("doc_id") % 25).cast("string"), F.lit("/"), F.col("doc_id").cast("string"), F.lit(".v2")).alias("base"),
        F.when(F.col("doc_id") % 2 == 0, "sidecar_lrc").otherwise("sidecar_txt").alias("source"), "text",
    )
    return fl.sidecar_candidates(t.tags, side)


@query("A12_lyrics_outcomes", f"WITH {duck('progress_events')} SELECT count(*) FILTER (WHERE outcome = 'found') AS found, count(*) FILTER (WHERE outcome = 'not_found') AS not_found, count(*) FILTER (WHERE outcome = 'error') AS errors, count(*) FILTER (WHERE outcome <> 'other') AS total FROM progress_events")
def a12(t):
    from tonelake.operators.maintenance import lyrics_outcomes

    return lyrics_outcomes(t.progress_events)


