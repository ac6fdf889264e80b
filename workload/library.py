"""Browsing, counting, listing."""

from __future__ import annotations

from pyspark.sql import functions as F

from tonelake.functions.numbers import text_or
from tonelake.operators import library as lib
from tonelake.plans.ranking import match_quality
from workload.registry import q, query, r, rule, text
from workload.views import duck

TAGS = f"WITH {duck('tags')}"
SONGS = f"WITH {duck('songs')}"


@query("P1_metadata_defaults", TAGS + """ SELECT id,
 CASE WHEN coalesce(title, '') <> '' THEN title ELSE
   (SELECT CASE WHEN strpos(ltrim(f, '.'), '.') > 0 THEN left(f, length(f) - strpos(reverse(f), '.')) ELSE f END FROM (SELECT list_last(string_split(filepath, '/')) AS f)) END AS title,
 coalesce(nullif(artist, ''), 'Unknown Artist') AS artist, coalesce(nullif(album, ''), 'Unknown Album') AS album, coalesce(genre, '') AS genre FROM tags""")
def p1(t):
    return lib.default_tags(t.tags).select("id", "title", "artist", "album", "genre")


@query("P2_song_response", SONGS + """ SELECT id, title, artist, album, genre, filepath, bpm, energy, valence, arousal, has_lyrics,
 CAST(NULL AS DOUBLE) AS score, CAST(NULL AS DOUBLE) AS semantic_score, 'unknown' AS match_quality FROM songs""")
def p2(t):
    return lib.song_response(t.songs)


@query("P2_tag_response", TAGS + """ SELECT id, coalesce(nullif(title, ''), 'Unknown') AS title, coalesce(nullif(artist, ''), 'Unknown') AS artist,
 coalesce(nullif(album, ''), 'Unknown') AS album, coalesce(genre, '') AS genre FROM tags""")
def p2_tags(t):
    return t.tags.select(
        "id", *[text_or(F.col(c), "Unknown").alias(c) for c in ("title", "artist", "album")], text_or(F.col("genre"), "").alias("genre")
    )


@query("P3_match_tier", """SELECT event_id, CASE WHEN value IS NULL THEN 'unknown' WHEN value >= 60 THEN 'high' WHEN value >= 35 THEN 'medium' ELSE 'low' END AS match_quality FROM events""")
def p3(t):
    return t.events.select("event_id", match_quality(F.col("value")).alias("match_quality"))


@query("P3b_score_band", """SELECT event_id, CASE WHEN coalesce(value, 0) = 0 THEN 'muted' WHEN value >= 70 THEN 'emerald' WHEN value >= 50 THEN 'amber' WHEN value >= 35 THEN 'orange' ELSE 'red' END AS band FROM events""")
def p3b(t):
    return t.events.select("event_id", lib.score_band(F.col("value")).alias("band"))


@query("P4_percent_views", SONGS + " SELECT id, CAST(floor(energy * 100 + 0.5) AS BIGINT) AS energy_percent, CAST(floor((valence + 1) * 50 + 0.5) AS BIGINT) AS mood_percent FROM songs")
def p4(t):
    energy, mood = lib.percent_views(F.col("energy"), F.col("valence"))
    return t.songs.select("id", energy.alias("energy_percent"), mood.alias("mood_percent"))


@query("P5_duration_text", TAGS + """ SELECT id, CASE WHEN seconds = 0 THEN '--:--' ELSE printf('%d:%02d', CAST(floor(seconds / 60) AS INT), CAST(seconds AS INT) % 60) END AS short,
 CASE WHEN seconds >= 3600 THEN printf('%d:%02d:%02d', CAST(floor(seconds / 3600) AS INT), CAST(floor(seconds % 3600 / 60) AS INT), CAST(seconds AS INT) % 60)
 ELSE printf('%d:%02d', CAST(floor(seconds / 60) AS INT), CAST(seconds AS INT) % 60) END AS long
 FROM (SELECT id, (seconds - 37) * 3 AS seconds FROM tags)""")
def p5(t):
    s = (F.col("seconds") - 37) * 3
    return t.tags.select("id", lib.duration_text(s).alias("short"), lib.duration_text_long(s).alias("long"))


@query("P12_lookup_by_ids", SONGS + ", picked AS (SELECT DISTINCT o_custkey AS id FROM orders WHERE o_totalprice > 150000) SELECT id, title FROM songs WHERE id IN (SELECT id FROM picked)")
def p12(t):
    picked = t.orders.filter(F.col("o_totalprice") > 150000).select(F.col("o_custkey").alias("id"))
    return lib.songs_in(t.songs, picked).select("id", "title")


@query("P12_lookup_by_path", SONGS + " SELECT id, title FROM songs WHERE filepath = '/music/5/5.flac'")
def p12_path(t):
    return t.songs.filter(F.col("filepath") == "/music/5/5.flac").select("id", "title")


@query("P13_without_lyrics", SONGS + " SELECT id FROM songs WHERE NOT has_lyrics AND (lyrics_text IS NULL OR lyrics_text = '')")
def p13(t):
    return lib.without_lyrics(t.songs).select("id")


@query("P14_pending_reprocess", SONGS + " SELECT id FROM songs WHERE NOT lyrics_processed")
def p14(t):
    return lib.pending(t.songs).select("id")


@query("P15_library_search", TAGS + " SELECT id, title FROM tags WHERE concat_ws(chr(1), lower(coalesce(title, '')), lower(coalesce(artist, '')), lower(coalesce(album, '')), lower(coalesce(genre, ''))) LIKE '%eco%'")
def p15(t):
    return t.tags.filter(lib.matches_text("ECO")).select("id", "title")


@query("P15_library_search_without_genre", TAGS + " SELECT id, title FROM tags WHERE lower(coalesce(title, '')) LIKE '%ring%' OR lower(coalesce(artist, '')) LIKE '%ring%' OR lower(coalesce(album, '')) LIKE '%ring%'")
def p15_short(t):
    return t.tags.filter(lib.matches_text("ring", ("title", "artist", "album"))).select("id", "title")


@query("P16_lyrics_lookup", SONGS + " SELECT id, CASE WHEN lyrics_text <> '' THEN lyrics_text END AS lyrics_text FROM songs")
def p16(t):
    return lib.stored_lyrics(t.songs)


@query("A1_library_stats", f"WITH {duck('songs', 'folders')} SELECT (SELECT count(*) FROM songs) AS song_count, (SELECT count(*) FROM songs WHERE clap_embedding IS NOT NULL) AS clap_count, (SELECT count(*) FROM folders) AS folder_count, (SELECT count(*) = 0 FROM songs) AS is_empty")
def a1(t):
    return lib.library_stats(t.songs, t.folders)


@query("A2_progress_breakdown", SONGS + " SELECT (SELECT count(*) FROM songs WHERE bpm IS NOT NULL) AS with_audio, (SELECT count(*) FROM songs WHERE has_lyrics) AS with_lyrics")
def a2(t):
    return lib.progress_counts(t.songs)


@query("A13_folder_rollup", TAGS + """, a AS (SELECT filepath, string_split(filepath, '/') AS p FROM tags),
 d AS (SELECT filepath, unnest(range(1, greatest(len(p), 2))) AS n, p FROM a)
 SELECT path, bool_or(lower(filepath) LIKE '%.mp3' OR lower(filepath) LIKE '%.flac' OR lower(filepath) LIKE '%.wav' OR lower(filepath) LIKE '%.m4a' OR lower(filepath) LIKE '%.ogg') AS has_audio
 FROM (SELECT filepath, CASE WHEN n = 1 THEN '/' ELSE array_to_string(p[1:n], '/') END AS path FROM d) GROUP BY 1""")
def a13(t):
    return lib.folder_rollup(t.tags)


@query("A13_browse_directory", TAGS + """, x AS (SELECT substr(filepath, 8) AS rest FROM tags WHERE starts_with(filepath, '/music/')),
 e AS (SELECT string_split(rest, '/')[1] AS name, contains(rest, '/') AS is_dir, regexp_matches(lower(rest), '\\.(mp3|flac|wav|m4a|ogg)$') AS audio FROM x)
 SELECT name, concat('/music/', name) AS path, is_dir, is_dir AND bool_or(audio) AS has_audio FROM e WHERE NOT starts_with(name, '.') GROUP BY name, is_dir""")
def a13_browse(t):
    return lib.browse(t.tags, "/music")


@query("A13_browse_files", TAGS + """, x AS (SELECT substr(filepath, 16) AS name FROM tags WHERE starts_with(filepath, '/music/Brand#2/'))
 SELECT DISTINCT name, concat('/music/Brand#2/', name) AS path, false AS is_dir, false AS has_audio FROM x WHERE NOT starts_with(name, '.')""")
def a13_files(t):
    return lib.browse(t.tags, "/music/Brand#2/")


# Names as libraries have them: some in capitals, some with accents.
_MIXED = "CASE WHEN id % 7 = 2 THEN upper({0}) WHEN id % 7 = 4 THEN replace({0}, 'e', 'é') WHEN id % 7 = 5 THEN replace({0}, 'o', 'Ö') ELSE {0} END AS {0}"


def _ordered(name: str, by: str, sql_key: str):
    columns = ", ".join(_MIXED.format(c) for c in ("title", "artist", "album"))

    @query(name, TAGS + f", m AS (SELECT id, {columns} FROM tags) SELECT id, title, artist, album, row_number() OVER (ORDER BY {sql_key}) AS rank FROM m")
    def run(t):
        rows = t.tags.select("id", *[F.expr(_MIXED.format(c)) for c in ("title", "artist", "album")])
        return lib.with_rank(rows, lib.library_order(by))


_ordered("O2_sort_by_title", "title", "coalesce(title, '') COLLATE \"en\", id")
_ordered("O2_sort_by_artist", "artist", "coalesce(artist, '') COLLATE \"en\", id")
_ordered("O2_sort_by_album", "album", "coalesce(album, '') COLLATE \"en\", id")
_ordered("O2_sort_by_recent", "recent", "id DESC")


@query("O3_song_list", SONGS + " SELECT id, title FROM songs ORDER BY id LIMIT 500")
def o3(t):
    return lib.list_songs(t.songs).select("id", "title")


@query("O4_folder_list", f"WITH {duck('folders')} SELECT path, last_scan_time, CASE WHEN coalesce(last_scan_time, 0) = 0 THEN 'Unknown' ELSE strftime(make_timestamp(CAST(last_scan_time * 1000000 AS BIGINT)), '%Y-%m-%d %H:%M') END AS last_scan_formatted, song_count, total_songs_in_db, row_number() OVER (ORDER BY last_scan_time DESC NULLS LAST, path) AS rank FROM folders")
def o4(t):
    return lib.folder_list(t.folders)


@query("S2_catalog_read", SONGS + " SELECT id, filepath, file_mtime, title, artist, album, genre, bpm, energy, brightness, valence, arousal, mode FROM songs")
def s2(t):
    return t.songs.select("id", "filepath", "file_mtime", "title", "artist", "album", "genre", "bpm", "energy", "brightness", "valence", "arousal", "mode")


@query("S3_text_vectors", SONGS + f" SELECT id, len(embedding) AS dims, {q('list_sum(list_transform(embedding, lambda x: x::DOUBLE))')} AS total FROM songs WHERE embedding IS NOT NULL")
def s3(t):
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x)
    return t.songs.filter(F.col("embedding").isNotNull()).select("id", F.size("embedding").cast("long").alias("dims"), r(total).alias("total"))


@query("S3_audio_vectors", SONGS + f" SELECT id, {q('list_sum(list_transform(clap_embedding, lambda x: x::DOUBLE))')} AS total FROM songs WHERE clap_embedding IS NOT NULL")
def s3_audio(t):
    total = F.aggregate("clap_embedding", F.lit(0.0), lambda a, x: a + x)
    return t.songs.filter(F.col("clap_embedding").isNotNull()).select("id", r(total).alias("total"))


@query("J6_semi_join_ids", SONGS + ", x AS (SELECT DISTINCT user_id FROM events WHERE event_type = 'click') SELECT id FROM songs WHERE id IN (SELECT user_id FROM x)")
def j6(t):
    ids = t.events.filter(F.col("event_type") == "click").select(F.col("user_id").alias("id"))
    return lib.songs_in(t.songs, ids).select("id")


@query("J2_genre_keyword_match", TAGS + f", {rule('genre_keywords')} SELECT DISTINCT t.id, k.genre FROM tags t JOIN genre_keywords k ON contains(lower(coalesce(t.genre, '')), k.keyword) OR contains(lower(coalesce(t.artist, '')), k.keyword)")
def j2_genre(t):
    from tonelake.plans.signals import song_genres
    from tonelake.rules import default_rulebook

    rules = default_rulebook()
    number = F.explode_outer(song_genres(rules)).alias("number")
    return t.tags.select("id", number).filter("number IS NOT NULL").select("id", F.get(F.lit(list(rules.genres)), F.col("number")).alias("genre"))
