"""The catalog's input tables, mapped from the given parquet tables.

Each view is one SQL text that both Spark and the checking engine read; only vector indexing
differs. Views cover the whole of their table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tonelake.rules import EMOTION_VALENCE, NEGATION_WORDS, default_rulebook

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
    "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]
PROMPTS = [
    "happy but not energetic", "sad rainy day", "chill lofi", "hype workout", "romantic evening",
    "peaceful breeze", "hype workout music", "chill but not sleepy",
    "Very sad and emotional slow song", "Epic orchestral music",
    "High energy cyberpunk action combat", "r&b soul", "joyful", "joyful music", "not sad", "gaming",
]
GENRE_TAGS = [
    "pop", "indie rock", "heavy metal", "smooth jazz", "orchestral", "house", "rap", "folk",
    "ambient", "lo-fi beats",
]
LABELS = list(EMOTION_VALENCE)


def sql_list(values: list[str], spark: bool) -> str:
    body = ", ".join("'" + v.replace("'", "\\'" if spark else "''") + "'" for v in values)
    return f"array({body})" if spark else f"[{body}]"


def pick(values: list[str], index: str, spark: bool) -> str:
    items = sql_list(values, spark)
    return f"element_at({items}, cast({index} as int) + 1)" if spark else f"{items}[CAST({index} AS INT) + 1]"


def vocabulary() -> list[str]:
    rules = default_rulebook()
    terms = [*rules.synonyms, *rules.profiles, *(w for ws in rules.genres.values() for w in ws)]
    return list(dict.fromkeys(terms))


def _songs(spark: bool) -> str:
    at = (lambda k: f"embedding[{k}]") if spark else (lambda k: f"embedding[{k + 1}]")
    u = lambda k: f"((least(greatest(cast({at(k)} as double) * 4e0, -1e0), 1e0) + 1e0) / 2e0)"
    total = " + ".join(u(10 + i) for i in range(7))
    shares = [f"round({u(10 + i)} / ({total}), 4)" for i in range(7)]
    labels = sql_list(LABELS, spark)
    if spark:
        dist = f"map_from_arrays({labels}, array({', '.join(shares)}))"
        mfccs = f"array(round(60 + 60 * {u(8)}, 4), round(-20 + 40 * {u(9)}, 4))"
        back = "reverse(embedding)"
    else:
        dist = f"map({labels}, [{', '.join(shares)}])"
        mfccs = f"[round(60 + 60 * {u(8)}, 4), round(-20 + 40 * {u(9)}, 4)]"
        back = "list_reverse(embedding)"
    mode = pick(["major", "minor", "unknown"], "vec_id % 3", spark)
    return f"""
SELECT vec_id AS id, concat('/music/', vec_id % 37, '/', vec_id, '.flac') AS filepath,
  cast(1700000000 + vec_id as double) AS file_mtime,
  concat(CASE WHEN vec_id % 6 = 0 THEN '01. ' ELSE '' END, 'Track ', vec_id, CASE WHEN vec_id % 4 = 0 THEN ' (Official Video)' ELSE '' END) AS title,
  concat(CASE WHEN vec_id % 37 = 5 THEN 'Soul ' ELSE '' END, 'Artist ', vec_id % 37) AS artist,
  concat('Album ', vec_id % 11) AS album, {pick(GENRE_TAGS, 'label', spark)} AS genre,
  CASE WHEN vec_id % 29 = 0 THEN 0e0 ELSE round(55 + 145 * {u(0)}, 1) END AS bpm,
  round(0.05 + 0.35 * {u(1)}, 4) AS energy, round(1000 + 3000 * {u(2)}, 1) AS brightness,
  round(-1 + 2 * {u(3)}, 2) AS valence,
  CASE WHEN vec_id % 31 = 0 THEN cast(NULL as double) ELSE round({u(4)}, 2) END AS arousal,
  round(0.85 + 2.65 * {u(5)}, 2) AS dynamic_range, round(1000 + 6500 * {u(6)}, 1) AS spectral_rolloff,
  round(800 + 2500 * {u(7)}, 1) AS spectral_bandwidth, {mfccs} AS mfccs,
  cast(vec_id % 101 as double) / 100 AS key_confidence, cast(vec_id % 97 as double) / 96 AS harmonic_ratio,
  {mode} AS mode, vec_id % 4 <> 0 AS has_lyrics,
  CASE WHEN vec_id % 9 = 0 THEN NULL ELSE {dist} END AS emotion_distribution,
  CASE WHEN vec_id % 8 = 4 THEN '' WHEN vec_id % 4 = 0 THEN cast(NULL as {'string' if spark else 'varchar'})
    ELSE concat('line one of ', vec_id, chr(10), 'line two of the song', chr(10), 'line two of the song') END AS lyrics_text,
  vec_id % 5 <> 2 AS lyrics_processed, embedding,
  CASE WHEN vec_id % 5 = 0 THEN NULL ELSE {back} END AS clap_embedding
FROM embeddings"""


def _prompt_rows(spark: bool) -> str:
    vocab = vocabulary()
    n = len(vocab)
    moods = list(default_rulebook().profiles)
    first, second = pick(vocab, f"p_partkey % {n}", spark), pick(vocab, f"(p_partkey * 7 + 3) % {n}", spark)
    negation = f"concat(' ', {pick(NEGATION_WORDS, f'p_partkey % {len(NEGATION_WORDS)}', spark)}, ' ', {pick(moods, f'p_partkey % {len(moods)}', spark)}, ' loud')"
    text = f"concat({first}, ' ', p_name, ' ', {second}, CASE WHEN p_partkey % 3 = 0 THEN {negation} ELSE '' END)"
    return f"""
SELECT p_partkey AS query_id,
  CASE WHEN p_partkey % 4 = 1 THEN {first} WHEN p_partkey % 5 = 0 THEN upper({text}) ELSE {text} END AS prompt
FROM part"""


def _sql(name: str, spark: bool) -> str:
    string = "string" if spark else "varchar"
    if name == "songs":
        return _songs(spark)
    if name == "prompt_rows":
        return _prompt_rows(spark)
    epoch = "unix_micros(cast({0} as timestamp)) / 1e6" if spark else "epoch_us({0}) / 1e6"
    if name == "files":
        return f"""
SELECT concat('/music/', o_custkey, '/', o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN '.renamed' ELSE '' END, '.flac') AS filepath,
  {epoch.format('o_orderdate')} AS file_mtime
FROM orders"""
    if name == "catalog":
        return f"""
SELECT o_orderkey AS id, concat('/music/', o_custkey, '/', o_orderkey, CASE WHEN o_orderkey % 10 = 0 THEN '.old' ELSE '' END, '.flac') AS filepath,
  CASE WHEN o_orderkey % 13 = 0 THEN cast(NULL as double) ELSE {epoch.format('o_orderdate')}
    - CASE WHEN o_orderkey % 7 = 0 THEN 3600e0 WHEN o_orderkey % 5 = 0 THEN 0.5e0 ELSE 0e0 END END AS file_mtime,
  o_orderstatus AS title
FROM orders"""
    if name == "frames":
        mfcc = ", ".join(f"cast((l_partkey * {i + 1} + l_linenumber) % 97 as double) - 30" for i in range(13))
        mfcc = f"array({mfcc})" if spark else f"[{mfcc}]"
        return f"""
SELECT l_orderkey AS song_id, l_quantity / 100 AS rms, l_extendedprice / 20 AS centroid,
  l_discount * 400 AS contrast, l_tax * 3 AS zcr, l_extendedprice / 10 AS rolloff,
  l_quantity * 60 AS bandwidth, l_quantity - 25 AS harmonic_abs, l_quantity + 5 AS signal_abs, {mfcc} AS mfcc
FROM lineitem"""
    if name == "chroma":
        return "SELECT l_orderkey AS song_id, cast(l_partkey % 12 as int) AS pitch, l_quantity AS value FROM lineitem"
    if name == "tempo":
        return "SELECT o_orderkey AS song_id, cast(o_custkey % 170 as double) + 30 AS bpm FROM orders"
    if name == "chunk_scores":
        label = pick([*LABELS, "boredom"], "l_partkey % 8", spark)
        return f"""
SELECT l_orderkey AS song_id, l_linenumber AS chunk_idx, cast(1 + l_orderkey % 5 as int) AS n_chunks,
  {label} AS label, l_discount * 4 AS score FROM lineitem"""
    if name == "lyrics":
        return """
SELECT doc_id AS song_id, lang, source,
  CASE WHEN doc_id % 6 = 0 THEN replace(text, '. ', concat('.', chr(10), chr(10)))
    WHEN doc_id % 6 = 1 THEN concat('[Verse 1]', chr(10), '[ar:Someone]', chr(10), '[00:12.34] ', replace(text, '. ', concat('.', chr(10), '[01:02.5', '0] ')))
    WHEN doc_id % 6 = 2 THEN concat('Written by Someone', chr(10), '(Translation:)', chr(10), '[Chorus]', chr(10), replace(text, ' th', concat(chr(10), ' th')))
    WHEN doc_id % 6 = 3 THEN replace(text, '. ', concat('.', chr(10)))
    ELSE text END AS lyrics_text
FROM documents"""
    if name == "tags":
        return """
SELECT p_partkey AS id,
  concat('/music/', p_brand, '/', CASE WHEN p_partkey % 17 = 0 THEN '.' ELSE '' END, p_partkey,
    CASE WHEN p_partkey % 9 = 0 THEN '.MP3' WHEN p_partkey % 10 = 0 THEN '.jpg' WHEN p_partkey % 23 = 0 THEN '' ELSE '.v2.flac' END) AS filepath,
  CASE WHEN p_partkey % 7 = 0 THEN '' WHEN p_partkey % 15 = 0 THEN NULL ELSE
    concat(CASE WHEN p_partkey % 4 = 1 THEN '01. ' WHEN p_partkey % 4 = 2 THEN '2 - ' ELSE '' END, p_name,
      CASE p_partkey % 8 WHEN 0 THEN ' (Official Audio)' WHEN 1 THEN ' [HQ]' WHEN 2 THEN ' (From "Big Film")'
        WHEN 3 THEN ' [From Film]' WHEN 4 THEN ' (lyrics)' WHEN 5 THEN '  (Live) feat. Someone' WHEN 6 THEN ' ft. A & B' ELSE '' END) END AS title,
  CASE WHEN p_partkey % 11 = 0 THEN '' ELSE concat(p_brand,
      CASE p_partkey % 6 WHEN 0 THEN ' - Topic' WHEN 1 THEN 'VEVO' WHEN 2 THEN ' (UK)' WHEN 3 THEN ' & Friends'
        WHEN 4 THEN ' Soundtrack' ELSE ' Topic' END) END AS artist,
  CASE WHEN p_partkey % 13 = 0 THEN NULL ELSE p_type END AS album,
  CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE lower(p_type) END AS genre,
  cast(p_size as double) * 37 AS seconds
FROM part"""
    if name == "progress_events":
        return """
SELECT user_id AS run_id, ts, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS current,
  cast(200 as bigint) AS total, event_type,
  CASE event_type WHEN 'click' THEN 'found' WHEN 'view' THEN 'not_found' WHEN 'error' THEN 'error' ELSE 'other' END AS outcome
FROM events"""
    if name == "folders":
        return f"""
SELECT concat('/music/', c_nationkey, '/', c_custkey) AS path,
  CASE WHEN c_custkey % 19 = 0 THEN 0e0 WHEN c_custkey % 23 = 0 THEN cast(NULL as double) ELSE 1.6e9 + c_custkey * 3600e0 END AS last_scan_time,
  cast(c_custkey % 400 as bigint) AS song_count, cast(c_custkey + 400 as bigint) AS total_songs_in_db
FROM customer"""
    if name == "scans":
        return """
SELECT concat('/music/', c_nationkey, '/', c_custkey) AS path, 1.65e9 + c_custkey AS last_scan_time,
  cast(c_custkey % 300 as bigint) AS song_count, cast(c_custkey + 500 as bigint) AS total_songs_in_db
FROM customer"""
    if name == "lyrics_sources":
        source = pick(["stored", "sidecar_lrc", "sidecar_txt", "cache", "tag", "online"], "(doc_id * 5 + s) % 6", spark)
        every = "explode(sequence(0, 2)) AS s" if spark else "unnest(range(0, 3)) AS s"
        return f"""
SELECT song_id, {source} AS source, doc_id * 3 + s AS ordinal, CASE WHEN (doc_id + s) % 4 = 0 THEN '' ELSE text END AS text
FROM (SELECT doc_id % 700 AS song_id, doc_id, concat(' ', text, chr(10)) AS text, {every} FROM documents) x"""
    if name == "lookup_results":
        source = pick(["lrclib", "genius", "ovh", "musixmatch", "genius_title"], "doc_id % 5", spark)
        return f"""
SELECT doc_id % 300 AS song_id, {source} AS source, doc_id AS ordinal,
  CASE WHEN doc_id % 300 % 41 = 0 THEN '' ELSE 'A Title' END AS title,
  CASE WHEN doc_id % 300 % 17 = 0 THEN 'Ghost Singers' WHEN doc_id % 300 % 13 = 0 THEN '' ELSE 'Band' END AS artist,
  CASE WHEN doc_id % 15 = 0 THEN 'short' ELSE concat(CASE WHEN doc_id % 9 = 2 THEN 'Lyrics not available. ' ELSE '' END,
    replace(text, '. ', concat('.', chr(10))), CASE WHEN doc_id % 5 = 3 THEN '******* This Lyrics is NOT for Commercial use *******' ELSE '' END) END AS text,
  concat('[ti:x]', chr(10), '[00:01.00] ', replace(text, '. ', concat('.', chr(10), '[00:02.00] '))) AS synced
FROM documents"""
    if name == "cache":
        return f"""
SELECT substr(md5(concat('/music/', p_brand, '/', p_partkey, CASE WHEN p_partkey % 3 = 0 THEN '.ogg|' ELSE '.mp3|' END, p_name, '|', p_brand)), 1, 16) AS cache_key,
  CASE WHEN p_partkey % 6 = 0 THEN '  ' ELSE concat(' ', p_type, chr(10)) END AS text
FROM part"""
    if name == "cache_songs":
        return f"""
SELECT p_partkey AS id, concat('/music/', p_brand, '/', p_partkey, '.mp3') AS filepath,
  CASE WHEN p_partkey % 8 = 0 THEN cast(NULL as {string}) ELSE p_name END AS title, p_brand AS artist,
  concat(p_type, ' words') AS text FROM part"""
    raise KeyError(name)


VIEWS = {
    "songs": ["embeddings"], "prompt_rows": ["part"], "files": ["orders"], "catalog": ["orders"],
    "frames": ["lineitem"], "chroma": ["lineitem"], "tempo": ["orders"], "chunk_scores": ["lineitem"],
    "lyrics": ["documents"], "tags": ["part"], "progress_events": ["events"], "folders": ["customer"],
    "scans": ["customer"], "lyrics_sources": ["documents"], "lookup_results": ["documents"],
    "cache": ["part"], "cache_songs": ["part"],
}


def duck(*names: str) -> str:
    """WITH clause (without the keyword) of the views."""
    return ",\n".join(f"{n} AS ({_sql(n, False)})" for n in names)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table, in the splits in which it is read."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A view, or a given table, as a DataFrame."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    text = _sql(name, True)
    tables = {t: table(spark, sf_dir, t) for t in VIEWS[name]}
    for t in tables:
        text = text.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(text, **tables)
