"""Registered queries of readers, live input, names and state: files and streams are made of the driver's tables and read back."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import links, readings, text
from .library import Library
from .operators import catalogue, history, merging, stats
from .operators.numbering import cut, shared_folder
from .plans.timeframe import Timeframe
from .queries import LATE, USER, _albums_sql, _artists_sql, _days, _tracks_sql, query, table_query
from .sources import importers, index
from .streaming import live

# ---- readers: each listen written in a service's format, several files, and read back

_HEARD = """SELECT l.id, l.user_id, l.listened_at AS played_at, epoch(l.listened_at)::BIGINT AS s, sg.name AS song, sg.duration_ms, coalesce(artist_name, '') AS artist, coalesce(album_name, '') AS album, l.duration_played_ms AS played
  FROM listens l JOIN songs sg ON sg.id = l.song_id LEFT JOIN first_artist USING (song_id) LEFT JOIN first_album USING (song_id)"""


def _heard(lib: Library) -> DataFrame:
    songs = stats.song_primaries(lib, lib.songs.select(F.col("id").alias("song_id"))).select("song_id", F.col("artist_name").alias("artist"), F.col("album_name").alias("album"))
    named = lib.listens.join(lib.songs.select(F.col("id").alias("song_id"), F.col("name").alias("song"), "duration_ms"), "song_id").join(songs, "song_id")
    at = F.col("listened_at").cast("timestamp")
    return named.select("id", at.alias("at"), F.unix_seconds(at).alias("s"), "song", "duration_ms", "artist", "album", F.col("duration_played_ms").alias("played"))


#: Listens in a document: a task holds a few dozen documents at a time.
_PER_DOCUMENT = 5000


def _written(rows: DataFrame, listens: int, name: str, line: Column, whole: str = "[%s]") -> str:
    """The rows, at most ``listens``, as documents of about _PER_DOCUMENT lines, a file each and eight at least, ``whole`` around the lines of each."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{rows.sparkSession.sparkContext.applicationId}"
    part = F.pmod(F.xxhash64("id"), F.lit(max(8, -(-listens // _PER_DOCUMENT))))
    parts = rows.select(part.alias("part"), line.alias("line")).groupBy("part").agg(F.array_join(F.collect_list("line"), ",\n").alias("lines"))
    parts.select(F.format_string(whole, "lines").alias("value")).write.mode("overwrite").option("maxRecordsPerFile", 1).text(path)
    return path


_COLUMNS = ["origin_url", "song", "album", "listened_at", "duration_ms", "duration_played_ms", "client", "source"]


def _read(found: DataFrame) -> DataFrame:
    kept = [F.col("listened_at").cast("timestamp_ntz").alias(c) if c == "listened_at" else F.col(c) for c in _COLUMNS]
    return importers.triage(found).select(*kept, F.array_join("artist_names", "|").alias("artists"), "status")


def _iso(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")


def _format(name: str, oracle: str, **columns: str):
    """Registers a reader; ``columns`` are the oracle's expressions over _HEARD, null where missing."""
    kinds = {"listened_at": "TIMESTAMP", "duration_ms": "INTEGER", "duration_played_ms": "INTEGER"}
    listed = ", ".join(f"({columns.get(c, 'NULL')})::{kinds.get(c, 'VARCHAR')} AS {c}" for c in _COLUMNS)
    return query(f"read_{name}", f"SELECT {listed}, {columns['artists']} AS artists, {columns.get('status', repr('imported'))} AS status FROM plays" + oracle, plays=_HEARD)


_SECOND = "date_trunc('second', played_at)"


@_format("spotify", "", origin_url="'https://open.spotify.com/track/' || lpad(id::VARCHAR, 22, '0')", song="song", album="album", listened_at="played_at", duration_played_ms="played", source="'spotify'", artists="artist")
def _spotify(lib: Library) -> DataFrame:
    fields = {"ts": _iso("at"), "ms_played": F.col("played"), "master_metadata_track_name": F.col("song"), "master_metadata_album_artist_name": F.col("artist"), "master_metadata_album_album_name": F.col("album"),
              "spotify_track_uri": F.concat(F.lit("spotify:track:"), F.lpad(F.col("id").cast("string"), 22, "0"))}
    path = _written(_heard(lib), lib.listens.count(), "spotify", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))
    return _read(importers.FORMATS["spotify"](lib.listens.sparkSession, path))


@_format("ytmusic", "", origin_url="CASE WHEN id % 3 > 0 THEN 'https://music.youtube.com/watch?v=' || lpad(id::VARCHAR, 11, '0') END", song="CASE WHEN id % 3 > 0 THEN song END", listened_at="played_at", source="'ytmusic'", artists="''",
         status="CASE WHEN id % 3 > 0 THEN 'imported' ELSE 'skipped' END")
def _ytmusic(lib: Library) -> DataFrame:
    header = F.when(F.col("id") % 3 > 0, "YouTube Music").otherwise("YouTube")
    fields = {"header": header, "title": F.concat(F.lit("Watched "), "song"), "titleUrl": F.concat(F.lit("https://music.youtube.com/watch?v="), F.lpad(F.col("id").cast("string"), 11, "0")), "time": _iso("at")}
    path = _written(_heard(lib), lib.listens.count(), "ytmusic", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))
    return _read(importers.FORMATS["ytmusic"](lib.listens.sparkSession, path))


@_format("lastfm", "", song="CASE WHEN id % 5 > 0 THEN song || ', \"live\"' END", album="CASE WHEN id % 5 > 0 THEN album END", listened_at=f"CASE WHEN id % 5 > 1 THEN {_SECOND} END", source="'lastfm'",
         artists="CASE WHEN id % 5 > 0 THEN artist ELSE NULL END", status="CASE WHEN id % 5 = 0 THEN 'skipped' WHEN id % 5 = 1 THEN 'failed' ELSE 'imported' END")
def _lastfm(lib: Library) -> DataFrame:
    plays = _heard(lib)
    track = F.concat(F.lit('"'), F.regexp_replace(F.concat("song", F.lit(', "live"')), '"', '""'), F.lit('"'))
    at = F.when(F.col("id") % 5 == 1, F.lit("soon")).otherwise(F.col("s").cast("string"))
    line = F.when(F.col("id") % 5 == 0, F.concat_ws(",", "artist", "album")).otherwise(F.concat_ws(",", "artist", "album", track, at))
    path = f"{shared_folder(plays.sparkSession)}/lastfm-{plays.sparkSession.sparkContext.applicationId}"
    plays.select(line.alias("value")).write.mode("overwrite").text(path)
    return _read(importers.FORMATS["lastfm"](lib.listens.sparkSession, path))


_MBID = "'00000000-0000-4000-8000-' || lpad(id::VARCHAR, 12, '0')"


@_format("listenbrainz", "", origin_url=f"CASE WHEN id % 2 = 0 THEN 'https://musicbrainz.org/recording/' || {_MBID} ELSE 'https://open.spotify.com/track/' || lpad(id::VARCHAR, 22, '0') END", song="song", album="album",
         listened_at=_SECOND, duration_ms="duration_ms", source="'listenbrainz'", artists="artist")
def _listenbrainz(lib: Library) -> DataFrame:
    digits = F.col("id").cast("string")
    mbid = F.when(F.col("id") % 2 == 0, F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(digits, 12, "0")))
    info = F.struct(mbid.alias("recording_mbid"), F.lpad(digits, 22, "0").alias("spotify_id"), "duration_ms")
    track = F.struct(F.col("artist").alias("artist_name"), F.col("song").alias("track_name"), F.col("album").alias("release_name"), info.alias("additional_info"))
    path = _written(_heard(lib), lib.listens.count(), "listenbrainz", F.to_json(F.struct(F.col("s").alias("listened_at"), track.alias("track_metadata"))))
    return _read(importers.FORMATS["listenbrainz"](lib.listens.sparkSession, path))


@_format("maloja", "", song="song", album="album", listened_at=_SECOND, duration_ms="duration_ms // 1000 * 1000", source="'maloja'", artists="artist || '|guest'")
def _maloja(lib: Library) -> DataFrame:
    track = F.struct(F.array("artist", F.lit("guest")).alias("artists"), F.col("song").alias("title"), F.struct(F.col("album").alias("albumtitle")).alias("album"), (F.col("duration_ms") / 1000).cast("long").alias("length"))
    path = _written(_heard(lib), lib.listens.count(), "maloja", F.to_json(F.struct(F.col("s").alias("time"), track.alias("track"))), '{"scrobbles": [%s]}')
    return _read(importers.FORMATS["maloja"](lib.listens.sparkSession, path))


@_format("koito", "", origin_url=f"'https://musicbrainz.org/recording/' || {_MBID}", song="song", album="album", listened_at="played_at", duration_ms="duration_ms // 1000 * 1000", client="'k' || id % 4", source="'koito'", artists="artist")
def _koito(lib: Library) -> DataFrame:
    said = lambda c: F.array(F.struct(F.lit("other").alias("alias"), F.lit(False).alias("is_primary")), F.struct(F.col(c).alias("alias"), F.lit(True).alias("is_primary"))).alias("aliases")
    mbid = F.concat(F.lit("00000000-0000-4000-8000-"), F.lpad(F.col("id").cast("string"), 12, "0"))
    track = F.struct(mbid.alias("mbid"), (F.col("duration_ms") / 1000).cast("long").alias("duration"), said("song"))
    line = F.struct(_iso("at").alias("listened_at"), F.concat(F.lit("k"), (F.col("id") % 4).cast("string")).alias("client"), track.alias("track"), F.struct(said("album")).alias("album"), F.array(F.struct(said("artist"))).alias("artists"))
    path = _written(_heard(lib), lib.listens.count(), "koito", F.to_json(line), '{"version": "1", "listens": [%s]}')
    return _read(importers.FORMATS["koito"](lib.listens.sparkSession, path))


@_format("ingest_batch", "", origin_url="'u' || id", song="song", album="album", listened_at="played_at", duration_ms="duration_ms", duration_played_ms="played", client="'b'", source="'batch'", artists="artist")
def _batch(lib: Library) -> DataFrame:
    fields = {"origin_url": F.concat(F.lit("u"), "id"), "artist_names": F.array("artist"), "song": F.col("song"), "album": F.col("album"), "listened_at": _iso("at"), "duration_ms": F.col("duration_ms"),
              "duration_played_ms": F.col("played"), "client": F.lit("b"), "source": F.lit("batch")}
    path = _written(_heard(lib), lib.listens.count(), "batch", F.to_json(F.struct(*(v.alias(k) for k, v in fields.items()))))
    return _read(importers.FORMATS["ingest_batch"](lib.listens.sparkSession, path))


_EXPORTED = """SELECT NULL::VARCHAR AS origin_url, s.name AS song, (SELECT name FROM albums WHERE id = (SELECT arg_min(album_id, [coalesce(track_number, 2147483648), album_id]) FROM song_albums x WHERE x.song_id = s.id)) AS album, listened_at,
  s.duration_ms::INTEGER AS duration_ms, duration_played_ms::INTEGER AS duration_played_ms, client, 'export' AS source,
  (SELECT string_agg(a.name, '|' ORDER BY position, artist_id) FROM song_artists x JOIN artists a ON a.id = artist_id WHERE x.song_id = s.id) AS artists, 'imported' AS status
  FROM listens l JOIN songs s ON s.id = l.song_id WHERE user_id = """


@query("read_own_export", _EXPORTED + str(USER))
def _own_export(lib: Library) -> DataFrame:
    from .sources.export import write_documents

    spark = lib.listens.sparkSession
    path = f"{shared_folder(spark)}/own-export-{spark.sparkContext.applicationId}"
    write_documents(lib, USER, path, listens=5)  # so that a history is in several
    return _read(importers.FORMATS["export"](spark, path))


@query("import_counters", """SELECT count(*) AS processed, count(*) FILTER (id % 5 > 1) AS imported, count(*) FILTER (id % 5 = 0) AS skipped, count(*) FILTER (id % 5 = 1) AS failed FROM plays""", plays=_HEARD)
def _counters(lib: Library) -> DataFrame:
    none = F.lit(None).cast("string")
    rows = _heard(lib).select(F.when(F.col("id") % 5 > 0, F.col("song")).alias("song"), none.alias("origin_url"), F.when(F.col("id") % 5 > 1, F.col("at")).alias("listened_at"))
    return importers.counts(importers.triage(rows))


@query("live_submissions", """SELECT id AS user_id, song, artist AS artists, album, """ + _SECOND + """::TIMESTAMP AS listened_at, CASE WHEN id % 2 = 0 THEN duration_ms ELSE 61000 END::INTEGER AS duration_ms, played::INTEGER AS duration_played_ms, 'p' || id % 3 AS media_player
  FROM plays WHERE id % 4 > 0 AND id % 9 > 0 AND """ + _SECOND + """ <= TIMESTAMP '2024-01-20 00:05:00'""", plays=_HEARD)  # fmt: skip
def _live(lib: Library) -> DataFrame:
    plays = _heard(lib)
    info = F.struct(F.when(F.col("id") % 2 == 0, F.col("duration_ms")).alias("duration_ms"), F.when(F.col("id") % 2 > 0, F.lit(61)).alias("duration"), F.col("played").alias("duration_played"), F.concat(F.lit("p"), F.col("id") % 3).alias("media_player"))
    track = F.struct(F.col("artist").alias("artist_name"), F.col("song").alias("track_name"), F.col("album").alias("release_name"), info.alias("additional_info"))
    at = F.when(F.col("id") % 9 == 0, F.lit(1_000_000_000)).otherwise(F.col("s"))  # one in nine is from 2001
    body = F.to_json(F.struct(F.col("id").alias("user_id"), F.when(F.col("id") % 4 > 0, "single").otherwise("playing_now").alias("listen_type"), F.array(F.struct(at.alias("listened_at"), track.alias("track_metadata"))).alias("payload")))
    sent = plays.select(F.from_json(body, importers.LIVE).alias("r")).select("r.*")
    found = importers.from_live(sent, datetime(2024, 1, 20))
    return found.select("user_id", "song", F.array_join("artist_names", "|").alias("artists"), "album", F.col("listened_at").cast("timestamp_ntz").alias("listened_at"), "duration_ms", "duration_played_ms", "media_player")


# ---- functions

_PREFIX = " ".join(f"WHEN substr(a, 1, {n}) <> substr(b, 1, {n}) THEN {n - 1}" for n in range(1, 5))


@table_query("jaro_winkler", f"""SELECT a, b, round(CASE WHEN a = b THEN 1 ELSE j + 0.1::DOUBLE * least(length(a), length(b), p) * (1 - j) END, 9) AS similarity FROM (
  SELECT a, b, jaro_similarity(a, b) AS j, CASE {_PREFIX} ELSE 4 END AS p FROM (
  SELECT DISTINCT x.p_name AS a, substr(y.c_name, 1, 3 + x.p_partkey % 9) || y.c_mktsegment AS b FROM part x JOIN customer y ON x.p_partkey = y.c_custkey UNION SELECT DISTINCT x.n_name, y.n_name FROM nation x, nation y))""")  # fmt: skip
def _jaro_winkler(spark: SparkSession, sf_dir: str) -> DataFrame:
    part, customer, nation = (fixtures.read(spark, sf_dir, t) for t in ("part", "customer", "nation"))
    cut_name = F.concat(F.expr("substring(c_name, 1, int(3 + p_partkey % 9))"), "c_mktsegment")
    pairs = part.join(customer, F.col("p_partkey") == F.col("c_custkey")).select(F.col("p_name").alias("a"), cut_name.alias("b"))
    names = nation.select(F.col("n_name").alias("a"), F.lit(1).alias("k")).join(nation.select(F.col("n_name").alias("b"), F.lit(1).alias("k")), "k").select("a", "b")
    return pairs.unionByName(names).distinct().select("a", "b", F.round(text.jaro_winkler(F.col("a"), F.col("b")), 9).alias("similarity"))


@query("jaccard_of_artists", """SELECT a.song_id AS a, b.song_id AS b, len(list_intersect(a.l, b.l))::DOUBLE / len(list_distinct(a.l || b.l)) AS overlap
  FROM lists a JOIN lists b ON b.song_id = a.song_id + 1""", lists="SELECT song_id, list(artist_id) AS l FROM song_artists GROUP BY song_id")
def _jaccard(lib: Library) -> DataFrame:
    lists = lib.song_artists.groupBy("song_id").agg(F.collect_set(F.col("artist_id").cast("string")).alias("l"))
    a, b = lists.toDF("a", "x"), lists.select((F.col("song_id") - 1).alias("a"), F.col("song_id").alias("b"), F.col("l").alias("y"))
    return a.join(b, "a").select("a", "b", text.jaccard(F.col("x"), F.col("y")).alias("overlap"))


_RAW = "CASE c_custkey % 6 WHEN 0 THEN '  ' || c_name || ' ' WHEN 1 THEN replace(c_name, '#', '.') WHEN 2 THEN replace(c_name, '#', '..') WHEN 3 THEN '.' || replace(c_name, '#', '_') WHEN 4 THEN replace(c_name, '#', '_') ELSE replace(c_name, '#', '_') || c_mktsegment || c_mktsegment END"


@table_query("usernames", f"""SELECT c_custkey, raw, CASE WHEN len(n) BETWEEN 2 AND 32 AND len(replace(translate(n, 'abcdefghijklmnopqrstuvwxyz0123456789_', ''), '.', '')) = 0 AND n[1] <> '.' AND n[-1] <> '.' AND position('..' IN n) = 0 THEN n END AS username
  FROM (SELECT c_custkey, {_RAW} AS raw, lower(trim({_RAW})) AS n FROM customer)""")  # fmt: skip
def _usernames(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fixtures.read(spark, sf_dir, "customer").select("c_custkey", F.expr(_RAW).alias("raw"))
    return rows.select("c_custkey", "raw", text.username(F.col("raw")).alias("username"))


@table_query("clock_texts", """SELECT o_orderkey, t, CASE kind WHEN 0 THEN m * 60 + s WHEN 1 THEN h * 3600 + m * 60 + s ELSE 0 END::BIGINT AS seconds,
  CASE WHEN s + 60 * m + 3600 * h < 60 THEN s || 's' WHEN s + 60 * m + 3600 * h < 3600 THEN m || 'm ' || s || 's' ELSE h || 'h ' || m || 'm' END AS said
  FROM (SELECT *, CASE kind WHEN 0 THEN m || ':' || lpad(s::VARCHAR, 2, '0') WHEN 1 THEN h || ':' || lpad(m::VARCHAR, 2, '0') || ':' || lpad(s::VARCHAR, 2, '0') WHEN 2 THEN 'x:' || s ELSE s::VARCHAR END AS t
  FROM (SELECT o_orderkey, o_orderkey % 4 AS kind, o_orderkey % 3 AS h, o_orderkey // 7 % 60 AS m, o_orderkey // 11 % 60 AS s FROM orders))""")  # fmt: skip
def _clock_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("o_orderkey")
    h, m, s = key % 3, F.floor(key / 7) % 60, F.floor(key / 11) % 60
    two = lambda c: F.lpad(c.cast("string"), 2, "0")
    shown = F.get(F.array(F.concat_ws(":", m.cast("string"), two(s)), F.concat_ws(":", h.cast("string"), two(m), two(s)), F.concat(F.lit("x:"), s.cast("string")), s.cast("string")), (key % 4).cast("int"))
    rows = fixtures.read(spark, sf_dir, "orders").select("o_orderkey", shown.alias("t"), (h * 3600 + m * 60 + s).cast("long").alias("n"))
    return rows.select("o_orderkey", "t", text.seconds_of(F.col("t")).alias("seconds"), text.format_duration(F.col("n")).alias("said"))


@table_query("json_and_images", """SELECT event_id, props::JSON->>'k' AS k, ([(props::JSON->>'k')::INTEGER, event_id])[2]::VARCHAR AS second, NULL::VARCHAR AS missing,
  CASE WHEN (props::JSON->>'k')::INTEGER >= event_id % 100 OR event_id % 7 = 0 THEN 'a' ELSE 'b' || event_id END AS image FROM events""")  # fmt: skip
def _json_and_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    events = fixtures.read(spark, sf_dir, "events")
    doc = F.to_json(F.struct(F.struct(F.array(k.cast("long"), F.col("event_id")).alias("l")).alias("d")))
    width = (F.col("event_id") % 100).cast("int")
    images = F.array(F.struct(F.lit("").alias("url"), F.lit(999).alias("width")), F.struct(F.lit("a").alias("url"), k.alias("width")), F.struct(F.when(F.col("event_id") % 7 > 0, F.concat(F.lit("b"), "event_id")).alias("url"), width.alias("width")))
    return events.select("event_id", text.json_at(F.col("props"), "k").alias("k"), text.json_at(doc, "d", "l", 1).alias("second"), text.json_at(doc, "d", "l", 2).alias("missing"), text.widest_image(images).alias("image"))


@table_query("origin_urls", """SELECT p_partkey, CASE WHEN m <> '' THEN 'https://musicbrainz.org/recording/' || m WHEN s LIKE 'http%' THEN s WHEN s <> '' THEN 'https://open.spotify.com/track/' || s ELSE '' END AS url,
  CASE p_partkey % 3 WHEN 0 THEN 'id' || p_partkey ELSE '' END AS last FROM (
  SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN 'm' || p_partkey ELSE '' END AS m, CASE p_partkey % 5 WHEN 1 THEN 'http://s/' || p_partkey WHEN 3 THEN '' ELSE 's' || p_partkey END AS s FROM part)""")  # fmt: skip
def _origin_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    said = key.cast("string")
    m = F.when(key % 2 == 0, F.concat(F.lit("m"), said)).otherwise("")
    s = F.when(key % 5 == 1, F.concat(F.lit("http://s/"), said)).when(key % 5 != 3, F.concat(F.lit("s"), said))
    uri = F.when(key % 3 == 0, F.concat(F.lit("spotify:track:id"), said)).when(key % 3 == 1, F.concat(F.lit("spotify:id"), said)).otherwise(F.concat(F.lit("a:b:c:id"), said))
    return fixtures.read(spark, sf_dir, "part").select("p_partkey", links.origin_url(m, s).alias("url"), links.last_of_uri(uri).alias("last"))


# ---- romanised names: built syllable by syllable, so that the right spelling is known from the pieces

# Fixed values of the test: how the jamo are spelt, written out beside the module's own table; _ is none.
_JAMO = {
    "i": "g kk n d tt r m b pp s ss _ j jj ch k t p h",
    "v": "a ae ya yae eo e yeo ye o wa wae oe yo u wo we wi yu eu ui i",
    "f": "_ g kk gs n nj nh d l lg lm lb ls lt lp lh m b bs s ss ng j ch k t p h",
}
_JAMO = {k: ["" if x == "_" else x for x in v.split(" ")] for k, v in _JAMO.items()}
#: The first of the words below before each of them: the small tsu doubles what follows it, or has nothing to double.
_DOUBLED = ["", "gakkou", "garraa", "gammen", "gakkya", "gattso", "", "gann", "gaffa", "", "gaoo", ""]
_KANA_WORDS = [("がっ", None), ("こう", "kou"), ("ラー", "raa"), ("メン", "men"), ("きゃ", "kya"), ("ツォ", "tso"), ("っぽ", "ppo"), ("ん", "n"), ("ふぁ", "fa"), ("ABC", "ABC"), ("を", "o"), ("ょ", None)]


def _listed(values: list) -> str:
    return "[" + ", ".join("NULL" if v is None else f"'{v}'" for v in values) + "]"


@table_query("romanized_hangul", f"""SELECT o_orderkey, chr((44032 + n)::INTEGER) || ' ' || chr((44032 + k)::INTEGER) AS name,
  {_listed(_JAMO['i'])}[n // 588 + 1] || {_listed(_JAMO['v'])}[n % 588 // 28 + 1] || {_listed(_JAMO['f'])}[n % 28 + 1] || ' ' || {_listed(_JAMO['i'])}[k // 588 + 1] || {_listed(_JAMO['v'])}[k % 588 // 28 + 1] || {_listed(_JAMO['f'])}[k % 28 + 1] AS spelt
  FROM (SELECT o_orderkey, o_orderkey * 7 % 11172 AS n, o_custkey * 13 % 11172 AS k FROM orders)""")  # fmt: skip
def _romanized_hangul(spark: SparkSession, sf_dir: str) -> DataFrame:
    syllable = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.lit(44032) + n), 4, "0")), "UTF-16BE")
    name = F.concat_ws(" ", syllable(F.col("o_orderkey") * 7 % 11172), syllable(F.col("o_custkey") * 13 % 11172))
    return fixtures.read(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("spelt", text.romanize_name("name"))


@table_query("romanized_kana", f"""SELECT o_orderkey, a || b AS name, CASE WHEN a = 'がっ' THEN {_listed(_DOUBLED)}[n + 1] WHEN x IS NULL OR y IS NULL OR a || b = 'ABCABC' THEN '' ELSE x || y END AS spelt FROM (
  SELECT o_orderkey, {_listed([k for k, _ in _KANA_WORDS])}[o_orderkey % 12 + 1] AS a, {_listed([k for k, _ in _KANA_WORDS])}[o_custkey % 12 + 1] AS b,
  {_listed([v for _, v in _KANA_WORDS])}[o_orderkey % 12 + 1] AS x, {_listed([v for _, v in _KANA_WORDS])}[o_custkey % 12 + 1] AS y, o_custkey % 12 AS n FROM orders)""")  # fmt: skip
def _romanized_kana(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.array(*(F.lit(k) for k, _ in _KANA_WORDS))
    piece = lambda c: F.get(said, (F.col(c) % 12).cast("int"))
    rows = fixtures.read(spark, sf_dir, "orders").select("o_orderkey", F.concat(piece("o_orderkey"), piece("o_custkey")).alias("name"))
    return rows.withColumn("spelt", text.romanize_name("name"))


#: Two made-up signs of a customer and an order, perhaps with kana behind: each sign has a kana reading, and two neighbouring ones a cheaper one together.
_SIGNS = [("か", "ka"), ("き", "ki"), ("く", "ku"), ("け", "ke"), ("こ", "ko"), ("さ", "sa"), ("た", "ta"), ("な", "na"), ("は", "ha"), ("ま", "ma")]
_SIGN = 0x4E00


@table_query("romanized_readings", f"""SELECT o_orderkey, chr(({_SIGN} + x)::INTEGER) || chr(({_SIGN} + y)::INTEGER) || CASE o_orderkey % 3 WHEN 0 THEN 'カ' WHEN 1 THEN chr({_SIGN + 99}) ELSE '' END AS name,
  CASE WHEN o_orderkey % 3 = 1 THEN '' ELSE CASE WHEN y = x + 1 THEN 'no' || s[x % 10 + 1] ELSE s[x % 10 + 1] || ' ' || s[y % 10 + 1] END || CASE o_orderkey % 3 WHEN 0 THEN ' ka' ELSE '' END END AS spelt
  FROM (SELECT o_orderkey, o_custkey % 25 AS x, o_orderkey // 2 % 25 AS y, {_listed([v for _, v in _SIGNS])} AS s FROM orders)""")  # fmt: skip
def _romanized_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    sign = lambda n: F.decode(F.unhex(F.lpad(F.hex(F.lit(_SIGN) + n), 4, "0")), "UTF-16BE")
    kana = F.get(F.array(*(F.lit(k) for k, _ in _SIGNS)), (F.col("n") % 10).cast("int"))
    nation = fixtures.read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("n"))
    one = nation.select(sign(F.col("n")).alias("surface"), kana.alias("reading"), F.lit(10.0).alias("cost"))
    two = nation.select(F.concat(sign(F.col("n")), sign(F.col("n") + 1)).alias("surface"), F.concat(F.lit("の"), kana).alias("reading"), F.lit(15.0).alias("cost"))
    spelt = readings.romanizer(one.unionByName(two))
    key = F.col("o_orderkey")
    behind = F.when(key % 3 == 0, "カ").when(key % 3 == 1, chr(_SIGN + 99)).otherwise("")
    name = F.concat(sign(F.col("o_custkey") % 25), sign(F.floor(key / 2) % 25), behind)
    return fixtures.read(spark, sf_dir, "orders").select("o_orderkey", name.alias("name")).withColumn("spelt", spelt("name"))


# ---- periods

_PERIODS = [("America/New_York", {"year": 2024, "month": 2}), ("Asia/Tokyo", {"year": 2020, "week": 53}), ("UTC", {"year": 2024}), ("Europe/Paris", {"period": "week"}), ("Asia/Kolkata", {"period": "month"}), ("America/Los_Angeles", {"period": "day"}), ("UTC", {"period": "all_time"})]
_LOCAL = [("TIMESTAMP '2024-02-01'", "INTERVAL 1 month"), ("TIMESTAMP '2020-12-28'", "INTERVAL 7 days"), ("TIMESTAMP '2024-01-01'", "INTERVAL 1 year")] + [(f"date_trunc('{u}', (now AT TIME ZONE 'UTC') AT TIME ZONE '{tz}')::TIMESTAMP", f"INTERVAL 1 {u}") for tz, u in (("Europe/Paris", "week"), ("Asia/Kolkata", "month"), ("America/Los_Angeles", "day"))]


@query("periods_played", """SELECT n, start_at, stop_at, (SELECT count(*) FROM listens WHERE listened_at >= start_at AND listened_at < stop_at) AS listens FROM (""" + " UNION ALL ".join(
    f"SELECT {i}::BIGINT AS n, ({a} AT TIME ZONE '{tz}') AT TIME ZONE 'UTC' AS start_at, (({a} + {step}) AT TIME ZONE '{tz}') AT TIME ZONE 'UTC' AS stop_at FROM (SELECT TIMESTAMP '2024-01-17 23:30:00' AS now)" for i, ((tz, _), (a, step)) in enumerate(zip(_PERIODS, _LOCAL))
) + " UNION ALL SELECT 6, TIMESTAMP '1970-01-01', TIMESTAMP '2024-01-18 23:30:00')")
def _periods(lib: Library) -> DataFrame:
    now = datetime(2024, 1, 17, 23, 30)
    out = None
    for i, (tz, named) in enumerate(_PERIODS):
        period = Timeframe.resolve(now, tz, **named)
        row = stats.in_time(lib.listens, period).agg(F.count("*").alias("listens"))
        row = row.select(F.lit(i).cast("long").alias("n"), F.lit(period.start).cast("timestamp_ntz").alias("start_at"), F.lit(period.stop).cast("timestamp_ntz").alias("stop_at"), "listens")
        out = row if out is None else out.unionByName(row)
    return out


# ---- rewind, search, cache, who listens now

_REWOUND = "coalesce((SELECT string_agg({key} || ':' || name || ':' || listen_count || ':' || (listen_count - coalesce(n, 0))::BIGINT, '|' ORDER BY blacklisted, listen_count DESC, name, {key}) FROM ({top}) t LEFT JOIN ({prior}) p USING ({key})), '') AS top_{kind}"
_PRIOR = "SELECT {key}, sum(listen_count) AS n FROM daily {join} WHERE user_id = %d AND %s GROUP BY 1" % (USER, _days(LATE.before()))


@query(
    "rewind",
    f"""SELECT coalesce(sum(listen_count), 0)::BIGINT AS plays, count(DISTINCT song_id) AS unique_tracks, coalesce(sum(played_ms), 0)::DOUBLE / 60000 AS minutes_listened,
      CASE WHEN count(DISTINCT day) = 0 THEN 0 ELSE sum(listen_count)::DOUBLE / count(DISTINCT day) END AS avg_daily_plays,
      (SELECT count(DISTINCT album_id) FROM scoped JOIN song_albums USING (song_id)) AS unique_albums, (SELECT count(DISTINCT artist_id) FROM scoped JOIN song_artists USING (song_id)) AS unique_artists,
      (SELECT coalesce(max(n), 0) FROM (SELECT count(*) AS n FROM (SELECT day - row_number() OVER (ORDER BY day)::INTEGER AS g FROM (SELECT DISTINCT day FROM scoped)) GROUP BY g)) AS longest_streak,
      (SELECT day FROM (SELECT day, sum(listen_count) AS n FROM scoped GROUP BY day) ORDER BY n DESC, day LIMIT 1) AS top_day,
      (SELECT count(*) FROM firsts WHERE user_id = {USER} AND entity_type = 'song' AND first_at >= TIMESTAMP '{LATE.start}' AND first_at < TIMESTAMP '{LATE.stop}') AS new_tracks,
      (SELECT count(*) FROM firsts WHERE user_id = {USER} AND entity_type = 'album' AND first_at >= TIMESTAMP '{LATE.start}' AND first_at < TIMESTAMP '{LATE.stop}') AS new_albums,
      (SELECT count(*) FROM firsts WHERE user_id = {USER} AND entity_type = 'artist' AND first_at >= TIMESTAMP '{LATE.start}' AND first_at < TIMESTAMP '{LATE.stop}') AS new_artists,
      {_REWOUND.format(kind="artists", key="artist_id", top=_artists_sql(True, "listen_count", 5), prior=_PRIOR.format(key="artist_id", join="JOIN song_artists USING (song_id)"))},
      {_REWOUND.format(kind="albums", key="album_id", top=_albums_sql(True, "listen_count", 5), prior=_PRIOR.format(key="album_id", join="JOIN song_albums USING (song_id)"))},
      {_REWOUND.format(kind="tracks", key="song_id", top=_tracks_sql(True, "listen_count", 5), prior=_PRIOR.format(key="song_id", join=""))} FROM scoped""",
    scoped=f"SELECT * FROM daily WHERE user_id = {USER} AND {_days(LATE)}",
)
def _rewind(lib: Library) -> DataFrame:
    said = lambda c: F.array_join(F.transform(c, lambda e: F.concat_ws(":", e["id"], e["name"], e["listen_count"], e["delta"])), "|").alias(c)
    out = stats.rewind(lib, USER, LATE)
    return out.select(*(c for c in out.columns if not c.startswith("top_") or c == "top_day"), *map(said, ("top_artists", "top_albums", "top_tracks")))


def _search_sql(kind: str, table: str, name: str) -> str:
    said = f"SELECT id, {name} AS said FROM {table}" + ("" if kind == "user" else f" UNION ALL SELECT entity_id, alias FROM aliases WHERE entity_type = '{kind}'")
    return f"""(SELECT '{kind}' AS kind, t.id, {name} AS name, max((contains(lower(said), 'take'))::INTEGER + (contains(lower(said), '1'))::INTEGER + (contains(lower(said), 'the'))::INTEGER) / 3.0::DOUBLE AS score
      FROM ({said}) x JOIN {table} t ON t.id = x.id GROUP BY t.id, {name} HAVING score > 0 ORDER BY score DESC, name, t.id LIMIT 25)"""


query("search_all", " UNION ALL ".join(_search_sql(*x) for x in (("artist", "artists", "name"), ("album", "albums", "name"), ("song", "songs", "name"), ("user", "users", "username"))))(lambda lib: history.search(lib, "Take 1 the"))
_CHANGED = {
    "artists_now": "SELECT id, CASE WHEN id % 4 = 1 THEN 'Take ' || name ELSE name END AS name FROM artists",
    "songs_now": "SELECT id, name FROM songs WHERE id % 11 > 0",
}


@query("search_stored", " UNION ALL ".join(_search_sql(*x) for x in (("artist", "artists_now", "name"), ("album", "albums", "name"), ("song", "songs_now", "name"), ("user", "users", "username"))), **_CHANGED)
def _search_stored(lib: Library) -> DataFrame:
    """An index written in three parts; then some artists are renamed and some songs taken out."""
    spark = lib.listens.sparkSession
    store = index.SearchIndex(spark, f"{shared_folder(spark)}/search-{spark.sparkContext.applicationId}-{datetime.now().timestamp():.6f}", fan=2)
    docs = cut(index.documents(lib))
    for i in range(3):
        store.change(i, docs.where(F.col("id") % 3 == i))
    renamed = F.when(F.col("id") % 4 == 1, F.concat(F.lit("Take "), "name")).otherwise(F.col("name"))
    after = lib.changed(artists=lib.artists.withColumn("name", renamed))
    changed = lib.artists.where("id % 4 = 1").select(F.lit("artist").alias("kind"), "id")
    store.change(3, index.documents(after, changed))  # these artists, and the albums and songs that show their names
    store.change(4, None, lib.songs.where("id % 11 = 0").select(F.lit("song").alias("kind"), "id"))
    return store.search("Take 1 the")


query("search_aliases", "SELECT id, entity_type, entity_id, alias FROM aliases WHERE entity_type = 'song' AND alias ILIKE '%take 1%' ORDER BY alias, id LIMIT 50")(lambda lib: history.search_aliases(lib.aliases, "song", "take 1", 50))

_CACHE = """SELECT CASE WHEN c_custkey % 3 > 0 THEN c_custkey END AS user_id, CASE WHEN c_custkey % 2 = 0 THEN c_nationkey END::BIGINT AS artist_id, c_mktsegment AS resource, c_custkey AS n,
  TIMESTAMP '2024-01-01' + to_minutes(c_custkey * 13 % 1440) AS computed_at FROM customer"""


@table_query("cache_life", f"""WITH cache AS ({_CACHE}) SELECT user_id, artist_id, resource, n, CASE WHEN n % 4 = 0 THEN 'new' ELSE 'old' END AS data, CASE WHEN n % 4 = 0 THEN TIMESTAMP '2024-01-02' ELSE computed_at END AS computed_at,
  computed_at >= TIMESTAMP '2024-01-01 23:50:00' OR n % 4 = 0 AS fresh FROM cache WHERE computed_at >= TIMESTAMP '2024-01-01 12:00:00'""")  # fmt: skip
def _cache_life(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A cache after twelve hours of pruning and one regeneration of every fourth row, and what of it is fresh."""
    key = F.col("c_custkey")
    none = F.lit(None).cast("long")
    at = F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(mins=(key * 13 % 1440).cast("int"))
    cache = fixtures.read(spark, sf_dir, "customer").select(
        F.when(key % 3 > 0, key).alias("user_id"), F.when(key % 2 == 0, F.col("c_nationkey")).cast("long").alias("artist_id"), none.alias("album_id"), none.alias("song_id"), F.col("c_mktsegment").alias("resource"),
        F.format_string('{"n": "%d", "a": "x"}', key).alias("params"), F.lit("old").alias("data"), at.alias("computed_at"),
    )
    now = datetime(2024, 1, 2)
    number = F.get_json_object("params", "$.n").cast("long")

    def compute(keys: DataFrame) -> DataFrame:  # the same parameters, written another way
        return keys.where(number % 4 == 0).withColumn("params", F.format_string('{"a":"x",   "n":"%d"}', number)).withColumn("data", F.lit("new"))

    after = cut(catalogue.regenerate(cache, now, compute))
    fresh = catalogue.fresh(after, now).select(number.alias("n"), F.lit(True).alias("fresh"))
    return after.select("user_id", "artist_id", "resource", number.alias("n"), "data", "computed_at").join(fresh, "n", "left").withColumn("fresh", F.coalesce("fresh", F.lit(False)))


@query("now_playing_state", """SELECT user_id, arg_max(song_id, started_at) AS song_id, max(started_at) AS started_at FROM (
      SELECT user_id, song_id, listened_at AS started_at, id % 2 AS half FROM one) GROUP BY user_id
      HAVING max(half) = 1 OR max(started_at) + INTERVAL 1 HOUR >= TIMESTAMP '2024-01-25'""",
       one="SELECT user_id, arg_min(song_id, id) AS song_id, listened_at, min(id) AS id FROM listens GROUP BY user_id, listened_at")
def _now_playing_state(lib: Library) -> DataFrame:
    one = lib.listens.groupBy("user_id", "listened_at").agg(F.min(F.struct("id", "song_id")).alias("r")).select("user_id", "r.song_id", F.col("listened_at").alias("started_at"), F.lit(3_600_000).cast("long").alias("duration_ms"), "r.id")
    parts = [one.where(f"id % 2 = {i}").drop("id") for i in (0, 1)]
    present = parts[0].groupBy("user_id").agg(F.max_by(F.struct("song_id", "started_at", "duration_ms"), "started_at").alias("r")).select("user_id", "r.*")
    return history.latest_now_playing(present, parts[1], datetime(2024, 1, 25)).select("user_id", "song_id", "started_at")


_ROCKS = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@query("stream_now_playing", """SELECT user_id, arg_max(song_id, [epoch_us(listened_at), song_id]) AS song_id, max(listened_at) AS started_at FROM listens GROUP BY user_id
      HAVING max(listened_at) + INTERVAL 3 HOUR > (SELECT max(listened_at) FROM listens)""")
def _stream_now_playing(lib: Library) -> DataFrame:
    """Starts by day, three hours each, as a stream; what is played at its end, by the last change that it gave of each user."""
    spark = lib.listens.sparkSession
    folder = f"{shared_folder(spark)}/playing-{spark.sparkContext.applicationId}-{datetime.now().timestamp():.6f}"
    starts = lib.listens.select("user_id", "song_id", F.col("listened_at").alias("started_at"), F.lit(3 * 3_600_000).cast("long").alias("duration_ms"))
    ten = F.floor(F.dayofmonth("started_at") / 10)
    for i in range(4):  # a file, and so a batch, for each ten days
        starts.where(ten == i).coalesce(1).write.parquet(f"{folder}/in/part={i}")
    before = spark.conf.get(_ROCKS[0])
    spark.conf.set(*_ROCKS)
    try:
        stream = spark.readStream.schema(starts.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
        written = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/{i}")
        live.live_now_playing(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/ck").foreachBatch(written).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(_ROCKS[0], before)
    rows = spark.read.parquet(f"{folder}/out/*")
    last = rows.groupBy("user_id").agg(F.max_by(F.struct("song_id", "started_us", "playing"), F.struct("batch", "started_us", ~F.col("playing"))).alias("r")).select("user_id", "r.*")
    end = lib.listens.agg(F.unix_micros(F.max("listened_at").cast("timestamp")).alias("end"))
    return last.where("playing").join(F.broadcast(end), F.col("started_us") + 3 * 3_600_000_000 > F.col("end")).select("user_id", "song_id", F.timestamp_micros("started_us").cast("timestamp_ntz").alias("started_at"))


# ---- streams: the driver's listens as a stream of files, folded batch by batch


def _streamed(lib: Library, name: str) -> tuple[DataFrame, str]:
    """A stream of the listens, in four batches, and a new folder beside it."""
    spark = lib.listens.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{datetime.now().timestamp():.6f}"
    lib.listens.withColumn("part", F.col("id") % 4).repartition("part").sortWithinPartitions("id").write.partitionBy("part").parquet(f"{folder}/in")
    return spark.readStream.schema(lib.listens.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in"), folder


_ONCE = {
    "once": "SELECT DISTINCT ON (user_id, song_id, listened_at) * FROM listens ORDER BY user_id, song_id, listened_at, id",
    "once_heard": """SELECT l.user_id, l.song_id, l.listened_at, coalesce(l.duration_played_ms, s.duration_ms, 0) AS played_ms FROM once l JOIN songs s ON s.id = l.song_id
      WHERE coalesce(s.duration_ms, 0) <= 0 OR 2 * coalesce(l.duration_played_ms, s.duration_ms, 0) >= s.duration_ms OR coalesce(l.duration_played_ms, s.duration_ms, 0) >= 240000""",
}


@query("stream_daily", "SELECT user_id, song_id, listened_at::DATE AS day, count(*) AS listen_count, sum(played_ms)::BIGINT AS played_ms FROM once_heard GROUP BY ALL", **_ONCE)
def _stream_daily(lib: Library) -> DataFrame:
    stream, folder = _streamed(lib, "stream")
    store = live.Store(lib.listens.sparkSession, f"{folder}/store", fan=3)
    live.start(stream, store, lib.songs, f"{folder}/ck", every=None).awaitTermination()
    return store.daily()


#: Listens as a stream that then deletes those of some ids: what is left, and what of it counts.
_LEFT = {
    "once": "SELECT DISTINCT ON (user_id, song_id, listened_at) * FROM listens ORDER BY user_id, song_id, listened_at, id",
    "kept": "SELECT * FROM once o WHERE NOT EXISTS (SELECT 1 FROM listens d WHERE d.id % 7 < 2 AND d.user_id = o.user_id AND d.song_id = o.song_id AND d.listened_at = o.listened_at)",
    "kept_heard": """SELECT l.user_id, l.song_id, l.listened_at, coalesce(l.duration_played_ms, s.duration_ms, 0) AS played_ms FROM kept l JOIN songs s ON s.id = l.song_id
      WHERE coalesce(s.duration_ms, 0) <= 0 OR 2 * coalesce(l.duration_played_ms, s.duration_ms, 0) >= s.duration_ms OR coalesce(l.duration_played_ms, s.duration_ms, 0) >= 240000""",
    "kept_attributed": """SELECT h.*, 'song' AS entity_type, song_id AS entity_id FROM kept_heard h UNION ALL SELECT h.*, 'album', album_id FROM kept_heard h JOIN song_albums USING (song_id)
      UNION ALL SELECT h.*, 'artist', artist_id FROM kept_heard h JOIN song_artists USING (song_id)""",
    "kept_runs": """SELECT user_id, count(*) AS length, max(day) AS last_day FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS island
      FROM (SELECT DISTINCT user_id, listened_at::DATE AS day FROM kept_heard)) GROUP BY user_id, island""",
}


def _retracted(lib: Library, name: str) -> live.Store:
    """The store after six batches: listens dealt by id, so in no order of time, then deletions in two."""
    spark = lib.listens.sparkSession
    folder = f"{shared_folder(spark)}/{name}-{spark.sparkContext.applicationId}-{datetime.now().timestamp():.6f}"
    dealt = lib.listens.withColumns({"deleted": F.lit(False), "part": F.col("id") % 4})
    taken = lib.listens.where("id % 7 < 2").withColumns({"deleted": F.lit(True), "part": F.lit(4) + F.col("id") % 7})
    rows = dealt.unionByName(taken)
    rows.repartition("part").sortWithinPartitions("id").write.partitionBy("part").parquet(f"{folder}/in")
    store = live.Store(spark, f"{folder}/store", fan=3)
    for i in range(6):
        live.fold_batch(store, lib.songs, spark.read.schema(rows.drop("part").schema).parquet(f"{folder}/in/part={i}"), i)
    return store


@query("retracted_statistics", """SELECT entity_type, entity_id, count(*) AS plays, count(DISTINCT user_id) AS unique_listeners, sum(played_ms)::BIGINT AS played_ms, min(listened_at) AS first_listened_at FROM kept_attributed GROUP BY ALL""", **_LEFT)
def _retracted_statistics(lib: Library) -> DataFrame:
    return _retracted(lib, "retracted").global_stats(lib.song_albums, lib.song_artists)


@query("retracted_user_state", """SELECT l.user_id, max(listened_at) AS last_listened_at,
      coalesce(max((SELECT length FROM kept_runs r WHERE r.user_id = l.user_id AND last_day >= DATE '2024-01-30' ORDER BY last_day DESC LIMIT 1)), 0) AS current_streak,
      coalesce(max((SELECT max(length) FROM kept_runs r WHERE r.user_id = l.user_id)), 0) AS longest_streak FROM kept l GROUP BY l.user_id""", **_LEFT)
def _retracted_user_state(lib: Library) -> DataFrame:
    return _retracted(lib, "retracted-state").user_state(datetime(2024, 1, 31).date())


@query("stream_streaks", """SELECT user_id, max(last_day) AS last_day, arg_max(length, last_day) AS current_streak, max(length) AS longest_streak FROM runs GROUP BY user_id""")
def _stream_streaks(lib: Library) -> DataFrame:
    spark = lib.listens.sparkSession
    folder = f"{shared_folder(spark)}/streaks-{spark.sparkContext.applicationId}-{datetime.now().timestamp():.6f}"
    heard, files = lib.eligible.select("user_id", "listened_at"), spark.sparkContext.defaultParallelism
    # A batch for each stretch of days, in as many files as there are cores. A user's listens of a stretch are in one of them, and
    # files are read from the oldest on, so where a stretch has fewer files and a batch runs into the next one no user's days change places.
    for i, (a, b) in enumerate((("2000-01-01", "2024-01-10"), ("2024-01-10", "2024-01-20"), ("2024-01-20", "2100-01-01"))):
        stretch = heard.where(F.col("listened_at").between(F.lit(a).cast("timestamp_ntz"), F.lit(b).cast("timestamp_ntz") - F.expr("INTERVAL 1 MICROSECOND")))
        stretch.repartition(files, "user_id").write.parquet(f"{folder}/in/part={i}")
    stream = spark.readStream.schema(heard.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in")
    written = lambda b, i: b.withColumn("batch", F.lit(i)).write.mode("overwrite").parquet(f"{folder}/out/{i}")
    live.live_streaks(stream).writeStream.outputMode("update").option("checkpointLocation", f"{folder}/ck").foreachBatch(written).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/out/*")
    return rows.groupBy("user_id").agg(F.max_by(F.struct("last_day", "current_streak", "longest_streak"), "batch").alias("r")).select("user_id", "r.*")


@query("suggestions_not_present", "SELECT 'song' AS entity_type, id AS lo_id, id + 2 AS hi_id, 0.5::DOUBLE AS score FROM songs WHERE id % 3 > 0 AND id + 2 IN (SELECT id FROM songs)")
def _suggestions(lib: Library) -> DataFrame:
    pairs = lib.songs.join(lib.songs.select((F.col("id") - 2).alias("id"), F.col("id").alias("b")), "id").select(F.lit("song").alias("entity_type"), F.col("b").alias("a"), F.col("id").alias("b"), F.lit(0.5).alias("score"))
    again = pairs.select("entity_type", F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.4).alias("score"))
    known = lib.songs.where("id % 3 = 0").select(F.lit("song").alias("entity_type"), F.col("id").alias("lo_id"), (F.col("id") + 2).alias("hi_id"))
    return merging.suggestions(pairs.unionByName(again), known)
