"""Registered queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from datetime import date, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import fixtures
from .functions import links, text
from .library import Library
from .operators import catalogue, history, ingest, matching, merging, rollups, stats
from .operators.numbering import cut
from .plans.timeframe import Timeframe
from .sources import export

NOW = datetime(2024, 1, 31)
JANUARY = Timeframe(datetime(2024, 1, 1), datetime(2024, 2, 1))
LATE = Timeframe(datetime(2024, 1, 16), datetime(2024, 1, 31))
ODD = Timeframe(datetime(2024, 1, 3, 7, 30), datetime(2024, 1, 29))
LISTENING = datetime(2024, 1, 30, 12)
USER, ARTIST, ALBUM, SONG = 7, 3, 13, 42

#: The library in SQL, for the oracles.
TABLES = {
    "listens": """SELECT event_id AS id, user_id, (props::JSON->>'k')::BIGINT AS song_id, ts AS listened_at, event_type AS client,
      CASE WHEN event_type <> 'error' THEN round(value * 1000)::BIGINT END AS duration_played_ms FROM events""",
    "songs": """SELECT p_partkey AS id, p_name AS name, CASE WHEN p_partkey % 10 <> 0 THEN (30 + p_partkey % 100) * 1000 END AS duration_ms,
      p_partkey % 13 = 0 AS pinned FROM part""",
    "artists": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "albums": """SELECT DISTINCT regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS id, p_brand AS name FROM part""",
    "song_artists": """SELECT song_id, artist_id, row_number() OVER (PARTITION BY song_id ORDER BY artist_id) - 1 AS position
      FROM (SELECT DISTINCT l_partkey AS song_id, l_suppkey AS artist_id FROM lineitem)""",
    "song_albums": """SELECT p_partkey AS song_id, regexp_extract(p_brand, '(\\d+)', 1)::BIGINT AS album_id,
      CASE WHEN p_size % 5 <> 0 THEN p_size END::BIGINT AS track_number FROM part""",
    "album_artists": """SELECT album_id, artist_id, row_number() OVER (PARTITION BY album_id ORDER BY artist_id) - 1 AS position
      FROM (SELECT DISTINCT album_id, artist_id FROM song_albums JOIN song_artists USING (song_id))""",
    "aliases": """SELECT id, entity_type, entity_id, alias FROM (
      SELECT p_partkey * 2 AS id, 'song' AS entity_type, p_partkey AS entity_id, p_type || ' take ' || p_size AS alias FROM part WHERE p_partkey % 5 = 0
      UNION ALL SELECT s_suppkey * 2 + 1, 'artist', s_suppkey, 'The ' || s_name FROM supplier WHERE s_suppkey % 4 = 0)""",
    "users": "SELECT c_custkey AS id, c_name AS username, c_acctbal > 0 AS public FROM customer",
    "sources": """SELECT id, 'song' AS entity_type, entity_id, source_type, source_type || '-' || entity_id AS extracted_id,
      CASE WHEN id % 2 = 0 THEN 'source_id' ELSE 'fuzzy_name' END AS correlation_method FROM (
      SELECT p_partkey * 2 + 1 AS id, p_partkey AS entity_id, p_type AS source_type FROM part
      UNION ALL SELECT p_partkey * 2, p_partkey, 'MIRROR' FROM part WHERE p_partkey % 3 = 0)""",
    "blacklist": """SELECT DISTINCT user_id, artist_id FROM listens JOIN song_artists USING (song_id) WHERE (user_id * 7 + artist_id) % 11 = 0""",
    "now_playing": """SELECT l.user_id, l.song_id, l.listened_at AS started_at, s.duration_ms * 600 AS duration_ms
      FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY listened_at DESC, id DESC) AS r FROM listens) l
      JOIN songs s ON s.id = l.song_id WHERE r = 1""",
    "heard": """SELECT l.id, l.user_id, l.song_id, l.listened_at, l.client, coalesce(l.duration_played_ms, s.duration_ms, 0) AS played_ms
      FROM listens l JOIN songs s ON s.id = l.song_id
      WHERE coalesce(s.duration_ms, 0) <= 0 OR 2 * coalesce(l.duration_played_ms, s.duration_ms, 0) >= s.duration_ms
        OR coalesce(l.duration_played_ms, s.duration_ms, 0) >= 240000""",
    "daily": """SELECT user_id, song_id, listened_at::DATE AS day, count(*) AS listen_count, sum(played_ms)::BIGINT AS played_ms
      FROM heard GROUP BY ALL""",
    "clock": "SELECT user_id, listened_at::DATE AS day, hour(listened_at) AS hour, count(*) AS listen_count FROM heard GROUP BY ALL",
    "attributed": """SELECT h.*, 'song' AS entity_type, song_id AS entity_id FROM heard h
      UNION ALL SELECT h.*, 'album', album_id FROM heard h JOIN song_albums USING (song_id)
      UNION ALL SELECT h.*, 'artist', artist_id FROM heard h JOIN song_artists USING (song_id)""",
    "firsts": "SELECT user_id, entity_type, entity_id, min(listened_at) AS first_at FROM attributed GROUP BY ALL",
    "totals": """SELECT entity_type, entity_id, count(*) AS plays, count(DISTINCT user_id) AS unique_listeners,
      sum(played_ms)::BIGINT AS played_ms, min(listened_at) AS first_listened_at FROM attributed GROUP BY ALL""",
    "runs": """SELECT user_id, count(*) AS length, min(day) AS first_day, max(day) AS last_day FROM (
      SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS island
      FROM (SELECT DISTINCT user_id, day FROM daily)) GROUP BY user_id, island""",
    "first_artist": """SELECT song_id, arg_min(artist_id, [position, artist_id]) AS artist_id, arg_min(name, [position, artist_id]) AS artist_name
      FROM song_artists JOIN artists ON id = artist_id GROUP BY song_id""",
    "first_album": """SELECT song_id, arg_min(album_id, [coalesce(track_number, 1000000), album_id]) AS album_id,
      arg_min(name, [coalesce(track_number, 1000000), album_id]) AS album_name FROM song_albums JOIN albums ON id = album_id GROUP BY song_id""",
}

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def sql(body: str, **more: str) -> str:
    """``body`` over the library's tables, and over ``more`` tables after these."""
    every = TABLES | more
    return "WITH " + ",\n".join(f"{name} AS ({query})" for name, query in every.items()) + "\n" + body


#: Queries that plan rollups anew; all others read stored ones, each written once a session.
ANEW = ("eligible_", "rebuild_", "fold_", "unrecord_", "merge_")


def query(name: str, oracle: str | None = None, **more: str):
    def keep(plan: Callable[[Library], DataFrame]) -> Callable[[Library], DataFrame]:
        read = fixtures.library if name.startswith(ANEW) else fixtures.stored_library
        QUERIES[name] = lambda spark, sf_dir: plan(read(spark, sf_dir))
        if oracle:
            ORACLES[name] = sql(oracle, **more)
        return plan

    return keep


def table_query(name: str, oracle: str | None = None):
    def keep(plan: Query) -> Query:
        QUERIES[name] = plan
        if oracle:
            ORACLES[name] = oracle
        return plan

    return keep


def _days(period: Timeframe) -> str:
    return f"day >= DATE '{period.days[0]}' AND day < DATE '{period.days[1]}'"


def _between(period: Timeframe, column: str = "listened_at") -> str:
    return f"{column} >= TIMESTAMP '{period.start}' AND {column} < TIMESTAMP '{period.stop}'"


# ---- rollups

query("eligible_listens", "SELECT id, user_id, song_id, listened_at, client, played_ms FROM heard")(lambda lib: lib.eligible)
query("rebuild_daily", "SELECT * FROM daily")(lambda lib: lib.daily)
query("rebuild_clock", "SELECT * FROM clock")(lambda lib: lib.clock)
query("rebuild_first_listens", "SELECT * FROM firsts")(lambda lib: lib.first_listens)
query("rebuild_global_stats", "SELECT * FROM totals")(lambda lib: lib.global_stats)
query(
    "rebuild_user_state",
    """SELECT l.user_id, max(listened_at) AS last_listened_at,
      coalesce(max((SELECT length FROM runs r WHERE r.user_id = l.user_id AND last_day >= DATE '2024-01-30' ORDER BY last_day DESC LIMIT 1)), 0) AS current_streak,
      coalesce(max((SELECT max(length) FROM runs r WHERE r.user_id = l.user_id)), 0) AS longest_streak FROM listens l GROUP BY l.user_id""",
)(lambda lib: rollups.user_state(lib.listens, lib.daily, date(2024, 1, 31)))
query("user_streaks", "SELECT user_id, length, first_day, last_day FROM runs")(lambda lib: rollups.streaks(lib.daily))
query(
    "streak_range",
    f"""SELECT coalesce(max(n), 0) AS longest_streak FROM (SELECT count(*) AS n FROM (
      SELECT day - row_number() OVER (ORDER BY day)::INTEGER AS g FROM (SELECT DISTINCT day FROM daily WHERE user_id = {USER} AND {_days(LATE)})) GROUP BY g)""",
)(lambda lib: stats.longest_streak(lib, USER, LATE))


@query("dedupe_listens", "SELECT user_id, song_id, listened_at, min(id) AS id, arg_min(client, id) AS client FROM twice GROUP BY ALL HAVING min(id) > 100",
       twice="SELECT id, user_id, song_id, listened_at, client FROM listens UNION ALL SELECT id + 1000000, user_id, song_id, listened_at, 'again' FROM listens")
def _dedupe(lib: Library) -> DataFrame:
    own = lib.listens.select("id", "user_id", "song_id", "listened_at", "client")
    again = own.withColumns({"id": F.col("id") + 1_000_000, "client": F.lit("again")})
    return rollups.dedupe(own.unionByName(again), own.where("id <= 100")).select("user_id", "song_id", "listened_at", "id", "client")


@query("fold_equals_rebuild_daily", "SELECT * FROM daily")
def _fold_daily(lib: Library) -> DataFrame:
    return _folded(lib)["daily"]


@query("fold_equals_rebuild_global", "SELECT * FROM totals")
def _fold_global(lib: Library) -> DataFrame:
    return _folded(lib)["global_stats"]


@query("fold_equals_rebuild_first", "SELECT * FROM firsts")
def _fold_first(lib: Library) -> DataFrame:
    return _folded(lib)["first_listens"]


def _stored(lib: Library, heard: DataFrame) -> rollups.Lazily:
    return rollups.Lazily(
        daily=lambda: rollups.daily(heard), clock=lambda: rollups.clock(heard), first_listens=lambda: cut(rollups.first_listens(heard, lib.song_albums, lib.song_artists)),
        global_stats=lambda: rollups.global_stats(heard, lib.song_albums, lib.song_artists),
    )


def _folded(lib: Library) -> dict[str, DataFrame]:
    return rollups.fold(_stored(lib, lib.eligible.where("id % 3 <> 0")), lib.eligible.where("id % 3 = 0"), lib.song_albums, lib.song_artists)


_LEFT = {
    "kept": "SELECT * FROM heard WHERE id % 50 <> 0",
    "kept_attributed": """SELECT h.*, 'song' AS entity_type, song_id AS entity_id FROM kept h
      UNION ALL SELECT h.*, 'album', album_id FROM kept h JOIN song_albums USING (song_id)
      UNION ALL SELECT h.*, 'artist', artist_id FROM kept h JOIN song_artists USING (song_id)""",
}


def _unrecorded(lib: Library) -> dict[str, DataFrame]:
    gone, left = lib.eligible.where("id % 50 = 0"), lib.eligible.where("id % 50 <> 0")
    return rollups.unrecord(_stored(lib, lib.eligible), gone, left, lib.song_albums, lib.song_artists)


query("unrecord_daily", "SELECT user_id, song_id, listened_at::DATE AS day, count(*) AS listen_count, sum(played_ms)::BIGINT AS played_ms FROM kept GROUP BY ALL", **_LEFT)(
    lambda lib: _unrecorded(lib)["daily"]
)
query("unrecord_clock", "SELECT user_id, listened_at::DATE AS day, hour(listened_at) AS hour, count(*) AS listen_count FROM kept GROUP BY ALL", **_LEFT)(lambda lib: _unrecorded(lib)["clock"])
query("unrecord_first_listens", "SELECT user_id, entity_type, entity_id, min(listened_at) AS first_at FROM kept_attributed GROUP BY ALL", **_LEFT)(lambda lib: _unrecorded(lib)["first_listens"])
query(
    "unrecord_global_stats",
    """SELECT entity_type, entity_id, count(*) AS plays, count(DISTINCT user_id) AS unique_listeners, sum(played_ms)::BIGINT AS played_ms,
      min(listened_at) AS first_listened_at FROM kept_attributed GROUP BY ALL""",
    **_LEFT,
)(lambda lib: _unrecorded(lib)["global_stats"])

# ---- summaries

_SUMMARY = """SELECT coalesce(sum(listen_count), 0)::BIGINT AS listen_count, count(DISTINCT song_id) AS unique_tracks, coalesce(sum(played_ms), 0)::DOUBLE / 60000 AS minutes_listened,
  count(DISTINCT day) AS days_active, (SELECT count(DISTINCT album_id) FROM scoped JOIN song_albums USING (song_id)) AS unique_albums,
  (SELECT count(DISTINCT artist_id) FROM scoped JOIN song_artists USING (song_id)) AS unique_artists FROM scoped"""
_RATIOS = """SELECT s.*, CASE WHEN days_active = 0 THEN 0 ELSE listen_count::DOUBLE / days_active END AS avg_daily_plays,
  CASE WHEN unique_artists = 0 THEN 0 ELSE unique_tracks::DOUBLE / unique_artists END AS tracks_per_artist,
  CASE WHEN unique_artists = 0 THEN 0 ELSE unique_albums::DOUBLE / unique_artists END AS albums_per_artist"""


def _session_sql(period: Timeframe) -> str:
    return f"""SELECT coalesce(avg(span) / 1000, 0)::DOUBLE AS avg_session_length_ms FROM (
      SELECT session, epoch_us(max(listened_at)) - epoch_us(min(listened_at)) AS span FROM (
      SELECT listened_at, sum(opens) OVER (ORDER BY listened_at) AS session FROM (
      SELECT listened_at, CASE WHEN listened_at - lag(listened_at) OVER (ORDER BY listened_at) <= INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS opens
      FROM listens WHERE user_id = {USER} AND {_between(period)})) GROUP BY session)"""


query("summary_global", _RATIOS + " FROM summary s", scoped=f"SELECT * FROM daily WHERE {_days(JANUARY)}", summary=_SUMMARY)(lambda lib: stats.summary(lib, JANUARY))
query(
    "summary_user",
    _RATIOS + ", longest_streak, avg_session_length_ms FROM summary s, streak, session",
    scoped=f"SELECT * FROM daily WHERE user_id = {USER} AND {_days(JANUARY)}",
    summary=_SUMMARY,
    streak=f"SELECT coalesce(max(n), 0) AS longest_streak FROM (SELECT count(*) AS n FROM (SELECT day - row_number() OVER (ORDER BY day)::INTEGER AS g FROM (SELECT DISTINCT day FROM scoped)) GROUP BY g)",
    session=_session_sql(JANUARY),
)(lambda lib: stats.summary(lib, JANUARY, USER))
query("summary_within_one_day", _RATIOS + " FROM summary s", scoped="SELECT * FROM daily WHERE false", summary=_SUMMARY)(
    lambda lib: stats.summary(lib, Timeframe(datetime(2024, 1, 5, 10), datetime(2024, 1, 5, 18)))
)
query("avg_session", _session_sql(JANUARY))(lambda lib: stats.average_session(lib, USER, JANUARY))
query(
    "session_windows",
    """SELECT user_id, min(listened_at) AS start_at, max(listened_at) AS end_at, count(*) AS listens FROM (
      SELECT user_id, listened_at, sum(opens) OVER (PARTITION BY user_id ORDER BY listened_at) AS session FROM (
      SELECT user_id, listened_at, CASE WHEN listened_at - lag(listened_at) OVER (PARTITION BY user_id ORDER BY listened_at) <= INTERVAL 5 MINUTES THEN 0 ELSE 1 END AS opens
      FROM listens)) GROUP BY user_id, session""",
)(lambda lib: stats.sessions(lib.listens).withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("start_at", "end_at")}))

# ---- leaders

_SCOPED_USER = f"SELECT * FROM daily WHERE user_id = {USER} AND {_days(JANUARY)}"
_SCOPED_ALL = f"SELECT * FROM daily WHERE {_days(JANUARY)}"
_SUMS = "sum(listen_count)::BIGINT AS listen_count, sum(played_ms)::DOUBLE / 60000 AS minutes_listened"


def _artists_sql(user: bool, metric: str, limit: int, offset: int = 0) -> str:
    flag = f"artist_id IN (SELECT artist_id FROM blacklist WHERE user_id = {USER})" if user else "false"
    return f"""SELECT artist_id, {_SUMS}, any_value(name) AS name, {flag} AS blacklisted FROM scoped JOIN song_artists USING (song_id) JOIN artists ON id = artist_id
      GROUP BY artist_id ORDER BY blacklisted, {metric} DESC, name, artist_id LIMIT {limit} OFFSET {offset}"""


def _albums_sql(user: bool, metric: str, limit: int) -> str:
    flag = f"album_id IN (SELECT album_id FROM album_artists JOIN blacklist USING (artist_id) WHERE user_id = {USER})" if user else "false"
    return f"""SELECT t.*, coalesce(p.artist_id, 0) AS artist_id, coalesce(p.name, '') AS artist_name FROM (
      SELECT album_id, {_SUMS}, any_value(name) AS name, {flag} AS blacklisted FROM scoped JOIN song_albums USING (song_id) JOIN albums ON id = album_id
      GROUP BY album_id ORDER BY blacklisted, {metric} DESC, name, album_id LIMIT {limit}) t
      LEFT JOIN (SELECT album_id, artist_id, name FROM album_artists JOIN artists ON id = artist_id WHERE position = 0) p USING (album_id)"""


def _tracks_sql(user: bool, metric: str, limit: int, where: str = "true") -> str:
    flag = f"song_id IN (SELECT song_id FROM song_artists JOIN blacklist USING (artist_id) WHERE user_id = {USER})" if user else "false"
    return f"""SELECT t.*, coalesce(artist_id, 0) AS artist_id, coalesce(artist_name, '') AS artist_name, coalesce(album_id, 0) AS album_id, coalesce(album_name, '') AS album_name FROM (
      SELECT song_id, {_SUMS}, any_value(name) AS name, {flag} AS blacklisted FROM scoped JOIN songs ON id = song_id WHERE {where}
      GROUP BY song_id ORDER BY blacklisted, {metric} DESC, name, song_id LIMIT {limit}) t
      LEFT JOIN first_artist USING (song_id) LEFT JOIN first_album USING (song_id)"""


_OF_ARTIST = f"song_id IN (SELECT song_id FROM song_artists WHERE artist_id = {ARTIST})"
_OF_ALBUM = f"song_id IN (SELECT song_id FROM song_albums WHERE album_id = {ALBUM})"
query("top_artists_listens", _artists_sql(False, "listen_count", 20), scoped=_SCOPED_ALL)(lambda lib: stats.top_artists(lib, JANUARY))
query("top_artists_minutes", _artists_sql(True, "minutes_listened", 20), scoped=_SCOPED_USER)(lambda lib: stats.top_artists(lib, JANUARY, USER, sort_by="minutes"))
query("top_page2", _artists_sql(False, "listen_count", 20, 20), scoped=_SCOPED_ALL)(lambda lib: stats.top_artists(lib, JANUARY, offset=20))
query("top_blacklisted", _artists_sql(True, "listen_count", 1000), scoped=_SCOPED_USER)(lambda lib: stats.top_artists(lib, JANUARY, USER, limit=1000))
query("top_albums", _albums_sql(False, "listen_count", 20), scoped=_SCOPED_ALL)(lambda lib: stats.top_albums(lib, JANUARY))
query("top_albums_user", _albums_sql(True, "minutes_listened", 10), scoped=_SCOPED_USER)(lambda lib: stats.top_albums(lib, JANUARY, USER, sort_by="minutes", limit=10))
query("top_tracks", _tracks_sql(False, "listen_count", 20), scoped=_SCOPED_ALL)(lambda lib: stats.top_tracks(lib, JANUARY))
query("top_tracks_user", _tracks_sql(True, "listen_count", 20), scoped=_SCOPED_USER)(lambda lib: stats.top_tracks(lib, JANUARY, USER))
query("top_tracks_artist_scope", _tracks_sql(False, "minutes_listened", 20, _OF_ARTIST), scoped=_SCOPED_ALL)(lambda lib: stats.top_tracks(lib, JANUARY, artist_id=ARTIST, sort_by="minutes"))
query("top_tracks_album_scope", _tracks_sql(False, "listen_count", 20, _OF_ALBUM), scoped=_SCOPED_ALL)(lambda lib: stats.top_tracks(lib, JANUARY, album_id=ALBUM))

# ---- over time


def _series(period: Timeframe, step: str) -> str:
    return f"SELECT unnest(generate_series(TIMESTAMP '{period.start}', TIMESTAMP '{period.stop}', INTERVAL 1 {step})) AS bucket"


def _activity_sql(step: str, where: str = "true") -> str:
    return f"""SELECT bucket, coalesce(sum(listen_count), 0)::BIGINT AS listen_count, coalesce(sum(played_ms), 0)::DOUBLE / 60000 AS minutes_listened FROM series
      LEFT JOIN (SELECT * FROM daily WHERE {where}) ON day::TIMESTAMP >= bucket AND day::TIMESTAMP < bucket + INTERVAL 1 {step} GROUP BY bucket"""


for _step in ("day", "week", "month"):
    query(f"activity_{_step}", _activity_sql(_step), series=_series(JANUARY, _step))(lambda lib, s=_step: stats.activity(lib, JANUARY, s))
_END_OF_MONTH = Timeframe(datetime(2023, 10, 31), datetime(2024, 4, 15))
query("activity_month_ends", _activity_sql("month"), series="""SELECT unnest([TIMESTAMP '2023-10-31', TIMESTAMP '2023-11-30', TIMESTAMP '2023-12-30', TIMESTAMP '2024-01-30', TIMESTAMP '2024-02-29', TIMESTAMP '2024-03-29']) AS bucket""")(
    lambda lib: stats.activity(lib, _END_OF_MONTH, "month")
)
query("activity_entity", _activity_sql("day", f"user_id = {USER} AND {_OF_ARTIST}"), series=_series(JANUARY, "day"))(lambda lib: stats.activity(lib, JANUARY, "day", USER, artist_id=ARTIST))
query("activity_odd_start", _activity_sql("week"), series=_series(ODD, "week"))(lambda lib: stats.activity(lib, ODD, "week"))
_CLAMPED = "SELECT unnest(generate_series((SELECT greatest(min(listened_at), TIMESTAMP '2000-01-01') FROM listens WHERE user_id = 7), TIMESTAMP '2024-02-01', INTERVAL 1 day)) AS bucket"
query("activity_clamped", _activity_sql("day", f"user_id = {USER}"), series=_CLAMPED)(
    lambda lib: stats.activity(lib, stats.clamp(lib, Timeframe(datetime(2000, 1, 1), datetime(2024, 2, 1)), USER), "day", USER)
)


def _discovery_sql(step: str, where: str) -> str:
    return f"""SELECT bucket, total, discoveries, CASE WHEN total = 0 THEN 0 ELSE discoveries::DOUBLE / total END AS rate FROM (
      SELECT bucket, coalesce((SELECT sum(listen_count) FROM daily WHERE {where} AND day::TIMESTAMP >= bucket AND day::TIMESTAMP < bucket + INTERVAL 1 {step}), 0)::BIGINT AS total,
      (SELECT count(*) FROM firsts WHERE {where} AND entity_type = 'song' AND first_at >= bucket AND first_at < bucket + INTERVAL 1 {step}) AS discoveries FROM series)"""


query("discovery", _discovery_sql("day", "true"), series=_series(JANUARY, "day"))(lambda lib: stats.discovery(lib, JANUARY, "day"))
query("discovery_user_week", _discovery_sql("week", f"user_id = {USER}"), series=_series(ODD, "week"))(lambda lib: stats.discovery(lib, ODD, "week", USER))


def _interest_sql(unit: str, where: str) -> str:
    return f"""SELECT bucket, count(t) AS listen_count FROM (
      SELECT unnest(generate_series((SELECT min(t) FROM own), date_trunc('{unit}', TIMESTAMP '{NOW}'), INTERVAL 1 {unit}))::TIMESTAMP AS bucket) LEFT JOIN own ON t = bucket GROUP BY bucket"""


def _own(unit: str, where: str) -> str:
    return f"SELECT date_trunc('{unit}', least(listened_at, TIMESTAMP '{NOW}'))::TIMESTAMP AS t FROM heard WHERE {where}"


query("interest_song", _interest_sql("day", ""), own=_own("day", f"song_id = {SONG}"))(lambda lib: stats.interest(lib, NOW, "day", song_id=SONG))
query("interest_artist_month", _interest_sql("month", ""), own=_own("month", _OF_ARTIST))(lambda lib: stats.interest(lib, NOW, "month", artist_id=ARTIST))
query("interest_album_week_user", _interest_sql("week", ""), own=_own("week", f"user_id = {USER} AND {_OF_ALBUM}"))(lambda lib: stats.interest(lib, NOW, "week", USER, album_id=ALBUM))


def _clock_sql(local: str, where: str = "true") -> str:
    return f"""SELECT day_of_week, hour, coalesce(n, 0)::BIGINT AS listen_count FROM (SELECT i // 24 AS day_of_week, i % 24 AS hour FROM range(168) t(i))
      LEFT JOIN (SELECT dayofweek(t) AS day_of_week, hour(t) AS hour, sum(listen_count) AS n FROM (
      SELECT {local} AS t, listen_count FROM clock WHERE {where} AND {_days(JANUARY)}) GROUP BY ALL) USING (day_of_week, hour)"""


query("clock_utc", _clock_sql("day + to_hours(hour)"))(lambda lib: stats.clock_grid(lib, JANUARY))
# New York is five hours behind all through January, Kolkata five and a half ahead.
query("clock_tz", _clock_sql("day + to_hours(hour) - INTERVAL 5 HOURS"))(lambda lib: stats.clock_grid(lib, JANUARY, "America/New_York"))
query("clock_tz_user", _clock_sql("day + to_hours(hour) + INTERVAL 330 MINUTES", f"user_id = {USER}"))(lambda lib: stats.clock_grid(lib, JANUARY, "Asia/Kolkata", USER))
query(
    "heat_levels",
    """SELECT level, v[least(len(v) - 1, floor(p * len(v))::BIGINT) + 1] AS up_to FROM (SELECT list_sort(list(n)) AS v FROM (SELECT sum(listen_count)::BIGINT AS n FROM daily GROUP BY day)),
      (VALUES (1::BIGINT, 0.25::DOUBLE), (2, 0.5), (3, 0.75), (4, 1.0)) l(level, p)""",
)(lambda lib: stats.heat_levels(stats.activity(lib, JANUARY, "day")))
query(
    "calendar_weeks",
    f"""SELECT i // 7 AS week, i % 7 AS weekday, d AS day, coalesce((SELECT sum(listen_count) FROM daily WHERE user_id = {USER} AND day = d), 0)::BIGINT AS listen_count
      FROM (SELECT i, DATE '2024-01-01' + i::INTEGER AS d FROM range(35) t(i))""",
)(lambda lib: stats.calendar(lib, USER, date(2024, 1, 3), 5))

# ---- others

query(
    "sources_breakdown",
    f"""SELECT coalesce(p.source_type, 'unknown') AS source_type, count(*) AS listen_count FROM heard LEFT JOIN (
      SELECT entity_id AS song_id, source_type FROM sources QUALIFY row_number() OVER (PARTITION BY entity_id ORDER BY correlation_method = 'source_id' DESC, id) = 1) p USING (song_id)
      WHERE {_between(JANUARY)} GROUP BY 1""",
)(lambda lib: stats.sources_breakdown(lib, JANUARY))
query(
    "rewind_top",
    f"""SELECT n.*, coalesce(p.n, 0)::BIGINT AS prior_count, (listen_count - coalesce(p.n, 0))::BIGINT AS delta FROM ({_artists_sql(True, "listen_count", 5)}) n
      LEFT JOIN (SELECT artist_id, sum(listen_count) AS n FROM daily JOIN song_artists USING (song_id) WHERE user_id = {USER} AND {_days(LATE.before())} GROUP BY 1) p USING (artist_id)""",
    scoped=f"SELECT * FROM daily WHERE user_id = {USER} AND {_days(LATE)}",
)(lambda lib: stats.rewind_top(lib, USER, LATE, "artists"))
query(
    "rewind_tracks",
    f"""SELECT n.*, coalesce(p.n, 0)::BIGINT AS prior_count, (listen_count - coalesce(p.n, 0))::BIGINT AS delta FROM ({_tracks_sql(True, "listen_count", 5)}) n
      LEFT JOIN (SELECT song_id, sum(listen_count) AS n FROM daily WHERE user_id = {USER} AND {_days(LATE.before())} GROUP BY 1) p USING (song_id)""",
    scoped=f"SELECT * FROM daily WHERE user_id = {USER} AND {_days(LATE)}",
)(lambda lib: stats.rewind_top(lib, USER, LATE, "tracks"))
query(
    "rewind_new_counts",
    f"""SELECT count(CASE WHEN entity_type = 'song' THEN 1 END) AS new_tracks, count(CASE WHEN entity_type = 'album' THEN 1 END) AS new_albums,
      count(CASE WHEN entity_type = 'artist' THEN 1 END) AS new_artists FROM firsts WHERE user_id = {USER} AND {_between(LATE, "first_at")}""",
)(lambda lib: stats.new_entities(lib, USER, LATE))
query("top_day", f"SELECT day, sum(listen_count)::BIGINT AS listen_count FROM daily WHERE user_id = {USER} AND {_days(JANUARY)} GROUP BY day ORDER BY 2 DESC, 1 LIMIT 1")(
    lambda lib: stats.top_day(lib, USER, JANUARY)
)
query("entity_summary_global", f"SELECT plays, unique_listeners, played_ms::DOUBLE / 60000 AS minutes_listened, first_listened_at FROM totals WHERE entity_type = 'album' AND entity_id = {ALBUM}")(
    lambda lib: stats.entity_summary(lib, "album", ALBUM)
)
query("entity_summary_user", f"SELECT count(*) AS plays, coalesce(sum(played_ms), 0)::DOUBLE / 60000 AS minutes_listened, min(listened_at) AS first_listened_at FROM heard WHERE user_id = {USER} AND {_OF_ARTIST}")(
    lambda lib: stats.entity_summary(lib, "artist", ARTIST, USER)
)
query("earliest_listen", f"SELECT min(listened_at) AS first_at FROM listens WHERE user_id = {USER}")(lambda lib: stats.earliest_listen(lib, USER))

# ---- history

_WITH_MIRROR = "song_id IN (SELECT entity_id FROM sources WHERE source_type = 'MIRROR')"
query(
    "history_filtered",
    f"SELECT id, user_id, song_id, listened_at, client FROM listens WHERE user_id = {USER} AND {_between(JANUARY)} AND {_WITH_MIRROR} ORDER BY listened_at DESC, id DESC LIMIT 10 OFFSET 10",
)(lambda lib: history.page(history.newest_first(history.history(lib, JANUARY, USER, source_type="MIRROR")), 2, 10))
query("history_count", f"SELECT count(*) AS n FROM listens WHERE {_between(ODD)} AND {_OF_ALBUM} AND {_OF_ARTIST}")(lambda lib: history.count(history.history(lib, ODD, album_id=ALBUM, artist_id=ARTIST)))
query(
    "entity_listens_visible",
    f"""SELECT h.id, CASE WHEN public THEN user_id END AS user_id, CASE WHEN public THEN username END AS username, song_id, listened_at FROM heard h JOIN users u ON u.id = user_id
      WHERE {_OF_ARTIST} ORDER BY listened_at DESC, h.id DESC LIMIT 100""",
)(lambda lib: history.page(history.newest_first(history.entity_listens(lib, artist_id=ARTIST)), 1, 100))
query("entity_listens_count", f"SELECT count(*) AS n FROM heard JOIN users u ON u.id = user_id WHERE {_OF_ALBUM}")(lambda lib: history.count(history.entity_listens(lib, album_id=ALBUM)))
query(
    "now_playing",
    f"""SELECT user_id, username, song_id, started_at, duration_ms FROM now_playing JOIN users u ON u.id = user_id
      WHERE (public OR user_id = {USER}) AND started_at + to_milliseconds(coalesce(duration_ms, 0)) >= TIMESTAMP '{LISTENING}'""",
)(lambda lib: history.now_playing(lib, LISTENING, viewer_id=USER))
query(
    "now_playing_artist",
    f"""SELECT user_id, username, song_id, started_at, duration_ms FROM now_playing JOIN users u ON u.id = user_id
      WHERE public AND started_at + to_milliseconds(coalesce(duration_ms, 0)) >= TIMESTAMP '2024-01-30' AND {_OF_ARTIST}""",
)(lambda lib: history.now_playing(lib, datetime(2024, 1, 30), artist_id=ARTIST))
query(
    "listens_search",
    f"""SELECT l.id, song_id, listened_at FROM listens l JOIN songs s ON s.id = song_id WHERE user_id = {USER} AND (s.name ILIKE '%red%'
      OR song_id IN (SELECT song_id FROM song_artists JOIN artists a ON a.id = artist_id WHERE a.name ILIKE '%red%'))""",
)(lambda lib: history.search_listens(lib, USER, "red"))
query(
    "songs_primary_info",
    """SELECT id AS song_id, coalesce(artist_id, 0) AS artist_id, coalesce(artist_name, '') AS artist_name, coalesce(album_id, 0) AS album_id, coalesce(album_name, '') AS album_name
      FROM songs LEFT JOIN first_artist ON song_id = id LEFT JOIN first_album a ON a.song_id = id""",
)(lambda lib: stats.song_primaries(lib, lib.songs.select(F.col("id").alias("song_id"))))
query(
    "search_songs",
    """SELECT id, name, ((lower(name) LIKE '%red%')::INTEGER + (lower(name) LIKE '%bolt%')::INTEGER) / 2.0::DOUBLE AS score FROM songs
      WHERE lower(name) LIKE '%red%' OR lower(name) LIKE '%bolt%' ORDER BY score DESC, name, id LIMIT 25""",
)(lambda lib: history.search_names(lib.songs, None, "Red bolt"))

# ---- catalogue

query("songs_by_source", "SELECT s.* FROM songs s JOIN sources x ON x.entity_id = s.id WHERE x.source_type = 'MIRROR' AND x.extracted_id = 'MIRROR-42'")(
    lambda lib: catalogue.by_source(lib.songs, lib.sources, "song", "MIRROR", "MIRROR-42")
)
query("songs_by_ids", "SELECT * FROM songs WHERE id IN (1, 5, 77)")(lambda lib: catalogue.by_ids(lib.songs, [1, 5, 77]))
query(
    "songs_by_name_and_artists",
    f"""SELECT * FROM songs WHERE name = (SELECT name FROM songs WHERE id = {SONG}) AND id IN (SELECT song_id FROM song_artists WHERE artist_id IN (1, 2, {ARTIST}))""",
)(lambda lib: lib.songs.join(lib.songs.where(F.col("id") == SONG).select("name"), "name", "left_semi").join(
    lib.song_artists.where(F.col("artist_id").isin(1, 2, ARTIST)).select(F.col("song_id").alias("id")), "id", "left_semi").select(*lib.songs.columns))
query("songs_of_album", f"SELECT id, name, duration_ms, pinned, track_number FROM songs JOIN song_albums ON song_id = id WHERE album_id = {ALBUM}")(
    lambda lib: catalogue.linked(lib.song_albums, "album_id", ALBUM, lib.songs, "song_id", F.asc_nulls_last("track_number"), "name")
)
query("artists_of_album", f"SELECT id, name, position FROM artists JOIN album_artists ON artist_id = id WHERE album_id = {ALBUM}")(
    lambda lib: catalogue.linked(lib.album_artists, "album_id", ALBUM, lib.artists, "artist_id", "position")
)
query("albums_of_artist", f"SELECT a.id, name, position FROM albums a JOIN album_artists ON album_id = a.id WHERE artist_id = {ARTIST}")(
    lambda lib: catalogue.linked(lib.album_artists, "artist_id", ARTIST, lib.albums, "album_id", F.asc_nulls_last("release_date"), "name").drop("release_date")
)
query("songs_page", "SELECT * FROM songs WHERE id > 50 ORDER BY id LIMIT 25")(lambda lib: catalogue.page_after(lib.songs, 50, 25))
_STAMPED = "SELECT id, name, pinned, TIMESTAMP '2024-01-01' + to_days((id % 40)::INTEGER) AS updated_at FROM songs"
query("stale_entities", "SELECT * FROM stamped WHERE updated_at < TIMESTAMP '2024-01-15' AND NOT pinned ORDER BY updated_at, id LIMIT 30", stamped=_STAMPED)(
    lambda lib: catalogue.stale(
        lib.songs.select("id", "name", "pinned", (F.lit(datetime(2024, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval((F.col("id") % 40).cast("int"))).alias("updated_at")), datetime(2024, 1, 15), 30
    )
)
query("update_unless_pinned", "SELECT id, CASE WHEN id = 13 AND NOT pinned OR id = 14 AND NOT pinned THEN 'renamed' ELSE name END AS name, duration_ms, pinned FROM songs")(
    lambda lib: catalogue.update(catalogue.update(lib.songs, 13, True, name=F.lit("renamed")), 14, True, name=F.lit("renamed"))
)
_TABLES_OF = {"artists": ["id"], "song_artists": ["song_id", "artist_id"], "album_artists": ["album_id", "artist_id"], "blacklist": ["user_id", "artist_id"], "aliases": ["entity_id", "entity_type"], "sources": ["entity_id", "entity_type"]}


@query("delete_entity", """SELECT 'artists' AS t, id AS a, NULL::VARCHAR AS b FROM artists WHERE id NOT IN (1, 2, 4) UNION ALL SELECT 'song_artists', song_id, artist_id::VARCHAR FROM song_artists WHERE artist_id NOT IN (1, 2, 4)
      UNION ALL SELECT 'album_artists', album_id, artist_id::VARCHAR FROM album_artists WHERE artist_id NOT IN (1, 2, 4) UNION ALL SELECT 'blacklist', user_id, artist_id::VARCHAR FROM blacklist WHERE artist_id NOT IN (1, 2, 4)
      UNION ALL SELECT 'aliases', entity_id, entity_type FROM aliases WHERE entity_type <> 'artist' OR entity_id NOT IN (1, 2, 4) UNION ALL SELECT 'sources', entity_id, entity_type FROM sources""")  # fmt: skip
def _delete_entity(lib: Library) -> DataFrame:
    left = catalogue.delete_entity({t: getattr(lib, t) for t in _TABLES_OF}, "artist", lib.artists.where("id IN (1, 2, 4)").select("id"))
    parts = [left[t].select(F.lit(t).alias("t"), F.col(c[0]).alias("a"), (F.col(c[1]).cast("string") if c[1:] else F.lit(None).cast("string")).alias("b")) for t, c in _TABLES_OF.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


query("blacklisted_artists", f"SELECT id, name FROM artists WHERE id IN (SELECT artist_id FROM blacklist WHERE user_id = {USER})")(
    lambda lib: lib.artists.join(lib.blacklist.where(F.col("user_id") == USER).select(F.col("artist_id").alias("id")), "id", "left_semi").orderBy("name")
)
query("search_documents", """SELECT d.*, coalesce(x.aliases, '') AS aliases FROM (SELECT 'song' AS kind, id, name, coalesce((SELECT string_agg(DISTINCT a.name, '|' ORDER BY a.name) FROM song_artists x JOIN artists a ON a.id = x.artist_id WHERE x.song_id = s.id), '') AS artists,
      coalesce((SELECT string_agg(DISTINCT a.name, '|' ORDER BY a.name) FROM song_albums x JOIN albums a ON a.id = x.album_id WHERE x.song_id = s.id), '') AS albums FROM songs s
      UNION ALL SELECT 'album', id, name, coalesce((SELECT string_agg(DISTINCT a.name, '|' ORDER BY a.name) FROM album_artists x JOIN artists a ON a.id = x.artist_id WHERE x.album_id = b.id), ''), '' FROM albums b
      UNION ALL SELECT 'artist', id, name, '', '' FROM artists) d
      LEFT JOIN (SELECT entity_type, entity_id, string_agg(DISTINCT alias, '|' ORDER BY alias) AS aliases FROM aliases GROUP BY ALL) x ON x.entity_type = d.kind AND x.entity_id = d.id""")(
    lambda lib: export.search_documents(lib).select("kind", "id", "name", *(F.array_join(c, "|").alias(c) for c in ("artists", "albums", "aliases")))
)
query("export_listens", f"SELECT song_id, listened_at, client, duration_played_ms FROM listens WHERE user_id = {USER} AND song_id IN (SELECT id FROM songs)")(lambda lib: export.export_listens(lib, USER))

# ---- merging: songs whose ids leave 1 by 5 go into the one before

_LOSERS = "SELECT id AS loser_id, id - 1 AS winner_id FROM songs WHERE id % 5 = 1 AND id > 1"


def _merged(lib: Library) -> Library:
    losers = lib.songs.where("id % 5 = 1 AND id > 1").select(F.col("id").alias("loser_id"), (F.col("id") - 1).alias("winner_id"))
    return merging.merge(lib, "song", losers)


query("merge_song_artists", """SELECT coalesce(winner_id, song_id) AS song_id, artist_id, arg_min(position, [(winner_id IS NOT NULL)::INTEGER, position]) AS position
      FROM song_artists LEFT JOIN losers ON loser_id = song_id GROUP BY 1, 2""", losers=_LOSERS)(lambda lib: _merged(lib).song_artists)  # fmt: skip
_KEPT = """SELECT user_id, coalesce(winner_id, song_id) AS song_id, listened_at, id, client, duration_played_ms FROM listens LEFT JOIN losers ON loser_id = song_id
  QUALIFY row_number() OVER (PARTITION BY user_id, coalesce(winner_id, song_id), listened_at ORDER BY winner_id IS NOT NULL, id) = 1"""
query("merge_listens", "SELECT user_id, song_id, listened_at, id, client, duration_played_ms FROM moved", losers=_LOSERS, moved=_KEPT)(
    lambda lib: _merged(lib).listens.select("user_id", "song_id", "listened_at", "id", "client", "duration_played_ms")
)
query("merge_sources", "SELECT id, entity_type, coalesce(winner_id, entity_id) AS entity_id, source_type, extracted_id, correlation_method FROM sources LEFT JOIN losers ON loser_id = entity_id", losers=_LOSERS)(
    lambda lib: _merged(lib).sources
)
query("merge_then_rebuild", """SELECT user_id, song_id, listened_at::DATE AS day, count(*) AS listen_count, sum(coalesce(duration_played_ms, duration_ms, 0))::BIGINT AS played_ms
      FROM moved JOIN songs s ON s.id = song_id WHERE s.id NOT IN (SELECT loser_id FROM losers) AND (coalesce(s.duration_ms, 0) <= 0
      OR 2 * coalesce(duration_played_ms, s.duration_ms, 0) >= s.duration_ms OR coalesce(duration_played_ms, s.duration_ms, 0) >= 240000) GROUP BY ALL""", losers=_LOSERS, moved=_KEPT)(
    lambda lib: _merged(lib).daily
)
query("merge_suggestions", """SELECT 'song' AS entity_type, least(a.id, b.id) AS lo_id, greatest(a.id, b.id) AS hi_id, 0.7::DOUBLE AS score FROM songs a JOIN songs b ON b.id = a.id + 1 AND a.name = b.name""")(
    lambda lib: merging.suggestions(
        lib.songs.select(F.col("id").alias("a"), "name").join(lib.songs.select((F.col("id") - 1).alias("a"), F.col("id").alias("b"), F.col("name").alias("n")), "a").where("name = n")
        .select(F.lit("song").alias("entity_type"), F.col("b").alias("a"), F.col("a").alias("b"), F.lit(0.7).alias("score"))
    )
)

# ---- text and matching

_GRAMS = "list_distinct(flatten(list_transform(list_filter(regexp_split_to_array(lower({0}), '[^\\p{{L}}\\p{{N}}]+'), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substr('  ' || w || ' ', i, 3)))))"
_SIMILARITY = "len(list_intersect(g, h))::DOUBLE / len(list_distinct(list_concat(g, h)))"


@table_query("trigram_similarity", f"""SELECT a, b, CASE WHEN len(g) = 0 OR len(h) = 0 THEN 0 ELSE {_SIMILARITY} END AS similarity FROM (
  SELECT x.n_name AS a, y.n_name AS b, {_GRAMS.format('x.n_name')} AS g, {_GRAMS.format('y.n_name')} AS h FROM nation x JOIN nation y ON x.n_regionkey = y.n_regionkey)""")  # fmt: skip
def _trigram_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = fixtures.read(spark, sf_dir, "nation")
    x, y = n.select(F.col("n_name").alias("a"), "n_regionkey"), n.select(F.col("n_name").alias("b"), "n_regionkey")
    return x.join(y, "n_regionkey").select("a", "b", text.trigram_similarity(F.col("a"), F.col("b")).alias("similarity"))


@table_query("trigram_matches", f"""WITH names AS (SELECT DISTINCT p_name AS name FROM part), queries AS (SELECT DISTINCT p_name || ' live' AS query FROM part),
  pairs AS (SELECT query, name, {_GRAMS.format('query')} AS g, {_GRAMS.format('name')} AS h FROM queries, names),
  scored AS (SELECT query, name, {_SIMILARITY} AS similarity FROM pairs WHERE {_SIMILARITY} >= 0.3)
  SELECT query, name, similarity, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, name)::INTEGER AS rank FROM scored
  QUALIFY rank <= 10""")  # fmt: skip
def _trigram_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.read(spark, sf_dir, "part")
    asked = part.select(F.concat("p_name", F.lit(" live")).alias("query"))
    return matching.trigram_matches(asked, part.select(F.col("p_name").alias("name")))


@table_query("token_set_ratio", """WITH w AS (SELECT p_partkey, p_name AS a, p_name2 AS b, list_sort(list_distinct(string_split(lower(p_name), ' '))) AS x, list_sort(list_distinct(string_split(lower(p_name2), ' '))) AS y
    FROM (SELECT p_partkey, p_name, lead(p_name) OVER (ORDER BY p_partkey) AS p_name2 FROM part) WHERE p_name2 IS NOT NULL),
  s AS (SELECT p_partkey, a, b, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c, array_to_string(list_sort(list_filter(x, lambda t: NOT list_contains(y, t))), ' ') AS l,
    array_to_string(list_sort(list_filter(y, lambda t: NOT list_contains(x, t))), ' ') AS r FROM w),
  t AS (SELECT *, trim(c || ' ' || l) AS c1, trim(c || ' ' || r) AS c2 FROM s)
  SELECT p_partkey, a, b, greatest(CASE WHEN greatest(length(c), length(c1)) = 0 THEN 1 ELSE 1 - levenshtein(c, c1)::DOUBLE / greatest(length(c), length(c1)) END,
    CASE WHEN greatest(length(c), length(c2)) = 0 THEN 1 ELSE 1 - levenshtein(c, c2)::DOUBLE / greatest(length(c), length(c2)) END,
    CASE WHEN greatest(length(c1), length(c2)) = 0 THEN 1 ELSE 1 - levenshtein(c1, c2)::DOUBLE / greatest(length(c1), length(c2)) END) AS ratio FROM t""")  # fmt: skip
def _token_set_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = fixtures.read(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("a"))
    after = part.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("a").alias("b"))
    return part.join(after, "p_partkey").select("p_partkey", "a", "b", text.token_set_ratio(F.col("a"), F.col("b")).alias("ratio"))


# Marks go, letters and digits stay, runs of anything printed between them are one blank, the rest goes without a trace.
@table_query("normalize_names", """SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(strip_accents(text)), '[\\p{P}\\p{S}\\p{Z}\\x09-\\x0D\\x1C-\\x1F\\x{85}]+', ' ', 'g'),
  '[^\\p{L}\\p{Nd} ]', '', 'g'), ' +', ' ', 'g')) AS normalized FROM documents""")
def _normalize_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = fixtures.read(spark, sf_dir, "documents")
    return docs.select("doc_id", text.normalize_name(F.col("text")).alias("normalized"))


@table_query("page_hosts", """SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#:]+)', 1) AS host FROM pages""")
def _page_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.read(spark, sf_dir, "pages").select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#:]+)", 1).alias("host"))


#: Links made of a number: what stands before and behind the digits, how many digits, the service that knows them.
_LINKS = [
    ("https://open.spotify.com/track/", 22, "?si=x", "spotify"), ("http://www.deezer.com/fr/track/", 9, "", "deezer"), ("https://musicbrainz.org/recording/00000000-0000-4000-8000-", 12, "#a", "musicbrainz"),
    ("https://music.youtube.com/watch?list=1&v=", 11, "&t=3", "ytmusic"), ("https://youtu.be/", 11, "", "ytmusic"), ("https://open.spotify.com/album/", 22, "", None), ("https://open.spotify.com/track/", 21, "", None),
    ("https://open.spotify.com/intl-de/track/", 22, "/", "spotify"),
]


def _link_cases(take, otherwise: str) -> str:
    return "CASE p_partkey % 8 " + " ".join(f"WHEN {i} THEN {take(*x)}" for i, x in enumerate(_LINKS)) + f" ELSE {otherwise} END"


_URL = _link_cases(lambda before, digits, behind, service: f"'{before}' || lpad(p_partkey::VARCHAR, {digits}, '0') || '{behind}'", "''")
_SERVICE = _link_cases(lambda before, digits, behind, service: f"'{service}'" if service else "NULL", "NULL")
_TRACK_ID = _link_cases(lambda before, digits, behind, service: (f"'{before.rpartition('/')[2]}' || " if service == "musicbrainz" else "") + f"lpad(p_partkey::VARCHAR, {digits}, '0')" if service else "NULL", "NULL")


@table_query("service_links", f"SELECT p_partkey, {_URL} AS url, {_SERVICE} AS service, {_TRACK_ID} AS track_id FROM part")
def _service_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, url = F.col("p_partkey"), F.lit("")
    for i, (before, digits, behind, _) in enumerate(_LINKS):
        url = F.when(key % 8 == i, F.concat(F.lit(before), F.lpad(key.cast("string"), digits, "0"), F.lit(behind))).otherwise(url)
    made = fixtures.read(spark, sf_dir, "part").select("p_partkey", url.alias("url"))
    return made.select("p_partkey", "url", links.service_of(F.col("url")).alias("service"), links.extracted_id(F.col("url")).alias("track_id"))


def text_versions(a: str, b: str) -> str:
    return " OR ".join(f"(position('{w}' IN lower({a})) > 0) <> (position('{w}' IN lower({b})) > 0)" for w in text.VERSION_WORDS)


@table_query("version_mismatch", f"SELECT p_partkey, ({text_versions('a', 'b')}) AS mismatch FROM (SELECT p_partkey, p_name || CASE WHEN p_partkey % 4 = 0 THEN ' (Live)' WHEN p_partkey % 4 = 1 THEN ' - Remaster' ELSE '' END AS a, p_name AS b FROM part)")
def _version_mismatch(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    a = F.concat("p_name", F.when(key % 4 == 0, " (Live)").when(key % 4 == 1, " - Remaster").otherwise(""))
    return fixtures.read(spark, sf_dir, "part").select("p_partkey", text.version_mismatch(a, F.col("p_name")).alias("mismatch"))


@table_query("duration_similarity", """SELECT o_orderkey, CASE WHEN a IS NULL OR b IS NULL OR a <= 0 OR b <= 0 THEN 1.0::DOUBLE WHEN abs(a - b) <= 15000 THEN 1 - abs(a - b)::DOUBLE / 15000 END AS similarity
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 9 > 0 THEN o_orderkey % 60 * 1000 END AS a, o_custkey % 60 * 1000 AS b FROM orders)""")  # fmt: skip
def _duration_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = F.when(F.col("o_orderkey") % 9 > 0, F.col("o_orderkey") % 60 * 1000)
    return fixtures.read(spark, sf_dir, "orders").select("o_orderkey", text.duration_similarity(a, F.col("o_custkey") % 60 * 1000).alias("similarity"))


@table_query("decide", """WITH scored AS (SELECT o_custkey AS input_id, o_custkey % 10 IN (0, 1) AS nobody, o_orderkey AS id, CASE WHEN o_orderkey % 11 > 0 THEN o_orderkey % 50 / 50.0::DOUBLE END AS score FROM orders),
  top AS (SELECT input_id, id, score, lead(score) OVER w AS runner_up, row_number() OVER w AS r FROM scored WHERE score IS NOT NULL AND NOT nobody WINDOW w AS (PARTITION BY input_id ORDER BY score DESC, id)),
  best AS (SELECT input_id, id, score, runner_up, score - 0.5::DOUBLE * CASE WHEN runner_up IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 0.15::DOUBLE - (score - runner_up)) END AS final FROM top WHERE r = 1)
  SELECT input_id, id, score, runner_up, final, CASE WHEN final >= 0.82::DOUBLE THEN 'accept' WHEN final >= 0.6::DOUBLE THEN 'suggest' ELSE 'create' END AS decision
  FROM (SELECT DISTINCT input_id FROM scored) LEFT JOIN best USING (input_id)""")  # fmt: skip
def _decide(spark: SparkSession, sf_dir: str) -> DataFrame:
    score = F.when(F.col("o_orderkey") % 11 > 0, F.col("o_orderkey") % 50 / F.lit(50.0))
    scored = fixtures.read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("input_id"), F.get(F.array(F.lit("various artists"), F.lit("unknown artist"), F.lit("x")), F.least(F.col("o_custkey") % 10, F.lit(2)).cast("int")).alias("name_normalized"), F.col("o_orderkey").alias("id"), score.alias("score"))
    return matching.decide(scored)


#: Candidates and scores in SQL. ``asked`` has (input_id, name, artists, duration_ms).
_MATCHING = {
    "known": """SELECT s.id, s.name, s.duration_ms, s.pinned, trim(regexp_replace(lower(s.name), '[^a-z0-9]+', ' ', 'g')) AS norm,
      list_sort(list_distinct(coalesce((SELECT list(artist_id::VARCHAR) FROM song_artists x WHERE x.song_id = s.id), []))) AS artists,
      list_distinct(string_split(trim(regexp_replace(lower(s.name), '[^a-z0-9]+', ' ', 'g')), ' ') || coalesce((SELECT flatten(list(regexp_split_to_array(lower(t), '[^a-z0-9]+'))) FROM (
        SELECT a.name AS t FROM song_artists x JOIN artists a ON a.id = x.artist_id WHERE x.song_id = s.id
        UNION ALL SELECT b.name FROM song_albums x JOIN albums b ON b.id = x.album_id WHERE x.song_id = s.id
        UNION ALL SELECT alias FROM aliases WHERE entity_type = 'song' AND entity_id = s.id)), [])) AS words FROM songs s""",
    "inputs": "SELECT *, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS norm FROM asked",
    "spellings": "SELECT DISTINCT norm AS q FROM inputs",
    "near": f"""SELECT q, id, similarity FROM (SELECT q, n, {_SIMILARITY} AS similarity FROM (SELECT q, {_GRAMS.format('q')} AS g FROM spellings) a, (SELECT n, {_GRAMS.format('n')} AS h FROM (SELECT DISTINCT norm AS n FROM known)) b)
      JOIN known ON norm = n WHERE similarity >= 0.3 QUALIFY row_number() OVER (PARTITION BY q ORDER BY similarity DESC, id) <= {{limit}}""",
    "worded": """SELECT q, id, len(list_intersect(w, words))::DOUBLE / len(w) AS share FROM (SELECT q, list_distinct(string_split(q, ' ')) AS w FROM spellings) a, known
      WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY q ORDER BY share DESC, id) <= {limit}""",
    "found": """SELECT input_id, k.id FROM inputs i JOIN known k ON k.name = i.name AND (len(i.artists) = 0 OR len(list_intersect(i.artists, k.artists)) > 0)
      UNION SELECT input_id, id FROM inputs JOIN near ON q = norm UNION SELECT input_id, id FROM inputs JOIN worded ON q = norm""",
    "named": """SELECT DISTINCT lower(i.name) AS a, lower(k.name) AS b FROM found f JOIN inputs i USING (input_id) JOIN known k ON k.id = f.id""",
    "lettered": """SELECT a, b, jaro_similarity(a, b) AS j, (CASE WHEN substr(a, 1, 1) <> substr(b, 1, 1) THEN 0 WHEN substr(a, 1, 2) <> substr(b, 1, 2) THEN 1 WHEN substr(a, 1, 3) <> substr(b, 1, 3) THEN 2
      WHEN substr(a, 1, 4) <> substr(b, 1, 4) THEN 3 ELSE 4 END) AS p, list_sort(list_distinct(string_split(a, ' '))) AS x, list_sort(list_distinct(string_split(b, ' '))) AS y FROM named""",
    "tokens": """SELECT a, b, CASE WHEN a = b THEN 1 ELSE j + 0.1::DOUBLE * p * (1 - j) END AS jw, array_to_string(list_sort(list_intersect(x, y)), ' ') AS c,
      trim(concat_ws(' ', array_to_string(list_sort(list_intersect(x, y)), ' '), array_to_string(list_filter(x, lambda t: NOT list_contains(y, t)), ' '))) AS c1,
      trim(concat_ws(' ', array_to_string(list_sort(list_intersect(x, y)), ' '), array_to_string(list_filter(y, lambda t: NOT list_contains(x, t)), ' '))) AS c2 FROM lettered""",
    "alike": """SELECT a, b, greatest(jw, 1 - levenshtein(c, c1)::DOUBLE / greatest(length(c), length(c1), 1), 1 - levenshtein(c, c2)::DOUBLE / greatest(length(c), length(c2), 1),
      1 - levenshtein(c1, c2)::DOUBLE / greatest(length(c1), length(c2), 1)) AS similarity FROM tokens""",
    "scored": f"""SELECT input_id, i.norm, k.id, CASE WHEN ({text_versions('i.name', 'k.name')}) OR (len(i.artists) > 0 AND len(k.artists) > 0 AND len(list_intersect(i.artists, k.artists)) = 0)
      OR (i.duration_ms > 0 AND k.duration_ms > 0 AND abs(i.duration_ms - k.duration_ms) > 15000) THEN NULL ELSE
      0.6::DOUBLE * similarity + 0.3::DOUBLE * CASE WHEN len(i.artists) = 0 OR len(k.artists) = 0 THEN 1.0::DOUBLE ELSE len(list_intersect(i.artists, k.artists))::DOUBLE / len(list_distinct(i.artists || k.artists)) END
      + 0.1::DOUBLE * CASE WHEN i.duration_ms > 0 AND k.duration_ms > 0 THEN 1 - abs(i.duration_ms - k.duration_ms)::DOUBLE / 15000 ELSE 1.0::DOUBLE END END AS score
      FROM found f JOIN inputs i USING (input_id) JOIN known k ON k.id = f.id JOIN alike ON a = lower(i.name) AND b = lower(k.name)""",
    "ranked": """SELECT input_id, id, score, lead(score) OVER w AS runner_up, row_number() OVER w AS r FROM scored WHERE score IS NOT NULL AND norm NOT IN ('various artists', 'unknown artist')
      WINDOW w AS (PARTITION BY input_id ORDER BY score DESC, id)""",
    "best": "SELECT *, score - 0.5::DOUBLE * CASE WHEN runner_up IS NULL THEN 0.0::DOUBLE ELSE greatest(0.0::DOUBLE, 0.15::DOUBLE - (score - runner_up)) END AS final FROM ranked WHERE r = 1",
    "decided": """SELECT input_id, id, score, runner_up, final, CASE WHEN final >= 0.82::DOUBLE THEN 'accept' WHEN final >= 0.6::DOUBLE THEN 'suggest' ELSE 'create' END AS decision
      FROM (SELECT input_id FROM inputs) LEFT JOIN best USING (input_id)""",
}


def _matching(limit: int, asked: str, **more: str) -> dict[str, str]:
    steps = {k: v.replace("{limit}", str(limit)) for k, v in _MATCHING.items()}
    return {"known": steps.pop("known"), "asked": asked} | {k: more.get(k, v) for k, v in steps.items()} | more


_ASKED = "SELECT id AS input_id, name || CASE WHEN id % 3 = 0 THEN ' (live)' ELSE '' END AS name, CASE WHEN id % 7 = 0 THEN [] ELSE artists END AS artists, duration_ms FROM known"


@query("resolve_songs", "SELECT input_id, id, round(score, 9) AS score, round(runner_up, 9) AS runner_up, round(final, 9) AS final, decision FROM decided", **_matching(10, _ASKED))
def _resolve(lib: Library) -> DataFrame:
    songs = ingest.known_entities(lib, "song")
    name = F.concat("name", F.when(F.col("id") % 3 == 0, " (live)").otherwise(""))
    artists = F.when(F.col("id") % 7 == 0, F.array().cast("array<string>")).otherwise(F.col("artists"))
    inputs = songs.select(F.col("id").alias("input_id"), name.alias("name"), artists.alias("artists"), "duration_ms").withColumn("name_normalized", text.normalize_name("name"))
    found = matching.resolve(inputs, songs)
    return found.select("input_id", "id", *(F.round(c, 9).alias(c) for c in ("score", "runner_up", "final")), "decision")


@query("reconcile_songs", """SELECT entity_type, winner_id, loser_id, max(score) AS score, min(action) AS action FROM (SELECT 'song' AS entity_type, CASE WHEN other.pinned THEN d.id ELSE least(input_id, d.id) END AS winner_id, CASE WHEN other.pinned THEN input_id ELSE greatest(input_id, d.id) END AS loser_id, round(final, 9) AS score,
      CASE WHEN decision = 'accept' AND NOT EXISTS (SELECT 1 FROM sources x JOIN sources y USING (source_type) WHERE x.entity_id = input_id AND y.entity_id = d.id AND x.extracted_id <> y.extracted_id) THEN 'merge' ELSE 'suggest' END AS action
      FROM decided d JOIN songs other ON other.id = d.id WHERE decision <> 'create') GROUP BY ALL""",
      **_matching(11, "SELECT id AS input_id, name, artists, duration_ms FROM known WHERE NOT pinned",
                  ranked=_MATCHING["ranked"].replace("WHERE score IS NOT NULL", "WHERE score IS NOT NULL AND input_id <> id")))
def _reconcile(lib: Library) -> DataFrame:
    songs = ingest.known_entities(lib, "song")
    return matching.reconcile(songs, songs.select("id"), "song", lib.sources).withColumn("score", F.round("score", 9))


# ---- a larger history


def _big(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rollups.eligible_listens(fixtures.big_listens(spark, sf_dir), fixtures.songs(spark, sf_dir))


_BIG = {
    "big": "SELECT l_orderkey * 8 + l_linenumber AS id, o_custkey AS user_id, l_partkey AS song_id, l_shipdate AS listened_at, (l_quantity * 10000)::BIGINT AS played FROM lineitem JOIN orders ON o_orderkey = l_orderkey",
    "big_heard": "SELECT b.*, coalesce(played, s.duration_ms, 0) AS played_ms FROM big b JOIN songs s ON s.id = song_id WHERE coalesce(s.duration_ms, 0) <= 0 OR 2 * coalesce(played, s.duration_ms, 0) >= s.duration_ms OR coalesce(played, s.duration_ms, 0) >= 240000",
}
QUERIES["big_rebuild_daily"] = lambda spark, sf_dir: rollups.daily(_big(spark, sf_dir))
ORACLES["big_rebuild_daily"] = sql("SELECT user_id, song_id, listened_at::DATE AS day, count(*) AS listen_count, sum(played_ms)::BIGINT AS played_ms FROM big_heard GROUP BY ALL", **_BIG)
QUERIES["big_streaks"] = lambda spark, sf_dir: rollups.streaks(rollups.daily(_big(spark, sf_dir)))
ORACLES["big_streaks"] = sql(
    """SELECT user_id, count(*) AS length, min(day) AS first_day, max(day) AS last_day FROM (SELECT user_id, day, day - row_number() OVER (PARTITION BY user_id ORDER BY day)::INTEGER AS island
      FROM (SELECT DISTINCT user_id, listened_at::DATE AS day FROM big_heard)) GROUP BY user_id, island""",
    **_BIG,
)


def _big_global(spark: SparkSession, sf_dir: str) -> DataFrame:
    lib = fixtures.library(spark, sf_dir)
    return rollups.global_stats(_big(spark, sf_dir), lib.song_albums, lib.song_artists)


QUERIES["big_global_stats"] = _big_global
ORACLES["big_global_stats"] = sql(
    """SELECT entity_type, entity_id, count(*) AS plays, count(DISTINCT user_id) AS unique_listeners, sum(played_ms)::BIGINT AS played_ms, min(listened_at) AS first_listened_at FROM (
      SELECT user_id, listened_at, played_ms, 'song' AS entity_type, song_id AS entity_id FROM big_heard
      UNION ALL SELECT user_id, listened_at, played_ms, 'album', album_id FROM big_heard JOIN song_albums USING (song_id)
      UNION ALL SELECT user_id, listened_at, played_ms, 'artist', artist_id FROM big_heard JOIN song_artists USING (song_id)) GROUP BY ALL""",
    **_BIG,
)
