"""Explicit schemas of the engine's tables; nothing is inferred from data."""

from pyspark.sql import types as T


TYPES = {
    "long": T.LongType(), "int": T.IntegerType(), "short": T.ShortType(), "string": T.StringType(), "boolean": T.BooleanType(), "float": T.FloatType(),
    "timestamp": T.TimestampType(), "date": T.DateType(), "array<string>": T.ArrayType(T.StringType()), "map<string,string>": T.MapType(T.StringType(), T.StringType()),
}


def _struct(text: str) -> T.StructType:
    return T.StructType([T.StructField(name, TYPES[kind]) for name, kind in (f.split(" ") for f in text.split(", "))])


LISTEN_INPUT = _struct(
    "user_id long, origin_url string, artist_names array<string>, song string, album string, listened_at timestamp, duration_ms int, "
    "duration_played_ms int, client string, client_version string, media_player string, submission_client string, source string"
)
USERS = _struct("id long, username string, display_name string, description string, image_id string, public boolean, is_admin boolean, created_at timestamp")
ARTISTS = _struct(
    "id long, name string, name_normalized string, name_romanized string, description string, image_id string, pinned boolean, created_at timestamp, updated_at timestamp"
)
ALBUMS = T.StructType([*ARTISTS.fields, T.StructField("release_date", T.DateType())])
SONGS = T.StructType([*(f for f in ARTISTS.fields if f.name != "description"), T.StructField("duration_ms", T.IntegerType())])
SONG_ARTISTS = _struct("song_id long, artist_id long, position short")
ALBUM_ARTISTS = _struct("album_id long, artist_id long, position short")
SONG_ALBUMS = _struct("song_id long, album_id long, track_number int")
SOURCES = _struct(
    "id long, entity_type string, entity_id long, source_type string, raw_url string, extracted_id string, correlation_method string, confidence float, created_at timestamp"
)
ALIASES = _struct("id long, entity_type string, entity_id long, alias string, created_at timestamp")
SUGGESTIONS = _struct("id long, entity_type string, lo_id long, hi_id long, score float, rejected boolean, created_at timestamp")
LISTENS = _struct("id long, user_id long, song_id long, listened_at timestamp, client string, duration_played_ms int, extra map<string,string>, created_at timestamp")
NOW_PLAYING = _struct("user_id long, song_id long, started_at timestamp, duration_ms int")
BLACKLIST = _struct("user_id long, artist_id long, created_at timestamp")
STATS_CACHE = _struct("user_id long, artist_id long, album_id long, song_id long, resource string, params string, data string, computed_at timestamp")
DAILY = _struct("user_id long, song_id long, day date, listen_count long, played_ms long")
CLOCK = _struct("user_id long, day date, hour short, listen_count long")
FIRST_LISTENS = _struct("user_id long, entity_type string, entity_id long, first_at timestamp")
GLOBAL_STATS = _struct("entity_type string, entity_id long, plays long, unique_listeners long, played_ms long, first_listened_at timestamp")
USER_STATE = _struct("user_id long, last_listened_at timestamp, current_streak long, longest_streak long")
