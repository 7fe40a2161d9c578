import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from earshot.functions import links, romanize, text


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first().x


@pytest.mark.parametrize("raw,want", [("Beyoncé  -- Déjà Vu!", "beyonce deja vu"), ("AC/DC", "ac dc"), ("が", "か"), ("½ x", "x"), ("  Ünïcode  ", "unicode"), ("", ""), ("...", "")])
def test_normalized(raw, want):
    assert text.normalized(raw) == want


@given(st.text(max_size=40))
@settings(max_examples=200, deadline=None)
def test_normalized_is_stable(s):
    once = text.normalized(s)
    assert once == once.strip() and "  " not in once and text.normalized(once) == once


@pytest.mark.parametrize("a,b,want", [("martha", "marhta", 0.9611111111), ("dwayne", "duane", 0.84), ("abc", "abd", 0.8222222222), ("a", "b", 0.0), ("same", "same", 1.0), ("", "x", 0.0)])
def test_jaro_winkler(a, b, want):
    assert text.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize(
    "a,b,want", [("red widget", "widget red", 1.0), ("red widget", "blue widget", 0.6363636364), ("song", "song live", 1.0), ("abc", "xyz", 0.0)]
)
def test_token_set_ratio(spark, a, b, want):
    assert one(spark, text.token_set_ratio(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("a,b,want", [("word", "two words", 0.3636363636), ("red widget", "red bolt", 0.25), ("", "x", 0.0), ("x", "x", 1.0)])
def test_trigram_similarity(spark, a, b, want):
    assert one(spark, text.trigram_similarity(F.lit(a), F.lit(b))) == pytest.approx(want, abs=1e-9)


@pytest.mark.parametrize("a,b,want", [(1000, 1000, 1.0), (7500, 15000, 0.5), (15000, 30000, 0.0), (1000, 16001, None), (None, 5, 1.0), (0, 50_000, 1.0)])
def test_duration_similarity(spark, a, b, want):
    assert one(spark, text.duration_similarity(F.lit(a).cast("int"), F.lit(b).cast("int"))) == want


@pytest.mark.parametrize("clock,want", [("3:45", 225), ("1:02:03", 3723), ("0:09", 9), ("", 0), ("x:1", 0), ("5", 0)])
def test_seconds_of(spark, clock, want):
    assert one(spark, text.seconds_of(F.lit(clock))) == want


def test_format_duration(spark):
    assert [one(spark, text.format_duration(F.lit(s).cast("long"))) for s in (45, 310, 3900)] == ["45s", "5m 10s", "1h 5m"]


@pytest.mark.parametrize("a,b,want", [("song", "song (live)", True), ("Song LIVE", "song live", False), ("x remaster", "x", True), ("x", "y", False)])
def test_version_mismatch(spark, a, b, want):
    assert one(spark, text.version_mismatch(F.lit(a), F.lit(b))) == want


@pytest.mark.parametrize("raw,want", [("ヨルシカ", "yorushika"), ("きゃ", "kya"), ("ラーメン", "raamen"), ("がっこう", "gakkou"), ("しゃ", "sha"), ("ファン", "fan"), ("つぁ", "tsa"), ("ツォ", "tso"), ("っあ", "aa"), ("ンー", ""), ("っ", ""), ("っー", ""), ("きャ", ""), ("ぁ", ""), ("ア・イ", ""), ("ア!", "a!")])
def test_kana(raw, want):
    assert romanize.romanize(raw) == want


@pytest.mark.parametrize("raw,want", [("한글", "hangeul"), ("국각", "guggag"), ("값", "gabs"), ("앉", "anj"), ("가", "ga"), ("abc", ""), ("漢字", ""), ("한é", "")])
def test_romanize(raw, want):
    assert romanize.romanize(raw) == want


def test_readings_can_be_brought():
    assert romanize.romanize("東京", readings=lambda t: ["とう", "きょう"]) == "tou kyou"
    assert romanize.romanize("北京", prefer_chinese=True, pinyin=lambda t: ["bei", "jing"]) == "bei jing"


ID = "4uLU6hMCjMI75M1A2tKUQC"
MBID = "8f3471b5-7e6a-48da-86a9-c1c07a0f47ae"


@pytest.mark.parametrize(
    "url,service,want",
    [
        (f"https://open.spotify.com/track/{ID}", "spotify", ID), (f"https://www.open.spotify.com/track/{ID}?si=abc123", "spotify", ID), (f"https://open.spotify.com/intl-de/track/{ID}", "spotify", ID),
        (f"https://open.spotify.com/album/{ID}", "spotify", None), ("https://example.com/track/1", "spotify", None), ("https://open.spotify.com/track/not-an-id", "spotify", None),
        ("https://www.deezer.com/track/14408104", "deezer", "14408104"), ("https://deezer.com/en/track/14408104", "deezer", "14408104"), ("https://www.deezer.com/album/901415162", "deezer", None),
        ("https://www.deezer.com/track/abc", "deezer", None), (f"https://musicbrainz.org/recording/{MBID}", "musicbrainz", MBID), (f"https://musicbrainz.org/release/{MBID}", "musicbrainz", None),
        ("https://musicbrainz.org/recording/8f34", "musicbrainz", None), ("https://music.youtube.com/watch?v=dQw4w9WgXcQ&list=x", "ytmusic", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ", "ytmusic", "dQw4w9WgXcQ"),
    ],
)
def test_track_ids(spark, url, service, want):
    assert one(spark, links.track_id(F.lit(url), service)) == want
    assert one(spark, links.service_of(F.lit(url))) == (service if want else None)


@pytest.mark.parametrize("uri,want", [("spotify:artist:0gxyHStUsqpMadRV0Di1Qt", "0gxyHStUsqpMadRV0Di1Qt"), ("not-a-uri", ""), ("", ""), ("a:b:c:d", "")])
def test_uris(spark, uri, want):
    assert one(spark, links.last_of_uri(F.lit(uri))) == want


def test_registered_in_sql(spark):
    text.register(spark)
    assert spark.sql("select normalize_name('AC/DC') a, romanize('한글') b, jaro_winkler('abc', 'abc') c").first() == ("ac dc", "hangeul", 1.0)


def test_readings_by_least_cost(spark):
    from earshot.functions import readings

    table = spark.createDataFrame([("東", "ひがし", 5.0), ("京", "きょう", 5.0), ("東京", "とうきょう", 6.0), ("都", "と", 4.0), ("京都", "きょうと", 3.0), ("東", "あずま", 9.0)], "surface string, reading string, cost double")
    at = readings.lattice(table)
    assert at("東京") == ["とうきょう"] and at("東京都") == ["ひがし", "きょうと"] and at("東x京") == ["ひがし", "x", "きょう"]
    assert at("北") is None and at("東北") is None and at("") == [] and at("東のカラー") == ["ひがし", "のカラー"] and at("京  都") == ["きょう", "と"]
    long = "東京" * 3000
    assert at(long) == ["とうきょう"] * 3000
    pinyin = spark.createDataFrame([("北", "bei", 1.0), ("京", "jing", 1.0)], "surface string, reading string, cost double")
    names = spark.createDataFrame([("東京タワー",), ("北京",), ("한글",), ("abc",), (None,), ("北京の",)], "name string")
    spell = lambda **kw: [r[0] for r in names.select(readings.romanizer(**kw)("name")).collect()]
    assert spell(readings=table) == ["toukyou tawaa", "", "hangeul", "", "", ""]
    assert spell(readings=table, pinyin=pinyin, prefer_chinese=True) == ["toukyou tawaa", "bei jing", "hangeul", "", "", ""]


def test_reading_tables_are_bounded(spark, monkeypatch):
    from earshot.functions import readings

    monkeypatch.setattr(readings, "MOST_ENTRIES", 1)
    with pytest.raises(ValueError, match="too large"):
        readings.lattice(spark.createDataFrame([("a", "b", 1.0), ("c", "d", 1.0)], "surface string, reading string, cost double"))
