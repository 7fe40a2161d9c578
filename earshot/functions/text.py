"""Text functions for matching names: built from Spark's own where it has the parts, Arrow batches where not."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import romanize as roman

#: A name that has one of these and one that lacks it are different recordings.
VERSION_WORDS = ("live", "remaster", "acoustic", "radio edit", "instrumental", "demo")
DURATION_SLACK_MS = 15_000


def normalized(name: str | None) -> str | None:
    """Lower-case letters and digits without marks; runs of blanks, punctuation and symbols are one blank."""
    if name is None:
        return None
    plain = "".join(c for c in unicodedata.normalize("NFD", name) if unicodedata.category(c) != "Mn")
    out, gap = [], False
    for c in unicodedata.normalize("NFC", plain).lower():
        kind = unicodedata.category(c)
        if kind[0] == "L" or kind == "Nd":
            out.append(" " + c if gap and out else c)
            gap = False
        elif kind[0] in "PS" or c.isspace():
            gap = True
    return "".join(out)


def jaro_winkler_of(a: str, b: str) -> float:
    """Jaro similarity with a bonus of a tenth for each of up to four equal first letters, always given."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    taken, mine = [False] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not taken[j] and b[j] == c:
                taken[j] = True
                mine.append(c)
                break
    if not mine:
        return 0.0
    theirs = [c for c, t in zip(b, taken) if t]
    m, swapped = len(mine), sum(x != y for x, y in zip(mine, theirs)) // 2
    jaro = (m / len(a) + m / len(b) + (m - swapped) / m) / 3
    prefix = next((i for i, (x, y) in enumerate(zip(a[:4], b[:4])) if x != y), min(4, len(a), len(b)))
    return jaro + 0.1 * prefix * (1 - jaro)


# Each distinct value of a batch is worked out once: names repeat.


@F.pandas_udf(T.StringType())
def normalize_name(names: pd.Series) -> pd.Series:
    return names.map({n: normalized(n) for n in names.unique()})


@F.pandas_udf(T.StringType())
def romanize_name(names: pd.Series) -> pd.Series:
    return names.map({n: roman.romanize(n) for n in names.unique()})


@F.pandas_udf(T.DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    pairs = [(x or "", y or "") for x, y in zip(a, b)]
    known = {p: jaro_winkler_of(*p) for p in set(pairs)}
    return pd.Series([known[p] for p in pairs], dtype="float64")


def edit_ratio(a: Column, b: Column) -> Column:
    longest = F.greatest(F.char_length(a), F.char_length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b).cast("double") / longest)


def tokens(name: Column) -> Column:
    return F.array_sort(F.array_distinct(F.filter(F.split(F.lower(name), r"\s+"), lambda w: w != "")))


def token_set_ratio(a: Column, b: Column) -> Column:
    """Best edit ratio of the shared words against the shared and own words of either side, and of these two."""
    left, right = tokens(a), tokens(b)
    shared = F.array_sort(F.array_intersect(left, right))
    common = F.array_join(shared, " ")
    one = F.trim(F.concat_ws(" ", common, F.array_join(F.array_sort(F.array_except(left, right)), " ")))
    two = F.trim(F.concat_ws(" ", common, F.array_join(F.array_sort(F.array_except(right, left)), " ")))
    return F.greatest(edit_ratio(common, one), edit_ratio(common, two), edit_ratio(one, two))


def best_similarity(a: Column, b: Column) -> Column:
    """The better of Jaro-Winkler and token set ratio; 0 if either name is empty."""
    blank = (F.coalesce(a, F.lit("")) == "") | (F.coalesce(b, F.lit("")) == "")
    return F.when(blank, F.lit(0.0)).otherwise(F.greatest(jaro_winkler(F.lower(a), F.lower(b)), token_set_ratio(a, b)))


def trigrams(name: Column) -> Column:
    """Distinct three-letter pieces of the alphanumeric words, each padded by two blanks before and one behind."""
    words = F.filter(F.split(F.lower(name), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    pieces = F.transform(words, lambda w: F.transform(F.sequence(F.lit(1), F.char_length(w) + 1), lambda i: F.substr(F.concat(F.lit("  "), w, F.lit(" ")), i, F.lit(3))))
    return F.array_distinct(F.flatten(pieces))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two arrays; 0 if either is empty or null."""
    a, b = F.coalesce(a, F.array().cast("array<string>")), F.coalesce(b, F.array().cast("array<string>"))
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)).cast("double") / F.size(F.array_union(a, b)))


def trigram_similarity(a: Column, b: Column) -> Column:
    return jaccard(trigrams(a), trigrams(b))


def version_mismatch(a: Column, b: Column) -> Column:
    out = F.lit(False)
    for w in VERSION_WORDS:
        out = out | (F.lower(a).contains(w) != F.lower(b).contains(w))
    return out


def duration_similarity(a: Column, b: Column) -> Column:
    """1 if a length is unknown, null (a veto) if they are more than fifteen seconds apart."""
    apart = F.abs(a.cast("long") - b.cast("long"))
    return F.when(a.isNull() | b.isNull() | (a <= 0) | (b <= 0), F.lit(1.0)).when(apart <= DURATION_SLACK_MS, 1 - apart.cast("double") / DURATION_SLACK_MS)


def seconds_of(clock: Column) -> Column:
    """Seconds of m:ss or h:mm:ss; 0 for anything else."""
    parts = F.split(clock, ":")
    value = F.aggregate(parts, F.lit(0).cast("long"), lambda t, p: t * 60 + p.try_cast("long"))
    return F.when(F.size(parts).between(2, 3), F.coalesce(value, F.lit(0).cast("long"))).otherwise(F.lit(0).cast("long"))


def format_duration(seconds: Column) -> Column:
    h, m, s = (F.floor(seconds / 3600), F.floor(seconds % 3600 / 60), seconds % 60)
    return F.when(seconds < 60, F.format_string("%ds", seconds)).when(seconds < 3600, F.format_string("%dm %ds", m, s)).otherwise(F.format_string("%dh %dm", h, m))


def username(raw: Column) -> Column:
    """The trimmed, lower-case name, null unless it has 2 to 32 of a-z, 0-9, _ and ., periods single and inside."""
    name = F.lower(F.trim(raw))
    return F.when(name.rlike("^[a-z0-9_.]{2,32}$") & ~name.startswith(".") & ~name.endswith(".") & ~name.contains(".."), name)


def json_at(document: Column, *steps: str | int) -> Column:
    """The text at a path of keys and indices of a JSON document, null if a step misses."""
    path = "".join(f"[{s}]" if isinstance(s, int) else f"['{s}']" for s in steps)
    return F.get_json_object(document, "$" + path)


def widest_image(images: Column) -> Column:
    """The link of the widest of (url, width) that has one; the first of equals."""
    with_link = F.filter(images, lambda i: F.coalesce(i["url"], F.lit("")) != "")
    best = F.aggregate(with_link, F.struct(F.lit(None).cast("string").alias("url"), F.lit(-1).alias("width")), lambda b, i: F.when(i["width"] > b["width"], F.struct(i["url"].alias("url"), i["width"].cast("int").alias("width"))).otherwise(b))
    return best["url"]


def register(spark: SparkSession) -> None:
    """The scalar functions under SQL names."""
    for name, f in (("normalize_name", normalize_name), ("romanize", romanize_name), ("jaro_winkler", jaro_winkler)):
        spark.udf.register(name, f)
