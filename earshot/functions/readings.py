"""Romanising words that only a dictionary can read: the cheapest way to cut a text into entries of a reading table."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import romanize as roman

#: A table of more entries, or of more characters in all, is refused: it is sent to every worker.
MOST_ENTRIES, MOST_CHARS = 2_000_000, 64_000_000
#: Cost of a run of kana or ASCII that no entry covers.
RUN_COST = 10.0


class Lattice:
    """Entries (surface, reading, cost). A text is cut where the costs add up to least, ties to fewer and then longer first pieces.

    Runs of kana, and of ASCII, pass as they are at a fixed cost; a text that nothing covers has no reading.
    """

    def __init__(self, entries: list[tuple[str, str, float]]):
        self.entries: dict[str, tuple[float, str]] = {}
        for surface, reading, cost in entries:
            if surface and reading is not None:
                self.entries[surface] = min(self.entries.get(surface, (float("inf"), "")), (float(cost), reading))
        self.longest = max(map(len, self.entries), default=0)

    @staticmethod
    def _run(text: str, at: int) -> int:
        """Where the run of kana, or of ASCII, that begins here ends."""
        of = roman.is_kana if roman.is_kana(text[at]) else (lambda c: ord(c) < 128)
        end = at
        while end < len(text) and of(text[end]):
            end += 1
        return end

    def __call__(self, text: str) -> list[str] | None:
        best: list[tuple[float, int, int, str] | None] = [None] * (len(text) + 1)  # cost, pieces, negative length of the first, reading
        best[len(text)] = (0.0, 0, 0, "")
        ends = [0] * len(text)
        for at in range(len(text) - 1, -1, -1):
            found = []
            for end in range(at + 1, min(len(text), at + self.longest) + 1):
                entry = self.entries.get(text[at:end])
                if entry is not None and best[end] is not None:
                    found.append((entry[0] + best[end][0], best[end][1] + 1, at - end, entry[1], end))
            end = self._run(text, at)
            if end > at and best[end] is not None:
                found.append((RUN_COST + best[end][0], best[end][1] + 1, at - end, text[at:end], end))
            if found:
                *top, ends[at] = min(found)
                best[at] = tuple(top)
        if best[0] is None:
            return None
        words, at = [], 0
        while at < len(text):
            words.append(best[at][3])
            at = ends[at]
        return [w for w in words if w.strip()]


def lattice(table: DataFrame) -> Lattice:
    """The lattice of a reading table (surface, reading, cost), which must be small enough to be sent to every worker."""
    size = table.agg(F.count("*"), F.sum(F.char_length("surface") + F.char_length("reading"))).first()
    if size[0] > MOST_ENTRIES or (size[1] or 0) > MOST_CHARS:
        raise ValueError(f"a reading table of {size[0]} entries and {size[1]} characters is too large to be broadcast")
    return Lattice([tuple(r) for r in table.select("surface", "reading", F.col("cost").cast("double")).collect()])


def romanizer(readings: DataFrame | None = None, pinyin: DataFrame | None = None, prefer_chinese: bool = False) -> Callable[[str | Column], Column]:
    """A column function as text.romanize_name that also reads what the tables have: kana of Japanese words, syllables of Chinese ones.

    With ``prefer_chinese`` texts of hanzi without kana are read by ``pinyin``. Whatever has a part without a reading is ''.
    """
    made = next((t for t in (readings, pinyin) if t is not None), None)
    if made is None:
        from .text import romanize_name

        return romanize_name
    context = made.sparkSession.sparkContext
    sent = {k: None if t is None else context.broadcast(lattice(t)) for k, t in (("readings", readings), ("pinyin", pinyin))}

    @F.pandas_udf("string")
    def spelt(names: pd.Series) -> pd.Series:
        tables = {k: None if v is None else v.value for k, v in sent.items()}
        return names.map({n: roman.romanize(n, tables["readings"], prefer_chinese, tables["pinyin"]) for n in names.unique()})

    return spelt
