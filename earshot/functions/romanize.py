"""Latin spellings of Hangul and kana; kanji and hanzi only through a reading table that the caller brings."""

from __future__ import annotations

from collections.abc import Callable

# Latin letters of the jamo in syllable order; finals are spelt by letter, not by sound.
INITIALS = ["g", "kk", "n", "d", "tt", "r", "m", "b", "pp", "s", "ss", "", "j", "jj", "ch", "k", "t", "p", "h"]
VOWELS = ["a", "ae", "ya", "yae", "eo", "e", "yeo", "ye", "o", "wa", "wae", "oe", "yo", "u", "wo", "we", "wi", "yu", "eu", "ui", "i"]
FINALS = ["", "g", "kk", "gs", "n", "nj", "nh", "d", "l", "lg", "lm", "lb", "ls", "lt", "lp", "lh", "m", "b", "bs", "s", "ss", "ng", "j", "ch", "k", "t", "p", "h"]

# Hepburn readings of hiragana; small kana are read only behind the kana that they change.
HIRAGANA = {
    "あ": "a", "い": "i", "う": "u", "え": "e", "お": "o", "か": "ka", "き": "ki", "く": "ku", "け": "ke", "こ": "ko",
    "が": "ga", "ぎ": "gi", "ぐ": "gu", "げ": "ge", "ご": "go", "さ": "sa", "し": "shi", "す": "su", "せ": "se", "そ": "so",
    "ざ": "za", "じ": "ji", "ず": "zu", "ぜ": "ze", "ぞ": "zo", "た": "ta", "ち": "chi", "つ": "tsu", "て": "te", "と": "to",
    "だ": "da", "ぢ": "ji", "づ": "zu", "で": "de", "ど": "do", "な": "na", "に": "ni", "ぬ": "nu", "ね": "ne", "の": "no",
    "は": "ha", "ひ": "hi", "ふ": "fu", "へ": "he", "ほ": "ho", "ば": "ba", "び": "bi", "ぶ": "bu", "べ": "be", "ぼ": "bo",
    "ぱ": "pa", "ぴ": "pi", "ぷ": "pu", "ぺ": "pe", "ぽ": "po", "ま": "ma", "み": "mi", "む": "mu", "め": "me", "も": "mo",
    "や": "ya", "ゆ": "yu", "よ": "yo", "ら": "ra", "り": "ri", "る": "ru", "れ": "re", "ろ": "ro",
    "わ": "wa", "ゐ": "i", "ゑ": "e", "を": "o", "ん": "n", "ゔ": "vu",
    "きゃ": "kya", "きゅ": "kyu", "きょ": "kyo", "ぎゃ": "gya", "ぎゅ": "gyu", "ぎょ": "gyo", "しゃ": "sha", "しゅ": "shu", "しょ": "sho",
    "じゃ": "ja", "じゅ": "ju", "じょ": "jo", "ちゃ": "cha", "ちゅ": "chu", "ちょ": "cho", "ぢゃ": "ja", "ぢゅ": "ju", "ぢょ": "jo",
    "にゃ": "nya", "にゅ": "nyu", "にょ": "nyo", "ひゃ": "hya", "ひゅ": "hyu", "ひょ": "hyo", "びゃ": "bya", "びゅ": "byu", "びょ": "byo",
    "ぴゃ": "pya", "ぴゅ": "pyu", "ぴょ": "pyo", "みゃ": "mya", "みゅ": "myu", "みょ": "myo", "りゃ": "rya", "りゅ": "ryu", "りょ": "ryo",
    "ふぁ": "fa", "ふぃ": "fi", "ふぇ": "fe", "ふぉ": "fo", "ゔぁ": "va", "ゔぃ": "vi", "ゔぇ": "ve", "ゔぉ": "vo",
    "てぃ": "ti", "でぃ": "di", "とぅ": "tu", "どぅ": "du", "うぃ": "wi", "うぇ": "we", "うぉ": "wo",
    "しぇ": "she", "じぇ": "je", "ちぇ": "che", "つぁ": "tsa", "つぃ": "tsi", "つぇ": "tse", "つぉ": "tso",
}
#: Katakana lie at a fixed distance behind hiragana. A pair is of one script.
KANA = HIRAGANA | {"".join(chr(ord(c) + 0x60) for c in k): v for k, v in HIRAGANA.items()}


def is_hangul(c: str) -> bool:
    return 0xAC00 <= ord(c) <= 0xD7A3


def is_kana(c: str) -> bool:
    return 0x3040 <= ord(c) <= 0x30FF


def is_han(c: str) -> bool:
    return 0x4E00 <= ord(c) <= 0x9FFF


def hangul(text: str) -> str | None:
    """Syllables taken apart by their code points; ASCII passes, anything else fails."""
    out = []
    for c in text:
        if is_hangul(c):
            n = ord(c) - 0xAC00
            out.append(INITIALS[n // 588] + VOWELS[n % 588 // 28] + FINALS[n % 28])
        elif ord(c) < 128:
            out.append(c)
        else:
            return None
    return "".join(out)


def _mora(text: str, at: int) -> tuple[str, int] | None:
    """The reading of the longest entry at a place and its length."""
    return next(((KANA[text[at : at + n]], n) for n in (2, 1) if text[at : at + n] in KANA), None)


def kana(text: str) -> str | None:
    """Kana by the longest entry first; ASCII passes. Small tsu doubles the first letter of what follows, and the
    long mark the vowel before it; where there is none, or at any other letter, the whole text fails."""
    out, i = "", 0
    while i < len(text):
        c = text[i]
        if ord(c) < 128:
            out, i = out + c, i + 1
        elif c in "っッ":
            said = _mora(text, i + 1)
            if said is None:
                return None
            out, i = out + said[0][0], i + 1
        elif c == "ー":
            if out[-1:] not in ("a", "i", "u", "e", "o"):
                return None
            out, i = out + out[-1], i + 1
        else:
            said = _mora(text, i)
            if said is None:
                return None
            out, i = out + said[0], i + said[1]
    return out


def romanize(text: str | None, readings: Callable[[str], list[str] | None] | None = None, prefer_chinese: bool = False, pinyin: Callable[[str], list[str] | None] | None = None) -> str:
    """A spelling of the whole text, or '' if any part of it has none. ``readings`` gives kana words, ``pinyin`` syllables."""
    text = text or ""
    if any(map(is_hangul, text)):
        return hangul(text) or ""
    if any(map(is_han, text)):
        if prefer_chinese and not any(map(is_kana, text)):
            words = pinyin(text) if pinyin else None
            return " ".join(words) if words else ""
        words = readings(text) if readings else None
        return kana(" ".join(words)) or "" if words else ""
    return (kana(text) or "") if any(map(is_kana, text)) else ""
