"""English stems by Porter's published algorithm (1980), as rules over the measure of a stem."""

from __future__ import annotations

import functools
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# The suffix rules of the steps, longest first where one ends another.
_STEP_2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous", "ization": "ize",
    "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
_STEP_3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
_STEP_4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ion", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _shape(word: str) -> str:
    """Consonants as ``c``, vowels as ``v``; y is a vowel after a consonant."""
    out = ""
    for ch in word:
        out += "v" if ch in "aeiou" or (ch == "y" and out[-1:] == "c") else "c"
    return out


def _measure(stem: str) -> int:
    """How often vowels are followed by consonants."""
    return len(re.findall("v+c+", _shape(stem)))


def _has_vowel(stem: str) -> bool:
    return "v" in _shape(stem)


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _shape(word)[-1] == "c"


def _short(word: str) -> bool:
    """Ends consonant, vowel, consonant other than w, x, y."""
    return _shape(word)[-3:] == "cvc" and word[-1] not in "wxy"


def _longest(word: str, suffixes) -> str | None:
    return max((s for s in suffixes if word.endswith(s)), key=len, default=None)


def _plural(w: str) -> str:
    suffix = _longest(w, ("sses", "ies", "ss", "s"))
    return w[:-2] if suffix in ("sses", "ies") else w[:-1] if suffix == "s" else w


def _past(w: str) -> str:
    if w.endswith("eed"):
        return w[:-1] if _measure(w[:-3]) else w
    suffix = _longest(w, ("ed", "ing"))
    if not suffix or not _has_vowel(w[: -len(suffix)]):
        return w
    w = w[: -len(suffix)]
    if w.endswith(("at", "bl", "iz")) or (_measure(w) == 1 and _short(w)):
        return w + "e"
    return w[:-1] if _double(w) and w[-1] not in "lsz" else w


def _replaced(w: str, rules: dict[str, str]) -> str:
    suffix = _longest(w, rules)
    return w[: -len(suffix)] + rules[suffix] if suffix and _measure(w[: -len(suffix)]) else w


def _dropped(w: str) -> str:
    suffix = _longest(w, _STEP_4)
    if not suffix or _measure(w[: -len(suffix)]) < 2 or (suffix == "ion" and w[-4:-3] not in ("s", "t")):
        return w
    return w[: -len(suffix)]


def _tidied(w: str) -> str:
    if w.endswith("e"):
        m = _measure(w[:-1])
        w = w[:-1] if m > 1 or (m == 1 and not _short(w[:-1])) else w
    return w[:-1] if w.endswith("ll") and _measure(w) > 1 else w


@functools.lru_cache(maxsize=200_000)
def porter(word: str) -> str:
    """Stem of a lower-case word; words of one or two letters, and words with other characters than a-z, stay."""
    if len(word) < 3 or not re.fullmatch("[a-z]+", word):
        return word
    w = _past(_plural(word))
    if w.endswith("y") and _has_vowel(w[:-1]):
        w = w[:-1] + "i"
    return _tidied(_dropped(_replaced(_replaced(w, _STEP_2), _STEP_3)))


def stem(word: Column) -> Column:
    """``porter`` for a column of words."""
    return F.pandas_udf(lambda words: words.map(lambda w: w if w is None else porter(w)), "string")(word)


def _stems(words: pd.Series) -> pd.Series:
    return words.map(lambda ws: ws if ws is None else [porter(w) for w in ws])


def stems(words: Column) -> Column:
    """``porter`` for a column of word arrays."""
    return F.pandas_udf(_stems, "array<string>")(words)
