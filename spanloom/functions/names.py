"""Drug-name keys: one normaliser for building and for querying."""

from __future__ import annotations

import re
import unicodedata
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Vocabulary of names.
SALT_WORDS = frozenset(
    "succinate tartrate hydrochloride hcl sodium maleate besylate dihydrochloride hydrobromide disodium potassium calcium magnesium sulfate bisulfate phosphate acetate mesylate "
    "bitartrate citrate fumarate chloride bromide nitrate tosylate pamoate lactate gluconate salicylate stearate valerate decanoate propionate carbonate oxalate malate aspartate "
    "saccharate benzoate napsylate edisylate xinafoate olamine strontium zinc tromethamine".split()
)
RELEASE_FORMS = frozenset(("er", "xr", "sr", "xl", "cr", "la"))
ARTICLES = frozenset(("the", "your", "my", "a", "an", "some"))
FORM_WORDS = frozenset(("tablet", "tablets", "pill", "pills", "capsule", "capsules", "cap", "caps", "tab", "tabs"))
DOSE_UNITS = frozenset("mg milligram milligrams mcg microgram micrograms ml milliliter milliliters g gram grams unit units iu meq".split())
DOSE = r"(?i)\d+\s*(MG|ML|MCG|UNT|%|/)"

_GLUED = re.compile(r"^(\d+(?:\.\d+)?)([a-z]+)$")


class NameKey(NamedTuple):
    key: str
    salt_key: str
    base_key: str
    release_modifier: str | None


def _words(raw: str) -> list[str]:
    """Lower-case words without accents; a hyphen counts as part of a word only inside it."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", raw) if not unicodedata.combining(c)).lower()
    chars = list(plain)
    wordlike = lambda c: c.isalnum() or c == "_"
    for i, c in enumerate(chars):
        inner = c == "-" and 0 < i < len(chars) - 1 and wordlike(chars[i - 1]) and wordlike(plain[i + 1])
        if not (wordlike(c) or inner):
            chars[i] = " "
    words = "".join(chars).split()
    skip = 0
    while skip < len(words) and words[skip] in ARTICLES:
        skip += 1
    return words[skip:]


def _dose_words(words: list[str]) -> int:
    """How many words at the end are a dose ("50 mg", "2 5 mg" from 2.5 counts one number)."""
    if len(words) >= 1 and (m := _GLUED.match(words[-1])) and m[2] in DOSE_UNITS:
        return 1
    if len(words) >= 2 and words[-1] in DOSE_UNITS and words[-2].isdigit():
        return 2
    return 0


def name_key(raw: str | None) -> NameKey:
    """Key of a name with its salt-free and release-free variants.

    A trailing dose form and dose are dropped, as often as both follow each
    other (three times at most), but never the whole name; nor do salt or
    release words empty it.  Keys are stable: the key of a key is itself.
    """
    words = _words(raw or "")
    for _ in range(3):
        rest = words[:-1] if words and words[-1] in FORM_WORDS else words
        n = _dose_words(rest)
        rest = rest[: len(rest) - n] if n else rest
        if not rest or len(rest) == len(words):
            break
        words = rest
    saltless = [w for w in words if w not in SALT_WORDS] or words
    base, modifier = list(words), None
    if len(base) > 1 and base[-1] in RELEASE_FORMS:
        modifier = base.pop()
    elif base:
        head, dash, tail = base[-1].rpartition("-")
        if dash and head and tail in RELEASE_FORMS:
            base[-1], modifier = head, tail
    return NameKey(" ".join(words), " ".join(saltless), " ".join(base), modifier)


def names_a_form(raw: str | None) -> bool:
    """Whether a mention ends in a dose form that follows something else ("water pill")."""
    words = _words(raw or "")
    words = words[: len(words) - n] if (n := _dose_words(words)) else words
    return len(words) > 1 and words[-1] in FORM_WORDS


def _name_keys(raw: pd.Series) -> pd.DataFrame:
    known = {v: name_key(v) for v in raw.unique()}
    return pd.DataFrame([known[v] for v in raw], columns=list(NameKey._fields))


def _names_form(raw: pd.Series) -> pd.Series:
    return raw.map(names_a_form)


def normalized(name: Column) -> Column:
    """Struct of the four keys; a null name has empty keys."""
    return F.pandas_udf(_name_keys, "key string, salt_key string, base_key string, release_modifier string")(name)


def ends_in_form(name: Column) -> Column:
    return F.pandas_udf(_names_form, "boolean")(name)


def has_dose(name: Column) -> Column:
    """A dose in the text makes it a product string."""
    return name.rlike(DOSE)


#: Words that can fill a phrase without naming anything.
EMPTY_WORDS = frozenset(
    "still on it that this one the a an my your his her our their same as before now then also too again just only more less other another take taking took takes keep keeping stay staying".split()
)


def names_nothing(text: Column) -> Column:
    """F-05: every word of two letters or more is a number, a unit or an empty word (or there is none); null names nothing."""
    from spanloom.functions.dosing import NUMBERS, SCALES, UNITS

    ignorable = sorted(EMPTY_WORDS | NUMBERS.keys() | SCALES.keys() | UNITS.keys())
    return F.forall(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("([a-z]{2,})"), 1), lambda w: w.isin(ignorable))


def ingredient_head(name: Column) -> Column:
    """A product string up to its first number: bracketed brand and leading rate dropped."""
    unbranded = F.regexp_replace(name, r"\s*\[[^\]]*\]\s*$", "")
    return F.trim(F.regexp_replace(F.regexp_replace(unbranded, r"^\d+(\.\d+)?\s+HR\s+", ""), r"\s\d.*$", ""))


def bracket_brand(name: Column) -> Column:
    """The brand in closing brackets, or null."""
    return F.nullif(F.regexp_extract(name, r"\[([^\]]+)\]\s*$", 1), F.lit(""))
