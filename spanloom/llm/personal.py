"""Personal information in free text: located, typed, and replaced.

Regular expressions over a cleaned token stream propose spans; checksums (Luhn,
mod-97) raise or lower the score of those that have one, and nearby context
words adjust it.  Titles and phrases propose names; the words that they show to
be names all over the collection form a table, and a join with it finds bare
mentions too.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Callable, Collection, Iterator
from functools import cached_property
from itertools import accumulate, compress, count
from operator import eq
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.llm.transcript import HESITATION, without_notes
from spanloom.operators.skew import salted_join
from spanloom.session import checkpointed

ACCEPT = 0.5
#: A listed name needs this many proposals, in a collection of any size, and this share of the word's uses.
NAME_SUPPORT, NAME_PURITY = 2, 0.1
#: Bits of the filter that spares most tokens the join with the name table: one megabyte however many names there are.
FILTER_BITS = 23
_CONTEXT = 7
_CACHE = 200_000

# Words that make up or surround personal data.
_DIGIT_WORDS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}
_NUMBER_WORD = (
    r"(?:(?:twenty|thirty|forty|fifty|sixty|seventy|eighty|ninety)(?:[ -](?:one|two|three|four|five|six|seven|eight|nine))?"
    r"|ten|eleven|twelve|thirteen|fourteen|fifteen|sixteen|seventeen|eighteen|nineteen|one|two|three|four|five|six|seven|eight|nine)"
)
_ID_CUES = {"record", "insurance", "member", "membership", "card", "social", "security", "chart", "policy", "passport", "licence", "license", "ssn", "identity", "id", "iban", "account"}
_PHONE_CUES = {"phone", "call", "reach", "text", "contact", "mobile", "cell", "telephone", "tel", "dial", "ring", "fax"}
_NOT_PERSONAL = {"batch", "lot", "room", "form", "bus", "steps", "mg", "milligrams", "dose", "extension", "pounds", "version"}
_ADDRESS_CUES = {"live", "living", "lives", "address", "moved", "parcel", "comes", "send", "at"}
_TITLES = {"mr", "mrs", "ms", "miss", "dr", "doctor", "nurse", "prof", "professor"}
_KIN = ("daughter", "son", "husband", "wife", "mother", "father", "sister", "brother", "partner", "aunt", "uncle", "neighbour", "friend")
#: How people are introduced: the words before a name, and what the name scores.  Below ``ACCEPT`` a phrase is
#: no proof by itself; it counts when the name list is learned.
_PHRASES = {
    "my name is": 0.6, "name is": 0.5, "name's": 0.6, "on behalf of": 0.6, "ask for": 0.6, "is called": 0.6, "named": 0.6, "this is": 0.4, "i am": 0.4, "i'm": 0.4, "meet": 0.4, "put": 0.4, "form": 0.4,
    **{f"{whose} {kin}": 0.6 for whose in ("my", "her", "his", "our") for kin in _KIN},
}
_SPEAKING = {"speaking", "calling", "here"}
_STREETS = {"street", "avenue", "lane", "road", "row", "court", "terrace", "drive", "close", "square", "boulevard", "crescent", "place", "way", "gardens", "alley"}
_SHORT_STREETS = {"st", "str", "av", "ave", "ln", "la", "rd", "ro", "ct", "co", "te", "ter", "dr", "cl", "sq", "blvd", "cres", "pl"}
_STREET, _SHORT_STREET = (rf"(?:{'|'.join(sorted(w))})" for w in (_STREETS, _SHORT_STREETS))
_STREET_NAME = r"[^\W\d_][\w'’-]+"
_PLAIN = set(
    "the a an and or of to in on at is was be for it i you he she we they my your his her our their this that with not no yes so but if as by up do did "
    "have has had me us them mg ml front right every once twice until day days week weeks time times steps weight pills pounds milligrams".split()
)
_TWO_LETTERS = set("am an as at be by do er go he hi if in is it me my no of oh ok on or so to uh um up us we mg ml".split())

_AT = r"(?:@| ?[\[(] ?at ?[\])] ?| at )"
_DOT = r"(?:\.| dot | ?[\[(] ?dot ?[\])] ?)"
_EMAIL = re.compile(rf"(?<![\w.+@-])[a-z0-9][\w+'’-]*(?:{_DOT}[\w+'’-]+)*{_AT}[a-z0-9][a-z0-9-]*(?:{_DOT}[a-z0-9-]+)*{_DOT}[a-z]{{2,}}(?![\w@])", re.I)
_AT_INSIDE = re.compile(r"@|[\[(]at[\])]", re.I)
_UNIT = r"(?:flat|apartment|apt\.?|unit|suite|no\.?|number)"
_ADDRESS = re.compile(
    rf"(?<![\w-])(?:{_UNIT} \d+[a-z]?,? )?(?:\d+[a-z]?(?: ?[-–] ?\d+[a-z]?)?|{_NUMBER_WORD}),? (?:(?:north|south|east|west|old|new)\.? )?(?P<name>{_STREET_NAME}(?: {_STREET_NAME})?) (?:{_STREET}\b|{_SHORT_STREET}\.)"
    rf"(?:,? {_UNIT} \d+[a-z]?)?"
    r"|(?<![\w-])(?P<german>[^\W\d_]{3,}(?:weg|stra(?:ß|ss)e|gasse|allee|platz|ring|damm|ufer)),? \d+ ?[a-z]?(?![\w:-])",
    re.I,
)
_GERMAN = re.compile(r"^[^\W\d_]{3,}(?:weg|stra(?:ß|ss)e|gasse|allee|platz|ring|damm|ufer)$")
_HOUSE = re.compile(rf"^(?:\d+[a-z]?(?:[-–]\d*[a-z]?)?|{_NUMBER_WORD})$", re.I)
_CODE = re.compile(r"^(?:[a-z]{1,3}-?\d{6,10}|[a-z]{1,3}(?:-\d{3,6}){1,4}-?[a-z]?|\d{3}-\d{2}-\d{4}|[a-z]{2}\d{2}(?:[a-z0-9]{11,30}))$", re.I)
_IBAN = re.compile(r"[a-z]{2}\d{2}[a-z0-9]{11,30}")
_NUMERIC = re.compile(r"^[+(]*\d[\d().\-–]*$")
_STOPPED = re.compile(r"[.?!]['\"”’)]*$")
_CLOSES_NAME = re.compile(r"[,;:?!]$|[^.]\.$")
_CLOSES_WORD = re.compile(r"[,.;:?!]$")
_WORDISH = re.compile(r"^[^\W\d_]+(?:['’-][^\W\d_]+)*$")
_OWNED = re.compile(r"['’]s$")
_T_AT, _T_NUMBER, _T_STREET, _T_TITLE, _T_PHRASE, _T_STOP, _T_CAPITAL, _T_SKIP, _T_NO_STUTTER, _T_CODE, _T_HOUSE = (1 << k for k in range(11))
_LAST_WORDS: dict[str, list[tuple[list[str], float]]] = {}
for _phrase, _score in _PHRASES.items():
    _LAST_WORDS.setdefault(_phrase.split()[-1], []).append((_phrase.split()[:-1], _score))


class Mention(NamedTuple):
    start: int
    end: int
    kind: str
    score: float


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def mod97(code: str) -> bool:
    """ISO 7064 check of an account number (IBAN)."""
    moved = code[4:] + code[:4]
    return int("".join(str(int(c, 36)) for c in moved)) % 97 == 1


class _Token(NamedTuple):
    low: str
    flags: int
    lead: int
    size: int
    name: str  # the word as the name list holds it


class _Tokens(dict):
    """What is known of a blank-separated piece, worked out once per spelling."""

    def __missing__(self, t: str) -> _Token:
        core = t.strip(".,;:?!—–…\"“”*")
        low = core.lower()
        flags = 0
        if not core or (HESITATION.match(low) and core != "ER"):
            flags |= _T_SKIP
        if low in _DIGIT_WORDS:
            flags |= _T_NUMBER | _T_NO_STUTTER
        inner = low.strip("()'\"")
        if _CODE.match(inner):
            flags |= _T_NUMBER | _T_CODE
        elif _NUMERIC.match(low):
            flags |= _T_NUMBER
        if _HOUSE.match(low):
            flags |= _T_HOUSE
        if low == "at" or _AT_INSIDE.search(low):
            flags |= _T_AT
        if low in _STREETS or low in _SHORT_STREETS and "." in t or _GERMAN.match(low):
            flags |= _T_STREET
        if low in _TITLES:
            flags |= _T_TITLE
        if low in _LAST_WORDS:
            flags |= _T_PHRASE
        if _STOPPED.search(t):
            flags |= _T_STOP
        if core[:1].isupper() or core[:1] == "(":
            flags |= _T_CAPITAL
        if len(self) >= _CACHE:
            self.clear()
        self[t] = made = _Token(low, flags, len(t) - len(t.lstrip(".,;:?!—–…\"“”*")) if core else 0, len(core), _OWNED.sub("", low.strip("()")))
        return made


_BLANK = np.array([chr(c).isspace() for c in range(0x3001)] + [False])
_PIECE = re.compile(r"\S+")
_LABEL_ENDS = ("-", "—", "–", ">", ":")


def _blanks(note: str) -> str:
    return " " * len(note)


def _places(text: str) -> list[int]:
    """Where each blank-separated piece of ``text`` begins."""
    if len(text) < 400:  # too little for vectors
        return [m.start() for m in _PIECE.finditer(text)]
    chars = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    blank = np.concatenate(([True], _BLANK[np.minimum(chars, 0x3001)]))
    return np.flatnonzero(blank[:-1] & ~blank[1:]).tolist()


class _Digits(dict):
    """The digits of a number-like token."""

    def __missing__(self, low: str) -> str:
        if len(self) >= _CACHE:
            self.clear()
        self[low] = digits = _DIGIT_WORDS.get(low) or re.sub(r"\D", "", low)
        return digits


_DIGITS = _Digits()


class Stream:
    """Tokens without notes, hesitations and stutters, with their places."""

    known = _Tokens()

    def __init__(self, text: str):
        self._blanked = blanked = without_notes(text, _blanks)
        raw = blanked.split()
        columns = zip(*map(self.known.__getitem__, raw)) if raw else ((),) * 5
        low, flags, lead, size, name = map(list, columns)
        at, last = range(len(raw)), {}
        if skipped := [k for k, f in enumerate(flags) if f & _T_SKIP]:
            before = -1
            for k in skipped:
                if k and not flags[k - 1] & _T_SKIP:
                    before = k - 1
                if before >= 0 and low[before] in _TITLES and raw[k] in _LABEL_ENDS:
                    raw[before] += ":"  # a speaker label, no title
            kept = [not f & _T_SKIP for f in flags]
            raw, low, flags, lead, size, name, at = (list(compress(c, kept)) for c in (raw, low, flags, lead, size, name, at))
        if again := [k for k in compress(count(1), map(eq, low[1:], low)) if not flags[k] & _T_NO_STUTTER]:
            kept, first = [True] * len(low), 0
            for k in again:
                kept[k] = False
                if kept[k - 1]:
                    first = k - 1
                raw[first] = raw[first].rstrip(".,—…") + raw[k][lead[k] + size[k] :]
                flags[first] = (flags[first] & ~_T_STOP) | flags[k] & _T_STOP
                last[at[first]] = (at[k], lead[k] + size[k])
            raw, low, flags, lead, size, name, at = (list(compress(c, kept)) for c in (raw, low, flags, lead, size, name, at))
        self.raw, self.low, self.flags, self.name = raw, low, flags, name
        self._size, self._lead, self._at, self._last = size, lead, at, last

    @cached_property
    def _starts(self) -> list[int]:
        return _places(self._blanked)

    def span(self, i: int, j: int) -> tuple[int, int]:
        """Characters of tokens i..j; most texts are never asked."""
        k = self._at[j - 1]
        k, length = self._last.get(k, (k, self._lead[j - 1] + self._size[j - 1]))
        return self._starts[self._at[i]] + self._lead[i], self._starts[k] + length

    def window(self, a: int, b: int) -> tuple[str, list[int]]:
        """Text of tokens a..b and where each begins in it."""
        parts = [t.rstrip("—…").removesuffix("...") for t in self.raw[a:b]]
        return " ".join(parts), [0, *accumulate(len(p) + 1 for p in parts)]

    def around(self, i: int, j: int) -> set[str]:
        """Context words of tokens i..j, within their sentence."""
        words = set()
        for k in range(i - 1, max(-1, i - 1 - _CONTEXT), -1):
            if self.flags[k] & _T_STOP and self.low[k] not in _TITLES:
                break
            words.add(self.low[k])
        for k in range(j, min(len(self.low), j + _CONTEXT)):
            if self.flags[k - 1] & _T_STOP:
                break
            words.add(self.low[k])
        return words


def _emails(s: Stream, at: list[int]) -> Iterator[tuple[int, int, str, float]]:
    dots, done = ("dot", "(dot)", "[dot]"), 0
    for k in at:
        if k < done:
            continue
        a, b = k, k + 1
        if s.low[k] in ("at", "(at)", "[at]"):
            a, b = k - 1, k + 2
            if a < 0 or b > len(s.low) or not ("." in s.low[b - 1] or "dot" in s.low[b - 1] or s.low[b : b + 1] and s.low[b] in dots):
                continue
        while a > 1 and s.low[a - 1] in dots:
            a -= 2
        while b + 1 < len(s.low) and s.low[b] in dots:
            b += 2
        text, places = s.window(max(a, 0), b)
        for m in _EMAIL.finditer(text):
            i, j = (max(a, 0) + bisect_right(places, p) - 1 for p in (m.start(), m.end() - 1))
            yield i, j + 1, "email", 0.9
            done = j + 1


def _addresses(s: Stream, streets: list[int]) -> Iterator[tuple[int, int, str, float]]:
    done = 0
    for k in streets:
        if k < done:
            continue
        a, b = max(0, k - 7), min(len(s.low), k + 4)
        if not any(f & _T_HOUSE for f in s.flags[max(0, k - 5) : k]) and not _GERMAN.match(s.low[k]):
            continue
        text, places = s.window(a, b)
        for m in _ADDRESS.finditer(text):
            i, j = (a + bisect_right(places, p) - 1 for p in (m.start(), m.end() - 1))
            if not i <= k <= j or m["german"] is None and any(w in _PLAIN for w in m["name"].lower().split()):
                continue
            yield i, j + 1, "address", 0.6 + 0.3 * bool(s.around(i, j + 1) & _ADDRESS_CUES)
            done = j + 1


def _numbers(s: Stream, numbers: list[int]) -> Iterator[tuple[int, int, str, float]]:
    n, done = len(s.low), 0
    for i in numbers:
        if i < done:
            continue
        if s.flags[i] & _T_CODE:
            core = s.low[i].strip("()'\"")
            digits = re.sub(r"\D", "", core)
            context = s.around(i, i + 1)
            score = 0.3 + 0.3 * (len(digits) >= 7) + 0.4 * bool(context & _ID_CUES) - 0.5 * bool(context & _NOT_PERSONAL and not context & _ID_CUES)
            if _IBAN.fullmatch(core):
                score += 0.5 if mod97(core) else -0.3
            yield i, i + 1, "id_number", score
            continue
        j, digits, parts = i, "", []
        while j < n and s.flags[j] & (_T_NUMBER | _T_CODE) == _T_NUMBER:
            digits += _DIGITS[s.low[j]]
            parts.append(s.low[j])
            j += 1
            if s.flags[j - 1] & _T_STOP:
                break
        done = max(i + 1, j)
        if len(digits) < 7:
            continue
        first = i
        if i and re.fullmatch(r"[a-z]{2}", s.low[i - 1]) and s.low[i - 1] not in _TWO_LETTERS and re.fullmatch(r"\d{4}", parts[0]):
            first = i - 1
        context, shape = s.around(first, j), " ".join(parts)
        card = 13 <= len(digits) <= 19
        is_id = 0.1 + 0.5 * bool(context & _ID_CUES) + 0.4 * (first < i) + 0.3 * (len(digits) in (8, 9)) + (0.3 if luhn(digits) else -0.2) * card
        is_phone = 0.3 * (len(digits) in (7, 10) or len(digits) == 11 and digits[0] == "1") + 0.3 * bool(context & _PHONE_CUES) + 0.2 * bool(re.match(r"[+(]|1-", shape))
        if is_id > is_phone:
            yield first, j, "id_number", 0.3 + is_id
        else:
            yield i, j, "phone", 0.3 + is_phone


def _name_at(s: Stream, i: int) -> int:
    """End of a capitalised name beginning at token ``i`` (``i`` if there is none)."""
    j = i
    while j < len(s.low) and j < i + 4:
        core = _OWNED.sub("", s.raw[j].strip(".,;:?!—–…\"“”*()"))
        initial = len(core) == 1 and core.isupper() and j > i
        if not (core and core[0].isupper() and _WORDISH.match(core) and (initial or len(core) > 2 and not core.isupper()) and core.lower() not in _PLAIN and core.lower() not in _TITLES):
            break
        j += 1
        if not initial and _CLOSES_WORD.search(s.raw[j - 1].rstrip("\"”')")):
            break
    return j


def _proposed_names(s: Stream, titles: list[int], phrases: list[int]) -> Iterator[tuple[int, int, float]]:
    """Names that titles and phrases point at, with their score."""
    n, low, flags = len(s.low), s.low, s.flags
    for i in titles:
        if i + 1 < n and flags[i + 1] & _T_CAPITAL and s.raw[i][-1] not in ":—–-" and s.raw[i + 1][0] not in "—–-:>":
            if (j := _name_at(s, i + 1)) > i + 1:
                yield i + 1, j, 0.8
    for k in phrases:
        if k + 1 >= n or not flags[k + 1] & _T_CAPITAL or flags[k] & _T_STOP:
            continue
        score = max((v for before, v in _LAST_WORDS[low[k]] if k >= len(before) and low[k - len(before) : k] == before), default=0.0)
        if score and (j := _name_at(s, k + 1)) > k + 1:
            yield k + 1, j, max(score, 0.6 * (j < n and low[j] in _SPEAKING))


def _flagged(s: Stream) -> list[list[int]]:
    """Token numbers by what they may begin: at signs, numbers, streets, titles, phrases."""
    mask = _T_AT | _T_NUMBER | _T_STREET | _T_TITLE | _T_PHRASE
    out: list[list[int]] = [[], [], [], [], []]
    for k in [k for k, f in enumerate(s.flags) if f & mask]:
        f = s.flags[k]
        for b in range(5):
            if f >> b & 1:
                out[b].append(k)
    return out


def propose(text: str, may_be_name: Callable[[str], bool]) -> tuple[Stream, list[tuple[int, int, str, float]], list[int]]:
    """(stream, accepted spans and proposed persons, tokens that the name list may hold)."""
    s = Stream(text)
    at, numbers, streets, titles, phrases = _flagged(s)
    taken: set[int] = set()
    spans = []
    for group in (_emails(s, at), _addresses(s, streets), _numbers(s, numbers)):
        for i, j, kind, score in group:
            if score >= ACCEPT and i < j and taken.isdisjoint(range(i, j)):
                taken.update(range(i, j))
                spans.append((i, j, kind, round(score, 3)))
    spans += [(i, j, "person", score) for i, j, score in _proposed_names(s, titles, phrases) if score >= ACCEPT and taken.isdisjoint(range(i, j))]
    return s, spans, [k for k in compress(count(), map(may_be_name, s.name)) if k not in taken]


def _joins_on(s: Stream, k: int) -> int:
    """How many tokens before ``k`` a listed name may end that goes on here: 1 or 2 (over an initial)."""
    return 2 if k > 1 and len(s.low[k - 1]) == 1 and s.low[k - 1].isalpha() and s.raw[k - 1].rstrip(".").isalpha() else 1


def _persons(proposed: list[tuple], listed: list[tuple]) -> list[tuple[int, int, float]]:
    """Proposed names and stretches of listed tokens (number, start, end, closed, over); no overlaps."""
    stretches, last = [], None
    for k, start, end, closed, over in sorted(listed):
        if last is not None and not last[1] and k - last[0] in (1, over):
            stretches[-1] = (stretches[-1][0], k + 1, stretches[-1][2], end, 0.7)
        else:
            stretches.append((k, k + 1, start, end, 0.7))
        last = (k, closed)
    out, until = [], -1
    for i, j, start, end, score in sorted([*proposed, *stretches], key=lambda x: (x[0], -x[1])):
        if i >= until:
            out.append((start, end, score))
            until = j
    return out


def find_mentions(text: str, names: Collection[str]) -> list[Mention]:
    """Accepted mentions of one text in order; an earlier kind wins an overlap."""
    s, spans, listed = propose(text, names.__contains__)
    found = [Mention(*s.span(i, j), kind, score) for i, j, kind, score in spans if kind != "person"]
    persons = _persons(
        [(i, j, *s.span(i, j), score) for i, j, kind, score in spans if kind == "person"],
        [(k, *s.span(k, k + 1), bool(_CLOSES_NAME.search(s.raw[k])), _joins_on(s, k)) for k in listed],
    )
    return sorted([*found, *(Mention(a, b, "person", score) for a, b, score in persons)])


def mask(text: str, mentions: list[Mention]) -> str:
    """``text`` with every mention replaced by its typed placeholder."""
    out, at = [], 0
    for m in mentions:
        out.append(text[at : m.start])
        out.append(f"[{m.kind.upper()}]")
        at = m.end
    return "".join([*out, text[at:]])


def _introductions(infos: list[_Token]) -> Iterator[tuple[int, int]]:
    """Stretches of pieces around titles and phrases that a capitalised piece follows; they don't overlap."""
    lo = hi = None
    for k in [k for k, x in enumerate(infos) if x.flags & (_T_TITLE | _T_PHRASE)]:
        if not any(x.flags & _T_CAPITAL for x in infos[k + 1 : k + 5]):
            continue
        if hi is not None and k - _CONTEXT > hi:
            yield lo, hi
            lo = None
        lo, hi = max(0, k - _CONTEXT) if lo is None else lo, min(len(infos), k + 2 * _CONTEXT)
    if lo is not None:
        yield lo, hi


def name_table(texts: DataFrame, column: str) -> DataFrame:
    """``(word)``: the words that titles and phrases show to be names, over the whole collection.

    A table, written once: it grows with the distinct names and never passes
    the driver.  Null and empty texts show nothing.
    """
    rows = texts.select(F.col(column).cast("string").alias("t")).where("t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, shown = Stream.known, Counter()
        used: Counter[str] = Counter()

        def out() -> pa.RecordBatch:
            words = list(used)
            return pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array([shown[w] for w in words], pa.int64()), pa.array([used[w] for w in words], pa.int64())], names=["word", "shown", "used"])

        for batch in batches:
            for t in batch.column(0).to_pylist():
                pieces = t.split()
                infos = [known[p] for p in pieces]
                used.update(x.name for x in infos)
                for a, b in _introductions(infos):
                    s = Stream(" ".join(pieces[a:b]))
                    _, _, _, titles, phrases = _flagged(s)
                    for i, j, _ in _proposed_names(s, titles, phrases):
                        shown.update(w for w in s.name[i:j] if len(w) > 2)
            if len(used) > _CACHE:  # partial counts add up
                yield out()
                shown.clear(), used.clear()
        yield out()

    counts = rows.mapInArrow(count, "word string, shown bigint, used bigint").groupBy("word").agg(F.sum("shown").alias("shown"), F.sum("used").alias("used"))
    return checkpointed(counts.where((F.col("shown") >= NAME_SUPPORT) & (F.col("shown") >= NAME_PURITY * F.col("used"))).select("word"))


def learn_names(texts: DataFrame, column: str) -> frozenset[str]:
    """``name_table`` as a set, for a collection known to be small."""
    return frozenset(r.word for r in name_table(texts, column).collect())


class _NameFilter:
    """Bloom filter of the name table: no listed word fails it, few others pass."""

    def __init__(self, names: DataFrame, bits: int = FILTER_BITS):
        self.bits = bits
        h = F.xxhash64("word")  # seed 42
        low = (1 << bits) - 1
        places = names.select(F.explode(F.array(*(x.bitwiseAND(F.lit(low)) + 1 for x in (h, F.shiftrightunsigned(h, bits))))).alias("p"))  # pages count from 1
        # one row of 4 KB per 32,768 bits: bounded by the filter's size
        rows = places.groupBy(F.expr("bitmap_bucket_number(p)").alias("b")).agg(F.expr("bitmap_construct_agg(bitmap_bit_position(p))").alias("m")).collect()
        self.pages = {r.b: bytes(r.m) for r in rows}
        self.key = xxhash.xxh64_intdigest(b"".join(self.pages[b] for b in sorted(self.pages)))

    def tester(self) -> Callable[[str], bool]:
        """The filter as a function; a worker keeps what it has looked up for its later tasks."""
        if self.key not in _TESTERS:
            _TESTERS.clear()
            _TESTERS[self.key] = _Passes(self.pages, self.bits)
        return _TESTERS[self.key].__getitem__


class _Passes(dict):
    def __init__(self, pages: dict[int, bytes], bits: int):
        super().__init__()
        self.pages, self.bits = pages, bits

    def __missing__(self, w: str) -> bool:
        h, hit = xxhash.xxh64_intdigest(w.encode(), 42), True
        for p in (h & (1 << self.bits) - 1, h >> self.bits & (1 << self.bits) - 1):
            page, at = self.pages.get((p >> 15) + 1), p & 32767
            hit = hit and page is not None and bool(page[at >> 3] >> (at & 7) & 1)
        if len(self) >= _CACHE:
            self.clear()
        self[w] = hit
        return hit


_TESTERS: dict[int, _Passes] = {}


_FOUND = "_h bigint, kind string, i int, j int, char_start int, char_end int, score double, word string, closed boolean, over int"


def _mentions(texts: DataFrame, keys: list[str], column: str, names: DataFrame | Collection[str]) -> DataFrame:
    """Mentions per (keys, hash of the text)."""
    spark = texts.sparkSession
    if not isinstance(names, DataFrame):
        names = spark.createDataFrame([(n,) for n in names], "word string")
    rows = texts.select(*keys, F.xxhash64(column).alias("_h"), F.col(column).cast("string").alias("_text")).where("_text is not null")
    key_types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.select(*keys).schema)
    bloom = _NameFilter(names)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        may_be = bloom.tester()
        for batch in batches:
            at, out = [], []
            for n, t in enumerate(batch.column("_text").to_pylist()):
                s, spans, listed = propose(t, may_be)
                at += [n] * (len(spans) + len(listed))
                out += [(kind, i, j, *s.span(i, j), score, None, None, None) for i, j, kind, score in spans]
                out += [("", k, k + 1, *s.span(k, k + 1), 0.7, s.name[k], bool(_CLOSES_NAME.search(s.raw[k])), _joins_on(s, k)) for k in listed]
            cols = list(zip(*out)) or [[]] * 9
            types = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.float64(), pa.string(), pa.bool_(), pa.int32()]
            where = pa.array(at, pa.int32())
            names_ = [*keys, "_h", "kind", "i", "j", "char_start", "char_end", "score", "word", "closed", "over"]
            yield pa.RecordBatch.from_arrays([*(batch.column(c).take(where) for c in (*keys, "_h")), *(pa.array(c, k) for c, k in zip(cols, types))], names=names_)

    # spans and the few tokens that passed the filter, written once; a common name may hold a third of the tokens
    found = checkpointed(rows.mapInArrow(scan, f"{key_types}, {_FOUND}"))
    sure = found.where("kind not in ('', 'person')")
    listed = salted_join(found.where("kind = ''"), names.select("word").distinct(), ["word"], "char_start")
    open_rows = found.where("kind = 'person'").unionByName(listed.select(*found.columns))
    token = F.struct("kind", "i", "j", "char_start", "char_end", "score", "closed", "over")
    # a text's own names: bounded by the text
    per_text = open_rows.groupBy(*keys, "_h").agg(F.collect_set(token).alias("tokens"))

    def stitch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, out = [], []
            for n, tokens in enumerate(batch.column("tokens").to_pylist()):
                part = _persons(
                    [(x["i"], x["j"], x["char_start"], x["char_end"], x["score"]) for x in tokens if x["kind"]],
                    [(x["i"], x["char_start"], x["char_end"], x["closed"], x["over"]) for x in tokens if not x["kind"]],
                )
                at += [n] * len(part)
                out += part
            where = pa.array(at, pa.int32())
            cols = list(zip(*out)) or [[]] * 3
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c).take(where) for c in (*keys, "_h")), pa.array(["person"] * len(at), pa.string()), *(pa.array(c, k) for c, k in zip(cols, (pa.int32(), pa.int32(), pa.float64())))],
                names=[*keys, "_h", "pii_type", "char_start", "char_end", "score"],
            )

    persons = per_text.mapInArrow(stitch, f"{key_types}, _h bigint, pii_type string, char_start int, char_end int, score double")
    return sure.select(*keys, "_h", F.col("kind").alias("pii_type"), "char_start", "char_end", "score").unionByName(persons)


def find_personal(texts: DataFrame, keys: list[str], column: str, names: DataFrame | Collection[str]) -> DataFrame:
    """One row per mention: ``keys``, pii_type, char_start, char_end, score.

    ``names`` is a table with a column ``word`` or a small collection.  Offsets
    are 0-based characters of the stored text.  Null and empty texts hold no
    mention; texts are read whole; repeated rows may give repeated mentions
    (callers deduplicate by key); other columns are ignored.

    One pass over the texts proposes everything but bare names.  Tokens that
    pass a Bloom filter of the name table (of fixed size) are joined with the
    table, salted, and listed neighbours become one mention.
    """
    return _mentions(texts, keys, column, names).select(*keys, "pii_type", "char_start", "char_end", "score")


def mask_personal(texts: DataFrame, column: str, names: DataFrame | Collection[str]) -> DataFrame:
    """``texts`` with every mention in ``column`` replaced by a placeholder; null stays null.

    Equal texts have equal mentions, so these are found once per distinct text
    and joined back by the text's hash and length, salted over the rows.
    """
    distinct = texts.select(F.col(column).alias("_text")).where("_text is not null").distinct().select("_text", F.length("_text").alias("_n"))
    found = _mentions(distinct, ["_n"], "_text", names)
    per_text = found.groupBy("_n", "_h").agg(F.array_sort(F.collect_set(F.struct("char_start", "char_end", "pii_type"))).alias("_found"))
    keyed = texts.withColumn("_h", F.xxhash64(column)).withColumn("_n", F.length(column)).withColumn("_row", F.monotonically_increasing_id())
    joined = salted_join(keyed, per_text, ["_n", "_h"], "_row", "left")
    # pieces of text between mentions and placeholders alternate
    at = lambda k: F.element_at("_found", k)
    pieces = F.transform(
        F.sequence(F.lit(1), F.size("_found")),
        lambda k: F.concat(
            F.substring(F.col(column), F.when(k == 1, F.lit(1)).otherwise(at(F.greatest(k - 1, F.lit(1)))["char_end"] + 1), F.greatest(at(k)["char_start"] - F.when(k == 1, F.lit(0)).otherwise(at(F.greatest(k - 1, F.lit(1)))["char_end"]), F.lit(0))),
            F.lit("["), F.upper(at(k)["pii_type"]), F.lit("]"),
        ),
    )
    rest = F.substring(F.col(column), at(-1)["char_end"] + 1, F.length(column))
    masked = F.when(F.col("_found").isNull(), F.col(column)).otherwise(F.concat(F.array_join(pieces, ""), rest))
    return joined.withColumn(column, masked).select(*texts.columns)
