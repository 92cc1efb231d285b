"""String similarity from the published definitions: Jaro-Winkler, Double Metaphone."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


def jaro(a: str, b: str) -> float:
    """Share of characters that match within half the longer length, less swaps."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(max(len(a), len(b)) // 2 - 1, 0)
    free, mine = [True] * len(b), []
    for i, c in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == c:
                free[j] = False
                mine.append(c)
                break
    m = len(mine)
    if not m:
        return 0.0
    other = [c for c, f in zip(b, free) if not f]
    swaps = sum(x != y for x, y in zip(mine, other)) // 2
    return (m / len(a) + m / len(b) + (m - swaps) / m) / 3


def jaro_winkler(a: str, b: str) -> float:
    """Jaro, raised by a common prefix of up to four characters where it is above 0.7."""
    j = jaro(a, b)
    if j <= 0.7:
        return j
    prefix = 0
    for x, y in zip(a[:4], b[:4]):
        if x != y:
            break
        prefix += 1
    return j + 0.1 * prefix * (1 - j)


_VOWELS = set("AEIOUY")


def double_metaphone(word: str) -> tuple[str, str]:
    """Primary and secondary phonetic code (the secondary repeats the primary if there is none)."""
    w = "".join(c for c in word.upper() if c.isalpha() or c == " ")
    n, out1, out2 = len(w), [], []
    at = lambda i, k=1: w[i : i + k] if i >= 0 else ""
    slavic = "W" in w or "K" in w or "CZ" in w or "WITZ" in w

    def put(a: str, b: str | None = None) -> None:
        out1.append(a)
        out2.append(a if b is None else b)

    i = 1 if at(0, 2) in ("GN", "KN", "PN", "WR", "PS") else 0
    if at(0) == "X":
        put("S")
        i = 1
    while i < n:
        c, nxt, step = w[i], at(i + 1), 1
        if c in _VOWELS:
            if i == 0:
                put("A")
        elif c == "B":
            put("P")
            step = 2 if nxt == "B" else 1
        elif c == "Ç":
            put("S")
        elif c == "C":
            if i > 1 and at(i - 2) not in _VOWELS and at(i - 1, 3) == "ACH" and at(i + 2) not in ("I", "E"):
                put("K")
                step = 2
            elif i == 0 and at(0, 6) == "CAESAR":
                put("S")
                step = 2
            elif nxt == "H":
                if at(i, 4) == "CHAE":
                    put("K", "X")
                elif i == 0 and (at(1, 5) in ("HARAC", "HARIS") or at(1, 3) in ("HOR", "HYM", "HIA", "HEM")) and at(0, 5) != "CHORE":
                    put("K")
                elif at(0, 3) == "SCH" or at(i + 2) in ("T", "S") or ((i == 0 or at(i - 1) in ("A", "O", "U", "E")) and at(i + 2) in ("L", "R", "N", "M", "B", "H", "F", "V", "W", "")):
                    put("K")
                else:
                    put("X" if i == 0 else "X", "X" if i == 0 else "K")
                step = 2
            elif nxt == "Z" and at(i - 2, 4) != "WICZ":
                put("S", "X")
                step = 2
            elif at(i + 1, 3) == "CIA":
                put("X")
                step = 3
            elif nxt == "C" and not (i == 1 and at(0) == "M"):
                if at(i + 2) in ("I", "E", "H") and at(i + 2, 2) != "HU":
                    put("KS" if (i == 1 and at(0) == "A") or at(i - 1, 5) in ("UCCEE", "UCCES") else "X")
                    step = 3
                else:
                    put("K")
                    step = 2
            elif nxt in ("K", "G", "Q"):
                put("K")
                step = 2
            elif nxt in ("I", "E", "Y"):
                put("S", "X" if at(i, 3) in ("CIO", "CIE", "CIA") else "S")
                step = 2
            else:
                put("K")
                step = 3 if at(i + 1, 2) in (" C", " Q", " G") else 2 if nxt in ("C", "K", "Q") and at(i + 1, 2) not in ("CE", "CI") else 1
        elif c == "D":
            if nxt == "G":
                if at(i + 2) in ("I", "E", "Y"):
                    put("J")
                    step = 3
                else:
                    put("TK")
                    step = 2
            else:
                put("T")
                step = 2 if nxt in ("T", "D") else 1
        elif c == "G":
            if nxt == "H":
                if i > 0 and at(i - 1) not in _VOWELS:
                    put("K")
                elif i == 0:
                    put("J" if at(i + 2) == "I" else "K")
                elif not ((i > 1 and at(i - 2) in ("B", "H", "D")) or (i > 2 and at(i - 3) in ("B", "H", "D")) or (i > 3 and at(i - 4) in ("B", "H"))):
                    if i > 2 and at(i - 1) == "U" and at(i - 3) in ("C", "G", "L", "R", "T"):
                        put("F")
                    elif at(i - 1) != "I":
                        put("K")
                step = 2
            elif nxt == "N":
                if i == 1 and at(0) in _VOWELS and not slavic:
                    put("KN", "N")
                elif at(i + 2, 2) != "EY" and at(i + 1) != "Y" and not slavic:
                    put("N", "KN")
                else:
                    put("KN")
                step = 2
            elif at(i + 1, 2) == "LI" and not slavic:
                put("KL", "L")
                step = 2
            elif i == 0 and (nxt == "Y" or at(1, 2) in ("ES", "EP", "EB", "EL", "EY", "IB", "IL", "IN", "IE", "EI", "ER")):
                put("K", "J")
                step = 2
            elif (at(i + 1, 2) == "ER" or nxt == "Y") and at(0, 6) not in ("DANGER", "RANGER", "MANGER") and at(i - 1) not in ("E", "I") and at(i - 1, 3) not in ("RGY", "OGY"):
                put("K", "J")
                step = 2
            elif nxt in ("E", "I", "Y") or at(i - 1, 4) in ("AGGI", "OGGI"):
                put("K") if at(0, 3) == "SCH" or at(i + 1, 2) == "ET" else put("J", "J" if at(i + 1, 4) == "IER" else "K")
                step = 2
            else:
                put("K")
                step = 2 if nxt == "G" else 1
        elif c == "H":
            if (i == 0 or at(i - 1) in _VOWELS) and nxt in _VOWELS:
                put("H")
                step = 2
        elif c == "J":
            if at(i, 4) == "JOSE" or at(0, 4) == "SAN ":
                put("H") if (i == 0 and at(i + 4) in (" ", "")) or at(0, 4) == "SAN " else put("J", "H")
            elif i == 0:
                put("J", "A")
            elif at(i - 1) in _VOWELS and not slavic and nxt in ("A", "O"):
                put("J", "H")
            elif i == n - 1:
                put("J", "")
            elif nxt not in ("L", "T", "K", "S", "N", "M", "B", "Z") and at(i - 1) not in ("S", "K", "L"):
                put("J")
            step = 2 if nxt == "J" else 1
        elif c in "KQ":
            put("K")
            step = 2 if nxt == c else 1
        elif c == "L":
            if nxt == "L" and (i == n - 3 and at(i - 1, 4) in ("ILLO", "ILLA", "ALLE") or (w[-2:] in ("AS", "OS") or w[-1:] in ("A", "O")) and at(i - 1, 4) == "ALLE"):
                put("L", "")
            else:
                put("L")
            step = 2 if nxt == "L" else 1
        elif c == "M":
            put("M")
            step = 2 if nxt == "M" or (at(i - 1, 3) == "UMB" and (i + 1 == n - 1 or at(i + 2, 2) == "ER")) else 1
        elif c == "N":
            put("N")
            step = 2 if nxt == "N" else 1
        elif c == "Ñ":
            put("N")
        elif c == "P":
            put("F" if nxt == "H" else "P")
            step = 2 if nxt in ("H", "P", "B") else 1
        elif c == "R":
            put("", "R") if i == n - 1 and not slavic and at(i - 2, 2) == "IE" and at(i - 4, 2) not in ("ME", "MA") else put("R")
            step = 2 if nxt == "R" else 1
        elif c == "S":
            if at(i - 1, 3) in ("ISL", "YSL"):
                pass
            elif i == 0 and at(0, 5) == "SUGAR":
                put("X", "S")
            elif nxt == "H":
                put("S" if at(i + 1, 4) in ("HEIM", "HOEK", "HOLM", "HOLZ") else "X")
                step = 2
            elif at(i, 3) in ("SIO", "SIA"):
                put("S", "S" if slavic else "X")
                step = 3
            elif (i == 0 and nxt in ("M", "N", "L", "W")) or nxt == "Z":
                put("S", "X")
                step = 2 if nxt == "Z" else 1
            elif nxt == "C":
                if at(i + 2) == "H":
                    if at(i + 3, 2) in ("OO", "ER", "EN", "UY", "ED", "EM"):
                        put("X", "SK") if at(i + 3, 2) in ("ER", "EN") else put("SK")
                    else:
                        put("X", "S" if i == 0 and at(3) not in _VOWELS and at(3) != "W" else "X")
                else:
                    put("S" if at(i + 2) in ("I", "E", "Y") else "SK")
                step = 3
            else:
                put("", "S") if i == n - 1 and at(i - 2, 2) in ("AI", "OI") else put("S")
                step = 2 if nxt in ("S", "Z") else 1
        elif c == "T":
            if at(i, 4) == "TION" or at(i, 3) in ("TIA", "TCH"):
                put("X")
                step = 3
            elif nxt == "H" or at(i, 3) == "TTH":
                put("T") if at(i + 2, 2) in ("OM", "AM") or at(0, 3) == "SCH" else put("0", "T")
                step = 2
            else:
                put("T")
                step = 2 if nxt in ("T", "D") else 1
        elif c == "V":
            put("F")
            step = 2 if nxt == "V" else 1
        elif c == "W":
            if nxt == "R":
                put("R")
                step = 2
            else:
                if i == 0 and (nxt in _VOWELS or at(0, 2) == "WH"):
                    put("A", "F" if nxt in _VOWELS else "A")
                if (i == n - 1 and at(i - 1) in _VOWELS) or at(i - 1, 5) in ("EWSKI", "EWSKY", "OWSKI", "OWSKY") or at(0, 3) == "SCH":
                    put("", "F")
                elif at(i, 4) in ("WICZ", "WITZ"):
                    put("TS", "FX")
                    step = 4
        elif c == "X":
            if not (i == n - 1 and (at(i - 3, 3) in ("IAU", "EAU") or at(i - 2, 2) in ("AU", "OU"))):
                put("KS")
            step = 2 if nxt in ("C", "X") else 1
        elif c == "Z":
            if nxt == "H":
                put("J")
                step = 2
            else:
                put("S", "TS") if at(i + 1, 2) in ("ZO", "ZI", "ZA") or (slavic and i > 0 and at(i - 1) != "T") else put("S")
                step = 2 if nxt == "Z" else 1
        i += step
    primary, secondary = "".join(out1), "".join(out2)
    return primary, secondary or primary


def _similarities(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else jaro_winkler(x, y) for x, y in zip(a, b)], dtype="float64")


def _codes(a: pd.Series) -> pd.Series:
    known = {v: None if v is None else list(double_metaphone(v.replace("-", " "))) for v in a.unique()}
    return a.map(known)


def jaro_winkler_similarity(a: Column, b: Column) -> Column:
    """Jaro-Winkler of two columns; null if either is null."""
    return F.pandas_udf(_similarities, "double")(a, b)


def metaphone_codes(a: Column) -> Column:
    """Both Double Metaphone codes; a hyphen separates words; null stays null."""
    return F.pandas_udf(_codes, "array<string>")(a)
