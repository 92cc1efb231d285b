"""Free-typed values mapped to a reference list: token repair and soft TF-IDF."""

from __future__ import annotations

import math
import re
import unicodedata
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import salted_join

MAX_EDITS = 2
#: The score that an entry needs to be meant.
LEAST = 0.6

# Spellings that sound alike, and abbreviations of salt names.
_SOUNDS = [("ph", "f"), ("kw", "qu"), ("cw", "qu"), ("ks", "x"), ("ck", "k"), ("y", "i"), ("k", "c"), ("z", "s")]
_ABBREVIATIONS = {"hcl": "hydrochloride", "hci": "hydrochloride", "na": "sodium", "phos": "phosphate"}
_WORD = re.compile(r"[a-z0-9]+")
_DIGITS_INSIDE = str.maketrans("01", "oi")


def tokens(value: str) -> list[str]:
    """Lower-case words of letters and digits, without accents."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", value) if not unicodedata.combining(c)).lower()
    out = []
    for w in _WORD.findall(plain):
        if w.isdigit() or re.fullmatch(r"\d+[a-z]{1,3}", w):
            continue  # strengths
        out.append(_ABBREVIATIONS.get(w, w.translate(_DIGITS_INSIDE) if not w.isalpha() else w))
    return out


def sound(token: str) -> str:
    for a, b in _SOUNDS:
        token = token.replace(a, b)
    return token


def allowed(token: str) -> int:
    """Edits with which a token of this length is looked up."""
    return 0 if len(token) < 5 else 1 if len(token) < 6 else MAX_EDITS


def meant(word: str) -> int:
    """Edits that a reference word of this length may have suffered."""
    return 0 if len(word) < 5 else 1 if len(word) < 7 else MAX_EDITS


def deletions(token: str, edits: int) -> set[str]:
    """``token`` with up to ``edits`` characters left out."""
    found = last = {token}
    for _ in range(edits):
        last = {t[:i] + t[i + 1 :] for t in last for i in range(len(t))}
        found = found | last
    return found


def edit_distance(a: str, b: str, most: int) -> int:
    """Edits with swaps of neighbours counted once; ``most + 1`` if beyond."""
    if abs(len(a) - len(b)) > most:
        return most + 1
    before, row = None, list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        now = [i]
        for j, y in enumerate(b, 1):
            v = min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y))
            if before is not None and j > 1 and x == b[j - 2] and a[i - 2] == y:
                v = min(v, before[j - 2] + 1)
            now.append(v)
        if min(now) > most:
            return most + 1
        before, row = row, now
    return min(row[-1], most + 1)


def _tokenised(values: DataFrame) -> DataFrame:
    """(name, token): the tokens of every value and its joined neighbours."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, toks = [], []
            for name in batch.column(0).to_pylist():
                t = tokens(name)
                seen = dict.fromkeys([*t, *(a + b for a, b in zip(t, t[1:]))])
                names.extend([name] * len(seen)), toks.extend(seen)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(toks, pa.string())], names=["name", "token"])

    return values.mapInArrow(run, "name string, token string")


def _variants(toks: DataFrame, longest: int) -> DataFrame:
    """(token, variant) under deletion, of the sound of each token.

    A sound longer than the ``longest`` reference word by more than the edits
    can match none, so it has no variants.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                names, out = [], []
                for t in batch.column(0).slice(at, 500).to_pylist():
                    v = deletions(sound(t), allowed(t)) if len(sound(t)) <= longest + MAX_EDITS else ()
                    names.extend([t] * len(v)), out.extend(v)
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(out, pa.string())], names=["token", "variant"])

    return toks.mapInArrow(run, "token string, variant string")


def _measured(pairs: DataFrame) -> DataFrame:
    """(token, word, distance, raw) of the pairs within the allowed edits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for t, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                d = edit_distance(sound(t), sound(w), MAX_EDITS)
                if d <= min(allowed(t), meant(w)):
                    rows.append((t, w, d, edit_distance(t, w, 9)))
            cols = list(zip(*rows)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.int32()))], names=["token", "word", "distance", "raw"])

    return pairs.mapInArrow(run, "token string, word string, distance int, raw int")


def map_to_reference(entries: DataFrame, entry_id: str, value: str, reference: DataFrame, key: str | list[str], code: str, least: float = LEAST) -> DataFrame:
    """``(entry_id, code, name, score)``: the reference entry each value means.

    One row per entry id and value that is neither null nor blank; repeated rows
    count once.  ``key`` names the columns of the reference that spell its
    entries.  ``code`` is '' if no entry scores ``least``.  Ties go to the
    smallest code, also among the codes of one spelling.  An empty reference maps
    everything to ''; null keys or codes in it are disregarded; extra columns are
    ignored.

    Method: values are reduced to distinct names and tokens.  Tokens (and joined
    neighbours, for words typed apart) meet reference words in an equi-join on
    deletion variants of their sound, verified by edit distance; every word
    within the edits repairs the token, at its similarity.  Entries are ranked by
    soft TF-IDF over all their words.  Candidates of a name are the entries that
    share a repaired word with it, but for words so common that an entry sharing
    only these can't score ``least`` (see ``_anchored``).  The joins from names
    are salted, since one name or word may hold a third of them.
    """
    blank = r"^[\s\p{Z}​﻿]*$"
    typed = entries.select(F.col(entry_id).cast("bigint").alias("entry_id"), F.col(value).cast("string").alias("name")).where(F.col("name").isNotNull() & ~F.col("name").rlike(blank)).distinct()
    names = typed.select("name").distinct()
    keys = [key] if isinstance(key, str) else key
    spelled = F.explode(F.array(*(F.col(k).cast("string") for k in keys)))
    listed = reference.select(spelled.alias("spelling"), F.col(code).cast("string").alias("code")).where("spelling is not null and code is not null")
    listed = listed.select(F.lower(F.trim(F.regexp_replace("spelling", r"[^\p{L}\p{N}]+", " "))).alias("name"), "code").where("name <> ''")
    listed = listed.groupBy("name").agg(F.min_by("code", _code_order("code")).alias("code"))

    ref_words = listed.select("name", F.explode(F.array_distinct(F.split("name", " "))).alias("word"))
    n = listed.count()
    idf = ref_words.groupBy("word").agg(F.log1p(F.lit(float(max(n, 1))) / F.count("*")).alias("idf"))
    entry = _anchored(ref_words.join(idf, "word").groupBy("name").agg(F.sort_array(F.collect_list(F.struct("idf", "word")), asc=False).alias("words")), least)
    entry = entry.join(listed, "name").select(F.explode("anchors").alias("anchor"), "words", "norm", "code", F.col("name").alias("entry"))

    pieces = _tokenised(names)
    words = idf.select(F.col("word").alias("token"))
    toks = pieces.select("token").distinct()
    # sounds are at most a letter longer than their spelling, per letter replaced; twice the length is safe
    longest = 2 * (words.agg(F.max(F.length("token")).alias("n")).first().n or 0)
    pairs = _variants(toks, longest).join(_variants(words, longest).select(F.col("token").alias("word"), "variant"), "variant").select("token", "word").distinct()
    measured = _measured(pairs)
    nearest = measured.groupBy("token").agg(F.min(F.struct("distance", "raw")).alias("best"))
    # a token weighs what its nearest word does, whichever word it stands for
    near = (F.col("distance") == F.col("best.distance")) & (F.col("raw") == F.col("best.raw"))
    within = measured.join(nearest, "token").join(idf, "word")
    own = within.where(near).groupBy("token").agg(F.max("idf").alias("own"))
    repairs = within.join(own, "token").select("token", "word", "idf", "own", near.alias("nearest"), (1 - F.col("distance") / (2.0 * F.length("word")) - F.col("raw") / 1000.0).alias("sim"))

    repaired = salted_join(pieces, repairs, ["token"], "name").groupBy("name", "word").agg(F.max_by(F.struct("sim", "own"), F.struct("sim", "own")).alias("as"), F.max("idf").alias("idf"), F.max("nearest").alias("nearest"))
    vector = repaired.groupBy("name").agg(F.collect_list(F.struct("word", (F.col("as.sim") * F.col("as.own")).alias("w"), "idf", "nearest")).alias("got"))  # words of one name
    vector = vector.select("name", F.expr("map_from_entries(transform(got, x -> struct(x.word, x.w)))").alias("sims"), F.expr("sqrt(aggregate(filter(got, x -> x.nearest), 0D, (a, x) -> a + x.idf * x.idf))").alias("size"))
    met = salted_join(vector.select("*", F.explode(F.map_keys("sims")).alias("anchor")), entry, ["anchor"], "name")
    score = F.expr("aggregate(words, 0D, (a, x) -> a + x.idf * coalesce(sims[x.word], 0D))") / (F.col("norm") * F.col("size"))
    best = met.withColumn("score", score).where(F.col("score") >= least).groupBy("name").agg(F.min_by(F.struct("code", "score"), F.struct(F.negative(F.round("score", 9)), _code_order("code"))).alias("best"))
    decided = best.select("name", "best.code", "best.score")
    return salted_join(typed, decided, ["name"], "entry_id", "left").select("entry_id", F.coalesce("code", F.lit("")).alias("code"), "name", F.coalesce("score", F.lit(0.0)).alias("score"))


def _code_order(c: str) -> Column:
    """Codes of digits as numbers, others after them as text."""
    return F.struct(F.length(c), F.col(c))


def _anchored(entries: DataFrame, least: float) -> DataFrame:
    """``entries`` with their norm and the words by which they are found.

    ``words`` stand rarest first.  A name that shares no word before the k-th
    has a score of at most the share of the entry's norm that the words from the
    k-th on make up (Cauchy-Schwarz); twice that mass where a token stands for two
    of its words, which is allowed for.  Where even that is below ``least`` the
    words from the k-th on need not find the entry.
    """
    norm = F.expr("sqrt(aggregate(words, 0D, (a, x) -> a + x.idf * x.idf))")
    rest = "sqrt(aggregate(slice(words, i + 1, size(words)), 0D, (a, y) -> a + y.idf * y.idf))"
    anchors = F.expr(f"transform(filter(words, (x, i) -> {rest} >= {least / math.sqrt(2)} * norm), x -> x.word)")
    return entries.withColumn("norm", norm).withColumn("anchors", anchors)
