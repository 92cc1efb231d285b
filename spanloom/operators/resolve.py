"""Resolving typed or spoken names against the name index, in stages.

Each stage works on distinct keys and passes on only what it left open: exact
key, key variants, then the exhaustive similarity stage with a margin test.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from spanloom.functions.names import ends_in_form, name_key, normalized
from spanloom.functions.similarity import double_metaphone, jaro_winkler
from spanloom.operators.skew import salted_join
from spanloom.operators.vocabulary import BEST_ORDER, CANONICAL_ORDER, brand_pairs, ingredient_frequency, salt_pairs, type_rank
from spanloom.session import checkpointed, shuffle_partitions

# Weights, thresholds and word lists of the decision.
RECALL, THRESHOLD, MARGIN, MAX_EDITS = 0.80, 0.72, 0.06, 3
WEIGHTS = {"jaro": 0.55, "phonetic": 0.15, "token": 0.08, "type": 0.12, "frequency": 0.10}
TYPE_PRIOR = {"IN": 1.0, "BN": 1.0, "PIN": 0.92, "TMSY": 0.70, "SY": 0.65}
PHRASE_TAIL = frozenset("up to at of from for in on by with about around and or back down over under per a an".split())
DESCRIPTORS = ("water", "sugar", "fluid", "oxygen", "iron", "air", "salt", "starch", "blood", "heart", "nerve", "pain", "sleep", "stomach", "chest", "breathing")
#: The index is the query set of the similarity stage; it is matched in blocks of this many rows.
BLOCK_ROWS = 20_000


class _Block:
    """One block of (rxcui, tty, str, key, salt_key, prior), prepared for the bound of the Jaro-Winkler similarity."""

    def __init__(self, rows: list[tuple]):
        self.rows, self.keys = rows, [r[3] for r in rows]
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(self.keys))))}
        self.bag = np.array([self._bag(k) for k in self.keys], np.uint8)
        self.lengths = np.array([max(len(k), 1) for k in self.keys], np.float32)
        self.heads = np.array([[ord(c) for c in (k + "\0\0\0\0")[:4]] for k in self.keys]).T
        self.words = [frozenset(k.split()) for k in self.keys]
        self.by_code: dict[str, list[int]] = {}
        for i, k in enumerate(self.keys):
            for c in _sounds(k):
                self.by_code.setdefault(c, []).append(i)

    def _bag(self, key: str) -> np.ndarray:
        known = [self.letters[c] for c in key if c in self.letters]
        return np.minimum(np.bincount(known, minlength=len(self.letters)), 255).astype(np.uint8)

    def near(self, q: str) -> list[int]:
        """Rows that may reach the recall floor: all of them, since shared letters and prefix bound the similarity."""
        shared = np.minimum(self.bag, self._bag(q)).sum(1, dtype=np.float32)
        bound = np.where(shared > 0, (shared / self.lengths + shared / max(len(q), 1) + 1) / 3, 0)
        same, prefix = np.ones(len(self.keys), bool), np.zeros(len(self.keys), np.float32)
        for at, c in enumerate(q[:4]):
            same &= self.heads[at] == ord(c)
            prefix += same
        return np.flatnonzero(bound + 0.1 * prefix * (1 - bound) >= RECALL - 1e-6).tolist()


_PREPARED: dict[int, _Block] = {}


def _sounds(key: str) -> set[str]:
    return set(double_metaphone(key.replace("-", " "))) - {""}


def _block_scorer(block: list[tuple]):
    """Scores all keys of a batch against one block of the index; a worker prepares a block once."""
    name = hash(tuple(block))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _PREPARED:
            _PREPARED.clear()
            _PREPARED[name] = _Block(block)
        b = _PREPARED[name]
        for batch in batches:
            rows = []
            for q in batch.column(0).to_pylist():
                sounds = {i for c in _sounds(q) for i in b.by_code.get(c, ())}
                words = frozenset(q.split())
                for i in sounds.union(b.near(q)):
                    j = jaro_winkler(q, b.keys[i])
                    if j < RECALL and i not in sounds:
                        continue
                    token = j if len(words) == len(b.words[i]) == 1 else len(words & b.words[i]) / max(1, len(words | b.words[i]))
                    rxcui, tty, name_, key, _, prior = block[i]
                    score = WEIGHTS["jaro"] * j + WEIGHTS["phonetic"] * (i in sounds) + WEIGHTS["token"] * token + WEIGHTS["type"] * TYPE_PRIOR.get(tty, 0.5) + WEIGHTS["frequency"] * prior
                    rows.append((q, rxcui, tty, name_, key, score))
            cols = list(zip(*rows)) or [[]] * 6
            types = [pa.string()] * 5 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["q", "rxcui", "tty", "str", "key", "score"])

    return run


def fuzzy_candidates(keys: DataFrame, index: DataFrame) -> DataFrame:
    """J-12/X-10: every index row whose key has Jaro-Winkler >= 0.80 or sounds alike, with its score.

    Exhaustive by meaning: the index, a reference list, is the stated query set
    and passes in blocks; a bound from shared letters and prefix, which no true
    match can miss, spares most comparisons.
    """
    schema, out, block = "q string, rxcui string, tty string, str string, key string, score double", None, []
    rows = index.select("rxcui", "tty", "str", "key", "salt_key", "prior").where("key <> ''").distinct().toLocalIterator()

    def flush(out, block):
        part = keys.select("q").mapInArrow(_block_scorer(block), schema)
        return part if out is None else out.unionByName(part)

    for r in rows:
        block.append(tuple(r))
        if len(block) == BLOCK_ROWS:
            out, block = flush(out, block), []
    return flush(out, block) if block or out is None else out


_CANDIDATE = "array<struct<rxcui:string,name:string,tty:string,score:double,edit_distance:int>>"


def _candidate(score: Column, edits: Column, row: str = "") -> Column:
    at = lambda c: F.col(f"{row}{c}")
    return F.struct(at("rxcui").alias("rxcui"), at("str").alias("name"), at("tty").alias("tty"), F.round(score, 4).alias("score"), edits.alias("edit_distance"))


def _best_type(hits: DataFrame, by: list[str]) -> DataFrame:
    """U-02: per mention only the hits of the best type, whether they are one concept, and all of them by name."""
    rank = type_rank(F.col("tty"), BEST_ORDER)
    best = hits.groupBy(*by).agg(F.min(rank).alias("best"))
    top = hits.join(best, by).where(rank == F.col("best"))
    listed = F.array_sort(F.collect_set(F.struct("str", "rxcui", "tty")))  # names of one spelling in a reference list
    return top.groupBy(*by).agg(F.count_distinct("rxcui").alias("n_concepts"), F.min_by(F.struct("rxcui", "tty", "str", "key"), F.struct("str", "rxcui")).alias("row"), listed.alias("listed"))


def resolve_keys(keys: DataFrame, index: DataFrame) -> DataFrame:
    """Status, code and candidates of each distinct normalised key (column ``q`` with its variants).

    ``keys`` has q, salt_key, base_key; ``index`` rxcui, tty, str, key, salt_key,
    base_key, prior.  Returns q, status, match_type, rxcui, tty, name, score,
    runner_up, edit_distance, candidates.

    T-02: candidates of an unresolved key are its five best; of an ambiguous one
    those of the five best within twice the margin (of several concepts with its
    very key, all); of a resolved one the second to fourth.
    """
    none, no_one = F.lit(None), F.lit(None).cast(_CANDIDATE)
    columns = ["q", "status", "match_type", "rxcui", "tty", "name", "score", "runner_up", "edit_distance", "candidates"]
    row = index.select("rxcui", "tty", "str", "key")
    exact = _best_type(keys.select("q").join(row.withColumn("q", F.col("key")), "q"), ["q"])
    one = F.col("n_concepts") == 1
    alike = F.transform("listed", lambda x: F.struct(x["rxcui"].alias("rxcui"), x["str"].alias("name"), x["tty"].alias("tty"), F.lit(1.0).alias("score"), F.lit(0).alias("edit_distance")))
    done1 = exact.select(
        "q", F.when(one, "resolved").otherwise("ambiguous").alias("status"), F.lit("exact").alias("match_type"), F.when(one, F.col("row.rxcui")).alias("rxcui"), F.when(one, F.col("row.tty")).alias("tty"),
        F.col("row.str").alias("name"), F.lit(1.0).alias("score"), none.cast("double").alias("runner_up"), F.lit(0).alias("edit_distance"), F.when(~one, alike).alias("candidates"),
    )

    # what a stage decides is written once: the stages after it and the result read it
    done1 = checkpointed(done1)
    open1 = checkpointed(keys.join(done1.select("q"), "q", "left_anti"))
    stages = None
    for n, (mine, theirs) in enumerate([("q", "salt_key"), ("salt_key", "key"), ("base_key", "key"), ("base_key", "base_key")]):
        side = index.select("rxcui", "tty", "str", "key", F.col(theirs).alias("_at"))
        part = open1.select("q", F.col(mine).alias("_at")).join(side, "_at").where("_at <> ''").select("q", F.lit(n).alias("stage"), "rxcui", "tty", "str", "key")
        stages = part if stages is None else stages.unionByName(part)
    variant = _best_type(stages, ["q", "stage"]).where("n_concepts = 1").groupBy("q").agg(F.min_by("row", "stage").alias("row"))
    done2 = variant.select(
        "q", F.lit("resolved").alias("status"), F.lit("variant").alias("match_type"), "row.rxcui", "row.tty", F.col("row.str").alias("name"), F.lit(0.9).alias("score"),
        none.cast("double").alias("runner_up"), F.levenshtein("q", "row.key").alias("edit_distance"), no_one.alias("candidates"),
    )

    done2 = checkpointed(done2)
    open2 = open1.join(done2.select("q"), "q", "left_anti")
    # few keys may be left, but each costs a pass over the index: spread them
    n = shuffle_partitions(keys.sparkSession)
    scored = fuzzy_candidates(open2.select("q").repartition(n, "q"), index)
    # U-03: one candidate per key, with the best score and the row of the best type
    rank = F.struct(type_rank(F.col("tty"), BEST_ORDER), F.negative("score"), F.col("str"), F.col("rxcui"))
    per_key = scored.groupBy("q", "key").agg(F.max("score").alias("score"), F.min_by(F.struct("rxcui", "str", "tty"), rank).alias("row"))
    # T-01: at most five rows of a key's pool leave their partition
    order = Window.partitionBy("q").orderBy(F.desc("score"), type_rank(F.col("row.tty"), BEST_ORDER), "row.str", "row.rxcui")
    five = per_key.withColumn("nth", F.row_number().over(order)).where("nth <= 5")
    told = F.struct("nth", "score", _candidate(F.col("score"), F.levenshtein("q", "key"), "row.").alias("c"))
    top = five.groupBy("q").agg(F.array_sort(F.collect_list(told)).alias("five")).withColumn("a", F.col("five")[0])
    best, second, edits = F.col("a.score"), F.coalesce(F.try_element_at("five", F.lit(2))["score"], F.lit(0.0)), F.col("a.c.edit_distance")
    # W-05: the margin decides, not the threshold alone
    status = F.when((best < THRESHOLD) | (edits > MAX_EDITS), "unresolved").when(best - second < MARGIN, "ambiguous").otherwise("resolved")
    done3 = top.withColumn("status", status).select(
        "q", "status", F.lit("fuzzy").alias("match_type"), *(F.when(F.col("status") == "resolved", F.col(f"a.c.{c}")).alias(c) for c in ("rxcui", "tty")), F.col("a.c.name").alias("name"),
        F.round(best, 4).alias("score"), F.round(second, 4).alias("runner_up"), edits.alias("edit_distance"),
        F.transform(
            F.when(F.col("status") == "unresolved", F.col("five")).when(F.col("status") == "resolved", F.slice("five", 2, 3)).otherwise(F.filter("five", lambda x: best - x["score"] < 2 * MARGIN)),
            lambda x: x["c"],
        ).alias("candidates"),
    )
    known = done1.unionByName(done2).unionByName(checkpointed(done3))
    rest = keys.join(known.select("q"), "q", "left_anti").select(
        "q", F.lit("unresolved").alias("status"), F.lit("none").alias("match_type"), *(none.cast("string").alias(c) for c in ("rxcui", "tty", "name")), F.lit(0.0).alias("score"),
        none.cast("double").alias("runner_up"), none.cast("int").alias("edit_distance"), no_one.alias("candidates"),
    )
    return known.unionByName(rest).select(*columns)


def head_of_phrase(key: str) -> str:
    """X-11: the words before the first function word or number."""
    words = key.split()
    cut = next((i for i, w in enumerate(words) if w in PHRASE_TAIL or w[0].isdigit()), len(words))
    return " ".join(words[:cut])


def correction_tail(raw: str) -> str | None:
    """X-12: the word on which a comma-separated stutter settled, or None."""
    *tried, last = [words[-1].lower() for part in (raw or "").split(",") if (words := part.split())] or [""]
    settled = len(tried) > 1 and len(last) > 3 and all(len(w) > 1 and last.startswith(w[:2]) for w in tried)
    return last if settled else None


def resolve_mentions(mentions: DataFrame, mention_id: str, mention: str, names: DataFrame, products: DataFrame) -> DataFrame:
    """The whole cascade for raw mentions: ``(mention_id, status, match_type, rxcui, tty, name, score, via, candidates)``.

    Keys are resolved once each.  An exact hit that is spelled otherwise is
    'case_insensitive'.  A colloquial reference ("water pill") is demoted to
    unresolved, and what was suspected stays as its only candidate; an unresolved
    phrase is retried on its head ("metoprolol up to 50").  A mention that is
    still unresolved and has no candidates gets those of the word on which a
    stutter settled, but stays unresolved.  Null or empty mentions and those
    without a key are unresolved.
    """
    prior = ingredient_frequency(products).select(F.lower(F.trim("ingredient_key")).alias("salt_key"), "prior").groupBy("salt_key").agg(F.max("prior").alias("prior"))
    index = checkpointed(names.select("rxcui", "tty", "str", "key", "salt_key", "base_key").distinct().join(prior, "salt_key", "left").fillna(0.0, ["prior"]))  # every stage reads it
    raw = mentions.select(F.col(mention_id).alias("mention_id"), F.col(mention).cast("string").alias("raw")).distinct()
    keyed = raw.withColumn("k", normalized(F.col("raw"))).select("mention_id", "raw", F.col("k.key").alias("q"), F.col("k.salt_key").alias("salt_key"), F.col("k.base_key").alias("base_key"))
    keyed = keyed.withColumn("head", F.pandas_udf(_heads, "string")("q")).withColumn("tail", F.pandas_udf(_tails, "string")("raw")).withColumn("form", ends_in_form(F.col("raw")))
    keyed = checkpointed(keyed)
    others = keyed.select(F.explode(F.array("head", "tail")).alias("q")).where("q <> ''").distinct().withColumn("k", normalized(F.col("q"))).select("q", F.col("k.salt_key").alias("salt_key"), F.col("k.base_key").alias("base_key"))
    every = keyed.select("q", "salt_key", "base_key").unionByName(others).where("q <> ''").dropDuplicates(["q"])
    decided = checkpointed(resolve_keys(checkpointed(every), index))
    fields = ("status", "match_type", "rxcui", "tty", "name", "score", "edit_distance", "candidates")
    of = lambda at: decided.select(F.col("q").alias(at), *(F.col(c).alias(f"{at}_{c}") for c in fields))
    told = keyed
    for at in ("q", "head", "tail"):  # a name typed often is one key: the joins are salted
        told = salted_join(told, of(at), [at], "mention_id", "left")
    is_ = lambda at, status: F.coalesce(F.col(f"{at}_status"), F.lit("unresolved")) == status
    by_head = is_("q", "unresolved") & (F.col("head") != F.col("q")) & ~is_("head", "unresolved")
    pick = lambda c: F.when(by_head, F.col(f"head_{c}")).otherwise(F.col(f"q_{c}"))
    told = told.withColumn("by_head", F.coalesce(by_head, F.lit(False))).select("mention_id", "raw", "q", "by_head", "form", *(c for c in told.columns if c.startswith("tail")), *(pick(c).alias(c) for c in fields))

    colloquial = F.coalesce(F.col("form") & F.col("q").isin(*DESCRIPTORS) & (F.col("status") == "resolved") & ~F.col("by_head"), F.lit(False))
    as_one = lambda p: F.array(F.struct(F.col(f"{p}rxcui").alias("rxcui"), F.col(f"{p}name").alias("name"), F.col(f"{p}tty").alias("tty"), F.round(f"{p}score", 4).alias("score"), F.coalesce(F.col(f"{p}edit_distance"), F.lit(0)).alias("edit_distance")))
    own = F.when(F.size("candidates") > 0, F.col("candidates"))
    settled = F.when(is_("tail", "resolved"), as_one("tail_")).otherwise(F.slice("tail_candidates", 1, 3))
    lost = F.coalesce(F.col("status"), F.lit("unresolved")) == "unresolved"
    match = F.when(F.col("match_type") == "variant", "fuzzy").when((F.col("match_type") == "exact") & (F.col("status") == "resolved") & (F.trim("raw") != F.col("name")), "case_insensitive").otherwise(F.col("match_type"))
    return told.select(
        "mention_id", F.when(colloquial | lost, "unresolved").otherwise(F.col("status")).alias("status"), F.when(colloquial | lost, "none").otherwise(match).alias("match_type"),
        *(F.when(~colloquial, F.col(c)).alias(c) for c in ("rxcui", "tty")), "name", F.when(~colloquial, F.coalesce("score", F.lit(0.0))).otherwise(0.0).alias("score"),
        F.when(F.col("by_head"), "head").otherwise("whole").alias("via"),
        F.coalesce(F.when(colloquial, as_one("")).when(lost & own.isNull(), settled).otherwise(own), F.array().cast(_CANDIDATE)).alias("candidates"),
    )


def _heads(keys: pd.Series) -> pd.Series:
    return keys.map(lambda k: name_key(head_of_phrase(k)).key if k else "")


def _tails(raw: pd.Series) -> pd.Series:
    return raw.map(lambda r: name_key(t).key if r is not None and r == r and (t := correction_tail(r)) else "")


def concept_facts(names: DataFrame, products: DataFrame) -> DataFrame:
    """Enrichment of every code: canonical name, ingredients, brands, salts, dose forms and strengths.

    Returns ``(rxcui, tty, canonical_name, is_brand, ingredients, brand_names,
    salt_candidates, dose_forms, strengths)``, lists sorted.  A brand's
    ingredients, and an ingredient's brands, come from branded products; only an
    ingredient has salts (two at least).  A salt's products are those of its full
    key, failing these those of its ingredient.  Codes without products have
    empty lists; null keys join nothing.
    """
    rows = names.where("rxcui is not null").groupBy("rxcui").agg(F.min_by(F.struct("tty", "str", "key", "salt_key"), F.struct(type_rank(F.col("tty"), CANONICAL_ORDER), F.length("str"), F.col("str"))).alias("n"))
    rows = rows.select("rxcui", "n.*")
    pairs = brand_pairs(products)
    by_brand = pairs.groupBy(F.col("brand_key").alias("key")).agg(F.sort_array(F.collect_set("ingredient_key")).alias("of_brand"))
    by_ingredient = pairs.groupBy(F.col("ingredient_key").alias("salt_key")).agg(F.sort_array(F.collect_set("brand_name")).alias("brands"))
    salts = salt_pairs(names.distinct(), products).groupBy(F.col("in_rxcui").alias("rxcui")).agg(F.sort_array(F.collect_set("pin_name")).alias("salts"))
    known = rows.join(by_brand, "key", "left").withColumn("at", F.when(F.col("tty") == "BN", F.coalesce(F.col("of_brand")[0], F.col("key"))).otherwise(F.col("salt_key")))
    known = known.join(by_ingredient.withColumnRenamed("salt_key", "at"), "at", "left").join(salts, "rxcui", "left")

    p = products.select("rxcui", "str", F.lower(F.trim("ingredient_key")).alias("own"), F.lower(F.trim("ingredient_full_key")).alias("full"), F.lower(F.trim("dose_form")).alias("form")).distinct()
    strength = F.regexp_extract("str", r"((?:\d+(?:\.\d+)?)\s*(?:MG|MCG|ML|G|UNT)\b)", 1)
    sold = lambda k: p.where(f"{k} <> ''").groupBy(F.col(k).alias("k")).agg(F.sort_array(F.collect_set(F.nullif("form", F.lit("")))).alias("forms"), F.sort_array(F.collect_set(F.nullif(strength, F.lit("")))).alias("found"))
    full = sold("full").select(F.col("k").alias("key"), F.col("forms").alias("f_forms"), F.col("found").alias("f_found"))
    known = known.join(sold("own").withColumnRenamed("k", "at"), "at", "left").join(full, "key", "left")
    exact = (F.col("tty") == "PIN") & F.col("f_forms").isNotNull()
    empty = F.array().cast("array<string>")
    return known.select(
        "rxcui", "tty", F.col("str").alias("canonical_name"), (F.col("tty") == "BN").alias("is_brand"), F.when(F.col("tty") == "BN", F.coalesce("of_brand", empty)).otherwise(F.array("str")).alias("ingredients"),
        F.when(F.col("tty") == "BN", F.array("str")).otherwise(F.coalesce("brands", empty)).alias("brand_names"), F.coalesce(F.when(F.col("tty") == "IN", F.col("salts")), empty).alias("salt_candidates"),
        F.coalesce(F.when(exact, F.col("f_forms")).otherwise(F.col("forms")), empty).alias("dose_forms"), F.coalesce(F.when(exact, F.col("f_found")).otherwise(F.col("found")), empty).alias("strengths"),
    )
