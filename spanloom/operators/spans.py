"""Evidence spans: where quotes occur verbatim, and which are discarded."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import salts_for

def _positions(text: str, quote: str) -> list[tuple[int, int]]:
    """All occurrences, overlapping ones too."""
    out, at = [], text.find(quote)
    while at >= 0:
        out.append((at, at + len(quote)))
        at = text.find(quote, at + 1)
    return out


def _loose(text: str, quote: str) -> list[tuple[int, int]]:
    """Occurrences when any run of blanks equals any other."""
    return [m.span() for m in re.finditer(r"\s+".join(map(re.escape, quote.split())), text)]


def find_spans(quotes: DataFrame, texts: DataFrame, quote_id: str, key: str, quote: str, text: str) -> DataFrame:
    """J-08/J-09: every occurrence of each quote in its own text.

    Returns quote_id, key, occurrence, char_offset, char_end, match ('exact',
    'relaxed' where only blanks differ, 'missing', or 'empty' for null or blank
    quotes, which are no discards).  Exact occurrences may overlap; the relaxed
    search runs only if there is none.  Missing and empty quotes keep one row
    with null offsets.  Quotes and texts meet on ``key``, so no pair outside a
    key is formed; a null key is missing.
    """
    q = quotes.select(F.col(quote_id).alias("quote_id"), F.col(key).alias("key"), F.col(quote).cast("string").alias("quote"))
    t = texts.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    blank = F.col("quote").isNull() | ~F.col("quote").rlike(r"[^\s\p{Z}]")
    # quotes of a key travel together, in as many parts as tasks share them; the text goes along once a part
    part = F.pmod(F.xxhash64("quote_id"), F.lit(salts_for(quotes)))
    met = q.where(~blank).groupBy("key", part.alias("part")).agg(F.collect_list(F.struct("quote_id", "quote")).alias("quotes")).join(t, "key", "left")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, quotes_, whole in zip(*(batch.column(c).to_pylist() for c in ("key", "quotes", "text"))):
                ids, nth, lo, hi, how = [], [], [], [], []
                for x in quotes_:
                    hits, kind = _positions(whole or "", x["quote"]), "exact"
                    if not hits:
                        hits, kind = _loose(whole or "", x["quote"]), "relaxed"
                    for n, (a, b) in enumerate(hits or [(None, None)]):
                        ids.append(x["quote_id"]), nth.append(n), lo.append(a), hi.append(b), how.append(kind if hits else "missing")
                kinds = [batch.schema.field("quotes").type.value_type.field("quote_id").type, batch.schema.field("key").type, pa.int32(), pa.int32(), pa.int32(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip((ids, [k] * len(ids), nth, lo, hi, how), kinds)], names=["quote_id", "key", "occurrence", "char_offset", "char_end", "match"])

    columns = [F.col("quote_id"), F.col("key"), F.lit(0).alias("occurrence"), F.lit(None).cast("int").alias("char_offset"), F.lit(None).cast("int").alias("char_end"), F.lit("empty").alias("match")]
    empty = q.where(blank).select(*columns)
    schema = ", ".join(f"{n} {t}" for n, t in empty.dtypes)
    return met.select("key", "quotes", "text").mapInArrow(scan, schema).unionByName(empty)


def nearest_spans(spans: DataFrame, turns: DataFrame) -> DataFrame:
    """W-04: of several occurrences the first inside the hinted turn, else the nearest to its middle.

    ``turns`` has quote_id, char_start, char_end of the hinted turn; without a
    hint the first occurrence is taken.
    """
    hint = turns.select("quote_id", F.col("char_start").alias("h_lo"), F.col("char_end").alias("h_hi"))
    hinted = spans.where("char_offset is not null").join(hint, "quote_id", "left")
    inside = F.col("char_offset").between(F.col("h_lo"), F.col("h_hi") - 1)
    away = F.abs(F.col("char_offset") - F.floor((F.col("h_lo") + F.col("h_hi")) / 2))
    rank = F.struct(F.when(inside, 0).otherwise(1), F.when(inside | F.col("h_lo").isNull(), 0).otherwise(away), F.col("char_offset"))
    return hinted.groupBy("quote_id").agg(F.min_by(F.struct("char_offset", "char_end", F.coalesce(inside, F.lit(False)).alias("inside")), rank).alias("s"), F.count("*").alias("n_occurrences")).select("quote_id", "s.char_offset", "s.char_end", "s.inside", "n_occurrences")


def fidelity(spans: DataFrame) -> DataFrame:
    """A-16/R-01: quotes found, found with other blanks, discarded, empty, and the share found."""
    once = spans.groupBy("quote_id").agg(F.first("match").alias("match"))
    is_ = lambda m: F.count_if(F.col("match") == m)
    found = is_("exact") + is_("relaxed")
    share = F.when(found + is_("missing") > 0, F.round(found / (found + is_("missing")), 6))
    return once.agg(is_("exact").alias("n_exact"), is_("relaxed").alias("n_relaxed"), is_("missing").alias("n_discarded"), is_("empty").alias("n_empty"), share.alias("fidelity"))


def drop_overlaps(spans: DataFrame, group: str, order: str, start: str, end: str) -> DataFrame:
    """W-07: keep a span only if it overlaps no span kept before it, in the given order.

    The greedy fold is order-dependent, so it runs over one sorted array per
    group; spans touching only at their ends don't overlap.
    """
    ordered = spans.where(f"`{start}` is not null and `{end}` is not null").groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col(start).alias("lo"), F.col(end).alias("hi")))).alias("all"))
    kept = F.expr("aggregate(all, cast(array() as array<struct<o:bigint,lo:double,hi:double>>), (acc, x) -> case when exists(acc, k -> x.lo < k.hi and x.hi > k.lo) then acc else concat(acc, array(named_struct('o', cast(x.o as bigint), 'lo', cast(x.lo as double), 'hi', cast(x.hi as double)))) end)")
    return ordered.select(group, F.explode(kept).alias("s")).select(group, F.col("s.o").alias(order), F.col("s.lo").alias(start), F.col("s.hi").alias(end))


#: Words without content of their own.
STOP = "the and for you your that this with are was have has had not but can will would should they them then than from into out our any all who what when where how why its it's".split()


def content_words(text):
    """X-14: distinct stems of words of three letters or more that carry content."""
    words = F.regexp_extract_all(F.lower(text), F.lit(r"([a-z]{3,})"), 1)
    plain = F.filter(words, lambda w: ~w.isin(STOP))
    stem = lambda w: F.when(F.length(w) > 6, F.regexp_replace(w, "ness$", "")).otherwise(w)
    cut = lambda w: F.regexp_replace(stem(w), "(?<=[a-z]{3})(ing|ed|es|s)$", "")
    return F.array_distinct(F.transform(plain, cut))


def merge_restatements(rows: DataFrame, group: str, order: str, text: str, least: int = 3, share: float = 0.7) -> DataFrame:
    """W-08: texts of a group that restate an earlier one merge; the longer stays, in the earlier's place.

    Two texts restate each other if they share at least ``least`` content words
    and ``share`` of the smaller set.
    """
    listed = rows.where(F.col(text).isNotNull()).groupBy(group).agg(F.array_sort(F.collect_list(F.struct(F.col(order).cast("bigint").alias("o"), F.col(text).alias("t"), content_words(F.col(text)).alias("w")))).alias("all"))
    same = "size(array_intersect(k.w, x.w)) >= {l} and size(array_intersect(k.w, x.w)) >= {s} * least(size(k.w), size(x.w))".format(l=least, s=share)
    fold = (
        "aggregate(all, cast(array() as array<struct<o:bigint,t:string,w:array<string>,n:int>>), (acc, x) -> case when exists(acc, k -> " + same + ") then "
        "transform(acc, (k, i) -> case when i = array_position(transform(acc, k -> " + same + "), true) - 1 then "
        "named_struct('o', k.o, 't', case when length(x.t) > length(k.t) then x.t else k.t end, 'w', case when length(x.t) > length(k.t) then x.w else k.w end, 'n', k.n + 1) else k end) "
        "else concat(acc, array(named_struct('o', x.o, 't', x.t, 'w', x.w, 'n', 1))) end)"
    )
    return listed.select(group, F.explode(F.expr(fold)).alias("r")).select(group, F.col("r.o").alias(order), F.col("r.t").alias(text), F.col("r.n").alias("n_merged"))


def only_spans(spans: DataFrame) -> DataFrame:
    """P-27: the place of quotes that occur exactly once, word for word."""
    exact = spans.where("match = 'exact'").groupBy("quote_id").agg(F.count("*").alias("n"), F.min("char_offset").alias("char_offset"), F.min("char_end").alias("char_end"))
    return exact.where("n = 1").drop("n")
