"""Merging mentions, regimes and dated events across turns."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def merge_mentions(mentions: DataFrame) -> DataFrame:
    """J-19/W-06: mentions of one concept in a session become one item; the first survives.

    ``mentions`` has session_id, seq, rxcui, mention, change_kind.  Unresolved
    mentions merge by their lower-case text.  The last change other than
    'continued' counts, else the first stated.
    """
    key = F.coalesce("rxcui", F.concat(F.lit("unresolved:"), F.lower(F.trim("mention"))))
    return mentions.where("mention is not null").groupBy("session_id", key.alias("item_key")).agg(
        F.min("seq").alias("first_seq"), F.count("*").alias("n_mentions"), F.min_by("mention", "seq").alias("mention"),
        F.coalesce(F.max_by("change_kind", F.when((F.col("change_kind") != "continued") & F.col("change_kind").isNotNull(), F.col("seq"))), F.min_by("change_kind", F.when(F.col("change_kind").isNotNull(), F.col("seq")))).alias("change_kind"),
    )


def regimes(doses: DataFrame, by: list[str]) -> DataFrame:
    """A-11/A-12: how many different regimes a group states, and how the dose moved from first to last.

    ``doses`` has the keys, seq, amount, unit, frequency.  A missing field is
    part of a regime, so "10 mg" and "10 mg daily" differ.  The direction is
    told only within one unit.
    """
    stated = doses.where("amount is not null or frequency is not null")
    regime = F.to_json(F.struct(F.coalesce(F.col("amount").cast("string"), F.lit("-")).alias("a"), F.coalesce("unit", F.lit("-")).alias("u"), F.coalesce(F.col("frequency").cast("string"), F.lit("-")).alias("f")))
    whole = F.col("amount").isNotNull() & F.col("unit").isNotNull()
    one_unit = F.count_distinct(F.when(whole, F.col("unit"))) == 1
    first, last = F.min_by("amount", F.when(whole, F.col("seq"))), F.max_by("amount", F.when(whole, F.col("seq")))
    kind = F.when(~one_unit | first.isNull(), F.lit(None).cast("string")).when(last > first, "increased").when(last < first, "decreased").otherwise("unchanged")
    return stated.groupBy(*by).agg(F.count("*").alias("n_stated"), F.count_distinct(regime).alias("n_regimes"), kind.alias("direction"))


def merge_events(events: DataFrame, day: str, kind: str, rank: list, detail: str) -> DataFrame:
    """U-06/T-08: events of one session, day and kind merge; undated ones never do.

    The best-ranked survives; the first non-null detail by rank is donated to it.
    ``events`` has session_id, event_id.
    """
    undated = F.when(F.col(day).isNull(), F.col("event_id"))
    order = F.struct(*rank, F.col("event_id"))
    return events.groupBy("session_id", F.col(day), F.col(kind), undated.alias("_u")).agg(
        F.min_by("event_id", order).alias("event_id"), F.count("*").alias("n_merged"), F.min_by(detail, F.when(F.col(detail).isNotNull(), order)).alias(detail)
    ).drop("_u")


def top_spans(quotes: DataFrame, headings: tuple[str, ...], most: int = 3) -> DataFrame:
    """T-06/U-05: distinct spans across headings (in the headings' order), the first ``most`` of each by offset."""
    place = F.coalesce(*(F.when(F.col("heading") == h, i) for i, h in enumerate(headings)), F.lit(len(headings)))
    once = quotes.groupBy("session_id", "char_offset", "char_end").agg(F.min_by("heading", place).alias("heading"))
    order = Window.partitionBy("session_id", "heading").orderBy("char_offset", "char_end")
    return once.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)


def misattributed(quotes: DataFrame, named: DataFrame, most: int = 2) -> DataFrame:
    """J-20: quotes that may belong to another item than the one they are attached to.

    ``quotes`` has session_id, quote_id, item, turn_id (of the quote) and
    mention_turn; ``named`` the distinct (session_id, turn_id, item) of items
    named in turns.  A quote in its mention's turn, or in a turn that names its
    item, is never one; else it is if more than ``most`` turns away, or if
    another item is named strictly between.  Only near quotes look between, so
    each meets at most ``most - 1`` turns by equality.
    """
    own = named.select("session_id", "turn_id", "item").distinct()
    away = quotes.where("turn_id <> mention_turn").join(own, ["session_id", "turn_id", "item"], "left_anti").withColumn("gap", F.abs(F.col("turn_id") - F.col("mention_turn")))
    near = away.where((F.col("gap") > 1) & (F.col("gap") <= most)).withColumn("between", F.explode(F.sequence(F.least("turn_id", "mention_turn") + 1, F.greatest("turn_id", "mention_turn") - 1)))
    other = near.join(own.select("session_id", F.col("turn_id").alias("between"), F.col("item").alias("rival")), ["session_id", "between"]).where("rival <> item")
    rivals = other.groupBy("session_id", "quote_id").agg(F.min(F.struct("between", "rival")).alias("r"))
    judged = away.join(rivals, ["session_id", "quote_id"], "left").where((F.col("gap") > most) | F.col("r").isNotNull())
    return judged.select("session_id", "quote_id", "item", "gap", F.coalesce("r.rival", F.lit("")).alias("rival"))
