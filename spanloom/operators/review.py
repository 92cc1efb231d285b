"""Reading extraction records for review: quotes by field, choices, orders and edits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.dewey import ancestor, dewey_nodes, once

#: The fields of a record that hold quotes.
QUOTE_FIELDS = (
    "mention_quote", "context_quote", "sig_quote", "sig", "change_evidence_quote", "phrase_quote", "purpose_quote", "instruction_quote", "topic_quote", "summary_quotes", "quote",
)


def quotes_of(records: DataFrame, record_id: str, raw: str) -> DataFrame:
    """P-15: every quote of a record with the field it stands in: ``(record_id, node, field, quote)``.

    A field holds its quote as a string or as an object with ``text``, alone or in
    a list or map; blank quotes yield no row; repeated records count once.
    """
    fields = "|".join(QUOTE_FIELDS)
    nodes = dewey_nodes(once(records, record_id, raw), "record_id", "raw", keep=rf"\.({fields})(\.[a-z_{{}}\[\]]+)*$").where("kind = 'string'")
    shape = rf"\.({fields})((\.(\[\]|\{{\}}|[a-z_]+))*?)(\.text)?$"
    told = nodes.withColumn("field", F.regexp_extract("path", shape, 1)).withColumn("inner", F.regexp_extract("path", shape, 2))
    told = told.where((F.col("field") != "") & (F.col("path").endswith(".text") | F.col("inner").rlike(r"^(\.\[\])?$")))
    return told.where(F.trim("value") != "").select("record_id", F.col("dewey").alias("node"), "field", F.col("value").alias("quote"))


def latest_edits(edits: DataFrame, keys: list[str], order: str) -> DataFrame:
    """P-25: of every key the edit written last; ties go to the greater row."""
    rest = [c for c in edits.columns if c not in keys]
    return edits.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(order, *[c for c in rest if c != order])).alias("e")).select(*keys, "e.*")


def review_order(disposition: Column, expanded: Column) -> Column:
    """T-07: rank in review: blocking items, then expanded ones, then the rest."""
    return F.when(disposition == "blocking", 0).when(F.coalesce(expanded, F.lit(False)), 1).otherwise(2)


def chosen_sig(sigs: DataFrame, keys: list[str], order: str) -> DataFrame:
    """T-09: of an item's instructions the settled one, else the most confident that is read and blocks nothing, else the first.

    ``sigs`` has ``settled`` and ``blocking`` (boolean, null is false), ``status``
    and ``parse_confidence``.
    """
    usable = ~F.coalesce("blocking", F.lit(False)) & F.col("status").isin("parsed", "partial")
    rank = F.struct(F.when(F.coalesce("settled", F.lit(False)), 0).when(usable, 1).otherwise(2), F.when(usable, -F.coalesce("parse_confidence", F.lit(0.0))).otherwise(0.0), F.col(order))
    rest = [c for c in sigs.columns if c not in keys]
    return sigs.groupBy(*keys).agg(F.min_by(F.struct(*rest), rank).alias("s")).select(*keys, "s.*")


def slug(text: Column) -> Column:
    """X-15: lower-case words of letters and digits joined by hyphens."""
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def media_fragment(start: Column, end: Column) -> Column:
    """P-24: the part of a recording as a fragment of its address, in seconds of three decimals."""
    return F.format_string("#t=%.3f,%.3f", start, end)


def still_there(text: Column, char_offset: Column, quote: Column) -> Column:
    """F-11: whether a stored span still is the slice of its transcript."""
    return F.coalesce(F.substring(text, char_offset + 1, F.length(quote)) == quote, F.lit(False))


def merge_target(hint: Column) -> Column:
    """J-24: the item that a hint ``merge_into:<id>`` names, else null."""
    return F.nullif(F.regexp_extract(hint, "^merge_into:(.+)$", 1), F.lit(""))


def override_roles(speakers: DataFrame, chosen: DataFrame) -> DataFrame:
    """R-19: ``speakers`` (session_id, speaker) with a role: clinician for the session's ``chosen`` speaker, other for the rest."""
    return speakers.join(chosen.select("session_id", "chosen"), "session_id").withColumn("role", F.when(F.col("speaker") == F.col("chosen"), "clinician").otherwise("other")).drop("chosen")


def short_title(text: Column, words: int = 8) -> Column:
    """X-19: the first words of a text, with an ellipsis if it goes on."""
    ws = F.filter(F.split(F.trim(text), r"\s+"), lambda w: w != "")
    return F.concat(F.array_join(F.slice(ws, 1, words), " "), F.when(F.size(ws) > words, "…").otherwise(""))


def amount_text(amount: Column, unit: Column) -> Column:
    """X-18: an amount with its unit, in six significant figures without trailing zeros; for amounts from 0.0001 to below a million."""
    scale = F.pow(F.lit(10.0), 5 - F.floor(F.log10(F.abs(amount))))
    plain = F.format_string("%.10f", F.when(amount == 0, F.lit(0.0)).otherwise(F.round(amount * scale) / scale))
    return F.concat_ws(" ", F.regexp_replace(F.regexp_replace(plain, r"(\.\d*?)0+$", "$1"), r"\.$", ""), unit)
