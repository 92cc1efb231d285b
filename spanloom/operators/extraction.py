"""Extraction envelopes as flat item, mention, ingredient and brand tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.dewey import ancestor, dewey_nodes, once, step_number

_LIST = r"(\.\[\])?"
_CHILD = rf"\.(mention_quote(\.text)?|medication{_LIST}\.(ingredients|brand_names){_LIST}(\.name)?)$"
_FIELD = rf"\.(mention_quote(\.text)?|medication{_LIST}\.rxcui|change_kind)$"
_KEEP = rf"\.kind$|{_CHILD}"


def item_children(records: DataFrame, record_id: str, raw: str, item_kind: str = "medication", outside: str = "discarded") -> DataFrame:
    """Children of every item of ``item_kind``: mention text, ingredients, brands.

    Returns ``(record_id, item, med_ord, child_kind, child_ord, child_text,
    node)``; ``item`` and ``node`` are the Dewey labels of the item and of the
    child, ``med_ord`` is the item's 0-based rank in the record.  Items below a key
    named ``outside`` don't count.  Blank and null values yield no row but keep
    their position.  Unreadable, cut, empty or null records and records without
    items yield nothing; repeated records count once.
    """
    ranked = _ranked_items(once(records, record_id, raw), item_kind, outside)
    return ranked.where("child_kind <> 'kind' and child_text rlike '[^\\\\s\\\\u00A0\\\\u2000-\\\\u200B\\\\u3000]'").select(
        "record_id", "item", "med_ord", "child_kind", "child_ord", "child_text", "node"
    )


def item_table(records: DataFrame, record_id: str, raw: str, item_kind: str = "medication", outside: str = "discarded") -> DataFrame:
    """``(record_id, item, med_ord)``: the items themselves, also those without children, under the rules of ``item_children``."""
    ranked = _ranked_items(once(records, record_id, raw), item_kind, outside)
    return ranked.where("child_kind = 'kind'").select("record_id", "item", "med_ord").distinct()


def _ranked_items(records: DataFrame, item_kind: str, outside: str) -> DataFrame:
    nodes = dewey_nodes(records, "record_id", "raw", keep=_KEEP).where(~F.col("path").rlike(rf"\.{outside}(\.|$)"))
    suffix = F.regexp_extract("path", _CHILD, 0)
    up = F.when(F.col("path").endswith(".kind"), 1).otherwise(F.size(F.split(suffix, r"\.")) - 1)
    listed = F.regexp_extract("path", r"\.(ingredients|brand_names)(\.\[\])", 2) != ""
    position = F.when(F.col("path").endswith(".[].name") & listed, step_number(F.element_at(F.split("dewey", r"\."), -2)).cast("int")).when(listed, F.col("ord")).otherwise(0)
    kind = (
        F.when(F.col("path").endswith(".kind"), "kind")
        .when(suffix.startswith(".mention_quote"), "mention")
        .when(suffix.contains(".ingredients"), "ingredient")
        .otherwise("brand")
    )
    rows = nodes.where("kind = 'string'").select(
        "record_id", ancestor(F.col("dewey"), up).alias("item"), kind.alias("child_kind"), position.alias("child_ord"), F.col("value").alias("child_text"), F.col("dewey").alias("node")
    )
    marks = F.max((F.col("child_kind") == "kind") & (F.col("child_text") == item_kind))
    # both windows share the partitioning by record; a record is one JSON value
    items = rows.withColumn("is_item", marks.over(Window.partitionBy("record_id", "item"))).where("is_item")
    return items.withColumn("med_ord", F.dense_rank().over(Window.partitionBy("record_id").orderBy("item")) - 1)


def item_mentions(records: DataFrame, record_id: str, raw: str, item_kind: str = "medication", outside: str = "discarded") -> DataFrame:
    """The mention of every item of ``item_kind`` with the code and the change that stand beside it.

    Returns ``(record_id, med_ord, mention, rxcui, change_kind)``, in any layout
    and under the rules of ``item_children``; of several codes the first counts.
    """
    nodes = dewey_nodes(once(records, record_id, raw), "record_id", "raw", keep=rf"\.kind$|{_FIELD}").where(~F.col("path").rlike(rf"\.{outside}(\.|$)"))
    suffix = F.regexp_extract("path", _FIELD, 0)
    up = F.when(F.col("path").endswith(".kind"), 1).otherwise(F.size(F.split(suffix, r"\.")) - 1)
    said = F.when(F.col("value").rlike(r"[^\s\u00A0\u2000-\u200B\u3000]"), F.col("value"))
    rows = nodes.where("kind in ('string', 'number')").select("record_id", ancestor(F.col("dewey"), up).alias("item"), suffix.alias("field"), F.col("path").endswith(".kind").alias("is_kind"), "dewey", F.col("kind").alias("type"), "value", said.alias("said")).distinct()
    of = lambda c: F.min_by("said", F.when(c & F.col("said").isNotNull(), F.struct("dewey", "said")))
    mention = F.when(F.col("field").startswith(".mention_quote") & (F.col("type") == "string"), F.col("said"))
    items = rows.groupBy("record_id", "item").agg(
        F.max(F.col("is_kind") & (F.col("type") == "string") & (F.col("value") == item_kind)).alias("is_item"), F.collect_set(mention).alias("mentions"),
        F.trim(of(F.col("field").endswith(".rxcui"))).alias("rxcui"), of((F.col("field") == ".change_kind") & (F.col("type") == "string")).alias("change_kind"),
    ).where("is_item")
    # a record is one JSON value
    ranked = items.withColumn("med_ord", F.row_number().over(Window.partitionBy("record_id").orderBy("item")) - 1)
    return ranked.select("record_id", "med_ord", F.explode("mentions").alias("mention"), "rxcui", "change_kind")


def item_states(records: DataFrame, record_id: str, raw: str, outside: str = "discarded") -> DataFrame:
    """A-13/A-14: per record its items by disposition, its discards, and the categories they carry.

    Read from the nodes of any layout; records without items or discards, and
    unreadable ones, yield no row; repeated records count once.
    """
    nodes = dewey_nodes(once(records, record_id, raw), "record_id", "raw", keep=rf"\.disposition$|\.d16_categor(y|ies){_LIST}$|\.{outside}\.\[\]$")
    away = F.col("path").rlike(rf"\.{outside}(\.|$)")
    flat = nodes.select("record_id", "dewey", away.alias("away"), F.col("path").rlike(r"\.\[\]$").alias("listed"), F.col("path").contains(".d16_").alias("category"), "kind", "value").distinct()
    state = F.when(~F.col("away") & ~F.col("category"), F.col("value"))
    code = F.when(F.col("category") & (F.col("kind") == "number"), F.col("value").cast("double").cast("int"))
    return flat.groupBy("record_id").agg(
        F.count(state).alias("n_items"), F.count_if(state == "blocking").alias("n_blocking"), F.count_if(state == "flagged").alias("n_flagged"), F.count_if(state == "printed_as_fact").alias("n_facts"),
        F.count_if(F.col("away") & ~F.col("category") & (F.col("kind") == "object")).alias("n_discarded"), F.array_join(F.transform(F.array_sort(F.collect_set(code)), lambda c: c.cast("string")), ",").alias("categories"),
    ).where("n_items > 0 or n_discarded > 0")
