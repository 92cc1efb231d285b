import json

from spanloom.operators.dewey import dewey_nodes, read_record
from spanloom.operators.extraction import item_children, item_states

SCHEMA = "extraction_id bigint, raw_json string, kind string, path string"


def med(**kw):
    return {"kind": "medication", "mention_quote": {"text": "m"}, "medication": {"ingredients": ["i"], "brand_names": []}} | kw


def found(spark, *records):
    df = spark.createDataFrame([(i, r if r is None or isinstance(r, str) else json.dumps(r), "k", "p") for i, r in enumerate(records)], SCHEMA)
    out = item_children(df, "extraction_id", "raw_json").select("record_id", "med_ord", "child_kind", "child_ord", "child_text")
    return sorted(tuple(r) for r in out.collect())


def test_layouts_agree(spark):
    want = [(0, 0, "ingredient", 0, "i"), (0, 0, "mention", 0, "m")]
    inner = {"medications": [med()]}
    for record in (
        inner, [inner], {"envelope": inner}, {"payload": json.dumps(inner)}, {"medications": {"med-x-0": med()}}, {"sections": [{"items": [med()]}]},
        {"medications": [med(mention_quote="m")]}, {"medications": [{"kind": "medication", "mentionQuote": {"text": "m"}, "medication": [{"ingredients": "i"}]}]},
        f"OUTPUT >> {json.dumps(inner)}\n```\nDone.", "﻿" + json.dumps(inner), {"medications": [med(medication={"ingredients": [{"name": "i", "rank": 1}], "brandNames": None})]},
    ):
        assert found(spark, record) == want, record


def test_positions_survive_nulls_and_blanks(spark):
    record = {"medications": [med(medication={"ingredients": [None, "a", "  ", {"name": "b"}], "brand_names": "One"}), med(mention_quote=None)], "discarded": [med()]}
    assert found(spark, record) == [
        (0, 0, "brand", 0, "One"), (0, 0, "ingredient", 1, "a"), (0, 0, "ingredient", 3, "b"), (0, 0, "mention", 0, "m"), (0, 1, "ingredient", 0, "i"),
    ]


def test_incomplete_records_yield_nothing(spark):
    whole = json.dumps({"medications": [med(), med()]})
    assert found(spark, None, "", "no json", "{", whole[:-1], whole[: len(whole) // 2], json.dumps({"payload": whole[:-3]}), "null") == []
    assert read_record("[1, 2") is None


def test_candidates_are_not_own_names(spark):
    record = {"medications": [med(medication={"ingredients": [], "candidates": [{"name": "x", "ingredients": ["y"]}]})]}
    assert found(spark, record) == [(0, 0, "mention", 0, "m")]


def test_labels_truncate_to_parents_and_follow_document_order(spark):
    df = spark.createDataFrame([(1, json.dumps({"a": [{"b": 1}, {"b": [True, None]}]}), "", "")], SCHEMA)
    nodes = {r.dewey: r for r in dewey_nodes(df, "extraction_id", "raw_json").collect()}
    assert all(d == "" or d[:-7].rstrip(".") in nodes for d in nodes)
    assert [nodes[d].path for d in sorted(nodes)] == ["$", "$.a", "$.a.[]", "$.a.[].b", "$.a.[]", "$.a.[].b", "$.a.[].b.[]", "$.a.[].b.[]"]


def test_empty_and_deep(spark):
    assert found(spark) == []
    deep = '{"a":' * 300 + '{"medications": [{"kind": "medication", "mention_quote": "d"}]}' + "}" * 300
    assert found(spark, deep) == [(0, 0, "mention", 0, "d")]


def test_item_states(spark):
    record = {"medications": [{"kind": "medication", "disposition": "blocking", "d16Categories": [7, 2]}, {"kind": "medication", "disposition": "flagged", "d16_categories": []}], "discarded": [{"d16_category": 1, "kind": "medication"}]}
    df = spark.createDataFrame([(1, json.dumps(record), "", ""), (1, json.dumps(record), "", ""), (2, "{}", "", ""), (3, None, "", "")], SCHEMA)
    assert [tuple(r) for r in item_states(df, "extraction_id", "raw_json").collect()] == [(1, 2, 1, 1, 0, 1, "1,2,7")]
