from conftest import rows
from spanloom.operators import search


def test_inverted_index_and_snippets(spark):
    t = spark.createDataFrame([(1, "Two bridges, repaired bridges!"), (2, "A bridge"), (3, None), (4, "")], "id int, t string")
    index = search.inverted_index(t, "id", "t")
    found = search.search_all(index, ["bridg", "repair"])
    assert [(r.text_id, r.n_hits, r.first_pos) for r in found.collect()] == [(1, 3, 2)]
    assert [r.snippet for r in search.snippets(found, t, "id", "t", 2).collect()] == ["Two bridges,"]
    assert search.search_all(index.where("false"), ["x"]).count() == 0


def test_labels_by_set_id_own_first_and_once(spark):
    m = spark.createDataFrame([(1, ["b", "a"], ["a", "c"]), (2, None, ["c"]), (3, None, None)], "mention_id int, own_ids array<string>, product_ids array<string>")
    labels = spark.createDataFrame([("a", "A"), ("b", "B"), ("c", "C")], "spl_set_id string, brand string")
    assert rows(search.labels_of(m, labels, most=2).select("mention_id", "pos", "brand")) == [(1, 0, "B"), (1, 1, "A"), (2, 0, "C")]
