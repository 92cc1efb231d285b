import pytest

from spanloom.llm.canonical import deletions, edit_distance, map_to_reference, tokens
from spanloom.llm.mixture import TOKENIZER, count_tokens, mix_sources, shuffled_copies, thresholds

tiktoken = pytest.importorskip("tiktoken")


def test_mixture_meets_shares_and_caps(spark):
    docs = [(i, [" A ", "a", "b", "B", "c", None][i % 6], f"text number {i} " * (1 + i % 7), 0) for i in range(3000)] + [(None, "a", "x", 0), (9001, "a", None, 0), (9002, "b", "", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, source string, text string, u int")
    t = spark.createDataFrame([("a", 0.5, 2), ("b", 0.3, 3), ("c", 0.1, 1), ("none", 0.1, 4), ("A", 0.5, 2), ("zero", None, 1)], "source string, target_share double, max_repeats int")
    m = mix_sources(d, "doc_id", "source", "text", t)
    shares = {r.source: r for r in m.shares.collect()}
    assert shares["none"].unreachable and shares["none"].actual_share == 0
    for s, target in (("a", 0.5), ("b", 0.3), ("c", 0.1)):
        assert abs(shares[s].actual_share - target / 0.9) < 0.01 and shares[s].most_repeats <= shares[s].max_repeats
    copies = shuffled_copies(m.repeats).toPandas()
    assert len(copies) == sum(r.n_copies for r in shares.values()) and copies.position.is_monotonic_increasing
    assert copies.duplicated(["doc_id", "copy_no"]).sum() == 0 and set(copies.source) <= {"a", "b", "c"}
    again = mix_sources(d.repartition(7), "doc_id", "source", "text", t)
    assert sorted(map(tuple, again.repeats.collect())) == sorted(map(tuple, m.repeats.collect()))
    assert mix_sources(d.where("false"), "doc_id", "source", "text", t).repeats.count() == 0


def test_tokens_round_trip(spark):
    from spanloom.llm.mixture import _encoding

    e = _encoding(TOKENIZER)
    texts = ["Hello, wörld! 12\n\n  x", "<|endoftext|>", ""]
    assert [e.decode(e.encode_ordinary(t)) for t in texts] == texts
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, None])], "id int, t string")
    assert [r.n_tokens for r in count_tokens(df, "t").orderBy("id").collect()] == [*(len(e.encode_ordinary(t)) for t in texts), 0]
    assert thresholds(float("inf"), 3) == [0, 0, 0] and thresholds(0.0, 2) == [1.0, 1.0]


def test_canonical(spark):
    ref = [("1", "clogibriium"), ("2", "clogibriium sr"), ("3", "bralatreovol citrate"), ("4", "bralatreovol"), ("5", "zadexoique"), ("5", "zadexoique"), (None, "x"), ("7", None)]
    r = spark.createDataFrame([(*x, 0) for x in ref], "rxcui string, key string, score int")
    cases = {
        "Clogibriium": "1", "  the CLOGYBRIIUM SR 5mg": "2", "clogib riium": "1", "cologibriium tabs": "1", "clog-ibriium": "1", "Citrate Bralatreovol": "3", "bralatreovol hcl": "4", "bralatreovoI": "4",
        "ZADEKSOIQUE": "5", "zade0xique (!)": "5", "eye drops": "", "the one for sleep": "", "???": "", "çlogibriium": "1", "x" * 20_000: "", "clogibriium " + "tab " * 5000: "1",
    }
    rows = [(i, t, 0) for i, t in enumerate(cases)] + [(0, next(iter(cases)), 0), (90, None, 0), (91, "   ", 0)]
    df = spark.createDataFrame(rows, "entry_id bigint, name string, code int")
    out = {x.entry_id: x.code for x in map_to_reference(df, "entry_id", "name", r, "key", "rxcui").collect()}
    assert out == {i: c for i, c in enumerate(cases.values())}
    assert {x.code for x in map_to_reference(df, "entry_id", "name", r.where("false"), "key", "rxcui").collect()} == {""}
    assert edit_distance("abcd", "abdc", 2) == 1 and edit_distance("a", "abcd", 2) == 3 and "ac" in deletions("abc", 1)
    assert tokens("Rx: H1cloquexone-HCl 50mg") == ["rx", "hicloquexone", "hydrochloride"]
