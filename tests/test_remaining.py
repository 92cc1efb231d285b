import json
import random
import zipfile

import pytest
from conftest import rows
from pyspark.sql import functions as F

from spanloom.operators import dewey, rangescan, resolve, review, search, visits, voices
from spanloom.sources import transcripts, vocabulary_files


def test_islands_match_brute_force(spark):
    rng = random.Random(5)
    data = [(f"e{rng.randrange(3)}" if rng.random() < 0.95 else None, k, rng.choice(["a", "b", None]), rng.random()) for k in range(200)]
    want = {}
    for e, k, label, size in data:
        if e is None:
            continue
        runs = want.setdefault(e, [])
        if runs and runs[-1][0] == label:
            runs[-1][2:] = [k, runs[-1][3] + 1, runs[-1][4] + size]
        else:
            runs.append([label, k, k, 1, size])
    df = spark.createDataFrame(data, "e string, k bigint, l string, s double")
    for n in (1, 7):
        got = {(r.e, r.label, r["first"], r["last"], r.n, round(r.total, 6)) for r in rangescan.islands(df, "e", "k", "l", "s", n).collect()}
        assert got == {(e, *r[:4], round(r[4], 6)) for e, rs in want.items() for r in rs}
    assert rangescan.islands(df.where("false"), "e", "k", "l", "s", 2).count() == 0


def test_labels_of_any_fan_out_sort_and_truncate(spark):
    steps = [dewey.step(n) for n in (0, 9, 10, 999_999, 1_000_000, 9_999_999, 10_000_000)]
    assert steps == sorted(steps)
    df = spark.createDataFrame([(f"{steps[1]}.{steps[5]}.{steps[0]}",)], "d string")
    r = df.select(dewey.ancestor(F.col("d"), 1).alias("a"), dewey.ancestor(F.col("d"), 5).alias("b"), dewey.step_number(dewey.ancestor(F.col("d"), 1)).alias("n")).first()
    assert (r.a, r.b, r.n) == (f"{steps[1]}.{steps[5]}", "", 9_999_999)


def test_records_behind_other_brackets():
    assert dewey.read_record('note [] {"a": 1}') == {"a": 1} and dewey.read_record('["a"]') == ["a"] and dewey.read_record("{}") == {}
    assert dewey.read_record('{"a": [1') is None and dewey.read_record("") is None and dewey.read_record("[1, 2] {") == [1, 2]


def test_long_intervals_meet_short_words(spark):
    rng = random.Random(1)
    spans = lambda n, most: [("s", k, a := rng.uniform(0, 20_000), a + rng.choice([0.0, rng.uniform(0, most)])) for k in range(n)]
    w, i = spans(150, 9_000), [*spans(60, 40), *[("s", 100 + k, a, b) for _, k, a, b in spans(8, 15_000)]]
    got = {r.k: (r.interval_id, r.overlap_s) for r in visits.assign_intervals(spark.createDataFrame(w, "session_id string, k int, start_s double, end_s double"), spark.createDataFrame(i, "session_id string, interval_id int, start_s double, end_s double"), ["k"]).collect()}
    for _, k, a, b in w:
        best = min(((-round(min(b, d) - max(a, c), 6), c, n) for _, n, c, d in i if a < d and b > c and b > a and d > c), default=None)
        assert got[k][0] == (best[2] if best else None)


def test_more_clusters_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(voices, "BLOCK_CLUSTERS", 7)
    rng = random.Random(2)
    made = [(k, [rng.uniform(-1, 1) for _ in range(5)]) for k in range(40)]
    c, p = spark.createDataFrame(made, "cluster int, centroid array<double>"), spark.createDataFrame([*made, (99, None)], "id int, v array<double>")
    out = {r.probe_id: r for r in voices.nearest_cluster(p, "id", "v", c).collect()}
    assert all(out[k].cluster == k and out[k].distance == 0 for k in range(40)) and out[99].cluster is None and not out[99].decided
    cos = lambda a, b: 1 - sum(x * y for x, y in zip(a, b)) / (sum(x * x for x in a) * sum(x * x for x in b)) ** 0.5
    assert {(r.a, r.b) for r in voices.close_clusters(c, 0.3).collect()} == {(i, j) for i, a in made for j, b in made if i < j and round(cos(a, b), 6) < 0.3}
    assert [r.cluster for r in voices.nearest_cluster(p, "id", "v", c.where("false")).collect()] == [None] * 41


def test_session_diff_and_stages(spark):
    a = spark.createDataFrame([("s", 0, "one two"), ("s", 1, "three"), ("s", 2, None)], "session_id string, turn_id int, text string")
    b = spark.createDataFrame([("s", 0, "one 2"), ("s", 1, "three"), ("s", 3, "four")], "session_id string, turn_id int, text string")
    assert [tuple(r) for r in visits.session_diff(a, b).collect()] == [("s", 3, 3, 1, 0, 0.5)]
    e = spark.createDataFrame([("g", 1, "consent"), ("g", 2, "recording"), ("g", 3, "consent"), ("h", 1, "recording"), ("h", 2, None)], "g string, o bigint, stage string")
    allowed = {"": ("consent",), "consent": ("recording",)}
    assert rows(visits.illegal_steps(e, "g", "o", "stage", allowed)) == [("g", 3, "recording", "consent"), ("h", 1, "", "recording")]


def test_candidates(spark):
    n = [("1", "IN", "prednisone", "prednisone", "prednisone", "prednisone"), ("2", "IN", "prednisolone", "prednisolone", "prednisolone", "prednisolone"), ("3", "IN", "metoprolol", "metoprolol", "metoprolol", "metoprolol"), ("4", "IN", "water", "water", "water", "water")]
    names = spark.createDataFrame(n, "rxcui string, tty string, str string, key string, salt_key string, base_key string")
    products = spark.createDataFrame([(k, "SCD", k) for k in ("metoprolol", "prednisone", "prednisolone")], "rxcui string, tty string, ingredient_key string")
    asked = ["predisone", "my water pill", "Metoprolol", "the meto, metop, metoprol", "zzz", None, "metoprolol up to 50 milligrams", "preds, predni, predisone"]
    m = spark.createDataFrame(list(enumerate(asked)), "id int, t string")
    out = {r.mention_id: r for r in resolve.resolve_mentions(m, "id", "t", names, products).collect()}
    assert out[0].status == "ambiguous" and {c.name for c in out[0].candidates} == {"prednisone", "prednisolone"}
    assert (out[1].status, [c.name for c in out[1].candidates], out[1].rxcui) == ("unresolved", ["water"], None)
    assert (out[2].status, out[2].match_type) == ("resolved", "case_insensitive")
    assert (out[6].status, out[6].via, out[6].rxcui) == ("resolved", "head", "3")
    assert out[4].candidates == [] and out[5].status == "unresolved"
    assert resolve.resolve_mentions(m.where("false"), "id", "t", names, products).count() == 0


def test_record_quotes_and_choices(spark):
    record = {"medications": [{"mention_quote": {"text": "m"}, "sig": [{"text": "s1"}, {"text": " "}], "change_evidence_quote": "c"}], "summary_quotes": {"open": [{"text": "o"}]}, "notes": {"text": "no"}}
    df = spark.createDataFrame([(1, json.dumps(record)), (1, json.dumps(record)), (2, None)], "id bigint, raw string")
    assert {(r.field, r.quote) for r in review.quotes_of(df, "id", "raw").collect()} == {("mention_quote", "m"), ("sig", "s1"), ("change_evidence_quote", "c"), ("summary_quotes", "o")}
    s = spark.createDataFrame([("a", 0, None, None, "partial", 0.4), ("a", 1, False, False, "parsed", 0.9), ("b", 0, None, True, "parsed", 0.9), ("b", 1, True, None, "unparseable", None), ("c", 0, None, True, "parsed", 0.9), ("c", 1, None, None, "unparseable", None)], "item string, seq int, settled boolean, blocking boolean, status string, parse_confidence double")
    assert rows(review.chosen_sig(s, ["item"], "seq").select("item", "seq")) == [("a", 1), ("b", 1), ("c", 0)]
    r = spark.range(1).select(review.slug(F.lit(" A, b!")).alias("s"), review.merge_target(F.lit("merge_into:x-1")).alias("m"), review.media_fragment(F.lit(1.0), F.lit(2.5)).alias("f")).first()
    assert tuple(r) == ("a-b", "x-1", "#t=1.000,2.500")


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.rrf").write_text("1|ENG|" + "|" * 10 + "IN||x, y|'||N||\n2|SPA|short|\n")
    assert [tuple(r) for r in vocabulary_files.concepts(vocabulary_files.read_rrf(spark, str(tmp_path / "a.rrf"))).collect()] == [("1", "IN", "x, y")]
    line = "|".join(["1", "ENG", *[""] * 10, "IN", "", 'na"me', "", "N", ""]) + "|\n"
    (tmp_path / "b.rrf").write_text(line)
    assert [tuple(r) for r in vocabulary_files.concepts(vocabulary_files.read_rrf(spark, str(tmp_path / "b.rrf"))).collect()] == [("1", "IN", 'na"me')]
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("1.json", json.dumps({"results": [{"set_id": "s", "warnings": ["w1", "w2"]}, {"openfda": {}}]}))
        z.writestr("2.json", "broken")
        z.writestr("3.json", json.dumps({"results": [{"openfda": {"spl_set_id": ["o"], "brand_name": ["b" * 300]}}]}))
    records = vocabulary_files.read_labels(spark, str(tmp_path / "l.zip"))
    label, texts = vocabulary_files.labels(records)
    assert records.where("record is null").count() == 1
    assert {(r.spl_set_id, len(r.brand or "")) for r in label.collect()} == {("s", 0), ("o", 200)} and [tuple(r) for r in texts.collect()] == [("s", "warnings", "w1 w2")]
    with pytest.raises(Exception):
        vocabulary_files.release_of(spark.createDataFrame([("/x/readme.txt",)], "path string")).collect()
    df = spark.createDataFrame([("s", "quote text", "why\tso", None)], "session_id string, quote string, reason string, extra string")
    for _ in range(2):
        transcripts.append_log(df, str(tmp_path / "log"))
    assert [r.value for r in spark.read.text(str(tmp_path / "log")).collect()] == ["s\twhy so\t"] * 2
    transcripts.write_tables({"t": df}, str(tmp_path))
    assert spark.read.parquet(str(tmp_path / "t.parquet")).count() == 1
    (tmp_path / "s.json").write_text(json.dumps({"session_id": "s", "turns": [{"id": 1, "text": "a", "words": []}]}, indent=1))
    assert transcripts.read_sessions(spark, str(tmp_path / "s.json")).first().turns[0].text == "a"
    transcripts.write_envelopes(spark.createDataFrame([(1, "x")], "id int, t string"), str(tmp_path / "env"))
    assert json.loads(spark.read.text(str(tmp_path / "env")).first().value) == {"id": 1, "t": "x"}


def test_stemmed_snippets_stand_on_the_hit(spark):
    filler = "e-mail-and so_on... 12.5 " * 12
    t = spark.createDataFrame([(1, filler + "the Bridges were repaired well."), (2, "a bridge")], "id int, t string")
    found = search.search_words(search.inverted_index(t, "id", "t"), ["bridge", "repairing"])
    assert [r.snippet for r in search.snippets(found, t, "id", "t", 5).collect()] == ["5 the Bridges were repaired"]
    assert search.search_words(search.inverted_index(t, "id", "t"), ["bridges"]).count() == 2
