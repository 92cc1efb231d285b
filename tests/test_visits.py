from pyspark.sql import functions as F

from conftest import rows
from spanloom.operators import mentions, spans, visits, vocabulary, voices
from spanloom.operators.resolve import resolve_mentions
from spanloom.sources import transcripts, vocabulary_files
from spanloom.streaming.retention import sweep, sweep_stream


def test_intervals_largest_overlap_ties_and_none(spark):
    p = spark.createDataFrame([("s", 1, 0.0, 2.0), ("s", 2, 2.0, 6.0), ("s", 3, 50.0, 51.0), ("s", 4, 1.0, 1.0), ("s", 5, None, 2.0), ("s", 6, 58.0, 62.0), ("t", 1, 0.0, 1.0)], "session_id string, word_idx int, start_s double, end_s double")
    i = spark.createDataFrame([("s", 10, 0.0, 4.0), ("s", 11, 4.0, 8.0), ("s", 12, 55.0, 70.0)], "session_id string, interval_id int, start_s double, end_s double")
    out = {(r.session_id, r.word_idx): r.interval_id for r in visits.assign_intervals(p, i, ["word_idx"]).collect()}
    assert out == {("s", 1): 10, ("s", 2): 10, ("s", 3): None, ("s", 4): None, ("s", 5): None, ("s", 6): 12, ("t", 1): None}
    assert visits.assign_intervals(p.where("false"), i, ["word_idx"]).count() == 0
    wide = spark.createDataFrame([("s", 13, 0.0, 9e9), ("s", 14, float("nan"), float("inf"))], i.schema)
    assert {r.word_idx: r.interval_id for r in visits.assign_intervals(p.where("session_id = 's'"), wide, ["word_idx"]).collect()} == {1: 13, 2: 13, 3: 13, 4: None, 5: None, 6: 13}


def test_turns_and_offsets(spark):
    w = spark.createDataFrame([("s", 0, "a", "hello"), ("s", 1, "a", "you"), ("s", 2, "b", "yes"), ("s", 3, None, "so"), ("s", 4, "a", "on")], "session_id string, word_idx int, who string, text string")
    assert rows(visits.build_turns(w, F.col("who")).select("turn_no", "label", "n_words", "char_start", "char_end")) == [(0, "a", 2, 0, 9), (1, "b", 1, 10, 13), (2, None, 1, 14, 16), (3, "a", 1, 17, 19)]
    t = spark.createDataFrame([("s", 4, "ab", 0), ("s", 9, "cdé", 3), ("s", 12, "x", 9)], "session_id string, turn_id int, text string, char_start int")
    assert rows(visits.turn_offsets(t)) == [("s", 4, 0, 2, True), ("s", 9, 3, 6, True), ("s", 12, 7, 8, False)]


def test_turn_at_gap_and_end(spark):
    t = spark.createDataFrame([("s", 1, 0, 4), ("s", 2, 5, 9)], "session_id string, turn_id int, char_start int, char_end int")
    p = spark.createDataFrame([("s", i, o) for i, o in enumerate((-1, 0, 3, 4, 5, 20))], "session_id string, probe_id int, char_offset int")
    assert [(r.char_offset, r.turn_id, r.inside) for r in visits.turn_at(p, t).orderBy("char_offset").collect()] == [(-1, 1, False), (0, 1, True), (3, 1, True), (4, 2, False), (5, 2, True), (20, 2, False)]


def test_spans(spark):
    q = spark.createDataFrame([(1, "s", "aa"), (2, "s", "b  c"), (3, "s", "zz"), (4, "s", " "), (5, None, "aa"), (6, "s", None)], "id int, k string, q string")
    t = spark.createDataFrame([("s", "aaa b c aa")], "k string, text string")
    found = spans.find_spans(q, t, "id", "k", "q", "text")
    assert rows(found.select("quote_id", "char_offset", "match").where("quote_id < 3")) == [(1, 0, "exact"), (1, 1, "exact"), (1, 8, "exact"), (2, 4, "relaxed")]
    f = spans.fidelity(found).first()
    assert (f.n_exact, f.n_relaxed, f.n_discarded, f.n_empty) == (1, 1, 2, 2)
    hint = spark.createDataFrame([(1, 7, 10)], "quote_id int, char_start int, char_end int")
    assert {r.quote_id: r.char_offset for r in spans.nearest_spans(found, hint).collect()} == {1: 8, 2: 4}


def test_greedy_folds(spark):
    s = spark.createDataFrame([("s", 1, 0.0, 5.0), ("s", 2, 4.0, 9.0), ("s", 3, 5.0, 7.0), ("s", 4, None, 7.0)], "g string, o bigint, lo double, hi double")
    assert [r.o for r in spans.drop_overlaps(s, "g", "o", "lo", "hi").orderBy("o").collect()] == [1, 3]
    t = spark.createDataFrame([("s", 1, "call the clinic about swelling ankles"), ("s", 2, "please call the clinic promptly about any swelling ankles today"), ("s", 3, "bring water")], "g string, o bigint, t string")
    assert [(r.o, r.n_merged) for r in spans.merge_restatements(t, "g", "o", "t").orderBy("o").collect()] == [(1, 2), (3, 1)]


def test_mentions_and_events(spark):
    m = spark.createDataFrame([("s", 1, "7", "Ab", "continued"), ("s", 2, "7", "ab", "started"), ("s", 3, None, "Zz", None), ("s", 4, None, "zz ", "stopped")], "session_id string, seq int, rxcui string, mention string, change_kind string")
    assert rows(mentions.merge_mentions(m).select("item_key", "n_mentions", "mention", "change_kind")) == [("7", 2, "Ab", "started"), ("unresolved:zz", 2, "Zz", "stopped")]
    d = spark.createDataFrame([("s", 1, 10.0, "mg", 1.0), ("s", 2, 20.0, "mg", None), ("t", 1, None, None, None)], "g string, seq int, amount double, unit string, frequency double")
    assert rows(mentions.regimes(d, ["g"])) == [("s", 2, 2, "increased")]
    e = spark.createDataFrame([("s", 1, "d", "k", None), ("s", 2, "d", "k", "x"), ("s", 3, None, "k", "y"), ("s", 4, None, "k", None)], "session_id string, event_id int, day string, kind string, detail string")
    assert sorted((r.event_id, r.n_merged, r.detail) for r in mentions.merge_events(e, "day", "kind", [], "detail").collect()) == [(1, 2, "x"), (3, 1, "y"), (4, 1, None)]


def test_voices(spark):
    c = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 0.0])], "cluster int, centroid array<double>")
    p = spark.createDataFrame([(1, [1.0, 0.1]), (2, [1.0, 1.0]), (3, [0.0, 0.0])], "id int, v array<double>")
    assert {r.probe_id: (r.cluster, r.decided) for r in voices.nearest_cluster(p, "id", "v", c).collect()} == {1: (0, True), 2: (0, False), 3: (0, False)}


def test_script_and_reading(spark):
    lines = ["# Title", "**DR:** not yet", "## Script", "**DR:** Hello “you”", "there *(nods)* again", "", "lost line", "**PT:** Fine", "## Notes", "**DR:** no"]
    df = spark.createDataFrame([("s", i, x) for i, x in enumerate(lines)], "session_id string, line_no int, raw string")
    assert rows(transcripts.parse_script(df).select("turn_id", "role", "text")) == [(0, "clinician", 'Hello "you" there again'), (1, "other", "Fine")]
    r = spark.createDataFrame([('{"a":1}',), ('x {"a":1} y',), ('{"a":',), (" ",), (None,)], "t string")
    assert [x.reading for x in transcripts.parse_output(r, "t").collect()] == ["whole", "salvaged", "malformed", "empty", "empty"]


def test_vocabulary_files(spark, tmp_path):
    import json
    import zipfile

    row = ["1", "ENG", *[""] * 10, "IN", "", "alpha", "", "N", ""]
    (tmp_path / "c.rrf").write_text("|".join(row) + "|\n" + "|".join(["2", "SPA", *row[2:]]) + "|\n1|ENG|\n")
    assert rows(vocabulary_files.concepts(vocabulary_files.read_rrf(spark, str(tmp_path / "c.rrf")))) == [("1", "IN", "alpha")]
    with zipfile.ZipFile(tmp_path / "l.zip", "w") as z:
        z.writestr("a.json", json.dumps({"results": [{"set_id": "x", "openfda": {"brand_name": ["A", "B"]}, "warnings": ["w1", "w2"]}]}))
        z.writestr("b.json", json.dumps({"results": [{"openfda": {"spl_set_id": ["y"], "rxcui": ["1"]}}, {"warnings": ["none"]}]}))
    label, texts = vocabulary_files.labels(vocabulary_files.read_labels(spark, str(tmp_path / "l.zip")))
    assert rows(label.select("spl_set_id", "brand", "has_rxcui")) == [("x", "A; B", False), ("y", None, True)]
    assert rows(texts) == [("x", "warnings", "w1 w2")]


def test_resolver(spark):
    names = [("6", "IN", "metoprolol"), ("7", "PIN", "metoprolol succinate"), ("1", "IN", "lisinopril"), ("2", "IN", "prednisone"), ("3", "IN", "prednisolone"), ("4", "IN", "water"), ("5", "BN", "Toprol XL")]
    from spanloom.functions.names import name_key

    n = spark.createDataFrame([(r, t, s, *name_key(s)[:3]) for r, t, s in names], "rxcui string, tty string, str string, key string, salt_key string, base_key string")
    p = spark.createDataFrame([(str(i), "SCD", k) for i, k in enumerate(("metoprolol", "prednisone", "prednisolone"))], "rxcui string, tty string, ingredient_key string")
    typed = ["metoprolol", "Metropolol", "the metoprolol up to 50 milligrams", "predisone", "water pill", "zzyzx", "", None, "toprol"]
    m = spark.createDataFrame(list(enumerate(typed)), "id int, t string")
    out = {r.mention_id: (r.status, r.rxcui, r.via) for r in resolve_mentions(m, "id", "t", n, p).collect()}
    assert out[0] == ("resolved", "6", "whole") and out[1] == ("resolved", "6", "whole") and out[2] == ("resolved", "6", "head")
    assert out[3][0] == "ambiguous" and out[4][:2] == ("unresolved", None) and out[8] == ("resolved", "5", "whole")
    assert all(out[i][0] == "unresolved" for i in (5, 6, 7))


def test_retention_batch_and_stream(spark, tmp_path):
    f = spark.createDataFrame([("a", "2031-01-01 00:00:00", True), ("b", "2031-01-01 00:00:00", None), ("c", "2031-01-01 23:59:00", False), ("d", None, None)], "path string, m string, keep boolean").withColumn("m", F.to_timestamp("m"))
    assert {r.path: r.state for r in sweep(f, "path", "m", F.to_timestamp(F.lit("2031-01-02 00:00:00")), F.col("keep")).collect()} == {"a": "kept", "b": "removed", "c": "young", "d": "unknown"}
    f.where("m is not null").withColumn("seen", F.to_timestamp(F.lit("2031-01-02 00:10:00"))).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("path string, m timestamp, keep boolean, seen timestamp").parquet(str(tmp_path / "in"))
    q = sweep_stream(stream, "path", "m", "seen", F.col("keep")).writeStream.outputMode("complete").format("memory").queryName("swept").start()
    q.processAllAvailable()
    q.stop()
    assert {r.state: r.n_folders for r in spark.table("swept").collect()} == {"kept": 1, "removed": 1, "young": 1}


def test_salts_and_canonical(spark):
    n = spark.createDataFrame([("1", "IN", "alpha", "alpha", "alpha"), ("2", "PIN", "alpha citrate", "alpha citrate", "alpha"), ("3", "PIN", "alpha sodium", "alpha sodium", "alpha"), ("4", "PIN", "beta sodium", "beta sodium", "beta")], "rxcui string, tty string, str string, key string, salt_key string")
    p = spark.createDataFrame([("alpha citrate",), ("alpha sodium",)], "ingredient_full_key string")
    assert rows(vocabulary.salt_pairs(n, p).select("pin_name")) == [("alpha citrate",), ("alpha sodium",)]
    assert vocabulary.canonical_names(n).where("rxcui = '1'").first().canonical_name == "alpha"


def test_registered_functions(spark):
    from spanloom.functions.register import register

    register(spark)
    r = spark.sql("select normalize_name('The Alpha ER').base_key a, jaro_winkler('ab','ab') b, double_metaphone('metoprolol')[0] c, parse_sig('50 mg daily').status d, resolve_date('tomorrow', date'2031-01-01').resolved_date e, find_span('éab','ab') f, find_span('x','y') g").first()
    assert (r.a, r.b, r.c, r.d, str(r.e), r.f, r.g) == ("alpha", 1.0, "MTPRLL", "parsed", "2031-01-02", 1, None)


def test_context(spark):
    t = spark.createDataFrame([("s", i) for i in (1, 4, 6, 9)] + [("t", 3)], "session_id string, turn_id int")
    assert rows(visits.context_window(t, 1)) == [("s", 1, "1,4"), ("s", 4, "1,4,6"), ("s", 6, "4,6,9"), ("s", 9, "6,9"), ("t", 3, "3")]


def test_misattribution(spark):
    q = spark.createDataFrame([("s", i, "x", t, 1) for i, t in enumerate((1, 2, 3, 4, 6))] + [("t", 9, "x", 3, 1)], "session_id string, quote_id int, item string, turn_id int, mention_turn int")
    n = spark.createDataFrame([("s", 1, "x"), ("s", 2, "y"), ("s", 4, "x"), ("t", 1, "x")], "session_id string, turn_id int, item string")
    assert rows(mentions.misattributed(q, n)) == [("s", 2, "x", 2, "y"), ("s", 4, "x", 5, "")]


def test_names_nothing(spark):
    from spanloom.functions.names import names_nothing

    df = spark.createDataFrame([("Five hundred. Still on it",), ("water pill",), ("",), (None,), ("a 5",)], "t string")
    assert [r.n for r in df.select(names_nothing(F.col("t")).alias("n")).collect()] == [True, False, True, True, True]


def test_cues(spark):
    w = spark.createDataFrame([("s", "ab", 0, 1.0, 1.4, 0.9), ("s", "cd", 3, 2.0, 2.5, 0.2), ("s", "ef", 6, 3.0, 9.0, None)], "session_id string, text string, char_offset int, start_s double, end_s double, probability double")
    q = spark.createDataFrame([("s", 1, 0, 8), ("s", 2, 20, 30)], "session_id string, quote_id int, char_offset int, char_end int")
    assert rows(visits.word_cue(q, w).select("quote_id", "cue_start_s", "cue_end_s")) == [(1, 1.65, 4.5), (2, None, None)]
