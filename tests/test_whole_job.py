"""Registered queries do the whole job: cases past the cuts they once had."""

import json
from datetime import datetime

import duckdb

from oracle import table
from spanloom.plans.reference import ORACLES, QUERIES

AT = datetime(2031, 5, 27)
TURNS = "session_id string, turn_id int, role string, text string, char_start int, char_end int, received_at timestamp"


def _write(spark, folder, name, rows, schema):
    spark.createDataFrame(rows, schema).write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def _turns(spark, folder, *said):
    """Turns of one session from (role, text)."""
    rows, at = [], 0
    for k, (role, text) in enumerate(said):
        rows.append(("s", k, role, text, at, at + len(text), AT))
        at += len(text) + 1
    _write(spark, folder, "turns", rows, TURNS)


def test_least_probability_of_the_whole_turn(spark, tmp_path):
    text = "please take the blue tablets after breakfast and rigesumil at night"
    _turns(spark, tmp_path, ("clinician", text))
    words, at = [], 0
    for k, w in enumerate(text.split()):
        words.append(("s", 0, k, w, at, float(k), 0.31 if w == "rigesumil" else 0.9, AT))
        at += len(w) + 1
    _write(spark, tmp_path, "words", words, "session_id string, turn_id int, word_idx int, text string, char_offset int, start_s double, probability double, received_at timestamp")
    r = QUERIES["turn_min_probability"](spark, str(tmp_path)).first()
    assert (r.audio_start, r.min_probability) == (0.0, 0.31)


def test_doses_and_dates_in_any_words_of_the_grammars(spark, tmp_path):
    said = ["keep taking the pacleriamil twice a day for now", "two puffs if needed", "use it prn", "how is the garden", "the mg is on the box"]
    _turns(spark, tmp_path, *(("clinician", t) for t in said), ("clinician", "It was fine in May. Come back in a fortnight. Ring prior to the operation. Good. Five weekdays, then a day."))
    _write(spark, tmp_path, "sessions", [("s", AT.date(), AT)], "session_id string, visit_date date, received_at timestamp")
    sigs = {r.turn_id: r for r in QUERIES["sig_parse"](spark, str(tmp_path)).collect()}
    assert {0, 1, 2, 4} <= set(sigs) and 3 not in sigs
    assert (sigs[0].frequency_per_day, sigs[1].dose_unit, sigs[2].prn, sigs[4].status) == (2.0, "puff", True, "unparseable")
    dates = {r.sentence_no: r.status for r in QUERIES["spoken_dates"](spark, str(tmp_path)).where("turn_id = 5").collect()}
    assert dates == {0: "resolved_range", 1: "resolved", 2: "unanchored", 4: "resolved"}


def test_clinicians_by_any_spelling(spark, tmp_path):
    _turns(spark, tmp_path, ("clinician", "call the clinic about swelling ankles"), (" Dr", "please call the clinic promptly about any swelling ankles today"), ("md", "bring plenty of water"), ("pt", "call the clinic about swelling ankles"))
    assert sorted((r.turn_id, r.n_merged) for r in QUERIES["restatements"](spark, str(tmp_path)).collect()) == [(0, 2), (2, 1)]
    headings = [r.heading for r in QUERIES["summary_roles_top3"](spark, str(tmp_path)).orderBy("char_offset").collect()]
    assert headings == ["what_changes"] * 3 + ["what_you_said"]


def test_mentions_merge_by_code_in_any_layout(spark, tmp_path):
    item = lambda text, code, change: {"kind": "medication", "mention_quote": {"text": text}, "medication": {"rxcui": code}, "change_kind": change}
    many = [item(f"w{k}", None, None) for k in range(1001)]
    raws = [
        {"medications": [item("Water pill", "7", "started"), item("furosemide", "7", "continued")]},
        {"payload": json.dumps({"medications": {"med-a-0": {"kind": "medication", "mentionQuote": "Lasix", "medication": [{"rxcui": "7"}], "changeKind": "stopped"}}})},
        {"medications": [item("zz", None, "started")], "discarded": [item("zz", None, "stopped")]},
        {"medications": many},
        {"medications": [item("w1000", None, "started")]},
    ]
    _write(spark, tmp_path, "extractions", [(k, "s", json.dumps(r)) for k, r in enumerate(raws)], "extraction_id bigint, session_id string, raw_json string")
    out = {r.item_key: r for r in QUERIES["mention_merge"](spark, str(tmp_path)).collect()}
    assert (out["7"].n_mentions, out["7"].mention, out["7"].change_kind) == (3, "Water pill", "stopped")
    assert (out["unresolved:zz"].n_mentions, out["unresolved:zz"].change_kind) == (1, "started")
    assert out["unresolved:w1000"].n_mentions == 2 and tuple(out["unresolved:w1000"].first_seq) == (3, 1000)


def test_lookalikes_with_other_heads(spark, tmp_path):
    _write(spark, tmp_path, "name_index", [("BN", "brantexol"), ("BN", "barntexol"), ("BN", "zumivir"), ("IN", "bratnexol")], "tty string, key string")
    assert [(r.a, r.b) for r in QUERIES["lookalike_pairs"](spark, str(tmp_path)).collect()] == [("barntexol", "brantexol")]


def _visits(spark, folder, transcripts, turns, words):
    """Turns are (session, text, from, to), words (session, text, offset); a turn id with times may follow either."""
    consent, turn_times, word_times = (True, "signed", AT), (0.0, 9.0), (0, 1.0, 2.0)
    _write(spark, folder, "sessions", [(k, f"v/{k}", f"v/{k}/a.wav", t, consent, AT) for k, t in transcripts], "session_id string, session_dir string, audio_path string, transcript_text string, consent struct<obtained boolean, method string, obtained_at timestamp_ntz>, received_at timestamp")
    _write(spark, folder, "turns", [(*x, *more, *(() if more else (k, *turn_times)), AT) for k, (*x, more) in enumerate((*t[:4], t[4:]) for t in turns)], "session_id string, text string, char_start int, char_end int, turn_id int, start_s double, end_s double, received_at timestamp")
    _write(spark, folder, "words", [(*x, *(more or word_times), k, 0.5, AT) for k, (*x, more) in enumerate((*w[:3], w[3:]) for w in words)], "session_id string, text string, char_offset int, turn_id int, start_s double, end_s double, word_idx int, probability double, received_at timestamp")


def _as_in_sql(spark, folder):
    con = duckdb.connect()
    for t in ("sessions", "turns", "words"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet/*.parquet'")
    assert table(QUERIES["contract_violations"](spark, str(folder)).toPandas()) == table(con.sql(ORACLES["contract_violations"]).df())


def test_broken_rules_are_counted_without_broadcasts(spark, tmp_path):
    """Transcripts that pack well: their file tells nothing of the pieces' size, which once were all sent to the driver."""
    many = "again " * 20000
    _visits(spark, tmp_path, [(f"s{k}", many) for k in range(4)], [(f"s{k}", many[:-1], 0, len(many) - 1) for k in range(4)], [(f"s{k}", "again", at) for k in range(4) for at in (0, 6, 11, 119994)])
    found = QUERIES["contract_violations"](spark, str(tmp_path))
    assert [tuple(r) for r in found.collect()] == [("word offset does not index the transcript", 4, 4)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_slices_of_any_offsets_as_in_sql(spark, tmp_path):
    said = "no, é\U0001f600 is  so"
    words = [("s", t, lo) for t in ("no,", "no", "", "é\U0001f600", "is  so", "so", "o", None) for lo in (-40, -3, -2, -1, 0, 4, 7, 11, 12, 99, None)] + [("none", "no,", 0), ("null", "no,", 0), (None, "no,", 0), ("t", "no,", 0)]
    turns = [("s", t, lo, hi) for t in ("no,", "", "so", said, None) for lo in (-3, -1, 0, 3, 11, 13, None) for hi in (-1, 0, 3, 13, 99, None)] + [("none", "x", 0, 1), ("null", "x", 0, 1), (None, "x", 0, 1)]
    _visits(spark, tmp_path, [("s", said), ("null", None), ("t", "")], turns, words)
    _as_in_sql(spark, tmp_path)


def test_words_outside_turns_of_any_times_as_in_sql(spark, tmp_path):
    times = (None, -1.0, 0.0, 1.0, 2.0, float("nan"), float("inf"), float("-inf"))
    spans = [(s, k) for s in ("s", "none", None) for k in [*((a, b) for a in times for b in times), None]]
    turns = [(s, "a", 0, 1, k and 8 * times.index(k[0]) + times.index(k[1]), *(k or (0.0, 1.0))) for s, k in spans]
    words = [(s, "a", 0, turn, a, b) for s in ("s", "none", None) for turn in (*range(66), None) for a in times for b in times]
    _visits(spark, tmp_path, [("s", "a")], turns, words)
    _as_in_sql(spark, tmp_path)
