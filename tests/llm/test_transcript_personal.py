from spanloom.llm.personal import find_mentions, find_personal, learn_names, luhn, mask, mask_personal, mod97
from spanloom.llm.transcript import Layouts, clean_row, clean_turns, layout

NAMES = frozenset("hestor pellgrove umberlane o'dravin".split())


def kinds(text, names=NAMES):
    return [(m.kind, text[m.start : m.end]) for m in find_mentions(text, names)]


def test_rows_are_cleaned():
    plain = Layouts({})
    for raw, want in {
        "[00:01:02] SPEAKER 01 - The uh, bus 41 stops.": ("The bus 41 stops.", 1, None),
        "spk2 > (that is half) [laughs] er yes": ("(that is half) yes", 2, None),
        "Dr. — I feel better than at 8:30.": ("I feel better than at 8:30.", None, "clinician"),
        ">> Take liavatruulo ER (0:12)": ("Take liavatruulo ER", None, None),
        "♪ humming ♪ um—": ("", None, None),
        "I I am": ("I I am", None, None),
        "": ("", None, None),
    }.items():
        assert clean_row(raw, plain) == want, raw
    assert layout("10 weeks ago".split()) == ("*",)


def test_turns_merge_by_speaker(spark):
    t = [
        ("s", 0, "SPK0", "PT", 0.0, "Hello."), ("s", 1, "speaker_0", None, 1.0, "uh"), ("s", 3, "S0", None, 2.0, "Again."), ("s", 4, "SPEAKER 01:", "Doctor", 3.0, "S1: Right."),
        ("s", 5, None, None, 4.0, "DR: Sit down."), ("s", 6, None, None, 5.0, "S0: Ok."), ("s", 7, None, None, 6.0, "By words."), ("s", 0, "SPK0", "PT", 0.0, "Hello."), ("s", 8, None, None, None, None), (None, 1, "S1", None, 0.0, "x"),
    ]
    turns = spark.createDataFrame([(*x, 9) for x in t], "session_id string, turn_id int, speaker_cluster string, role string, start_s double, text string, n_words int")
    words = spark.createDataFrame([("s", 7, "spk-01"), ("s", 7, None)], "session_id string, turn_id int, speaker_cluster string")
    for n in (1, 4):
        out = [tuple(r) for r in clean_turns(turns, words, partitions=n).orderBy("first_turn_id").collect()]
        assert out == [("s", 0, 3, 0, 2, "Hello. Again."), ("s", 4, 5, 1, 3, "Right. Sit down."), ("s", 6, 6, 0, 1, "Ok."), ("s", 7, 7, 1, 2, "By words.")]
    assert clean_turns(turns.where("false"), words).count() == 0


def test_mentions_by_kind():
    assert kinds("My name is Torvik um B. Kelpo, I live at Flat 2, 30 Oxbow Row now.") == [("person", "Torvik um B. Kelpo"), ("address", "Flat 2, 30 Oxbow Row")]
    assert kinds("Right, Umberlane. i saw doctor o'dravin") == [("person", "Umberlane"), ("person", "o'dravin")]
    assert kinds("write to hestor dot pellgrove at quaymail dot test now") == [("email", "hestor dot pellgrove at quaymail dot test")]
    assert kinds("A.B+c@x-y.example, or hestor (at) a.b.example.") == [("email", "A.B+c@x-y.example"), ("email", "hestor (at) a.b.example")]
    assert kinds("call me on five five five, oh one four four or (212) 555-0123") == [("phone", "five five five, oh one four four"), ("phone", "(212) 555-0123")]
    assert kinds("Her social number is 560 515 1989. The member card says ZK 4138 0595.") == [("id_number", "560 515 1989"), ("id_number", "ZK 4138 0595")]
    assert kinds("we live at sextonweg 77 now") == [("address", "sextonweg 77")]
    for clean in ("Dr. — Take it daily.", "The batch printed on the box is LX-22-07.", "I walked 5550 steps at 8:30.", "room 212, bus 41, 120/80, 10 10— 10 10, 10", "do not drive until spring", ""):
        assert kinds(clean) == [], clean


def test_checksums():
    assert luhn("4539578763621486") and not luhn("4539578763621487")
    assert mod97("GB82WEST12345698765432") and not mod97("GB82WEST12345698765431")
    assert kinds("my card is 4539 5787 6362 1486 ok")[0][0] == "id_number"


def test_frames(spark):
    df = spark.createDataFrame([("a", "This is Xandor Kvarn speaking, and Xandor Kvarn left.", 0), ("b", None, 0), ("c", "", 0)], "k string, t string, score int")
    names = learn_names(df, "t")
    assert names == frozenset() or names == frozenset({"xandor", "kvarn"})
    out = find_personal(df, ["k"], "t", frozenset({"xandor", "kvarn"}))
    assert [(r.k, r.pii_type, r.char_start) for r in out.orderBy("char_start").collect()] == [("a", "person", 8), ("a", "person", 35)]
    masked = {r.k: r.t for r in mask_personal(df, "t", frozenset({"xandor", "kvarn"})).collect()}
    assert masked == {"a": "This is [PERSON] speaking, and [PERSON] left.", "b": None, "c": ""}
    assert mask("abc", []) == "abc" and find_personal(df.where("false"), ["k"], "t", NAMES).count() == 0


def test_very_long_texts_are_read_whole():
    tail = " call me on 212 555 0123"
    for filler in ("word " * 60_000, "x dot " * 30_000, "( " * 50_000, "a" * 200_000 + " "):
        text = filler + "mail a.b@c.example or" + tail
        assert kinds(text)[-2:] == [("email", "a.b@c.example"), ("phone", "212 555 0123")]
        assert clean_row(text, Layouts({}))[0].endswith("0123")
