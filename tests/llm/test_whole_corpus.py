"""Results don't depend on what else is in the collection, and the joined paths equal the one-text functions."""

import random

from pyspark.sql import functions as F

from spanloom.llm.personal import find_mentions, find_personal, learn_names, mask, mask_personal, name_table
from spanloom.llm.transcript import clean_turns

PEOPLE = ["Xandor Kvarn", "Hestor Pellgrove", "Maruna O'Dravin"]


def _texts(rng, n):
    out = []
    for k in range(n):
        who = rng.choice(PEOPLE)
        out.append(rng.choice([
            f"I saw Dr. {who} today.", f"my name is {who}, call 212 555 0199", f"right, {who.lower()}.", f"write to {who.split()[0].lower()}@mail.example or {who}", f"{who.split()[1]} T. {who.split()[0]} left",
            "nothing here", "", "[music] um " + who + "; " + who, f"social number 560 515 1989 of {who}, {rng.choice(['Fennelweg 55', '12 Oxbow Street'])}",
        ]))
    return out


def test_mentions_equal_the_one_text_function(spark):
    rng = random.Random(8)
    texts = _texts(rng, 150)
    df = spark.createDataFrame([*((k, t, 0) for k, t in enumerate(texts)), (900, None, 0), (901, texts[0], 0), (901, texts[0], 0)], "k int, t string, score int")
    names = name_table(df, "t")
    listed = learn_names(df, "t")
    assert listed >= {"xandor", "kvarn"} and {r.word for r in names.collect()} == listed
    want = sorted((k, m.kind, m.start, m.end) for k, t in [*enumerate(texts), (901, texts[0])] for m in find_mentions(t, listed))
    assert sorted({(r.k, r.pii_type, r.char_start, r.char_end) for r in find_personal(df, ["k"], "t", names).collect()}) == want
    masked = mask_personal(df, "t", names).collect()
    assert len(masked) == len(texts) + 3 and all(r.t == (None if r.k == 900 else mask(texts[0 if r.k == 901 else r.k], find_mentions(texts[0 if r.k == 901 else r.k], listed))) for r in masked)
    assert find_personal(df.where("false"), ["k"], "t", names).count() == 0 and name_table(df.where("false"), "t").count() == 0


def test_a_million_unrelated_rows_change_no_mention(spark):
    rng = random.Random(9)
    few = spark.createDataFrame([(k, t) for k, t in enumerate(_texts(rng, 60))], "k bigint, t string")
    other = spark.range(1_000, 1_001_000, numPartitions=8).select(F.col("id").alias("k"), F.concat(F.lit("the tide was at "), (F.col("id") % 12).cast("string")).alias("t"))
    found = lambda df: {tuple(r) for r in find_personal(df, ["k"], "t", name_table(df, "t")).where("k < 1000").select("k", "pii_type", "char_start").collect()}
    assert found(few) == found(few.unionByName(other)) != set()


def test_unrelated_rows_change_no_turn(spark):
    marks = ["[00:00:0{}]", "(0:0{})", "{}.0"]
    said = [("s", k, None, None, float(k), f"{marks[k % 3].format(k % 9)} Zorp{k % 2}: word {k}") for k in range(60)]
    schema = "session_id string, turn_id int, speaker_cluster string, role string, start_s double, text string"
    few = spark.createDataFrame(said, schema)
    other = spark.range(0, 200_000, numPartitions=4).select(F.concat(F.lit("u"), F.col("id") % 500).alias("session_id"), F.col("id").cast("int").alias("turn_id"), F.lit("S1").alias("speaker_cluster"), F.lit("pt").alias("role"), F.lit(1.0).alias("start_s"), F.lit("plain words").alias("text"))
    words = spark.createDataFrame([], "session_id string, turn_id int, speaker_cluster string")
    turns = lambda df: sorted(tuple(r) for r in clean_turns(df, words).where("session_id = 's'").collect())
    assert turns(few) == turns(few.unionByName(other)) != []
