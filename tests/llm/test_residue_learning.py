"""Recall on held-out wordings, and exemplars learned from labelled pages."""

import pathlib
import random
import runpy

from pyspark.sql import functions as F

from spanloom.llm.residue import find_residue

HELD_OUT = runpy.run_path(str(pathlib.Path(__file__).with_name("paraphrases.py")))


def test_recall_on_held_out_wordings(spark):
    residue, content = HELD_OUT["PARAPHRASES"], HELD_OUT["CONTENT"]
    rng = random.Random(1)
    plain = [" ".join(rng.choice(" ".join(content).split()) for _ in range(30)) + "." for _ in range(400)]
    pages = [*residue, *content, *plain]
    df = spark.createDataFrame(list(enumerate(pages)), "doc_id bigint, text string")
    found = {r.doc_id for r in find_residue(df, "doc_id", "text").where("is_residue").collect()}
    assert len([k for k in found if k < len(residue)]) >= 0.9 * len(residue)
    assert not [k for k in found if k >= len(residue)]


def test_exemplars_are_learned_from_labelled_pages(spark):
    menu, notice = "Welcome in | Look around | Ask us", "Our kiosk keeps small notes on your visit. Fine."
    said = "The {} lantern store crossed the {} bridge before the {} market opened."
    rng = random.Random(5)
    words = [a + b for a in ("ka", "lo", "mi") for b in ("ban", "dor", "fen")]
    story = lambda: " ".join(said.format(*(rng.choice(words) for _ in range(3))) for _ in range(3))
    refusal = lambda: f"Kiosk {rng.choice(words)} refuses: this counter stays shut for you."
    pages = [(f"{menu}\n{notice}\n{story()}", 200) for _ in range(300)]
    pages += [(f"{menu}\n{notice}\n{refusal()}", 503) for _ in range(12)] + [(f"{menu}\n{notice}\n{refusal()}", 200) for _ in range(20)]
    pages += [(f"{menu}\n{story()}\nThe note on the door said: {refusal()}", 200), (None, 503), ("", 503), (story(), None)]
    df = spark.createDataFrame([(n, *p) for n, p in enumerate(pages)], "doc_id bigint, text string, status int")
    out = {r.doc_id: r.is_residue for r in find_residue(df, "doc_id", "text", labelled=F.col("status") >= 400).collect()}
    assert {k for k, v in out.items() if v} == set(range(300, 332)) and len(out) == len(pages) - 1
    assert not [r for r in find_residue(df, "doc_id", "text").collect() if r.is_residue]  # without labels nothing tells
    assert find_residue(df.where("false"), "doc_id", "text", labelled=F.col("status") >= 400).count() == 0
