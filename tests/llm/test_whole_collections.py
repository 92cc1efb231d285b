"""Evidence counts alike in a collection of any size."""

from spanloom.llm import personal


def test_a_rare_name_is_listed_in_a_large_collection(spark, monkeypatch):
    # as if there were millions of proposals: half of them would be asked for
    monkeypatch.setattr(personal, "NAME_MIN_SHARE", 0.5, raising=False)
    said = ["I saw Mr Smith today."] * 40 + ["I saw Mr Okonkwo today."] * 2
    texts = spark.createDataFrame([(t,) for t in said], "text string")
    assert personal.learn_names(texts, "text") == {"smith", "okonkwo"}
