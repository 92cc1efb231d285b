import random

from conftest import rows
from spanloom.operators.intervals import merge_intervals
from spanloom.operators.rangescan import annotate

SCHEMA = "e string, lo bigint, hi bigint, kind string, entity int"


def brute(spans):
    out, by = [], {}
    for e, lo, hi in spans:
        if e is not None and lo is not None and hi is not None and hi > lo:
            by.setdefault(e, []).append((lo, hi))
    for e, xs in by.items():
        merged = []
        for lo, hi in sorted(xs):
            if merged and lo <= merged[-1][1]:
                merged[-1][1] = max(merged[-1][1], hi)
            else:
                merged.append([lo, hi])
        out += [(e, "period", lo, hi) for lo, hi in merged] + [(e, "gap", a[1], b[0]) for a, b in zip(merged, merged[1:])]
    return sorted(out)


def got(spark, spans, **kw):
    df = spark.createDataFrame([(e, lo, hi, "x", 1) for e, lo, hi in spans], SCHEMA)
    return sorted(tuple(r) for r in merge_intervals(df, "e", "lo", "hi", **kw).collect())


def test_nested_touching_gapped_and_repeated(spark):
    spans = [("a", 0, 10), ("a", 2, 5), ("a", 10, 12), ("a", 20, 30), ("a", 20, 30), ("b", 1, 2)]
    assert got(spark, spans) == brute(spans)


def test_nulls_and_impossible_bounds_are_disregarded(spark):
    spans = [("a", None, 5), ("a", 5, None), (None, 1, 2), ("a", 7, 7), ("a", 9, 3), ("a", 1, 2)]
    assert got(spark, spans) == [("a", "period", 1, 2)]


def test_empty(spark):
    assert got(spark, []) == []


def test_one_entity_over_many_partitions(spark):
    rng = random.Random(5)
    hot = [("hot", s, s + rng.randrange(1, 60)) for s in (rng.randrange(6000) for _ in range(400))]
    cover = [("wide", 0, 10_000)] + [("wide", s, s + 1) for s in range(0, 9000, 30)]  # one span swallows whole partitions
    cold = [(f"e{rng.randrange(30)}", s, s + rng.randrange(1, 40)) for s in (rng.randrange(500) for _ in range(200))]
    for n in (1, 3, 9):
        assert got(spark, hot + cover + cold, partitions=n) == brute(hot + cover + cold)


def test_annotate_carries_sums_and_previous_values_across_partitions(spark):
    rng = random.Random(1)
    data = [("hot", i, float(rng.randrange(9)), rng.choice(["x", "y", None])) for i in range(120)] + [(f"e{i % 7}", i, 1.0, "z") for i in range(40)]
    df = spark.createDataFrame(data, "e string, o int, v double, l string")
    want = []
    for e in {d[0] for d in data}:
        before, prev, first = 0.0, None, True
        for _, o, v, label in sorted(d for d in data if d[0] == e) if e != "hot" else [d for d in data if d[0] == "hot"]:
            want.append((e, o, before, prev, first))
            before, prev, first = before + v, label, False
    for n in (1, 2, 7):
        out = annotate(df, "e", ["o"], sums=["v"], lags=["l"], partitions=n).select("e", "o", "before_v", "prev_l", "is_first")
        assert rows(out) == sorted(want, key=lambda r: tuple((x is None, str(x)) if not isinstance(x, (int, float)) else (False, f"{x:020.6f}") for x in r))
