import random
from collections import Counter, defaultdict

from spanloom.llm.frequency import term_frequency
from spanloom.llm.runs import collapse_runs, letters_and_digits

SCHEMA = "g string, s int, i int, t string, a double, b double, grp string, form int"


def brute(events):
    seen = {}
    for e in events:
        if all(e[k] is not None for k in (0, 1, 2, 4, 5)):
            seen.setdefault(e[:3], e)
    by = defaultdict(list)
    for e in seen.values():
        by[e[0], e[1]].append(e)
    out = []
    for (g, s), es in by.items():
        es.sort(key=lambda e: (round(e[4] * 1000), e[2]))
        run = []
        for e in [*es, None]:
            f = letters_and_digits(e[3] or "") if e else None
            if run and f and f == run[-1][1]:
                run.append((e, f))
                continue
            if len(run) > 1:
                out.append((g, s, run[0][0][2], run[-1][0][2], len(run), round(run[-1][0][5] * 1000) - round(run[0][0][4] * 1000)))
            run = [(e, f)] if f else []
    return sorted(out)


def got(spark, events, **kw):
    df = spark.createDataFrame([(*e, "x", 0) for e in events], SCHEMA)
    return sorted(tuple(r) for r in collapse_runs(df, "g", "s", "i", "t", "a", "b", **kw).collect())


def test_runs_match_brute_force_over_partition_borders(spark):
    rng = random.Random(3)
    words = ["The", "the,", "thé", "a", "—", "x9", None]
    events = [("hot", 1, i, "same" if 40 <= i < 110 else rng.choice(words), i / 10, i / 10 + 0.05) for i in range(160)]
    events += [(f"g{i % 4}", i % 3, i, rng.choice(words[:3]), i / 10, i / 10 + 0.1) for i in range(60)]
    events += events[10:30] + [(None, 1, 1, "a", 0.0, 1.0), ("n", 1, 1, "a", None, 1.0), ("n", None, 2, "a", 0.0, 1.0)]
    rng.shuffle(events)
    for n in (1, 5, 11):
        assert got(spark, events, partitions=n) == brute(events)


def test_one_run_fills_everything_and_nothing(spark):
    assert got(spark, [("g", 1, i, "no", float(i), i + 0.5) for i in range(70)], partitions=6) == [("g", 1, 0, 69, 70, 69500)]
    assert got(spark, []) == [] and got(spark, [("g", 1, 0, "a", 0.0, 1.0)]) == []
    assert letters_and_digits("Éa—2!") == "ea2"


def test_terms(spark):
    rng = random.Random(2)
    data = [(str(rng.randrange(40)), " / ".join(rng.choice(["Hot", " hot ", "b  C", "", "d"]) for _ in range(rng.randrange(1, 4))), rng.choice(["A", " a", None])) for _ in range(300)]
    data += [(None, "hot", "A"), ("1", None, None), ("1", " ", " ")]
    df = spark.createDataFrame([(*d, 1) for d in data], "rec string, terms string, kind string, term int")
    occ, recs = Counter(), defaultdict(set)
    for rec, terms, kind in data:
        for field, parts in (("terms", terms.split("/") if terms is not None else []), ("kind", [kind] if kind is not None else [])):
            for p in parts:
                if t := " ".join(p.lower().split()):
                    occ[field, t] += 1
                    recs[field, t] |= {rec} - {None}
    total = len({d[0] for d in data} - {None})
    mark = lambda n: "rare" if n <= 2 else "common" if n > 0.02 * total else "usual"
    want = sorted((f, t, occ[f, t], len(recs[f, t]), mark(len(recs[f, t]))) for f, t in occ)
    for n in (1, 6):
        assert sorted(tuple(r) for r in term_frequency(df, "rec", {"terms": "/", "kind": None}, partitions=n).collect()) == want
    assert term_frequency(df.where("false"), "rec", {"terms": "/"}).collect() == []
