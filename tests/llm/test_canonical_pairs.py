"""Canonical mapping against all pairs of names and entries."""

import math
import random

from spanloom.llm.canonical import LEAST, MAX_EDITS, allowed, edit_distance, map_to_reference, meant, sound, tokens


def all_pairs(names, entries):
    df = {}
    for e in entries:
        for w in set(e.split()):
            df[w] = df.get(w, 0) + 1
    idf = {w: math.log1p(len(entries) / n) for w, n in df.items()}
    out = {}
    for name in names:
        toks = tokens(name)
        toks = dict.fromkeys([*toks, *(a + b for a, b in zip(toks, toks[1:]))])
        weight, nearest = {}, set()
        for t in toks:
            near = [(edit_distance(sound(t), sound(w), MAX_EDITS), edit_distance(t, w, 9), w) for w in idf]
            near = [x for x in near if x[0] <= min(allowed(t), meant(x[2]))]
            best = min((x[:2] for x in near), default=None)
            own = max((idf[w] for d, r, w in near if (d, r) == best), default=0)
            nearest |= {w for d, r, w in near if (d, r) == best}
            for d, r, w in near:
                weight[w] = max(weight.get(w, (0, 0)), (1 - d / (2 * len(w)) - r / 1000, own))
        size = math.sqrt(sum(idf[w] ** 2 for w in nearest))
        scores = []
        for e, code in entries.items():
            words = set(e.split())
            got = sum(idf[w] * weight[w][0] * weight[w][1] for w in words if w in weight)
            if got and (s := got / (math.sqrt(sum(idf[w] ** 2 for w in words)) * size)) >= LEAST:
                scores.append((-round(s, 9), len(code), code))
        out[name] = min(scores)[2] if scores else ""
    return out


def test_every_name_gets_the_best_of_all_entries(spark):
    rng = random.Random(11)
    parts = [a + b + c for a in ("clo", "bra", "zad", "vyr") for b in ("gib", "lat", "exo") for c in ("rium", "reol", "ique", "naxone")]
    salts = ["citrate", "sodium", "acetate"]
    entries = {}
    for k, p in enumerate(parts):
        entries[p] = str(100 + k)
        if rng.random() < 0.5:
            entries[f"{p} {rng.choice(salts)}"] = str(200 + k)
    names = ["citrate", "sodium acetate", "???", "for sleep"]
    for _ in range(150):
        e = list(rng.choice(sorted(entries)))
        for _ in range(rng.randrange(4)):
            at = rng.randrange(len(e))
            e[at] = rng.choice(["", e[at] * 2, rng.choice("abcxyz"), " "])
        names.append(rng.choice(["", "my ", "Generic "]) + "".join(e).upper() + rng.choice(["", " 50 mg", " tabs", " citrate"]))
    names = [n for n in dict.fromkeys(names) if n.strip()]
    df = spark.createDataFrame(list(enumerate(names)), "entry_id bigint, name string")
    ref = spark.createDataFrame([(e.upper(), e, c, 1) for e, c in entries.items()], "str string, key string, rxcui string, score int")
    got = {r.name: r.code for r in map_to_reference(df, "entry_id", "name", ref, ["key", "str"], "rxcui").collect()}
    assert got == all_pairs(names, entries) and sum(c == "" for c in got.values()) > 3
