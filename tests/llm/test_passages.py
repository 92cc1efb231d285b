"""Edited passages: found within the budget, refused beyond it."""

import random

from spanloom.llm.leaks import LeakMatcher, find_passages, plain_words

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("ban", "dor", "fen", "gul", "pas")]
ITEM = " ".join(WORDS[:12])


def distances(budget, text, item=ITEM):
    return LeakMatcher([(1, item)], budget=budget).passages(plain_words(text))


def test_one_changed_letter_needs_one_edit():
    for at in range(12):  # the edit may stand in any word
        words = WORDS[:12]
        words[at] = words[at][:2] + "x" + words[at][3:]
        text = "before " + " ".join(words) + " after"
        assert distances(0, text) == {}
        assert distances(1, text)[0][0] == 1 and distances(1, text)[0][1] < 12
        other = (at + 3) % 12
        words[other] = words[other][:1] + "yy" + words[other][1:]
        assert distances(1, " ".join(words)) == {}
    assert distances(1, ITEM) == {0: (0, 12)} and distances(0, ITEM) == {0: (0, 12)}


def test_a_changed_word_needs_its_letters():
    words = [*WORDS[:5], "xyzzy", *WORDS[6:12]]
    assert distances(4, " ".join(words)) == {} and distances(5, " ".join(words))[0] == (5, 6)


def _least(pattern, text):
    row = [0] * (len(text) + 1)
    for i, x in enumerate(pattern, 1):
        now = [i]
        for j, y in enumerate(text, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


def test_edited_passages_match_brute_force(spark):
    rng = random.Random(7)
    items = [(n, " ".join(rng.choice(WORDS) for _ in range(rng.randrange(8, 22)))) for n in range(6)]
    docs = []
    for n in range(60):
        w = list(rng.choice(items)[1].split())
        a = rng.randrange(max(1, len(w) - 11))
        cut = list(" ".join(w[a : a + 13]))
        for _ in range(rng.randrange(4)):
            k = rng.randrange(len(cut))
            cut[k] = rng.choice(["", "q", cut[k] + "z"])
        docs.append((n, " ".join(rng.choice(WORDS) for _ in range(4)) + " " + "".join(cut) + " tail", 0))
    docs += [(100, None, 0), (101, "", 0), (None, ITEM, 0), docs[0]]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, distance int")
    q = spark.createDataFrame(items, "item_id bigint, text string")
    for budget in (0, 1, 2):
        want = set()
        for n, t, _ in docs:
            for k, i in items if t and n is not None else ():
                words = plain_words(i).split()
                least = min((_least("".join(words[w : w + 12]), plain_words(t).replace(" ", "")) for w in range(len(words) - 11)), default=99)
                if least <= budget:
                    want.add((n, k, least))
        for limit in (100_000, 20):
            got = {(r.doc_id, r.item_id, r.distance) for r in find_passages(d, "doc_id", "text", q, "item_id", "text", budget=budget, block_pieces=limit).collect()}
            assert got == want
        assert want
