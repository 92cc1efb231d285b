import random

from hypothesis import given, settings
from hypothesis import strategies as st

from spanloom.llm.leaks import LeakMatcher, find_leaks, myers_distance, plain_words
from spanloom.llm.residue import ExemplarIndex, find_residue, signatures, unfilled_fields, weigh_page

WORDS = [a + b for a in ("ka", "lo", "mi", "tu", "re") for b in ("ban", "dor", "fen", "gul", "pas")]


def _edit(p, t):
    row = [0] * (len(t) + 1)
    for i, x in enumerate(p, 1):
        now = [i]
        for j, y in enumerate(t, 1):
            now.append(min(row[j] + 1, now[-1] + 1, row[j - 1] + (x != y)))
        row = now
    return min(row)


@given(st.text(alphabet="abc", min_size=1, max_size=12), st.text(alphabet="abc", max_size=20))
@settings(max_examples=200, deadline=None)
def test_myers_is_the_edit_distance(p, t):
    assert myers_distance(p, t) == _edit(p, t)


def _brute(doc, item, k=12):
    d, i = plain_words(doc).split(" "), plain_words(item).split(" ")
    runs = {tuple(d[a : a + k]) for a in range(len(d) - k + 1)}
    return any(tuple(i[a : a + k]) in runs for a in range(len(i) - k + 1))


def test_leaks_match_brute_force(spark):
    rng = random.Random(4)
    items = [(n, " ".join(rng.choice(WORDS) + (str(rng.randrange(9)) if rng.random() < 0.2 else "") for _ in range(rng.randrange(5, 40)))) for n in range(12)]
    docs = []
    for n in range(120):
        text = " ".join(rng.choice(WORDS) for _ in range(30))
        if n % 2:
            w = rng.choice(items)[1].split()
            a = rng.randrange(len(w))
            cut = w[a : a + rng.choice([6, 11, 12, 13, 20])]
            text += " " + rng.choice([" ", " <b>", ",\n"]).join(cut).upper().replace("<B>", "<b>") + " end"
        docs.append((n, text, 0))
    docs += [(900, None, 0), (901, "", 0), (None, "x", 0)]
    d = spark.createDataFrame(docs, "doc_id bigint, text string, item_id int")
    q = spark.createDataFrame([*items, (50, None), (51, ""), items[0]], "item_id bigint, text string")
    want = sorted((n, k) for n, t, _ in docs if t and n is not None for k, i in items if _brute(t, i))
    for limit in (100_000, 7):  # one block, and several
        assert sorted((r.doc_id, r.item_id) for r in find_leaks(d, "doc_id", "text", q, "item_id", "text", block_pieces=limit).collect()) == want
    assert want and find_leaks(d, "doc_id", "text", q.where("false"), "item_id", "text").count() == 0


def test_garbled_passages_and_partial_words():
    item = "5 oak pegs " + " ".join(WORDS[:12])
    m = LeakMatcher([(1, item)])
    assert m.find("x " + " ".join(w[:2] + "­" + w[2:] for w in WORDS[:12])) == {0: 12}
    assert m.find("x 5&nbsp;oak​ pegs<br/>" + " ".join(WORDS[:9])) == {0: 12}
    assert m.find("85 oak pegs " + " ".join(WORDS[:9])) == {}  # the first word is another number


def test_residue(spark):
    text = "The river festival collected three wooden bridges in the week after the fair. A young beekeeper painted the covered market before noon."
    pages = {
        1: "Home | Contact | Search\n404 Not Found\nYou may try the search box instead.\n© 2031 x.example Back to top",
        2: f"Guide\n{text}\nSome features of this page need scripts.",
        3: "Home\nPlease enable JavaScript to view this site.",
        4: f"{text}\nDear {{{{ first_name }}}}, welcome back to the shop.",
        5: f"{text}\nIn this lesson the marker `{{{{ title }}}}` is written where a value follows.",
        6: f"We collected odd messages (\"Service temporarily unavailable\") on mugs.\n{text}",
        7: "Lorem ipsum dolor sit amet, consectetur adipiscing elit, sed do eiusmod tempor.",
        8: "The sign said <<no bicycles>> in red paint. Write to us [sic] was the whole note.",
        9: "",
        10: "Ihr Browser wird geprÃ¼ft. Einen Moment bitte.",
    }
    df = spark.createDataFrame([*((k, v, 0) for k, v in pages.items()), (11, None, 0)], "doc_id bigint, text string, fields int")
    out = {r.doc_id: r.is_residue for r in find_residue(df, "doc_id", "text").collect()}
    assert {k for k, v in out.items() if v} == {1, 3, 4, 7, 10} and 11 not in out
    assert find_residue(df.where("false"), "doc_id", "text").count() == 0
    assert signatures("Prüfen über 12x PrÃ¼fen") == ["pr*fen", "ber", "#", "pr*fen"]
    assert unfilled_fields("%%A%% {x} @@b@@ [Your Name Here] '{x}' [Enter] 100%") == 4
    ExemplarIndex()


def test_very_long_texts_are_read_whole():
    item = " ".join(WORDS[:20])
    assert LeakMatcher([(1, item)]).find("pad " * 300_000 + item) == {0: 20}
    index = ExemplarIndex()
    index.weigh({}, 10)
    assert weigh_page("pad. " * 100_000 + "{{ name }}", index)[2] == 1
