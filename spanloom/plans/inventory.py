
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.operators import resolve, review, search, spans, visits
from spanloom.operators.rangescan import annotate
from spanloom.plans.reference import latest_sessions, latest_turns, latest_words, with_latest
from spanloom.session import table
from spanloom.sources import transcripts, vocabulary_files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_latest(sql)
        return f

    return register


# ---------------------------------------------------------------- sources


def _release_lines(s, d):
    """The name list as lines of a release file: eighteen fields, some not English, some suppressed, by the length of the name."""
    n = table(s, d, "name_index", "rxcui", "tty", "str").distinct().withColumn("h", F.length("str"))
    lang, off = F.when(F.col("h") % 5 == 0, "SPA").otherwise("ENG"), F.when(F.col("h") % 7 == 0, "Y").otherwise("N")
    blank = F.lit("")
    fields = [F.col("rxcui"), lang, *[blank] * 10, F.col("tty"), blank, F.col("str"), blank, off, blank]
    return n.select(F.concat(F.concat_ws("|", *fields), F.lit("|")).alias("value"))


@query("SELECT DISTINCT rxcui, tty, str FROM name_index WHERE length(str) % 5 <> 0 AND length(str) % 7 <> 0")
def release_concepts(s, d):
    """S-01, S-02: English, unsuppressed concepts of a pipe-delimited release."""
    return vocabulary_files.concepts(vocabulary_files.split_fields(_release_lines(s, d)))


@query(
    r"""
    SELECT DISTINCT rxcui, 'RXN_AVAILABLE_STRENGTH' AS name, regexp_extract(str, '[0-9.]+ (MG|MCG|ML|G|UNT)') AS value FROM product WHERE regexp_matches(str, '[0-9.]+ (MG|MCG|ML|G|UNT)')
    UNION ALL SELECT DISTINCT rxcui, 'SPL_SET_ID', 'set-' || ingredient_key FROM product WHERE ingredient_key <> ''"""
)
def release_attributes(s, d):
    """S-03: wanted attributes with a value, from lines of entity, attribute and value."""
    p = table(s, d, "product", "rxcui", "str", "ingredient_key")
    line = lambda name, value: F.concat_ws("|", "rxcui", *[F.lit("")] * 7, F.lit(name), F.lit(""), F.coalesce(value, F.lit("")), F.lit(""))
    kinds = F.array(line("RXN_AVAILABLE_STRENGTH", F.regexp_extract("str", r"([0-9.]+ (MG|MCG|ML|G|UNT))", 1)), line("SPL_SET_ID", F.when(F.col("ingredient_key") != "", F.concat(F.lit("set-"), "ingredient_key"))), line("OTHER", F.col("str")))
    return vocabulary_files.attributes(vocabulary_files.split_fields(p.select(F.explode(kinds).alias("value")))).distinct()


@query("SELECT DISTINCT lower(dose_form) AS dose_form FROM product WHERE dose_form IS NOT NULL AND dose_form <> ''")
def release_dose_forms(s, d):
    """S-04: dose forms of a release, lower-case and once each."""
    p = table(s, d, "product", "dose_form").where("dose_form <> ''").distinct()
    fields = [F.lit("1"), F.lit("ENG"), *[F.lit("")] * 10, F.lit("DF"), F.lit(""), F.col("dose_form"), F.lit(""), F.lit("N"), F.lit("")]
    return vocabulary_files.dose_form_names(vocabulary_files.split_fields(p.select(F.concat_ws("|", *fields).alias("value"))))


@query("SELECT DISTINCT strftime(loaded_at, '%m%d%Y') AS release FROM product WHERE loaded_at IS NOT NULL")
def release_names(s, d):
    """S-05: the release that a readme's name tells."""
    p = table(s, d, "product", "loaded_at").where("loaded_at is not null").select(F.concat(F.lit("/kb/release/Readme_Full_"), F.date_format("loaded_at", "MMddyyyy"), F.lit(".txt")).alias("path")).distinct()
    return vocabulary_files.release_of(p)


def _label_records(s, d):
    """One label record per product; every third has no set id of its own, codes only where the key is long."""
    p = table(s, d, "product", "rxcui", "str", "ingredient_key", "dose_form").groupBy("rxcui").agg(F.min("str").alias("str"), F.min("ingredient_key").alias("ing"), F.min("dose_form").alias("form"))
    third = F.col("rxcui").cast("int") % 3 == 0
    own = F.when(~third, F.array(F.concat(F.lit("spl-"), "rxcui")))
    openfda = F.struct(own.alias("spl_set_id"), F.array("str", "ing").alias("brand_name"), F.array("ing").alias("generic_name"), F.when(F.length("rxcui") > 5, F.array("rxcui")).alias("rxcui"))
    whole = F.struct(F.when(F.col("rxcui").cast("int") % 2 == 0, F.concat(F.lit("set-"), "rxcui")).alias("set_id"), F.lit("20300101").alias("effective_time"), openfda.alias("openfda"), F.array(F.concat(F.lit("Take "), "str"), F.col("form")).alias("indications_and_usage"), F.array("form").alias("warnings"))
    return p.select(F.to_json(whole).alias("record"))


_LABELS = """
    WITH p AS (SELECT rxcui, min(str) AS str, min(ingredient_key) AS ing, min(dose_form) AS form FROM product GROUP BY 1),
    l AS (SELECT *, CASE WHEN CAST(rxcui AS INTEGER) % 3 <> 0 THEN 'spl-' || rxcui WHEN CAST(rxcui AS INTEGER) % 2 = 0 THEN 'set-' || rxcui END AS spl_set_id FROM p)"""


@query(
    _LABELS
    + """
    SELECT spl_set_id, substr(concat_ws('; ', str, ing), 1, 200) AS brand, substr(coalesce(ing, ''), 1, 200) AS generic, '20300101' AS effective_time, length(rxcui) > 5 AS has_rxcui FROM l WHERE spl_set_id IS NOT NULL"""
)
def label_rows(s, d):
    """S-07: label rows: set id of the record or its first own one, names joined and cut at 200."""
    return vocabulary_files.labels(_label_records(s, d))[0]


@query(
    _LABELS
    + """
    SELECT spl_set_id, 'indications_and_usage' AS field, concat_ws(' ', 'Take ' || str, form) AS body FROM l WHERE spl_set_id IS NOT NULL AND concat_ws(' ', 'Take ' || str, form) <> ''
    UNION ALL SELECT spl_set_id, 'warnings', form FROM l WHERE spl_set_id IS NOT NULL AND form <> ''"""
)
def label_texts(s, d):
    """S-07: the text fields of labels, one row each."""
    return vocabulary_files.labels(_label_records(s, d))[1]


@query(
    """,
    w2 AS (SELECT session_id, count(*) AS n_words, CAST(sum(length(text)) AS BIGINT) AS n_letters FROM w WHERE (session_id, turn_id) IN (SELECT session_id, turn_id FROM t) GROUP BY 1),
    t2 AS (SELECT session_id, count(*) AS n_turns FROM t GROUP BY 1)
    SELECT s.session_id, CAST(s.visit_date AS VARCHAR) AS visit_date, coalesce(n_turns, 0) AS n_turns, coalesce(n_words, 0) AS n_words, coalesce(n_letters, 0) AS n_letters, coalesce(s.consent.obtained, false) AS consented
    FROM s LEFT JOIN t2 USING (session_id) LEFT JOIN w2 USING (session_id)"""
)
def session_round_trip(s, d):
    """S-09, S-16: sessions written as one JSON document each and read back with the declared schema."""
    docs = transcripts.session_documents(latest_sessions(s, d), latest_turns(s, d), latest_words(s, d))
    read = transcripts.parse_sessions(docs)
    words = F.flatten(F.transform("turns", lambda t: F.coalesce(t["words"], F.array().cast("array<struct<text:string,start:double,end:double,probability:double,speaker_cluster:string,char_offset:int>>"))))
    count = lambda c: F.coalesce(F.nullif(F.size(c), F.lit(-1)), F.lit(0)).cast("bigint")
    return read.select(
        "session_id", F.col("visit_date").cast("string").alias("visit_date"), count(F.col("turns")).alias("n_turns"), count(words).alias("n_words"),
        F.coalesce(F.aggregate(words, F.lit(0).cast("bigint"), lambda n, w: n + F.length(w["text"])), F.lit(0)).alias("n_letters"), F.coalesce("consent.obtained", F.lit(False)).alias("consented"),
    )


# ---------------------------------------------------------------- sessions


@query(
    """,
    g AS (SELECT session_id, turn_id, count(*) / count(DISTINCT lower(text))::DOUBLE AS r, 1 - avg(probability) AS p FROM w GROUP BY 1, 2)
    SELECT session_id, turn_id, round(r + 1e-9, 6) AS repetition, round(p + 1e-9, 6) AS no_speech, coalesce(r > 2.4, false) OR coalesce(p > 0.6, false) AS suspect FROM g"""
)
def suspect_turns(s, d):
    """F-07: turns whose words repeat themselves, or are so improbable that they may be no speech."""
    g = latest_words(s, d).groupBy("session_id", "turn_id").agg((F.count("*") / F.count_distinct(F.lower("text"))).alias("r"), (1 - F.avg("probability")).alias("p"))
    return g.select("session_id", "turn_id", F.round(F.col("r") + 1e-9, 6).alias("repetition"), F.round(F.col("p") + 1e-9, 6).alias("no_speech"), visits.suspect_segment(F.col("r"), F.col("p")).alias("suspect"))


@query(
    r""",
    b AS (SELECT session_id, turn_id, string_agg(text, ' ' ORDER BY word_idx) AS text FROM w GROUP BY 1, 2),
    m AS (SELECT session_id, turn_id, t.text IS NOT NULL AS has_a, b.text IS NOT NULL AS has_b, t.text AS a, b.text AS b,
                 CASE WHEN t.text IS NULL THEN [] ELSE list_filter(string_split_regex(trim(t.text), '\s+'), lambda x: x <> '') END AS wa,
                 CASE WHEN b.text IS NULL THEN [] ELSE list_filter(string_split_regex(trim(b.text), '\s+'), lambda x: x <> '') END AS wb FROM t FULL JOIN b USING (session_id, turn_id)),
    n AS (SELECT *, a IS NOT DISTINCT FROM b AS same, len(list_filter(range(1, least(len(wa), len(wb)) + 1), lambda i: wa[i] = wb[i])) AS agree, greatest(len(wa), len(wb)) AS nw FROM m)
    SELECT session_id, count(*) FILTER (has_a) AS n_left, count(*) FILTER (has_b) AS n_right, count(*) FILTER (same) AS n_same, coalesce(min(turn_id) FILTER (NOT same), -1) AS first_unlike,
           round(CASE WHEN sum(nw) > 0 THEN sum(agree) / sum(nw) ELSE 1.0 END, 6) AS word_agreement FROM n GROUP BY session_id"""
)
def session_differences(s, d):
    """A-18: stored turns against the same turns put together from their words."""
    word = F.struct("word_idx", "text")
    rebuilt = latest_words(s, d).groupBy("session_id", "turn_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["text"]), " ").alias("text"))
    return visits.session_diff(latest_turns(s, d), rebuilt).fillna(-1, ["first_unlike"])


_NEXT = {"": ("click", "view", "purchase", "signup"), "view": ("view", "click", "signup"), "click": ("view", "click", "purchase"), "purchase": ("view",), "signup": ("view", "click")}


@query(
    """
    WITH o AS (SELECT CAST(user_id AS VARCHAR) AS session_id, event_id, event_type AS to_stage, coalesce(lag(event_type) OVER (PARTITION BY user_id ORDER BY event_id), '') AS from_stage FROM events WHERE event_type IS NOT NULL)
    SELECT * FROM o WHERE NOT ((from_stage = '' AND to_stage IN ('click', 'view', 'purchase', 'signup')) OR (from_stage = 'view' AND to_stage IN ('view', 'click', 'signup')) OR (from_stage = 'click' AND to_stage IN ('view', 'click', 'purchase'))
        OR (from_stage = 'purchase' AND to_stage = 'view') OR (from_stage = 'signup' AND to_stage IN ('view', 'click')))"""
)
def stage_violations(s, d):
    """Z-02: steps of users that a stage machine does not allow."""
    e = table(s, d, "events", "event_id", "user_id", "event_type").select(F.col("user_id").cast("string").alias("session_id"), "event_id", F.col("event_type").alias("stage"))
    return visits.illegal_steps(e, "session_id", "event_id", "stage", _NEXT)


# ---------------------------------------------------------------- records under review


@query()
def record_quotes(s, d):
    """P-15: every quote of every envelope with its field."""
    return review.quotes_of(table(s, d, "extractions", "extraction_id", "raw_json"), "extraction_id", "raw_json")


@query(
    r""",
    q AS (SELECT session_id || ':' || turn_id AS quote_id, session_id, text AS quote FROM t WHERE regexp_matches(text, '[^\s]')),
    f AS (SELECT quote_id, quote, s.transcript_text AS tx FROM q JOIN s USING (session_id) WHERE contains(s.transcript_text, quote)),
    n AS (SELECT quote_id, quote, strpos(tx, quote) - 1 AS lo, strpos(substr(tx, strpos(tx, quote) + 1), quote) AS again FROM f)
    SELECT quote_id, CAST(lo AS INTEGER) AS char_offset, CAST(lo + length(quote) AS INTEGER) AS char_end FROM n WHERE again = 0"""
)
def single_spans(s, d):
    """P-27: turns whose text occurs exactly once in their session's transcript."""
    q = latest_turns(s, d).select(F.concat_ws(":", "session_id", F.col("turn_id").cast("string")).alias("quote_id"), "session_id", "text")
    return spans.only_spans(spans.find_spans(q, latest_sessions(s, d), "quote_id", "session_id", "text", "transcript_text"))


@query(
    """,
    q AS (SELECT session_id, turn_id, char_start, text, substr(text, 1, 20) AS head FROM t WHERE text IS NOT NULL)
    SELECT q.session_id, q.turn_id, coalesce(substr(s.transcript_text, char_start + 1, length(q.text)) = q.text, false) AS holds, trim(regexp_replace(lower(head), '[^a-z0-9]+', '-', 'g'), '-') AS slug
    FROM q JOIN s USING (session_id)"""
)
def span_checks(s, d):
    """F-11, X-15: whether each turn still is its slice of the transcript, and a slug of its beginning."""
    t = latest_turns(s, d).where("text is not null").join(latest_sessions(s, d).select("session_id", "transcript_text"), "session_id")
    return t.select("session_id", "turn_id", review.still_there(F.col("transcript_text"), F.col("char_start"), F.col("text")).alias("holds"), review.slug(F.left("text", F.lit(20))).alias("slug"))


@query(
    """
    WITH e AS (SELECT DISTINCT * FROM med_entries)
    SELECT session_id, item_id, arg_max(entry_id, (entered_at, entry_id)) AS entry_id, arg_max(status, (entered_at, entry_id)) FILTER (true) AS status
    FROM (SELECT session_id, item_id, entry_id, coalesce(status, '') AS status, entered_at FROM e WHERE entered_at IS NOT NULL) GROUP BY 1, 2"""
)
def latest_reviews(s, d):
    """P-25: of every item of a session what a reviewer entered last."""
    e = table(s, d, "med_entries", "session_id", "item_id", "entry_id", "status", "entered_at").where("entered_at is not null").distinct()
    rows = e.select("session_id", "item_id", F.struct("entered_at", "entry_id").alias("at"), "entry_id", F.coalesce("status", F.lit("")).alias("status"))
    return review.latest_edits(rows, ["session_id", "item_id"], "at").drop("at")


@query(
    """
    WITH e AS (SELECT DISTINCT session_id, entry_id, item_id, status FROM med_entries WHERE session_id IS NOT NULL),
    r AS (SELECT *, CASE WHEN status = 'confirmed' THEN 0 WHEN item_id IS NOT NULL AND status IS NULL THEN 1 ELSE 2 END AS rank FROM e)
    SELECT session_id, entry_id, CAST(rank AS INTEGER) AS rank, CAST(row_number() OVER (PARTITION BY session_id ORDER BY rank, entry_id) AS INTEGER) AS place FROM r"""
)
def review_places(s, d):
    """T-07: entries of a session in the order of review, stable within a rank."""
    from pyspark.sql import Window

    e = table(s, d, "med_entries", "session_id", "entry_id", "item_id", "status").where("session_id is not null").distinct()
    blocking = F.when(F.col("status") == "confirmed", "blocking")
    ranked = e.withColumn("rank", review.review_order(blocking, F.col("item_id").isNotNull() & F.col("status").isNull()))
    # one session's review list is what a reader sees at once
    return ranked.select("session_id", "entry_id", "rank", F.row_number().over(Window.partitionBy("session_id").orderBy("rank", "entry_id")).alias("place"))


# ---------------------------------------------------------------- concepts, labels, search


@query(
    """
    WITH n AS (SELECT rxcui, arg_min(struct_pack(tty := tty, str := str, key := key, salt_key := salt_key), (CASE tty WHEN 'IN' THEN 0 WHEN 'PIN' THEN 1 WHEN 'BN' THEN 2 WHEN 'SY' THEN 6 ELSE 99 END, length(str), str)) AS x FROM name_index WHERE rxcui IS NOT NULL GROUP BY 1),
    r AS (SELECT rxcui, x.str AS str, x.salt_key AS salt_key FROM n WHERE x.tty = 'IN'),
    p AS (SELECT DISTINCT rxcui, str, lower(trim(ingredient_key)) AS own, lower(trim(dose_form)) AS form, regexp_extract(str, '([0-9]+(\\.[0-9]+)?\\s*(MG|MCG|ML|G|UNT)\\b)', 1) AS st FROM product)
    SELECT r.rxcui, r.str AS canonical_name, coalesce(array_to_string(list_sort(list(DISTINCT nullif(form, '')) FILTER (nullif(form, '') IS NOT NULL)), ','), '') AS dose_forms,
           coalesce(array_to_string(list_sort(list(DISTINCT nullif(st, '')) FILTER (nullif(st, '') IS NOT NULL)), ','), '') AS strengths
    FROM r LEFT JOIN p ON p.own = r.salt_key AND p.own <> '' GROUP BY 1, 2""".replace("\\\\", "\\")
)
def ingredient_facts(s, d):
    """Section 2.10, J-16, U-07: dose forms and strengths marketed of every ingredient."""
    facts = resolve.concept_facts(table(s, d, "name_index"), table(s, d, "product"))
    return facts.where("tty = 'IN'").select("rxcui", "canonical_name", F.array_join("dose_forms", ",").alias("dose_forms"), F.array_join("strengths", ",").alias("strengths"))


@query()
def concept_facts(s, d):
    """Section 2.10: what is known of every code: names, ingredients, brands, salts, forms, strengths."""
    return resolve.concept_facts(table(s, d, "name_index"), table(s, d, "product"))


@query()
def name_candidates(s, d):
    """T-02: the candidates of typed names that are not resolved, or of those next to the one resolved."""
    rows = table(s, d, "med_entries", "entry_id", "canonical_name").where("entry_id is not null")
    found = resolve.resolve_mentions(rows, "entry_id", "canonical_name", table(s, d, "name_index"), table(s, d, "product", "rxcui", "tty", "ingredient_key").distinct())
    return found.select("mention_id", "status", F.posexplode("candidates").alias("rank", "c")).select("mention_id", "status", "rank", "c.*")


@query(
    """
    WITH p AS (SELECT rxcui, min(trim(regexp_replace(lower(ingredient_key), '[^a-z0-9/ -]', '', 'g'))) AS ing FROM product GROUP BY 1),
    o AS (SELECT ing, rxcui, CAST(row_number() OVER (PARTITION BY ing ORDER BY rxcui) - 1 AS INTEGER) AS pos FROM p WHERE ing <> '')
    SELECT ing AS mention_id, pos, 'spl-' || rxcui AS spl_set_id, rxcui AS label FROM o WHERE pos < 50"""
)
def label_links(s, d):
    """J-16, J-17, U-07, T-10: labels of each ingredient by set id, in a stated order, the first fifty."""
    p = table(s, d, "product", "rxcui", "ingredient_key").groupBy("rxcui").agg(F.min(F.trim(F.regexp_replace(F.lower("ingredient_key"), "[^a-z0-9/ -]", ""))).alias("ing")).where("ing <> ''")
    spl = F.concat(F.lit("spl-"), "rxcui")
    resolutions = p.groupBy(F.col("ing").alias("mention_id")).agg(F.sort_array(F.collect_set(spl)).alias("product_ids")).withColumn("own_ids", F.slice("product_ids", 1, 1))
    return search.labels_of(resolutions, p.select(spl.alias("spl_set_id"), F.col("rxcui").alias("label"))).select("mention_id", "pos", "spl_set_id", "label")


@query()
def stemmed_search(s, d):
    """J-18: documents about bridges and repairs, whatever the words' endings, with the place of the first hit."""
    return search.search_words(search.inverted_index(table(s, d, "documents", "doc_id", "text"), "doc_id", "text"), ["bridges", "repairing"])


# ---------------------------------------------------------------- source rows and wording


@query(
    """,
    z AS (SELECT session_id, word_idx, trim(text) AS text, round(end_s - start_s, 3) AS length_s FROM w WHERE trim(text) <> '')
    SELECT * FROM z"""
)
def recognised_words(s, d):
    """S-12: words of the recogniser, trimmed, without blank ones."""
    return latest_words(s, d).where("trim(text) <> ''").select("session_id", "word_idx", F.trim("text").alias("text"), F.round(F.col("end_s") - F.col("start_s"), 3).alias("length_s"))


@query(
    """,
    i AS (SELECT session_id, turn_id, start_s, end_s FROM t WHERE end_s - start_s >= 2.0)
    SELECT session_id, turn_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY start_s, turn_id) - 1 AS BIGINT) AS interval_idx FROM i"""
)
def long_intervals(s, d):
    """S-13: intervals of two seconds at least, numbered by their start."""
    rows = latest_turns(s, d).where("end_s - start_s >= 2.0").select("session_id", "turn_id", "start_s").withColumn("one", F.lit(1.0))
    return annotate(rows, "session_id", ["start_s", "turn_id"], sums=["one"]).select("session_id", "turn_id", F.col("before_one").cast("bigint").alias("interval_idx"))


@query(
    """,
    c AS (SELECT session_id, try_cast(regexp_extract(speaker_cluster, '([0-9]{1,6})[^0-9]*$', 1) AS INTEGER) AS speaker, round(sum(CASE WHEN end_s > start_s THEN end_s - start_s ELSE 0 END), 6) AS speech FROM t GROUP BY 1, 2),
    k AS (SELECT session_id, arg_max(speaker, (speech, -speaker)) AS chosen FROM c WHERE speaker IS NOT NULL GROUP BY 1)
    SELECT c.session_id, c.speaker, CASE WHEN c.speaker = k.chosen THEN 'clinician' ELSE 'other' END AS role FROM c JOIN k USING (session_id) WHERE c.speaker IS NOT NULL"""
)
def role_override(s, d):
    """R-19: the chosen speaker of a session is the clinician, all others are not; here the one who speaks longest is chosen."""
    speaker = F.expr("try_cast(regexp_extract(speaker_cluster, '([0-9]{1,6})[^0-9]*$', 1) as int)")
    length = F.when(F.col("end_s") > F.col("start_s"), F.col("end_s") - F.col("start_s")).otherwise(0.0)
    speech = latest_turns(s, d).groupBy("session_id", speaker.alias("speaker")).agg(F.round(F.sum(length), 6).alias("speech")).where("speaker is not null")
    chosen = speech.groupBy("session_id").agg(F.max_by("speaker", F.struct("speech", F.negative("speaker"))).alias("chosen"))
    return review.override_roles(speech, chosen).select("session_id", "speaker", "role")


@query(
    """
    WITH e AS (SELECT DISTINCT session_id, item_id, entry_id, canonical_name FROM med_entries),
    r AS (SELECT session_id, item_id, arg_max(coalesce(status, ''), (entered_at, entry_id)) AS status FROM (SELECT DISTINCT * FROM med_entries) WHERE entered_at IS NOT NULL GROUP BY 1, 2)
    SELECT e.session_id, e.item_id, e.entry_id, coalesce(r.status, 'none') AS status, trim(coalesce(canonical_name, '')) <> '' AND coalesce(r.status, '') = 'confirmed' AS printable FROM e LEFT JOIN r ON e.session_id = r.session_id AND e.item_id = r.item_id"""
)
def printable_items(s, d):
    """F-09, J-23: entered items with what reviewers decided on them, and whether they may be printed: named and confirmed."""
    e = table(s, d, "med_entries", "session_id", "item_id", "entry_id", "canonical_name").distinct()
    met = e.join(latest_reviews(s, d).select("session_id", "item_id", "status"), ["session_id", "item_id"], "left")
    named = F.trim(F.coalesce("canonical_name", F.lit(""))) != ""
    return met.select("session_id", "item_id", "entry_id", F.coalesce("status", F.lit("none")).alias("status"), (named & (F.coalesce("status", F.lit("")) == "confirmed")).alias("printable"))


@query(
    r""",
    x AS (SELECT session_id, turn_id, list_filter(string_split_regex(trim(text), '\s+'), lambda w: w <> '') AS ws FROM t WHERE text IS NOT NULL)
    SELECT session_id, turn_id, array_to_string(ws[1:8], ' ') || CASE WHEN len(ws) > 8 THEN '…' ELSE '' END AS title FROM x"""
)
def turn_titles(s, d):
    """X-19: the first eight words of a turn as its title."""
    return latest_turns(s, d).where("text is not null").select("session_id", "turn_id", review.short_title(F.col("text")).alias("title"))


@query(
    r"""
    WITH p AS (SELECT DISTINCT regexp_extract(str, '([0-9]+(?:\.[0-9]+)?)\s*(MG|MCG|ML|G|UNT)\b', 1) AS a, lower(regexp_extract(str, '([0-9]+(?:\.[0-9]+)?)\s*(MG|MCG|ML|G|UNT)\b', 2)) AS u FROM product)
    SELECT a AS amount, u AS unit, printf('%g', CAST(a AS DOUBLE) / 3) || ' ' || u AS third FROM p WHERE a <> ''"""
)
def dose_wording(s, d):
    """X-18: amounts as they are printed, six figures at most: here a third of every strength."""
    amount, unit = (F.regexp_extract("str", r"([0-9]+(?:\.[0-9]+)?)\s*(MG|MCG|ML|G|UNT)\b", k) for k in (1, 2))
    p = table(s, d, "product", "str").select(amount.alias("amount"), F.lower(unit).alias("unit")).where("amount <> ''").distinct()
    return p.select("amount", "unit", review.amount_text(F.col("amount").cast("double") / 3, F.col("unit")).alias("third"))


@query("SELECT DISTINCT session_id, strftime(visit_date, '%A, %B %-d') AS said FROM sessions WHERE visit_date IS NOT NULL")
def visit_days(s, d):
    """D-11: the day of each visit as it is said."""
    return table(s, d, "sessions", "session_id", "visit_date").where("visit_date is not null").select("session_id", F.date_format("visit_date", "EEEE, MMMM d").alias("said")).distinct()


@query(
    """,
    q AS (SELECT session_id, turn_id, start_s, end_s FROM t WHERE end_s > start_s)
    SELECT session_id, turn_id, printf('#t=%.3f,%.3f', start_s, end_s) AS fragment FROM q"""
)
def turn_fragments(s, d):
    """P-24: each turn as a fragment of its recording."""
    return latest_turns(s, d).where("end_s > start_s").select("session_id", "turn_id", review.media_fragment(F.col("start_s"), F.col("end_s")).alias("fragment"))
