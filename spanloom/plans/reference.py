
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.functions import dates, dosing, names, similarity
from spanloom.operators import mentions, resolve, review, search, spans, visits, vocabulary, voices
from spanloom.operators.dewey import ancestor, dewey_nodes, once
from spanloom.operators.extraction import item_mentions, item_states
from spanloom.operators.rangescan import annotate
from spanloom.session import shuffle_partitions, table
from spanloom.sources import transcripts
from spanloom.streaming import retention

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def with_latest(sql: str) -> str:
    """``sql``, led by the latest deliveries if it goes on with a comma."""
    return _COMMON + sql if sql.lstrip().startswith(",") else sql


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = with_latest(sql)
        return f

    return register


# one row per key: what was delivered last
_COMMON = """
    WITH s AS (SELECT * FROM sessions QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY received_at DESC) = 1),
    t AS (SELECT * FROM turns QUALIFY row_number() OVER (PARTITION BY session_id, turn_id ORDER BY received_at DESC) = 1),
    w AS (SELECT * FROM words QUALIFY row_number() OVER (PARTITION BY session_id, word_idx ORDER BY received_at DESC) = 1)"""
_NO = "try_cast(regexp_extract({}, '([0-9]{{1,6}})[^0-9]*$', 1) AS INTEGER)"


def _sessions(s, d):
    return visits.latest(table(s, d, "sessions"), ["session_id"], "received_at")


def _turns(s, d):
    return visits.latest(table(s, d, "turns"), ["session_id", "turn_id"], "received_at")


def _words(s, d):
    return visits.latest(table(s, d, "words"), ["session_id", "word_idx"], "received_at")


latest_sessions, latest_turns, latest_words = _sessions, _turns, _words


def _speaker(c: str):
    return F.expr(f"try_cast(regexp_extract({c}, '([0-9]{{1,6}})[^0-9]*$', 1) as int)")


# ---------------------------------------------------------------- transcripts


@query(
    """,
    wt AS (SELECT w.*, s.transcript_text FROM w JOIN s USING (session_id)),
    tt AS (SELECT t.*, s.transcript_text FROM t JOIN s USING (session_id)),
    broken AS (
        SELECT 'word offset does not index the transcript' AS rule, session_id FROM wt WHERE substr(transcript_text, char_offset + 1, length(text)) <> text
        UNION ALL SELECT 'turn text is not its slice', session_id FROM tt WHERE substr(transcript_text, char_start + 1, char_end - char_start) <> text
        UNION ALL SELECT 'turn length differs from its span', session_id FROM t WHERE char_end - char_start <> length(text)
        UNION ALL SELECT 'word outside its turn', w.session_id FROM w JOIN t USING (session_id, turn_id) WHERE t.end_s > t.start_s AND (w.start_s < t.start_s OR w.end_s > t.end_s)
        UNION ALL SELECT 'word interval invalid', session_id FROM w WHERE end_s < start_s OR start_s < 0
        UNION ALL SELECT 'word of no length', session_id FROM w WHERE end_s = start_s
        UNION ALL SELECT 'word probability missing or out of range', session_id FROM w WHERE probability IS NULL OR probability < 0 OR probability > 1
        UNION ALL SELECT 'turn interval missing or invalid', session_id FROM t WHERE start_s IS NULL OR end_s IS NULL OR end_s <= start_s
        UNION ALL SELECT 'no consent', session_id FROM s WHERE consent IS NULL OR consent.obtained IS NULL OR NOT consent.obtained
        UNION ALL SELECT 'no audio', session_id FROM s WHERE audio_path IS NULL
        UNION ALL SELECT 'audio outside its session', session_id FROM s WHERE NOT starts_with(audio_path, session_dir || '/') OR contains(audio_path, '..') OR starts_with(audio_path, '/') <> starts_with(session_dir, '/'))
    SELECT rule, count(*) AS n_rows, count(DISTINCT session_id) AS n_sessions FROM broken GROUP BY rule"""
)
def contract_violations(s, d):
    """F-12, F-13, P-26: rows that break a rule of the data model."""
    sessions = table(s, d, "sessions", "session_id", "session_dir", "audio_path", "transcript_text", "consent", "received_at")
    turns = table(s, d, "turns", "session_id", "turn_id", "start_s", "end_s", "text", "char_start", "char_end", "received_at")
    words = table(s, d, "words", "session_id", "turn_id", "word_idx", "text", "start_s", "end_s", "probability", "char_offset", "received_at")
    keyed = (sessions, ["session_id"]), (turns, ["session_id", "turn_id"]), (words, ["session_id", "word_idx"])
    return visits.violations(*(visits.latest_rows(df, keys, "received_at") for df, keys in keyed))


@query(
    """,
    o AS (SELECT session_id, turn_id, char_start AS stored, length(text) AS n, CAST(coalesce(sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS lo FROM t)
    SELECT session_id, turn_id, lo AS char_start, lo + n AS char_end, lo = stored AS agrees FROM o"""
)
def turn_offsets(s, d):
    """W-02: running character offsets of turns joined by one blank."""
    return visits.turn_offsets(_turns(s, d).select("session_id", "turn_id", "text", "char_start"))


@query(
    f""",
    l AS (SELECT session_id, word_idx, text, {_NO.format("speaker_cluster")} AS label FROM w),
    m AS (SELECT *, CASE WHEN row_number() OVER o = 1 OR label IS DISTINCT FROM lag(label) OVER o THEN 1 ELSE 0 END AS new,
                 coalesce(sum(length(text) + 1) OVER (PARTITION BY session_id ORDER BY word_idx ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS lo FROM l WINDOW o AS (PARTITION BY session_id ORDER BY word_idx)),
    g AS (SELECT *, sum(new) OVER (PARTITION BY session_id ORDER BY word_idx ROWS UNBOUNDED PRECEDING) - 1 AS turn_no FROM m)
    SELECT session_id, CAST(turn_no AS BIGINT) AS turn_no, coalesce(any_value(label), -1) AS label, count(*) AS n_words, min(word_idx) AS first_word_idx, max(word_idx) AS last_word_idx,
           CAST(min(lo) AS BIGINT) AS char_start, CAST(max(lo + length(text)) AS BIGINT) AS char_end
    FROM g GROUP BY session_id, turn_no"""
)
def turn_islands(s, d):
    """W-01: turns built from contiguous words of one speaker."""
    return visits.build_turns(_words(s, d), _speaker("speaker_cluster")).withColumn("label", F.coalesce("label", F.lit(-1)))


@query(
    r""",
    x AS (SELECT session_id, turn_id, string_split_regex(trim(text), '\s+') AS ws FROM t),
    e AS (SELECT session_id, turn_id, unnest(ws) AS word, unnest(range(len(ws))) AS pos FROM x),
    k AS (SELECT *, greatest(length(word) / 13.0::DOUBLE, 0.12) AS took, CASE WHEN pos = 0 THEN 0.35 ELSE 0 END AS pause FROM e WHERE word <> ''),
    r AS (SELECT *, sum(took + pause) OVER (PARTITION BY session_id ORDER BY turn_id, pos ROWS UNBOUNDED PRECEDING) - 0.35 AS stop FROM k),
    b AS (SELECT session_id, turn_id, count(*) AS n_words, round(max(stop) + 1e-6, 2) AS end_s FROM r GROUP BY session_id, turn_id)
    SELECT * FROM b"""
)
def running_clock(s, d):
    """W-03: synthetic times, summed up per turn."""
    clock = visits.synthetic_clock(_turns(s, d).select("session_id", "turn_id", "text"))
    return clock.groupBy("session_id", "turn_id").agg(F.count("*").alias("n_words"), F.round(F.max("end_s") + 1e-6, 2).alias("end_s"))


@query(
    """,
    p AS (SELECT session_id, word_idx, start_s, end_s FROM w),
    i AS (SELECT session_id, turn_id AS interval_id, start_s AS lo, end_s AS hi FROM t WHERE start_s IS NOT NULL AND end_s > start_s),
    m AS (SELECT p.session_id, p.word_idx, i.interval_id, least(p.end_s, hi) - greatest(p.start_s, lo) AS overlap, lo
          FROM p JOIN i ON p.session_id = i.session_id AND p.start_s < i.hi AND p.end_s > i.lo WHERE p.end_s > p.start_s),
    b AS (SELECT * FROM m QUALIFY row_number() OVER (PARTITION BY session_id, word_idx ORDER BY round(overlap, 6) DESC, lo, interval_id) = 1)
    SELECT p.session_id, p.word_idx, coalesce(b.interval_id, -1) AS interval_id, round(coalesce(b.overlap, 0), 3) AS overlap_s FROM p LEFT JOIN b USING (session_id, word_idx)"""
)
def interval_assign(s, d):
    """J-01: each word to the interval that it overlaps most; J-02: -1 where none does."""
    intervals = _turns(s, d).select("session_id", F.col("turn_id").alias("interval_id"), "start_s", "end_s")
    return visits.assign_intervals(_words(s, d), intervals, ["word_idx"]).fillna(-1, ["interval_id"]).fillna(0.0, ["overlap_s"])


@query(
    """
    SELECT coalesce(reason, 'none given') AS reason, count(*) AS n_words, count(DISTINCT session_id) AS n_sessions, round(avg(probability), 6) AS mean_probability
    FROM (SELECT DISTINCT * FROM dropped_words) GROUP BY ALL"""
)
def drop_reasons(s, d):
    """J-02, S-18: words that never reached the transcript, by reason."""
    rows = table(s, d, "dropped_words").distinct()
    return rows.groupBy(F.coalesce("reason", F.lit("none given")).alias("reason")).agg(F.count("*").alias("n_words"), F.count_distinct("session_id").alias("n_sessions"), F.round(F.avg("probability"), 6).alias("mean_probability"))


@query(
    f""",
    r AS (SELECT session_id, {_NO.format("speaker_cluster")} AS speaker, CASE WHEN lower(trim(role)) IN ('clinician', 'doctor', 'dr', 'physician') THEN 'clinician' WHEN lower(trim(role)) IN ('other', 'pt', 'patient', 'family') THEN 'other' END AS role, end_s - start_s AS s FROM t)
    SELECT session_id, speaker, CASE WHEN count(role) FILTER (role = 'clinician') > count(role) FILTER (role = 'other') THEN 'clinician' WHEN count(role) > 0 THEN 'other' ELSE 'unknown' END AS role,
           count(*) AS n_turns, round(sum(CASE WHEN s > 0 THEN s ELSE 0 END), 3) AS speech_s
    FROM r WHERE speaker IS NOT NULL GROUP BY session_id, speaker"""
)
def speaker_roles(s, d):
    """J-03, F-03, A-08, R-19: role and total speech of each speaker of a session."""
    low = F.lower(F.trim("role"))
    kind = F.when(low.isin("clinician", "doctor", "dr", "physician"), "clinician").when(low.isin("other", "pt", "patient", "family"), "other")
    rows = _turns(s, d).select("session_id", _speaker("speaker_cluster").alias("speaker"), kind.alias("k"), (F.col("end_s") - F.col("start_s")).alias("s")).where("speaker is not null")
    clinician, other = F.count_if(F.col("k") == "clinician"), F.count_if(F.col("k") == "other")
    return rows.groupBy("session_id", "speaker").agg(
        F.when(clinician > other, "clinician").when(clinician + other > 0, "other").otherwise("unknown").alias("role"), F.count("*").alias("n_turns"), F.round(F.sum(F.when(F.col("s") > 0, F.col("s")).otherwise(0.0)), 3).alias("speech_s")
    )


@query(
    """,
    p AS (SELECT session_id, word_idx AS probe_id, char_offset FROM w),
    h AS (SELECT p.*, t.turn_id, p.char_offset < t.char_end AS inside FROM p ASOF LEFT JOIN t ON p.session_id = t.session_id AND p.char_offset >= t.char_start),
    n AS (SELECT p.session_id, p.probe_id, t.turn_id AS next_id FROM p ASOF LEFT JOIN t ON p.session_id = t.session_id AND p.char_offset < t.char_start)
    SELECT h.session_id, h.probe_id, h.char_offset, CASE WHEN h.inside THEN h.turn_id ELSE coalesce(n.next_id, h.turn_id) END AS turn_id, coalesce(h.inside, false) AS inside
    FROM h JOIN n USING (session_id, probe_id)"""
)
def turn_at_offset(s, d):
    """J-04, J-05: the turn that holds a word's offset, or the next one."""
    probes = _words(s, d).select("session_id", F.col("word_idx").alias("probe_id"), "char_offset")
    return visits.turn_at(probes, _turns(s, d)).withColumn("inside", F.coalesce("inside", F.lit(False)))


@query(""", c AS (SELECT session_id, turn_id, list(turn_id) OVER (PARTITION BY session_id ORDER BY turn_id ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING) AS ids FROM t)
    SELECT session_id, turn_id, array_to_string(ids, ',') AS context_ids FROM c""")
def context_window(s, d):
    """F-14: the two turns to either side of each turn."""
    return visits.context_window(_turns(s, d).select("session_id", "turn_id"))


@query(
    r""",
    f AS (SELECT session_id, turn_id, word_idx, probability, regexp_matches(text, '\b[0-9]+(\.[0-9]+)?') AS numeral FROM w)
    SELECT session_id, count(*) AS n_words, count(*) FILTER (numeral) AS n_numerals, count(*) FILTER (probability < CASE WHEN numeral THEN 0.80 ELSE 0.55 END) AS n_doubtful FROM f GROUP BY session_id"""
)
def low_confidence(s, d):
    """F-06, F-08, R-02: words below the confidence that their kind asks for."""
    numeral = F.col("text").rlike(r"\b\d+(\.\d+)?")
    doubtful = F.col("probability") < F.when(numeral, 0.80).otherwise(0.55)
    return _words(s, d).groupBy("session_id").agg(F.count("*").alias("n_words"), F.count_if(numeral).alias("n_numerals"), F.count_if(doubtful).alias("n_doubtful"))


@query(
    """
    SELECT session_id, count(*) AS n_deliveries, count(DISTINCT md5(coalesce(transcript_text, ''))) AS n_texts, CAST(epoch(max(received_at)) - epoch(min(received_at)) AS BIGINT) AS spread_s
    FROM sessions GROUP BY session_id HAVING count(*) > 1"""
)
def session_deliveries(s, d):
    """A-18: sessions delivered more than once, and whether their texts differ."""
    at = F.unix_timestamp("received_at")
    return table(s, d, "sessions").groupBy("session_id").agg(F.count("*").alias("n_deliveries"), F.count_distinct(F.md5(F.coalesce("transcript_text", F.lit("")))).alias("n_texts"), (F.max(at) - F.min(at)).alias("spread_s")).where("n_deliveries > 1")


@query(
    r""",
    x AS (SELECT session_id, turn_id, CASE WHEN lower(trim(role)) IN ('clinician', 'doctor', 'dr', 'physician') THEN 'clinician' ELSE 'other' END AS role,
                 replace(replace(translate(regexp_replace(text, '[\r\n]+', ' ', 'g'), '‘’“”–—', '''''""--'), '…', '...'), chr(160), ' ') AS plain FROM t WHERE text IS NOT NULL AND trim(text) <> ''),
    y AS (SELECT session_id, turn_id, role, trim(regexp_replace(regexp_replace(plain, '\*\([^)]*\)\*', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM x)
    SELECT session_id, CAST(row_number() OVER (PARTITION BY session_id ORDER BY turn_id) - 1 AS INTEGER) AS turn_id, role, text FROM y"""
)
def script_turns(s, d):
    """S-10, X-16, P-22: turns read back from role-play scripts written from the turns."""
    rows = _turns(s, d).where("text is not null and trim(text) <> ''")
    label = F.when(F.lower(F.trim("role")).isin("clinician", "doctor", "dr", "physician"), "DR").otherwise("PT")
    said = rows.select("session_id", (F.col("turn_id") * 3 + 1).alias("line_no"), F.concat(F.lit("**"), label, F.lit(":** "), F.regexp_replace("text", r"[\r\n]+", " ")).alias("raw"))
    blank = rows.select("session_id", (F.col("turn_id") * 3 + 2).alias("line_no"), F.lit("").alias("raw"))
    head = rows.select("session_id").distinct().select("session_id", F.lit(-1).alias("line_no"), F.lit("## Script").alias("raw"))
    return transcripts.parse_script(said.unionByName(blank).unionByName(head)).drop("label")


# ---------------------------------------------------------------- evidence spans


def _quotes(s, d):
    return table(s, d, "med_entries", "entry_id", "session_id", "canonical_name").distinct()


@query(
    """,
    q AS (SELECT DISTINCT entry_id, session_id, canonical_name AS quote FROM med_entries),
    f AS (SELECT q.*, s.transcript_text AS tx, CASE WHEN quote IS NULL OR trim(quote) = '' THEN 'empty' WHEN contains(s.transcript_text, quote) THEN 'exact' ELSE 'missing' END AS m FROM q LEFT JOIN s USING (session_id)),
    h AS (SELECT entry_id, unnest(list_filter(range(length(tx) - length(quote) + 1), lambda i: substr(tx, i + 1, length(quote)) = quote)) AS lo, length(quote) AS n FROM f WHERE m = 'exact')
    SELECT entry_id, CAST(lo AS INTEGER) AS char_offset, CAST(lo + n AS INTEGER) AS char_end FROM h"""
)
def span_occurrences(s, d):
    """J-08: every verbatim occurrence of each entered name in its session."""
    found = spans.find_spans(_quotes(s, d), _sessions(s, d), "entry_id", "session_id", "canonical_name", "transcript_text")
    return found.where("match = 'exact'").select(F.col("quote_id").alias("entry_id"), "char_offset", "char_end")


@query(
    r""",
    q AS (SELECT DISTINCT entry_id, session_id, canonical_name AS quote FROM med_entries),
    p AS (SELECT q.*, s.transcript_text AS tx, array_to_string(list_transform(string_split_regex(trim(quote), '\s+'), lambda w: regexp_escape(w)), '\s+') AS pat FROM q LEFT JOIN s USING (session_id)),
    m AS (SELECT entry_id, CASE WHEN quote IS NULL OR NOT regexp_matches(quote, '[^\s\p{Z}]') THEN 'empty' WHEN contains(tx, quote) THEN 'exact' WHEN regexp_matches(tx, pat) THEN 'relaxed' ELSE 'missing' END AS m FROM p),
    c AS (SELECT count(*) FILTER (m = 'exact') AS n_exact, count(*) FILTER (m = 'relaxed') AS n_relaxed, count(*) FILTER (m = 'missing') AS n_discarded, count(*) FILTER (m = 'empty') AS n_empty FROM m)
    SELECT *, round((n_exact + n_relaxed) / (n_exact + n_relaxed + n_discarded), 6) AS fidelity FROM c"""
)
def span_fidelity(s, d):
    """A-16, R-01, F-04, J-09: entered names found in their session, exactly or but for blanks, or discarded."""
    return spans.fidelity(spans.find_spans(_quotes(s, d), _sessions(s, d), "entry_id", "session_id", "canonical_name", "transcript_text"))


@query()
def span_nearest(s, d):
    """W-04: of several occurrences of an entered name the one nearest to the middle turn of its session."""
    found = spans.find_spans(_quotes(s, d), _sessions(s, d), "entry_id", "session_id", "canonical_name", "transcript_text")
    middle = _turns(s, d).groupBy("session_id").agg(F.expr("percentile_disc(0.5) within group (order by char_start)").alias("char_start"))
    hint = _quotes(s, d).join(_turns(s, d).join(middle, ["session_id", "char_start"], "left_semi"), "session_id").select(F.col("entry_id").alias("quote_id"), "char_start", "char_end")
    return spans.nearest_spans(found, hint)


@query(
    """,
    q AS (SELECT session_id, turn_id, session_id || ':' || turn_id AS quote_id, char_start AS lo, char_start + least(40, length(text)) AS hi FROM t),
    m AS (SELECT q.quote_id, w.char_offset, w.start_s, w.probability FROM q JOIN w USING (session_id, turn_id) WHERE w.char_offset < q.hi AND w.char_offset + length(w.text) > q.lo),
    a AS (SELECT quote_id, arg_min(start_s, char_offset) AS audio_start, min(probability) AS p FROM m GROUP BY quote_id)
    SELECT q.quote_id, q.session_id, q.turn_id, a.audio_start, coalesce(a.p, 1.0) AS min_probability FROM q LEFT JOIN a USING (quote_id)"""
)
def span_min_probability(s, d):
    """J-06: least word probability under the opening forty characters of each turn."""
    q = _turns(s, d).select("session_id", "turn_id", F.concat_ws(":", "session_id", F.col("turn_id").cast("string")).alias("quote_id"), F.col("char_start").alias("char_offset"), (F.col("char_start") + F.least(F.lit(40), F.length("text"))).alias("char_end"))
    return visits.word_probability(q, _words(s, d))


@query(
    """,
    q AS (SELECT session_id, turn_id, session_id || ':' || turn_id AS quote_id, char_start AS lo, char_end AS hi FROM t),
    m AS (SELECT q.quote_id, w.char_offset, w.start_s, w.probability FROM q JOIN w USING (session_id, turn_id) WHERE w.char_offset < q.hi AND w.char_offset + length(w.text) > q.lo),
    a AS (SELECT quote_id, arg_min(start_s, char_offset) AS audio_start, min(probability) AS p FROM m GROUP BY quote_id)
    SELECT q.quote_id, q.session_id, q.turn_id, a.audio_start, coalesce(a.p, 1.0) AS min_probability FROM q LEFT JOIN a USING (quote_id)"""
)
def turn_min_probability(s, d):
    """J-06: least word probability under each turn, all of it (``span_min_probability`` stops after forty characters, as its SQL does)."""
    q = _turns(s, d).select("session_id", "turn_id", F.concat_ws(":", "session_id", F.col("turn_id").cast("string")).alias("quote_id"), F.col("char_start").alias("char_offset"), "char_end")
    return visits.word_probability(q, _words(s, d))


@query(
    """,
    q AS (SELECT session_id, session_id || ':' || turn_id AS quote_id, char_start AS lo, char_end AS hi FROM t WHERE char_end > char_start),
    m AS (SELECT q.quote_id, w.start_s, w.end_s, coalesce(w.probability, 1.0) AS p, w.char_offset AS o FROM q JOIN w ON q.session_id = w.session_id AND w.char_offset < q.hi AND w.char_offset + length(w.text) > q.lo),
    a AS (SELECT quote_id, arg_min(start_s, (p, o)) AS ws, arg_min(end_s, (p, o)) AS we, max(end_s) AS stop FROM m GROUP BY quote_id)
    SELECT quote_id, session_id, round(greatest(0.0, ws - 0.35), 3) AS cue_start_s, round(greatest(we + 0.25, least(stop, ws + 2.5)), 3) AS cue_end_s FROM q LEFT JOIN a USING (quote_id)"""
)
def quote_cues(s, d):
    """J-07, R-18: where to listen to each turn, at its least certain word."""
    q = _turns(s, d).where("char_end > char_start").select("session_id", F.concat_ws(":", "session_id", F.col("turn_id").cast("string")).alias("quote_id"), F.col("char_start").alias("char_offset"), "char_end")
    return visits.word_cue(q, _words(s, d))


@query(
    """,
    l AS (SELECT session_id, list({'o': CAST(turn_id AS BIGINT), 'lo': start_s, 'hi': end_s} ORDER BY turn_id) AS x FROM t WHERE start_s IS NOT NULL AND end_s IS NOT NULL GROUP BY 1),
    k AS (SELECT session_id, list_reduce(list_transform(x, lambda e: [e]), lambda acc, e: CASE WHEN len(list_filter(acc, lambda y: e[1].lo < y.hi AND e[1].hi > y.lo)) > 0 THEN acc ELSE list_concat(acc, e) END) AS kept FROM l),
    u AS (SELECT session_id, unnest(kept) AS e FROM k)
    SELECT session_id, e.o AS turn_id, e.lo AS start_s, e.hi AS end_s FROM u"""
)
def span_overlap_dedup(s, d):
    """W-07: turns kept in order while they overlap no kept one in time."""
    rows = _turns(s, d).select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), "start_s", "end_s")
    return spans.drop_overlaps(rows, "session_id", "turn_id", "start_s", "end_s")


@query(
    """,
    h AS (SELECT session_id, char_start AS c_lo, char_end AS c_hi FROM t WHERE char_end > char_start QUALIFY row_number() OVER (PARTITION BY session_id ORDER BY char_start, turn_id) = (count(*) OVER (PARTITION BY session_id) + 1) // 2),
    o AS (SELECT session_id, unnest(list_filter(range(length(transcript_text) - 3), lambda i: substr(transcript_text, i + 1, 4) = ' the')) AS lo FROM s WHERE transcript_text IS NOT NULL),
    m AS (SELECT o.session_id, CAST(o.lo AS INTEGER) AS lo, o.lo BETWEEN h.c_lo AND h.c_hi - 1 AS inside, abs(o.lo - floor((h.c_lo + h.c_hi) / 2)) AS away FROM o JOIN h USING (session_id))
    SELECT session_id AS quote_id, arg_min(lo, (CASE WHEN inside THEN 0 ELSE 1 END, CASE WHEN inside THEN 0 ELSE away END, lo)) AS char_offset, bool_or(inside) AS inside, count(*) AS n_occurrences FROM m GROUP BY 1"""
)
def nearest_the(s, d):
    """W-04: of all places of a frequent word in a session the one nearest to its middle turn."""
    rows = _sessions(s, d)
    found = spans.find_spans(rows.select("session_id", F.col("session_id").alias("quote_id"), F.lit(" the").alias("quote")), rows, "quote_id", "session_id", "quote", "transcript_text")
    placed = _turns(s, d).where("char_end > char_start").select("session_id", "turn_id", "char_start", "char_end").withColumn("one", F.lit(1.0))
    numbered = annotate(placed, "session_id", ["char_start", "turn_id"], sums=["one"])
    size = numbered.groupBy("session_id").agg(F.count("*").alias("n"))
    middle = numbered.join(size, "session_id").where("before_one + 1 = (n + 1) div 2")
    return spans.nearest_spans(found, middle.select(F.col("session_id").alias("quote_id"), "char_start", "char_end")).drop("char_end")


@query(
    """,
    c AS (SELECT session_id, CAST(turn_id AS BIGINT) AS o, text AS x,
                 list_distinct(list_transform(list_filter(regexp_extract_all(lower(text), '[a-z]{3,}'), lambda w: NOT list_contains(["""
    + ", ".join("'" + w.replace("'", "''") + "'" for w in spans.STOP)
    + """], w)),
                     lambda w: regexp_replace(CASE WHEN length(w) > 6 THEN regexp_replace(w, 'ness$', '') ELSE w END, '^([a-z]{3,}?)(ing|ed|es|s)$', '\\1'))) AS w
          FROM t WHERE text IS NOT NULL AND lower(trim(role)) IN ('clinician', 'doctor', 'dr', 'physician', 'md')),
    l AS (SELECT session_id, list({'o': o, 't': x, 'w': w, 'n': 1} ORDER BY o) AS e FROM c GROUP BY 1),
    f AS (SELECT session_id, list_reduce(list_transform(e, lambda x: [x]), lambda acc, x:
            CASE WHEN len(list_filter(acc, lambda k: len(list_intersect(k.w, x[1].w)) >= 3 AND len(list_intersect(k.w, x[1].w)) >= 0.7 * least(len(k.w), len(x[1].w)))) > 0
            THEN list_transform(acc, lambda k, i: CASE WHEN i = list_position(list_transform(acc, lambda q: len(list_intersect(q.w, x[1].w)) >= 3 AND len(list_intersect(q.w, x[1].w)) >= 0.7 * least(len(q.w), len(x[1].w))), true)
                 THEN {'o': k.o, 't': CASE WHEN length(x[1].t) > length(k.t) THEN x[1].t ELSE k.t END, 'w': CASE WHEN length(x[1].t) > length(k.t) THEN x[1].w ELSE k.w END, 'n': k.n + 1} ELSE k END)
            ELSE list_concat(acc, x) END) AS kept FROM l),
    u AS (SELECT session_id, unnest(kept) AS r FROM f)
    SELECT session_id, r.o AS turn_id, r.t AS text, CAST(r.n AS INTEGER) AS n_merged FROM u"""
)
def restatements(s, d):
    """W-08, X-14: clinician turns, however the role is spelled, that restate an earlier one merge into it."""
    rows = _turns(s, d).where(visits.role_class("role") == "clinician").select("session_id", "turn_id", "text")
    return spans.merge_restatements(rows, "session_id", "turn_id", "text")


# ---------------------------------------------------------------- vocabulary


@query(
    """
    WITH c AS (SELECT DISTINCT upper(trim(tty)) AS tty, str FROM name_index UNION ALL SELECT DISTINCT upper(trim(tty)), str FROM product)
    SELECT tty, CASE WHEN tty IN ('IN', 'BN', 'PIN') OR (tty IN ('SY', 'TMSY') AND NOT regexp_matches(str, '[0-9]+\\s*(MG|ML|MCG|UNT|%|/)', 'i')) THEN 'name' WHEN tty IN ('SCD', 'SBD', 'PSN') THEN 'product' ELSE 'other' END AS target,
           count(*) AS n, count(*) FILTER (regexp_matches(str, '[0-9]+\\s*(MG|ML|MCG|UNT|%|/)', 'i')) AS n_with_dose
    FROM c GROUP BY ALL""".replace("\\\\", "\\")
)
def name_routing(s, d):
    """F-01, F-02, A-06: concepts routed to names and products by type, and doses among them."""
    both = table(s, d, "name_index", "tty", "str").select(F.upper(F.trim("tty")).alias("tty"), "str").distinct().unionByName(table(s, d, "product", "tty", "str").select(F.upper(F.trim("tty")).alias("tty"), "str").distinct())
    return vocabulary.route_names(both).groupBy("tty", "target").agg(F.count("*").alias("n"), F.count_if(names.has_dose(F.col("str"))).alias("n_with_dose"))


@query(
    """
    WITH p AS (SELECT DISTINCT rxcui, upper(trim(tty)) AS tty, ingredient_key FROM product),
    c AS (SELECT ingredient_key, count(*) AS product_count FROM p WHERE tty IN ('SCD', 'SBD') AND trim(ingredient_key) <> '' GROUP BY 1)
    SELECT ingredient_key, product_count, round(least(1.0, ln(1.0::DOUBLE + product_count) / ln(1.0::DOUBLE + max(product_count) OVER ())), 9) AS prior FROM c"""
)
def ingredient_freq(s, d):
    """A-01, A-02: products per ingredient, and the scaled prior."""
    return vocabulary.ingredient_frequency(table(s, d, "product", "rxcui", "tty", "ingredient_key").distinct())


@query(
    """
    WITH i AS (SELECT DISTINCT rxcui AS in_rxcui, key AS in_key FROM name_index WHERE tty = 'IN'),
    p AS (SELECT DISTINCT rxcui AS pin_rxcui, str AS pin_name, key AS pin_key, salt_key AS in_key FROM name_index WHERE tty = 'PIN'),
    j AS (SELECT in_rxcui, in_key, pin_rxcui, min(pin_name) AS pin_name FROM p JOIN i USING (in_key) WHERE pin_key <> in_key AND pin_key IN (SELECT lower(trim(ingredient_full_key)) FROM product) GROUP BY ALL)
    SELECT *, count(*) OVER (PARTITION BY in_rxcui) AS n_salts FROM j QUALIFY count(*) OVER (PARTITION BY in_rxcui) >= 2"""
)
def salt_pairs(s, d):
    """J-13, J-14, A-03, A-04: marketed salts of ingredients that have several."""
    return vocabulary.salt_pairs(table(s, d, "name_index").distinct(), table(s, d, "product", "ingredient_full_key"))


@query(
    r"""
    WITH b AS (SELECT DISTINCT rxcui, trim(str) AS str, regexp_extract(str, '\[([^\]]+)\]\s*$', 1) AS brand,
                      trim(regexp_replace(regexp_replace(regexp_replace(str, '\s*\[[^\]]*\]\s*$', ''), '^[0-9]+(\.[0-9]+)?\s+HR\s+', ''), '\s[0-9].*$', '')) AS ing FROM product),
    c AS (SELECT lower(brand) AS brand_key, lower(ing) AS ingredient_key, arg_min(brand, (rxcui, brand)) AS brand_name, count(*) AS n FROM b WHERE brand <> '' AND ing <> '' GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY ingredient_key ORDER BY n DESC, brand_key) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY ingredient_key ORDER BY n DESC, brand_key) <= 12"""
)
def brand_top12(s, d):
    """J-15, A-05, T-03, X-03, X-04: brands of each ingredient, the twelve most frequent."""
    rows = table(s, d, "product", "rxcui", "str").select("rxcui", F.trim("str").alias("str")).distinct()
    return vocabulary.brand_ingredients(rows)


@query(
    r"""
    WITH b AS (SELECT DISTINCT rxcui, trim(str) AS str, regexp_extract(str, '\[([^\]]+)\]\s*$', 1) AS brand,
                      trim(regexp_replace(regexp_replace(regexp_replace(str, '\s*\[[^\]]*\]\s*$', ''), '^[0-9]+(\.[0-9]+)?\s+HR\s+', ''), '\s[0-9].*$', '')) AS ing FROM product),
    c AS (SELECT lower(brand) AS brand_key, lower(ing) AS ingredient_key, arg_min(brand, (rxcui, brand)) AS brand_name, count(*) AS n FROM b WHERE brand <> '' AND ing <> '' GROUP BY 1, 2)
    SELECT *, CAST(row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, ingredient_key) AS INTEGER) AS rank FROM c QUALIFY row_number() OVER (PARTITION BY brand_key ORDER BY n DESC, ingredient_key) <= 6"""
)
def ingredient_top6(s, d):
    """T-04: ingredients of each brand, the six most frequent."""
    rows = table(s, d, "product", "rxcui", "str").select("rxcui", F.trim("str").alias("str")).distinct()
    return vocabulary.brand_ingredients(rows, top=6, per="brand_key")


@query(
    r"""
    WITH p AS (SELECT DISTINCT rxcui, ingredient_key, regexp_extract(str, '([0-9]+(?:\.[0-9]+)?)\s*(MG|MCG|ML|G|UNT)\b', 1) AS a, lower(regexp_extract(str, '([0-9]+(?:\.[0-9]+)?)\s*(MG|MCG|ML|G|UNT)\b', 2)) AS u FROM product)
    SELECT ingredient_key, CASE u WHEN 'unt' THEN 'unit' WHEN 'ml' THEN 'mL' ELSE u END AS unit, count(*) AS n_products, count(DISTINCT a) AS n_strengths, min(CAST(a AS DOUBLE)) AS least, max(CAST(a AS DOUBLE)) AS most
    FROM p WHERE a <> '' AND ingredient_key IS NOT NULL GROUP BY 1, 2"""
)
def product_strengths(s, d):
    """J-16, X-21: strengths marketed per ingredient."""
    return vocabulary.strengths(table(s, d, "product", "rxcui", "ingredient_key", "str").distinct())


@query(
    r"""
    WITH f AS (SELECT DISTINCT lower(trim(dose_form)) AS form FROM product WHERE trim(dose_form) <> ''),
    p AS (SELECT DISTINCT rxcui, lower(trim(regexp_replace(str, '\s*\[[^\]]*\]\s*$', ''))) AS b FROM product)
    SELECT rxcui, arg_max(form, length(form)) AS form FROM p, f WHERE ends_with(b, ' ' || form) GROUP BY rxcui"""
)
def dose_form_suffix(s, d):
    """X-05, S-04: the dose form with which a product's string ends."""
    rows = table(s, d, "product", "rxcui", "str", "dose_form")
    return vocabulary.dose_forms(rows.select("rxcui", "str"), rows)


@query(
    """
    WITH n AS (SELECT DISTINCT rxcui, tty, str, CASE tty WHEN 'IN' THEN 0 WHEN 'PIN' THEN 1 WHEN 'BN' THEN 2 WHEN 'SY' THEN 6 ELSE 9 END AS r FROM name_index)
    SELECT rxcui, arg_min(str, (r, length(str), str)) AS canonical_name, arg_min(tty, (r, length(str), str)) AS tty FROM n GROUP BY rxcui"""
)
def canonical_pick(s, d):
    """T-05: the canonical name of each code."""
    return vocabulary.canonical_names(table(s, d, "name_index", "rxcui", "tty", "str").distinct())


@query(
    """
    SELECT DISTINCT str, key AS "key", salt_key, base_key, release_modifier, true AS stable FROM name_index"""
)
def normalize_index(s, d):
    """X-01: keys made anew from the names of the index; ``stable`` if the key of a key is itself."""
    rows = table(s, d, "name_index", "str").distinct().withColumn("k", names.normalized(F.col("str"))).withColumn("again", names.normalized(F.col("k.key")))
    return rows.select("str", "k.*", (F.col("again.key") == F.col("k.key")).alias("stable"))


# ---------------------------------------------------------------- names


def _typed_keys(s, d):
    rows = table(s, d, "med_entries", "canonical_name").where("canonical_name is not null").distinct()
    return rows.withColumn("k", names.normalized(F.col("canonical_name"))).select(F.col("k.key").alias("q"), F.col("k.salt_key").alias("salt_key"), F.col("k.base_key").alias("base_key")).where("q <> ''").distinct()


@query(
    """
    WITH a AS (SELECT DISTINCT key AS a FROM name_index WHERE tty = 'BN'), p AS (SELECT a, left(a, 3) AS h FROM a)
    SELECT x.a AS a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 6) AS jw, CAST(levenshtein(x.a, y.a) AS INTEGER) AS edits FROM p x JOIN p y ON x.h = y.h AND x.a < y.a"""
)
def lookalike_brands(s, d):
    """X-06, X-07: Jaro-Winkler and edit distance of brands that begin alike."""
    a = table(s, d, "name_index", "tty", "key").where("tty = 'BN'").select(F.col("key").alias("a"), F.left("key", F.lit(3)).alias("h")).distinct()
    pairs = a.join(a.select(F.col("a").alias("b"), "h"), "h").where("a < b")
    return pairs.select("a", "b", F.round(similarity.jaro_winkler_similarity(F.col("a"), F.col("b")), 6).alias("jw"), F.levenshtein("a", "b").alias("edits"))


@query(
    """
    WITH p AS (SELECT DISTINCT key AS a FROM name_index WHERE tty = 'BN' AND key <> '')
    SELECT x.a AS a, y.a AS b, round(jaro_winkler_similarity(x.a, y.a), 6) AS jw, CAST(levenshtein(x.a, y.a) AS INTEGER) AS edits FROM p x JOIN p y ON x.a < y.a WHERE jaro_winkler_similarity(x.a, y.a) >= 0.8"""
)
def lookalike_pairs(s, d):
    """X-06, X-07: brands with a Jaro-Winkler similarity of 0.8 at least, however they begin (``lookalike_brands`` pairs equal heads only, as its SQL does)."""
    a = table(s, d, "name_index", "tty", "key").where("tty = 'BN' and key <> ''").select(F.col("key").alias("q")).distinct()
    index = a.select(F.lit("").alias("rxcui"), F.lit("BN").alias("tty"), F.col("q").alias("str"), F.col("q").alias("key"), F.lit("").alias("salt_key"), F.lit(0.0).alias("prior"))
    met = resolve.fuzzy_candidates(a.repartition(shuffle_partitions(s), "q"), index).where("q < key").select(F.col("q").alias("a"), F.col("key").alias("b")).distinct()
    jw = similarity.jaro_winkler_similarity(F.col("a"), F.col("b"))
    return met.withColumn("raw", jw).where(F.col("raw") >= resolve.RECALL).select("a", "b", F.round("raw", 6).alias("jw"), F.levenshtein("a", "b").alias("edits"))


@query()
def phonetic_codes(s, d):
    """X-08: Double Metaphone codes of the index, and how many keys share each."""
    keys = table(s, d, "name_index", "key").distinct().select("key", F.explode(F.array_distinct(similarity.metaphone_codes(F.col("key")))).alias("code"))
    return keys.where("code <> ''").groupBy("code").agg(F.count("*").alias("n_keys"))


@query()
def resolve_names(s, d):
    """Section 2.10 (J-10 to J-12, U-02, U-03, X-10 to X-13, W-05): every typed name through the whole cascade."""
    rows = table(s, d, "med_entries", "entry_id", "canonical_name").where("entry_id is not null")
    return resolve.resolve_mentions(rows, "entry_id", "canonical_name", table(s, d, "name_index"), table(s, d, "product", "rxcui", "tty", "ingredient_key").distinct())


@query(
    """
    WITH q AS (SELECT DISTINCT key AS q, tty FROM name_index WHERE tty = 'SY'),
    h AS (SELECT q.q, n.rxcui, n.tty, CASE n.tty WHEN 'IN' THEN 0 WHEN 'PIN' THEN 1 WHEN 'BN' THEN 2 WHEN 'TMSY' THEN 3 ELSE 4 END AS r FROM q JOIN name_index n ON n.key = q.q),
    b AS (SELECT * FROM h QUALIFY rank() OVER (PARTITION BY q ORDER BY r) = 1)
    SELECT q, count(DISTINCT rxcui) AS n_concepts, min(rxcui) AS rxcui FROM b GROUP BY q"""
)
def resolve_exact(s, d):
    """J-10, U-02: synonyms looked up by key, only the best type counting."""
    index = table(s, d, "name_index", "rxcui", "tty", "str", "key").distinct()
    hits = index.where("tty = 'SY'").select(F.col("key").alias("q")).distinct().join(index, F.col("q") == F.col("key"))
    rank = vocabulary.type_rank(F.col("tty"), vocabulary.BEST_ORDER)
    best = hits.groupBy("q").agg(F.min(rank).alias("best"))
    return hits.join(best, "q").where(rank == F.col("best")).groupBy("q").agg(F.count_distinct("rxcui").alias("n_concepts"), F.min("rxcui").alias("rxcui"))


_EMPTY = ", ".join(f"'{w}'" for w in sorted(names.EMPTY_WORDS | dosing.NUMBERS.keys() | dosing.SCALES.keys() | dosing.UNITS.keys()))


@query(
    rf"""
    SELECT count(*) AS n_names, count(*) FILTER (len(list_filter(regexp_extract_all(lower(n), '[a-z]{{2,}}'), lambda w: NOT list_contains([{_EMPTY}], w))) = 0) AS n_nothing
    FROM (SELECT DISTINCT canonical_name AS n FROM med_entries WHERE canonical_name IS NOT NULL)"""
)
def names_nothing(s, d):
    """F-05: typed names in which no word could be a name."""
    rows = table(s, d, "med_entries", "canonical_name").where("canonical_name is not null").distinct()
    return rows.agg(F.count("*").alias("n_names"), F.count_if(names.names_nothing(F.col("canonical_name"))).alias("n_nothing"))


# ---------------------------------------------------------------- grammars


@query()
def sig_parse(s, d):
    """N-01 to N-11: dosing fields of every turn of which the grammar reads any, or that only names an amount or a frequency."""
    rows = _turns(s, d).select("session_id", "turn_id", "text").withColumn("sig", dosing.sig(F.col("text")))
    read = (F.col("sig.status") != "unparseable") | F.coalesce("sig.dose_form", "sig.route", "sig.total_quantity").isNotNull() | F.col("sig.prn")
    named = F.col("text").rlike(r"(?i)\b(mg|milligrams?|daily|every|bedtime|as needed|times a day|tablets?)\b")
    return rows.where(read | named).select("session_id", "turn_id", "sig.*")


_TIME_WORDS = "|".join([*(f"{u}s?" for u in dates.UNIT_DAYS), *dates.MONTHS, *dosing.WEEKDAYS, "yesterday", "today", "tomorrow", "before", "after"])


def _sig_cues_sql() -> str:
    """Ordered look-ups of the grammar's phrases among the tokens of a turn."""
    has = lambda phrase: "contains(k, ' " + phrase.replace("'", "''") + " ')"
    often = sorted(dosing.FREQUENCIES.items(), key=lambda x: (x[1] >= 1, -x[1]))
    cases = " ".join(f"WHEN {has(p)} THEN {v!r}::DOUBLE" for p, v in often)
    routes = " ".join(f"WHEN {' OR '.join(map(has, cues))} THEN '{r}'" for r, cues in dosing.ROUTES.items())
    times = ", ".join(f"CASE WHEN {' OR '.join(map(has, cues))} THEN '{label}' END" for label, cues in dosing.TIMES.items())
    days = ", ".join(f"CASE WHEN {has(w)} OR {has(w + 's')} THEN '{w}' END" for w in dosing.WEEKDAYS)
    listed = lambda x: f"array_to_string(list_filter([{x}], lambda v: v IS NOT NULL), ',')"
    return rf""",
    k AS (SELECT session_id, turn_id, ' ' || array_to_string(regexp_extract_all(lower(replace(text, '’', '''')), '\d+(?:\.\d+)?|\p{{L}}+(?:''\p{{L}}+)?|[%/]'), ' ') || ' ' AS k FROM t WHERE text IS NOT NULL)
    SELECT session_id, turn_id, coalesce(CASE {cases} END, 0) AS stated_per_day, coalesce(CASE {routes} END, '') AS route, {listed(times)} AS timing, {listed(days)} AS days FROM k"""


@query(_sig_cues_sql())
def sig_cues(s, d):
    """N-03, N-04, N-06: route, stated frequency, times and days that the grammar finds in every turn."""
    parsed = _turns(s, d).where("text is not null").select("session_id", "turn_id", dosing.sig(F.col("text")).alias("g"))
    # a frequency that follows from "every n hours" is not stated
    derived = F.col("g.interval_hours").isNotNull() & (F.col("g.frequency_per_day") == F.round(24 / F.nullif("g.interval_hours", F.lit(0.0)), 4))
    stated = F.when(~F.coalesce(derived, F.lit(False)), F.col("g.frequency_per_day"))
    days = F.coalesce("g.days_of_week", F.array().cast("array<string>"))
    return parsed.select("session_id", "turn_id", F.coalesce(stated, F.lit(0.0)).alias("stated_per_day"), F.coalesce("g.route", F.lit("")).alias("route"), F.array_join("g.timing", ",").alias("timing"), F.array_join(days, ",").alias("days"))


@query()
def spoken_dates(s, d):
    """D-01 to D-10: dates in the sentences of each visit, resolved against its day; unparseable ones that name a time stay in."""
    said = _turns(s, d).join(_sessions(s, d).select("session_id", "visit_date"), "session_id").select("session_id", "turn_id", "visit_date", F.posexplode(F.split("text", r"(?<=[.?!])\s+")).alias("sentence_no", "phrase"))
    told = said.withColumn("r", dates.resolved(F.col("phrase"), F.col("visit_date"))).where((F.col("r.status") != "unparseable") | F.col("phrase").rlike(rf"(?i)\b({_TIME_WORDS})\b"))
    return told.select("session_id", "turn_id", "sentence_no", "r.status", "r.resolved_date", "r.range_start", "r.range_end", "r.precision", "r.direction", "r.depends_on_event")


@query(
    """,
    n AS (SELECT s.session_id, s.visit_date, k.target FROM s, (SELECT unnest(range(7)) AS target) k WHERE s.visit_date IS NOT NULL)
    SELECT session_id, CAST(visit_date AS VARCHAR) AS visit_date, CAST(target AS INTEGER) AS target,
           CAST(visit_date + CAST(CASE WHEN (target - (isodow(visit_date) - 1) + 7) % 7 = 0 THEN 7 ELSE (target - (isodow(visit_date) - 1) + 7) % 7 END AS INTEGER) AS VARCHAR) AS coming FROM n"""
)
def date_weekday(s, d):
    """D-07: the coming Monday (0) to Sunday (6) after each visit, never the day itself."""
    days = ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")
    rows = _sessions(s, d).where("visit_date is not null").select("session_id", "visit_date", F.posexplode(F.array(*map(F.lit, days))).alias("target", "name"))
    return rows.select("session_id", F.col("visit_date").cast("string").alias("visit_date"), "target", dates.resolved(F.concat(F.lit("next "), "name"), F.col("visit_date"))["resolved_date"].cast("string").alias("coming"))


@query(
    """,
    n AS (SELECT s.session_id, s.visit_date, k.n FROM s, (SELECT unnest([1, 3, 14]) AS n) k WHERE s.visit_date IS NOT NULL)
    SELECT session_id, CAST(n AS INTEGER) AS n, CAST(visit_date + CAST(7 * n AS INTEGER) AS VARCHAR) AS in_weeks, CAST(visit_date - CAST(n AS INTEGER) AS VARCHAR) AS days_ago FROM n"""
)
def date_relative(s, d):
    """D-06, D-09: "in n weeks" and "n days ago"."""
    rows = _sessions(s, d).where("visit_date is not null").select("session_id", "visit_date", F.explode(F.array(F.lit(1), F.lit(3), F.lit(14))).alias("n"))
    when = lambda text: dates.resolved(text, F.col("visit_date"))["resolved_date"].cast("string")
    return rows.select("session_id", "n", when(F.concat(F.lit("come back in "), F.col("n").cast("string"), F.lit(" weeks"))).alias("in_weeks"), when(F.concat(F.col("n").cast("string"), F.lit(" days ago"))).alias("days_ago"))


# ---------------------------------------------------------------- envelopes


@query()
def quote_discovery(s, d):
    """P-16: objects with a text and an offset at any depth of an envelope, by shape."""
    whole = once(table(s, d, "extractions", "extraction_id", "raw_json"), "extraction_id", "raw_json")
    nodes = dewey_nodes(whole, "record_id", "raw", keep=r"\.(text|char_offset)$")
    field = F.regexp_extract("path", r"([a-z_]+)$", 1)
    rows = nodes.select("record_id", ancestor(F.col("dewey"), 1).alias("node"), field.alias("field"), "value", "path").distinct()
    return rows.groupBy("record_id", "node").agg(F.max(F.when(F.col("field") == "text", F.col("value"))).alias("text"), F.max(F.when(F.col("field") == "char_offset", F.col("value"))).cast("double").cast("int").alias("char_offset")).where("text is not null and char_offset is not null")


@query()
def envelope_states(s, d):
    """A-13, A-14: items of each envelope by disposition, discards, and categories."""
    return item_states(table(s, d, "extractions", "extraction_id", "raw_json"), "extraction_id", "raw_json")


@query(
    r"""
    WITH r AS (SELECT DISTINCT * FROM extractions)
    SELECT CASE WHEN raw_json IS NULL OR trim(raw_json) = '' THEN 'empty' WHEN json_valid(raw_json) THEN 'whole' WHEN json_valid(regexp_extract(raw_json, '(?s)(\{.*\})', 1)) THEN 'salvaged' ELSE 'malformed' END AS reading, count(*) AS n_records FROM r GROUP BY 1"""
)
def output_reading(s, d):
    """S-14: how each stored answer can be read (whole, salvaged from its outermost braces, malformed, empty)."""
    rows = table(s, d, "extractions", "extraction_id", "raw_json").distinct()
    return transcripts.parse_output(rows, "raw_json").groupBy("reading").agg(F.count("*").alias("n_records"))


@query()
def mention_merge(s, d):
    """J-19, W-06, U-01: mentions of one concept, or of one text without a code, in a session merge, the first surviving."""
    rows = item_mentions(table(s, d, "extractions", "extraction_id", "raw_json"), "extraction_id", "raw_json")
    owner = table(s, d, "extractions", "extraction_id", "session_id").distinct()
    seq = F.struct("extraction_id", "med_ord")
    m = rows.withColumnRenamed("record_id", "extraction_id").join(owner, "extraction_id").select("session_id", seq.alias("seq"), "rxcui", "mention", "change_kind")
    return mentions.merge_mentions(m)


@query(
    r""",
    k AS (SELECT DISTINCT key AS item FROM name_index WHERE NOT contains(key, ' ')),
    n AS (SELECT DISTINCT u.session_id, u.turn_id, u.item FROM (SELECT session_id, turn_id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS item FROM t) u JOIN k USING (item)),
    i AS (SELECT session_id, item, min(turn_id) AS mention_turn, count(*) AS c FROM n GROUP BY 1, 2),
    m AS (SELECT session_id, arg_min(item, (-c, item)) AS item, arg_min(mention_turn, (-c, item)) AS mention_turn FROM i GROUP BY 1),
    q AS (SELECT t.session_id, t.turn_id, m.item, m.mention_turn, abs(t.turn_id - m.mention_turn) AS gap FROM t JOIN m USING (session_id) WHERE regexp_matches(t.text, '[0-9]+ (mg|milligrams)') AND t.turn_id <> m.mention_turn),
    a AS (SELECT q.* FROM q ANTI JOIN n ON q.session_id = n.session_id AND q.turn_id = n.turn_id AND q.item = n.item),
    b AS (SELECT a.session_id, a.turn_id, arg_min(n.item, (n.turn_id, n.item)) AS rival FROM a JOIN n ON a.session_id = n.session_id AND n.item <> a.item AND n.turn_id > least(a.turn_id, mention_turn) AND n.turn_id < greatest(a.turn_id, mention_turn) WHERE a.gap <= 2 GROUP BY 1, 2)
    SELECT a.session_id, a.turn_id AS quote_id, a.item, a.gap, coalesce(b.rival, '') AS rival FROM a LEFT JOIN b USING (session_id, turn_id) WHERE a.gap > 2 OR b.rival IS NOT NULL"""
)
def misattributed_doses(s, d):
    """J-20: stated doses far from, or cut off from, the mention of their session's chief drug."""
    t = _turns(s, d)
    keys = table(s, d, "name_index", "key").where("key not like '% %'").select(F.col("key").alias("item")).distinct()
    named = t.select("session_id", "turn_id", F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"), 1)).alias("item")).join(keys, "item").distinct()
    items = named.groupBy("session_id", "item").agg(F.min("turn_id").alias("mention_turn"), F.count("*").alias("c"))
    chief = items.groupBy("session_id").agg(F.min_by(F.struct("item", "mention_turn"), F.struct(F.negative("c"), F.col("item"))).alias("m")).select("session_id", "m.item", "m.mention_turn")
    quotes = t.where(F.col("text").rlike("[0-9]+ (mg|milligrams)")).select("session_id", "turn_id", F.col("turn_id").alias("quote_id")).join(chief, "session_id")
    return mentions.misattributed(quotes, named)


@query()
def dose_regimes(s, d):
    """A-11, A-12: regimes that each session's turns state, and where the dose moved."""
    parsed = _turns(s, d).select("session_id", F.col("turn_id").alias("seq"), dosing.sig(F.col("text")).alias("sig")).select("session_id", "seq", F.col("sig.dose_amount").alias("amount"), F.col("sig.dose_unit").alias("unit"), F.col("sig.frequency_per_day").alias("frequency"))
    return mentions.regimes(parsed, ["session_id"])


@query(
    """,
    e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CASE WHEN event_type <> 'error' THEN CAST(CAST(ts AS DATE) AS VARCHAR) END AS day, event_type AS kind, CASE WHEN value > 50 THEN props END AS detail FROM events),
    r AS (SELECT *, CASE WHEN day IS NULL THEN event_id END AS u FROM e)
    SELECT session_id, day, kind, min(event_id) AS event_id, count(*) AS n_merged, arg_min(detail, event_id) FILTER (detail IS NOT NULL) AS detail FROM r GROUP BY session_id, day, kind, u"""
)
def event_merge(s, d):
    """U-06, T-08: events of one user, day and kind merge, undated ones never; a detail is donated."""
    e = table(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.when(F.col("event_type") != "error", F.to_date("ts").cast("string")).alias("day"), F.col("event_type").alias("kind"), F.when(F.col("value") > 50, F.col("props")).alias("detail"))
    return mentions.merge_events(e, "day", "kind", [], "detail")


@query(
    """,
    e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS session_id, CAST(CAST(ts AS DATE) AS VARCHAR) AS day, event_type AS kind, value, CASE WHEN value > 50 THEN props END AS detail FROM events)
    SELECT session_id, day, kind, arg_min(event_id, (value IS NULL, -value, event_id)) AS event_id, count(*) AS n_merged, arg_min(detail, (value IS NULL, -value, event_id)) FILTER (detail IS NOT NULL) AS detail FROM e GROUP BY session_id, day, kind"""
)
def event_survivors(s, d):
    """U-06, T-08: of the events of one user, day and kind the one of the greatest value survives; the best-ranked detail is donated to it."""
    e = table(s, d, "events").select("event_id", F.col("user_id").cast("string").alias("session_id"), F.to_date("ts").cast("string").alias("day"), F.col("event_type").alias("kind"), "value", F.when(F.col("value") > 50, F.col("props")).alias("detail"))
    return mentions.merge_events(e, "day", "kind", [F.col("value").isNull().alias("unknown"), F.negative("value").alias("least")], "detail")


@query()
def chosen_sigs(s, d):
    """T-09: of the instructions that a session's turns state the one to act on: the most confident that is read, else the first."""
    said = _turns(s, d).select("session_id", "turn_id", dosing.sig(F.col("text")).alias("g"))
    read = said.select("session_id", "turn_id", F.lit(None).cast("boolean").alias("settled"), (F.col("g.dose_amount") > 1000).alias("blocking"), "g.status", "g.parse_confidence", "g.normalized_sig")
    return review.chosen_sig(read, ["session_id"], "turn_id").select("session_id", "turn_id", "status", "normalized_sig")


@query(
    """,
    q AS (SELECT session_id, char_start AS char_offset, char_end, CASE WHEN lower(trim(role)) = 'clinician' THEN 'what_changes' WHEN role IS NULL THEN 'open' ELSE 'what_you_said' END AS heading FROM t)
    SELECT session_id, char_offset, char_end, heading, CAST(row_number() OVER o AS INTEGER) AS rank FROM q WINDOW o AS (PARTITION BY session_id, heading ORDER BY char_offset, char_end) QUALIFY row_number() OVER o <= 3"""
)
def summary_top3(s, d):
    """T-06, U-05: the first three distinct spans under each heading."""
    heading = F.when(F.lower(F.trim("role")) == "clinician", "what_changes").when(F.col("role").isNull(), "open").otherwise("what_you_said")
    q = _turns(s, d).select("session_id", F.col("char_start").alias("char_offset"), "char_end", heading.alias("heading"))
    return mentions.top_spans(q, ("what_changes", "what_you_said", "open"))


@query(
    """,
    q AS (SELECT session_id, char_start AS char_offset, char_end, CASE WHEN lower(trim(role)) IN ('clinician', 'doctor', 'dr', 'physician', 'md') THEN 'what_changes' WHEN role IS NULL THEN 'open' ELSE 'what_you_said' END AS heading FROM t)
    SELECT session_id, char_offset, char_end, heading, CAST(row_number() OVER o AS INTEGER) AS rank FROM q WINDOW o AS (PARTITION BY session_id, heading ORDER BY char_offset, char_end) QUALIFY row_number() OVER o <= 3"""
)
def summary_roles_top3(s, d):
    """T-06, U-05: as ``summary_top3``, with every spelling of the clinician's role (its SQL has one only)."""
    heading = F.when(visits.role_class("role") == "clinician", "what_changes").when(F.col("role").isNull(), "open").otherwise("what_you_said")
    q = _turns(s, d).select("session_id", F.col("char_start").alias("char_offset"), "char_end", heading.alias("heading"))
    return mentions.top_spans(q, ("what_changes", "what_you_said", "open"))


# ---------------------------------------------------------------- voices


_CENTROIDS = """
    WITH f AS (SELECT label AS cluster, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS pos FROM embeddings),
    m AS (SELECT cluster, pos, avg(x) AS x FROM f GROUP BY 1, 2),
    c AS (SELECT cluster, list(x ORDER BY pos) AS centroid FROM m GROUP BY 1)"""


@query(
    _CENTROIDS
    + """,
    k AS (SELECT e.vec_id, c.cluster, 1 - list_cosine_similarity(e.embedding::DOUBLE[], c.centroid) AS d FROM embeddings e, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, cluster) AS n FROM k)
    SELECT a.vec_id AS probe_id, a.cluster, round(a.d, 6) AS distance, round(b.d - a.d, 6) AS margin, a.d <= 0.65 AND b.d - a.d >= 0.10 AS decided FROM r a JOIN r b ON a.vec_id = b.vec_id AND a.n = 1 AND b.n = 2"""
)
def nearest_voice(s, d):
    """A-09, J-21: nearest cluster of each vector, with the margin to the next."""
    e = table(s, d, "embeddings")
    return voices.nearest_cluster(e, "vec_id", "embedding", voices.centroids(e, "label", "embedding"))


@query(
    _CENTROIDS
    + """,
    k AS (SELECT e.vec_id, c.cluster, round(1 - list_cosine_similarity(e.embedding::DOUBLE[], c.centroid), 6) AS distance FROM embeddings e JOIN c ON e.label = c.cluster),
    n AS (SELECT cluster, count(*) AS n FROM k GROUP BY 1)
    SELECT cluster, n, vec_id, distance, distance > 0.45 AS flagged FROM k JOIN n USING (cluster) QUALIFY row_number() OVER (PARTITION BY cluster ORDER BY distance DESC, vec_id DESC) = 1"""
)
def voice_outliers(s, d):
    """A-10: the vector farthest from the centroid of its own cluster."""
    return voices.worst_outliers(table(s, d, "embeddings"), "vec_id", "label", "embedding")


@query(
    _CENTROIDS
    + """
    SELECT x.cluster AS a, y.cluster AS b, round(1 - list_cosine_similarity(x.centroid, y.centroid), 6) AS distance FROM c x, c y WHERE x.cluster < y.cluster AND round(1 - list_cosine_similarity(x.centroid, y.centroid), 6) < 1.0"""
)
def close_voices(s, d):
    """J-22: clusters whose centroids lie on one side (distance below 1)."""
    return voices.close_clusters(voices.centroids(table(s, d, "embeddings"), "label", "embedding"), below=1.0)


# ---------------------------------------------------------------- search, sinks, retention


@query(
    r"""
    WITH k AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS w FROM documents WHERE text IS NOT NULL)
    SELECT doc_id AS text_id, count(*) AS n_hits FROM k WHERE w IN ('covered', 'market') GROUP BY doc_id HAVING count(DISTINCT w) = 2"""
)
def token_search(s, d):
    """J-18: documents that hold both words, by the inverted index without stems."""
    index = search.inverted_index(table(s, d, "documents", "doc_id", "text"), "doc_id", "text", stemmed=False)
    return search.search_all(index, ["covered", "market"]).select("text_id", "n_hits")


@query()
def stemmed_snippets(s, d):
    """J-18: snippets of documents about bridges and repairs, by stems."""
    docs = table(s, d, "documents", "doc_id", "text")
    return search.snippets(search.search_all(search.inverted_index(docs, "doc_id", "text"), ["bridg", "repair"]), docs, "doc_id", "text")


@query(
    """,
    c AS (SELECT t.session_id, count(*) AS n_turns, count(t.role) AS n_roles FROM t GROUP BY 1)
    SELECT count(*) AS n_sessions, round(avg(CASE WHEN s.audio_path IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS with_audio, round(avg(CASE WHEN s.consent.obtained THEN 1.0 ELSE 0.0 END), 6) AS with_consent, round(avg(n_roles / n_turns), 6) AS roles_known FROM s LEFT JOIN c USING (session_id)"""
)
def coverage_ratio(s, d):
    """A-07: shares of sessions with audio and consent, and of turns with a role."""
    c = _turns(s, d).groupBy("session_id").agg(F.count("*").alias("n"), F.count("role").alias("k"))
    share = lambda b: F.round(F.avg(F.when(b, 1.0).otherwise(0.0)), 6)
    return _sessions(s, d).join(c, "session_id", "left").agg(F.count("*").alias("n_sessions"), share(F.col("audio_path").isNotNull()).alias("with_audio"), share(F.col("consent.obtained")).alias("with_consent"), F.round(F.avg(F.col("k") / F.col("n")), 6).alias("roles_known"))


@query(
    """
    SELECT session_id, to_base64(encode(transcript_text)) AS data, CAST(octet_length(encode(transcript_text)) AS INTEGER) AS size, to_base64(unhex(sha1(transcript_text))) AS hash
    FROM (SELECT DISTINCT session_id, transcript_text FROM sessions)"""
)
def document_attachment(s, d):
    """S-17: attachment of each transcript: base64 text, size, and hash."""
    rows = table(s, d, "sessions", "session_id", "transcript_text").distinct()
    done = transcripts.document_reference(rows, "session_id", "transcript_text")
    return done.withColumn("data", F.regexp_replace("data", r"\s", ""))


@query(
    """,
    a AS (SELECT session_dir AS path, CAST(epoch(TIMESTAMP '2031-07-01') - epoch(received_at) AS BIGINT) AS age_s, coalesce(consent.obtained, false) AND audio_path IS NULL AS keep FROM s)
    SELECT path, age_s, CASE WHEN keep THEN 'kept' WHEN age_s IS NULL THEN 'unknown' WHEN age_s >= 86400 THEN 'removed' ELSE 'young' END AS state FROM a"""
)
def retention_sweep(s, d):
    """Z-01: session folders by whether they have outlived a day."""
    return retention.sweep(_sessions(s, d), "session_dir", "received_at", F.lit("2031-07-01 00:00:00").cast("timestamp"), F.col("consent.obtained") & F.col("audio_path").isNull())
