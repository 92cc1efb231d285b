"""Transcript operators: interval assignment, turn building, offsets, validation.

All take and return DataFrames keyed by ``session_id``; offsets are 0-based and
end-exclusive, in characters.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spanloom.operators.rangescan import annotate, islands

# Spellings of the two roles.
ROLES = {
    "clinician": "clinician", "doctor": "clinician", "dr": "clinician", "physician": "clinician", "md": "clinician",
    "patient": "other", "pt": "other", "other": "other", "family": "other",
}


def role_class(c: str) -> Column:
    """``clinician`` or ``other`` for any spelling of the role in column ``c``, else null."""
    low = F.lower(F.trim(F.col(c)))
    clinician, other = ([k for k, v in ROLES.items() if v == kind] for kind in ("clinician", "other"))
    return F.when(low.isin(clinician), "clinician").when(low.isin(other), "other")


def latest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """One row per key: the one delivered last (repeated and late deliveries).

    Aggregates before the shuffle, so a key delivered very often is no hot group.
    Every column is aggregated by itself, so columns that a query does not use
    are not read; of deliveries with one time the greatest value of a column
    counts.  A null time comes before all others.
    """
    rest = [c for c in rows.columns if c not in keys]
    last = lambda c: F.max(F.col(c)) if c == by else F.max(F.struct(F.col(by), F.col(c)))[c]
    return rows.groupBy(*keys).agg(*(last(c).alias(c) for c in rest)).select(*rows.columns)


def latest_rows(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """``latest`` for queries that use every column of ``rows``: a delivery stays together and moves with one time.

    Of deliveries with one time the greatest row counts.
    """
    rest = [c for c in rows.columns if c not in (*keys, by)]
    last = rows.groupBy(*keys).agg(F.max(F.struct(by, *rest)).alias("last"))
    return last.select(*(F.col(c) if c in keys else F.col(f"last.{c}").alias(c) for c in rows.columns))


def assign_intervals(points: DataFrame, intervals: DataFrame, point_keys: list[str], bucket_s: float = 30.0) -> DataFrame:
    """J-01/J-02: every word to the interval it overlaps most (J-01); unmatched kept with null (J-02).

    ``points`` has session_id, ``point_keys``, start_s, end_s; ``intervals``
    session_id, interval_id, start_s, end_s.  Ties go to the earliest interval,
    then to the smallest id; zero overlap (also zero-length words) is no match;
    null or infinite times match nothing.  Both sides are cut into time buckets, so a long
    session's words and intervals meet bucket by bucket rather than all with all.
    A span of any length fills two buckets at most: buckets double in size from
    level to level, a span is at home on the level that fits it, and two spans
    meet where the longer one is at home.
    """
    timed = "start_s is not null and end_s > start_s and abs(start_s) < 1e12 and abs(end_s) < 1e12"
    w = points.where(timed).select("session_id", *point_keys, F.col("start_s").alias("w_lo"), F.col("end_s").alias("w_hi"))
    i = intervals.where(timed).select("session_id", "interval_id", F.col("start_s").alias("i_lo"), F.col("end_s").alias("i_hi"))
    level = lambda lo, hi: F.greatest(F.lit(0), F.ceil(F.log2((F.col(hi) - F.col(lo)) / bucket_s))).cast("int")
    w, i = w.withColumn("home", level("w_lo", "w_hi")), i.withColumn("home", level("i_lo", "i_hi"))
    # at most about forty levels lie between the shortest and the longest span of times below 1e12
    levels = F.array(*(F.lit(r.home) for r in w.select("home").union(i.select("home")).distinct().collect())).cast("array<int>")

    def cut(df: DataFrame, lo: str, hi: str, own: str) -> DataFrame:
        on = df.withColumn("level", F.explode(F.filter(levels, lambda k: k >= F.col("home"))))
        first = F.floor(F.col(lo) / (bucket_s * F.pow(F.lit(2.0), "level")))
        last = F.greatest(first, F.ceil(F.col(hi) / (bucket_s * F.pow(F.lit(2.0), "level"))) - 1)
        return on.withColumn(own, F.col("level") == F.col("home")).withColumn("b", F.explode(F.sequence(first, last))).drop("home")

    met = cut(w, "w_lo", "w_hi", "w_own").join(cut(i, "i_lo", "i_hi", "i_own"), ["session_id", "level", "b"]).where("(w_own or i_own) and w_lo < i_hi and w_hi > i_lo")
    overlap = F.least("w_hi", "i_hi") - F.greatest("w_lo", "i_lo")
    best = met.groupBy("session_id", *point_keys).agg(F.max_by(F.struct("interval_id", overlap.alias("overlap")), F.struct(F.round(overlap, 6), F.negative("i_lo"), F.negative("interval_id"))).alias("hit"))
    return points.select("session_id", *point_keys).distinct().join(best, ["session_id", *point_keys], "left").select("session_id", *point_keys, "hit.interval_id", F.round("hit.overlap", 3).alias("overlap_s"))


def build_turns(words: DataFrame, label: Column) -> DataFrame:
    """W-01/W-02: contiguous words of one label form a turn, with character offsets.

    ``words`` has session_id, word_idx, text; words are joined by one blank,
    turns by one blank.  A null label is a label of its own.  One scan over the
    words makes the turns; their numbers and offsets come from a scan over the
    turns, which are far fewer.
    """
    sized = words.select("session_id", F.col("word_idx").cast("bigint").alias("word_idx"), label.alias("label"), (F.length("text") + 1).cast("double").alias("size"))
    turns = islands(sized, "session_id", "word_idx", "label", "size").withColumn("one", F.lit(1.0))
    placed = annotate(turns, "session_id", ["first"], sums=["total", "one"])
    start = F.col("before_total").cast("bigint")
    return placed.select(
        "session_id", F.col("before_one").cast("bigint").alias("turn_no"), "label", F.col("n").alias("n_words"), F.col("first").cast("int").alias("first_word_idx"), F.col("last").cast("int").alias("last_word_idx"),
        start.alias("char_start"), (start + F.col("total").cast("bigint") - 1).alias("char_end"),
    )


def turn_offsets(turns: DataFrame) -> DataFrame:
    """W-02: running offsets of turns joined by one blank, next to the stored ones."""
    sized = turns.withColumn("size", (F.length("text") + 1).cast("double"))
    lo = F.col("before_size").cast("bigint")
    return annotate(sized, "session_id", ["turn_id"], sums=["size"]).select("session_id", "turn_id", lo.alias("char_start"), (lo + F.length("text")).alias("char_end"), (lo == F.col("char_start")).alias("agrees"))


def synthetic_clock(turns: DataFrame) -> DataFrame:
    """W-03: a running clock for text without times: max(length / 13, 0.12) s a word, 0.35 s between turns."""
    words = turns.select("session_id", "turn_id", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("pos", "word")).where("word <> ''")
    timed = words.withColumn("took", F.greatest(F.length("word") / 13.0, F.lit(0.12))).withColumn("step", F.col("took") + F.when(F.col("pos") == 0, 0.35).otherwise(0.0))
    start = F.col("before_step") + F.col("step") - F.col("took") - 0.35
    return annotate(timed, "session_id", ["turn_id", "pos"], sums=["step"]).select("session_id", "turn_id", "pos", "word", start.alias("start_s"), (start + F.col("took")).alias("end_s"))


def turn_at(offsets: DataFrame, turns: DataFrame, bucket: int = 256) -> DataFrame:
    """J-04/J-05: the turn that holds an offset; in a gap the next turn, after the end the last.

    ``offsets`` has session_id, probe_id, char_offset; ``turns`` session_id,
    turn_id, char_start, char_end.  Every turn answers for the gap before it, so
    the as-of lookup is a containment: both sides meet on (session, stretch of
    ``bucket`` characters), which spreads a session of any length.  Turns without
    a span are disregarded; a negative offset lies before the first turn; null
    offsets and offsets of unknown sessions get null.
    """
    spans = turns.where("session_id is not null and char_end > char_start and char_start >= 0").select("session_id", F.col("turn_id").cast("int").alias("turn_id"), F.col("char_start").cast("bigint").alias("lo"), F.col("char_end").cast("bigint").alias("hi"))
    reach = annotate(spans, "session_id", ["lo", "turn_id"], lags=["hi"]).withColumn("start", F.least("lo", F.coalesce("prev_hi", F.lit(0)))).select("session_id", "turn_id", "lo", "hi", "start")
    cut = reach.withColumn("b", F.explode(F.expr(f"sequence(start div {bucket}, (hi - 1) div {bucket})")))
    probes = offsets.select("session_id", "probe_id", F.col("char_offset").cast("bigint").alias("char_offset"), F.expr(f"greatest(char_offset, 0) div {bucket}").alias("b"))
    held = probes.join(cut, ["session_id", "b"]).where("greatest(char_offset, 0) >= start and char_offset < hi")
    best = held.groupBy("session_id", "probe_id").agg(F.min_by(F.struct("turn_id", (F.col("char_offset") >= F.col("lo")).alias("inside")), F.struct(F.col("char_offset") < F.col("lo"), F.negative("lo"), "turn_id")).alias("t"))
    final = spans.groupBy("session_id").agg(F.max_by("turn_id", F.struct("hi", "turn_id")).alias("last_id"))
    found = probes.join(best, ["session_id", "probe_id"], "left").join(final, "session_id", "left")
    return found.select("session_id", "probe_id", "char_offset", F.coalesce("t.turn_id", F.when(F.col("char_offset").isNotNull(), F.col("last_id"))).alias("turn_id"), F.coalesce("t.inside", F.lit(False)).alias("inside"))


def context_window(turns: DataFrame, reach: int = 2) -> DataFrame:
    """F-14: ids of the turns around each turn, ``reach`` to either side.

    Turns are numbered by a range scan and meet on (session, number), a unique
    key, instead of a window over the whole session.
    """
    one = annotate(turns.select("session_id", "turn_id").withColumn("one", F.lit(1.0)), "session_id", ["turn_id"], sums=["one"]).select("session_id", "turn_id", F.col("before_one").cast("bigint").alias("pos"))
    given = one.select("session_id", F.col("turn_id").alias("near"), F.explode(F.expr(f"sequence(pos - {reach}, pos + {reach})")).alias("pos"))
    met = one.join(given, ["session_id", "pos"]).groupBy("session_id", "turn_id").agg(F.array_sort(F.collect_list("near")).alias("ids"))
    return met.select("session_id", "turn_id", F.array_join(F.transform("ids", lambda x: x.cast("string")), ",").alias("context_ids"))


def word_probability(quotes: DataFrame, words: DataFrame) -> DataFrame:
    """J-06: first start and least probability of the words that a quote overlaps in its turn.

    ``quotes`` has session_id, turn_id, quote_id, char_offset, char_end.  A quote
    without words has probability 1 and no start.
    """
    w = words.select("session_id", "turn_id", F.col("char_offset").alias("w_lo"), (F.col("char_offset") + F.length("text")).alias("w_hi"), F.col("start_s").alias("w_start"), "probability")
    met = quotes.join(w, ["session_id", "turn_id"]).where("w_lo < char_end and w_hi > char_offset")
    agg = met.groupBy("quote_id").agg(F.min_by("w_start", "w_lo").alias("audio_start"), F.min("probability").alias("min_probability"))
    return quotes.join(agg, "quote_id", "left").select("quote_id", "session_id", "turn_id", "audio_start", F.coalesce("min_probability", F.lit(1.0)).alias("min_probability"))


def word_cue(quotes: DataFrame, words: DataFrame, lead_s: float = 0.35, tail_s: float = 0.25, focus_s: float = 2.5, bucket: int = 256) -> DataFrame:
    """J-07/R-18/P-24: where to listen to a quote, by its words in any turn.

    ``quotes`` has session_id, quote_id, char_offset, char_end.  The cue begins
    ``lead_s`` before the least probable word (the first of equals) and ends
    ``tail_s`` after it, or with the quote, at most ``focus_s`` on.  Quotes and
    words meet on stretches of ``bucket`` characters; quotes without words get null.
    """
    cut = lambda lo, hi: F.explode(F.expr(f"sequence({lo} div {bucket}, ({hi} - 1) div {bucket})"))
    w = words.where("length(text) > 0 and char_offset >= 0").select("session_id", F.col("char_offset").cast("bigint").alias("w_lo"), (F.col("char_offset") + F.length("text")).cast("bigint").alias("w_hi"), "start_s", "end_s", "probability")
    q = quotes.where("char_end > char_offset and char_offset >= 0").select("session_id", "quote_id", F.col("char_offset").cast("bigint").alias("q_lo"), F.col("char_end").cast("bigint").alias("q_hi"))
    met = q.withColumn("b", cut("q_lo", "q_hi")).join(w.withColumn("b", cut("w_lo", "w_hi")), ["session_id", "b"]).where("w_lo < q_hi and w_hi > q_lo")
    weak = F.min_by(F.struct("start_s", "end_s"), F.struct(F.coalesce("probability", F.lit(1.0)), F.col("w_lo")))
    agg = met.groupBy("quote_id").agg(weak.alias("weak"), F.max("end_s").alias("stop"))
    begin = F.greatest(F.lit(0.0), F.col("weak.start_s") - lead_s)
    end = F.greatest(F.col("weak.end_s") + tail_s, F.least(F.col("stop"), F.col("weak.start_s") + focus_s))
    timed = agg.select("quote_id", F.round(begin, 3).alias("cue_start_s"), F.round(end, 3).alias("cue_end_s"))
    return quotes.select("quote_id", "session_id").join(timed, "quote_id", "left")


def violations(sessions: DataFrame, turns: DataFrame, words: DataFrame) -> DataFrame:
    """F-12/F-13/P-26: how many rows break each rule of the data model (one row per broken rule).

    Every table is read and moved once.  Its rows carry the rules that they break
    by themselves; sorted by session and turn, they stream past the transcript of
    their session and the span of their turn, so a task holds one transcript at a
    time and no list of pieces.  Nothing is broadcast: transcripts are far larger
    than their file, by which Spark would judge them.
    """
    path = F.col("audio_path")
    outside = path.isNotNull() & (~path.startswith(F.concat("session_dir", F.lit("/"))) | path.contains("..") | (path.startswith("/") != F.col("session_dir").startswith("/")))
    of_session = {"no consent": F.col("consent").isNull() | F.col("consent.obtained").isNull() | ~F.col("consent.obtained"), "no audio": path.isNull(), "audio outside its session": outside}
    length, start, end, p = F.length("text"), F.col("start_s"), F.col("end_s"), F.col("probability")
    span = F.col("char_end") - F.col("char_start")
    of_turn = {"turn length differs from its span": span != length, "turn interval missing or invalid": start.isNull() | end.isNull() | (end <= start)}
    of_word = {"word interval invalid": (end < start) | (start < 0), "word of no length": end == start, "word probability missing or out of range": p.isNull() | (p < 0) | (p > 1)}
    alone = [*of_session, *of_turn, *of_word]
    rules = [*alone, "word outside its turn", "turn text is not its slice", "word offset does not index the transcript"]

    def marked(df: DataFrame, kind: int, own: dict[str, Column], turn: Column, begin: Column, stop: Column, at: Column, n: Column, text: Column) -> DataFrame:
        """The rows of one table as they stream by; a text of unknown place is left out."""
        broken = sum((F.when(test, 1 << rules.index(rule)).otherwise(0) for rule, test in own.items()), F.lit(0))
        zero, place = F.lit(0).cast("bigint"), [x.cast("bigint") for x in (at, n)]
        return df.select(
            "session_id", turn.cast("int").alias("turn_id"), F.lit(kind).alias("kind"), broken.alias("broken"), begin.cast("double").alias("begin"), stop.cast("double").alias("stop"),
            *(F.coalesce(x, zero).alias(c) for c, x in zip(("at", "n"), place)), F.when(at.isNotNull() & n.isNotNull(), text).alias("text"),
        )

    none, timed = F.lit(None), end > start
    rows = marked(sessions, 0, of_session, none, none, none, F.lit(0), F.lit(0), F.col("transcript_text"))
    rows = rows.unionByName(marked(turns, 1, of_turn, F.col("turn_id"), F.when(timed, start), F.when(timed, end), F.col("char_start"), span, F.col("text")))
    rows = rows.unionByName(marked(words, 2, of_word, F.col("turn_id"), start, F.coalesce(end, F.lit(float("-inf"))), F.col("char_offset"), length, F.col("text")))
    ordered = rows.repartition("session_id").sortWithinPartitions("session_id", "turn_id", "kind")  # a session's own row has no turn and leads
    found = ordered.mapInArrow(_checked(*(1 << rules.index(rule) for rule in rules[len(alone) :])), "session_id string, broken int, n bigint")
    names = F.array_compact(F.array(*(F.when(F.col("broken").bitwiseAND(1 << k) != 0, rule) for k, rule in enumerate(rules))))
    return found.select("session_id", F.explode(names).alias("rule"), "n").groupBy("rule").agg(F.sum("n").alias("n_rows"), F.count_distinct("session_id").alias("n_sessions"))


def _checked(outside_turn: int, turn_unlike: int, word_unlike: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Rows per session and set of broken rules, each rule a bit; unknown answers break none.

    Null times arrive as NaN, but a word's unknown end as minus infinity, since a
    NaN is past every end, as in SQL.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session = whole = turn = None
        lo = hi = 0.0
        for batch in batches:
            counts: Counter[tuple[str | None, int]] = Counter()
            columns = (batch.column(c).to_numpy(zero_copy_only=False).tolist() for c in ("session_id", "turn_id", "kind", "broken", "begin", "stop", "at", "n", "text"))
            for of, in_turn, kind, broken, begin, stop, at, n, text in zip(*columns):
                if of != session or of is None:
                    session, whole, turn = of, None, None
                if kind == 0:
                    whole = text
                else:
                    if kind == 1:
                        turn, lo, hi = in_turn, begin, stop
                    elif in_turn == turn and (begin < lo or stop > hi or stop != stop and hi == hi):
                        broken |= outside_turn
                    if whole is not None and text is not None and _slice(whole, at, n) != text:
                        broken |= turn_unlike if kind == 1 else word_unlike
                if broken:
                    counts[of, broken] += 1
            out = [pa.array([of for of, _ in counts], pa.string()), pa.array([broken for _, broken in counts], pa.int32()), pa.array(list(counts.values()), pa.int64())]
            yield pa.RecordBatch.from_arrays(out, names=["session_id", "broken", "n"])

    return run


def _slice(whole: str, lo: int, n: int) -> str:
    """``substr(whole, lo + 1, n)`` of SQL: below -1 ``lo`` counts from the end, a negative ``n`` goes backwards."""
    if lo >= 0 and n >= 0:
        return whole[lo : lo + n]
    start = lo if lo >= -1 else len(whole) + lo + 1
    start, stop = min(start, start + n), max(start, start + n)
    return whole[max(start, 0) : max(stop, 0)]


def suspect_segment(compression_ratio: Column, no_speech: Column) -> Column:
    """F-07: a segment that repeats itself or is likely no speech; unknown figures suspect nothing."""
    return F.coalesce(compression_ratio > 2.4, F.lit(False)) | F.coalesce(no_speech > 0.6, F.lit(False))


def session_diff(left: DataFrame, right: DataFrame) -> DataFrame:
    """A-18: two versions of sessions, turn by turn.

    Both have session_id, turn_id, text.  Returns per session the turns of each
    version, how many have the same text, the first that differs or is missing,
    and the share of words that both versions of a turn have at the same place.
    Turns meet on (session_id, turn_id); null texts count as empty.
    """
    side = lambda df, c: df.select("session_id", "turn_id", F.coalesce("text", F.lit("")).alias(c))
    met = side(left, "a").join(side(right, "b"), ["session_id", "turn_id"], "full")
    words = lambda c: F.filter(F.split(F.trim(c), r"\s+"), lambda w: w != "")
    both = F.zip_with(words("a"), words("b"), lambda x, y: x.eqNullSafe(y))
    same = F.col("a").eqNullSafe(F.col("b"))
    counted = met.select(
        "session_id", "turn_id", "a", "b", same.alias("same"), F.coalesce(F.size(F.filter(both, lambda x: x)), F.lit(0)).alias("agree"),
        F.greatest(F.coalesce(F.size(words("a")), F.lit(0)), F.coalesce(F.size(words("b")), F.lit(0))).alias("n_words"),
    )
    return counted.groupBy("session_id").agg(
        F.count("a").alias("n_left"), F.count("b").alias("n_right"), F.count_if("same").alias("n_same"), F.min(F.when(~F.col("same"), F.col("turn_id"))).alias("first_unlike"),
        F.round(F.when(F.sum("n_words") > 0, F.sum("agree") / F.sum("n_words")).otherwise(1.0), 6).alias("word_agreement"),
    )


def illegal_steps(events: DataFrame, group: str, order: str, stage: str, allowed: dict[str, tuple[str, ...]]) -> DataFrame:
    """Z-02: steps from one stage to the next that a stage machine does not allow, per group of any size.

    ``allowed`` maps a stage to the stages that may follow; the first stage of a
    group must follow ``""``.  Null stages are disregarded.
    """
    rows = events.where(F.col(stage).isNotNull()).select(group, order, stage)
    placed = annotate(rows, group, [order], lags=[stage])
    before = F.when(F.col("is_first"), "").otherwise(F.col(f"prev_{stage}"))
    legal = F.lit(False)
    for a, following in allowed.items():
        legal = legal | ((before == a) & F.col(stage).isin(*following))
    return placed.where(~legal).select(group, order, before.alias("from_stage"), F.col(stage).alias("to_stage"))
