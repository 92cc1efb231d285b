"""Raw recogniser rows turned into clean, ordered speaker turns.

Layouts of lines are mined with a fixed-depth tree over the forms of the first
tokens; slots for time marks and speaker labels are inferred per layout from
how their values agree with the rows' own times, labels and roles; then the
layouts are applied, noise is removed and adjoining rows of a speaker merge.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.rangescan import range_scan
from spanloom.operators.skew import salted_join
from spanloom.operators.visits import ROLES, role_class
from spanloom.session import checkpointed

DEPTH = 4
AGREE = 0.6
#: Lines a layout needs, in a collection of any size, before its statistics count.
MIN_LINES = 20
TIME_SLACK_S = 3.0

# Vocabulary of labels, sounds and hesitations.
_NUMBERED = {"speaker", "spk", "spkr", "s", "sp", "voice", "channel"}
_SOUNDS = (
    "laugh chuckl giggl cough sneez sniff sigh clear throat breath gasp yawn groan hum whisper sob cry crying door phone ring beep buzz click bang knock noise static music typing "
    "pause silence silent blank audio crosstalk overlapping inaudible unintelligible indistinct background paper rustl chair scrap footstep baby dog bark applause keyboard mumbl foreign language"
)
_SOUND = re.compile(r"^(?:%s)" % "|".join(_SOUNDS.split()))
HESITATION = re.compile(r"^(?:u+h+m*|u+m+|e+r+m*|a+h+m+|h+m+|e+h*m+|m{2,}|ä+h+m*)$")

_CLOCK = re.compile(r"^[\[(<{|]*(?:(?:(\d+):)?(\d+):)(\d+(?:[.,]\d+)?)[\])>}|]*[,;-]?$")
_SECONDS = re.compile(r"^[\[(<{|]+(\d+(?:\.\d+)?)s?[\])>}|]+$")
_NOTE = re.compile(r"\(\([^()]*\)\)|<<[^<>]*>>|\[[^\[\]]*\]|\([^()]*\)|\{[^{}]*\}|<\|?[^<>|]*\|?>|\*[^*\s][^*]*\*|♪[^♪]*♪|♪")
_OPEN = re.compile(r"[\[({<*♪]")
_INNER = re.compile(r"[^\W\d_]+")
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
_DELIMS = {"-", "—", "–", ">", ">>", "|", ":"}
_FIRST_WORD = re.compile(r"[^\W\d_]+")


def time_value(token: str) -> float | None:
    """Seconds that a token marks, if it is nothing but a time mark."""
    if m := _CLOCK.match(token):
        return (int(m[1] or 0) * 60 + int(m[2])) * 60 + float(m[3].replace(",", "."))
    return float(m[1]) if (m := _SECONDS.match(token)) and ("." in m[1] or "s" in token) else None


def _form(token: str) -> str:
    mask = re.sub(r"\d+", "9", token.lower())
    if time_value(token) is not None:
        return "T" + mask
    if mask in _DELIMS:
        return "D" + mask
    if mask == "9":
        return "N"
    if len(mask) <= 20 and (mask[-1] in ":>]—–" or mask[0] in "[<") and any(c.isalnum() for c in mask):
        return "L" + mask
    return "W" + mask


def layout(tokens: list[str]) -> tuple[str, ...]:
    """Path of a line in the token tree: forms of its head, ``*`` from the first plain word on."""
    forms = [_form(t) for t in tokens[: DEPTH + 2]]
    path: list[str] = []
    for i, f in enumerate(forms[:DEPTH]):
        if f[0] == "W":
            after = forms[i + 1 : i + 3]
            joined = after and (after[0][0] == "D" or (len(after) > 1 and after[0] == "N" and after[1][0] == "D") or re.match(r"^L9\W$", after[0]))
            if not joined or len(f) > 14:
                break
        elif f == "N" and not (path and path[-1][0] == "W"):
            break
        path.append(f)
        if f[0] == "L" and f[-1] in ":>]—–" and i and path[-2][0] == "W":
            break
    return (*path, "*")[:DEPTH]


def _label_at(forms: tuple[str, ...], i: int) -> tuple[str, int]:
    """(word, tokens) of a label-like stretch of the path at ``i``; no tokens if none."""
    f = forms[i]
    if f[0] == "L":
        return (m[0] if (m := _FIRST_WORD.search(f[1:])) else ""), 1
    if f[0] == "W" and i + 1 < len(forms):
        word = m[0] if (m := _FIRST_WORD.search(f[1:])) else ""
        if forms[i + 1][0] in "LD":
            return word, 2
        if forms[i + 1] == "N":  # the delimiter may lie beyond the tree's depth
            return word, 3
    return "", 0


_HEADS = "session_id string, turn_id bigint, nth int, path string, " + ", ".join(f"s{j} int" for j in range(1, 7))


def _heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The layouts that a row may show, one after the other, and for the first how its slots agree with the row.

    A row whose head is plain words shows none.  Further layouts are those that
    remain when leading time marks and quote signs are taken off.
    """
    for batch in batches:
        out = []
        for session, turn, text, start, number, role in zip(*(batch.column(c).to_pylist() for c in ("session_id", "turn_id", "text", "start_s", "number", "role"))):
            tokens = text.split(None, DEPTH + 2)
            nth = 0
            while tokens and (path := layout(tokens))[0] != "*":
                out.append((session, turn, nth, "\t".join(path), *(_agreement(path, tokens, start, number, role) if not nth else (0,) * 6)))
                if path[0][0] != "T" and path[0] != "D>>":
                    break
                text, nth = text.split(None, 1)[1] if len(tokens) > 1 else "", nth + 1
                tokens = text.split(None, DEPTH + 2)
        cols = list(zip(*out)) or [[]] * 10
        types = [pa.string(), pa.int64(), pa.int32(), pa.string(), *[pa.int32()] * 6]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=["session_id", "turn_id", "nth", "path", *(f"s{j}" for j in range(1, 7))])


def _agreement(path: tuple[str, ...], tokens: list[str], start: float | None, number: int | None, role: str | None) -> tuple[int, ...]:
    """(times, right ones, numbers, right ones, roles, clinicians) that the slots of one line show."""
    s, i = [0] * 6, 0
    if path[0][0] == "T":
        i = 1
        if start is not None:
            s[0], s[1] = 1, int(abs(time_value(tokens[0]) - start) <= TIME_SLACK_S)
    word, n = _label_at(path, i) if i < len(path) else ("", 0)
    if n:
        digits = re.findall(r"\d+", "".join(tokens[i : i + n]))
        if digits and number is not None:
            s[2], s[3] = 1, int(int(digits[-1]) == number)
        elif role is not None:
            s[4], s[5] = 1, int(role == "clinician")
    return tuple(s)


class Layouts:
    """Slots per layout: from its statistics where it has enough lines, else from the grammar of known labels."""

    def __init__(self, stats: dict[str, list[int]]):
        self.stats, self.slots, self.told = stats, {}, {}

    def slot(self, path: tuple[str, ...]) -> tuple[int, int, str]:
        """(time tokens, label tokens, 'number' | role | '')."""
        key = "\t".join(path)
        if (known := self.told.get(key) or self.slots.get(key)) is None:
            if len(self.slots) >= 100_000:
                self.slots.clear()
            known = self.slots[key] = self._infer(path, self.stats.get(key, [0] * 7))
        return known

    @staticmethod
    def _infer(path: tuple[str, ...], s: list[int]) -> tuple[int, int, str]:
        i = 0
        if path[0][0] == "T":
            marked = path[0][1] in "[(<{" or "." in path[0]  # written as a mark, not as a time of day
            i = int(s[2] >= AGREE * s[1] if s[1] >= MIN_LINES else marked)
        if i >= len(path) or (path[0][0] == "T" and not i):
            return i, 0, ""
        if path[i] == "D>>":
            return i, 1, ""
        word, n = _label_at(path, i)
        if not n:
            return i, 0, ""
        numbered = "9" in "".join(path[i : i + n]) or "N" in path[i : i + n]
        if numbered:
            ok = s[4] >= 0.9 * s[3] if s[3] >= MIN_LINES else word in _NUMBERED
            return (i, n, "number") if ok else (i, 0, "")
        if s[5] >= MIN_LINES and min(s[6], s[5] - s[6]) <= 0.1 * s[5]:
            return i, n, "clinician" if s[6] * 2 > s[5] else "other"
        return (i, n, ROLES[word]) if word in ROLES else (i, 0, "")


def is_note(body: str) -> bool:
    """A sound note or time mark, not something said in brackets."""
    inner = body.strip("[](){}<>*♪| ")
    if time_value(body) is not None or not any(c.isalnum() for c in inner):
        return True
    words = _INNER.findall(inner.lower())
    return body[0] == "♪" or bool(words) and len(words) <= 4 and any(_SOUND.match(w) for w in words)


def without_notes(text: str, fill: Callable[[str], str]) -> str:
    """``text`` with its sound notes and time marks replaced, also such as stand inside other brackets."""
    out, at = [], 0
    for m in _OPEN.finditer(text):
        if m.start() >= at and (n := _NOTE.match(text, m.start())) and is_note(n[0]):
            out += [text[at : n.start()], fill(n[0])]
            at = n.end()
    return "".join([*out, text[at:]]) if out else text


def clean_row(text: str, layouts: Layouts) -> tuple[str, int | None, str | None]:
    """(what was said, number in the label, role in the label) of one row."""
    tokens = text.split()
    number = role = None
    while tokens:
        times, labels, kind = layouts.slot(layout(tokens))
        if not times + labels:
            break
        head = "".join(tokens[times : times + labels])
        if kind == "number" and (d := re.findall(r"\d+", head)):
            number = int(d[-1]) if number is None else number
        elif kind in ("clinician", "other"):
            role = role or kind
        tokens = tokens[times + labels :]
        if labels and kind:
            break
    rest = " ".join(tokens)
    rest = without_notes(rest, lambda note: " ")
    kept: list[str] = []
    for t in rest.split():
        if t.count(":") == 2 and "." in t and time_value(t) is not None:
            continue  # a mark with a fraction is no time of day
        bare = _EDGE.sub("", t)
        if HESITATION.match(bare.lower()) and bare != "ER":  # in capitals it is a release form
            continue
        kept.append(t)
    if not any(c.isalnum() for t in kept for c in t):
        kept = []
    return " ".join(kept), number, role


def _exceptions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Layouts whose statistics say something else than the grammar of known labels."""
    plain = Layouts({})
    for batch in batches:
        out = []
        for path, *s in zip(*(c.to_pylist() for c in batch.columns)):
            steps = tuple(path.split("\t"))
            if (slot := Layouts._infer(steps, s)) != plain.slot(steps):
                out.append((path, *slot))
        cols = list(zip(*out)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.int32(), pa.int32(), pa.string()))], names=["path", "times", "labels", "slot"])


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    layouts = Layouts({})
    for batch in batches:
        out = []
        for t, told in zip(batch.column("text").to_pylist(), batch.column("told").to_pylist()):
            layouts.told = {x["path"]: (x["times"], x["labels"], x["slot"]) for x in told} if told else {}
            out.append(clean_row(t, layouts))
        n = [sum(any(c.isalnum() for c in w) for w in o[0].split()) for o in out]
        arrays = [*(batch.column(c) for c in ("session_id", "turn_id", "number", "role")), *(pa.array([o[k] for o in out], t) for k, t in ((0, pa.string()), (1, pa.int32()), (2, pa.string()))), pa.array(n, pa.int32())]
        yield pa.RecordBatch.from_arrays(arrays, names=["session_id", "turn_id", "number", "role", "clean", "label_no", "label_role", "n_words"])


_SEGMENT = "session_id string, first_turn_id bigint, last_turn_id bigint, speaker_no int, n_words bigint, text string, pid int, pos int"


def _segments(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adjoining rows of one speaker become one; ``pos`` 1 first, 2 last, 3 both of the partition."""
    open_row, texts, first = None, [], True

    def out(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.string(), pa.int32(), pa.int32()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=["session_id", "first_turn_id", "last_turn_id", "speaker_no", "n_words", "text", "pid", "pos"])

    for batch in batches:
        rows = []
        for session, turn, speaker, n, text in zip(*(batch.column(c).to_pylist() for c in ("session_id", "turn_id", "speaker_no", "n_words", "clean"))):
            if open_row is not None and open_row[0] == session and open_row[3] == speaker:
                open_row[2], open_row[4] = turn, open_row[4] + n
                texts.append(text)
                continue
            if open_row is not None:
                rows.append((*open_row, " ".join(filter(None, texts)), pid, int(first)))
                first = False
            open_row, texts = [session, turn, turn, speaker, n], [text]
        if rows:
            yield out(rows)
    if open_row is not None:
        yield out([(*open_row, " ".join(filter(None, texts)), pid, 3 if first else 2)])


def speaker_number(c: str):
    """The number at the end of a speaker label."""
    return F.expr(f"try_cast(regexp_extract({c}, '([0-9]{{1,6}})[^0-9]*$', 1) as int)")


def clean_turns(turns: DataFrame, words: DataFrame, partitions: int | None = None) -> DataFrame:
    """Clean speaker turns: ``(session_id, first_turn_id, last_turn_id, speaker_no, n_words, text)``.

    ``turns`` has session_id, turn_id, speaker_cluster, role, start_s, text;
    ``words`` session_id, turn_id, speaker_cluster.  Rows with a null session,
    turn or text are disregarded, repeated rows of a turn count once, rows
    without a word left vanish.  The speaker is the number of the
    row's own label; failing that of the label in its text, of its words, or of
    the one speaker of its role in the session; null if none of these tells, and
    nulls merge with nulls.  Empty input gives an empty result.

    The statistics of layouts stay a table.  Layouts for which they say something
    else than the grammar of known labels are joined, salted, to the rows that
    show them.
    """
    rows = turns.select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), speaker_number("speaker_cluster").alias("number"), role_class("role").alias("role"), F.col("start_s").cast("double").alias("start_s"), F.col("text").cast("string").alias("text"))
    rows = rows.where("session_id is not null and turn_id is not null and text is not null")

    heads = checkpointed(rows.mapInArrow(_heads, _HEADS))
    stats = heads.where("nth = 0").groupBy("path").agg(F.count("*").alias("s0"), *(F.sum(f"s{j}").alias(f"s{j}") for j in range(1, 7)))
    # layouts of fewer lines follow the grammar of known labels
    told = stats.where(F.col("s0") >= MIN_LINES).mapInArrow(_exceptions, "path string, times int, labels int, slot string")
    shown = salted_join(heads.select("session_id", "turn_id", "path"), told, ["path"], "turn_id")
    shown = shown.groupBy("session_id", "turn_id").agg(F.collect_set(F.struct("path", "times", "labels", "slot")).alias("told"))
    once = rows.dropDuplicates(["session_id", "turn_id"]).join(shown, ["session_id", "turn_id"], "left").select("session_id", "turn_id", "number", "role", "text", "told")
    cleaned = checkpointed(once.mapInArrow(_apply, "session_id string, turn_id bigint, number int, role string, clean string, label_no int, label_role string, n_words int"))
    unlabelled = cleaned.where("number is null and label_no is null and n_words > 0").select("session_id", "turn_id")
    spoken = words.select("session_id", F.col("turn_id").cast("bigint").alias("turn_id"), speaker_number("speaker_cluster").alias("w")).where("w is not null")
    spoken = spoken.join(unlabelled, ["session_id", "turn_id"], "left_semi").groupBy("session_id", "turn_id", "w").agg(F.count("*").alias("n"))
    by_words = spoken.groupBy("session_id", "turn_id").agg(F.max_by("w", F.struct("n", F.negative("w"))).alias("words_no"))
    told = cleaned.join(by_words, ["session_id", "turn_id"], "left").withColumn("told", F.coalesce("number", "label_no", "words_no"))
    lone = told.where("told is not null").withColumn("kind", F.coalesce("label_role", "role")).where("kind is not null")
    lone = lone.groupBy("session_id", "kind").agg(F.min("told").alias("lo"), F.max("told").alias("hi")).where("lo = hi").select("session_id", "kind", F.col("lo").alias("role_no"))
    # only rows that nothing else tells meet the role map
    open_rows = told.where("told is null").withColumn("kind", F.coalesce("label_role", "role"))
    open_rows = salted_join(open_rows, lone, ["session_id", "kind"], "turn_id", "left")
    named = told.where("told is not null").withColumn("speaker_no", F.col("told")).select("session_id", "turn_id", "speaker_no", "n_words", "clean").unionByName(
        open_rows.select("session_id", "turn_id", F.col("role_no").alias("speaker_no"), "n_words", "clean")
    )
    said = named.where("n_words > 0")
    segments = checkpointed(range_scan(said, ["session_id", "turn_id"], _segments, _SEGMENT, partitions))

    # the first and last segment of each partition may go on across the border
    order = Window.orderBy("pid", "pos")
    edges = segments.where("pos > 0")
    goes_on = (F.lag("pid").over(order) != F.col("pid")) & (F.lag("session_id").over(order) == F.col("session_id")) & F.lag("speaker_no").over(order).eqNullSafe(F.col("speaker_no"))
    chains = edges.withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chains.groupBy("chain").agg(
        F.first("session_id").alias("session_id"), F.min("first_turn_id").alias("first_turn_id"), F.max("last_turn_id").alias("last_turn_id"), F.max("speaker_no").alias("speaker_no"),
        F.sum("n_words").alias("n_words"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("first_turn_id", "text"))), lambda x: x["text"]), " ").alias("text"),
    )
    columns = ["session_id", "first_turn_id", "last_turn_id", "speaker_no", "n_words", "text"]
    return segments.where("pos = 0").select(*columns).unionByName(joined.select(*columns))
