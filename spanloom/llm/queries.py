"""Queries over the project's tables and, where SQL can say it, their oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spanloom.llm.canonical import map_to_reference
from spanloom.llm.frequency import term_frequency
from spanloom.llm.leaks import find_leaks, find_passages
from spanloom.llm.mixture import mix_sources, shuffled_copies
from spanloom.llm.personal import find_personal, mask_personal, name_table
from spanloom.llm.residue import find_residue
from spanloom.llm.runs import collapse_runs
from spanloom.llm.transcript import clean_turns
from spanloom.session import table


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Stretches of the same word said again within a turn."""
    words = table(spark, d, "words", "session_id", "turn_id", "word_idx", "text", "start_s", "end_s")
    runs = collapse_runs(words, "session_id", "turn_id", "word_idx", "text", "start_s", "end_s")
    return runs.select(
        F.col("grp").alias("session_id"), F.col("sub").cast("int").alias("turn_id"), F.col("first_idx").cast("int").alias("first_word_idx"),
        F.col("last_idx").cast("int").alias("last_word_idx"), F.col("n_events").cast("int").alias("n_events"), "duration_ms",
    )


def p4_turns(spark: SparkSession, d: str) -> DataFrame:
    """Clean turns, one per uninterrupted speaker, in spoken order, with their text."""
    turns = table(spark, d, "turns", "session_id", "turn_id", "speaker_cluster", "role", "start_s", "text")
    rows = clean_turns(turns, table(spark, d, "words", "session_id", "turn_id", "speaker_cluster"))
    ints = ("first_turn_id", "last_turn_id", "speaker_no", "n_words")
    return rows.select("session_id", *(F.col(c).cast("int").alias(c) for c in ints), "text")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """The turns' first and last rows, speakers and words; the texts are made all the same."""
    return p4_turns(spark, d).drop("text")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The entry of the name list that every typed name means, or ''."""
    return p5_matches(spark, d).select("entry_id", "rxcui")


def p5_matches(spark: SparkSession, d: str) -> DataFrame:
    """The same with the name as typed and the score of its match."""
    mapped = map_to_reference(table(spark, d, "med_entries", "entry_id", "canonical_name"), "entry_id", "canonical_name", table(spark, d, "name_index", "str", "key", "rxcui"), ["key", "str"], "rxcui")
    return mapped.withColumnRenamed("code", "rxcui")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Occurrences and products of every ingredient and term type."""
    return term_frequency(table(spark, d, "product", "rxcui", "ingredient_key", "tty"), "rxcui", {"ingredient_key": "/", "tty": None})


_TEXTS = {"sessions": ("transcript_text", None), "turns": ("text", "turn_id"), "dropped_words": ("text", "dropped_idx")}


def _names(spark: SparkSession, d: str) -> DataFrame:
    return name_table(table(spark, d, "sessions", "session_id", "transcript_text").distinct(), "transcript_text")


def p7_mentions(spark: SparkSession, d: str) -> DataFrame:
    """Every mention of personal data with its place and score."""
    texts = None
    for name, (column, row) in _TEXTS.items():
        row_no = F.col(row).cast("int") if row else F.lit(0)
        part = table(spark, d, name).select(F.lit(name).alias("source_table"), "session_id", row_no.alias("row_no"), F.col(column).alias("text"))
        texts = part if texts is None else texts.unionByName(part)
    return find_personal(texts, ["source_table", "session_id", "row_no"], "text", _names(spark, d)).distinct()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """The mentions' tables, rows, types and first characters."""
    return p7_mentions(spark, d).select("source_table", "session_id", "row_no", "pii_type", "char_start").distinct()


def _masked(name: str) -> Callable[[SparkSession, str], DataFrame]:
    column, row = _TEXTS[name]

    def run(spark: SparkSession, d: str) -> DataFrame:
        rows = table(spark, d, name, "session_id", *([row] if row else []), column).distinct()
        return mask_personal(rows, column, _names(spark, d))

    run.__doc__ = f"``{name}.{column}`` with typed placeholders instead of personal data."
    return run


p7_masked_turns, p7_masked_sessions, p7_masked_dropped_words = map(_masked, ("turns", "sessions", "dropped_words"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding twelve consecutive words of an evaluation item."""
    return p8_leak_runs(spark, d).select("doc_id", "item_id")


def p8_leak_runs(spark: SparkSession, d: str) -> DataFrame:
    """The same pairs with the longest run of words found."""
    return find_leaks(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text")


def p8_passages(spark: SparkSession, d: str) -> DataFrame:
    """Documents holding twelve words of an item with at most one changed character, and the edits."""
    return find_passages(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text")


def _mixture(spark: SparkSession, d: str):
    return mix_sources(table(spark, d, "documents", "doc_id", "source", "text"), "doc_id", "source", "text", table(spark, d, "mix_targets"))


def p9_mix(spark: SparkSession, d: str) -> DataFrame:
    """The mixed corpus: one row per chosen copy of a document, with its text, globally shuffled."""
    return shuffled_copies(_mixture(spark, d).texts)


def p9_repeats(spark: SparkSession, d: str) -> DataFrame:
    """How often every used document is repeated, and its tokens."""
    return _mixture(spark, d).repeats


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target, reachable and actual share of every source."""
    return _mixture(spark, d).shares


def _residue(spark: SparkSession, d: str) -> DataFrame:
    return find_residue(table(spark, d, "documents", "doc_id", "text", "status_code"), "doc_id", "text", labelled=F.col("status_code") >= 400)


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents that are template residue, filler or error pages."""
    return _residue(spark, d).where("is_residue").select("doc_id")


def p10_pages(spark: SparkSession, d: str) -> DataFrame:
    """Residue and content words and unfilled fields of every document."""
    return _residue(spark, d)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p2_found": p2_found,
    "p4_found": p4_found,
    "p4_turns": p4_turns,
    "p5_found": p5_found,
    "p5_matches": p5_matches,
    "p6_found": p6_found,
    "p7_found": p7_found,
    "p7_mentions": p7_mentions,
    "p7_masked_turns": p7_masked_turns,
    "p7_masked_sessions": p7_masked_sessions,
    "p7_masked_dropped_words": p7_masked_dropped_words,
    "p8_found": p8_found,
    "p8_leak_runs": p8_leak_runs,
    "p8_passages": p8_passages,
    "p9_mix": p9_mix,
    "p9_repeats": p9_repeats,
    "p9_shares": p9_shares,
    "p10_found": p10_found,
    "p10_pages": p10_pages,
}

_LEAK_SQL = r"""
        WITH clean AS (
            SELECT 'd' AS side, doc_id AS id, text FROM documents WHERE text IS NOT NULL
            UNION ALL SELECT DISTINCT 'i', item_id, text FROM eval_items WHERE text IS NOT NULL),
        bare AS (SELECT side, id, regexp_replace(regexp_replace(regexp_replace(text, '[\x{00AD}\x{200B}-\x{200F}\x{2060}-\x{2064}\x{FEFF}]', '', 'g'), '</?(br|p|div|li|ul|ol|tr|td|th|table|h[1-6]|hr)\b[^<>]*>', ' ', 'gi'), '</?[a-zA-Z][^<>]*>', '', 'g') AS t FROM clean),
        words AS (SELECT side, id, string_split(trim(regexp_replace(lower(t), '[^\p{L}\p{N}]+', ' ', 'g')), ' ') AS w FROM bare),
        runs AS (SELECT DISTINCT side, id, unnest(list_transform(range(greatest(len(w) - 11, 0)), lambda i: array_to_string(list_slice(w, i + 1, i + 12), ' '))) AS run FROM words)
        SELECT DISTINCT d.id AS doc_id, i.id AS item_id FROM runs d JOIN runs i ON d.run = i.run AND d.side = 'd' AND i.side = 'i'""".replace("\\\\", "\\")

ORACLES: dict[str, str] = {
    "p8_found": _LEAK_SQL,
    "p2_found": r"""
        WITH w AS (
            SELECT DISTINCT session_id, turn_id, word_idx, start_s, end_s,
                   regexp_replace(lower(strip_accents(text)), '[^\p{L}\p{N}]', '', 'g') AS f
            FROM words WHERE session_id IS NOT NULL AND turn_id IS NOT NULL AND word_idx IS NOT NULL),
        m AS (SELECT *, lag(f) OVER (PARTITION BY session_id, turn_id ORDER BY start_s, word_idx) AS p FROM w),
        g AS (SELECT *, sum(CASE WHEN f <> '' AND f = p THEN 0 ELSE 1 END)
                     OVER (PARTITION BY session_id, turn_id ORDER BY start_s, word_idx ROWS UNBOUNDED PRECEDING) AS k FROM m)
        SELECT session_id, turn_id, arg_min(word_idx, (start_s, word_idx)) AS first_word_idx,
               arg_max(word_idx, (start_s, word_idx)) AS last_word_idx, CAST(count(*) AS INTEGER) AS n_events,
               CAST(round(arg_max(end_s, (start_s, word_idx)) * 1000) AS BIGINT) - CAST(round(min(start_s) * 1000) AS BIGINT) AS duration_ms
        FROM g GROUP BY session_id, turn_id, k HAVING count(*) > 1""",
    "p6_found": r"""
        WITH parts AS (
            SELECT 'ingredient_key' AS field_name, unnest(string_split(ingredient_key, '/')) AS raw, rxcui FROM product WHERE ingredient_key IS NOT NULL
            UNION ALL SELECT 'tty', tty, rxcui FROM product WHERE tty IS NOT NULL),
        terms AS (SELECT field_name, trim(regexp_replace(lower(raw), '[\s\p{Z}\x{0085}\x{200B}\x{FEFF}]+', ' ', 'g')) AS term, rxcui FROM parts),
        n AS (SELECT count(DISTINCT rxcui) AS n_all FROM product)
        SELECT field_name, term, count(*) AS n_occ, count(DISTINCT rxcui) AS n_records,
               CASE WHEN count(DISTINCT rxcui) <= 2 THEN 'rare' WHEN count(DISTINCT rxcui) > 0.02 * any_value(n_all) THEN 'common' ELSE 'usual' END AS mark
        FROM terms, n WHERE term <> '' GROUP BY field_name, term""",
}
