"""Readers and writers of session text: scripts, envelopes, document references."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

WORD = T.StructType([T.StructField("text", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("probability", T.DoubleType()), T.StructField("speaker_cluster", T.StringType()), T.StructField("char_offset", T.IntegerType())])
TURN = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("speaker_cluster", T.StringType()), T.StructField("role", T.StringType()), T.StructField("start", T.DoubleType()), T.StructField("end", T.DoubleType()), T.StructField("text", T.StringType()), T.StructField("char_start", T.IntegerType()), T.StructField("char_end", T.IntegerType()), T.StructField("words", T.ArrayType(WORD))])
SESSION = T.StructType([T.StructField("session_id", T.StringType()), T.StructField("visit_date", T.DateType()), T.StructField("session_dir", T.StringType()), T.StructField("audio_path", T.StringType()), T.StructField("transcript_text", T.StringType()), T.StructField("turns", T.ArrayType(TURN)), T.StructField("consent", T.StructType([T.StructField("obtained", T.BooleanType()), T.StructField("method", T.StringType()), T.StructField("obtained_at", T.TimestampNTZType())]))])


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """S-09: session documents, one JSON object per file, with the declared schema; malformed files fail."""
    return spark.read.schema(SESSION).json(path, multiLine=True, mode="FAILFAST")


def _clean(text):
    """X-16: typographic quotes, dashes, ellipses and hard blanks as ASCII."""
    return F.regexp_replace(F.translate(text, "‘’“”–— ", "''\"\"-- "), "…", "...")


def parse_script(lines: DataFrame) -> DataFrame:
    """S-10/P-22: turns of a role-play script.

    ``lines`` has session_id, line_no, raw.  Only what follows a heading
    ``## Script`` (to the next heading of that rank) counts.  ``**LABEL:** text``
    opens a turn; plain lines continue it; blank lines, rules, headings, quotes
    and table rows close it; stage directions ``*(...)*`` are dropped.
    """
    order = Window.partitionBy("session_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    heading = F.regexp_extract("raw", r"^##\s+(.*?)\s*$", 1)
    opened = F.regexp_extract("raw", r"^\*\*([^*:]+):\*\*\s*(.*)$", 1)
    body = F.when(opened != "", F.regexp_extract("raw", r"^\*\*([^*:]+):\*\*\s*(.*)$", 2)).otherwise(F.trim("raw"))
    closes = (F.trim("raw") == "") | F.col("raw").rlike(r"^\s*(---|#|>|\|)")
    marked = lines.select("session_id", "line_no", "raw", F.when(heading != "", heading).alias("h"), F.nullif(opened, F.lit("")).alias("label"), closes.alias("closes"), body.alias("body"))
    inside = marked.withColumn("part", F.last("h", ignorenulls=True).over(order)).where("lower(part) = 'script' and h is null")
    numbered = inside.withColumn("turn", F.sum(F.when(F.col("label").isNotNull(), 1).otherwise(0)).over(order)).where("turn > 0")
    block = Window.partitionBy("session_id", "turn").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    kept = numbered.withColumn("closed", F.max(F.col("closes").cast("int")).over(block)).where("closed = 0")
    said = F.trim(F.regexp_replace(F.regexp_replace(_clean(F.col("body")), r"\*\([^)]*\)\*", " "), r"\s+", " "))
    joined = kept.groupBy("session_id", "turn").agg(F.first("label", ignorenulls=True).alias("label"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", said.alias("s")))), lambda x: x["s"]), " ").alias("text"))
    clinician = F.upper("label").rlike(r"^(DR|DOC|CLINICIAN|PHYSICIAN|NURSE)")
    return joined.select("session_id", (F.col("turn") - 1).cast("int").alias("turn_id"), "label", F.when(clinician, "clinician").otherwise("other").alias("role"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("text")).where("text <> ''")


def parse_output(rows: DataFrame, text: str) -> DataFrame:
    """S-14: how a model's answer can be read: 'whole' JSON, the outermost braces ('salvaged'), or 'malformed' ('empty' if blank)."""
    raw = F.col(text).cast("string")
    inner = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    readable = lambda c: F.try_parse_json(c).isNotNull()
    kind = F.when(raw.isNull() | (F.trim(raw) == ""), "empty").when(readable(raw), "whole").when((inner != "") & readable(inner), "salvaged").otherwise("malformed")
    return rows.withColumn("reading", kind).withColumn("readable", F.when(kind == "whole", raw).when(kind == "salvaged", inner))


def document_reference(rows: DataFrame, key: str, html: str) -> DataFrame:
    """S-17: attachment fields of a document reference: base64 of the UTF-8 bytes, their number, base64 of the SHA-1 digest."""
    data = F.encode(F.col(html), "UTF-8")
    return rows.select(key, F.base64(data).alias("data"), F.octet_length(F.col(html)).alias("size"), F.base64(F.unhex(F.sha1(data))).alias("hash"))


def write_envelopes(rows: DataFrame, path: str) -> None:
    """S-16: one JSON object per line."""
    rows.select(F.to_json(F.struct(*rows.columns)).alias("value")).write.mode("overwrite").text(path)


def session_documents(sessions: DataFrame, turns: DataFrame, words: DataFrame) -> DataFrame:
    """S-09/S-16: ``(session_id, document)``: sessions with their turns and words as one JSON object each, as ``parse_sessions`` reads it."""
    word = F.struct("word_idx", F.struct("text", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "probability", "speaker_cluster", "char_offset").alias("w"))
    listed = words.groupBy("session_id", "turn_id").agg(F.transform(F.array_sort(F.collect_list(word)), lambda x: x["w"]).alias("words"))
    turn = F.struct(F.col("turn_id").alias("id"), "speaker_cluster", "role", F.col("start_s").alias("start"), F.col("end_s").alias("end"), "text", "char_start", "char_end", "words")
    whole = turns.join(listed, ["session_id", "turn_id"], "left").groupBy("session_id").agg(F.array_sort(F.collect_list(turn), lambda a, b: a["id"] - b["id"]).alias("turns"))
    fields = ["session_id", "visit_date", "session_dir", "audio_path", "transcript_text", "turns", "consent"]
    return sessions.join(whole, "session_id", "left").select("session_id", F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("document"))


def parse_sessions(documents: DataFrame, column: str = "document") -> DataFrame:
    """S-09: session documents as columns of the declared schema; a malformed one fails."""
    return documents.select(F.from_json(column, SESSION, {"mode": "FAILFAST"}).alias("d")).select("d.*")


def write_tables(tables: dict[str, DataFrame], folder: str) -> None:
    """S-15: each table as Parquet below ``folder``, made anew."""
    for name, rows in tables.items():
        rows.write.mode("overwrite").parquet(f"{folder}/{name}.parquet")


def append_log(rows: DataFrame, path: str, never: tuple[str, ...] = ("text", "quote")) -> None:
    """S-18: rows appended as tab-separated lines, without the columns that hold what was said."""
    kept = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in rows.columns if c not in never]
    rows.select(F.concat_ws("\t", *(F.regexp_replace(c, r"[\t\r\n]+", " ") for c in kept)).alias("value")).write.mode("append").text(path)
