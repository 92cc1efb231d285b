"""Readers for pipe-delimited vocabulary releases and zipped label JSON."""

from __future__ import annotations

import io
import json
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text fields of a label record, one row each after unpivoting.
LABEL_FIELDS = ("indications_and_usage", "dosage_and_administration", "warnings", "contraindications", "drug_interactions")


def split_fields(lines: DataFrame, column: str = "value") -> DataFrame:
    """``fields`` arrays of pipe-delimited lines; the one empty field after a closing pipe is dropped, nothing is quoted."""
    fields = F.split(column, r"\|", -1)
    closed = F.element_at(fields, -1) == ""
    return lines.select(F.when(closed, F.slice(fields, 1, F.size(fields) - 1)).otherwise(fields).alias("fields"))


def read_rrf(spark: SparkSession, path: str) -> DataFrame:
    """S-01: the fields of a pipe-delimited file."""
    return split_fields(spark.read.text(path))


def concepts(rows: DataFrame) -> DataFrame:
    """S-02: English, unsuppressed concepts (rxcui, tty, str); short rows are skipped."""
    f = lambda i: F.get("fields", F.lit(i))
    return rows.where((F.size("fields") >= 17) & (f(1) == "ENG") & (f(16) != "Y")).select(f(0).alias("rxcui"), f(12).alias("tty"), f(14).alias("str"))


def attributes(rows: DataFrame, names: tuple[str, ...] = ("SPL_SET_ID", "RXN_AVAILABLE_STRENGTH")) -> DataFrame:
    """S-03: wanted attributes (rxcui, name, value) with a value."""
    f = lambda i: F.get("fields", F.lit(i))
    return rows.where((F.size("fields") > 10) & f(8).isin(*names) & (f(10) != "")).select(f(0).alias("rxcui"), f(8).alias("name"), f(10).alias("value"))


def dose_form_names(rows: DataFrame) -> DataFrame:
    """S-04: distinct lower-case dose forms."""
    return concepts(rows).where("tty = 'DF'").select(F.lower("str").alias("dose_form")).distinct()


def release_of(files: DataFrame, column: str = "path") -> DataFrame:
    """S-05: the first group of eight digits in a readme's file name; files without one raise."""
    digits = F.regexp_extract(F.element_at(F.split(column, "/"), -1), r"(\d{8})", 1)
    return files.select(F.when(digits == "", F.raise_error(F.lit("no release in the readme's name"))).otherwise(digits).alias("release"))


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """S-06: one row per record of ``results`` in all JSON members of the zip files.

    Members that are no JSON object with ``results`` give one row with a null
    record, so a broken release shows; ``labels`` skips it.  A zip is one value: its
    members are read one after the other, its records leave in batches.
    """

    def unzip(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column(0).to_pylist():
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        try:
                            results = json.loads(z.read(member)).get("results") or []
                        except (ValueError, AttributeError):
                            results = [None]
                        for at in range(0, len(results), 500):
                            yield pa.RecordBatch.from_arrays([pa.array([r if r is None else json.dumps(r) for r in results[at : at + 500]], pa.string())], names=["record"])

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(unzip, "record string")


def labels(records: DataFrame) -> tuple[DataFrame, DataFrame]:
    """S-07: (label rows, unpivoted texts) of label records; records without any set id are dropped."""
    schema = "set_id string, effective_time string, openfda struct<spl_set_id:array<string>,brand_name:array<string>,generic_name:array<string>,rxcui:array<string>>, " + ", ".join(f"{f} array<string>" for f in LABEL_FIELDS)
    r = records.select(F.from_json("record", schema).alias("r")).select("r.*")
    joined = lambda c: F.left(F.array_join(F.col(c), "; "), F.lit(200))
    own = F.coalesce(F.get("openfda.spl_set_id", F.lit(0)), "set_id")
    base = r.withColumn("spl_set_id", own).where("spl_set_id is not null")
    label = base.select("spl_set_id", joined("openfda.brand_name").alias("brand"), joined("openfda.generic_name").alias("generic"), "effective_time", (F.coalesce(F.size("openfda.rxcui"), F.lit(0)) > 0).alias("has_rxcui"))
    texts = base.select("spl_set_id", *(F.array_join(F.col(f), " ").alias(f) for f in LABEL_FIELDS)).unpivot(["spl_set_id"], list(LABEL_FIELDS), "field", "body").where("body <> ''")
    return label, texts
