"""Registers the functions that SQL users need."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from spanloom.functions import dates, dosing, names, similarity


def _find_span(text: pd.Series, quote: pd.Series) -> pd.Series:
    return pd.Series([None if t is None or not q else t.find(q) for t, q in zip(text, quote)], dtype="Int32").replace(-1, pd.NA)


def register(spark: SparkSession) -> None:
    """normalize_name, jaro_winkler, double_metaphone, parse_sig, resolve_date, find_span (0-based, null if absent)."""
    for name, function, kind in (
        ("normalize_name", names._name_keys, "key string, salt_key string, base_key string, release_modifier string"),
        ("jaro_winkler", similarity._similarities, "double"),
        ("double_metaphone", similarity._codes, "array<string>"),
        ("parse_sig", dosing._sig, dosing.SIG_SCHEMA),
        ("resolve_date", dates._dates, dates.DATE_SCHEMA),
        ("find_span", _find_span, "int"),
    ):
        spark.udf.register(name, F.pandas_udf(function, kind))
