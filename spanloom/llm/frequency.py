"""How often every term occurs, and in how many records: last-seen counters."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.session import shuffle_partitions

RARE_RECORDS = 2
COMMON_SHARE = 0.02
_PAIRS = "field_name string, term string, record string, occ bigint"


def _pre_count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Equal (field, term, record) of one batch become one row."""
    for batch in batches:
        t = pa.Table.from_batches([batch]).group_by(["field_name", "term", "record"]).aggregate([("occ", "sum")])
        yield from t.rename_columns(["field_name", "term", "record", "occ"]).to_batches()


def _last_seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counters over rows sorted by (field, term, record).

    The open term's counter is its occurrences, its records and the identifier
    of the record seen last; no set of records is kept.
    """
    term, occ, records, last = None, 0, 0, None

    def out(rows: list[tuple]) -> pa.RecordBatch:
        cols = list(zip(*rows)) or [[]] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.string(), pa.string(), pa.int64(), pa.int64()))], names=["field_name", "term", "n_occ", "n_records"])

    for batch in batches:
        if not batch.num_rows:
            continue
        f, t, r, n = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("field_name", "term", "record", "occ"))
        new_term = np.concatenate(([True], (t[1:] != t[:-1]) | (f[1:] != f[:-1])))
        new_record = new_term | np.concatenate(([True], r[1:] != r[:-1]))
        seen = new_record & np.array([x is not None for x in r])
        starts, rows = np.flatnonzero(new_term), []
        sums, counts = np.add.reduceat(n, starts), np.add.reduceat(seen.astype(np.int64), starts)
        for k, a in enumerate(starts.tolist()):
            if (f[a], t[a]) == term:  # only the batch's first stretch can go on with the open term
                occ, records = occ + int(sums[k]), records + int(counts[k]) - int(seen[a] and r[a] == last)
            else:
                if term is not None:
                    rows.append((*term, occ, records))
                term, occ, records = (f[a], t[a]), int(sums[k]), int(counts[k])
        last = r[-1]
        if rows:
            yield out(rows)
    if term is not None:
        yield out([(*term, occ, records)])


def term_frequency(rows: DataFrame, record: str, fields: dict[str, str | None], rare_records: int = RARE_RECORDS, common_share: float = COMMON_SHARE, partitions: int | None = None) -> DataFrame:
    """``(field_name, term, n_occ, n_records, mark)`` for every distinct term.

    ``fields`` maps a column to the separator of its terms, or None if the whole
    value is one.  Terms are lower-cased, blanks of any kind trimmed and
    collapsed; empty terms and null values don't count.  ``n_occ`` counts over
    all stored rows, ``n_records`` distinct non-null records.  ``mark`` is
    'rare' up to ``rare_records`` records, else 'common' above ``common_share``
    of all distinct records, else 'usual'.  Empty input gives no rows.

    Method: equal (term, record) pairs are pre-counted before the shuffle; terms
    are hash-partitioned with a salt taken from the record, so a term holding
    any share of the rows is spread and its partial record counts still add up;
    sorted by record, each term needs one counter with its last record.
    """
    clean = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[\s\p{Z}\u0085​﻿]+", " "))
    branches = None
    for name, separator in fields.items():
        values = rows.select(F.lit(name).alias("field_name"), F.col(record).cast("string").alias("record"), F.col(name).cast("string").alias("v")).where("v is not null")
        parts = F.explode(F.split("v", separator, -1)) if separator else F.col("v")
        branch = values.select("field_name", parts.alias("raw"), "record").select("field_name", clean(F.col("raw")).alias("term"), "record", F.lit(1).cast("bigint").alias("occ")).where("term <> ''")
        branches = branch if branches is None else branches.unionByName(branch)
    n = partitions or shuffle_partitions(rows.sparkSession)
    salt = F.pmod(F.xxhash64("record"), F.lit(n)).cast("int")  # as many parts as tasks, whatever share a term holds
    spread = branches.mapInArrow(_pre_count, _PAIRS).repartition(n, "field_name", "term", salt).sortWithinPartitions("field_name", "term", "record")
    partial = spread.mapInArrow(_last_seen, "field_name string, term string, n_occ bigint, n_records bigint")
    totals = partial.groupBy("field_name", "term").agg(F.sum("n_occ").alias("n_occ"), F.sum("n_records").alias("n_records"))
    n_all = rows.select(F.count_distinct(F.col(record).cast("string")).alias("n")).first().n
    mark = F.when(F.col("n_records") <= rare_records, "rare").when(F.col("n_records") > common_share * n_all, "common").otherwise("usual")
    return totals.withColumn("mark", mark)
