"""Merging overlapping intervals and listing the gaps between them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.rangescan import range_scan
from spanloom.session import checkpointed

_LOCAL = "entity string, lo bigint, hi bigint, prev_hi bigint, pid int"


def _local_islands(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Merge the sorted spans of one partition; state is one open island."""
    open_entity, open_lo, open_hi, before = None, 0, 0, None

    def out(entity, lo, hi, prev) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [
                pa.array(entity, pa.string()),
                pa.array(lo, pa.int64()),
                pa.array(hi, pa.int64()),
                pa.array(prev, pa.int64()),
                pa.array(np.full(len(lo), pid, np.int32)),
            ],
            names=["entity", "lo", "hi", "prev_hi", "pid"],
        )

    for batch in batches:
        if not batch.num_rows:
            continue
        codes = batch.column("entity").dictionary_encode()
        names, code = codes.dictionary.to_pylist(), codes.indices.to_numpy(zero_copy_only=False)
        lo, hi = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lo", "hi"))
        entities, los, his, prevs = [], [], [], []
        bounds = np.flatnonzero(np.diff(code)) + 1
        for a, b in zip([0, *bounds], [*bounds, len(code)]):
            name, s, e = names[code[a]], lo[a:b], np.maximum.accumulate(hi[a:b])
            if name == open_entity:
                e = np.maximum(e, open_hi)
            elif open_entity is not None:
                entities.append(open_entity), los.append(open_lo), his.append(open_hi), prevs.append(before)
            reach = np.concatenate(([open_hi if name == open_entity else np.iinfo(np.int64).min], e[:-1]))
            starts = np.flatnonzero(s > reach) if name == open_entity else np.unique(np.concatenate(([0], np.flatnonzero(s > reach))))
            if name != open_entity:
                open_entity, open_lo, before = name, int(s[0]), None
                starts = starts[1:]
            for k in starts.tolist():  # the open island ends where the next begins
                closed = int(reach[k])
                entities.append(name), los.append(open_lo), his.append(closed), prevs.append(before)
                open_lo, before = int(s[k]), closed
            open_hi = int(e[-1])
        if los:
            yield out(entities, los, his, prevs)
    if open_entity is not None:
        yield out([open_entity], [open_lo], [open_hi], [before])


def merge_intervals(spans: DataFrame, entity: str, start: str, end: str, partitions: int | None = None) -> DataFrame:
    """Continuous periods and the gaps between them, per entity.

    ``start`` and ``end`` are integral columns.  Rows with a null entity, a null
    bound or an end not after the start are disregarded; touching intervals
    join; repeated intervals change nothing.  Other columns are ignored, so
    clashing names do no harm.  Returns ``(entity, kind, lo, hi)`` with kind
    ``period`` or ``gap``; an empty input gives an empty result.

    Method: global range sort by (entity, start); every partition merges its own
    run in one streaming pass; each partition is summarised by the maximum end
    of its last entity; the summaries are prefix-combined (one row per
    partition); and the local islands are re-scanned with the carried end and
    the carried island label.  An entity holding any share of all rows is spread
    over as many partitions as its rows fill.
    """
    rows = spans.select(
        F.col(entity).cast("string").alias("entity"), F.col(start).cast("bigint").alias("lo"), F.col(end).cast("bigint").alias("hi")
    ).where("entity is not null and lo is not null and hi is not null and hi > lo")
    local = checkpointed(range_scan(rows, ["entity", "lo", "hi"], _local_islands, _LOCAL, partitions))

    # one summary per partition: its first and last entity, and the maximum end of the last one
    edge = local.groupBy("pid").agg(F.min("entity").alias("first"), F.max_by(F.struct("entity", "hi"), F.struct("entity", "lo")).alias("tail"))
    in_out = edge.select(F.col("first").alias("entity"), "pid", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("reach")).unionByName(
        edge.select("tail.entity", "pid", F.lit(1).alias("side"), F.col("tail.hi").alias("reach"))
    )
    so_far = Window.partitionBy("entity").orderBy("pid", "side").rowsBetween(Window.unboundedPreceding, -1)
    carry = in_out.withColumn("carry_hi", F.max("reach").over(so_far)).where("side = 0 and carry_hi is not null")
    carry = carry.select(F.col("pid").alias("c_pid"), F.col("entity").alias("c_entity"), "carry_hi")

    scanned = local.join(F.broadcast(carry), (F.col("pid") == F.col("c_pid")) & (F.col("entity") == F.col("c_entity")), "left")
    scanned = scanned.withColumn("opens", F.col("carry_hi").isNull() | (F.col("lo") > F.col("carry_hi")))
    gaps = scanned.where(F.col("opens") & (F.col("prev_hi").isNotNull() | F.col("carry_hi").isNotNull())).select(
        "entity", F.lit("gap").alias("kind"), F.greatest("prev_hi", "carry_hi").alias("lo"), F.col("lo").alias("hi")
    )

    # islands that do not open belong to the last opener of an earlier partition
    opener = scanned.where("opens").groupBy("pid", "entity").agg(F.max("lo").alias("label"))
    waiting = scanned.where("not opens").groupBy("pid", "entity").agg(F.max("hi").alias("late_hi"))
    steps = opener.join(edge.select("pid", F.col("tail.entity").alias("entity")), ["pid", "entity"], "left_semi").select(
        "entity", "pid", F.lit(1).alias("side"), "label", F.lit(None).cast("bigint").alias("late_hi")
    ).unionByName(waiting.select("entity", "pid", F.lit(0).alias("side"), F.lit(None).cast("bigint").alias("label"), "late_hi"))
    late = steps.withColumn("label", F.when(F.col("side") == 0, F.max("label").over(so_far)).otherwise(F.col("label"))).where("side = 0")
    late = late.groupBy("entity", "label").agg(F.max("late_hi").alias("late_hi"))  # at most one row per partition
    periods = (
        scanned.where("opens")
        .join(F.broadcast(late.select(F.col("entity").alias("l_entity"), F.col("label").alias("l_lo"), "late_hi")), (F.col("entity") == F.col("l_entity")) & (F.col("lo") == F.col("l_lo")), "left")
        .select("entity", F.lit("period").alias("kind"), "lo", F.greatest("hi", "late_hi").alias("hi"))
    )
    return periods.unionByName(gaps)
