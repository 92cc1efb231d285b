"""Global range sort with one streaming pass per partition.

Operators that need "the row before this one" over groups of any size (one
entity may hold a third of all rows) cannot use a window partitioned by the
entity: that puts the whole entity in one task.  Here rows are range-partitioned
by (entity, order), so a hot entity is spread over many partitions; every
partition is scanned once with constant state, and what crosses a partition
border travels in one summary row per partition.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from spanloom.session import checkpointed, shuffle_partitions


def range_scan(
    df: DataFrame,
    keys: list[str],
    scan: Callable[[int, Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
    schema: str,
    partitions: int | None = None,
) -> DataFrame:
    """Range-sort ``df`` by ``keys`` and run ``scan(partition_id, batches)``.

    Equal key tuples always meet in one partition.  The number of partitions is
    explicit, so adaptive execution does not merge or split them.
    """
    n = partitions or shuffle_partitions(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from scan(TaskContext.get().partitionId(), batches)

    ordered = df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
    return ordered.mapInArrow(run, schema)


def _stepper(entity: str, sums: list[str], lags: list[str]):
    """Partition-local running sums (exclusive) and previous values per entity."""

    def scan(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_entity, totals, last = None, [0.0] * len(sums), [None] * len(lags)
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(entity).dictionary_encode()
            code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            starts = np.concatenate(([0], np.flatnonzero(np.diff(code)) + 1))
            goes_on = names[code[0]] == open_entity
            first = np.zeros(len(code), bool)
            first[starts] = True
            own = first.copy()  # rows whose predecessor lies in no earlier row of this partition
            own[0] = not goes_on
            segment = np.repeat(np.arange(len(starts)), np.diff(np.concatenate((starts, [len(code)]))))
            arrays = list(batch.columns)
            for k, c in enumerate(sums):
                v = batch.column(c).to_numpy(zero_copy_only=False).astype(float)
                running = np.concatenate(([0.0], np.cumsum(v)))
                before = running[:-1] - running[starts][segment]
                if goes_on:
                    before[segment == 0] += totals[k]
                totals[k] = float(before[-1] + v[-1])
                arrays.append(pa.array(before, pa.float64()))
            for k, c in enumerate(lags):
                values = batch.column(c)
                shifted = pa.concat_arrays([pa.array([last[k] if goes_on else None], values.type), values.slice(0, len(values) - 1)])
                arrays.append(pa.compute.if_else(pa.array(first & (np.arange(len(code)) > 0)), pa.scalar(None, values.type), shifted))
                last[k] = values[len(values) - 1].as_py()
            open_entity = names[code[-1]]
            arrays += [pa.array(own), pa.array(np.full(len(code), pid, np.int32))]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *(f"before_{c}" for c in sums), *(f"prev_{c}" for c in lags), "_opens", "_pid"])

    return scan


def annotate(df: DataFrame, entity: str, order: list[str], sums: list[str] = (), lags: list[str] = (), partitions: int | None = None) -> DataFrame:
    """Running sums before each row and previous values, per entity of any size.

    Adds ``before_<c>`` for each of ``sums`` (double, sum over the entity's
    earlier rows), ``prev_<c>`` for each of ``lags`` and ``is_first``.  Rows with
    a null entity are dropped.  An entity is spread over range partitions; one
    row per partition carries its state across the border.
    """
    rows = df.where(F.col(entity).isNotNull())
    sums, lags = list(sums), list(lags)
    types = dict(rows.dtypes)
    schema = ", ".join([*(f"`{c}` {t}" for c, t in types.items()), *(f"`before_{c}` double" for c in sums), *(f"`prev_{c}` {types[c]}" for c in lags), "_opens boolean", "_pid int"])
    step = checkpointed(range_scan(rows, [entity, *order], _stepper(entity, sums, lags), schema, partitions))

    last = F.struct(F.col(entity).alias("e"), *(F.col(c).alias(f"o{i}") for i, c in enumerate(order)))
    state = F.struct(F.col(entity).alias("entity"), *((F.col(f"before_{c}") + F.col(c)).alias(f"t_{c}") for c in sums), *(F.col(c).alias(f"l_{c}") for c in lags))
    edge = step.groupBy("_pid").agg(F.max_by(state, last).alias("tail"), F.min(entity).alias("first"))
    # at most two rows per partition: where an entity leaves one, and where it enters one
    leave = edge.select(F.col("tail.entity").alias("entity"), F.col("_pid"), F.lit(1).alias("side"), F.col("tail").alias("state"))
    enter = edge.select(F.col("first").alias("entity"), F.col("_pid"), F.lit(0).alias("side"), F.lit(None).cast(edge.schema["tail"].dataType).alias("state"))
    so_far = Window.partitionBy("entity").orderBy("_pid", "side").rowsBetween(Window.unboundedPreceding, -1)
    carried = leave.unionByName(enter)
    for c in sums:
        carried = carried.withColumn(f"c_{c}", F.sum(F.col("state")[f"t_{c}"]).over(so_far))
    for c in lags:
        carried = carried.withColumn(f"c_{c}_l", F.last(F.col("state")[f"l_{c}"]).over(so_far))
    carried = carried.withColumn("seen", F.count("state").over(so_far)).where("side = 0 and seen > 0").select(F.col("entity").alias("_e"), F.col("_pid").alias("_p"), *(f"c_{c}" for c in sums), *(f"c_{c}_l" for c in lags))

    out = step.join(F.broadcast(carried), (F.col("_pid") == F.col("_p")) & (F.col(entity) == F.col("_e")), "left")
    columns = [*types, *((F.col(f"before_{c}") + F.coalesce(f"c_{c}", F.lit(0.0))).alias(f"before_{c}") for c in sums)]
    columns += [F.when(F.col("_opens"), F.col(f"c_{c}_l")).otherwise(F.col(f"prev_{c}")).alias(f"prev_{c}") for c in lags]
    return out.select(*columns, (F.col("_opens") & F.col("_p").isNull()).alias("is_first"))


def _island_scan(entity: str, order: str, label: str, size: str, label_type: pa.DataType):
    """Stretches of rows of one entity and label within a partition; ``pos`` 1 marks its first, 2 its last, 3 both."""

    def scan(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_row, first = None, True  # entity, label, first, last, n, total

        def out(rows: list[tuple]) -> pa.RecordBatch:
            types = [pa.string(), label_type, pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.int32()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=[entity, "label", "first", "last", "n", "total", "pid", "pos"])

        for batch in batches:
            if not batch.num_rows:
                continue
            codes = batch.column(entity).dictionary_encode()
            code, names = codes.indices.to_numpy(zero_copy_only=False), codes.dictionary.to_pylist()
            labels = batch.column(label).dictionary_encode()
            value, values = labels.indices.fill_null(-1).to_numpy(zero_copy_only=False), [*labels.dictionary.to_pylist(), None]
            new = np.concatenate(([True], (np.diff(code) != 0) | (np.diff(value) != 0)))
            starts = np.flatnonzero(new)
            stops = np.concatenate((starts[1:], [len(code)]))
            at = batch.column(order).to_numpy(zero_copy_only=False)
            totals = np.add.reduceat(batch.column(size).to_numpy(zero_copy_only=False).astype(float), starts)
            rows = []
            for a, b, total in zip(starts.tolist(), stops.tolist(), totals.tolist()):
                row = [names[code[a]], values[value[a]], int(at[a]), int(at[b - 1]), b - a, total]
                if open_row is not None and open_row[:2] == row[:2]:
                    open_row[3], open_row[4], open_row[5] = row[3], open_row[4] + row[4], open_row[5] + total
                    continue
                if open_row is not None:
                    rows.append((*open_row, pid, int(first)))
                    first = False
                open_row = row
            if rows:
                yield out(rows)
        if open_row is not None:
            yield out([(*open_row, pid, 3 if first else 2)])

    return scan


def islands(df: DataFrame, entity: str, order: str, label: str, size: str, partitions: int | None = None) -> DataFrame:
    """Stretches of successive rows of one label, per entity of any size, in one scan.

    ``entity`` is a string, ``order`` a bigint, ``size`` a double, ``label`` of any plain type.
    Returns (entity, label, first, last, n, total): the order of the first and
    last row, their number and the sum of their sizes.  A null label is a label of
    its own; rows with a null entity or order are dropped, a null size counts 0.
    """
    rows = df.where(F.col(entity).isNotNull() & F.col(order).isNotNull()).fillna(0.0, [size]).select(entity, order, label, size)
    kind = dict(rows.dtypes)[label]
    label_type = to_arrow_type(rows.schema[label].dataType)
    schema = f"`{entity}` string, label {kind}, first bigint, last bigint, n bigint, total double, pid int, pos int"
    found = checkpointed(range_scan(rows, [entity, order], _island_scan(entity, order, label, size, label_type), schema, partitions))
    # at most two rows per partition may go on across a border
    window = Window.orderBy("pid", "pos")
    before = lambda c: F.lag(c).over(window)
    goes_on = (before("pid") != F.col("pid")) & (before(entity) == F.col(entity)) & before("label").eqNullSafe(F.col("label"))
    chains = found.where("pos > 0").withColumn("new", F.when(goes_on, 0).otherwise(1)).withColumn("chain", F.sum("new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    joined = chains.groupBy("chain").agg(F.first(entity).alias(entity), F.max("label").alias("label"), F.min("first").alias("first"), F.max("last").alias("last"), F.sum("n").alias("n"), F.sum("total").alias("total"))
    columns = [entity, "label", "first", "last", "n", "total"]
    return found.where("pos = 0").select(*columns).unionByName(joined.select(*columns))
