"""Runs of repeated consecutive events, collapsed by pointer doubling."""

from __future__ import annotations

import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from spanloom.operators.rangescan import range_scan
from spanloom.session import checkpointed

_EVENT = "grp string, sub bigint, idx bigint, start_ms bigint, end_ms bigint, form string, prev_idx bigint, pid int, edge int"


def letters_and_digits(token: str) -> str:
    """Token without case, accents and everything but letters and digits."""
    plain = "".join(c for c in unicodedata.normalize("NFKD", token.casefold()) if not unicodedata.combining(c))
    return "".join(c for c in plain if c.isalnum())


def _scanner(form: Callable[[str], str]) -> Callable:
    def scan(pid: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, str] = {}
        names = ["grp", "sub", "idx", "start_ms", "end_ms", "form", "prev_idx", "pid", "edge"]
        types = [pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int32(), pa.int32()]
        last, written, any_row = None, False, False  # last event: (grp, sub, idx, start, end, form)

        def forms(column: pa.Array) -> np.ndarray:
            d = column.dictionary_encode()
            values = []
            for t in d.dictionary.to_pylist():
                if (f := known.get(t)) is None:
                    f = form(t)
                    if len(known) < 200_000:
                        known[t] = f
                values.append(f)
            return np.array([*values, ""], dtype=object)[d.indices.fill_null(len(values)).to_numpy(zero_copy_only=False)]

        for batch in batches:
            if not batch.num_rows:
                continue
            grp = batch.column("grp").to_numpy(zero_copy_only=False)
            sub, idx, lo, hi = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("sub", "idx", "start_ms", "end_ms"))
            f = forms(batch.column("token"))
            if last is not None:  # the event before the batch leads it
                grp, f = np.concatenate(([last[0]], grp)), np.concatenate(([last[5]], f))
                sub, idx, lo, hi = (np.concatenate(([v], a)) for v, a in zip(last[1:5], (sub, idx, lo, hi)))
            same = (grp[1:] == grp[:-1]) & (sub[1:] == sub[:-1])
            fresh = np.concatenate(([True], ~(same & (idx[1:] == idx[:-1]))))
            grp, sub, idx, lo, hi, f = (a[fresh] for a in (grp, sub, idx, lo, hi, f))
            same = (grp[1:] == grp[:-1]) & (sub[1:] == sub[:-1])
            match = same & (f[1:] == f[:-1]) & (f[1:] != "")
            keep = np.zeros(len(f), bool)
            keep[1:] |= match
            keep[:-1] |= match
            prev = np.full(len(f), -1)
            prev[1:][match] = idx[:-1][match]
            edge = np.zeros(len(f), np.int32)
            if not any_row:
                keep[0], edge[0], any_row = True, 1, True
            lead = last is not None
            if lead:  # written before, or as the start of a run that only now shows
                keep[0] = keep[0] and not written
            at = np.flatnonzero(keep)
            last, written = (grp[-1], sub[-1], idx[-1], lo[-1], hi[-1], f[-1]), bool(keep[-1]) or (written and len(f) == 1)
            if len(at):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t, mask=m) for c, t, m in zip(
                        (grp[at], sub[at], idx[at], lo[at], hi[at], f[at], prev[at], np.full(len(at), pid), edge[at]), types,
                        (None, None, None, None, None, None, prev[at] < 0, None, None))],
                    names=names,
                )
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip((*last, None, pid, 2), types)], names=names)

    return scan


def collapse_runs(
    events: DataFrame, group: str, subgroup: str, index: str, token: str, start_s: str, end_s: str,
    form: Callable[[str], str] = letters_and_digits, partitions: int | None = None,
) -> DataFrame:
    """Each longest run of at least two equal successive events as one row.

    Events of one (group, subgroup) succeed one another by (start, index); they
    are equal when ``form`` of their token is.  An event whose form is empty
    (also a null token) belongs to no run and interrupts it.  Rows with a null
    group, subgroup, index or time are disregarded; repeated rows of one index
    count once.  Returns ``(grp, sub, first_idx, last_idx, n_events,
    duration_ms)``; no runs, or no rows, give an empty result.

    Method: events are range-sorted, so a group of any size is spread over
    partitions.  One streaming pass links each event to an equal predecessor and
    keeps only members of runs plus one first and one last row per partition,
    from which links across borders follow.  Then pointer doubling: every
    pointer is replaced by its target's pointer until all reach their run's
    start, in log2(longest run) self-joins.  Events that have arrived leave the
    moving side, so no join key is hot however long a run is.
    """
    ms = lambda c: F.round(F.col(c).cast("double") * 1000).cast("bigint")
    finite = " and ".join(f"`{c}` is not null and abs(cast(`{c}` as double)) < 1e12" for c in (start_s, end_s))
    rows = events.where(finite).select(
        F.col(group).cast("string").alias("grp"), F.col(subgroup).cast("bigint").alias("sub"), F.col(index).cast("bigint").alias("idx"),
        ms(start_s).alias("start_ms"), ms(end_s).alias("end_ms"), F.col(token).cast("string").alias("token"),
    ).where("grp is not null and sub is not null and idx is not null")
    scanned = checkpointed(range_scan(rows, ["grp", "sub", "start_ms", "idx"], _scanner(form), _EVENT, partitions))

    # one first (edge 1) and one last (edge 2) row per partition: links across partition borders
    border = Window.orderBy("pid", "edge")
    edges = scanned.where("edge > 0").select("grp", "sub", "idx", "form", "pid", "edge")
    before = lambda c: F.lag(c).over(border)
    links = (
        edges.withColumn("link", F.when((before("edge") == 2) & (before("grp") == F.col("grp")) & (before("sub") == F.col("sub")) & (before("form") == F.col("form")) & (F.col("form") != ""), before("idx")))
        .where("edge = 1 and link is not null")
        .select(F.col("grp").alias("l_grp"), F.col("sub").alias("l_sub"), F.col("idx").alias("l_idx"), "link")
    )
    linked = scanned.join(F.broadcast(links), (F.col("grp") == F.col("l_grp")) & (F.col("sub") == F.col("l_sub")) & (F.col("idx") == F.col("l_idx")), "left")
    nodes = checkpointed(
        linked.groupBy("grp", "sub", "idx").agg(
            F.min("start_ms").alias("start_ms"), F.max("end_ms").alias("end_ms"), F.max(F.coalesce("prev_idx", "link")).alias("ptr")
        ).withColumn("root", F.col("ptr").isNull()).withColumn("ptr", F.coalesce("ptr", "idx"))
    )

    key = ["grp", "sub"]
    arrived = nodes.where("root").select(*key, "idx", F.col("idx").alias("ptr"))
    moving = nodes.where("not root").select(*key, "idx", "ptr")
    done = [arrived]
    while True:
        arrived_ids = F.lit(True).alias("there")
        table = arrived.select(*key, F.col("idx").alias("ptr"), F.col("ptr").alias("next"), arrived_ids).unionByName(
            moving.select(*key, F.col("idx").alias("ptr"), F.col("ptr").alias("next"), F.lit(False).alias("there"))
        )
        stepped = checkpointed(moving.join(table, [*key, "ptr"]).select(*key, "idx", F.col("next").alias("ptr"), "there"))
        reached = stepped.where("there").select(*key, "idx", "ptr")
        moving = stepped.where("not there").select(*key, "idx", "ptr")
        done.append(reached)
        arrived = arrived.unionByName(reached)
        if moving.isEmpty():
            break
    labels = arrived.withColumnRenamed("ptr", "first_idx")
    runs = nodes.select(*key, "idx", "start_ms", "end_ms").join(labels, [*key, "idx"])
    return (
        runs.groupBy(*key, "first_idx")
        .agg(F.count("*").alias("n_events"), F.max_by(F.struct("idx", "end_ms"), F.struct("start_ms", "idx")).alias("tail"), F.min("start_ms").alias("lo"))
        .where("n_events > 1")
        .select(*key, "first_idx", F.col("tail.idx").alias("last_idx"), "n_events", (F.col("tail.end_ms") - F.col("lo")).alias("duration_ms"))
    )
