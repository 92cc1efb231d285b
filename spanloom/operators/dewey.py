"""Shredding nested JSON records into linked flat tables by Dewey labels.

Every node of a record gets the path of ordinals that leads to it
(``000000.000003.000001``).  Labels sort in document order, the parent of a node
is its label without the last step, and nodes that share a schema path (keys,
with list steps and identifier keys replaced) form one flat table.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NODE_SCHEMA = "record_id bigint, dewey string, path string, key string, ord int, kind string, value string"

_WIDTH = 6
_START = re.compile(r'\{\s*["}]|\[\s*(?:[\[{\]"]|-?\d|true\b|false\b|null\b)')
_CAMEL = re.compile(r"(?<=[a-z0-9])([A-Z])")
_IDENTIFIER = re.compile(r"^(?=.*\d)(?=.*[-:]).+$")
_DECODER = json.JSONDecoder()


def step(ordinal: int) -> str:
    """One step of a label; a letter leads numbers of more digits, so that labels of any fan-out sort as their numbers."""
    digits = f"{ordinal:0{_WIDTH}d}"
    return digits if len(digits) == _WIDTH else chr(ord("a") + len(digits) - _WIDTH - 1) + digits


def step_number(label: Column) -> Column:
    """The ordinal of the last step of a label."""
    return F.regexp_extract(label, r"([0-9]+)$", 1).cast("bigint")


def read_record(raw: str | None):
    """The first complete JSON value in ``raw`` that holds anything, else an empty one, or None.

    Text around it (fences, prefixes, byte-order marks, empty brackets) is
    skipped.  A value that is cut off is no record, nor is a complete value
    nested inside it.
    """
    found, at = None, 0
    while raw and (m := _START.search(raw, at)):
        try:
            value, at = _DECODER.raw_decode(raw, m.start())
        except (ValueError, RecursionError):
            return None if found is None else found
        if value:
            return value
        found = value if found is None else found
    return found


def schema_step(key: str, snake: dict[str, str]) -> str:
    """Key as a schema step: camel case unified, identifier-like keys as ``{}``."""
    if (s := snake.get(key)) is None:
        s = "{}" if _IDENTIFIER.match(key) else _CAMEL.sub(lambda m: "_" + m[1].lower(), key)
        if len(snake) < 100_000:
            snake[key] = s
    return s


def walk(record, snake: dict[str, str], keep: Callable[[str], bool] = lambda path: True) -> Iterator[tuple]:
    """(dewey, path, key, ordinal, kind, value) of the nodes whose path is kept, in document order.

    A string that itself holds a JSON object or array is opened as ``<json>``.
    The walk keeps its own stack, so depth is bounded by memory only.
    """
    stack = [("", "$", "", 0, record)]
    while stack:
        dewey, path, key, ordinal, node = stack.pop()
        inner, kind, value = None, "null", None
        if isinstance(node, dict):
            kind = "object"
            inner = [("{}" if isinstance(v, dict) and v.get("id") == k else schema_step(k, snake), k, v) for k, v in node.items()]
        elif isinstance(node, list):
            kind, inner = "array", [("[]", "", v) for v in node]
        elif isinstance(node, str):
            kind, value = "string", node
            if node.lstrip()[:1] in ("{", "[") and (opened := read_record(node)) is not None and isinstance(opened, (dict, list)):
                inner = [("<json>", "", opened)]
        elif isinstance(node, bool):
            kind, value = "boolean", "true" if node else "false"
        elif node is not None:
            kind, value = "number", json.dumps(node)
        if keep(path):
            yield dewey, path, key, ordinal, kind, value
        if inner:
            lead = f"{dewey}." if dewey else ""
            stack.extend([(lead + step(i), f"{path}.{name}", k, i, v) for i, (name, k, v) in enumerate(inner)][::-1])


class _Wanted(dict):
    """Whether a schema path is kept, worked out once per path."""

    def __init__(self, keep: str):
        super().__init__()
        self.keep = re.compile(keep)

    def __missing__(self, path: str) -> bool:
        if len(self) >= 100_000:
            self.clear()
        self[path] = hit = self.keep.search(path) is not None
        return hit


def once(records: DataFrame, record_id: str, raw: str) -> DataFrame:
    """``(record_id, raw)`` of records, those delivered again unchanged once, before they are shredded."""
    rows = records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(raw).cast("string").alias("raw"))
    return rows.where("raw is not null").groupBy("record_id", F.xxhash64("raw").alias("_h"), F.length("raw").alias("_n")).agg(F.first("raw").alias("raw")).select("record_id", "raw")


def dewey_nodes(records: DataFrame, record_id: str, raw: str, keep: str | None = None) -> DataFrame:
    """One row per node of the JSON in ``raw``, labelled with its Dewey path.

    ``keep`` is a regular expression over schema paths; other nodes are not
    emitted (projection pushed into the shredder).  Null, empty, cut or non-JSON
    values yield nothing; a null record id is kept as null.  Records delivered
    twice unchanged yield equal rows; callers apply ``once`` before or ``distinct`` after.
    """
    def shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        snake: dict[str, str] = {}
        wanted = _Wanted(keep).__getitem__ if keep else lambda path: True
        for batch in batches:
            rows: list[tuple] = []
            for rid, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                record = read_record(text)
                if record is not None:
                    rows.extend((rid, *n) for n in walk(record, snake, wanted))
                if len(rows) > 20_000:
                    yield _batch(rows)
                    rows = []
            if rows:
                yield _batch(rows)

    def _batch(rows: list[tuple]) -> pa.RecordBatch:
        types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.string(), pa.string()]
        names = ["record_id", "dewey", "path", "key", "ord", "kind", "value"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    return records.select(F.col(record_id).cast("bigint").alias("record_id"), F.col(raw).cast("string").alias("raw")).mapInArrow(shred, NODE_SCHEMA)


def ancestor(dewey: Column, up: Column | int) -> Column:
    """The label ``up`` steps above: truncation of the label."""
    up = F.lit(up) if isinstance(up, int) else up
    steps = F.split(dewey, r"\.")
    return F.array_join(F.slice(steps, F.lit(1), F.greatest(F.size(steps) - up, F.lit(0))), ".")
