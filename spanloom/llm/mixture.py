"""Mixing sources to target shares by hash-seeded Poisson replication."""

from __future__ import annotations

import base64
import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spanloom.operators.skew import salted_join
from spanloom.session import checkpointed, shuffle_partitions

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how the public byte-level vocabulary pre-splits a text.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Buckets of the hash per source in the calibration table.
BUCKETS = 2048
_HASH = "(xxhash64({seed}, {column}) & 9007199254740991) / 9007199254740992D"


@functools.lru_cache(maxsize=2)
def _encoding(path: str):
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("mixture", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


def count_tokens(rows: DataFrame, text: str, tokenizer: str = TOKENIZER) -> DataFrame:
    """``rows`` without ``text``, with ``n_tokens`` of the whole text (null: 0)."""
    kept = [c for c in rows.columns if c != text]
    schema = rows.select(*kept, F.lit(0).cast("bigint").alias("n_tokens")).schema

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoding(tokenizer).encode_ordinary
        for batch in batches:
            n = [len(encode(t)) if t else 0 for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(n, pa.int64())], names=[*kept, "n_tokens"])

    return rows.mapInArrow(scan, schema)


def source_key(c: str):
    """Source names compare without case and outer blanks."""
    return F.lower(F.regexp_replace(F.col(c).cast("string"), r"^[\s ]+|[\s ]+$", ""))


def thresholds(rate: float, cap: int) -> list[float]:
    """Poisson CDF at 0..cap-1: a document is used once for each value its hash reaches."""
    if math.isinf(rate):
        return [0.0] * cap
    total, out = 0.0, []
    for k in range(cap):
        total += math.exp(k * math.log(rate) - rate - math.lgamma(k + 1)) if rate > 0 else float(k == 0)
        out.append(min(total, 1.0))
    return out


def _expected(rate: float, cap: int, above) -> float:
    return sum(float(above(t)) for t in thresholds(rate, cap))


def solve_rate(target: float, cap: int, above) -> float:
    """The Poisson mean whose capped draws give ``target`` tokens.

    ``above(t)`` is the number of tokens of documents whose hash is at least
    ``t``; the draws are seeded, so the outcome is monotone in the mean.
    """
    if target <= 0:
        return 0.0
    if target >= cap * float(above(0.0)):
        return math.inf
    lo, hi = 0.0, 1.0
    while _expected(hi, cap, above) < target:
        lo, hi = hi, hi * 2
        if hi > 4 * cap + 1000:  # every hash but the smallest is at its cap
            return math.inf
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if _expected(mid, cap, above) < target else (lo, mid)
    return hi


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The steps of each source from its target tokens, cap and tokens per bucket."""
    for batch in batches:
        steps = []
        for want, cap, buckets in zip(*(batch.column(c).to_pylist() for c in ("want", "cap", "buckets"))):
            mass = np.zeros(BUCKETS)
            for x in buckets or ():
                mass[x["b"]] = x["n"]
            left = np.concatenate((mass[::-1].cumsum()[::-1], [0.0]))
            above = lambda t, left=left: np.interp(t * BUCKETS, np.arange(BUCKETS + 1), left)
            steps.append(thresholds(solve_rate(want, cap, above), cap) if want else [])
        kept = ("source", "target_share", "max_repeats", "reachable_share")
        yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(steps, pa.list_(pa.float64()))], names=[*kept, "steps"])


class Mixture:
    """Chosen repeats and actual shares, from one checkpointed token table, and the repeats with their texts."""

    def __init__(self, repeats: DataFrame, shares: DataFrame, texts: DataFrame):
        self.repeats, self.shares, self.texts = repeats, shares, texts


def mix_sources(
    documents: DataFrame, doc_id: str, source: str, text: str, targets: DataFrame,
    seed: int = 17, total_tokens: float | None = None, tokenizer: str = TOKENIZER,
) -> Mixture:
    """Replicate documents so that sources meet their shares of all text tokens.

    ``targets`` has (source, target_share, max_repeats); repeated rows count
    once, a source named twice keeps its largest share, rows with a null or
    negative share or a cap below 1 count as share 0.  Documents whose source is
    null or not targeted are not used; null or empty texts have no tokens.  A
    source without tokens can't meet its share: the others keep their
    proportions, and the report says so.  The total is ``total_tokens``, by
    default the largest that all sources can fill within their caps; where a
    given total is too large for a source, it stands at its cap.

    Method: the Poisson distribution with the mean repetition rate is inverted
    at a hash of the document id, cut at the cap.  The mean is calibrated on the
    tokens per hash bucket (at most ``BUCKETS`` rows a source), source by source
    in one distributed step, so the actual shares, not just the expected, meet
    the targets; within a bucket tokens are taken as even, so a source of a few
    documents can only come near.  Copies are exploded and ordered by a hash of
    (id, copy): a global shuffle.  Repeats follow from the id alone, so texts
    need no join with the chosen documents.
    """
    spark = documents.sparkSession
    wanted = targets.select(source_key("source").alias("source"), F.col("target_share").cast("double").alias("share"), F.col("max_repeats").cast("int").alias("cap"))
    wanted = wanted.where("source is not null").groupBy("source").agg(F.max("share").alias("share"), F.max_by("cap", "share").alias("cap"))
    valid = (F.col("cap") >= 1) & (F.col("share") > 0) & ~F.isnan("share")
    wanted = wanted.select("source", F.when(valid, F.col("share")).otherwise(0.0).alias("share"), F.coalesce(F.greatest("cap", F.lit(0)), F.lit(0)).alias("cap"))

    docs = documents.select(F.col(doc_id).cast("bigint").alias("d"), source_key(source).alias("source"), F.col(text).cast("string").alias("t")).where("d is not null")
    docs = docs.withColumn("u", F.expr(_HASH.format(seed=int(seed), column="d")))
    # a source may hold a third of all documents: joins with the targets are salted
    counted = checkpointed(count_tokens(salted_join(docs, wanted.select("source"), ["source"], "d"), "t", tokenizer))
    table = counted.groupBy("source", F.floor(F.col("u") * BUCKETS).cast("int").alias("b")).agg(F.sum("n_tokens").alias("n")).where("n > 0")
    mass = table.groupBy("source").agg(F.collect_list(F.struct("b", "n")).alias("buckets"), F.sum("n").cast("double").alias("size"))
    sized = wanted.join(mass, "source", "left").withColumn("live", (F.col("share") > 0) & F.col("size").isNotNull())
    # two numbers: the shares that can be met, and the largest total that every source can fill
    whole, fits = sized.where("live").agg(F.sum("share"), F.min(F.col("cap") * F.col("size") / F.col("share"))).first()
    total = (fits or 0.0) * (whole or 0.0) if total_tokens is None else float(total_tokens)
    reachable = F.when(F.col("live"), F.col("share") / F.lit(whole or 1.0)).otherwise(0.0)
    ready = sized.select("source", F.col("share").alias("target_share"), F.col("cap").alias("max_repeats"), reachable.alias("reachable_share"), (reachable * total).alias("want"), "cap", "buckets")
    chosen = checkpointed(ready.mapInArrow(_solve, "source string, target_share double, max_repeats int, reachable_share double, steps array<double>"))

    repeats = F.expr("size(filter(steps, x -> u >= x))")
    drawn = salted_join(counted, chosen.select("source", "steps"), ["source"], "d").withColumn("repeats", repeats).drop("steps")
    by_source = drawn.groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum((F.col("repeats") > 0).cast("int")).alias("used_docs"), F.sum("repeats").alias("n_copies"),
        F.max("repeats").alias("most_repeats"), F.sum("n_tokens").alias("source_tokens"), F.sum(F.col("n_tokens") * F.col("repeats")).alias("mixed_tokens"),
    )
    filled = chosen.drop("steps").join(by_source, "source", "left").fillna(0, ["n_docs", "used_docs", "n_copies", "most_repeats", "source_tokens", "mixed_tokens"])
    every = filled.agg(F.sum("mixed_tokens").alias("all_tokens"))  # one row
    shares = filled.crossJoin(F.broadcast(every))
    shares = shares.withColumn("actual_share", F.when(F.col("all_tokens") > 0, F.col("mixed_tokens") / F.col("all_tokens")).otherwise(0.0))
    shares = shares.withColumn("unreachable", (F.col("target_share") > 0) & (F.col("source_tokens") == 0)).drop("all_tokens")
    used = drawn.where("repeats > 0").select(F.col("d").alias("doc_id"), "source", "n_tokens", "repeats")
    texts = salted_join(docs, chosen.select("source", "steps"), ["source"], "d").withColumn("repeats", repeats).where("repeats > 0").select(F.col("d").alias("doc_id"), "source", "repeats", F.col("t").alias("text"))
    return Mixture(used, shares, texts)


def shuffled_copies(repeats: DataFrame, seed: int = 17, partitions: int | None = None) -> DataFrame:
    """One row per chosen copy, in a globally shuffled order.

    ``position`` is a hash of (seed, id, copy); the rows are partitioned by
    ranges of it and sorted, so every output file is a random sample of the
    mixture.  A hash is even, so its ranges need no sampling of the rows.
    """
    n = partitions or shuffle_partitions(repeats.sparkSession)
    copies = repeats.withColumn("copy_no", F.explode(F.expr("sequence(1, repeats)"))).withColumn("position", F.expr(f"xxhash64({int(seed) + 1}, doc_id, copy_no)")).drop("repeats")
    part = F.least(F.lit(n - 1), F.floor((F.col("position") / 2.0**64 + 0.5) * n).cast("int"))
    return copies.repartitionById(n, part).sortWithinPartitions("position", "doc_id")
