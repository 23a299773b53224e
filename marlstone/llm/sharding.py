"""Uniform shuffle into shards of exact size, by a hypergeometric communication matrix.

The rows of each input partition are counted; from those counts alone it is drawn how many rows each partition sends to
each shard: a matrix with the exact row and column sums, distributed as a uniform permutation of all rows would make it
(multivariate hypergeometric, one partition after the other; by groups of partitions first, then within each group). Each partition permutes its rows and deals them out by its line of
the matrix; after the exchange each shard permutes what it got. The second permutation is made in sub-ranges of the permuting
hash, whose offsets are sums of counts, so that a shard needn't fit a task.

Only counts come to the driver: one number per group of partitions. Law ``rows``: counts differ by one at most. Whole groups of equal
texts are not kept together (a group of a third of all rows couldn't be, under this law); rows are placed one by one.

Defined results: a null text has 0 bytes and the crc32 of the empty string; null ids and repeated rows are rows like any other and
get slots of their own; fewer rows than shards leave shards empty; an empty table gives an empty result. Extra columns are ignored
by ``assign`` and carried by ``shard_rows``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ._shared import free_name, stash


def shard_sizes(total: int, shards: int) -> np.ndarray:
    """Rows of each shard: at most one apart."""
    return np.array([total // shards + (k < total % shards) for k in range(shards)], np.int64)


def communication_matrix(counts: list[int], sizes: np.ndarray, seed: int) -> np.ndarray:
    """Line p, column s: rows that partition p sends to shard s. Sums are ``counts`` and ``sizes``."""
    rng, left = np.random.default_rng(seed), sizes.astype(np.int64).copy()
    out = np.zeros((len(counts), len(sizes)), np.int64)
    for p, n in enumerate(counts):
        rest = int(left.sum())
        for s in range(len(left) - 1):  # conditional univariate draws: exact, and without numpy's limit of 1e9 on the joint draw
            if not n:
                break
            rest -= int(left[s])
            out[p, s] = _draw(rng, int(left[s]), rest, n)
            n -= int(out[p, s])
        out[p, -1] += n
        left -= out[p]
    return out


def _draw(rng: np.random.Generator, good: int, bad: int, n: int) -> int:
    """Hypergeometric; beyond numpy's limit of 1e9 by inversion of the probabilities within 15 deviations of the mean."""
    if good + bad < 10**9:
        return int(rng.hypergeometric(good, bad, n)) if good and n else 0
    total = good + bad
    mean = n * good / total
    sd = (mean * (bad / total) * ((total - n) / (total - 1))) ** 0.5
    low, high = max(0, n - bad, int(mean - 15 * sd - 15)), min(good, n, int(mean + 15 * sd + 15))
    k = np.arange(low, high, dtype=np.float64)
    logs = np.concatenate([[0.0], np.cumsum(np.log((good - k) * (n - k) / ((k + 1) * (bad - n + k + 1))))])
    p = np.cumsum(np.exp(logs - logs.max()))
    return low + int(np.searchsorted(p, rng.random() * p[-1], side="right"))


def assign(docs: DataFrame, shards: int, seed: int = 7, rows_a_range: int = 500_000) -> DataFrame:
    """doc_id, size, text_crc32, shard, slot. ``rows_a_range``: rows of a sub-range of a shard's second permutation, about."""
    body = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col("doc_id").cast("long"), (F.octet_length(body) + 16).cast("long").alias("size"), F.crc32(body).alias("text_crc32"),
        F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_r"),
    )
    rows = stash(rows, "op5-rows")  # from here on partition and row numbers are facts, whatever is recomputed
    return place(rows, shards, seed, rows_a_range)


def _lines(seed: int, totals: dict[int, np.ndarray]):
    """Lines of the matrix (ends of each shard's part) for the partitions of a group, drawn from the group's line."""

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted(x for b in it for x in zip(*(b.column(c).to_pylist() for c in ("_g", "_p", "count"))))
        for g in sorted({r[0] for r in rows}):
            mine = [r for r in rows if r[0] == g]
            matrix = communication_matrix([r[2] for r in mine], totals[g], seed + 1_000 + g)
            yield pa.RecordBatch.from_arrays([pa.array([r[1] for r in mine], pa.int32()), pa.array(np.cumsum(matrix, axis=1).tolist(), pa.list_(pa.int64()))], ["_p", "_ends"])

    return run


def place(rows: DataFrame, shards: int, seed: int, rows_a_range: int, groups: int = 256) -> DataFrame:
    """Adds shard and slot to rows that have _p (partition) and _r (row number, unique).

    The matrix is drawn in two steps, which gives the same distribution: on the driver one line for each of at most ``groups`` groups
    of partitions, then in a task for each group the lines of its partitions. Lines and offsets are joined by the keys that the two
    permutations are dealt by anyway.
    """
    counts = rows.groupBy("_p").count().withColumn("_g", F.pmod("_p", F.lit(groups)))
    sums = sorted((r["_g"], r["n"]) for r in counts.groupBy("_g").agg(F.sum("count").alias("n")).collect())
    total = sum(n for _, n in sums)
    matrix = communication_matrix([n for _, n in sums], shard_sizes(total, shards), seed)
    lines = counts.repartition(min(groups, max(1, len(sums))), "_g").mapInArrow(_lines(seed, {g: m for (g, _), m in zip(sums, matrix)}), "_p int, _ends array<long>")
    first = Window.partitionBy("_p").orderBy(F.xxhash64(F.lit(seed), "_r"), "_r")
    dealt = rows.withColumn("_k", F.row_number().over(first)).join(lines, "_p")
    dealt = dealt.withColumn("shard", F.size(F.filter("_ends", lambda e: e < F.col("_k"))).cast("int")).drop("_ends", "_k")
    ranges = max(1, -(-total // (shards * rows_a_range)))  # ranges of the hash, so that their number doesn't change the order
    dealt = dealt.withColumn("_h", F.xxhash64(F.lit(seed + 1), "_r").bitwiseAND(F.lit((1 << 63) - 1)))
    dealt = dealt.withColumn("_q", F.shiftright(F.shiftright("_h", 39) * F.lit(ranges).cast("long"), 24))
    sums = dealt.groupBy("shard", "_q").agg(F.count("*").alias("_n"))  # shards * ranges rows
    before = Window.partitionBy("shard").orderBy("_q").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("_from", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    second = Window.partitionBy("shard", "_q").orderBy("_h", "_r")
    out = dealt.join(sums, ["shard", "_q"]).withColumn("slot", F.col("_from") + F.row_number().over(second) - 1)
    return out.drop("_p", "_r", "_h", "_q", "_from")


def shard_rows(docs: DataFrame, shards: int, seed: int = 7, rows_a_range: int = 500_000) -> DataFrame:
    """All rows of ``docs``, whole, with _shard and _slot (underscores are added where ``docs`` has such columns); write with
    partitionBy("_shard") for shard files."""
    tagged = docs.select(F.struct(*docs.columns).alias("_row"), F.spark_partition_id().alias("_p"), F.monotonically_increasing_id().alias("_r"))
    out = place(stash(tagged, "shard-rows"), shards, seed, rows_a_range)
    return out.select("_row.*", F.col("shard").alias(free_name(docs.columns, "_shard")), F.col("slot").alias(free_name(docs.columns, "_slot")))
