"""Document fingerprints by Order MinHash.

Each of ``m`` hash functions selects the ``l`` smallest of a text's occurrence-numbered k-mers (code points); the selected ones are
put back into text order and the tuple is hashed. Two texts share a tuple only if they share those k-mers in that order, so the
share of equal tuples follows the edit distance rather than the set overlap.

The query also fingerprints each text after an edit that needs the next document in descending id order. Ranges of ids are dealt to
tasks by split points from an approximate quantile (bounded, on the driver), and the first row of each range is also sent to the
range before it, so that neighbours meet without a global sort in one task and texts are shuffled once.

Defined results: null text counts as empty; an empty text has the fingerprint of no tuples (all zeros), alike to other empty texts
only; a text under k code points is one k-mer. Null ids come last in the order, ties are ordered by text. One document is its own
next. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import mix, text_col

K, L, M = 6, 2, 32


def _odd(m: int) -> np.ndarray:
    return mix(np.arange(1, m + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407)) | np.uint64(1)


def numbered_kmers(text: str, k: int = K) -> np.ndarray:
    """Hash of each k-mer together with its occurrence number among equal ones: those with the same 44 leading hash bits, in texts of any
    length."""
    cp = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(cp):
        return np.zeros(0, np.uint64)
    k = min(k, len(cp))
    n = len(cp) - k + 1
    h = cp[:n].astype(np.uint64)
    for j in range(1, k):
        h *= np.uint64(0x9E3779B97F4A7C15)
        h += cp[j : n + j]
    h = mix(h + np.uint64(k))
    if n < 1 << 20:  # the position in the low bits makes the sort stable
        key = np.sort((h & np.uint64(0xFFFFFFFFFFF00000)) | np.arange(n, dtype=np.uint64))
        order, run = (key & np.uint64(0xFFFFF)).astype(np.int64), key >> np.uint64(20)
    else:  # the same order where the position needs more bits
        order = np.argsort(h >> np.uint64(20), kind="stable")
        run = h[order] >> np.uint64(20)
    same = np.flatnonzero(run[1:] == run[:-1]) + 1
    if len(same):
        number = np.zeros(n, np.uint64)
        at = np.arange(n)
        at[same] = 0
        number[order] = (np.arange(n) - np.maximum.accumulate(at)).astype(np.uint64)
        h = np.where(number > 0, mix(h + number * np.uint64(0xC2B2AE3D27D4EB4F)), h)
    return h


def fingerprint(text: str, k: int = K, m: int = M) -> np.ndarray:
    """m tuple hashes of 32 bits; zeros for an empty text."""
    e = numbered_kmers(text, k)
    if not len(e):
        return np.zeros(m, np.uint32)
    odd, rows = _odd(m), np.arange(m)
    step = max(1, 65536 // m)
    best = np.zeros((m, 0), np.uint64)
    where = np.zeros((m, 0), np.int64)
    for a in range(0, len(e), step):  # two smallest of each block, then of all blocks' candidates
        v = e[a : a + step] * odd[:, None]
        one = v.argmin(1)
        first = v[rows, one]
        if v.shape[1] > 1:
            v[rows, one] = np.uint64(0xFFFFFFFFFFFFFFFF)
            two = v.argmin(1)
            best = np.column_stack([best, first, v[rows, two]])
            where = np.column_stack([where, one + a, two + a])
        else:
            best, where = np.column_stack([best, first]), np.column_stack([where, one + a])
    pick = np.argsort(best, axis=1, kind="stable")[:, :L]
    at = np.sort(where[rows[:, None], pick], axis=1)
    h = np.full(m, L, np.uint64)
    for j in range(at.shape[1]):
        h = mix(h * np.uint64(0x9E3779B97F4A7C15) + e[at[:, j]])
    return (h >> np.uint64(32)).astype(np.uint32) | np.uint32(1)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def as_text(f: np.ndarray) -> str:
    return f.astype(">u4").tobytes().hex()


def edited(text: str, following: str) -> str:
    n = len(text) // 2
    return text[: len(text) - n] + following[:n]


_OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _pairs(it: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """Rows with their successor in the bucket; rows sent along from the next bucket only follow."""
    held = None
    for batch in it:
        texts = text_col(batch, "text")
        for bucket, tail, doc_id, text in zip(batch.column("bucket").to_pylist(), batch.column("tail").to_pylist(), batch.column("doc_id").to_pylist(), texts):
            if held is not None and held[0] == bucket:
                new = text.as_py()
                yield held[1], held[2], new
            elif tail:
                continue
            else:
                new = text.as_py()
            held = None if tail else (bucket, doc_id, new)


def _prints(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, known = [], (None, None)

    def batch() -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], [x.split()[0] for x in _OUT.split(", ")])

    for doc_id, text, following in _pairs(it):
        own = known[1] if known[0] == text else fingerprint(text)
        nxt = fingerprint(following)
        new = edited(text, following)
        f = fingerprint(new)
        rows.append((doc_id, len(text), hashlib.sha256(new.encode()).hexdigest(), as_text(own), as_text(f), likeness(own, f), likeness(own, nxt)))
        known = (following, nxt)
        if len(rows) == 1024:
            yield batch()
            rows.clear()
    if rows:
        yield batch()


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next; one row per document."""
    spark = docs.sparkSession
    rows = docs.select(F.col("doc_id").cast("long"), "text")
    parts = 12 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = np.array(sorted(set(rows.select("doc_id").stat.approxQuantile("doc_id", [i / parts for i in range(1, parts)], 0.25 / parts))), np.float64)

    @F.pandas_udf("long")
    def bucket(ids: pd.Series) -> pd.Series:
        x = ids.to_numpy(np.float64, na_value=-np.inf)
        return pd.Series(len(cuts) - np.searchsorted(cuts, x, side="right") + ids.isna().to_numpy())

    put = rows.withColumn("bucket", bucket("doc_id"))
    firsts = sorted((r["bucket"], r["id"]) for r in put.select("bucket", "doc_id").groupBy("bucket").agg(F.max("doc_id").alias("id")).collect())  # one row per range
    heads = [(i, firsts[k - 1][0]) for k, (_, i) in enumerate(firsts)]
    small = spark.createDataFrame(heads, "first_id long, before long")
    both = put.join(F.broadcast(small), F.col("doc_id").eqNullSafe(F.col("first_id")), "left").drop("first_id")
    own = F.array(F.struct(F.col("bucket").alias("b"), F.lit(0).alias("t")))
    two = F.when(F.col("before").isNull(), own).otherwise(F.concat(own, F.array(F.struct(F.col("before").alias("b"), F.lit(1).alias("t")))))
    sent = both.withColumn("to", F.explode(two)).select(F.col("to.b").alias("bucket"), F.col("to.t").alias("tail"), "doc_id", "text")
    dealt = sent.repartition("bucket").sortWithinPartitions("bucket", "tail", F.desc_nulls_last("doc_id"), "text")
    return dealt.mapInArrow(_prints, _OUT)
