"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 4 code points of the lower-cased text, weighted by log(1 + tf) * idf and scaled to length 1. The
model is trained by follow-the-regularised-leader (per-coordinate steps, L1 and L2 penalties, so most weights are exactly 0) on a
bounded sample of labelled rows, then its logits are divided by a temperature fitted on rows of the sample that training didn't see.

Document frequencies (idf) are counted over the whole texts of all labelled rows outside the held-out fold. The sample that the weights
are fitted on: at most ``sample`` such rows of at most ``sample_chars`` characters, those with the smallest hash of the id. Only fitting
uses the sample; every whole text is scored.

Defined results: a null text, or one without a letter (Unicode category L), is ``und`` with score 0; without any labelled row all are ``und``; null ids and
repeated rows are scored like any other (null ids are not held out and not learnt from). Extra columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc32_mod, only, slices

BITS = 15
_BLOCK = 1 << 18
ORDERS = 4
LETTER = regex.compile(r"\p{L}")
_OUT = "doc_id long, held_out boolean, lang_pred string, score double"


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a whole text: ids and log(1 + tf)."""
    cp = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    total = None
    for a in range(0, max(1, len(cp)), _BLOCK):  # n-grams that begin in the block
        part = np.bincount(_grams(cp[a : a + _BLOCK + ORDERS - 1], min(_BLOCK, len(cp) - a)), minlength=1 << BITS)
        total = part if total is None else total + part
    ids = np.flatnonzero(total)
    return ids, np.log1p(total[ids])


def _grams(cp: np.ndarray, begin: int) -> np.ndarray:
    """Buckets of the n-grams that begin at the first ``begin`` code points."""
    out, h = [np.zeros(0, np.int64)], np.zeros(len(cp), np.uint32)
    for n in range(min(ORDERS, len(cp))):
        h = (h[: len(cp) - n] + cp[n:] + np.uint32(1)) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        out.append(((h[:begin] * np.uint32(0x85EBCA77)) >> np.uint32(32 - BITS)).astype(np.int64))
    return np.concatenate(out)


@dataclass
class Model:
    """Classes, idf and weights (features x classes, most of them 0), with the temperature."""

    classes: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def logits(self, ids: np.ndarray, tf: np.ndarray) -> np.ndarray:
        x = tf * self.idf[ids]
        return x @ self.weights[ids] / max(float(np.sqrt(x @ x)), 1e-12) + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.classes or text is None or not LETTER.search(text):
            return "und", 0.0
        p = softmax(self.logits(*counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.classes[best], float(min(1.0, p[best]))


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max())
    return e / e.sum()


def fit(texts: list[str], langs: list[str], df: np.ndarray | None = None, n_docs: int = 0, epochs: int = 2, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02, l2: float = 0.01) -> Model:
    """FTRL-proximal with elastic net, one step per text; one in five texts is kept for the temperature. ``df``: in how many of ``n_docs``
    documents each feature occurs (that of the given texts if left out)."""
    classes = sorted(set(langs))
    if not classes:
        return Model([], np.zeros(0), np.zeros((0, 0)), np.zeros(0), 1.0)
    feats = [counts(t) for t in texts]
    if df is None:
        df, n_docs = np.bincount(np.concatenate([ids for ids, _ in feats]), minlength=1 << BITS), len(feats)
    idf = np.log((1 + n_docs) / (1 + df)) + 1
    c, y = len(classes), np.array([classes.index(x) for x in langs])
    z, n = np.zeros((1 << BITS, c)), np.zeros((1 << BITS, c))
    zb, nb = np.zeros(c), np.zeros(c)

    def weight(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    kept = [k for k in range(len(feats)) if len(feats) >= 20 and k % 5 == 4]
    learn = np.array(sorted(set(range(len(feats))) - set(kept)))
    rng = np.random.default_rng(11)
    for _ in range(epochs):
        for k in rng.permutation(learn):
            ids, tf = feats[k]
            x = tf * idf[ids]
            x = x / max(float(np.sqrt(x @ x)), 1e-12)
            w, b = weight(z[ids], n[ids]), -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            e = softmax(x @ w + b)
            e[y[k]] -= 1
            g = x[:, None] * e
            step = (np.sqrt(n[ids] + g * g) - np.sqrt(n[ids])) / alpha
            z[ids] += g - step * w
            n[ids] += g * g
            zb += e - (np.sqrt(nb + e * e) - np.sqrt(nb)) / alpha * b
            nb += e * e
    model = Model(classes, idf, weight(z, n), -zb / ((beta + np.sqrt(nb)) / alpha + l2), 1.0)
    if kept:
        logits, truth = np.array([model.logits(*feats[k]) for k in kept]), y[kept]
        grid = np.exp(np.linspace(np.log(0.05), np.log(5), 60))

        def loss(t: float) -> float:
            s = logits / t
            s = s - s.max(1, keepdims=True)
            return float((np.log(np.exp(s).sum(1)) - s[np.arange(len(s)), truth]).mean())

        model.temperature = float(min(grid, key=loss))
    return model


def train(docs: DataFrame, sample: int = 2000, sample_chars: int = 20_000, folds: int = 5) -> Model:
    """Fits on a bounded sample of labelled rows outside the held-out fold."""
    ok = F.col("lang").isNotNull() & F.col("text").isNotNull() & (crc32_mod("doc_id", folds) != 0)
    rows = docs.select("doc_id", "text", "lang").where(ok)
    df, n_docs = document_frequencies(rows)
    share = min(1.0, 1.5 * sample / max(n_docs, 1))  # of all; if too few of these are short enough, fewer are learnt from
    pick = rows.where(F.length("text") <= sample_chars).withColumn("_h", F.xxhash64("doc_id")).where(F.pmod("_h", F.lit(1_000_000)) < int(share * 1_000_000) + 1)
    got = pick.orderBy("_h", "text").limit(sample).select("_h", "text", "lang")
    made = got.repartition(1).mapInArrow(_fits(df, n_docs), "model binary").collect()  # one task of bounded size; the driver gets the model alone
    return pickle.loads(made[0]["model"]) if made else fit([], [])


def _fits(df: np.ndarray, n_docs: int):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = sorted((h, t, y) for b in it for h, t, y in zip(*(c.to_pylist() for c in b.columns)))
        yield pa.RecordBatch.from_pydict({"model": [pickle.dumps(fit([r[1] for r in rows], [r[2] for r in rows], df, n_docs))]})

    return run


def document_frequencies(rows: DataFrame, groups: int = 32) -> tuple[np.ndarray, int]:
    """In how many of the rows' texts each feature occurs, and the number of rows. Each task adds up one array of fixed size, the arrays
    are added in ``groups`` tasks, and theirs in one: the driver gets a single array."""
    parts = rows.select("text").mapInArrow(_frequencies, "part int, n long, df binary")
    for k in (groups, 1):
        parts = parts.repartition(k, F.pmod("part", F.lit(k))).mapInArrow(_sums, "part int, n long, df binary")
    got = parts.collect()
    return (np.frombuffer(got[0]["df"], np.int64), got[0]["n"]) if got else (np.zeros(1 << BITS, np.int64), 0)


def _frequencies(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    only("language")
    df, n = np.zeros(1 << BITS, np.int64), 0
    for part in slices(it, "text"):
        for t in part.column("text"):
            df[counts(t.as_py())[0]] += 1
            n += 1
    if n:
        yield pa.RecordBatch.from_pydict({"part": pa.array([TaskContext.get().partitionId()], pa.int32()), "n": [n], "df": pa.array([df.tobytes()], pa.binary())})


def _sums(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    df, n, part = np.zeros(1 << BITS, np.int64), 0, None
    for batch in it:
        for p, m, x in zip(*(c.to_pylist() for c in batch.columns)):
            df, n, part = df + np.frombuffer(x, np.int64), n + m, p if part is None else min(p, part)
    if n:
        yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "n": [n], "df": pa.array([df.tobytes()], pa.binary())})


def _predicts(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language")
        model = shared.value
        for part in slices(it, "text"):
            got = [model.predict(t.as_py()) for t in part.column("text")]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array([g[0] for g in got]), pa.array([g[1] for g in got])], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, folds: int = 5) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row. The model is broadcast: 2^15 features x classes; the classes are those of the
    sample, so at most ``sample`` many."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    held = F.coalesce(crc32_mod("doc_id", folds) == 0, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(_predicts(shared), _OUT)


def keep_known(docs: DataFrame, model: Model, floor: float = 0.0) -> DataFrame:
    """The rows of ``docs`` whose text has a language of the model, whole; ``und`` and scores under ``floor`` go."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("language")
        for part in slices(it, "text"):
            got = [shared.value.predict(t.as_py()) for t in part.column("text")]
            yield part.filter(pa.array([g[0] != "und" and g[1] >= floor for g in got]))

    return docs.mapInArrow(run, docs.schema)
