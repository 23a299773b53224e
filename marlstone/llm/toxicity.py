"""Toxicity: a bidirectional gated recurrent network with attention pooling, over character and word inputs, in numpy.

A word's input is the embedding of its hash bucket plus the mean embedding of its hashed byte 3- and 4-grams (with word ends), so
that inflected forms share what they learn. Windows of ``WINDOW`` words overlap by half and cover the whole text; a GRU reads each
window in both directions, attention pools its states, and a document's score is that of its most toxic window. Training sees
document labels only: the log-sum-exp over a document's windows makes the label fall on the windows that earn it. Back-propagation
is written out; the optimiser is Adam.

The sample: at most ``toxic_sample`` toxic and ``clean_sample`` clean labelled rows of at most ``sample_chars`` characters, those with
the smallest hash of the id; rows of the held-out fold never. Small samples are read more often: 10 000 texts over the sample's size
is the number of epochs, at least two and at most ``most_epochs``. Only fitting uses the sample; every window of every text is scored.
A word of over LONGEST bytes (script without blanks, endless strings) counts as overlapping pieces of that length, so that a window
spans a bounded stretch of any text.

Defined results: null, empty and blank texts have no window and get the score of a window without words (the bias alone,
at most 0.27); labels that are null are left out; a row whose id is in
``labels`` more than once takes the largest label. Without labels of both kinds every score is 0. Null ids are not held out.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._shared import crc32_mod, mix, only, slices, text_col, utf8, words

WINDOW, STRIDE = 32, 16
LONGEST = 48  # bytes of a word
WORD_BITS, CHAR_BITS, DIM, HID = 14, 15, 12, 8
THRESHOLD = 0.3
_OUT = "doc_id long, held_out boolean, score double, predicted int"


#: Bytes between words: ASCII other than letters and digits.
APART = np.array([b < 128 and not chr(b).isalnum() for b in range(256)])


def distinct_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Word number (among the batch's distinct words) of each word, word offsets of the texts, then for each distinct word its bucket
    and, end to end with offsets, the buckets of its character n-grams."""
    buf, off = utf8(texts)
    starts, ends, h, at = _pieces(buf, *words(buf, off, APART))
    hs, first, inv = np.unique(h, return_index=True, return_inverse=True)
    s, n = starts[first], (ends - starts)[first]
    low = buf.copy()
    upper = (low >= 65) & (low <= 90)
    low[upper] += 32
    goff = np.concatenate([[0], np.cumsum(2 * n + 1)])  # n 3-grams and n + 1 4-grams of ^^word$, all over ^word$
    grams = np.zeros(goff[-1], np.int64)
    padded = np.zeros(int((n + 4).sum()), np.uint64)  # \1 \1 word \2 \2
    poff = np.concatenate([[0], np.cumsum(n + 4)])
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    padded[np.repeat(poff[:-1] + 2, n) + inner] = low[np.repeat(s, n) + inner]
    padded[poff[:-1]] = padded[poff[:-1] + 1] = 1
    padded[poff[1:] - 1] = padded[poff[1:] - 2] = 2
    if len(padded) >= 4:
        p3 = (padded[:-2] << np.uint64(16)) | (padded[1:-1] << np.uint64(8)) | padded[2:]
        p4 = (p3[:-1] << np.uint64(8)) | padded[3:]
        b3 = (mix(p3) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        b4 = (mix(p4 + np.uint64(1 << 40)) >> np.uint64(64 - CHAR_BITS)).astype(np.int64)
        i3 = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
        grams[np.repeat(goff[:-1], n) + i3] = b3[np.repeat(poff[:-1] + 1, n) + i3]
        m = n + 1
        i4 = np.arange(int(m.sum())) - np.repeat(np.cumsum(m) - m, m)
        grams[np.repeat(goff[:-1] + n, m) + i4] = b4[np.repeat(poff[:-1], m) + i4]
    return inv.astype(np.int64), at, (hs >> np.uint64(64 - WORD_BITS)).astype(np.int64), grams, goff


def _pieces(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, h: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words as they are, those of over LONGEST bytes as pieces of that length that overlap by half."""
    n = ends - starts
    if n.max(initial=0) <= LONGEST:
        return starts, ends, h, at
    step = LONGEST // 2
    k = np.where(n > LONGEST, 1 + -(-(n - LONGEST) // step), 1)
    word = np.repeat(np.arange(len(n)), k)
    s = starts[word] + (np.arange(len(word)) - np.repeat(np.cumsum(k) - k, k)) * step
    e, own = np.minimum(s + LONGEST, ends[word]), h[word]
    cut = np.flatnonzero(n[word] > LONGEST)
    x = np.zeros(len(cut), np.uint64)
    for b in range(LONGEST):
        live = s[cut] + b < e[cut]
        x[live] = x[live] * np.uint64(0x9E3779B97F4A7C13) + buf[s[cut[live]] + b] + np.uint64(1)
    own[cut] = mix(x)
    return s, e, own, np.concatenate([[0], np.cumsum(k)])[at]


def windows(at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First word, words and text of each window; windows overlap by half, the last one ends with the text. No words: no window."""
    n = np.diff(at)
    k = np.where(n > 0, 1 + np.maximum(0, -(-(n - WINDOW) // STRIDE)), 0)
    doc = np.repeat(np.arange(len(n)), k)
    number = np.arange(int(k.sum())) - np.repeat(np.cumsum(k) - k, k)
    begin = at[doc] + number * STRIDE
    return begin, np.minimum(WINDOW, at[doc + 1] - begin), doc


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


@dataclass
class Net:
    """p: word and char embeddings, and for each direction input (DIM x 3H), recurrent (H x 3H) and bias (3H); attention; output."""

    p: dict[str, np.ndarray]

    @classmethod
    def new(cls, seed: int = 5) -> Net:
        rng = np.random.default_rng(seed)
        mat = lambda a, b, s: (rng.standard_normal((a, b)) * s).astype(np.float32)
        p = {"word": mat(1 << WORD_BITS, DIM, 0.01), "char": mat(1 << CHAR_BITS, DIM, 0.03)}
        for d in "fb":
            p |= {"W" + d: mat(DIM, 3 * HID, DIM**-0.5), "U" + d: mat(HID, 3 * HID, HID**-0.5), "c" + d: np.zeros(3 * HID, np.float32)}
        return cls(p | {"a": mat(2 * HID, 1, 0.5)[:, 0], "o": mat(2 * HID, 1, 0.5)[:, 0], "b": np.full(1, -2, np.float32)})

    def inputs(self, bucket: np.ndarray, grams: np.ndarray, goff: np.ndarray) -> np.ndarray:
        if not len(bucket):
            return np.zeros((0, DIM), np.float32)
        out = np.empty((len(bucket), DIM), np.float32)
        for a in range(0, len(bucket), 20000):
            g = goff[a : a + 20001] if a + 20001 <= len(goff) else goff[a:]
            out[a : a + len(g) - 1] = np.add.reduceat(self.p["char"][grams[g[0] : g[-1]]], g[:-1] - g[0], axis=0) / np.diff(g)[:, None]
        return out + self.p["word"][bucket]

    def _gru(self, d: str, gates: np.ndarray, ids: np.ndarray, keep: bool) -> tuple[np.ndarray, list]:
        """States (steps x windows x H). gates: rows of input projections, the last for padding; ids: steps x windows."""
        U = self.p["U" + d]
        h = np.zeros((ids.shape[1], HID), np.float32)
        out, tape = np.empty((*ids.shape, HID), np.float32), []
        for t in range(ids.shape[0]) if d == "f" else range(ids.shape[0] - 1, -1, -1):
            x, u = gates[ids[t]], h @ U
            zr = sigmoid(x[:, : 2 * HID] + u[:, : 2 * HID])
            z, r = zr[:, :HID], zr[:, HID:]
            c = np.tanh(x[:, 2 * HID :] + r * u[:, 2 * HID :])
            new = h + z * (c - h)
            pad = ids[t] == len(gates) - 1
            if pad.any():
                new[pad] = h[pad]
            if keep:
                tape.append((t, h, z, r, c, u[:, 2 * HID :], pad))
            out[t] = h = new
        return out, tape

    def forward(self, x: np.ndarray, ids: np.ndarray, keep: bool = False):
        """Logit of each window. x: inputs of distinct words; ids: steps x windows, len(x) for padding."""
        pad = ids == len(x)
        hs, tapes = [], []
        for d in "fb":
            gates = np.zeros((len(x) + 1, 3 * HID), np.float32)
            gates[:-1] = x @ self.p["W" + d] + self.p["c" + d]
            h, tape = self._gru(d, gates, ids, keep)
            hs.append(h)
            tapes.append(tape)
        H = np.concatenate(hs, axis=2)
        s = np.where(pad, np.float32(-1e9), H @ self.p["a"])
        e = np.exp(s - s.max(0))
        w = e / e.sum(0)
        v = H @ self.p["o"]
        logit = (w * v).sum(0) + self.p["b"][0]
        return logit, (H, w, v, tapes, pad) if keep else None

    def backward(self, x: np.ndarray, ids: np.ndarray, tape: tuple, dlogit: np.ndarray) -> dict[str, np.ndarray]:
        H, w, v, tapes, pad = tape
        g = {"b": np.array([dlogit.sum()], np.float32)}
        dv = w * dlogit
        ds = w * (v - (w * v).sum(0)) * dlogit
        g["o"], g["a"] = np.einsum("tn,tnh->h", dv, H), np.einsum("tn,tnh->h", ds, H)
        dH = dv[:, :, None] * self.p["o"] + ds[:, :, None] * self.p["a"]
        dx = np.zeros_like(x)
        for k, d in enumerate("fb"):
            U = self.p["U" + d]
            dU, dgates = np.zeros_like(U), np.zeros((len(x) + 1, 3 * HID), np.float32)
            dh = np.zeros((ids.shape[1], HID), np.float32)
            for t, h, z, r, c, uc, skip in reversed(tapes[k]):
                dh = dh + dH[t, :, k * HID : (k + 1) * HID]
                live = (~skip)[:, None]
                dc = dh * z * (1 - c * c) * live
                dz = dh * (c - h) * z * (1 - z) * live
                dr = dc * uc * r * (1 - r)
                pre = np.concatenate([dz, dr, dc], axis=1)
                _scatter(dgates, ids[t], pre)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dU += h.T @ du
                dh = np.where(live, dh * (1 - z), dh) + du @ U.T
            g["U" + d], g["W" + d], g["c" + d] = dU, x.T @ dgates[:-1], dgates[:-1].sum(0)
            dx += dgates[:-1] @ self.p["W" + d].T
        g["x"] = dx
        return g


def _scatter(into: np.ndarray, ids: np.ndarray, rows: np.ndarray) -> None:
    order = np.argsort(ids, kind="stable")
    s = ids[order]
    first = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
    into[s[first]] += np.add.reduceat(rows[order], first, axis=0)


def window_ids(inv: np.ndarray, begin: np.ndarray, n: np.ndarray, pad: int) -> np.ndarray:
    """steps x windows; windows shorter than WINDOW are padded."""
    step = np.arange(WINDOW)[:, None]
    return np.where(step < n, inv[np.minimum(begin + step, len(inv) - 1)], pad)


def fit(texts: list[str], labels: list[int], epochs: int | None = None, most_epochs: int = 5, batch: int = 16, per_doc: int = 16, rate: float = 0.02, seed: int = 3) -> Net | None:
    """Adam on the log loss of a document's log-sum-exp; of a longer document's windows ``per_doc`` are used in
    an epoch: drawn at random in the first, later half at random and half those that score highest so far."""
    y = np.array(labels)
    if len(set(labels)) < 2:
        return None
    epochs = epochs or max(2, min(most_epochs, 10_000 // len(texts)))  # small samples are read more often
    inv, at, bucket, grams, goff = distinct_words(pa.array(texts, pa.large_string()))
    begin, n, doc = windows(at)
    first = np.searchsorted(doc, np.arange(len(texts) + 1))
    net, rng = Net.new(), np.random.default_rng(seed)
    m = {k: np.zeros_like(v) for k, v in net.p.items()}
    s = {k: np.zeros_like(v) for k, v in net.p.items()}
    step = 0
    balance = np.where(y == 1, min(4.0, (y == 0).sum() / max(1, (y == 1).sum())), 1.0)
    for epoch in range(epochs):
        order = rng.permutation(np.flatnonzero(np.diff(first) > 0))
        lr = rate * (1 - epoch / epochs) ** 0.5
        if epoch:
            x = net.inputs(bucket, grams, goff)
            heat = np.concatenate([net.forward(x, window_ids(inv, begin[a : a + 4096], n[a : a + 4096], len(x)))[0] for a in range(0, len(begin), 4096)])
        else:
            heat = rng.random(len(begin))
        for b in range(0, len(order), batch):
            some = order[b : b + batch]
            picks = [_pick(rng, heat[first[d] : first[d + 1]], per_doc) + first[d] for d in some]
            w = np.concatenate(picks)
            seg = np.concatenate([[0], np.cumsum([len(p) for p in picks])])[:-1]
            raw = window_ids(inv, begin[w], n[w], -1)
            used, local = np.unique(raw, return_inverse=True)
            local = local.reshape(raw.shape)
            if used[0] == -1:
                used = used[1:]
                local = np.where(local == 0, len(used), local - 1)
            lens = goff[used + 1] - goff[used]
            sub_off = np.concatenate([[0], np.cumsum(lens)])
            sub = grams[np.repeat(goff[used], lens) + np.arange(sub_off[-1]) - np.repeat(sub_off[:-1], lens)]
            x = net.inputs(bucket[used], sub, sub_off)
            logit, tape = net.forward(x, local, keep=True)
            top = np.maximum.reduceat(logit, seg)
            e = np.exp(logit - np.repeat(top, np.diff([*seg, len(w)])))
            sums = np.add.reduceat(e, seg)
            counts = np.diff([*seg, len(w)])
            bag = top + np.log(sums)
            err = (sigmoid(bag) - y[some]) * balance[some] / len(some)
            share = e / np.repeat(sums, counts)
            g = net.backward(x, local, tape, (np.repeat(err, counts) * share).astype(np.float32))
            dx = g.pop("x")
            step += 1
            for k, v in g.items():
                _adam(net.p[k], m[k], s[k], v, lr, step)
            _rows(net.p["word"], m["word"], s["word"], bucket[used], dx, lr)
            _rows(net.p["char"], m["char"], s["char"], sub, np.repeat(dx / lens[:, None], lens, axis=0), lr)
    return net


def _pick(rng: np.random.Generator, heat: np.ndarray, most: int) -> np.ndarray:
    if len(heat) <= most:
        return np.arange(len(heat))
    order = np.argsort(-heat)
    return np.concatenate([order[: most // 2], rng.choice(order[most // 2 :], most - most // 2, replace=False)])


def _adam(p: np.ndarray, m: np.ndarray, s: np.ndarray, g: np.ndarray, lr: float, step: int) -> None:
    m += 0.1 * (g - m)
    s += 0.01 * (g * g - s)
    p -= lr * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.99**step)) + 1e-6)


def _rows(p: np.ndarray, m: np.ndarray, s: np.ndarray, ids: np.ndarray, g: np.ndarray, lr: float) -> None:
    """Adagrad on the rows that occur."""
    order = np.argsort(ids, kind="stable")
    k = ids[order]
    first = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
    g = np.add.reduceat(g[order], first, axis=0)
    k = k[first]
    s[k] += g * g
    p[k] -= 3 * lr * g / (np.sqrt(s[k]) + 1e-5)


def score(net: Net | None, texts: pa.Array, most: int = 4096) -> np.ndarray:
    """Score of each whole text: the largest over all its windows."""
    out = np.zeros(len(texts))
    if net is None:
        return out
    inv, at, bucket, grams, goff = distinct_words(texts)
    begin, n, doc = windows(at)
    x = net.inputs(bucket, grams, goff)
    best = np.full(len(texts), -np.inf)
    for a in range(0, len(begin), most):
        logit, _ = net.forward(x, window_ids(inv, begin[a : a + most], n[a : a + most], len(x)))
        np.maximum.at(best, doc[a : a + most], logit)
    best[np.isneginf(best)] = min(float(net.p["b"][0]), -1.0)
    return 1 / (1 + np.exp(-np.clip(best, -40, 40)))


def train(docs: DataFrame, labels: DataFrame, toxic_sample: int = 1200, clean_sample: int = 3600, sample_chars: int = 12_000, folds: int = 4) -> Net | None:
    """Fits on a bounded sample of labelled rows outside the held-out fold."""
    ok = (F.length("text") <= sample_chars) & (crc32_mod("doc_id", folds) != 2)
    marks = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    ids = docs.where(ok).select("doc_id").join(marks, "doc_id").withColumn("_h", F.xxhash64("doc_id"))
    clean, toxic = (ids.where(some).orderBy("_h", "doc_id").limit(most) for some, most in ((F.col("toxic") <= 0, clean_sample), (F.col("toxic") > 0, toxic_sample)))
    chosen = clean.unionByName(toxic).collect()  # the join below both is shared
    if not chosen:
        return None
    spark = docs.sparkSession
    few = F.broadcast(spark.createDataFrame([(r["doc_id"], r["toxic"]) for r in chosen], "doc_id long, toxic int").dropDuplicates())  # at most toxic_sample + clean_sample ids
    got = docs.where(ok).select("doc_id", "text").join(few, "doc_id").select(F.xxhash64("doc_id").alias("h"), "text", "toxic")
    got = got.orderBy("h", "text").limit(len(chosen))  # where an id is repeated, its rows would be more than were chosen
    made = got.repartition(1).mapInArrow(_fits, "net binary").collect()  # one task of bounded size; the driver gets the net alone
    return pickle.loads(made[0]["net"]) if made else None


def _fits(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = sorted((h, t, y) for b in it for h, t, y in zip(*(c.to_pylist() for c in b.columns)))
    yield pa.RecordBatch.from_pydict({"net": [pickle.dumps(fit([r[1] for r in rows], [int(r[2] > 0) for r in rows]))]})


def _scores(shared):
    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for part in slices(it, "text", 1 << 20):
            s = score(shared.value, text_col(part, "text"))
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return run


def predict(docs: DataFrame, net: Net | None, folds: int = 4) -> DataFrame:
    """doc_id, held_out, score, predicted for every row. The net is broadcast: its size is fixed (about 2.4 MB)."""
    shared = docs.sparkSession.sparkContext.broadcast(net)
    held = F.coalesce(crc32_mod("doc_id", folds) == 2, F.lit(False))
    return docs.select(F.col("doc_id").cast("long"), held.alias("held_out"), "text").mapInArrow(_scores(shared), _OUT)


def keep_clean(docs: DataFrame, net: Net | None) -> DataFrame:
    """The rows of ``docs`` that score under the threshold, whole."""
    shared = docs.sparkSession.sparkContext.broadcast(net)

    def run(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        only("toxicity")
        for part in slices(it, "text", 1 << 20):
            yield part.filter(pa.array(score(shared.value, text_col(part, "text")) < THRESHOLD))

    return docs.mapInArrow(run, docs.schema)
