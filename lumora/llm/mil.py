"""Quality by attention-based multiple-instance learning.

A document is a bag of passages of PASSAGE words (the last one may be shorter), over its whole text. Every passage
is encoded by its words and its looks: the learnt embeddings of its words (hashed to BUCKETS, summed over the passage and divided
by the root of their number), and a learnt map of FEATURES numbers (shares of kinds of characters and words, repetition, word and line
lengths, hashed word shapes), through a tanh layer. Gated attention, softmax(w . (tanh(V h) * sigmoid(U h))) over
the document's passages, weighs them; the weighted sum is scored by a logistic unit. All of it, embeddings included, is learnt
from document labels alone, with seeded Adam steps on the driver, from a bounded sample of labelled documents: those with the
least hash of doc_id, at most TRAIN_DOCS of them and as many as have TRAIN_PASSAGES passages in all. A document is taken with
all of its passages or not at all. Scoring reads every passage of every text. The broadcast model has a fixed size.

Null and empty texts are a bag of one passage of zeros, with a score as any other. Labels that are null, or whose
document isn't there, are left out; of several rows for one doc_id the least label counts; if one class is missing
the model says that class. Repeated documents get a row each; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .jobs import cut, prepare, table, tidy
from .text import SPACED, Words, column, mix, slices

PASSAGE, TRAIN_DOCS, TRAIN_PASSAGES = 64, 4000, 100_000
BUCKETS = 1024
SHAPES = 32
PLAIN = 18
FEATURES = PLAIN + SHAPES
HIDDEN, GATE, EPOCHS, RATE, DECAY = 24, 12, 40, 0.01, 1e-4
_STEP = 512  # passages encoded at a time

_CLASS = np.zeros(256, dtype=np.uint8)  # 0 other, 1 lower, 2 upper, 3 digit, 4 beyond ASCII, 5 full stop or comma, 6 other mark
_CLASS[33:127] = 6
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58], _CLASS[128:] = 1, 2, 3, 4
_CLASS[[44, 46]] = 5


def featurise(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(passages x FEATURES, passages x PASSAGE buckets of words, filled up with BUCKETS, the row of each passage); every row has one passage at least."""
    w = Words(raw, off, SPACED)
    rows = len(off) - 1
    per_row = np.maximum(1, -(-w.counts // PASSAGE))
    first = np.concatenate(([0], np.cumsum(per_row)))
    owner = np.repeat(np.arange(rows), per_row)
    total = int(first[-1])
    out = np.zeros((total, FEATURES), dtype=np.float32)
    ids = np.full((total, PASSAGE), BUCKETS, dtype=np.uint16)
    if not len(w.starts):
        return out, ids, owner
    row_of = w.rows()
    passage = first[row_of] + (np.arange(len(row_of)) - w.bounds[row_of]) // PASSAGE
    n = np.bincount(passage, minlength=total).astype(np.float64)
    length = w.ends - w.starts
    chars = np.maximum(1.0, np.bincount(passage, weights=length, minlength=total))
    kind = _CLASS[raw]
    words = np.maximum(1.0, n)
    share = lambda mask, by: np.bincount(passage, weights=mask, minlength=total) / by
    counts = {}
    for k in (1, 2, 3, 4, 5, 6):
        sums = np.concatenate(([0], np.cumsum(kind == k, dtype=np.int32)))
        counts[k] = sums[w.ends] - sums[w.starts]
        out[:, k - 1] = share(counts[k], chars)
    letters = counts[1] + counts[2] + counts[4]
    out[:, 6] = share(length, words) / 10
    out[:, 7] = share(counts[6] >= 1, words)
    out[:, 8] = share(letters == 0, words)
    out[:, 9] = share((counts[2] >= 2) & (counts[1] == 0), words)
    out[:, 10] = share(counts[5] >= 1, words)
    out[:, 11] = share(length == 1, words)
    out[:, 12] = share(length >= 12, words)
    h = w.hashes()
    ids[passage, (np.arange(len(h)) - w.bounds[row_of]) % PASSAGE] = mix(h) % np.uint64(BUCKETS)
    bits = total.bit_length()
    key = np.sort(mix(h) >> np.uint64(bits) | passage.astype(np.uint64) << np.uint64(64 - bits))
    at = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    runs = np.diff(np.concatenate((at, [len(key)])))
    where = (key[at] >> np.uint64(64 - bits)).astype(np.int64)
    most = np.zeros(total)
    np.maximum.at(most, where, runs)
    out[:, 13] = np.bincount(where, minlength=total) / words
    out[:, 14] = most / words
    same = np.zeros(len(h), dtype=bool)
    same[1:] = (h[1:] == h[:-1]) & (passage[1:] == passage[:-1])
    out[:, 15] = share(same, words)
    lines = np.concatenate(([0], np.cumsum(raw == 10, dtype=np.int32)))
    gap = np.zeros(len(h))
    gap[1:] = (lines[w.starts[1:]] - lines[w.ends[:-1]]) * (row_of[1:] == row_of[:-1])
    out[:, 16] = share(gap, words)
    out[:, 17] = n / PASSAGE
    shape = kind[w.starts].astype(np.int64) * 49 + kind[w.ends - 1] * 7 + kind[np.minimum(w.starts + 1, w.ends - 1)]
    shape = (mix(shape.astype(np.uint64) * np.uint64(64) + np.minimum(length, 12).astype(np.uint64) // np.uint64(3)) % np.uint64(SHAPES)).astype(np.int64)
    out[:, PLAIN:] = np.bincount(passage * SHAPES + shape, minlength=total * SHAPES).reshape(total, SHAPES) / words[:, None]
    return out, ids, owner


def word_counts(ids: np.ndarray) -> np.ndarray:
    """passages x BUCKETS: how often each bucket occurs, over the root of the passage's words."""
    n = (ids < BUCKETS).sum(axis=1, keepdims=True)
    flat = (np.arange(len(ids))[:, None] * (BUCKETS + 1) + ids).ravel()
    counts = np.bincount(flat, minlength=len(ids) * (BUCKETS + 1)).reshape(-1, BUCKETS + 1)[:, :BUCKETS]
    return (counts / np.sqrt(np.maximum(n, 1))).astype(np.float32)


class Model:
    """The network's weights: arrays of fixed sizes."""

    def __init__(self, weights: dict[str, np.ndarray], mean: np.ndarray, scale: np.ndarray):
        self.weights, self.mean, self.scale = weights, mean, scale

    def encode(self, x: np.ndarray, ids: np.ndarray) -> np.ndarray:
        """Passages x HIDDEN, a bounded number of passages at a time."""
        p, out = self.weights, []
        for lo in range(0, len(x), _STEP):
            shape = (x[lo : lo + _STEP].astype(np.float64) - self.mean) / self.scale
            out.append(np.tanh(shape @ p["W"] + word_counts(ids[lo : lo + _STEP]) @ p["E"] + p["b"]))
        return np.concatenate(out)

    def attend(self, h: np.ndarray, first: np.ndarray) -> tuple:
        """h: encoded passages by bag, first: where each bag begins."""
        p = self.weights
        n = np.diff(np.concatenate((first, [len(h)])))
        a, g = np.tanh(h @ p["V"] + p["bv"]), 1 / (1 + np.exp(-(h @ p["U"] + p["bu"])))
        e = (a * g) @ p["w"]
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first), n))
        alpha = e / np.repeat(np.add.reduceat(e, first), n)
        z = np.add.reduceat(alpha[:, None] * h, first, axis=0)
        y = z @ p["c"] + p["d"][0]
        return a, g, alpha, z, 1 / (1 + np.exp(-np.clip(y, -40, 40))), n

    def score(self, x: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.attend(self.encode(x, ids), first)[4]

    def attention(self, x: np.ndarray, ids: np.ndarray, first: np.ndarray) -> np.ndarray:
        return self.attend(self.encode(x, ids), first)[2]


def fit(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> Model:
    """bags: features and word buckets of each document's passages."""
    rng = np.random.Generator(np.random.PCG64(seed))
    shapes = {"W": (FEATURES, HIDDEN), "E": (BUCKETS, HIDDEN), "b": (HIDDEN,), "V": (HIDDEN, GATE), "bv": (GATE,), "U": (HIDDEN, GATE), "bu": (GATE,), "w": (GATE,), "c": (HIDDEN,), "d": (1,)}
    p = {k: rng.normal(0, 1 / np.sqrt(s[0]), s) if len(s) == 2 or k in "wc" else np.zeros(s) for k, s in shapes.items()}
    if not bags or labels.min() == labels.max():
        p = {k: np.zeros(s) for k, s in shapes.items()}
        p["d"][0] = 0 if not bags else (6 if labels[0] else -6)
        return Model(p, np.zeros(FEATURES), np.ones(FEATURES))
    n = np.array([len(x) for x, _ in bags], dtype=np.float64)
    mean = sum(x.sum(axis=0, dtype=np.float64) for x, _ in bags) / n.sum()
    var = sum(((x - mean) ** 2).sum(axis=0) for x, _ in bags) / n.sum()
    model = Model(p, mean, np.sqrt(var) + 1e-3)
    m1, m2, step = {k: np.zeros_like(v) for k, v in p.items()}, {k: np.zeros_like(v) for k, v in p.items()}, 0
    for epoch in range(epochs):
        order = rng.permutation(len(bags))
        # steps of some 2000 passages: a long document is a step of its own
        cuts = np.flatnonzero(np.diff(np.cumsum(n[order]) // 2000, prepend=0))
        for pick in np.split(order, cuts):
            if not len(pick):
                continue
            first = np.concatenate(([0], np.cumsum(n[pick]).astype(np.int64)))[:-1]
            x = (np.concatenate([bags[i][0] for i in pick]) - model.mean) / model.scale
            ids = np.concatenate([bags[i][1] for i in pick])
            h = np.concatenate([np.tanh(x[lo : lo + _STEP] @ p["W"] + word_counts(ids[lo : lo + _STEP]) @ p["E"] + p["b"]) for lo in range(0, len(x), _STEP)])
            a, g, alpha, z, q, sizes = model.attend(h, first)
            dy = (q - labels[pick]) / len(pick)
            wide = np.repeat(dy[:, None] * p["c"], sizes, axis=0)
            dalpha = (wide * h).sum(axis=1)
            de = alpha * (dalpha - np.repeat(np.add.reduceat(alpha * dalpha, first), sizes))
            dgate = de[:, None] * p["w"]
            da, dg = dgate * g * (1 - a * a), dgate * a * g * (1 - g)
            dh = (alpha[:, None] * wide + da @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            dE = sum(word_counts(ids[lo : lo + _STEP]).T @ dh[lo : lo + _STEP].astype(np.float32) for lo in range(0, len(x), _STEP))
            grads = {"W": x.T @ dh, "E": dE, "b": dh.sum(0), "V": h.T @ da, "bv": da.sum(0), "U": h.T @ dg, "bu": dg.sum(0), "w": (a * g).T @ de, "c": z.T @ dy, "d": np.array([dy.sum()])}
            step += 1
            rate = RATE * (1 - epoch / epochs)
            for k, v in p.items():
                grad = grads[k] + DECAY * v * (v.ndim == 2)
                m1[k] = 0.9 * m1[k] + 0.1 * grad
                m2[k] = 0.99 * m2[k] + 0.01 * grad * grad
                v -= rate * (m1[k] / (1 - 0.9**step)) / (np.sqrt(m2[k] / (1 - 0.99**step)) + 1e-8)
    return model


@tidy
def _bag_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, out, sizes = column(batch, "doc_id"), [], []
        for lo, hi, raw, off in slices(column(batch, "text")):
            x, words, owner = featurise(raw, off)
            bounds = np.searchsorted(owner, np.arange(hi - lo + 1))
            for a, b in zip(bounds[:-1], bounds[1:], strict=True):
                # a document beyond the bound of the sample can't be in it
                out.append(x[a:b].tobytes() + words[a:b].tobytes() if b - a <= TRAIN_PASSAGES else None)
                sizes.append(int(b - a))
        yield pa.RecordBatch.from_arrays([ids, pa.array(out, pa.binary()), pa.array(sizes, pa.int64())], names=["doc_id", "bag", "n"])


def _bag(raw: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    cut_ = 4 * FEATURES * n
    return np.frombuffer(raw[:cut_], dtype=np.float32).reshape(n, FEATURES), np.frombuffer(raw[cut_:], dtype=np.uint16).reshape(n, PASSAGE)


def held_out(doc_id: str = "doc_id", of: int = 3, is_: int = 1):
    return F.crc32(F.col(doc_id).cast("string")) % of == is_


def train(docs: DataFrame, labels: DataFrame) -> Model:
    """A model from labels (doc_id, quality) of rows that aren't held out, learnt from a sample of bounded size that reaches the driver."""
    prepare(docs.sparkSession)
    labels = labels.where("doc_id is not null and quality is not null").where(~held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    labels = labels.join(docs.select("doc_id").distinct(), "doc_id", "left_semi")
    picked = cut(labels.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRAIN_DOCS))
    bags = docs.select("doc_id", "text").join(F.broadcast(picked.select("doc_id")), "doc_id", "left_semi").mapInArrow(_bag_batches, "doc_id long, bag binary, n long")
    bags = cut(bags.where("bag is not null").groupBy("doc_id").agg(F.min(F.struct("bag", "n")).alias("b")).select("doc_id", "b.bag", "b.n").join(picked, "doc_id"))
    # the first ones, in order of their hash, that have TRAIN_PASSAGES passages in all
    order = Window.orderBy(F.xxhash64("doc_id"), "doc_id").rowsBetween(Window.unboundedPreceding, 0)
    few = bags.select("doc_id", F.sum("n").over(order).alias("upto")).where(F.col("upto") <= TRAIN_PASSAGES)  # of TRAIN_DOCS rows
    rows = bags.join(F.broadcast(few.select("doc_id")), "doc_id", "left_semi").orderBy("doc_id").collect()
    return fit([_bag(r.bag, r.n) for r in rows], np.array([float(r.quality > 0) for r in rows]))


def _scorer(spark: SparkSession, model: Model):
    sent = spark.sparkContext.broadcast(model)

    def scores(texts: pa.Array) -> np.ndarray:
        out = [np.zeros(0)]
        for _, _, raw, off in slices(texts):
            x, ids, owner = featurise(raw, off)
            out.append(sent.value.score(x, ids, np.searchsorted(owner, np.arange(len(off) - 1))))
        return np.concatenate(out)

    return scores


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    prepare(docs.sparkSession)
    scores = _scorer(docs.sparkSession, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([column(b, "doc_id"), pa.array(scores(column(b, "text")))], names=["doc_id", "score"])

    out = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs whose score is least or more, with all their columns."""
    prepare(docs.sparkSession)
    scores = _scorer(docs.sparkSession, model)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                yield b.filter(pa.array(scores(column(b, "text")) >= least))

    return docs.mapInArrow(run, docs.schema)


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score by a model of labels.quality."""
    docs = table(spark, sf_dir, "documents")
    return score(docs, train(docs, table(spark, sf_dir, "labels")))


QUERIES = {"op8_quality_classifier": op8_quality_classifier}
ORACLE: dict[str, str] = {}
