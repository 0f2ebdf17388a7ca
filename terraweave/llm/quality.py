"""Quality classifier: attention-based multiple-instance learning over passages."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import drop_staged, staged
from . import kernels as K
from .language_id import held_out

#: Words of a passage.
PASSAGE = 64
#: Labelled documents, drawn by the hash of their id, from which the classifier is fitted.
TRAIN_DOCS = 4096
#: Passages that they may have together: 29 MB of features on the driver.
TRAIN_PASSAGES = 1 << 17
BIGRAMS = 64
HIDDEN = 24
EPOCHS = 30

#: The class of each byte: one for each ASCII punctuation mark, then lower, upper, digit, space, line end, control, other.
_CLASS = np.full(256, 38, np.int64)
_marks = [b for b in range(33, 127) if not chr(b).isalnum()]
_CLASS[_marks] = np.arange(len(_marks))
_CLASS[97:123], _CLASS[65:91], _CLASS[48:58] = 32, 33, 34
_CLASS[:32], _CLASS[32], _CLASS[10] = 37, 35, 36
CLASSES = 39
FEATURES = CLASSES + BIGRAMS + 7


def passages(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Features of every passage of a chunk, and each row's first passage; a row has one at least."""
    w = K.words(data, offsets, K.SPACE_WORDS, lower=False)
    rows = len(offsets) - 1
    count = np.maximum(1, -(-np.diff(w.first) // PASSAGE))
    first = np.concatenate(([0], np.cumsum(count)))
    total = int(first[-1])
    row = w.row_of()
    of_word = first[row] + (np.arange(len(row)) - w.first[row]) // PASSAGE
    head = np.searchsorted(of_word, np.arange(total))
    begin = np.repeat(offsets[:-1], count)
    later = np.arange(total) != np.repeat(first[:-1], count)
    begin[later] = w.starts[head[later]]
    sizes = np.diff(np.append(begin, len(data)))
    of_byte = np.repeat(np.arange(total), sizes)
    out = np.zeros((total, FEATURES), np.float32)
    many = np.maximum(sizes, 1)[:, None]
    out[:, :CLASSES] = np.bincount(of_byte * CLASSES + _CLASS[data], minlength=total * CLASSES).reshape(total, CLASSES) / many
    if len(data) > 1:
        # A pair belongs to the passage that holds both bytes; none crosses into the next passage or row.
        inner = of_byte[:-1] == of_byte[1:]
        pair = (data[:-1].astype(np.int64) * 31 + data[1:]) * 40503 >> 7 & (BIGRAMS - 1)
        out[:, CLASSES : CLASSES + BIGRAMS] = np.bincount((of_byte[:-1] * BIGRAMS + pair)[inner], minlength=total * BIGRAMS).reshape(total, BIGRAMS) / many
    n = np.bincount(of_word, minlength=total)
    one = np.maximum(n, 1)
    stats = out[:, CLASSES + BIGRAMS :]
    stats[:, 0] = n / PASSAGE
    stats[:, 1] = np.bincount(of_word, w.ends - w.starts, total) / one / 16
    for lag in (1, 2, 3):
        same = np.zeros(len(row), bool)
        same[lag:] = (w.hashes[lag:] == w.hashes[:-lag]) & (of_word[lag:] == of_word[:-lag])
        stats[:, 1 + lag] = np.bincount(of_word, same, total) / one
    keys = np.sort((of_word.astype(np.uint64) << np.uint64(40)) | (w.hashes >> np.uint64(24)))
    fresh = np.ones(len(keys), bool)
    fresh[1:] = keys[1:] != keys[:-1]
    stats[:, 5] = np.bincount((keys[fresh] >> np.uint64(40)).astype(np.int64), minlength=total) / one
    stats[:, 6] = sizes / 512
    return out, first


def _features(column: pa.Array):
    for row, end, data, offsets in K.chunks(column):
        x, first = passages(data, offsets)
        yield row, end, x, first


@dataclass
class AttentionModel:
    """Passage encoder tanh(We x + be), gated attention over passages, a logistic head.

    A document's score depends on its passages alone, to the last bit: products have one shape,
    and sums run over one row or one document.
    """

    mean: np.ndarray
    spread: np.ndarray
    weights: dict[str, np.ndarray]

    def forward(self, x: np.ndarray, first: np.ndarray):
        p = self.weights
        h = np.tanh(K.times(x, p["We"]) + p["be"])
        t, g = np.tanh(K.times(h, p["V"])), 1 / (1 + np.exp(-K.times(h, p["U"])))
        e = (t * g * p["w"]).sum(1)
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, first[:-1]), np.diff(first)))
        a = e / np.repeat(np.add.reduceat(e, first[:-1]), np.diff(first))
        z = np.add.reduceat(a[:, None] * h, first[:-1], axis=0)
        return h, t, g, a, z, (z * p["o"]).sum(1) + p["c"]

    def score(self, x: np.ndarray, first: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.forward((x - self.mean) / self.spread, first)[-1].astype(np.float64), -30, 30)))


def fit(x: np.ndarray, first: np.ndarray, label: np.ndarray, epochs: int = EPOCHS, seed: int = 7) -> AttentionModel:
    """Adam on the log loss of documents; x holds all passages, first each document's begin."""
    rng = np.random.default_rng(seed)
    mean, spread = x.mean(0), x.std(0) + 1e-2
    x = ((x - mean) / spread).astype(np.float32)
    shapes = {"We": (x.shape[1], HIDDEN), "be": (HIDDEN,), "V": (HIDDEN, HIDDEN), "U": (HIDDEN, HIDDEN), "w": (HIDDEN,), "o": (HIDDEN,), "c": (1,)}
    p = {k: (rng.normal(0, 1 / np.sqrt(s[0]), s) if k not in ("be", "c") else np.zeros(s)).astype(np.float32) for k, s in shapes.items()}
    model, docs = AttentionModel(mean, spread, p), len(first) - 1
    m, v, step = {k: np.zeros_like(a) for k, a in p.items()}, {k: np.zeros_like(a) for k, a in p.items()}, 0
    for epoch in range(epochs):
        for batch in np.array_split(rng.permutation(docs), max(1, docs // 64)):
            counts = first[batch + 1] - first[batch]
            begin = np.concatenate(([0], np.cumsum(counts)))
            at = np.repeat(first[batch] - begin[:-1], counts) + np.arange(begin[-1])
            xb = x[at]
            h, t, g, a, z, logit = model.forward(xb, begin)
            d = (1 / (1 + np.exp(-logit)) - label[batch]) / len(batch)
            dz = d[:, None] * p["o"]
            dzr = np.repeat(dz, counts, 0)
            da = (dzr * h).sum(1)
            de = a * (da - np.repeat(np.add.reduceat(a * da, begin[:-1]), counts))
            dt, dg = de[:, None] * p["w"] * g * (1 - t * t), de[:, None] * p["w"] * t * g * (1 - g)
            dh = (a[:, None] * dzr + dt @ p["V"].T + dg @ p["U"].T) * (1 - h * h)
            grads = {"We": xb.T @ dh, "be": dh.sum(0), "V": h.T @ dt, "U": h.T @ dg, "w": (t * g).T @ de, "o": z.T @ d, "c": d.sum(keepdims=True)}
            step += 1
            rate = 3e-3 * (1 - 0.9 * epoch / epochs)
            for k, grad in grads.items():
                grad = grad + 1e-4 * p[k]
                m[k] += 0.1 * (grad - m[k])
                v[k] += 0.01 * (grad * grad - v[k])
                p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)).astype(np.float32)
    return model


def _first_texts(rows: DataFrame) -> DataFrame:
    """Of the texts that repeat an id, the one with the smallest hash."""
    return rows.groupBy("doc_id").agg(F.min(F.struct("h", "n", "x", "y")).alias("r")).select("doc_id", "r.*")


def train(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text", label: str = "quality", max_docs: int = TRAIN_DOCS, max_passages: int = TRAIN_PASSAGES,
) -> AttentionModel | None:
    """Fit on about max_docs labelled documents, drawn by the hash of their id; their whole texts count.

    Of those drawn, the driver gets texts in hash order as long as they fit into max_passages
    together, so a text of more passages than that teaches nothing. Rows with a null id, label
    or text teach nothing either; an id with several labels has the largest, one with several
    texts the one with the smallest hash; None where nothing or only one label is left.
    """
    labels = labels.where(F.col(doc_id).isNotNull() & F.col(label).isNotNull()).select(F.col(doc_id).alias("doc_id"), F.col(label).cast("double").alias("y"))
    every = max(1, -(-labels.count() // max_docs))
    # About max_docs rows of two numbers: the bound of this broadcast.
    drawn = labels.where(F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(every)) == 0).groupBy("doc_id").agg(F.max("y").alias("y"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text is not null").join(F.broadcast(drawn), "doc_id")

    def run(batches):
        for batch in batches:
            for row, end, x, first in _features(batch.column(0)):
                parts = [x[a:b].astype(np.float16).tobytes() for a, b in zip(first[:-1], first[1:], strict=True)]
                count = pa.array(np.diff(first))
                rest = [batch.column(i).slice(row, end - row) for i in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays([*rest, count, pa.array(parts, pa.binary())], ["doc_id", "h", "y", "n", "x"])

    kind = docs.schema[doc_id].dataType.simpleString()
    got = rows.select("text", "doc_id", F.xxhash64("text").alias("h"), "y").mapInArrow(run, f"doc_id {kind}, h bigint, y double, n bigint, x binary")
    got = staged(_first_texts(got))
    # About max_docs rows: the passages that come before, in hash order.
    size = Window.orderBy(F.xxhash64("h", "doc_id"), "h", "doc_id")
    fit_in = got.where(F.col("n") <= max_passages).select("doc_id", F.sum("n").over(size).alias("upto")).where(F.col("upto") <= max_passages)
    table = got.join(F.broadcast(fit_in), "doc_id").select("x", "y").toArrow()
    drop_staged(got)
    y = table["y"].to_numpy()
    if not len(y) or y.min() == y.max():
        return None
    raw = table["x"].to_pylist()
    order = sorted(range(len(y)), key=lambda i: (raw[i], y[i]))
    x = [np.frombuffer(raw[i], np.float16).reshape(-1, FEATURES).astype(np.float32) for i in order]
    return fit(np.concatenate(x), np.concatenate(([0], np.cumsum([len(a) for a in x]))), y[order].astype(np.float32))


def classify(docs: DataFrame, model: AttentionModel | None, *, text: str = "text", columns: list[str] | None = None) -> DataFrame:
    """docs (or some columns of it) with score (0 to 1) and predicted (1 if score >= 0.5), over whole texts.

    A score depends on the text alone, whatever rows, batches or partitions surround it. Null and
    empty texts are one passage without features and get that passage's score; without
    a model every score is 0.5; repeated rows score alike; columns score and predicted are
    replaced; no rows give no rows.
    """
    keep = [c for c in (columns or docs.columns) if c not in ("score", "predicted")]
    held = docs.sparkSession.sparkContext.broadcast(model)
    K.small_batches(docs.sparkSession)

    def run(batches):
        for batch in batches:
            score = np.full(batch.num_rows, 0.5)
            if held.value is not None:
                for row, end, x, first in _features(batch.column(0)):
                    score[row:end] = held.value.score(x, first)
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return docs.select(F.col(text).alias("_text"), *keep).mapInArrow(run, docs.select(*keep).schema.add("score", "double").add("predicted", "integer"))


__all__ = ["AttentionModel", "classify", "fit", "held_out", "passages", "train"]
