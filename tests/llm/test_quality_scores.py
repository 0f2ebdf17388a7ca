"""Quality scores: a plain scorer, and the same score whatever stands around a text."""

import math
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraweave.llm import quality as Q

SF = "/root/testdata/sf0.001"


def plain_passages(text):
    """Features of each passage by loops over bytes and words."""
    raw = text.encode()
    words = [(m.start(), m.end()) for m in re.finditer(rb"[^\x20\x09-\x0D]+", raw)]
    groups = [words[i : i + Q.PASSAGE] for i in range(0, len(words), Q.PASSAGE)] or [[]]
    begins = [0] + [g[0][0] for g in groups[1:]] + [len(raw)]
    out = []
    for g, a, b in zip(groups, begins, begins[1:], strict=False):
        x, part = [0.0] * Q.FEATURES, raw[a:b]
        many = max(1, len(part))
        for byte in part:
            x[Q._CLASS[byte]] += 1 / many
        for p, q in zip(part, part[1:], strict=False):
            x[Q.CLASSES + ((p * 31 + q) * 40503 >> 7 & Q.BIGRAMS - 1)] += 1 / many
        w, n = [raw[s:e] for s, e in g], max(1, len(g))
        same = [sum(w[i] == w[i - lag] for i in range(lag, len(w))) / n for lag in (1, 2, 3)]
        x[Q.CLASSES + Q.BIGRAMS :] = [len(w) / Q.PASSAGE, sum(map(len, w)) / n / 16, *same, len(set(w)) / n, len(part) / 512]
        out.append(x)
    return out


def plain_score(model, text):
    p, bag = {k: v.astype(float) for k, v in model.weights.items()}, []
    for x in plain_passages(text):
        x = [(v - m) / s for v, m, s in zip(x, model.mean, model.spread, strict=True)]
        h = [math.tanh(sum(x[i] * p["We"][i, j] for i in range(len(x))) + p["be"][j]) for j in range(Q.HIDDEN)]
        mixed = lambda name, h=h: [sum(h[i] * p[name][i, j] for i in range(Q.HIDDEN)) for j in range(Q.HIDDEN)]
        e = sum(math.tanh(a) / (1 + math.exp(-b)) * w for a, b, w in zip(mixed("V"), mixed("U"), p["w"], strict=True))
        bag.append((math.exp(e), h))
    whole = sum(a for a, _ in bag)
    z = [sum(a * h[j] for a, h in bag) / whole for j in range(Q.HIDDEN)]
    return 1 / (1 + math.exp(-(sum(v * o for v, o in zip(z, p["o"], strict=True)) + p["c"][0])))


@pytest.fixture(scope="module")
def model(docs, spark):
    return Q.train(docs, spark.read.parquet(f"{SF}/labels.parquet"))


def test_scores_equal_a_plain_scorer(docs, odd, model):
    texts = [r.text or "" for r in docs.where("n_chars < 2000").limit(30).collect()] + ["", "one", "a b", "Über 12 Ärzte! 数字\n" * 90]
    table = pa.array(texts)
    got = np.concatenate([model.score(x, first) for _, _, x, first in Q._features(table)])
    assert got.tolist() == pytest.approx([plain_score(model, t) for t in texts], abs=2e-5)


def test_scores_do_not_depend_on_neighbours(spark, docs, model):
    """Equal, not close: other orders, batch sizes and partitions."""
    rows, key = docs.select("doc_id", "text"), "spark.sql.execution.arrow.maxRecordsPerBatch"
    want = {r.doc_id: r.score for r in Q.classify(rows, model).collect()}
    before = spark.conf.get(key)
    try:
        for order, parts, batch in ((F.desc("doc_id"), 1, 1000), (F.xxhash64("doc_id"), 1, 7), ("text", 1, 64), ("doc_id", 5, 33)):
            spark.conf.set(key, str(batch))
            moved = rows.orderBy(order).coalesce(1) if parts == 1 else rows.repartition(parts, "doc_id")
            assert {r.doc_id: r.score for r in Q.classify(moved, model).collect()} == want
    finally:
        spark.conf.set(key, before)


def test_training_does_not_depend_on_order(spark, docs, model):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    again = Q.train(docs.repartition(5, "text").orderBy(F.desc("doc_id")), labels.repartition(3))
    assert all((again.weights[k] == model.weights[k]).all() for k in model.weights)


def test_training_is_bounded_by_passages(spark, docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    assert Q.train(docs, labels, max_passages=60) is not None
    long = spark.createDataFrame([(i, "word " * 64 * (3 + i)) for i in range(4)], "doc_id bigint, text string")
    marks = spark.createDataFrame([(i, i % 2) for i in range(4)], "doc_id bigint, quality int")
    assert Q.train(long, marks, max_passages=2) is None and Q.train(long, marks, max_passages=100) is not None
