"""Masked pseudo-likelihood: a plain scorer, exact counts held or joined, equal results for any split."""

import math
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from terraweave.llm import pseudo_likelihood as P


def plain_scores(texts, model):
    """Log probability of each text, word by word, by loops over the network's weights."""
    w = {k: getattr(model.network, k).astype(float).tolist() for k in P._SHAPES}
    parsed = []
    for text in texts:
        for _, _, hashes, leaf, _ in P._tokens(pa.array([text])):
            parsed.append((text.lower().split(), P._classes(hashes, leaf, model.own).tolist(), leaf.tolist()))
    n, size = Counter(), Counter()
    for words, classes, leaves in parsed:
        for word, c, leaf in zip(words, classes, leaves, strict=True):
            n[word] += 1
            size[leaf] += c >= P.OWN
    share = lambda logits, at: logits[at] - math.log(sum(map(math.exp, logits)))
    out = []
    for words, classes, leaves in parsed:
        total = 0.0
        for i, (word, c, leaf) in enumerate(zip(words, classes, leaves, strict=True)):
            near = [classes[j] if 0 <= j < len(words) else P.CLASSES for d in range(1, P.SIDE + 1) for j in (i - d, i + d)]
            h = [math.tanh(sum(w["embed"][k][near[k]][u] for k in range(2 * P.SIDE)) + w["bias"][u]) for u in range(P.WIDTH)]
            total += share([sum(h[u] * w["out"][u][k] for u in range(P.WIDTH)) + w["out_bias"][k] for k in range(P.CLASSES)], c)
            if c >= P.OWN:
                total += share([sum(h[u] * w["branch"][u][k] for u in range(P.WIDTH)) + w["branch_bias"][c - P.OWN][k] for k in range(P.BRANCHES)], leaf % P.BRANCHES)
                total += math.log(n[word] / (size[leaf] + 1))
        out.append(total)
    return out


@pytest.mark.parametrize("held", [1 << 14, 40, 0])
def test_scores_equal_a_plain_scorer(spark, monkeypatch, held):
    monkeypatch.setattr(P, "HELD", held)
    rng = np.random.default_rng(4)
    texts = [" ".join(f"w{int(x)}" for x in rng.zipf(1.3, 120) % 900) for _ in range(12)] + ["Odd WORDS of odd words"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "")], "doc_id bigint, text string")
    model = P.train(docs)
    assert len(model.held) <= held and (model.others is None) == (held > 900)
    got = {r.doc_id: r.log_probability for r in P.score_documents(docs, model).collect() if r.n_tokens}
    assert [got[i] for i in range(len(texts))] == pytest.approx(plain_scores(texts, model), abs=1e-2)


def test_words_of_a_leaf_sum_to_one(spark, monkeypatch):
    """300,000 words, more than are held: each has its own count."""
    monkeypatch.setattr(P, "HELD", 1 << 14)
    words = [f"{i:06d}x{i % 7}" for i in range(300_000)]
    twice = words[:40_000]
    docs = spark.createDataFrame([(i, " ".join((words + twice)[i : i + 1000])) for i in range(0, 340_000, 1000)], "doc_id bigint, text string")
    model = P.train(docs, rounds=1)
    assert int(model.totals.sum()) == 340_000 - 2 * P.OWN
    assert not len(model.held) and model.others.where("n = 2").count() == 40_000 == model.others.count()


def test_every_branch_sums_to_one(spark):
    net = P.Network.fresh()
    near = np.random.default_rng(3).integers(0, P.CLASSES + 1, (2 * P.SIDE, 5))
    for i in range(5):
        one, total = near[:, [i]], 0.0
        for c in range(P.CLASSES):
            many = P.BRANCHES if c >= P.OWN else 1
            total += np.exp(net.log_probability(np.repeat(one, many, 1), np.full(many, c), np.arange(many))).sum()
        assert total == pytest.approx(1, abs=1e-5)


def test_scores_do_not_depend_on_the_split(spark, docs, monkeypatch):
    """Equal, not close: 1 and 8 partitions, other orders, other batches; models of several shards, added in steps."""
    monkeypatch.setattr(P, "SHARD_WORDS", 20_000)
    monkeypatch.setattr(P, "SUM_MODELS", 3)
    monkeypatch.setattr(P, "HELD", 3000)
    rows, key = docs.select("doc_id", "text").unionByName(docs.limit(5).select(F.lit(None).cast("bigint").alias("doc_id"), "text")), "spark.sql.execution.arrow.maxRecordsPerBatch"
    before, got = spark.conf.get(key), []
    try:
        for batch, moved in ((1000, rows.coalesce(1)), (17, rows.orderBy(F.desc("doc_id")).repartition(8, "doc_id")), (64, rows.orderBy("text").coalesce(1))):
            spark.conf.set(key, str(batch))
            got.append(sorted((str(r.doc_id), r.n_tokens, r.log_probability) for r in P.score_documents(moved, P.train(moved)).collect()))
    finally:
        spark.conf.set(key, before)
    assert got[0] == got[1] == got[2]


def test_counts_grow_with_the_corpus(spark):
    docs = spark.createDataFrame([(i, f"w{i} w{i} v{i % 9}") for i in range(500)], "doc_id bigint, text string")
    assert P.count_words(docs, "text").count() == 509
    assert P.count_words(docs.where("doc_id < 100"), "text").count() == 109
