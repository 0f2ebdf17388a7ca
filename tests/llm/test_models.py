"""Language ID, quality, masked pseudo-likelihood: held-out accuracy, exact parts, odd rows."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.llm import language_id, pseudo_likelihood, quality
from terraweave.llm.queries import op1_language_id, op2_quality_classifier

SF = "/root/testdata/sf0.01"


def longest_matches(doc, known):
    """Phrases of the greedy parse of a whole text, by search in the training text."""
    at, phrases = 0, 0
    while at < len(doc):
        n = 1
        while at + n < len(doc) and doc[at : at + n + 1] in known:
            n += 1
        at, phrases = at + (n if doc[at : at + n] in known else 1), phrases + 1
    return phrases


@pytest.mark.parametrize("piece,span", [(256, 1 << 18), (16, 1 << 18), (8, 100)])
def test_cross_parsing_counts_longest_matches(monkeypatch, piece, span):
    monkeypatch.setattr(language_id, "PIECE", piece)
    monkeypatch.setattr(language_id, "SPAN", span)
    monkeypatch.setattr(language_id, "ABREAST", 2)
    rng = np.random.default_rng(2)
    texts = {"a": rng.integers(97, 101, 300).astype(np.uint32), "b": rng.integers(97, 103, 200).astype(np.uint32), "c": np.tile([97, 98, 98], 400).astype(np.uint32)}
    docs = [rng.integers(97, 105, n).astype(np.uint32) for n in rng.integers(1, 600, 20)]
    # Phrases longer than pieces, texts that repeat, a training text itself.
    docs += [np.tile([97, 98, 98], 300).astype(np.uint32), np.full(700, 97, np.uint32), texts["a"], np.concatenate((texts["b"], texts["a"][5:250], texts["c"])), docs[0][:1]]
    parser = language_id.CrossParser(texts)
    got = parser.bits(docs)
    for doc, bits in zip(docs, got, strict=True):
        for k, name in enumerate(parser.languages):
            known = "".join(map(chr, texts[name]))
            assert bits[k] == pytest.approx(longest_matches("".join(map(chr, doc)), known) * math.log2(len(known)) / len(doc))
    assert (np.concatenate([parser.bits([d]) for d in docs]) == got).all()


def test_every_labelled_language_is_learned(spark):
    """Five languages of 600 rows each; four have one distinct text, one of them a very long one."""
    rng = np.random.default_rng(9)
    say = lambda letters, n: " ".join("".join(rng.choice(list(letters), 5)) for _ in range(n))
    rows = [(say("abcdefgh", 60), "many") for _ in range(600)]
    for name, text in (("one", say("ijklmnop", 80)), ("two", say("qrstuvwx", 80)), ("three", say("абвгдежз", 80)), ("four", say("αβγδεζηθ", 9000))):
        rows += [(text, name)] * 600
    parser = language_id.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert parser.languages == ["four", "many", "one", "three", "two"]
    assert max(2**s for s in parser.scale) <= language_id.TRAIN_SYMBOLS + 1
    other = say("αβγδεζηθ", 30)
    assert language_id.identify(spark.createDataFrame([(other,)], "text string"), parser).first().lang_pred == "four"


def test_language_does_not_depend_on_neighbours(spark, docs):
    parser = language_id.train(docs, "text", "lang")
    key = lambda df: sorted((r.doc_id, r.lang_pred, r.score, r.bits, r.accepted) for r in language_id.identify(df, parser).collect())
    assert key(docs) == key(docs.orderBy(F.xxhash64("doc_id")).coalesce(1)) == key(docs.repartition(7, "doc_id"))


def test_language_accuracy_on_held_out_documents(spark):
    got = op1_language_id(spark, SF).join(spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang"), "doc_id")
    assert got.where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0] > 0.98
    assert got.where("score < 0 or score > 1 or score is null").count() == 0
    assert got.where("not accepted").count() < 0.002 * got.count()


def test_language_of_odd_rows(spark, odd, none, docs):
    parser = language_id.train(docs, "text", "lang")
    got = language_id.identify(odd, parser)
    by = {r.doc_id: r for r in got.collect()}
    assert got.count() == odd.count() and by[1].lang_pred == by[2].lang_pred == by[13].lang_pred == "und"
    assert by[5].lang_pred in parser.languages and not by[13].accepted and by[1].bits is None
    assert language_id.identify(none, parser).count() == 0
    assert language_id.train(none, "text", "lang") is None
    assert {r.lang_pred for r in language_id.identify(odd, None).collect()} == {"und"}
    strange = spark.createDataFrame([(1, "жзйщ цъыэ юябг щшчц"), (2, "a"), (3, "Von.")], "doc_id bigint, text string")
    assert [r.accepted for r in language_id.identify(strange, parser).orderBy("doc_id").collect()] == [False, True, True]


def test_quality_on_held_out_documents(spark):
    got = op2_quality_classifier(spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").toPandas()
    assert (got.predicted == got.quality).mean() > 0.95
    assert got.score.between(0, 1).all()


def test_quality_gradient_and_odd_rows(spark, odd, none, docs):
    labels = spark.read.parquet("/root/testdata/sf0.001/labels.parquet")
    model = quality.train(docs, labels)
    got = quality.classify(odd, model)
    assert got.count() == odd.count() and got.where("score is null or score < 0 or score > 1").count() == 0
    scores = {r.doc_id: r.score for r in got.collect()}
    assert scores[1] == scores[2] and scores[5] == scores[14]
    assert quality.classify(none, model).count() == 0 and quality.train(none, labels) is None
    assert {r.score for r in quality.classify(odd, None).collect()} == {0.5}
    nulls = labels.limit(1).select(F.lit(None).cast("bigint").alias("doc_id"), "quality", "toxic").unionByName(labels.withColumn("quality", F.lit(None).cast("bigint")))
    assert quality.train(docs, nulls) is None


def test_attention_weighs_passages():
    """A bag is good if any passage is: only attention, not the mean, tells them apart."""
    rng = np.random.default_rng(0)
    x, first, y = [], [0], []
    for i in range(1500):
        bag = np.zeros((rng.integers(1, 12), quality.FEATURES), np.float32)
        bag[:, :6] = rng.normal(0, 1, (len(bag), 6))
        y.append(i % 2)
        bag[rng.integers(len(bag)), 0] += 6 * (i % 2)
        x.append(bag)
        first.append(first[-1] + len(bag))
    x, first, y = np.concatenate(x), np.array(first), np.array(y, np.float32)
    half = first[1000]
    model = quality.fit(x[:half], first[:1001], y[:1000], epochs=40)
    assert ((model.score(x[half:], first[1000:] - half) > 0.5) == y[1000:]).mean() > 0.9


def test_network_gradient_matches_differences():
    rng = np.random.default_rng(1)
    net = pseudo_likelihood.Network.fresh()
    near, target = rng.integers(0, pseudo_likelihood.CLASSES + 1, (4, 50)), rng.integers(0, pseudo_likelihood.CLASSES, 50)
    branch = rng.integers(0, pseudo_likelihood.BRANCHES, 50)
    loss = lambda flat: -pseudo_likelihood.Network.of(flat).log_probability(near, target, branch).mean()
    start, moved = net.flat().astype(np.float64), pseudo_likelihood.Network.of(net.flat())
    moved.train(near, target, branch, 1.0)
    gradient = start - moved.flat()
    direction = rng.normal(0, 1, len(start))
    step = 1e-3
    assert (loss(start + step * direction) - loss(start - step * direction)) / (2 * step) == pytest.approx(gradient @ direction, rel=0.05)


def test_both_sides_tell_more_than_frequency(docs):
    model = pseudo_likelihood.train(docs)
    for _, _, words, leaf, first in pseudo_likelihood._tokens(docs.select("text").toArrow()["text"].combine_chunks()):
        classes = pseudo_likelihood._classes(words, leaf, model.own)
        size = pseudo_likelihood.BRANCHES
        place = classes * size + np.where(classes >= pseudo_likelihood.OWN, leaf % size, 0)
        share = np.bincount(place, minlength=pseudo_likelihood.CLASSES * size) / len(classes)
        alone = np.log(share[place]).mean()
        assert model.network.log_probability(pseudo_likelihood.neighbours(classes, first), classes, leaf % size).mean() > alone
        break


def test_neighbours_stop_at_text_ends():
    near = pseudo_likelihood.neighbours(np.array([1, 2, 3, 4]), np.array([0, 3, 3, 4]))
    end = pseudo_likelihood.CLASSES
    assert near.T.tolist() == [[end, 2, end, 3], [1, 3, end, end], [2, end, 1, end], [end] * 4]


def test_scores_of_odd_rows(odd, none):
    model = pseudo_likelihood.train(odd)
    got = {r.doc_id: r for r in pseudo_likelihood.score_documents(odd, model).collect()}
    assert got[1].n_tokens == 0 and got[1].log_probability == 0 and got[1].mean_log_probability is None
    assert got[5].n_tokens == 40_000 and got[5].log_probability == pytest.approx(got[14].log_probability) and got[6].n_tokens == 1
    assert pseudo_likelihood.score_documents(none, pseudo_likelihood.train(none)).count() == 0
