"""Language ID learns every labelled language, however many of its rows are copies."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.llm import language_id


def test_language_of_copies_is_learned(spark):
    rng = np.random.default_rng(6)
    letters = np.array(list("абвгдежзиклмн"))
    texts = [" ".join("".join(rng.choice(letters, 6)) for _ in range(60)) for _ in range(80)]
    step = 5000 // language_id.TRAIN_TEXTS
    hashed = spark.createDataFrame([(t,) for t in texts], "text string").where(F.pmod(F.xxhash64("text"), F.lit(step)) != 0)
    copied = [r.text for r in hashed.limit(20).collect()]
    rows = [(copied[i % 20], "copied") for i in range(5000)]
    rows += [(" ".join("".join(rng.choice(list("abcdefgh"), 5)) for _ in range(60)), "other") for _ in range(100)]
    parser = language_id.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert parser.languages == ["copied", "other"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(copied)], "doc_id bigint, text string")
    assert {r.lang_pred for r in language_id.identify(docs, parser).collect()} == {"copied"}


def test_short_texts_are_learned_up_to_the_bound(spark):
    rng = np.random.default_rng(7)
    rows = [("".join(rng.choice(list("abcdefghijkl"), 8)), "short") for _ in range(20_000)]
    rows += [("12345 - 67890", "short")] * 20_000
    parser = language_id.train(spark.createDataFrame(rows, "text string, lang string"), "text", "lang")
    assert parser.scale == pytest.approx([np.log2(language_id.TRAIN_SYMBOLS)], abs=1e-2)
