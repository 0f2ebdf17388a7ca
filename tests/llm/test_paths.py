"""Compaction of paths, words compared at their coordinates, and words that some hashes confuse."""

import random

import pytest

from terraweave.llm import ngram_join, substring_dedup
from test_windows import SPANS, joined, pairs, without_repeats


def thue_morse(n):
    """A word of 2**n letters and its complement: equal under any polynomial hash modulo 2**64."""
    a, b = "a", "b"
    for _ in range(n):
        a, b = a + b, b + a
    return a, b


def test_words_that_polynomials_confuse_stay_apart(spark):
    a, b = thue_morse(11)
    same = " ".join(f"w{i}" for i in range(34))
    rows = [(1, f"{same} {a}"), (2, f"{same} {b}"), (3, a), (4, b), (5, f"{a} x"), (6, f"{b} x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    assert pairs(substring_dedup.dedup_substrings(docs, digest=True), *SPANS) == without_repeats(rows)
    got = {r.doc_id: r.component_id for r in ngram_join.similarity_classes(docs).collect()}
    assert got == {r[0]: r[2] for r in joined(rows)} and got[3] != got[4] and got[5] != got[6]


@pytest.mark.parametrize("bits", [1, 4, 9])
def test_confused_paths_are_settled_by_words(spark, docs, bits):
    """Hashes of a few bits: nearly all paths hold different words."""
    rng = random.Random(bits)
    rows = [(i, " ".join(rng.choice("abc") for _ in range(rng.randint(0, 40)))) for i in range(50)]
    rows += [(60, rows[3][1] + " d"), (61, rows[3][1]), (61, rows[3][1]), (None, rows[4][1]), (62, None)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), digest=True, window=6, edge=3, hash_bits=bits)
    assert pairs(got, *SPANS) == without_repeats(rows, 6)


def test_unbranched_paths_become_one_row(spark):
    """Two copies of 3,000 words, one of them cut short, and a fork: paths, not windows, are left."""
    words = [f"w{i}" for i in range(3000)]
    rows = [("u", 1, v, t) for v, t in ()]
    names = [1000 + i for i in range(200)]
    rows = [(a, 2, b, 2) for a, b in zip(names, names[1:], strict=False)] + [(names[-1], 2, None, 2)]
    # A fork: 7 is followed by 8 once and by 9 twice; 9 stands three times.
    rows += [(7, 1, 8, 1), (7, 1, 9, 2), (8, 1, None, 1), (9, 1, None, 3), (5, 1, None, 1)]
    follows = spark.createDataFrame(rows, "u bigint, n bigint, v bigint, t bigint")
    got = sorted((r.u, r.n, r.c) for r in substring_dedup.contracted(follows).collect())
    assert got == [(7, 1, 3), (9, 1, 3), (1000, 400, 2)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words)), (3, " ".join(words[1000:1500]))], "doc_id bigint, text string")
    keyed = docs.selectExpr("doc_id", "text", "doc_id AS k1", "doc_id AS k2")
    spans = {r.k1: r.spans for r in substring_dedup.repeated_spans(keyed).collect()}
    assert sum(x.n for x in spans[1]) == 3000 - 34 and sum(x.n for x in spans[3]) == 500 - 34
    assert len(spans[1]) < 40 and len(spans[3]) < 40
