"""Decontamination, substring dedup and the n-gram join against brute force."""

import hashlib
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from terraweave.llm import decontamination, ngram_join, substring_dedup

ALNUM, SPACE = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"), re.compile(r"[^\x20\x09-\x0D]+")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def pairs(df, *columns):
    return sorted([tuple(r[c] for c in columns) for r in df.collect()], key=str)


def contaminated(rows, items):
    found = defaultdict(set)
    for item, text in items:
        words = ALNUM.findall(lower(text))
        n = min(10, len(words))
        for i in range(len(words) - n + 1 if words else 0):
            found[tuple(words[i : i + n])].add(str(item))
    out = []
    for doc, text in rows:
        words, hit, got = ALNUM.findall(lower(text)), set(), set()
        for n in {len(k) for k in found}:
            for i in range(len(words) - n + 1):
                if tuple(words[i : i + n]) in found:
                    hit |= set(range(i, i + n))
                    got |= found[tuple(words[i : i + n])]
        out.append((doc, len(words), len(hit), len(got), sha(",".join(sorted(got))), bool(hit)))
    return sorted(out, key=str)


DIGEST = ("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


@pytest.mark.parametrize("limit", [decontamination.MAX_SET_BYTES, 3000])
def test_decontamination_equals_brute_force(spark, docs, limit):
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet")
    got = decontamination.contamination_digest(decontamination.decontaminate(docs, bench, max_set_bytes=limit))
    want = contaminated([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert pairs(got, *DIGEST) == want
    assert any(r[-1] for r in want) and not all(r[-1] for r in want)


def test_decontamination_of_odd_rows(spark, odd, none):
    items = [(1, "The SAME words, stand"), (2, None), (3, ""), (None, "lost"), (4, "..."), (10, "one"), (11, "über 12"), (12, "w0 w1 w2 w3 w4 w5 w6 w7 w8 w9 w10")]
    bench = spark.createDataFrame(items, "item_id bigint, text string")
    got = decontamination.contamination_digest(decontamination.decontaminate(odd, bench))
    want = contaminated([(r.doc_id, r.text) for r in odd.collect()], [x for x in items if None not in x])
    assert pairs(got, *DIGEST) == want
    dropped = decontamination.decontaminate(odd, bench, action="drop")
    assert dropped.columns == odd.columns and dropped.count() == sum(not r[-1] for r in want)
    cut = {r.doc_id: r.text for r in decontamination.decontaminate(odd, bench, action="cut").collect()}
    assert cut[7] == " here twice in a row" and cut[10] == "" and cut[1] is None and cut[13] == "!!! ... ---"
    assert decontamination.decontaminate(none, bench).count() == 0
    assert not pairs(decontamination.contamination_digest(decontamination.decontaminate(odd, bench.limit(0))).where("contaminated"), "doc_id")


def without_repeats(rows, window=35):
    words = [SPACE.findall(t or "") for _, t in rows]
    seen = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc, _), w in zip(rows, words, strict=True):
        gone = {j for i in range(len(w) - window + 1) if seen[tuple(w[i : i + window])] > 1 for j in range(i, i + window)}
        out.append((doc, len(w), len(gone), sha(" ".join(x for j, x in enumerate(w) if j not in gone))))
    return sorted(out, key=str)


SPANS = ("doc_id", "n_words", "n_removed", "kept_sha256")


def test_substrings_equal_brute_force(docs):
    got = substring_dedup.dedup_substrings(docs, digest=True)
    assert pairs(got, *SPANS) == without_repeats([(r.doc_id, r.text) for r in docs.collect()])


def test_substrings_of_odd_rows(odd, none):
    got = substring_dedup.dedup_substrings(odd, digest=True, window=6, edge=3)
    assert pairs(got, *SPANS) == without_repeats([(r.doc_id, r.text) for r in odd.collect()], 6)
    assert substring_dedup.dedup_substrings(none).count() == 0
    with pytest.raises(ValueError):
        substring_dedup.dedup_substrings(odd, window=3, edge=3)


@pytest.mark.parametrize("window,edge", [(4, 2), (7, 3)])
def test_substrings_of_few_words(spark, window, edge):
    """Two words only: periodic texts, many branches, ties of minimisers."""
    import random

    rng = random.Random(window)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 30)))) for i in range(60)] + [(99, "a " * 40)]
    got = substring_dedup.dedup_substrings(spark.createDataFrame(rows, "doc_id bigint, text string"), digest=True, window=window, edge=edge)
    assert pairs(got, *SPANS) == without_repeats(rows, window)


def joined(rows, size=5):
    sets = []
    for _, t in rows:
        w = SPACE.findall(lower(t))
        sets.append({tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} - {()})
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = defaultdict(list)
    for i, (doc, _) in enumerate(rows):
        least[find(i)].append(doc)
    smallest = lambda g: min((d for d in g if d is not None), default=None)
    return sorted([(doc, len(sets[i]), doc if not sets[i] else smallest(least[find(i)])) for i, (doc, _) in enumerate(rows)], key=str)


def near_copies(n, length=60, edits=4, seed=1):
    import random

    rng = random.Random(seed)
    base, out = [f"w{i}" for i in range(length)], []
    for i in range(n):
        words = list(base)
        for _ in range(rng.randint(0, edits)):
            k = rng.randrange(len(words))
            words[k : k + rng.randint(0, 1)] = [f"x{rng.randrange(40)}"] * rng.randint(0, 2)
        out.append((i, " ".join(words)))
    return out


@pytest.mark.parametrize("large", [1, 64])
def test_join_equals_brute_force(spark, docs, odd, large, monkeypatch):
    monkeypatch.setattr(ngram_join, "LARGE", large)
    columns = ("doc_id", "n_shingles", "component_id")
    for rows in ([(r.doc_id, r.text) for r in docs.collect()], near_copies(150), near_copies(80, 9, 2, 3), near_copies(100, 25, 3, 5)):
        got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
        assert pairs(got, *columns) == joined(rows)
    got = ngram_join.similarity_classes(odd.where("doc_id is not null"))
    assert pairs(got, *columns) == joined([(r.doc_id, r.text) for r in odd.where("doc_id is not null").collect()])


def test_join_judges_rows_by_their_text(spark):
    """Ids that repeat with other texts, and rows without an id, which link like others."""
    one, two, three = (" ".join(f"{c}{i}" for i in range(30)) for c in "abc")
    rows = [(5, one), (5, two), (3, one + " x"), (9, two + " y"), (None, three), (7, three + " z"), (None, "alone in the world it stands here"), (5, "short"), (None, None)]
    got = ngram_join.similarity_classes(spark.createDataFrame(rows, "doc_id bigint, text string"))
    assert pairs(got, "doc_id", "n_shingles", "component_id") == joined(rows)


def test_join_keeps_rows_without_id_and_empty_tables(odd, none):
    got = ngram_join.similarity_classes(odd)
    assert got.count() == odd.count()
    assert ngram_join.similarity_classes(none).count() == 0
    assert got.where(F.col("n_shingles") == 0).where(~F.col("doc_id").eqNullSafe(F.col("component_id"))).count() == 0
