"""Packing, line dedup and top-k search."""

import itertools
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from terraweave.llm import length_buckets, line_dedup, packed_output, pivot_search
from terraweave.llm.queries import op4_exact_top_k
from terraweave.llm.tokenizer import decode, encode


def test_best_fit_decreasing_equals_plain_search():
    rng = random.Random(4)
    for _ in range(60):
        capacity = rng.randint(1, 40)
        sizes = [rng.randint(1, capacity) for _ in range(rng.randint(0, 60))]
        free, want = [], []
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            fits = [k for k, f in enumerate(free) if f >= sizes[i]]
            if fits:
                tight = min(free[k] for k in fits)
                free[next(k for k in fits if free[k] == tight)] -= sizes[i]
            else:
                free.append(capacity - sizes[i])
            want.append(sizes[i])
        bins = packed_output.best_fit_decreasing(sizes, capacity)
        assert sorted(i for b in bins for i in b) == list(range(len(sizes)))
        assert all(sum(sizes[i] for i in b) <= capacity for b in bins)
        assert sorted(capacity - sum(sizes[i] for i in b) for b in bins) == sorted(free)


def test_packed_tokens_round_trip(docs):
    packed = packed_output.pack_tokens(docs, capacity=512, block_tokens=5000)
    got = {r.doc_id: r.ids for r in packed_output.unpack_tokens(packed).collect()}
    for r in docs.collect():
        assert got.get(r.doc_id, []) == encode(r.text).tolist()
        assert decode(got.get(r.doc_id, [])) == r.text
    for r in packed.collect():
        ids = np.frombuffer(r.ids, "<u2")
        assert len(ids) == 512 and (ids[r.n_tokens :] == packed_output.PAD).all()
        assert r.cu_seqlens[0] == 0 and r.cu_seqlens[-1] == r.n_tokens and r.position_resets == r.cu_seqlens[:-1]
    assert packed.select("row_id").distinct().count() == packed.count()


def test_packing_of_odd_rows(odd, none):
    packed = packed_output.pack_tokens(odd, capacity=256)
    held = sum(len(encode(r.text)) for r in odd.collect())
    assert sum(r.n_tokens for r in packed.collect()) == held
    assert not {1, 2} & {d for r in packed.collect() for d in r.doc_ids}
    assert packed_output.pack_tokens(none).count() == 0


def test_long_texts_are_encoded_whole():
    for text in ("word " * 30_000, "x" * 100_000, "a  b\n\n c " * 20_000):
        assert decode(encode(text)) == text


@pytest.mark.parametrize("seed", range(3))
def test_boundaries_are_optimal(seed):
    rng = random.Random(seed)
    for _ in range(100):
        histogram = {rng.randint(1, 40): rng.randint(1, 9) for _ in range(rng.randint(1, 9))}
        buckets = rng.randint(1, 5)
        got, lengths = length_buckets.optimal_boundaries(histogram, buckets), sorted(histogram)
        cost = lambda bounds: sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())  # noqa: B023, E731
        best = min(cost([*some, lengths[-1]]) for k in range(min(buckets, len(lengths))) for some in itertools.combinations(lengths[:-1], k))
        assert len(got) <= buckets and cost(got) == best


def check_batches(rows, budget):
    batches = defaultdict(list)
    for r in rows:
        batches[r.bucket, r.batch].append(r)
        assert r.padding == r.bucket_length - r.n_tokens >= 0
    for (bucket, _), b in batches.items():
        assert len(b) * b[0].bucket_length <= budget or len(b) == 1
        assert sorted(r.place for r in b) == list(range(len(b)))
    last = defaultdict(int)
    for bucket, batch in batches:
        last[bucket] = max(last[bucket], batch)
    for (bucket, batch), b in batches.items():
        assert batch == last[bucket] or len(b) == max(1, budget // b[0].bucket_length)


def test_length_buckets(docs, odd, none, monkeypatch):
    rows = length_buckets.pack_by_length(docs, token_budget=4096).collect()
    want = {r.doc_id: len(encode(r.text)) for r in docs.collect()}
    assert {r.doc_id: r.n_tokens for r in rows} == want and len(rows) == len(want)
    check_batches(rows, 4096)
    monkeypatch.setattr(length_buckets, "CHUNK_ROWS", 30)
    check_batches(length_buckets.pack_by_length(docs, token_budget=2048, buckets=3).collect(), 2048)
    rows = length_buckets.pack_by_length(odd).collect()
    assert len(rows) == odd.count() and sum(r.n_tokens == 0 for r in rows) == 3
    assert length_buckets.pack_by_length(none).count() == 0


def cut_lines(rows, least):
    sites, first = defaultdict(set), {}
    for doc, text, site in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        for i, line in enumerate(text.split("\n") if text is not None else []):
            line = line.strip(" ")
            if line and site is not None:
                sites[line].add(site)
                first.setdefault(line, (doc, i))
    out = []
    for doc, text, _ in rows:
        lines = text.split("\n") if text is not None else []
        kept = [x for i, x in enumerate(lines) if not (x.strip(" ") and len(sites[x.strip(" ")]) >= least and first[x.strip(" ")] != (doc, i))]
        out.append((doc, len(lines), len(lines) - len(kept), None if text is None else "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [2, 5, 10])
def test_line_dedup_equals_brute_force(docs, least):
    got = line_dedup.dedup_lines(docs, min_sites=least)
    rows = [(r.doc_id, r.text, r.source) for r in docs.collect()]
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()], key=str) == cut_lines(rows, least)


def test_line_dedup_of_odd_rows(spark, odd, none):
    rows = [(i, f"head {i}\n boiler plate \n\nend\nx\n\ny\n{'z' * i}" * (1 + 9 * (i == 3)), f"s{i % 6}") for i in range(40)]
    rows += [(50, None, "s1"), (51, "", "s2"), (52, "\n", None), (None, "boiler plate\nend", "s3"), (53, "boiler plate", None), (53, "boiler plate", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string")
    got = line_dedup.dedup_lines(df.where("doc_id is not null"), min_sites=5)
    assert sorted([(r.doc_id, r.n_lines, r.n_removed, r.text) for r in got.collect()], key=str) == cut_lines([r for r in rows if r[0] is not None], 5)
    assert line_dedup.dedup_lines(df, min_sites=5).count() == len(rows)
    out = line_dedup.dedup_lines(odd)
    assert out.count() == odd.count() and sorted(out.columns) == sorted([*odd.columns, "n_lines"])
    assert line_dedup.dedup_lines(none).count() == 0
    every = line_dedup.dedup_lines(df, min_sites=5, keep_first=False)
    assert every.where("text like '%boiler%'").count() == 0


def best(vectors, queries, k):
    out = []
    for q, v in queries:
        scores = sorted(((-int(np.dot(np.array(v, object), np.array(w, object))), c) for c, w in vectors if c != q), key=lambda x: x)[:k]
        out += [(q, i + 1, c, -s) for i, (s, c) in enumerate(scores)]
    return sorted(out)


def found(df):
    return sorted((r.query_id, r.rank, r.vec_id, r.score) for r in df.collect())


def test_top_k_equals_brute_force(spark, monkeypatch):
    rows = [(r.vec_id, np.floor(64 * np.array(r.embedding, np.float64)).astype(int).tolist()) for r in spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").collect()]
    assert found(op4_exact_top_k(spark, "/root/testdata/sf0.001")) == best(rows, [r for r in rows if r[0] % 20 == 0], 20)
    for step, dense in ((4, 1.0), (16, 0.0)):
        monkeypatch.setattr(pivot_search, "STEP", step)
        monkeypatch.setattr(pivot_search, "DENSE", dense)
        monkeypatch.setattr(pivot_search, "GROUP_ROWS", 7)
        monkeypatch.setattr(pivot_search, "PAIR_ROWS", 5)
        rng = np.random.default_rng(step)
        centres = rng.integers(-50, 50, (4, 3))
        small = [(i, (centres[i % 4] + rng.integers(-2, 3, 3)).tolist()) for i in range(300)]
        df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in small], "vec_id bigint, embedding array<double>")
        told = {}
        assert found(pivot_search.top_k(df, df.where("vec_id % 20 = 0"), k=7, pivots=8, stripe_rows=20, told=told)) == best(small, [r for r in small if r[0] % 20 == 0], 7)
        # Loose clusters of small numbers: most stripes lie too far away for a query to ask.
        assert told["searched"] < 0.7 * told["pairs"]


def test_top_k_of_odd_rows(spark):
    big = 3_000_000_001.0
    rows = [(0, [1.0, 2.0]), (1, [1.0, 2.0]), (2, [1.0, 2.0]), (3, None), (4, [1.0, None]), (5, [float("nan"), 1.0]), (6, [float("inf"), 1.0]), (7, []), (8, [big, 1.0]), (9, [big, 2.0]), (None, [1.0, 1.0]), (20, [big, 3.0]), (40, [0.0, 0.0]), (20, [big, 2.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    df = df.withColumns({"stripe": F.lit("x"), "score": F.lit(0.5), "t": F.lit(1)})
    good = [(i, [int(x) for x in v]) for i, v in rows if i in (0, 1, 2, 8, 9, 20, 40)]
    # Of a query's rows the one with the smallest vector asks; all rows of other ids are candidates.
    asks = {i: min(v for j, v in good if j == i) for i in (0, 20, 40)}
    for stripe_rows in (8192, 2):
        assert found(pivot_search.top_k(df, df.where("vec_id % 20 = 0"), k=4, stripe_rows=stripe_rows)) == best(good, list(asks.items()), 4)
    longer = df.unionByName(spark.createDataFrame([(60, [5.0], "x", 0.5, 1)], df.schema))
    with pytest.raises(ValueError):
        pivot_search.top_k(longer, longer.where("vec_id % 20 = 0"))
    assert pivot_search.top_k(df.limit(0), df.limit(0)).count() == 0
    assert pivot_search.quantised(df).count() == len(rows)
