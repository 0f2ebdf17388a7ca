"""Exact top-k inner-product search by pivot tables.

Each vector keeps its distances to many pivots. The triangle inequality gives a largest lower
bound of the distance of query and candidate, and with both norms an upper bound of their inner
product. Candidates stand in stripes by their nearest pivot, and a stripe's least and largest
distances bound all of its candidates at once: a query first searches the stripe of the highest
bound, and then only those whose bound reaches its k-th score there. Inside a stripe candidates
are evaluated in bound order until no bound reaches the k-th score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged

PIVOTS = 16
#: Vectors from which the pivots are chosen; a bounded sample, for speed only.
PIVOT_SAMPLE = 2048
#: Candidates of a stripe, about, and queries that meet one in one task.
STRIPE_ROWS = 8192
GROUP_ROWS = 1024
#: Stripes, and queries, whose bounds are compared in one task.
PAIR_ROWS = 4096
#: Candidates that are evaluated at once.
STEP = 256
#: Part of a stripe from which what the bounds leave is evaluated by a matrix product, for BATCH queries at once.
DENSE = 0.125
BATCH = 64


def choose_pivots(vectors: np.ndarray, n: int = PIVOTS) -> np.ndarray:
    """Far-apart vectors: each next pivot is the one farthest from those chosen."""
    chosen = [int(np.argmax((vectors**2).sum(1)))]
    far = ((vectors - vectors[chosen[0]]) ** 2).sum(1)
    while len(chosen) < min(n, len(vectors)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((vectors - vectors[chosen[-1]]) ** 2).sum(1))
    return vectors[chosen]


def distances(vectors: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    squares = (vectors**2).sum(1)[:, None] + (pivots**2).sum(1) - 2 * vectors @ pivots.T
    return np.sqrt(np.maximum(squares, 0))


def search_block(q_ids, queries, q_table, ids, vectors, table, k, floor=None):
    """(query, candidate, score) of each query's k best among these candidates, itself left out.

    With floor, scores below a query's own are of no use to it and may be left out.

    The candidates of the highest bounds give a first k-th score; those whose bound reaches it
    follow in bound order. Where more than a DENSE part of them is left, one matrix product for
    many queries is cheaper than gathering rows. ids must ascend: equal scores keep the smaller.
    """
    largest = float(np.abs(queries).max(initial=0)) * float(np.abs(vectors).max(initial=0)) * vectors.shape[1]
    kind = np.float32 if largest < 2**24 else np.float64 if largest < 2**53 else np.int64
    whole, asked = vectors.astype(kind), queries.astype(kind)
    norms, q_norms = (vectors**2).sum(1), (queries**2).sum(1)
    slack = 1e-6 * (norms.max(initial=0) + q_norms.max(initial=0)) + 1e-6
    table32 = np.ascontiguousarray(table.T, np.float32)
    asks = np.full(len(queries), -np.inf) if floor is None else floor

    def best_of(at, scores):
        keep = np.lexsort((at, -scores))[:k]
        return at[keep], scores[keep]

    def report(i, at, scores):
        return [(int(q_ids[i]), c, int(s)) for c, s in zip(ids[at].tolist(), scores.tolist(), strict=True)]

    for begin in range(0, len(queries), BATCH):
        dense = []
        for i in range(begin, min(begin + BATCH, len(queries))):
            apart = np.zeros(len(ids), np.float32)
            for p, d in enumerate(table32):
                np.maximum(apart, np.abs(d - np.float32(q_table[i, p])), out=apart)
            apart = np.maximum(apart.astype(np.float64) * (1 - 1e-6) - 1e-3, 0)
            bound = (q_norms[i] + norms - apart**2) / 2 + slack
            bound[ids == q_ids[i]] = -np.inf
            at = np.argpartition(-bound, min(STEP, len(ids) - 1))[:STEP]
            at = at[bound[at] > -np.inf]
            best_at, best = best_of(at, whole[at] @ asked[i])
            least = max(best[-1] if len(best) == k else -np.inf, asks[i])
            left = (bound >= least) & (bound > -np.inf)
            left[at] = False
            if left.sum() > DENSE * len(ids):
                dense.append((i, best_at, best, least, left))
                continue
            rest = np.flatnonzero(left)
            rest = rest[np.argsort(-bound[rest], kind="stable")]
            for j in range(0, len(rest), STEP):
                at = rest[j : j + STEP]
                at = at[bound[at] >= least]
                if not len(at):
                    break
                best_at, best = best_of(np.concatenate((best_at, at)), np.concatenate((best, whole[at] @ asked[i])))
                least = max(best[-1] if len(best) == k else -np.inf, asks[i])
            yield from report(i, best_at, best)
        if dense:
            product = asked[[x[0] for x in dense]] @ whole.T
            for scores, (i, best_at, best, least, left) in zip(product, dense, strict=True):
                at = np.flatnonzero(left & (scores >= least))
                yield from report(i, *best_of(np.concatenate((best_at, at)), np.concatenate((best, scores[at]))))


def _bounds(table: np.ndarray, norms: np.ndarray, low: np.ndarray, high: np.ndarray, largest: np.ndarray) -> np.ndarray:
    """Upper bounds of the inner product of each query with any candidate of each stripe."""
    out = np.empty((len(table), len(low)))
    for i, t in enumerate(table):
        apart = np.maximum(np.maximum(low - t, t - high).max(1), 0)
        apart = np.maximum(apart * (1 - 1e-6) - 1e-3, 0)
        triangle = (norms[i] + largest - apart**2) / 2
        # Rounding of squares and roots stays far below a millionth of the norms.
        out[i] = np.minimum(triangle, np.sqrt(norms[i] * largest)) + 1e-6 * (norms[i] + largest) + 1e-3
    return out


def _unpacked(column, width: int) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(-1, width)


def _against(asked: DataFrame, stripes: DataFrame, n_queries: int, n_stripes: int, width: int, emit, schema: str) -> DataFrame:
    """emit(queries, stripes, bounds) over all pairs of a block of queries and one of stripes."""
    groups, blocks = max(1, -(-n_queries // PAIR_ROWS)), max(1, -(-n_stripes // PAIR_ROWS))
    left = asked.withColumn("g", F.pmod(F.xxhash64("id"), F.lit(groups)).cast("int")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = stripes.withColumn("b", F.pmod(F.xxhash64("stripe"), F.lit(blocks)).cast("int")).withColumn("g", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))

    def meet(q: pa.Table, c: pa.Table) -> pa.Table:
        if not q.num_rows or not c.num_rows:
            return None
        arrays = lambda name: np.array(c[name].to_pylist(), np.float64)
        return emit(q, c, _bounds(_unpacked(q["t"], width), q["norm"].to_numpy(), arrays("low"), arrays("high"), c["largest"].to_numpy()))

    names = [x.split()[0] for x in schema.split(", ")]

    def run(q: pa.Table, c: pa.Table) -> pa.Table:
        got = meet(q, c)
        return pa.table(dict(zip(names, got if got is not None else [pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], strict=False)))

    return left.groupBy("g", "b").cogroup(right.groupBy("g", "b")).applyInArrow(run, schema)


def _searched(cells: DataFrame, asked: DataFrame, wanted: DataFrame, k: int, dim: int, width: int) -> DataFrame:
    """query_id, vec_id, score over the wanted pairs (id, stripe, floor): a stripe's queries in groups."""
    rows = wanted.join(asked, "id")
    sizes = wanted.groupBy("stripe").agg(F.count("*").alias("n")).select("stripe", F.ceil(F.col("n") / GROUP_ROWS).cast("int").alias("groups"))
    # A stripe has about STRIPE_ROWS candidates, so these joins have no hot key.
    left = cells.join(sizes, "stripe").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    right = rows.join(sizes, "stripe").withColumn("part", F.pmod(F.xxhash64("id"), F.col("groups")).cast("int")).drop("groups")

    def meet(c: pa.Table, q: pa.Table) -> pa.Table:
        found: list = []
        if c.num_rows and q.num_rows:
            c, q = c.sort_by("id"), q.sort_by("id")
            found = list(search_block(q["id"].to_numpy(), _unpacked(q["v"], dim), _unpacked(q["t"], width), c["id"].to_numpy(), _unpacked(c["v"], dim), _unpacked(c["t"], width), k, q["floor"].to_numpy()))
        cols = list(zip(*found, strict=True)) or [(), (), ()]
        return pa.table({name: pa.array(x, pa.int64()) for name, x in zip(("query_id", "vec_id", "score"), cols, strict=True)})

    return left.groupBy("stripe", "part").cogroup(right.groupBy("stripe", "part")).applyInArrow(meet, "query_id bigint, vec_id bigint, score bigint")


def top_k(
    vectors: DataFrame, queries: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", k: int = 20, pivots: int = PIVOTS, stripe_rows: int = STRIPE_ROWS, told: dict | None = None,
) -> DataFrame:
    """Each query's k candidates of the largest inner product, itself left out.

    Both frames hold vec_id (long) and embedding (array of whole numbers as double); other
    columns are left out. Returns query_id, rank from 1, vec_id and score (long); equal scores
    rank by vec_id. Vectors that are null, empty, or hold null or non-finite components, and rows
    without id, take no part; vectors of different lengths raise. Of repeated ids every row is a
    candidate and a query's own id is left out whole; of queries that repeat an id the one with
    the smallest vector asks. A query with fewer candidates gets them all; no queries or
    candidates give no rows. Scores beyond 53 bits are computed in 64-bit whole numbers. told, a
    mapping, gets the pairs of query and stripe there are, and those that were searched.
    """
    spark = vectors.sparkSession
    fit = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != F.lit(float("inf"))))
    prepare = lambda df: df.select(F.col(vec_id).cast("long").alias("id"), F.col(embedding).cast("array<double>").alias("v")).where(fit & F.col("id").isNotNull())
    candidates, asked = prepare(vectors), prepare(queries).groupBy("id").agg(F.min("v").alias("v"))
    sizes = candidates.groupBy(F.size("v").alias("d")).count().collect()
    q_sizes = asked.groupBy(F.size("v").alias("d")).count().collect()
    schema = "query_id bigint, rank int, vec_id bigint, score bigint"
    if not sizes or not q_sizes:
        return spark.createDataFrame([], schema)
    if len({r["d"] for r in [*sizes, *q_sizes]}) > 1:
        raise ValueError(f"vectors of different lengths: {sorted({r['d'] for r in [*sizes, *q_sizes]})}")
    dim, n, n_queries = sizes[0]["d"], sizes[0]["count"], q_sizes[0]["count"]
    every = max(1, n // PIVOT_SAMPLE)
    sample = candidates.where(F.pmod(F.xxhash64("id"), F.lit(every)) == 0).select("v").limit(4 * PIVOT_SAMPLE).collect() or candidates.limit(PIVOT_SAMPLE).collect()
    held = spark.sparkContext.broadcast(choose_pivots(np.array([r["v"] for r in sample], np.float64), pivots))
    width = len(held.value)

    def tabulate(batches):
        for batch in batches:
            v = batch.column(1).flatten().to_numpy().reshape(-1, dim) if batch.num_rows else np.zeros((0, dim))
            table = distances(v, held.value)
            near = table.argmin(1) if len(v) else np.zeros(0, np.int64)
            lists = pa.FixedSizeListArray.from_arrays(pa.array(table.ravel()), width).cast(pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in v], pa.binary()), pa.array([r.tobytes() for r in table], pa.binary()), pa.array((v**2).sum(1)), pa.array(near), lists], ["id", "v", "t", "norm", "near", "far"])

    table = "id bigint, v binary, t binary, norm double, near bigint, far array<double>"
    asked = staged(asked.mapInArrow(tabulate, table).drop("near", "far"))
    cells = staged(candidates.mapInArrow(tabulate, table))
    # One row for each pivot: how many stripes its candidates fill. Copies of a vector spread by id.
    parts = cells.groupBy("near").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / stripe_rows)).cast("long").alias("parts"))
    cells = cells.join(F.broadcast(parts), "near").withColumn("stripe", F.col("near") * (1 << 40) + F.pmod(F.xxhash64("id"), F.col("parts")))
    ends = [f(F.col("far")[i]).alias(f"{name}{i}") for name, f in (("low", F.min), ("high", F.max)) for i in range(width)]
    stripes = cells.groupBy("stripe").agg(*ends, F.max("norm").alias("largest"))
    stripes = staged(stripes.select("stripe", "largest", *[F.array(*[f"{name}{i}" for i in range(width)]).alias(name) for name in ("low", "high")]))
    n_stripes = stripes.count()
    rows = cells.select("id", "v", "t", "stripe")

    def best(q, c, bounds):
        top = bounds.argmax(1)
        return q["id"], c["stripe"].take(pa.array(top)), pa.array(bounds[np.arange(len(top)), top])

    home = _against(asked, stripes, n_queries, n_stripes, width, best, "id bigint, stripe bigint, bound double")
    home = staged(home.groupBy("id").agg(F.max_by("stripe", F.struct("bound", "stripe")).alias("stripe")).withColumn("floor", F.lit(float("-inf"))))
    first = staged(_searched(rows, asked, home, k, dim, width))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    reached = first.withColumn("rank", F.row_number().over(order)).where(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").cast("double").alias("floor"))
    after = staged(asked.join(home.select("id", F.col("stripe").alias("home")), "id").join(reached, "id", "left").fillna(float("-inf"), ["floor"]))

    def reaching(q, c, bounds):
        floor, stripe = q["floor"].to_numpy(), c["stripe"].to_numpy()
        i, j = np.nonzero((bounds >= floor[:, None]) & (stripe[None, :] != q["home"].to_numpy()[:, None]))
        return q["id"].take(pa.array(i)), pa.array(stripe[j]), pa.array(floor[i])

    wanted = staged(_against(after, stripes, n_queries, n_stripes, width, reaching, "id bigint, stripe bigint, floor double"))
    if told is not None:
        told |= {"pairs": n_queries * n_stripes, "searched": n_queries + wanted.count()}
    found = first.unionByName(_searched(rows, asked, wanted, k, dim, width))
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vectors: DataFrame, scale: int = 64, *, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """vec_id and embedding with floor(scale * x) in place of each component x, as double."""
    return vectors.select(F.col(vec_id), F.transform(F.col(embedding).cast("array<double>"), lambda x: F.when(F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), x).otherwise(F.floor(scale * x).cast("double"))).alias(embedding))
