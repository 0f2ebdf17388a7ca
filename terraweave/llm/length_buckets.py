"""Packing into optimal length buckets: dynamic programming over the global length histogram."""

from __future__ import annotations

from collections import deque

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..plans.staging import staged
from . import kernels as K
from .tokenizer import VOCABULARY, encode

BUCKETS = 16
#: Bucket lengths are multiples of this, which also bounds the histogram by the longest text.
MULTIPLE = 8
#: Padded tokens that one batch may hold; a longer document is a batch of its own.
TOKEN_BUDGET = 65536
#: Documents of one bucket that one task numbers.
CHUNK_ROWS = 50_000


def optimal_boundaries(histogram: dict[int, int], buckets: int) -> list[int]:
    """At most `buckets` lengths, from {length: count}, that minimise the padding of all documents.

    Each length is padded to the next boundary. Padding of lengths i+1..j under boundary b_j is
    b_j (N_j - N_i) - (T_j - T_i); for growing j the best i follows a lower hull of lines, so a
    layer costs linear time.
    """
    lengths = sorted(x for x, n in histogram.items() if n > 0)
    if not lengths:
        return []
    count, total = [0], [0]
    for x in lengths:
        count.append(count[-1] + histogram[x])
        total.append(total[-1] + histogram[x] * x)
    d = len(lengths)
    cost = [0] + [lengths[j] * count[j + 1] - total[j + 1] for j in range(d)]
    back = [[0] * (d + 1)]
    for _ in range(1, min(buckets, d)):
        hull, new, come = deque(), [None] * (d + 1), [0] * (d + 1)
        new[0] = 0
        for j in range(1, d + 1):
            i = j - 1
            line = (-count[i], cost[i] + total[i], i)
            while len(hull) > 1 and (line[1] - hull[-2][1]) * (hull[-2][0] - hull[-1][0]) <= (hull[-1][1] - hull[-2][1]) * (hull[-2][0] - line[0]):
                hull.pop()
            hull.append(line)
            x = lengths[j - 1]
            while len(hull) > 1 and hull[1][0] * x + hull[1][1] <= hull[0][0] * x + hull[0][1]:
                hull.popleft()
            new[j] = hull[0][0] * x + hull[0][1] + x * count[j] - total[j]
            come[j] = hull[0][2]
        cost = new
        back.append(come)
    out, j = [], d
    for come in reversed(back):
        if j == 0:
            break
        out.append(lengths[j - 1])
        j = come[j]
    return out[::-1]


def token_lengths(docs: DataFrame, doc_id: str, text: str, vocabulary: str, more: tuple[str, ...] = ()) -> DataFrame:
    """Every row's id and token count, with the columns of more."""

    def run(batches):
        for batch in batches:
            n = np.fromiter((len(encode(t.as_py(), vocabulary)) for t in batch.column(1)), np.int64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), *batch.columns[2:]], ["doc_id", "n_tokens", *more])
            K.release()

    fields = [f"doc_id {docs.schema[doc_id].dataType.simpleString()}", "n_tokens bigint", *[f"{c} {docs.schema[c].dataType.simpleString()}" for c in more]]
    return docs.select(doc_id, text, *more).mapInArrow(run, ", ".join(fields))


def pack_by_length(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", buckets: int = BUCKETS, multiple: int = MULTIPLE,
    token_budget: int = TOKEN_BUDGET, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Deal every document into a length bucket and a token-budget batch inside it.

    Token counts are rounded up to a multiple; the histogram of all of them gives the bucket
    boundaries. A batch of bucket b holds token_budget // boundary documents, one at least,
    ordered by length and id inside chunks of a bucket; chunks are dealt by a hash of id, length
    and text, so rows without an id or with one and the same spread over all. Returns doc_id, n_tokens, bucket (from 0,
    by length), bucket_length, batch (from 0 in each bucket), place (in the batch) and padding.
    Null and empty texts have 0 tokens and fill buckets like others, at the smallest multiple;
    equal lengths share a bucket; repeated rows count each; other columns are left out; an empty
    table gives no rows.
    """
    K.small_batches(docs.sparkSession)
    rounded = F.greatest(F.lit(multiple), F.ceil(F.col("n_tokens") / multiple) * multiple).cast("long")
    docs = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(text, doc_id).alias("deal"))
    sized = staged(token_lengths(docs, "doc_id", "text", vocabulary, ("deal",)).withColumn("rounded", rounded))
    histogram = {r["rounded"]: r["count"] for r in sized.groupBy("rounded").count().toLocalIterator()}
    bounds = optimal_boundaries(histogram, buckets)
    chunks = max(1, -(-sum(histogram.values()) // CHUNK_ROWS))
    spark = docs.sparkSession
    table = spark.createDataFrame([(i, int(b)) for i, b in enumerate(bounds)], "bucket int, bucket_length bigint")
    edges = F.array(*[F.lit(b) for b in bounds]) if bounds else F.array().cast("array<bigint>")
    # The table of boundaries has `buckets` rows.
    dealt = sized.withColumn("bucket", F.size(F.filter(edges, lambda b: b < F.col("rounded")))).join(F.broadcast(table), "bucket")
    dealt = dealt.withColumn("chunk", F.pmod(F.xxhash64("deal", "n_tokens"), F.lit(chunks)))
    before = dealt.groupBy("bucket", "chunk").agg(F.count("*").alias("n"))
    before = before.select("bucket", "chunk", (F.sum("n").over(Window.partitionBy("bucket").orderBy("chunk")) - F.col("n")).alias("before"))
    mine = Window.partitionBy("bucket", "chunk").orderBy("n_tokens", "doc_id", "deal")
    at = F.col("before") + F.row_number().over(mine) - 1
    per = F.greatest(F.lit(1), F.floor(F.lit(token_budget) / F.col("bucket_length")))
    numbered = dealt.join(before, ["bucket", "chunk"]).withColumn("at", at)
    return numbered.select(
        "doc_id", "n_tokens", "bucket", "bucket_length", F.floor(F.col("at") / per).alias("batch"),
        F.pmod("at", per).alias("place"), (F.col("bucket_length") - F.col("n_tokens")).alias("padding"),
    )
