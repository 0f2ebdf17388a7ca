"""Token-ID output: best-fit-decreasing packing with a segment tree over capacities."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import kernels as K
from .tokenizer import PAD, VOCABULARY, encode

CAPACITY = 2048
#: Tokens that one packing block holds; a block is packed, written and forgotten.
BLOCK_TOKENS = 1 << 21


class CapacityTree:
    """How many open bins have each free capacity; finds the tightest that fits in log time."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, free: int, n: int) -> None:
        node = free + self.leaves
        while node:
            self.count[node] += n
            node >>= 1

    def tightest(self, need: int) -> int:
        """The smallest free capacity of at least need with an open bin, or -1."""
        node = need + self.leaves
        if self.count[node]:
            return need
        while node > 1:
            if not node & 1 and self.count[node + 1]:
                node += 1
                break
            node >>= 1
        else:
            return -1
        while node < self.leaves:
            node *= 2
            if not self.count[node]:
                node += 1
        return node - self.leaves


def best_fit_decreasing(sizes: list[int], capacity: int) -> list[list[int]]:
    """Bins of item numbers; larger items first, ties in the given order, each into the tightest bin."""
    tree, bins, open_at = CapacityTree(capacity), [], {}
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        free = tree.tightest(sizes[i])
        if free < 0:
            bins.append([i])
            k, free = len(bins) - 1, capacity
        else:
            k = open_at[free].pop()
            tree.add(free, -1)
            bins[k].append(i)
        left = free - sizes[i]
        open_at.setdefault(left, []).append(k)
        tree.add(left, 1)
    return bins


def pack_tokens(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY,
    block_tokens: int = BLOCK_TOKENS, vocabulary: str = VOCABULARY,
) -> DataFrame:
    """Rows of a packed id matrix over all texts.

    Each task packs its documents block by block, without a shuffle. A document over the
    capacity is cut into pieces of the capacity and a rest, so every token is written once.
    Returns row_id, n_tokens, doc_ids and offsets (each segment's document and its first
    token's place there), cu_seqlens (cumulative segment lengths, from 0), position_resets
    (where positions start from 0 again) and ids, little-endian unsigned 16-bit, padded to the
    capacity. Null and empty texts have no token and stand in no row; a null id stays null;
    repeated rows are packed each; other columns are left out; an empty table gives no rows.
    row_id is unique, but like the blocks it depends on how the input is split.
    """
    K.small_batches(docs.sparkSession)
    kind = docs.schema[doc_id].dataType.simpleString()

    def rows(pieces, base):
        out = []
        for k, items in enumerate(best_fit_decreasing([len(p[2]) for p in pieces], capacity)):
            ends = np.cumsum([0] + [len(pieces[i][2]) for i in items])
            ids = np.full(capacity, PAD, "<u2")
            ids[: ends[-1]] = np.concatenate([pieces[i][2] for i in items])
            out.append((base + k, int(ends[-1]), [pieces[i][0] for i in items], [pieces[i][1] for i in items], ends.tolist(), ends[:-1].tolist(), ids.tobytes()))
        return out

    def run(batches):
        seen = TaskContext.get().partitionId() << 33
        pieces, held, id_type = [], 0, None
        for batch in batches:
            id_type = batch.column(0).type
            for i, t in zip(batch.column(0), batch.column(1), strict=True):
                ids = encode(t.as_py(), vocabulary)
                for at in range(0, len(ids), capacity):
                    pieces.append((i.as_py(), at, ids[at : at + capacity]))
                held += len(ids)
                if held >= block_tokens:
                    made = rows(pieces, seen)
                    seen += len(made)
                    yield from batches_of(made, id_type)
                    pieces, held = [], 0
        if pieces:
            yield from batches_of(rows(pieces, seen), id_type)

    def batches_of(made, id_type):
        types = [pa.int64(), pa.int64(), pa.list_(id_type), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.binary()]
        for at in range(0, len(made), 512):
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made[at : at + 512], strict=True), types, strict=True)], NAMES)

    return docs.select(doc_id, text).mapInArrow(run, f"row_id bigint, n_tokens bigint, doc_ids array<{kind}>, offsets array<bigint>, cu_seqlens array<int>, position_resets array<int>, ids binary")


NAMES = ["row_id", "n_tokens", "doc_ids", "offsets", "cu_seqlens", "position_resets", "ids"]


def write_packed(docs: DataFrame, path: str, **options) -> None:
    """Write the matrix rows as Parquet, one binary cell to a matrix row."""
    pack_tokens(docs, **options).write.mode("errorifexists").parquet(path)


def unpack_tokens(packed: DataFrame) -> DataFrame:
    """doc_id and ids (array<int>) of every document that pack_tokens wrote, in token order."""

    def run(batches):
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                ids = np.frombuffer(r["ids"], "<u2")
                for d, o, a, b in zip(r["doc_ids"], r["offsets"], r["cu_seqlens"], r["cu_seqlens"][1:], strict=False):
                    out.append((d, o, ids[a:b].astype(np.int32)))
            if out:
                id_type = batch.schema.field("doc_ids").type.value_type
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (id_type, pa.int64(), pa.list_(pa.int32())), strict=True)], ["doc_id", "at", "part"])

    kind = packed.schema["doc_ids"].dataType.elementType.simpleString()
    parts = packed.mapInArrow(run, f"doc_id {kind}, at bigint, part array<int>")
    return parts.groupBy("doc_id").agg(F.flatten(F.array_sort(F.collect_list(F.struct("at", "part")))["part"]).alias("ids"))
