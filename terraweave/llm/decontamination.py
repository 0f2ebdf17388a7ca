"""Benchmark decontamination: a bounded broadcast hash set of test windows scanned over whole texts."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop_staged, staged
from . import kernels as K

WINDOW = 10
_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Bytes that one broadcast set may hold, words and tables together; a larger benchmark is scanned in blocks.
MAX_SET_BYTES = 32 << 20
#: Bytes of tables for each window: hash, place and length of its words, its items.
_WINDOW_BYTES = 36
#: log2 of the entries of the gate that thins out lookups.
_GATE_BITS = 20


class WindowSet:
    """The distinct windows of some items: sorted hashes, and each one's words as a place in one buffer.

    It holds no Python object for a window, so what is built, sent and unpacked is about
    _WINDOW_BYTES for each window and the words themselves.
    """

    def __init__(self, items: list[tuple[str, bytes]], window: int = WINDOW):
        """items are (id, lower-case words joined by one space); ids may repeat."""
        self.names = sorted({i for i, _ in items})
        number = {name: k for k, name in enumerate(self.names)}
        self.words = b"\n".join(t for _, t in items)
        found = defaultdict(list)
        base = 0
        data = np.frombuffer(self.words, np.uint8)
        for name, text in items:
            w = K.words(data[base : base + len(text)], np.array([0, len(text)]), K.ALNUM_WORDS, lower=False)
            length = min(window, len(w.hashes))
            if length:
                first = np.arange(len(w.hashes) - length + 1)
                begin, size = w.starts[first], w.ends[first + length - 1] - w.starts[first]
                found[length].append((K.windows(w.hashes, length), base + begin, size.astype(np.int32), np.full(len(first), number[name], np.int32)))
            base += len(text) + 1
        self.by_length = {length: self._table([np.concatenate(c) for c in zip(*parts, strict=True)]) for length, parts in found.items()}

    def _table(self, columns):
        """Hashes, places and lengths of distinct windows in hash order, bounds and numbers of their items, the gate."""
        order = np.lexsort((columns[3], columns[0]))
        h, begin, size, item = (c[order] for c in columns)
        # Windows of one hash: each distinct text is kept once, with the items of all its copies.
        bounds = np.flatnonzero(np.concatenate(([True], h[1:] != h[:-1], [True])))
        keep, items, firsts = [], [], [0]
        many = np.flatnonzero(np.diff(bounds) > 1)
        alone = np.ones(len(h), bool)
        for k in many:
            alone[bounds[k] : bounds[k + 1]] = False
        texts: dict[int, list[np.ndarray]] = {}
        for k in many:
            groups: dict[bytes, list[int]] = {}
            for i in range(bounds[k], bounds[k + 1]):
                groups.setdefault(self.words[begin[i] : begin[i] + size[i]], []).append(i)
            for at in groups.values():
                texts[at[0]] = np.unique(item[at])
        heads = np.sort(np.concatenate((np.flatnonzero(alone), np.fromiter(texts, np.int64, len(texts)))))
        items = [texts[i] if i in texts else item[i : i + 1] for i in heads.tolist()] if texts else None
        if items is None:
            keep, firsts, numbers = heads, np.arange(len(heads) + 1, dtype=np.int64), item[heads]
        else:
            keep, firsts, numbers = heads, np.concatenate(([0], np.cumsum([len(x) for x in items]))), np.concatenate(items)
        gate = np.zeros(1 << _GATE_BITS, bool)
        gate[(h >> np.uint64(64 - _GATE_BITS)).astype(np.int64)] = True
        return h[keep], begin[keep], size[keep], firsts, numbers.astype(np.int32), gate

    def hits(self, data: np.ndarray, w: K.Words):
        """(word position, length, item ids) of each window occurrence in a chunk."""
        for length, (known, begin, size, firsts, numbers, gate) in self.by_length.items():
            h = K.windows(w.hashes, length)
            at = np.flatnonzero(gate[(h >> np.uint64(64 - _GATE_BITS)).astype(np.int64)])
            at = at[np.isin(h[at], known)]
            for i in np.intersect1d(at, K.valid_starts(w, length), assume_unique=True).tolist():
                joined = b" ".join(data[s:e].tobytes() for s, e in zip(w.starts[i : i + length], w.ends[i : i + length], strict=True)).lower()
                k = int(np.searchsorted(known, h[i]))
                while k < len(known) and known[k] == h[i]:
                    if self.words[begin[k] : begin[k] + size[k]] == joined:
                        yield i, length, [self.names[x] for x in numbers[firsts[k] : firsts[k + 1]]]
                    k += 1


def _scan(batches, windows: WindowSet, spans: bool):
    """Per row: id, word count, merged hit ranges (word positions), item ids; with spans, byte ranges."""
    for batch in batches:
        for row, end, data, offsets in K.chunks(batch.column(1)):
            w = K.words(data, offsets, K.ALNUM_WORDS, lower=True)
            ranges, items = defaultdict(list), defaultdict(set)
            for i, length, ids in windows.hits(data, w):
                r = int(np.searchsorted(w.first, i, "right")) - 1
                ranges[r].append((i, i + length))
                items[r].update(ids)
            counts, n = np.diff(w.first), end - row
            merged = []
            for r in range(n):
                out: list[list[int]] = []
                for a, b in sorted(ranges.get(r, ())):
                    if out and a <= out[-1][1]:
                        out[-1][1] = max(out[-1][1], b)
                    else:
                        out.append([a, b])
                base = int(w.first[r])
                if spans:
                    merged.append([x for a, b in out for x in (int(w.starts[a] - offsets[r]), int(w.ends[b - 1] - offsets[r]))])
                else:
                    merged.append([x - base for ab in out for x in ab])
            yield batch.column(0).slice(row, n), batch.column(1).slice(row, n), counts, merged, [sorted(items.get(r, ())) for r in range(n)]


def _pieces(item: str, text: str, window: int, limit: int) -> Iterator[tuple[str, bytes, int]]:
    """An item's words in pieces with every window in one of them, and the bytes that each piece may take."""
    found = _WORD.findall(text.encode().lower())
    at = 0
    while at < len(found):
        end, size = at, 64 + len(item)
        while end < len(found) and (end - at < window or size + len(found[end]) + 1 + _WINDOW_BYTES <= limit):
            size += len(found[end]) + 1 + _WINDOW_BYTES
            end += 1
        yield item, b" ".join(found[at:end]), size
        at = end - window + 1 if end < len(found) else end


def _blocks(benchmark: DataFrame, item_id: str, text: str, limit: int, window: int = WINDOW) -> Iterator[WindowSet]:
    """Sets of at most limit bytes (or one window), the next one built when asked for."""
    rows = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(text).alias("t")).where("i is not null and t is not null")
    held, total = [], 0
    for r in rows.toLocalIterator():
        for item, words, size in _pieces(r.i, r.t, window, limit):
            if held and total + size > limit:
                yield WindowSet(held, window)
                held, total = [], 0
            held.append((item, words))
            total += size
    yield WindowSet(held, window)


def _hits(rows: DataFrame, row: str, text: str, blocks: Iterator[WindowSet], spans: bool) -> DataFrame:
    """row, hit_ranges (merged over all blocks), items: one row for each row with a hit in any block.

    One block at a time is built, sent, scanned and forgotten.
    """

    def hits(batches, held):
        for ids, _, _, merged, items in _scan(batches, held.value, spans):
            keep = [i for i, ranges in enumerate(merged) if ranges]
            yield pa.RecordBatch.from_arrays([ids.take(pa.array(keep, pa.int64())), pa.array([merged[i] for i in keep], pa.list_(pa.int32())), pa.array([items[i] for i in keep], pa.list_(pa.string()))], ["row", "hit_ranges", "items"])

    parts = []
    for block in blocks:
        held = rows.sparkSession.sparkContext.broadcast(block)
        parts.append(staged(rows.select(row, text).mapInArrow(lambda b, held=held: hits(b, held), "row bigint, hit_ranges array<int>, items array<string>")))
        held.destroy()
    found = parts[0]
    for part in parts[1:]:
        found = found.unionByName(part)
    found = found.groupBy("row").agg(F.flatten(F.collect_list("hit_ranges")).alias("hit_ranges"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    starts, ends = F.filter("hit_ranges", lambda _, i: i % 2 == 0), F.filter("hit_ranges", lambda _, i: i % 2 == 1)
    ordered = F.array_sort(F.arrays_zip(starts.alias("a"), ends.alias("b")))
    merged = F.aggregate(
        ordered, F.array().cast("array<int>"),
        lambda out, x: F.when((F.size(out) > 0) & (x["a"] <= F.try_element_at(out, F.lit(-1))), F.concat(F.slice(out, 1, F.greatest(F.size(out) - 1, F.lit(0))), F.array(F.greatest(F.try_element_at(out, F.lit(-1)), x["b"]))))
        .otherwise(F.concat(out, F.array(x["a"], x["b"]))),
    )
    out = staged(found.select("row", merged.alias("hit_ranges"), "items"))
    drop_staged(*parts)
    return out


def _cut(value: str | None, ranges) -> str | None:
    """The text without its byte ranges."""
    if not ranges:
        return value
    raw, at, out = (value or "").encode(), 0, b""
    for a, b in zip(ranges[::2], ranges[1::2], strict=True):
        out, at = out + raw[at:a], b
    return (out + raw[at:]).decode()


def _in_blocks(docs: DataFrame, blocks: Iterator[WindowSet], doc_id: str, text: str, action: str) -> DataFrame:
    """The same answers from several blocks: rows are staged with a key, and all blocks scan the texts as they came."""
    row = "_row"
    while row in docs.columns:
        row += "_"
    rows = staged(docs.withColumn(row, F.monotonically_increasing_id()))
    hits = _hits(rows, row, text, blocks, action == "cut").withColumnRenamed("row", row)
    if action == "drop":
        return rows.join(hits, row, "left_anti").select(docs.columns)
    if action == "report":

        def count(batches):
            for batch in batches:
                for r, end, data, offsets in K.chunks(batch.column(2)):
                    n = np.diff(K.words(data, offsets, K.ALNUM_WORDS, lower=True).first)
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(r, end - r), batch.column(1).slice(r, end - r), pa.array(n, pa.int64())], [row, "doc_id", "n_words"])

        kind = docs.schema[doc_id].dataType.simpleString()
        counted = rows.select(row, F.col(doc_id).alias("doc_id"), text).mapInArrow(count, f"{row} bigint, doc_id {kind}, n_words bigint")
        none = lambda c, kind: F.coalesce(F.col(c), F.array().cast(kind)).alias(c)
        return counted.join(hits, row, "left").select("doc_id", "n_words", none("hit_ranges", "array<int>"), none("items", "array<string>"))
    names, at = docs.columns, docs.columns.index(text)

    def cut(batches):
        for batch in batches:
            ranges = batch.column(len(names)).to_pylist()
            texts = [_cut(t, r) for t, r in zip(batch.column(at).to_pylist(), ranges, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(names))], names)

    joined = rows.join(hits.select(row, F.col("hit_ranges").alias(f"{row}ranges")), row, "left")
    return joined.select(*names, f"{row}ranges").mapInArrow(cut, docs.schema)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text", window: int = WINDOW, action: str = "report", max_set_bytes: int = MAX_SET_BYTES,
) -> DataFrame:
    """Find, cut or drop benchmark passages in whole texts.

    Words are runs of ASCII digits and letters (lower-cased) and non-ASCII characters. A window
    is `window` consecutive words of an item; a shorter item with any word is one window.
    action "report": one row for each row of docs: id, n_words, hit_ranges (flat word positions,
    begin and end), items. action "drop": rows of docs without a hit, all columns kept. action
    "cut": all rows of docs, with hit spans taken out of the text. Windows are found by hash and
    compared word by word, so collisions cannot hit. max_set_bytes bounds the built set, words
    and tables together; a larger benchmark (or item) is scanned in blocks, one after the other,
    with the same answers: all blocks scan the given texts, staged with a key for each row, and
    the ranges of a row are joined on it. Null or empty text has no words and is
    kept; null items and items without words have no window; an empty benchmark hits nothing;
    rows that repeat are judged each on its own; other columns pass through.
    """
    K.small_batches(docs.sparkSession)
    blocks = _blocks(benchmark, item_id, item_text, max_set_bytes, window)
    first = next(blocks)
    if (second := next(blocks, None)) is not None:
        return _in_blocks(docs, chain((first, second), blocks), doc_id, text, action)
    held = docs.sparkSession.sparkContext.broadcast(first)
    if action == "report":
        kind = docs.schema[doc_id].dataType.simpleString()

        def report(batches):
            for ids, _, counts, merged, items in _scan(batches, held.value, spans=False):
                yield pa.RecordBatch.from_arrays([ids, pa.array(counts, pa.int64()), pa.array(merged, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], ["doc_id", "n_words", "hit_ranges", "items"])

        return docs.select(doc_id, text).mapInArrow(report, f"doc_id {kind}, n_words bigint, hit_ranges array<int>, items array<string>")
    names, at = docs.columns, docs.columns.index(text)

    def act(batches):
        for batch in batches:
            pair = pa.RecordBatch.from_arrays([pa.array(np.arange(batch.num_rows)), batch.column(at)], ["i", "t"])
            keep, texts = [], []
            for ids, part, _, merged, _ in _scan([pair], held.value, spans=True):
                for i, t, ranges in zip(ids.to_pylist(), part.to_pylist(), merged, strict=True):
                    if action == "drop":
                        keep += [i] if not ranges else []
                    else:
                        texts.append(_cut(t, ranges))
            if action == "drop":
                yield batch.take(pa.array(keep, pa.int64()))
            else:
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if j == at else batch.column(j) for j in range(len(names))], names)

    return docs.mapInArrow(act, docs.schema)


def contamination_digest(report: DataFrame) -> DataFrame:
    """The fixed digest columns of a report."""
    starts = F.filter("hit_ranges", lambda _, i: i % 2 == 0)
    ends = F.filter("hit_ranges", lambda _, i: i % 2 == 1)
    merged = F.aggregate(
        F.array_sort(F.arrays_zip(starts.alias("a"), ends.alias("b"))),
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("at")),
        lambda acc, x: F.struct((acc["n"] + F.greatest(F.lit(0), x["b"] - F.greatest(x["a"], acc["at"]))).cast("long").alias("n"), F.greatest(acc["at"], x["b"]).alias("at")),
    )["n"]
    return report.select(
        "doc_id", "n_words", merged.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join(F.array_sort("items"), ","), 256).alias("items_sha256"),
    ).withColumn("contaminated", F.col("n_hit") > 0)

