"""Substring dedup by compacting a de Bruijn graph of token k-mers.

Windows of `window` words are the edges of the graph: two that follow each other in a text share
all words but one, their node. Only repeated edges matter, and in three scans they are told from
the others. First, windows that share a minimiser are taken together as one stretch, and stretches
are counted; a minimiser on one stretch only has windows that repeat together or not at all.
Where a minimiser lies on several stretches, the second scan counts single windows. The third
counts how often each repeated stretch or window (a unit) is followed by which other. That gives
every unit's degrees and multiplicity: a unit and its successor are one nonbranching path if each
always stands beside the other. Such links are contracted by pointer jumping, in joins that halve
a path's length in each round, to one row for each path with its windows.

A fourth scan gives the source coordinates of every place where a path begins. Hashes alone
decide nothing: the words at all coordinates of a path are compared by a digest of 128 bits as
they are cut. Paths that hold different words fall back to single windows, compared by digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.joins import join_hot
from ..plans.staging import drop_staged, staged
from . import kernels as K

WINDOW = 35
EDGE = 16
#: Places of a path from which its row is broadcast where its places are joined, if all such rows are few.
HOT = 1024
#: Rounds of contraction; each doubles the units that one pointer skips.
ROUNDS = 60
_POS_BITS = np.uint64(28)


def stretches(w: K.Words, window: int, edge: int, mask: np.uint64):
    """Minimiser hash, stretch hash, first window and windows of each stretch of a chunk, in order."""
    at = K.valid_starts(w, window)
    if not len(at):
        none = np.zeros(0, np.int64)
        return none.astype(np.uint64), none.astype(np.uint64), none, none
    kmers = K.windows(w.hashes, edge)
    packed = (kmers >> _POS_BITS << _POS_BITS) | np.arange(len(kmers), dtype=np.uint64)
    best = K.sliding_min(packed, window - edge + 1)[at] & np.uint64((1 << 28) - 1)
    begin = np.flatnonzero(np.concatenate(([True], (best[1:] != best[:-1]) | (np.diff(at) != 1))))
    lo, count = at[begin], np.diff(np.append(begin, len(at)))
    where = best[begin].astype(np.int64)
    stretch = K.mix(K.spans(w.hashes, lo, lo + count + window - 1) ^ (where - lo).astype(np.uint64))
    return kmers[where], stretch & mask, lo, count


class _Units:
    """Finds the units of a chunk: repeated stretches whole, repeated windows of forked ones singly."""

    def __init__(self, some: K.Bloom, forks: K.Bloom, windows: K.Bloom | None, window: int, edge: int, mask: np.uint64):
        self.some, self.forks, self.windows, self.window, self.edge, self.mask = some, forks, windows, window, edge, mask

    def forked(self, w: K.Words) -> np.ndarray:
        """Starts of all windows of forked stretches."""
        a, _, lo, n = stretches(w, self.window, self.edge, self.mask)
        keep = self.forks.has(a) if len(a) else np.zeros(0, bool)
        lo, n = lo[keep], n[keep]
        return np.repeat(lo - np.cumsum(n) + n, n) + np.arange(n.sum())

    def names(self, w: K.Words, starts: np.ndarray) -> np.ndarray:
        """Unit names of single windows."""
        return K.mix(K.windows(w.hashes, self.window)[starts] ^ np.uint64(0x8B72E7A1)) & self.mask

    def of(self, w: K.Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Name, first window and windows of each unit, in order."""
        a, s, lo, n = stretches(w, self.window, self.edge, self.mask)
        if not len(a):
            return s, lo, n
        whole = self.some.has(a) & ~self.forks.has(a)
        single = self.forked(w)
        u = self.names(w, single)
        keep = self.windows.has(u)
        u, at = np.concatenate((s[whole], u[keep])), np.concatenate((lo[whole], single[keep]))
        n = np.concatenate((n[whole], np.ones(keep.sum(), np.int64)))
        order = np.argsort(at, kind="stable")
        return u[order], at[order], n[order]


def _scan(docs: DataFrame, columns: list[str], schema: str, emit) -> DataFrame:
    """emit(words, row offset, key columns) of every chunk of the texts, which are the last column."""

    def run(batches):
        for batch in batches:
            keys = [batch.column(i).to_numpy() for i in range(batch.num_columns - 1)]
            for row, _, data, offsets in K.chunks(batch.column(batch.num_columns - 1)):
                got = emit(K.words(data, offsets, K.SPACE_WORDS, lower=False), row, keys)
                if len(got[0]):
                    yield pa.RecordBatch.from_arrays(got, names)

    names = [x.split()[0] for x in schema.split(", ")]
    return docs.select(*columns).mapInArrow(run, schema)


def contracted(follows: DataFrame) -> DataFrame:
    """u, n (windows) and c (places) of every nonbranching path of repeated units.

    follows has u, n (windows of u), v (the unit that follows it somewhere, or null) and t (how
    often). Unit u and v are linked where u stands c(u) = t = c(v) times: then v is all that ever
    follows u and u all that ever stands before v. Paths cannot close, as each place has an end.
    """
    degrees = follows.groupBy("u").agg(F.sum("t").alias("c"), F.max("n").alias("n"), F.max(F.struct("t", "v")).alias("next"))
    degrees = staged(degrees.where("c > 1").select("u", "c", "n", F.when(F.col("next.t") == F.col("c"), F.col("next.v")).alias("v")))
    before = degrees.where("v is not null").select(F.col("v").alias("u"), F.col("u").alias("p"), F.col("c").alias("cp"))
    linked = degrees.join(before, "u").where("c = cp").groupBy("u").agg(F.min("p").alias("p"), F.first("n").alias("n"))
    # Pointers of linked units: at is an earlier unit of the path, and done where it is the first.
    linked = staged(linked)
    first = linked.select(F.col("u").alias("p"), F.lit(True).alias("inner"))
    pointers = staged(linked.join(first, "p", "left").select("u", "n", F.col("p").alias("at"), F.col("inner").isNull().alias("done")))
    for _ in range(ROUNDS):
        if pointers.where("not done").isEmpty():
            break
        ahead = pointers.select(F.col("u").alias("at"), F.col("at").alias("next"), F.col("done").alias("ends"))
        moved = pointers.where("not done").join(ahead, "at").select("u", "n", F.col("next").alias("at"), F.col("ends").alias("done"))
        new = staged(pointers.where("done").unionByName(moved))
        drop_staged(pointers)
        pointers = new
    else:
        raise RuntimeError(f"paths did not contract in {ROUNDS} rounds")
    rest = pointers.groupBy("at").agg(F.sum("n").alias("more")).withColumnRenamed("at", "u")
    paths = degrees.select("u", "c", "n").join(pointers.select("u"), "u", "left_anti").join(rest, "u", "left")
    paths = staged(paths.select("u", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"), "c"))
    drop_staged(degrees, linked, pointers)
    return paths


def repeated_spans(docs: DataFrame, *, text: str = "text", window: int = WINDOW, edge: int = EDGE, bloom_bits: int = 26, hash_bits: int = 64) -> DataFrame:
    """k1, k2 and spans array<struct<lo, n, u>>: n windows from lo on lie on path u; all candidates.

    docs must hold k1 and k2, two longs that name a row's text.
    """
    spark, mask = docs.sparkSession, np.uint64((1 << hash_bits) - 1)
    filters = lambda df, c: K.bloom_of(df, c, bloom_bits)
    count = _scan(docs, [text], "a bigint, s bigint", lambda w, row, keys: [K.signed(x) for x in stretches(w, window, edge, mask)[:2]])
    shared = staged(count.groupBy("a", "s").agg(F.count("*").alias("c")).groupBy("a").agg(F.count("*").alias("kinds"), F.sum("c").alias("c")).where("c > 1").select("a", "kinds"))
    some, forks = filters(shared, "a"), filters(shared.where("kinds > 1"), "a")
    held = spark.sparkContext.broadcast(_Units(some, forks, None, window, edge, mask))

    def windows(w, row, keys):
        return [K.signed(held.value.names(w, held.value.forked(w)))]

    twice = staged(_scan(docs, [text], "u bigint", windows).groupBy("u").agg(F.count("*").alias("c")).where("c > 1").select("u"))
    units = spark.sparkContext.broadcast(_Units(some, forks, filters(twice, "u"), window, edge, mask))

    def follow(w, row, keys):
        u, at, n = units.value.of(w)
        row_of = np.searchsorted(w.first, at, "right")
        goes_on = np.zeros(len(u), bool)
        goes_on[:-1] = (at[1:] == (at + n)[:-1]) & (row_of[1:] == row_of[:-1])
        v = np.zeros(len(u), np.uint64)
        v[:-1] = u[1:]
        return [K.signed(u), pa.array(n), pa.array(v.view(np.int64), mask=~goes_on)]

    follows = _scan(docs, [text], "u bigint, n bigint, v bigint", follow).groupBy("u", "v").agg(F.max("n").alias("n"), F.count("*").alias("t"))
    paths = contracted(follows)
    heads = spark.sparkContext.broadcast(filters(paths, "u"))

    def locate(w, row, keys):
        u, at, _ = units.value.of(w)
        keep = heads.value.has(u) if len(u) else np.zeros(0, bool)
        u, at = u[keep], at[keep]
        rows = np.searchsorted(w.first, at, "right") - 1
        return [K.signed(u), pa.array(keys[0][row + rows]), pa.array(keys[1][row + rows]), pa.array((at - w.first[rows]).astype(np.int32))]

    places = staged(_scan(docs, ["k1", "k2", text], "u bigint, k1 bigint, k2 bigint, lo int", locate))
    hot = staged(paths.where(F.col("c") > HOT).select("u", "n"))
    usual = join_hot(places, hot.select("u"), ["u"], F.struct("k1", "lo"), "left_anti", width=16).join(paths.where(F.col("c") <= HOT).select("u", "n"), "u")
    found = usual.unionByName(join_hot(places, hot, ["u"], F.struct("k1", "lo"), width=24).select(usual.columns))
    # Rows that repeat have one key; their places are kept once, by each task first.
    spans = staged(found.groupBy("k1", "k2").agg(F.collect_set(F.struct("lo", F.col("n").cast("int").alias("n"), "u")).alias("spans")))
    drop_staged(shared, twice, paths, places, hot)
    return spans


def _digest(words: list[bytes], lo: int, n: int) -> np.ndarray:
    return np.frombuffer(hashlib.blake2b(b" ".join(words[lo : lo + n]), digest_size=16).digest(), np.int64)


def _cut(keyed: DataFrame, spans: DataFrame, window: int, digest: bool) -> DataFrame:
    """k1, k2, doc_id, the answer of each row, and the digests (u, d1, d2) of its spans' words."""
    last = "kept_sha256" if digest else "text"

    def cut(batches):
        for batch in batches:
            total, removed, out, seen, bounds = [], [], [], [], [0]
            for raw, found in zip(batch.column("text"), batch.column("spans"), strict=True):
                have = (raw.as_py() or "").encode().split()
                total.append(len(have))
                if found.is_valid:
                    lo, n, u = (found.values.field(i).to_numpy() for i in range(3))
                    gone = np.zeros(len(have) + 1, np.int32)
                    np.add.at(gone, np.minimum(lo, len(have)), 1)
                    np.add.at(gone, np.minimum(lo + n + window - 1, len(have)), -1)
                    gone = np.cumsum(gone)[:-1] > 0
                    seen += [(k, *_digest(have, a, b + window - 1)) for k, a, b in zip(u.tolist(), lo.tolist(), n.tolist(), strict=True)]
                    have = [have[i] for i in np.flatnonzero(~gone)]
                bounds.append(len(seen))
                removed.append(total[-1] - len(have))
                kept = b" ".join(have)
                out.append(hashlib.sha256(kept).hexdigest() if digest else kept.decode())
            columns = [pa.array([x[i] for x in seen], pa.int64()) for i in range(3)]
            lists = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.StructArray.from_arrays(columns, ["u", "d1", "d2"]))
            rows = [pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(out, pa.string()), lists]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("k1", "k2", "doc_id")], *rows], ["k1", "k2", "doc_id", "n_words", "n_removed", last, "seen"])

    kind = keyed.schema["doc_id"].dataType.simpleString()
    joined = keyed.join(spans.hint("shuffle_hash"), ["k1", "k2"], "left").select("k1", "k2", "doc_id", "text", "spans")
    schema = f"k1 bigint, k2 bigint, doc_id {kind}, n_words bigint, n_removed bigint, {last} string, seen array<struct<u: bigint, d1: bigint, d2: bigint>>"
    return joined.mapInArrow(cut, schema)


def _windows_apart(keyed: DataFrame, spans: DataFrame, window: int) -> DataFrame:
    """The windows of spans that stand twice or more by digest, as spans of one window each."""

    def single(batches):
        for batch in batches:
            out = []
            for k1, k2, raw, found in zip(*[batch.column(c) for c in ("k1", "k2", "text", "spans")], strict=True):
                have = (raw.as_py() or "").encode().split()
                starts = {i for x in found.as_py() for i in range(x["lo"], min(x["lo"] + x["n"], len(have) - window + 1))}
                out += [(k1.as_py(), k2.as_py(), i, *_digest(have, i, window).tolist()) for i in sorted(starts)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()), strict=True)], ["k1", "k2", "lo", "d1", "d2"])

    found = staged(keyed.join(spans, ["k1", "k2"]).select("k1", "k2", "text", "spans").mapInArrow(single, "k1 bigint, k2 bigint, lo int, d1 bigint, d2 bigint"))
    twice = staged(found.groupBy("d1", "d2").agg(F.count("*").alias("c")).where("c > 1").select("d1", "d2"))
    return join_hot(found, twice, ["d1", "d2"], F.struct("k1", "lo"), width=32).select("k1", "k2", F.struct("lo", F.lit(1).alias("n"), F.lit(0).cast("bigint").alias("u")).alias("span"))


def dedup_substrings(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", window: int = WINDOW, edge: int = EDGE, digest: bool = False, hash_bits: int = 64,
) -> DataFrame:
    """Remove every word that a repeated window covers; windows are judged on the input.

    Words are runs of other bytes than ASCII white space. Returns id, n_words, n_removed and
    either the kept words joined by one space (text) or their SHA-256 (kept_sha256). Null and
    empty texts have no words; a text shorter than a window is kept whole; a repeated row
    repeats every window of it, so all its windows go; other columns are left out; an empty
    table gives no rows. Rows are told apart by 128 bits of hash over id and text. Fewer
    hash_bits cost time, as more paths hold different words, but change no answer.
    """
    if not 1 < edge < window:
        raise ValueError("an edge must be shorter than a window")
    K.small_batches(docs.sparkSession)
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), F.xxhash64(doc_id, text).alias("k1"), F.xxhash64(F.lit(11), text, doc_id).alias("k2"))
    spans = repeated_spans(keyed, window=window, edge=edge, hash_bits=hash_bits)
    cut = staged(_cut(keyed, spans, window, digest))
    seen = cut.select(F.explode("seen").alias("d")).select("d.*").groupBy("u").agg(*[f(c).alias(f"{n}{c}") for c in ("d1", "d2") for n, f in (("low", F.min), ("high", F.max))])
    mixed = staged(seen.where("lowd1 <> highd1 or lowd2 <> highd2").select("u"))
    answer = [c for c in cut.columns if c not in ("k1", "k2", "seen")]
    if mixed.isEmpty():
        drop_staged(spans, mixed)
        return cut.select(*answer)
    each = spans.select("k1", "k2", F.explode("spans").alias("span"))
    mark = mixed.select(F.col("u"), F.lit(True).alias("mixed"))
    each = staged(join_hot(each.select("k1", "k2", "span", F.col("span.u").alias("u")), mark, ["u"], F.struct("k1", "span"), "left", width=24))
    hit = staged(each.where("mixed").select("k1", "k2").distinct())
    single = _windows_apart(keyed, each.where("mixed").groupBy("k1", "k2").agg(F.collect_list("span").alias("spans")), window)
    good = each.where("mixed is null").join(hit, ["k1", "k2"], "left_semi").select("k1", "k2", "span").unionByName(single)
    again = _cut(keyed.join(hit, ["k1", "k2"], "left_semi"), staged(good.groupBy("k1", "k2").agg(F.collect_set("span").alias("spans"))), window, digest)
    return cut.join(hit, ["k1", "k2"], "left_anti").select(*answer).unionByName(again.select(*answer))
