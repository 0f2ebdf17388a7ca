"""Vectorised byte kernels over Arrow text columns: words, hashes and windows without Python strings.

A word's hash sums a scrambled value of each byte and its place in the word, so no two words
collide by their structure; a second lane, scrambled in another way, makes 128 bits of the two.
Window hashes are polynomials over word hashes. Memory is about forty bytes for each byte of a
chunk, and a chunk holds whole texts of CHUNK bytes together or one longer text.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
#: Bytes of an Arrow batch sent to a Python worker, but for a longer row.
BATCH_BYTES = 1 << 22
#: Places in a word whose byte values are looked up; later ones are computed, by the same rule.
_SPOTS = 64
_LANES = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F))
_tables: dict[int, np.ndarray] = {}
_STEP = 0xD1342543DE82EF95
_STEP_INV = pow(_STEP, -1, 1 << 64)
_powers: dict[int, np.ndarray] = {}

#: ASCII white space ends a word; every other byte belongs to one.
SPACE_WORDS = np.ones(256, bool)
SPACE_WORDS[[9, 10, 11, 12, 13, 32]] = False
#: ASCII digits and letters and every byte of a non-ASCII character belong to a word.
ALNUM_WORDS = np.zeros(256, bool)
ALNUM_WORDS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def powers(base: int, n: int) -> np.ndarray:
    have = _powers.get(base)
    if have is None or len(have) < n:
        size = max(n, CHUNK + 1)
        out = np.ones(size, np.uint64)
        out[1:] = np.uint64(base)
        _powers[base] = have = np.multiply.accumulate(out)
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection on 64 bits that spreads every input bit."""
    h = h ^ (h >> np.uint64(31))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def small_batches(spark) -> None:
    """Bound the texts that a Python worker holds at once, unless the session has its own bounds.

    Rows of a join come sorted, so a batch may hold one group's long texts only: bytes are bounded
    as well as rows, as each of an executor's tasks has a batch beside the heap and in its worker.
    """
    for key, usual, bound in (("maxRecordsPerBatch", "10000", "1000"), ("maxBytesPerBatch", "67108864b", str(BATCH_BYTES))):
        key = f"spark.sql.execution.arrow.{key}"
        if spark.conf.get(key) == usual:
            spark.conf.set(key, bound)


def release() -> None:
    """Give freed memory back to the system: workers outlive their tasks and share it with the JVM."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, row offsets) of runs of whole texts; null counts as empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    row = 0
    while row < len(column):
        end = max(row + 1, int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1)
        yield row, end, data[offsets[row] : offsets[end]], offsets[row : end + 1] - offsets[row]
        row = end
    del column, offsets, data
    release()


@dataclass
class Words:
    """Words of a chunk: byte ranges, hashes, and for each row the range of its words."""

    starts: np.ndarray
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray
    twins: np.ndarray | None = None

    def row_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))


def _byte_values(codes: np.ndarray, lane: int) -> np.ndarray:
    """A scrambled value for each code (256 * place + byte)."""
    rule = lambda c: mix(mix(c.astype(np.uint64) + _LANES[lane]) * _LANES[lane])
    if lane not in _tables:
        _tables[lane] = rule(np.arange(256 * _SPOTS))
    if not len(codes) or codes.max() < 256 * _SPOTS:
        return _tables[lane].take(codes)
    out, far = np.empty(len(codes), np.uint64), codes >= 256 * _SPOTS
    out[far], out[~far] = rule(codes[far]), _tables[lane].take(codes[~far])
    return out


def words(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, lower: bool, twin: bool = False) -> Words:
    n = len(data)
    empty = np.zeros(0, np.int64)
    none = Words(empty, empty, empty.astype(np.uint64), np.zeros(len(offsets), np.int64), empty.astype(np.uint64) if twin else None)
    if not n:
        return none
    inside = table[data]
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = inside[:-1]
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    if not len(starts):
        return none
    after = np.zeros(n, bool)
    after[:-1] = inside[1:]
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    lengths = ends - starts
    begin = np.cumsum(lengths) - lengths
    codes = np.arange(begin[-1] + lengths[-1])
    codes -= np.repeat(begin, lengths)
    codes <<= 8
    codes += (LOWER[data] if lower else data)[inside]
    lanes = [mix(np.add.reduceat(_byte_values(codes, lane), begin)) for lane in range(1 + twin)]
    return Words(starts, ends, lanes[0], np.searchsorted(starts, offsets), lanes[1] if twin else None)


def windows(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """The hash of each run of length words; runs over a row's end must be left out by the caller."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = _sums(hashes, salt)
    return mix(((sums[length:] - sums[:n]) * powers(_STEP_INV, n)) ^ np.uint64(length))


def _sums(hashes: np.ndarray, salt: int) -> np.ndarray:
    source = mix(hashes ^ np.uint64(salt)) if salt else hashes
    sums = np.zeros(len(source) + 1, np.uint64)
    np.cumsum(source * powers(_STEP, len(source)), out=sums[1:])
    return sums


def spans(hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """The hash of the words from starts to ends; it depends on the words and the salt alone."""
    sums = _sums(hashes, salt)
    return mix(((sums[ends] - sums[starts]) * powers(_STEP_INV, len(sums))[starts]) ^ (ends - starts).astype(np.uint64))


def valid_starts(w: Words, length: int) -> np.ndarray:
    """Word positions at which a run of length words stays within its row."""
    if len(w.hashes) < length:
        return np.zeros(0, np.int64)
    left = np.repeat(w.first[1:], np.diff(w.first)) - np.arange(len(w.hashes))
    return np.flatnonzero(left >= length)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every width neighbours, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = np.minimum(out[: len(out) - step], out[step:])
        have += step
    return out


def times(x: np.ndarray, w: np.ndarray, bias: np.ndarray | None = None, block: int = 1024) -> np.ndarray:
    """x @ w (+ bias), each row by the same arithmetic wherever it stands: every product has the same shape."""
    out = np.empty((len(x), w.shape[1]), np.result_type(x, w))
    for at in range(0, len(x), block):
        part = x[at : at + block]
        if len(part) < block:
            part = np.concatenate((part, np.zeros((block - len(part), x.shape[1]), x.dtype)))
            out[at : at + block] = (part @ w)[: len(x) - at]
        else:
            np.matmul(part, w, out=out[at : at + block])
    if bias is not None:
        out += bias
    return out


def signed(values: np.ndarray) -> pa.Array:
    return pa.array(values.view(np.int64))


class Bloom:
    """A fixed-size Bloom filter for 64-bit hashes: a prefilter whose false hits a later join removes."""

    def __init__(self, bits: np.ndarray):
        self.bits = bits
        self.shift = np.uint64(64 - (len(bits) * 64 - 1).bit_length())

    def places(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return mix(hashes ^ np.uint64(0x5851F42D4C957F2D)) >> self.shift, mix(hashes ^ np.uint64(0x14057B7EF767814F)) >> self.shift

    def has(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for place in self.places(hashes):
            out &= (self.bits[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1) == 1
        return out


def bloom_of(df, column: str, log2_bits: int = 26) -> Bloom:
    """The filter of a bigint column: executors set bits, partial bit_or merges them, 2**log2_bits / 8 bytes reach the driver."""
    from pyspark.sql import functions as F

    size = 1 << (log2_bits - 6)

    def mark(batches):
        mine = Bloom(np.zeros(size, np.uint64))
        for batch in batches:
            h = batch.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
            for place in mine.places(h):
                np.bitwise_or.at(mine.bits, (place >> np.uint64(6)).astype(np.int64), np.uint64(1) << (place & np.uint64(63)))
        at = np.flatnonzero(mine.bits)
        for part in np.array_split(at, max(1, len(at) // 65536)):
            if len(part):
                yield pa.RecordBatch.from_arrays([pa.array(part), signed(mine.bits[part])], ["at", "bits"])

    marked = df.select(column).where(F.col(column).isNotNull()).mapInArrow(mark, "at bigint, bits bigint")
    merged = marked.groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    bits = np.zeros(size, np.uint64)
    bits[merged["at"].to_numpy()] = merged["bits"].to_numpy().view(np.uint64)
    return Bloom(bits)
