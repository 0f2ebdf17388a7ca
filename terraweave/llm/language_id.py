"""Language ID by cross-parsing entropy against suffix automata of labelled text."""

from __future__ import annotations

import sys
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import kernels as K

#: Symbols of training text for each language, from whole texts, and texts from which they come.
TRAIN_SYMBOLS = 16384
TRAIN_TEXTS = 64
#: Equal parts that a language gives of its shortest text where every text of it is longer than TRAIN_SYMBOLS.
PARTS = 16
#: Texts are parsed in pieces of this many symbols side by side; phrases run on from piece to piece.
PIECE = 256
#: Symbols, and languages, that are parsed side by side.
SPAN = 1 << 18
ABREAST = 8
#: Sharpness of the score: odds double for each 1 / SHARPNESS bits a symbol.
SHARPNESS = 6.0
UNKNOWN = "und"
#: Bits a symbol after the first phrase above which no learned language is accepted: half of what
#: symbols that match nothing cost.
REJECT_BITS = float(np.log2(TRAIN_SYMBOLS) / 2)


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(sys.maxunicode + 1)), bool, sys.maxunicode + 1)


def _codes(text: str) -> np.ndarray:
    """Lower-case code points, each run of other characters than letters as one 0."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "replace"), "<u4")
    out = np.where(_letters()[raw], raw, 0)
    keep = np.ones(len(out), bool)
    keep[1:] = (out[1:] != 0) | (out[:-1] != 0)
    return out[keep]


class Automaton:
    """Suffix automaton of a symbol sequence."""

    def __init__(self, symbols):
        self.next, link, length = [{}], [-1], [0]
        last = 0
        for c in symbols:
            now = len(self.next)
            self.next.append({})
            length.append(length[last] + 1)
            link.append(0)
            p = last
            while p >= 0 and c not in self.next[p]:
                self.next[p][c] = now
                p = link[p]
            if p >= 0:
                q = self.next[p][c]
                if length[q] == length[p] + 1:
                    link[now] = q
                else:
                    clone = len(self.next)
                    self.next.append(dict(self.next[q]))
                    length.append(length[p] + 1)
                    link.append(link[q])
                    while p >= 0 and self.next[p].get(c) == q:
                        self.next[p][c] = clone
                        p = link[p]
                    link[q] = link[now] = clone
            last = now


class CrossParser:
    """All languages' automata in one table: a step is a lookup, its lowest bit starts a phrase."""

    def __init__(self, texts: dict[str, np.ndarray]):
        self.languages = sorted(texts)
        alphabet = np.unique(np.concatenate([*texts.values(), np.zeros(1, np.uint32)]))
        self.alphabet = alphabet
        width = len(alphabet) + 2  # a letter that no training text has, and the end of a short piece
        self.width, self.roots, self.scale, tables, base = width, [], [], [], 0
        for name in self.languages:
            sequence = np.searchsorted(alphabet, texts[name]).tolist()
            states = Automaton(sequence).next
            # One state more than the automaton's: after a letter that it does not know.
            table = np.zeros((len(states) + 1, width), np.int64)
            lost = 2 * (base + len(states) * width)
            again = np.full(width, lost + 1, np.int64)
            for c, to in states[0].items():
                again[c] = 2 * (base + to * width) + 1
            table[:] = again
            table[0] = lost
            for i, edges in enumerate(states):
                for c, to in edges.items():
                    table[i, c] = 2 * (base + to * width)
            table[:, width - 1] = 2 * (base + np.arange(len(table)) * width)
            tables.append(table.ravel())
            self.roots.append(base)
            self.scale.append(float(np.log2(max(2, len(sequence)))))
            base += table.size
        self.table = np.concatenate(tables).astype(np.int32 if 2 * base < 2**31 else np.int64)

    @property
    def lookup(self) -> np.ndarray:
        if getattr(self, "_lookup", None) is None:
            self._lookup = np.full(sys.maxunicode + 1, len(self.alphabet), np.uint16)
            self._lookup[self.alphabet] = np.arange(len(self.alphabet))
        return self._lookup

    def bits(self, codes: list[np.ndarray]) -> np.ndarray:
        """Bits a symbol of each text under each language; each text must have a symbol."""
        counts = np.array([len(c) for c in codes])
        phrases = np.empty((len(codes), len(self.languages)))
        short = np.flatnonzero(counts <= SPAN)
        for at in range(0, len(self.roots), ABREAST):
            roots = np.array(self.roots[at : at + ABREAST], self.table.dtype)[:, None]
            if len(short):
                phrases[short, at : at + ABREAST] = 1 + self._parse([codes[i] for i in short], np.repeat(roots, len(short), 1))[0].T
            for i in np.flatnonzero(counts > SPAN):
                state, total = roots, np.ones(len(roots))
                for begin in range(0, counts[i], SPAN):
                    starts, state = self._parse([codes[i][begin : begin + SPAN]], state)
                    total += starts[:, 0]
                phrases[i, at : at + ABREAST] = total
        return phrases * np.array(self.scale) / counts[:, None]

    def _parse(self, codes: list[np.ndarray], entry: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that start in each text, and its last state, by language; entry holds the first states.

        All pieces are parsed at once as if a phrase began with each. Then each takes the state
        in which its predecessor ends, and is parsed anew up to the place where the states agree;
        if they never do, its successor follows. What comes out is the parse of the whole text.
        """
        pieces = np.array([-(-len(c) // PIECE) for c in codes])
        first = np.cumsum(pieces) - pieces
        grid = np.full((pieces.sum(), PIECE), self.width - 1, np.int32)
        flat = grid.ravel()
        for c, at in zip(codes, first * PIECE, strict=True):
            flat[at : at + len(c)] = self.lookup[c]
        grid = np.ascontiguousarray(grid.T)
        begin = np.repeat(self.table.dtype.type(0) + entry.min(1, keepdims=True), grid.shape[1], 1)
        begin[:, first] = entry
        steps, state = np.empty((PIECE, *begin.shape), self.table.dtype), begin
        for t, row in enumerate(grid):
            steps[t] = self.table.take(state + row)
            state = steps[t] >> 1
        end, heads = state, np.zeros(grid.shape[1] + 1, bool)
        heads[first] = heads[-1] = True
        k, p = np.nonzero(np.broadcast_to(~heads[:-1], end.shape))
        while len(k):
            wrong = begin[k, p] != end[k, p - 1]
            k, p = k[wrong], p[wrong]
            state = begin[k, p] = end[k, p - 1]
            for t in range(PIECE):
                new = self.table.take(state + grid[t, p])
                apart = new != steps[t, k, p]
                steps[t, k, p] = new
                k, p, state = k[apart], p[apart], new[apart] >> 1
                if not len(k):
                    break
            end[k, p] = state
            more = ~heads[p + 1]
            k, p = k[more], p[more] + 1
        last = first + pieces - 1
        return np.add.reduceat((steps & 1).sum(0), first, axis=1), end[:, last]


def train(labelled: DataFrame, text: str, lang: str) -> CrossParser | None:
    """Automata over at most TRAIN_SYMBOLS of each language, from about TRAIN_TEXTS whole texts or more.

    Of a language's distinct texts with a letter and of TRAIN_SYMBOLS characters at most, about
    one in `every` is drawn by its hash: so many that there are TRAIN_TEXTS texts and twice
    TRAIN_SYMBOLS characters, or all of them. In hash order, each text that fits into the room
    left is taken whole. A language that has longer texts only gives PARTS equal parts, spread
    over the whole of its shortest. The sample changes neither with the order of rows nor with
    copies. Nothing labelled gives None.
    """
    labelled = labelled.where(F.col(lang).isNotNull() & F.col(text).isNotNull()).select(F.col(lang).alias("lang"), F.col(text).alias("text"))
    labelled = labelled.where(F.col("text").rlike(r"\p{L}")).select("*", F.xxhash64("text").alias("h"), F.length("text").cast("long").alias("size"))
    distinct = labelled.groupBy("lang", "h").agg(F.min("size").alias("size"))
    fits = F.col("size") <= TRAIN_SYMBOLS
    known = distinct.groupBy("lang").agg(F.count_if(fits).alias("n"), F.sum(F.when(fits, F.col("size"))).alias("size"), F.min(F.struct("size", "h")).alias("least")).collect()
    if not known:
        return None
    steps = {r["lang"]: max(1, min(r["n"] // TRAIN_TEXTS, r["size"] // (2 * TRAIN_SYMBOLS))) for r in known if r["n"]}
    every = F.coalesce(*[F.when(F.col("lang") == name, F.lit(n)) for name, n in steps.items()], F.lit(None).cast("int"))
    drawn = labelled.where(fits & (F.pmod("h", every) == 0)).select("lang", "h", "text")
    alone = [F.struct(F.lit(r["lang"]), F.lit(r["least"]["h"])) for r in known if not r["n"]]
    if alone:
        part = TRAIN_SYMBOLS // PARTS - 1
        cut = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda i: F.substring("text", (i * (F.col("size") - part) / (PARTS - 1)).cast("int") + 1, F.lit(part))), "\n")
        drawn = drawn.unionByName(labelled.where(F.struct("lang", "h").isin(alone)).select("lang", "h", cut.alias("text")))
    drawn = drawn.groupBy("lang", "h").agg(F.min("text").alias("text")).orderBy("lang", "h")
    parts: dict[str, list[np.ndarray]] = {}
    for r in drawn.toLocalIterator():
        got, codes = parts.setdefault(r["lang"], []), np.append(_codes(r["text"]), 0)
        if codes.any() and sum(map(len, got)) + len(codes) <= TRAIN_SYMBOLS + 1:
            got.append(codes)
    texts = {name: np.concatenate(got)[:-1].astype(np.uint32) for name, got in parts.items() if got}
    return CrossParser(texts) if texts else None


def identify(docs: DataFrame, parser: CrossParser | None, *, text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1), bits (of the best language, a symbol) and accepted.

    The language whose text needs the fewest phrases wins; phrases are weighed by the log of the
    training length and divided by the symbols, that is bits a symbol. A tie goes to the name
    that sorts first. Null text, text without a letter, and any text where nothing was learned
    are "und" with score 0, null bits and not accepted; nor is a text that parses hardly better
    than unknown symbols (REJECT_BITS). Whole texts are parsed. Rows that repeat get the same
    answer; existing columns with these names are replaced; no rows give no rows.
    """
    keep = [c for c in docs.columns if c not in ("lang_pred", "score", "bits", "accepted")]
    K.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(parser)
    at = keep.index(text)

    def run(batches):
        parser = held.value
        for batch in batches:
            n = batch.num_rows
            lang, score, best, accepted = [UNKNOWN] * n, np.zeros(n), [None] * n, np.zeros(n, bool)
            todo, held_codes, size = [], [], 0

            def parse():
                bits = parser.bits(held_codes)
                low = bits.argmin(1)
                odds = np.exp2(-SHARPNESS * (bits - bits.min(1, keepdims=True))).sum(1)
                for i, k, b, o, c in zip(todo, low, bits.min(1), odds, held_codes, strict=True):
                    lang[i], best[i], score[i] = parser.languages[k], float(b), 1 / o
                    accepted[i] = b - parser.scale[k] / len(c) <= REJECT_BITS

            for i, value in enumerate(batch.column(at)):
                codes = _codes(value.as_py() or "") if parser else np.zeros(0, np.uint32)
                if codes.any():
                    todo.append(i)
                    held_codes.append(codes)
                    size += len(codes)
                    if size > SPAN:
                        parse()
                        todo, held_codes, size = [], [], 0
            if todo:
                parse()
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lang, pa.string()), pa.array(score), pa.array(best, pa.float64()), pa.array(accepted)], [*keep, "lang_pred", "score", "bits", "accepted"])
            K.release()

    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double").add("bits", "double").add("accepted", "boolean")
    return docs.select(*keep).mapInArrow(run, schema)


def held_out(doc_id: str | Column, folds: int, fold: int) -> Column:
    """Whether the CRC-32 of the id as text leaves this remainder; a null id never does."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds == fold, F.lit(False))

