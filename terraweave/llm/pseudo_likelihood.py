"""Masked pseudo-likelihood: a bidirectional window network predicts each word from both sides.

The prediction has three steps. From the words on both sides the network gives the word's class,
then its branch within the class; frequent words are classes of their own, the others share
classes by their last bytes and branches by their hash. Among the words of a leaf (class and
branch) exact counts over the whole corpus decide: those of frequent words are broadcast, all
others are a table that grows with the vocabulary and is joined. Words are told apart by 64 bits.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.staging import drop_staged, staged
from . import kernels as K

CLASSES = 64
#: Classes that one frequent word each has.
OWN = 40
SHARED = CLASSES - OWN
#: Branches of a shared class.
BRANCHES = 64
WIDTH = 24
#: Words that the network sees on each side.
SIDE = 2
#: Windows of one training step.
STEP = 1024
ROUNDS = 2
#: Step length of a shard's first step; later steps shrink.
RATE = 2.0
#: Words that one training shard has, about: the corpus alone, not its files, decides on the shards.
SHARD_WORDS = 1 << 19
#: Shards' models that one task adds up, and that the driver gets at most.
SUM_MODELS = 256
#: Words whose counts are broadcast, at most: 16 MB. The counts of all others are joined.
HELD = 1 << 20
#: Words that a task collects before it gives out their counts.
_POOL = 1 << 19
#: Joined terms are summed as whole multiples of this, so that their order makes no difference.
_GRAIN = float(1 << 32)


def _tokens(column: pa.Array):
    """(first row, end row, word hashes, leaves, row bounds) of each chunk."""
    for row, end, data, offsets in K.chunks(column):
        w = K.words(data, offsets, K.SPACE_WORDS, lower=True)
        lower = K.LOWER[data].astype(np.int32)
        last = lower[w.ends - 1] if len(w.ends) else np.zeros(0, np.int32)
        before = lower[np.maximum(w.ends - 2, w.starts)] if len(w.ends) else last
        leaf = (last * 31 + before) % SHARED * BRANCHES + (w.hashes >> np.uint64(40)).astype(np.int32) % BRANCHES
        yield row, end, w.hashes, leaf.astype(np.int32), w.first


def _places(words: np.ndarray, known: np.ndarray) -> np.ndarray:
    """The place of each word among the sorted known ones, -1 where it is none of them."""
    if not len(known):
        return np.full(len(words), -1, np.int32)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    return np.where(known[at] == words, at, -1).astype(np.int32)


def _classes(words: np.ndarray, leaf: np.ndarray, own: np.ndarray) -> np.ndarray:
    at = _places(words, own)
    return np.where(at >= 0, at, OWN + leaf // BRANCHES)


def _small(weights: np.ndarray, bias: np.ndarray) -> bool:
    """Whether no logit over hidden values of -1 to 1 can leave the range of single precision's exp."""
    return float(np.abs(weights).sum(0).max() + np.abs(bias).max()) < 80


def _softmax_step(logit: np.ndarray, target: np.ndarray, scale: float, small: bool) -> np.ndarray:
    """The scaled gradient of the log loss by the logits, in their place."""
    if not small:
        logit -= logit.max(1, keepdims=True)
    np.exp(logit, out=logit)
    logit *= (scale / logit.sum(1))[:, None]
    logit[np.arange(len(target)), target] -= scale
    return logit


def _one_hot(rows: int, at: np.ndarray) -> np.ndarray:
    out = np.zeros((rows, len(at)), np.float32)
    out[at, np.arange(len(at))] = 1
    return out


def _log_softmax(logit: np.ndarray, target: np.ndarray, small: bool) -> np.ndarray:
    right = logit[np.arange(len(logit)), target]
    if not small:
        top = logit.max(1)
        logit -= top[:, None]
        right -= top
    np.exp(logit, out=logit)
    return right - np.log(logit.sum(1))


_SHAPES = {
    "embed": (2 * SIDE, CLASSES + 1, WIDTH), "bias": (WIDTH,), "out": (WIDTH, CLASSES), "out_bias": (CLASSES,), "branch": (WIDTH, BRANCHES), "branch_bias": (SHARED, BRANCHES),
}


@dataclass
class Network:
    """tanh of summed neighbour embeddings, a softmax over classes and one over a class's branches.

    Class CLASSES stands beyond a text's ends. Log probabilities of a word depend on its
    neighbours alone, to the last bit.
    """

    embed: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    branch: np.ndarray
    branch_bias: np.ndarray

    @staticmethod
    def fresh(seed: int = 5) -> Network:
        rng = np.random.default_rng(seed)
        return Network(**{k: np.zeros(s, np.float32) if "bias" in k else rng.normal(0, 0.3, s).astype(np.float32) for k, s in _SHAPES.items()})

    @staticmethod
    def of_counts(own: np.ndarray, totals: np.ndarray) -> Network:
        """A fresh network whose biases are the classes' and branches' shares of all words, one word added to each."""
        net, leaves = Network.fresh(), totals.reshape(SHARED, BRANCHES) + 1
        sizes = np.concatenate((own + 1, leaves.sum(1)))
        net.out_bias = np.log(sizes / sizes.sum()).astype(np.float32)
        net.branch_bias = np.log(leaves / leaves.sum(1, keepdims=True)).astype(np.float32)
        net.out *= 0.1
        net.branch *= 0.1
        return net

    def flat(self) -> np.ndarray:
        return np.concatenate([getattr(self, k).ravel() for k in _SHAPES])

    @staticmethod
    def of(flat: np.ndarray) -> Network:
        parts, at = {}, 0
        for k, shape in _SHAPES.items():
            n = int(np.prod(shape))
            parts[k], at = flat[at : at + n].astype(np.float32).reshape(shape), at + n
        return Network(**parts)

    def hidden(self, near: np.ndarray) -> np.ndarray:
        total = self.embed[0].take(near[0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.embed[k].take(near[k], axis=0)
        total += self.bias
        return np.tanh(total, out=total)

    def train(self, near: np.ndarray, target: np.ndarray, branch: np.ndarray, rate: float) -> None:
        """One step of gradient descent on the mean conditional log loss; branch counts for shared classes."""
        h, scale = self.hidden(near), np.float32(rate / len(target))
        p = _softmax_step(h @ self.out + self.out_bias, target, scale, _small(self.out, self.out_bias))
        d = p @ self.out.T
        shared = np.flatnonzero(target >= OWN)
        kind, hs = target[shared] - OWN, h[shared]
        q = _softmax_step(hs @ self.branch + self.branch_bias[kind], branch[shared], scale, _small(self.branch, self.branch_bias))
        d[shared] += q @ self.branch.T
        d *= 1 - h * h
        self.out -= h.T @ p
        self.out_bias -= p.sum(0)
        self.branch -= hs.T @ q
        self.branch_bias -= _one_hot(SHARED, kind) @ q
        self.bias -= d.sum(0)
        for k in range(2 * SIDE):
            self.embed[k] -= _one_hot(CLASSES + 1, near[k]) @ d

    def log_probability(self, near: np.ndarray, target: np.ndarray, branch: np.ndarray) -> np.ndarray:
        """Of each word's class, and where it is shared of its branch too."""
        out, small = np.empty(len(target)), (_small(self.out, self.out_bias), _small(self.branch, self.branch_bias))
        for at in range(0, len(target), 8192):
            part, goal = slice(at, at + 8192), target[at : at + 8192]
            h = self.hidden(near[:, part])
            out[part] = _log_softmax(K.times(h, self.out, self.out_bias), goal, small[0])
            shared = np.flatnonzero(goal >= OWN)
            logit = K.times(h[shared], self.branch)
            logit += self.branch_bias[goal[shared] - OWN]
            out[at + shared] += _log_softmax(logit, branch[part][shared], small[1])
        return out


def neighbours(classes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The classes of the SIDE words on each side of every word; CLASSES beyond a text's ends."""
    near = np.full((2 * SIDE, len(classes)), CLASSES, np.int32)
    counts = np.diff(first)
    place = np.arange(len(classes)) - np.repeat(first[:-1], counts)
    left = np.repeat(counts, counts) - place - 1
    for k in range(SIDE):
        back, ahead = place > k, left > k
        near[2 * k, back] = classes[np.flatnonzero(back) - k - 1]
        near[2 * k + 1, ahead] = classes[np.flatnonzero(ahead) + k + 1]
    return near


@dataclass
class PseudoLikelihood:
    network: Network
    own: np.ndarray  # sorted hashes of the words with a class of their own; the place is the class
    held: np.ndarray  # sorted hashes of the words whose counts are broadcast
    counts: np.ndarray  # their counts
    totals: np.ndarray  # words of each leaf in the corpus
    others: DataFrame | None  # word, n: counts of all other words that stand twice or more, if any

    def within(self, words: np.ndarray, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Log shares of words in their leaves, and the places of those not held, counted once so far.

        A leaf's words by count n / (total + 1) and one unseen word sum to 1.
        """
        at = _places(words, self.held)
        n = np.where(at >= 0, self.counts[np.maximum(at, 0)], 1) if len(self.held) else np.ones(len(words))
        return np.log(n) - np.log(self.totals[leaf] + 1), np.flatnonzero(at < 0)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word, leaf, n: how often each word stands in the whole corpus."""

    def count(batches):
        pool, held = [], 0

        def given():
            words, at, counts = (np.concatenate(x) for x in zip(*pool, strict=True))
            order = np.lexsort((at, words))
            words, at, counts = words[order], at[order], counts[order]
            new = np.flatnonzero(np.concatenate(([True], (words[1:] != words[:-1]) | (at[1:] != at[:-1]))))
            return pa.RecordBatch.from_arrays([K.signed(words[new]), pa.array(at[new]), pa.array(np.add.reduceat(counts, new))], ["word", "leaf", "n"])

        for batch in batches:
            for _, _, found, leaf, _ in _tokens(batch.column(0)):
                words, at, n = np.unique(found, return_index=True, return_counts=True)
                pool.append((words, leaf[at], n))
                held += len(words)
                if held > _POOL:
                    yield given()
                    pool, held = [], 0
        if held:
            yield given()

    return docs.select(text).mapInArrow(count, "word bigint, leaf int, n bigint").groupBy("word", "leaf").agg(F.sum("n").alias("n"))


def _most_frequent(counts: DataFrame) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hashes and counts of the OWN most frequent words, and of at most HELD frequent ones; each sorted."""

    def table(df):
        got = df.select("word", "n").toArrow()
        words = got["word"].to_numpy().astype(np.int64).view(np.uint64)
        order = np.argsort(words)
        return words[order], got["n"].to_numpy().astype(np.float64)[order]

    own, often = table(counts.orderBy(F.desc("n"), "word").limit(OWN))
    size = F.floor(8 * F.log2("n"))
    least, room = None, HELD
    for r in counts.groupBy(size.alias("size")).agg(F.count("*").alias("words")).orderBy(F.desc("size")).collect():
        room -= r["words"]
        if room < 0:
            break
        least = r["size"]
    return own, often, *(table(counts.where(size >= least)) if least is not None else (np.zeros(0, np.uint64), np.zeros(0)))


def _coded(docs: DataFrame, doc_id: str, text: str, own: np.ndarray, shards: int) -> DataFrame:
    """shard, order (o1, o2) and codes of every text with a word: two bytes a word, its class and branch."""
    held = docs.sparkSession.sparkContext.broadcast(own)

    def code(batches):
        for batch in batches:
            for row, end, words, leaf, first in _tokens(batch.column(3)):
                classes = _classes(words, leaf, held.value)
                codes = (classes * BRANCHES + np.where(classes >= OWN, leaf % BRANCHES, 0)).astype("<u2").tobytes()
                some = np.flatnonzero(np.diff(first))
                parts = [codes[2 * first[i] : 2 * first[i + 1]] for i in some]
                yield pa.RecordBatch.from_arrays([*[batch.column(i).take(pa.array(row + some)) for i in range(3)], pa.array(parts, pa.binary())], ["shard", "o1", "o2", "codes"])

    # Copies of a text have ids of their own, so they spread over all shards.
    o1, o2 = F.xxhash64(text, doc_id), F.xxhash64(F.lit(13), doc_id, text)
    rows = docs.select(F.pmod(o1, F.lit(shards)).cast("int").alias("shard"), o1.alias("o1"), o2.alias("o2"), text)
    return rows.mapInArrow(code, "shard int, o1 bigint, o2 bigint, codes binary")


def _shard_models(batches, start: Network, turn: int, rounds: int):
    """(shard, windows, model) of each shard; batches come in order of shard and rows."""
    mine, shard, step, windows, held, size = None, None, 0, 0, [], 0

    def learn():
        nonlocal step, windows
        codes = np.concatenate(held).astype(np.int32)
        first = np.concatenate(([0], np.cumsum([len(c) for c in held])))
        classes, branch = codes // BRANCHES, codes % BRANCHES
        near = neighbours(classes, first)
        for at in range(0, len(codes), STEP):
            step += 1
            if step % rounds == turn:
                mine.train(near[:, at : at + STEP], classes[at : at + STEP], branch[at : at + STEP], RATE / (1 + 0.002 * step) ** 0.5)
                windows += min(STEP, len(codes) - at)

    def result():
        return pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([windows], pa.int64()), pa.array([(windows * mine.flat().astype(np.float64)).tobytes()], pa.binary())], ["shard", "windows", "total"])

    for batch in batches:
        for s, codes in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            if s != shard or size > 32 * STEP:
                if held:
                    learn()
                held, size = [], 0
            if s != shard:
                if windows:
                    yield result()
                mine, shard, step, windows = Network.of(start.flat()), s, 0, 0
            held.append(np.frombuffer(codes.as_py(), "<u2"))
            size += len(held[-1])
    if held:
        learn()
    if windows:
        yield result()


def _added(models: DataFrame, shards: int) -> tuple[int, np.ndarray]:
    """Windows and weighted sum of all models, added in the order of shards, SUM_MODELS at a time."""

    def add(group: pa.Table) -> pa.Table:
        group = group.sort_by("shard")
        total = sum(np.frombuffer(b, np.float64) for b in group["total"].to_pylist())
        return pa.table({"shard": pa.array([group["shard"][0].as_py() // SUM_MODELS], pa.int32()), "windows": pa.array([sum(group["windows"].to_pylist())], pa.int64()), "total": pa.array([total.tobytes()], pa.binary())})

    while shards > SUM_MODELS:
        models = models.groupBy(F.floor(F.col("shard") / SUM_MODELS).alias("g")).applyInArrow(add, models.schema)
        shards = -(-shards // SUM_MODELS)
    weight, total = 0, 0.0
    for r in models.orderBy("shard").toLocalIterator():
        weight, total = weight + r["windows"], total + np.frombuffer(r["total"], np.float64)
    return weight, total


def train(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", rounds: int = ROUNDS) -> PseudoLikelihood:
    """Fit on every word of every text: shards of the corpus train side by side, then models are averaged.

    Texts are dealt to shards by hash and sorted there, so neither the order nor the partitions
    of docs change the model. In round r of R each shard takes the steps whose number leaves r
    modulo R, so all windows are used once; models weigh by their windows. An empty corpus leaves
    the first network. Rows that repeat in id and text meet in one shard.
    """
    K.small_batches(docs.sparkSession)
    counts = staged(count_words(docs, text))
    own, often, held, n = _most_frequent(counts)
    spark = docs.sparkSession
    signed = spark.createDataFrame([(int(w),) for w in own.view(np.int64)], "word bigint")
    # Forty words at most are broadcast.
    leaves = counts.join(F.broadcast(signed), "word", "left_anti").groupBy("leaf").agg(F.sum("n").alias("n")).collect()
    totals = np.zeros(SHARED * BRANCHES)
    for r in leaves:
        totals[r["leaf"]] = r["n"]
    size = counts.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-size // SHARD_WORDS))
    network = Network.of_counts(np.pad(often, (0, OWN - len(own))), totals) if size else Network.fresh()
    if size:
        coded = staged(_coded(docs, doc_id, text, own, shards))
        for turn in range(rounds):
            start = spark.sparkContext.broadcast(network)
            ordered = coded.repartition("shard").sortWithinPartitions("shard", "o1", "o2").select("shard", "codes")
            models = staged(ordered.mapInArrow(lambda b, start=start, turn=turn: _shard_models(b, start.value, turn, rounds), "shard int, windows bigint, total binary"))
            weight, total = _added(models, shards)
            if weight:
                network = Network.of(total / weight)
            drop_staged(models)
        drop_staged(coded)
    frequent = F.lit(False)
    if len(held):
        frequent = F.col("n") >= int(n.min())
    others = staged(counts.where(~frequent & (F.col("n") > 1)).select("word", "n"))
    drop_staged(counts)
    if others.isEmpty():
        drop_staged(others)
        others = None
    return PseudoLikelihood(network, own, held, n, totals, others)


def score_documents(docs: DataFrame, model: PseudoLikelihood, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens, log_probability (summed over all words, natural log) and its mean.

    Words are runs of other bytes than ASCII white space, A-Z lower-cased; every word of a whole
    text counts, and a text's score depends on nothing around it. Null and empty texts have 0
    words, sum 0 and a null mean; repeated rows score alike; other columns are left out; no rows
    give no rows.
    """
    K.small_batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(replace(model, others=None))
    joins = model.others is not None
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches):
        m, row_id = held.value, TaskContext.get().partitionId() << 40
        for batch in batches:
            for row, end, words, leaf, first in _tokens(batch.column(1)):
                classes = _classes(words, leaf, m.own)
                each = m.network.log_probability(neighbours(classes, first), classes, leaf % BRANCHES)
                shared = np.flatnonzero(classes >= OWN)
                inside, missing = m.within(words[shared], leaf[shared])
                each[shared] += inside
                n, total = np.diff(first), np.zeros(end - row)
                some = np.flatnonzero(n)
                if len(some):
                    total[some] = np.add.reduceat(each, first[some])
                rare = shared[missing] if joins else shared[:0]
                lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(rare, first).astype(np.int32)), K.signed(words[rare]))
                yield pa.RecordBatch.from_arrays([pa.array(row_id + np.arange(end - row)), batch.column(0).slice(row, end - row), pa.array(n), pa.array(total), lists], ["row_id", "doc_id", "n_tokens", "scored", "rare"])
                row_id += end - row

    scored = docs.select(doc_id, text).mapInArrow(run, f"row_id bigint, doc_id {kind}, n_tokens bigint, scored double, rare array<bigint>")
    whole = F.col("scored")
    if joins:
        scored = staged(scored)
        terms = scored.select("row_id", F.explode("rare").alias("word")).join(model.others, "word")
        sums = terms.groupBy("row_id").agg(F.sum(F.round(F.log("n") * _GRAIN).cast("bigint")).alias("inside"))
        scored, whole = scored.join(sums, "row_id", "left"), whole + F.coalesce(F.col("inside") / _GRAIN, F.lit(0.0))
    out = scored.select("doc_id", "n_tokens", whole.alias("log_probability"))
    return out.withColumn("mean_log_probability", F.when(F.col("n_tokens") > 0, F.col("log_probability") / F.col("n_tokens")))
