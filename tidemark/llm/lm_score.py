"""Operator 4, document scores by masked pseudo-likelihood.

A small network predicts every token from the two tokens on each side: a vector for each token and place, their sum
through tanh, a softmax over token classes. Frequent words are classes of their own, the others share classes by hash.
A token's probability is that of its class times that of the word within its class, from the counts of all words of the
whole corpus; one more count per class is for words that do not occur in it. Symbols are tokens too. Training passes over every document once: in each round
all tasks start from the same weights, train on their share with mini-batches, and Spark averages the
weights, weighted by tokens. A document's score is the sum of the log-probabilities of its tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.common import batch, id_and_text
from tidemark.llm.words import store_words, token_slices, word_counts
from tidemark.session import cut_lineage

BUCKETS = 1 << 16
FREQUENT, SHARED = 96, 32
CLASSES, NONE = FREQUENT + SHARED, FREQUENT + SHARED
SIDE, HIDDEN = 2, 16
_SIDES = np.array([*range(-SIDE, 0), *range(1, SIDE + 1)])
ROUNDS, STEP, BATCH = 2, 0.05, 4096
#: Tokens held at a time, whatever the size of an Arrow batch; a longer document is held alone.
SLICE = 1 << 18
#: Words with at least one in so many tokens (so at most as many words) are looked up in tasks, all others are joined.
COMMON = 1 << 14


class Network:
    """Weights as one flat vector: vectors by place and class, output weights, output bias."""

    shapes = ((2 * SIDE, CLASSES + 1, HIDDEN), (HIDDEN, CLASSES), (CLASSES,))
    size = sum(int(np.prod(s)) for s in shapes)

    def __init__(self, flat: np.ndarray):
        self.flat = flat.astype(np.float32)
        parts = np.split(self.flat, np.cumsum([int(np.prod(s)) for s in self.shapes])[:-1])
        self.vectors, self.out, self.bias = (p.reshape(s) for p, s in zip(parts, self.shapes))

    @classmethod
    def start(cls, share: np.ndarray, seed: int = 3) -> Network:
        """Small random weights; the bias is the log share of each class."""
        net = cls(np.random.default_rng(seed).normal(0, 0.1, cls.size))
        net.bias[:] = np.log(np.maximum(share, 1e-9))
        return net

    def _logits(self, context: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hidden values, and logits with 0 as the largest of a row."""
        total = self.vectors[0][context[:, 0]]
        for i in range(1, 2 * SIDE):
            total += self.vectors[i][context[:, i]]
        hidden = np.tanh(total)
        logits = hidden @ self.out
        logits += self.bias
        logits -= logits.max(axis=1, keepdims=True)
        return hidden, logits

    def log_probabilities(self, context: np.ndarray, target: np.ndarray) -> np.ndarray:
        """Log-probability of each target."""
        logits = self._logits(context)[1]
        own = logits[np.arange(len(target)), target]
        return own - np.log(np.exp(logits, out=logits).sum(axis=1))

    def train(self, context: np.ndarray, target: np.ndarray, memory: np.ndarray) -> None:
        """One step; step sizes follow the summed squares of past gradients."""
        hidden, error = self._logits(context)
        np.exp(error, out=error)
        error /= error.sum(axis=1, keepdims=True) * len(target)
        error[np.arange(len(target)), target] -= 1 / len(target)
        back = (error @ self.out.T) * (1 - hidden * hidden)
        places = [_class_sums(context[:, i], back).ravel() for i in range(2 * SIDE)]
        gradient = np.concatenate([*places, (hidden.T @ error).ravel(), error.sum(axis=0)])
        memory += gradient * gradient
        self.flat -= STEP * gradient / np.sqrt(memory + 1e-8)


def _class_sums(classes: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Sums of the rows of each class, and of those without one."""
    order = np.argsort(classes, kind="stable")
    ordered = classes[order]
    first = np.flatnonzero(np.diff(ordered.astype(np.int16), prepend=-1))
    out = np.zeros((CLASSES + 1, rows.shape[1]), np.float32)
    out[ordered[first]] = np.add.reduceat(rows[order], first, axis=0)
    return out


def surrounded(classes: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Classes of all documents in a row with ``SIDE`` empty places around each, and the place of every token in it."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    at = np.arange(len(classes)) + SIDE * (doc + 1)
    row = np.full(len(classes) + SIDE * len(first), NONE, classes.dtype)
    row[at] = classes
    return row, at


def context(row: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Classes on both sides of the tokens at these places."""
    return row[at[:, None] + _SIDES]


def class_table(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Class of every bucket and tokens of every class; of fixed size."""
    buckets = np.zeros(BUCKETS, np.int64)
    sums = counts.groupBy(F.pmod("word", F.lit(BUCKETS)).alias("bucket")).agg(F.sum("n").alias("n"))
    for row in sums.toLocalIterator():  # at most a row per bucket
        buckets[row.bucket] = row.n
    table = FREQUENT + np.arange(BUCKETS) % SHARED
    top = np.argsort(-buckets, kind="stable")[:FREQUENT]
    table[top] = np.arange(FREQUENT)
    return table.astype(np.uint8), np.bincount(table, weights=buckets, minlength=CLASSES)


def _trained(words: DataFrame, table, net: Network, turn: int, rounds: int) -> Network:
    shared = words.sparkSession.sparkContext.broadcast((table, net.flat))

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, flat = shared.value
        own, memory, seen = Network(flat.copy()), np.zeros(Network.size, np.float32), 0
        for b in batches:
            for *_, packed, first in token_slices(b.column("words"), SLICE):
                classes = table[packed % BUCKETS]
                row, at = surrounded(classes, first)
                order = np.random.default_rng(len(classes)).permutation(len(classes))
                for i in range(0, len(order), BATCH):
                    some = order[i : i + BATCH]
                    own.train(context(row, at[some]), classes[some], memory)
                seen += len(classes)
        if seen:
            yield batch(i=np.arange(Network.size, dtype=np.int32), w=own.flat.astype(np.float64) * seen, n=np.full(Network.size, float(seen)))

    part = words.filter(F.pmod(F.xxhash64("doc_id", F.lit("round")), F.lit(rounds)) == turn).select("words")
    sums = part.mapInArrow(train, "i int, w double, n double").groupBy("i").agg((F.sum("w") / F.sum("n")).alias("w"))
    flat = net.flat.copy()
    for row in sums.toLocalIterator():  # a row per weight
        flat[row.i] = row.w
    return Network(flat)


def fit(words: DataFrame, rounds: int = ROUNDS) -> tuple[DataFrame, np.ndarray, np.ndarray, Network]:
    """Word counts, class table, tokens by class and trained network. Every document is trained on in one of the rounds."""
    counts = cut_lineage(word_counts(words), "word-counts")
    table, totals = class_table(counts)
    net = Network.start(totals / max(1, totals.sum()))
    for turn in range(rounds):
        net = _trained(words, table, net, turn, rounds)
    return counts, table, totals, net


def score_words(words: DataFrame, counts: DataFrame, table: np.ndarray, totals: np.ndarray, net: Network) -> DataFrame:
    """Sums of log P(class) + log P(word | class), the latter (n + [n = 0]) / (tokens of the class + 1)."""
    common = F.col("n") * COMMON >= int(totals.sum())
    found = sorted((row.word, row.n) for row in counts.filter(common).collect())  # at most COMMON rows
    names = np.array([w for w, _ in found] + [1 << 32], np.int64)  # the last is no word
    logs = np.log(np.array([n for _, n in found] + [1], float))
    shared = words.sparkSession.sparkContext.broadcast((table, np.log(totals + 1), names, logs, net.flat))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, class_logs, names, logs, flat = shared.value
        own, row = Network(flat), TaskContext.get().partitionId() << 40
        for b in batches:
            for x, y, packed, first in token_slices(b.column("words"), SLICE):
                classes = table[packed % BUCKETS]
                around, place = surrounded(classes, first)
                each = np.zeros(len(classes) + 1)
                for i in range(0, len(classes), BATCH):
                    own_classes = classes[i : i + BATCH]
                    each[i + 1 : i + 1 + len(own_classes)] = own.log_probabilities(context(around, place[i : i + BATCH]), own_classes)
                at = np.searchsorted(names, packed)
                known = names[at] == packed
                each[1:] += np.where(known, logs[at], 0) - class_logs[classes]
                sums = np.cumsum(each)
                doc = np.repeat(np.arange(y - x), np.diff(first))
                pairs, k = np.unique((doc[~known] << 32) | packed[~known].astype(np.int64), return_counts=True)
                begin = pa.array(np.searchsorted(pairs >> 32, np.arange(y - x + 1)), pa.int32())
                rare = pa.StructArray.from_arrays([pa.array(pairs & 0xFFFFFFFF), pa.array(k.astype(np.int32))], names=["word", "k"])
                yield batch(
                    row=row + np.arange(y - x), doc_id=b.column("doc_id").slice(x, y - x), n_tokens=np.diff(first).astype(np.int64),
                    log_likelihood=sums[first[1:]] - sums[first[:-1]], rare=pa.ListArray.from_arrays(begin, rare),
                )
                row += y - x

    schema = "row long, doc_id long, n_tokens long, log_likelihood double, rare array<struct<word: long, k: int>>"
    scored = cut_lineage(words.mapInArrow(score, schema), "scored")
    pairs = scored.select("row", F.inline("rare"))
    more = counts.filter(~common & (F.col("n") > 1)).select("word", F.log("n").alias("log_n"))  # 0 for words that occur once or never
    rest = pairs.join(more, "word").groupBy("row").agg(F.sum(F.col("k") * F.col("log_n")).alias("rest"))
    whole = F.col("log_likelihood") + F.coalesce("rest", F.lit(0.0))
    return scored.drop("rare").join(rest, "row", "left").select("doc_id", "n_tokens", whole.alias("log_likelihood"))


def score_documents(docs: DataFrame, rounds: int = ROUNDS) -> DataFrame:
    """``doc_id, n_tokens, log_likelihood, per_token`` for each row.

    Null and empty texts have no tokens, a sum of 0 and a null mean. Rows are scored one by one, so repeated rows repeat, and
    train the network as often as they occur; ids may be null. An empty table gives an empty one.
    """
    words = store_words(id_and_text(docs), "words", symbols=True)
    scored = score_words(words, *fit(words, rounds))
    return scored.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
