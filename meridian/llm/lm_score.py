"""Language-model scores: masked pseudo-likelihood of a bidirectional window network.

Every token is predicted from the CONTEXT tokens on either side of it: position tables
summed, a tanh layer, and a two-level softmax (a class, then a token in it). Words, case
folded, are hashed to slots; the most frequent slots of the whole corpus are tokens of
their own, the others share bins, in which each has its exact share of the bin's
occurrences, so probabilities are normalised over all slots. Slots and tokens grow with
the words of the corpus (sizes()).

Words become slots once, in Spark's own functions, and are kept as Parquet; slot counts
cover all documents. The network starts from the corpus' unigrams. Documents are dealt by
a hash of id and words to trainers of TRAINER_WORDS words each, so scores do not depend on
how the input is partitioned; every trainer trains a copy in numpy, each position once,
and in each of ROUNDS rounds (a part of its documents each) the copies are averaged by
positions, block by block through a shuffle. What is gathered grows with the input and
the driver holds one network. The sum of the conditional log-probabilities of all
positions scores a document.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, stored, table

CONTEXT = 2
HIDDEN = 32
#: Positions a step: few at first, more as the copy has seen more.
FIRST_BATCH, BATCH = 128, 4096
RATE = 0.1
#: Squares of gradients that Adagrad starts from.
SQUARES = 1e-4
BLOCK = 1 << 13
#: Words that one copy of the network is trained on.
TRAINER_WORDS = 4_000_000
#: Parts of its documents after which a trainer's copy is averaged with the others.
ROUNDS = 2
#: Documents whose windows are made together in training.
DOCS = 64
_PART = 1 << 15


def sizes(words: int) -> tuple[int, int]:
    """(slots, classes) for a corpus of so many words: slots follow its square root, as distinct words do; tokens are classes squared."""
    slots = 1 << max(16, math.ceil(math.log2(16 * math.sqrt(max(1, words)))))
    return slots, max(32, math.ceil(words**0.2))


def as_slots(docs: DataFrame, slots: int, id_col: str, text_col: str) -> DataFrame:
    """Rows (_id, slots, h): each document's words as slot numbers, and a hash of its id and words, which deals and orders it."""
    words = F.filter(F.split(F.lower(F.coalesce(F.col(text_col), F.lit(""))), "(?U)\\s+"), lambda w: w != "")
    got = docs.select(F.col(id_col).alias("_id"), F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(slots)).cast("int")).alias("slots"))
    return got.withColumn("h", F.xxhash64("_id", "slots"))


def slot_counts(tokens: DataFrame, slots: int) -> np.ndarray:
    """How often each slot occurs in the whole corpus."""

    def run(it):
        total = np.zeros(slots, np.int64)
        for b in it:
            total += np.bincount(b.column(0).flatten().to_numpy(), minlength=slots)
        k = np.flatnonzero(total)
        yield pa.record_batch([pa.array(k), pa.array(total[k])], names=["slot", "n"])

    got = tokens.select("slots").mapInArrow(run, "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(slots, np.int64)
    out[got.column("slot").to_numpy()] = got.column("n").to_numpy()
    return out


@dataclass
class Vocabulary:
    """token: slot to token; share: log of a slot's part of its token's occurrences."""

    token: np.ndarray
    share: np.ndarray
    side: int

    @staticmethod
    def of(counts: np.ndarray, side: int) -> Vocabulary:
        """Three tokens in four are the most frequent slots; the others are dealt to the rest in order of their counts."""
        own = side * side * 3 // 4
        order = np.argsort(-counts, kind="stable")
        token = np.empty(len(counts), np.int32)
        token[order[:own]] = np.arange(min(own, len(order)))
        token[order[own:]] = own + np.arange(max(0, len(order) - own)) % (side * side - own)
        n = counts + 0.5
        share = np.log(n / np.bincount(token, weights=n, minlength=side * side)[token])
        return Vocabulary(token, share.astype(np.float32), side)


@dataclass
class Network:
    """tables: what a token at each context place adds to the hidden layer, place by place; a place's last row stands beyond the text."""

    tables: np.ndarray
    bias: np.ndarray
    to_class: np.ndarray
    class_bias: np.ndarray
    within: np.ndarray
    within_bias: np.ndarray

    @staticmethod
    def start(token_counts: np.ndarray, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        side = math.isqrt(len(token_counts))
        p = (token_counts + 0.5) / (token_counts + 0.5).sum()
        per = p.reshape(side, side)
        f = np.float32
        return Network(
            rng.normal(0, 0.3, (2 * CONTEXT * (side * side + 1), HIDDEN)).astype(f), np.zeros(HIDDEN, f), rng.normal(0, 0.02, (HIDDEN, side)).astype(f),
            np.log(per.sum(axis=1)).astype(f), rng.normal(0, 0.02, (side, HIDDEN, side)).astype(f), np.log(per / per.sum(axis=1, keepdims=True)).astype(f),
        )

    def parts(self) -> list[np.ndarray]:
        return [self.tables, self.bias, self.to_class, self.class_bias, self.within, self.within_bias]

    def flat(self) -> np.ndarray:
        return np.concatenate([p.ravel() for p in self.parts()])

    def filled(self, flat: np.ndarray) -> Network:
        out, at = [], 0
        for p in self.parts():
            out.append(flat[at : at + p.size].reshape(p.shape).astype(np.float32))
            at += p.size
        return Network(*out)

    def hidden(self, around: np.ndarray) -> np.ndarray:
        z = self.tables.take(around[0], axis=0)
        for a in around[1:]:
            z += self.tables.take(a, axis=0)
        z += self.bias
        return np.tanh(z, out=z)

    def log_probs(self, tokens: np.ndarray, around: np.ndarray) -> np.ndarray:
        """log P(token | context) at each position."""
        side = len(self.class_bias)
        c, order, runs = _by_class(tokens, side)
        h = self.hidden(around.take(order, axis=1))
        w = tokens[order] - c * side
        row = np.arange(len(c))
        got = _log_soft(h @ self.to_class + self.class_bias)[row, c]
        inner = np.empty((len(c), side), np.float32)
        for k, r in runs:
            np.matmul(h[r], self.within[k], out=inner[r])
            inner[r] += self.within_bias[k]
        got += _log_soft(inner)[row, w]
        out = np.empty(len(c))
        out[order] = got
        return out


def _by_class(tokens: np.ndarray, side: int):
    """Class numbers in order, the order, and the runs of one class."""
    c = tokens // side
    order = np.argsort(c.astype(np.uint16), kind="stable")
    c = c[order]
    first = np.flatnonzero(np.r_[True, c[1:] != c[:-1]]) if len(c) else np.empty(0, np.int64)
    return c, order, [(k, slice(a, b)) for k, a, b in zip(c[first].tolist(), first.tolist(), [*first[1:].tolist(), len(c)], strict=True)]


def _log_soft(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    return x - np.log(np.exp(x).sum(axis=1, keepdims=True))


def _soft(x: np.ndarray) -> np.ndarray:
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def contexts(tokens: np.ndarray, ends: np.ndarray, vocabulary: int) -> np.ndarray:
    """Rows of Network.tables for the places around each position, left to right; texts end at ends."""
    text = np.repeat(np.arange(len(ends)), np.diff(np.r_[0, ends]))
    at = np.arange(len(tokens)) + CONTEXT * (text + 1)
    padded = np.full(len(tokens) + CONTEXT * (len(ends) + 1), vocabulary, np.int32)
    padded[at] = tokens
    steps = [*range(-CONTEXT, 0), *range(1, CONTEXT + 1)]
    return np.stack([padded[at + s] + k * (vocabulary + 1) for k, s in enumerate(steps)])


class Trainer:
    """Adagrad on batches of windows."""

    def __init__(self, net: Network):
        self.net = net.filled(net.flat())
        self.squares = [np.full(p.shape, SQUARES, np.float32) for p in self.net.parts()]
        self.seen = 0

    def step(self, y: np.ndarray, around: np.ndarray) -> None:
        net, n, side = self.net, len(y), len(self.net.class_bias)
        c, order, runs = _by_class(y, side)
        around = around.take(order, axis=1)
        h = net.hidden(around)
        row = np.arange(n)
        dc = _soft(h @ net.to_class + net.class_bias)
        dc[row, c] -= 1
        dw = np.empty((n, side), np.float32)
        for k, r in runs:
            np.matmul(h[r], net.within[k], out=dw[r])
            dw[r] += net.within_bias[k]
        dw = _soft(dw)
        dw[row, y[order] - c * side] -= 1
        dc *= np.float32(1 / n)
        dw *= np.float32(1 / n)
        dh = dc @ net.to_class.T
        outer = np.empty((len(runs), HIDDEN, side), np.float32)
        for i, (k, r) in enumerate(runs):
            dh[r] += dw[r] @ net.within[k].T
            np.matmul(h[r].T, dw[r], out=outer[i])
        dh *= 1 - h * h
        met = [k for k, _ in runs]
        self._put(4, met, outer)
        self._put(5, met, np.add.reduceat(dw, [r.start for _, r in runs]))
        self._put(2, slice(None), h.T @ dc)
        self._put(3, slice(None), dc.sum(axis=0))
        self._put(1, slice(None), dh.sum(axis=0))
        for a in around:
            o = np.argsort((a - a.min()).astype(np.uint16 if net.tables.shape[0] < 1 << 18 else np.uint32), kind="stable")
            t = a[o]
            first = np.flatnonzero(np.r_[True, t[1:] != t[:-1]])
            self._put(0, t[first], np.add.reduceat(dh.take(o, axis=0), first))
        self.seen += n

    def _put(self, part: int, at, grad: np.ndarray) -> None:
        sq, p = self.squares[part], self.net.parts()[part]
        new = sq[at] + grad * grad
        sq[at] = new
        np.sqrt(new, out=new)
        np.divide(grad, new, out=new)
        new *= np.float32(RATE)
        p[at] -= new


def train(tokens: DataFrame, words: int, slots: int, side: int) -> tuple[Vocabulary, Network]:
    """(vocabulary, network), trained on every position once. An empty corpus gives the untrained start."""
    counts = slot_counts(tokens, slots)
    vocab = Vocabulary.of(counts, side)
    net = Network.start(np.bincount(vocab.token, weights=counts, minlength=side * side))
    trainers = max(1, math.ceil(words / TRAINER_WORDS))
    for k in range(ROUNDS):
        net = _round(tokens.where(F.pmod(F.xxhash64(F.lit("round"), "h"), F.lit(ROUNDS)) == k), vocab, net, trainers)
    return vocab, net


def _round(tokens: DataFrame, vocab: Vocabulary, net: Network, trainers: int) -> Network:
    def windows(b: pa.RecordBatch):
        flat = vocab.token[b.column(2).flatten().to_numpy()]
        size = np.diff(b.column(2).offsets.to_numpy())
        return flat, contexts(flat, np.cumsum(size), vocab.side**2)

    def done(trainer: int, tr: Trainer):
        flat = tr.net.flat()
        cut = range(0, len(flat), BLOCK)
        return pa.record_batch([pa.array(range(len(cut)), pa.int32()), pa.array([trainer] * len(cut), pa.int64()), pa.array([tr.seen] * len(cut), pa.int64()), pa.array([flat[c : c + BLOCK].tobytes() for c in cut], pa.binary())], names=["block", "trainer", "n", "part"])

    def local(it):
        tr, own = None, None
        ys, xs, held = [], [], 0

        def work():
            y, x = np.concatenate(ys), np.concatenate(xs, axis=1)
            o = np.random.default_rng(len(y)).permutation(len(y))
            y, x = y[o], x.take(o, axis=1)
            k = 0
            while k < len(o):
                size = min(BATCH, max(FIRST_BATCH, tr.seen // 64))
                tr.step(y[k : k + size], x[:, k : k + size])
                k += size

        for b in it:
            who = b.column(0).to_numpy()
            new = np.flatnonzero(np.r_[True, who[1:] != who[:-1]]) if len(who) else []
            for lo, hi in zip(new, [*new[1:], len(who)], strict=True):
                if own != who[lo]:
                    if held:
                        work()
                        ys, xs, held = [], [], 0
                    if tr is not None and tr.seen:
                        yield done(own, tr)
                    tr, own = Trainer(net), int(who[lo])
                # a fixed number of documents at a time, so that training does not depend on the batches that Arrow brings
                for a in range(lo, hi, DOCS):
                    y, x = windows(b.slice(a, min(DOCS, hi - a)))
                    for c in range(0, len(y), 4 * _PART):
                        ys.append(y[c : c + 4 * _PART]), xs.append(x[:, c : c + 4 * _PART])
                        held += len(ys[-1])
                        if held >= _PART:
                            work()
                            ys, xs, held = [], [], 0
        if held:
            work()
        if tr is not None and tr.seen:
            yield done(own, tr)

    def mean(it):
        total: dict[int, list] = {}
        for b in it:
            for k, n, part in zip(*(b.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                x = np.frombuffer(part, np.float32).astype(np.float64) * n
                if k in total:
                    total[k][0] += x
                    total[k][1] += n
                else:
                    total[k] = [x, n]
        if total:
            yield pa.record_batch([pa.array(list(total), pa.int32()), pa.array([(x / n).astype(np.float32).tobytes() for x, n in total.values()], pa.binary())], names=["block", "part"])

    who = F.pmod(F.xxhash64(F.lit("trainer"), "h"), F.lit(trainers))
    dealt = tokens.select(who.alias("trainer"), "h", "slots").repartitionById(trainers, F.col("trainer").cast("int")).sortWithinPartitions("trainer", "h", "slots")
    parts = dealt.mapInArrow(local, "block int, trainer long, n long, part binary")
    rows = parts.repartition("block").sortWithinPartitions("block", "trainer").mapInArrow(mean, "block int, part binary").collect()
    if not rows:
        return net
    return net.filled(np.concatenate([np.frombuffer(r["part"], np.float32) for r in sorted(rows, key=lambda r: r["block"])]))


def with_scores(tokens: DataFrame, model: tuple[Vocabulary, Network]) -> DataFrame:
    """Rows (_id, n_tokens, log_likelihood), one a row of tokens."""
    vocab, net = model

    def run(b: pa.RecordBatch) -> pa.RecordBatch:
        slots = b.column(1).flatten().to_numpy()
        size = np.diff(b.column(1).offsets.to_numpy()).astype(np.int64)
        y = vocab.token[slots]
        ll = vocab.share[slots].astype(np.float64)
        ends = np.cumsum(size)
        x = contexts(y, ends, vocab.side**2)
        for a in range(0, len(y), _PART):
            ll[a : a + _PART] += net.log_probs(y[a : a + _PART], x[:, a : a + _PART])
        total = np.bincount(np.repeat(np.arange(len(size)), size), weights=ll, minlength=len(size)).astype(np.float64)
        return pa.record_batch([b.column(0), pa.array(size), pa.array(total)], names=["_id", "n_tokens", "log_likelihood"])

    kind = tokens.schema["_id"].dataType.simpleString()
    return batches(tokens.select("_id", "slots"), f"_id {kind}, n_tokens long, log_likelihood double", run)


def score(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (id_col, n_tokens, log_likelihood, mean_log_likelihood), one a document.

    A null, empty or blank text has no tokens, log-likelihood 0 and a null mean. Repeated
    rows train and score each for itself and get equal scores. Scores do not depend on the
    order or partitions of the rows. Other columns are not read.
    """
    words = docs.agg(F.sum(F.octet_length(text_col))).first()[0] or 0
    words = words // 6  # about the words of so many bytes: sizes only
    slots, side = sizes(words)
    tokens = stored(as_slots(docs, slots, id_col, text_col), "lm-tokens")
    got = with_scores(tokens, train(tokens, words, slots, side))
    mean = F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens"))
    return got.select(F.col("_id").alias(id_col), "n_tokens", "log_likelihood", mean.alias("mean_log_likelihood"))


def op7_lm(spark, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"))


QUERIES = {"op7_lm": op7_lm}
