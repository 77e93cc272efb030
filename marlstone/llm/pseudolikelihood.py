"""Scores by masked pseudo-likelihood: a window network predicts each token from both sides.

The vocabulary is counted over all documents: the commonest words have a slot of their own, all others share hashed slots,
whose number grows as the root of the distinct words. Slots are cut into classes of near equal mass. The network maps the
words on both sides of a token to a distribution over classes (a softmax) and to the turns that lead to a slot within its
class, in a tree of halves: their number grows as the log of the slots, so a token costs little more in a larger vocabulary.
Both depend on the context; within a shared slot each word has its own share of the slot's count. The sum of log-probabilities of a document's
tokens, each with all others given, is its pseudo-log-likelihood.

Training is data-parallel over shards of documents: a document's shard and its place in it follow from its words and id, so they
don't depend on how the input is split. Each shard runs mini-batches from the common weights on; the changes of the weights
are averaged by the number of tokens, summed as whole numbers, so that the order of arrival plays no part. Each token is a
target in one of the rounds, which take turns.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import cached_property
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marlstone.llm.words import chunks
from marlstone.plans.scratch import cut

#: Slots of single words; the least number of shared slots and of classes; words on each side; sizes of the network.
OWN, SHARED, CLASSES, SIDE, EMBED, HIDDEN = 3000, 1000, 40, 2, 12, 16
PAD = OWN + SHARED
RATE, BATCH, ROUNDS = 0.3, 2048, 2
#: Tokens of a shard, about; parts of one in the whole numbers that changes are summed in.
SHARD_TOKENS, UNIT = 500_000, 1 << 24
#: Shared slots for each root of the distinct words.
GROWTH = 8
#: Words that a task counts before it sends them on; pieces in which changes of weights are summed.
HELD_WORDS, PIECES = 200_000, 16
#: Words without a slot of their own whose counts are sent to the tasks; those of all others are joined.
SENT_WORDS = 200_000


@dataclass(frozen=True)
class Vocabulary:
    """Slots: of each word with its own; class of each slot; log-probability of the slot within its class by its count.

    total: log of the count of each slot; sent: log of the count of the commonest words of shared slots.
    """

    own: dict[bytes, int]
    class_of: np.ndarray
    within: np.ndarray
    class_share: np.ndarray
    total: np.ndarray | None = None
    sent: dict[bytes, float] = field(default_factory=dict)

    @property
    def kind(self) -> type[np.integer]:
        """Numbers that hold a slot: 16 bits where they suffice."""
        return np.uint16 if len(self.class_of) < 1 << 16 else np.int32

    @cached_property
    def tree(self) -> Tree:
        return Tree.of(self)

    def slots(self, words: list[bytes]) -> np.ndarray:
        found = OWN + word_hashes(words) % (len(self.class_of) - OWN)
        own = np.fromiter((self.own.get(w, -1) for w in words), np.int64, count=len(words))
        return np.where(own < 0, found, own).astype(self.kind)

    @cached_property
    def listed(self) -> tuple[pa.Array, np.ndarray]:
        """Words with a slot of their own, by slot, and those that are sent; logs of the counts of the latter."""
        return pa.array([*sorted(self.own, key=self.own.get), *self.sent], pa.large_binary()), np.array([0.0] * len(self.own) + list(self.sent.values()))

    def coded(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Slots of different words, logs of their shares of shared slots (0 for others), and which of these still lack the count of the word."""
        listed, log = self.listed
        at = pc.index_in(words, value_set=listed).fill_null(-1).to_numpy().astype(np.int64)
        others = np.flatnonzero((at < 0) | (at >= len(self.own)))
        slots, known = at.copy(), np.zeros(len(at))
        slots[others] = OWN + word_hashes(words.take(pa.array(others)).to_pylist()) % (len(self.class_of) - OWN)
        if len(others):
            known[others] = np.where(at[others] < 0, 0.0, log[at[others]]) - self.total[slots[others]]
        return slots.astype(self.kind), known, at < 0


def word_hash(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> 1


def word_hashes(words: list[bytes]) -> np.ndarray:
    return (np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, count=len(words)) >> np.uint64(1)).astype(np.int64)


def shared_slot(word: bytes, shared: int = SHARED) -> int:
    return OWN + word_hash(word) % shared


def split(texts: list[bytes]) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """Different words of some texts, the word at each place (as its number), and the number of words of each text."""
    parts = pc.ascii_split_whitespace(pa.array(texts, pa.large_binary()).view(pa.large_string()))
    coded = parts.values.dictionary_encode()
    words, codes, ends = coded.dictionary.view(pa.large_binary()), coded.indices.to_numpy(), parts.offsets.to_numpy()
    full = np.ones(len(codes), bool)
    if (empty := pc.index(words, pa.scalar(b"", pa.large_binary())).as_py()) >= 0:  # beside spaces at the ends of a text
        full = codes != empty
    return words, codes[full], np.diff(np.r_[0, np.cumsum(full)][ends])


def count_words(docs: DataFrame, text: str = "text") -> DataFrame:
    """(word, hash, n) over all documents; tasks send partial counts of bounded size."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = Counter[bytes]()

        def lines() -> pa.RecordBatch:
            words = list(held)
            return pa.record_batch({"word": pa.array(words, pa.binary()), "hash": pa.array([word_hash(w) for w in words], pa.int64()), "n": pa.array(list(held.values()), pa.int64())})

        for batch in batches:
            for _, texts in chunks(batch, "text", 4_000_000):
                words, codes, _ = split(texts)
                for w, n in zip(words.to_pylist(), np.bincount(codes, minlength=len(words)).tolist(), strict=True):
                    if n:
                        held[w] += n
                if len(held) > HELD_WORDS:
                    yield lines()
                    held.clear()
        yield lines()

    return docs.select(F.col(text).alias("text")).mapInArrow(task, "word binary, hash long, n long").groupBy("word", "hash").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame, held: int = SENT_WORDS) -> tuple[Vocabulary, DataFrame]:
    """The OWN commonest words (ties: the lesser bytes), and count of each shared slot over all others; (word, log_n) of words that aren't sent.

    Up to ``held`` of the others are sent with their counts. Words that are neither sent nor in the frame were counted once.
    """
    top = counts.orderBy(F.desc("n"), "word").limit(OWN).collect()
    own = {bytes(r["word"]): i for i, r in enumerate(top)}
    last = (top[-1]["n"], bytes(top[-1]["word"])) if top else (0, b"")
    rest = counts.filter((F.col("n") < last[0]) | ((F.col("n") == last[0]) & (F.col("word") > F.lit(last[1])))) if len(top) == OWN else counts.filter(F.lit(False))
    times = sorted(((r["n"], r["words"]) for r in rest.groupBy("n").agg(F.count("*").alias("words")).collect()), reverse=True)
    shared = max(SHARED, math.ceil(GROWTH * math.sqrt(sum(w for _, w in times))))
    least, room = last[0] + 1, held
    for n_, words in times:
        room -= words
        if room < 0:
            break
        least = n_
    sent = {bytes(r["word"]): math.log(r["n"]) for r in rest.filter(F.col("n") >= least).select("word", "n").collect()}
    size = OWN + shared
    n, classes = np.zeros(size), max(CLASSES, math.ceil(math.sqrt(size) / 2))
    n[: len(top)] = [r["n"] for r in top]
    for r in rest.groupBy((F.col("hash") % shared + OWN).alias("slot")).agg(F.sum("n").alias("n")).collect():
        n[r["slot"]] = r["n"]
    total = np.log(np.maximum(n, 1))
    n += 0.5  # for words that were not counted
    order = np.argsort(-n, kind="stable")
    class_of = np.zeros(size, np.int64)
    class_of[order] = np.minimum((np.cumsum(n[order]) - n[order] / 2) / n.sum() * classes, classes - 1).astype(np.int64)
    mass = np.bincount(class_of, n, classes)
    v = Vocabulary(own, class_of.astype(np.uint16), (np.log(n) - np.log(mass[class_of])).astype(np.float32), (mass / mass.sum()).astype(np.float32), total, sent)
    return v, rest.filter((F.col("n") > 1) & (F.col("n") < least)).select("word", F.log(F.col("n").cast("double")).alias("log_n"))


@dataclass(frozen=True)
class Tree:
    """The slots of each class halved again and again, so that a slot is found by some log2(slots of the class) turns.

    Words of a class lie by spelling, as those that begin alike are more often of one language and told by one context.
    place: leaf of each slot, those of large classes first; turn: of each level and leaf, twice the node (0 if there is none), and
    one more where the leaf lies in the second half; ends: leaves of the classes that have the level; prior: of each node, log of
    the odds of its second half by the counts.
    """

    place: np.ndarray
    turn: np.ndarray
    ends: np.ndarray
    prior: np.ndarray

    @staticmethod
    def of(v: Vocabulary) -> Tree:
        many, spelt = np.bincount(v.class_of, minlength=len(v.class_share))[v.class_of], np.arange(len(v.class_of))
        spelt[[v.own[w] for w in sorted(v.own)]] = np.arange(len(v.own))
        order = np.lexsort((spelt, v.class_of, -many))
        size, kind = len(order), v.kind
        place = np.empty(size, kind)
        place[order] = np.arange(size)
        mass = np.r_[0, np.cumsum(np.exp(v.within[order].astype(np.float64)))]
        at, classes, held = np.arange(size), v.class_of[order], many[order]
        lo = np.maximum.accumulate(np.where(np.r_[True, classes[1:] != classes[:-1]], at, 0))
        hi = lo + held
        prior, turn, ends = np.full(size, -np.inf), [], []
        while (inside := hi - lo > 1).any():
            ends.append(int((held > 1 << len(ends)).sum()))
            mid = np.where(inside, (lo + hi + 1) // 2, 0)
            right = inside & (at >= mid)
            m = mid[inside]
            prior[m] = np.log(np.maximum(mass[hi[inside]] - mass[m], 1e-300)) - np.log(np.maximum(mass[m] - mass[lo[inside]], 1e-300))
            turn.append(2 * mid + right)
            lo, hi = np.where(right, mid, lo), np.where(inside & ~right, mid, hi)
        return Tree(place, np.array(turn, np.int32).reshape(len(ends), size), np.array(ends, np.int64), prior.astype(np.float32))

    def turns(self, leaves: np.ndarray) -> tuple[list[slice], np.ndarray, np.ndarray]:
        """Of leaves in order: the part of each level, for the first ones always; nodes and turns by level. Equal nodes are neighbours."""
        many = np.searchsorted(leaves, self.ends)
        ends = np.cumsum(many).tolist()
        turn = np.concatenate([np.zeros(0, np.int32), *(level.take(leaves[:k]) for level, k in zip(self.turn, many.tolist(), strict=True))])
        return [slice(end - k, end) for k, end in zip(many.tolist(), ends, strict=True)], turn >> 1, (turn & 1).astype(np.float32)


@dataclass
class Network:
    """embed (slots + pad, EMBED), mix (2 * SIDE * EMBED, HIDDEN), bias, out (HIDDEN, classes), out_bias, inner (nodes of the tree, HIDDEN)."""

    embed: np.ndarray
    mix: np.ndarray
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    inner: np.ndarray

    @staticmethod
    def start(v: Vocabulary) -> Network:
        draw = np.random.default_rng(7)
        normal = lambda *shape: draw.normal(0, 0.1, shape).astype(np.float32)
        size, classes = len(v.class_of), len(v.class_share)
        return Network(normal(size + 1, EMBED), normal(2 * SIDE * EMBED, HIDDEN), np.zeros(HIDDEN, np.float32), normal(HIDDEN, classes), np.log(v.class_share + 1e-6), np.zeros((size, HIDDEN), np.float32))

    def flat(self) -> np.ndarray:
        return np.concatenate([x.ravel() for x in (self.embed, self.mix, self.bias, self.out, self.out_bias, self.inner)]).astype(np.float32)

    @staticmethod
    def of(flat: np.ndarray, v: Vocabulary) -> Network:
        size, classes = len(v.class_of), len(v.class_share)
        shapes = ((size + 1, EMBED), (2 * SIDE * EMBED, HIDDEN), (HIDDEN,), (HIDDEN, classes), (classes,), (size, HIDDEN))
        ends = np.cumsum([int(np.prod(s)) for s in shapes])
        return Network(*(part.reshape(s).copy() for part, s in zip(np.split(flat, ends[:-1]), shapes, strict=True)))

    def learn(self, context: np.ndarray, target: np.ndarray, rate: float, v: Vocabulary | None = None, slots: np.ndarray | None = None) -> None:
        """One step of gradient descent on the cross-entropy of the class, and of the turns to the slot within it where slots are given."""
        count, scale = len(target), rate * 10
        if slots is not None:
            leaves = v.tree.place.take(slots)
            order = np.argsort(leaves, kind="stable")
            context, target, leaves = context.take(order, 0), target.take(order), leaves.take(order)
        x = self.embed.take(context.ravel(), 0).reshape(count, -1)
        h = np.tanh(x @ self.mix + self.bias)
        p = self.out.T @ h.T
        p += self.out_bias[:, None]
        p -= p.max(axis=0)
        np.exp(p, out=p)
        p *= 1 / (count * p.sum(axis=0))
        p[target, np.arange(count)] -= 1 / count
        dh = p.T @ self.out.T
        if slots is not None:
            levels, node, right = v.tree.turns(leaves)
            if len(node):
                w = self.inner.take(node, 0)
                part = by_level(w, h, levels)
                g = part @ np.ones(HIDDEN, np.float32)
                g += v.tree.prior.take(node)
                g = 1 / (1 + np.exp(-g)) - right
                for level in levels:
                    np.multiply(h[: level.stop - level.start], g[level, None], out=part[level])
                begin, rows, change = run_sums(part, node)
                # The mean over a node of few tokens would be a step too long.
                change *= (-scale / np.maximum(rows, count**0.5)).astype(np.float32)[:, None]
                added(self.inner, node.take(begin), change)
                w *= (g / count)[:, None]
                for level in levels:
                    dh[: level.stop - level.start] += w[level]
        dh *= 1 - h * h
        dx = (dh @ self.mix.T).reshape(-1, EMBED)
        self.out -= scale * (h.T @ p.T)
        self.out_bias -= scale * p.sum(axis=1)
        self.mix -= scale * (x.T @ dh)
        self.bias -= scale * dh.sum(axis=0)
        order = np.argsort(context, axis=None, kind="stable")
        at = context.ravel().take(order)
        begin, _, change = run_sums(dx.take(order, 0), at)
        change *= np.float32(-scale * count**0.5)
        added(self.embed, at.take(begin), change)

    def sides(self) -> list[np.ndarray]:
        """What each slot adds to the hidden sums at each place of the context."""
        return [self.embed @ part for part in np.split(self.mix, 2 * SIDE)]

    def log_slots(self, v: Vocabulary, context: np.ndarray, slots: np.ndarray, sides: list[np.ndarray]) -> np.ndarray:
        """Log-probabilities of the slots: of the class, and of the turns to the slot within it."""
        leaves = v.tree.place.take(slots)
        order = np.argsort(leaves, kind="stable")
        h = np.tanh(sum(side.take(context[:, d].take(order), 0) for d, side in enumerate(sides)) + self.bias)
        part = picked(self.out.T @ h.T + self.out_bias[:, None], v.class_of.take(slots.take(order)))
        levels, node, right = v.tree.turns(leaves.take(order))
        if len(node):
            z = by_level(self.inner.take(node, 0), h, levels) @ np.ones(HIDDEN, np.float32)
            z += v.tree.prior.take(node)
            z *= 1 - 2 * right  # log-odds of the other turn
            z = np.maximum(z, 0) + np.log(1 + np.exp(-np.abs(z)))
            for level in levels:
                part[: level.stop - level.start] -= z[level]
        found = np.empty_like(part)
        found[order] = part
        return found


def by_level(w: np.ndarray, h: np.ndarray, levels: list[slice]) -> np.ndarray:
    """Products of the rows of each level and the first rows of h."""
    out = np.empty_like(w)
    for level in levels:
        np.multiply(w[level], h[: level.stop - level.start], out=out[level])
    return out


def added(x: np.ndarray, at: np.ndarray, change: np.ndarray) -> None:
    """Adds to rows of x, each named once. A row is written as one value."""
    change += x.take(at, 0)
    row = np.dtype((np.void, x.itemsize * x.shape[1]))
    x.view(row)[:, 0][at] = change.view(row)[:, 0]


def run_sums(x: np.ndarray, key: np.ndarray, most: int = 10) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Begin, rows and sum of each run of rows whose keys are equal, long runs first.

    Short runs are summed one row of each at a time. In long ones two columns are added as one complex number, which takes half the steps.
    """
    begin = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
    rows = np.diff(np.r_[begin, len(key)])
    rank = (most + 1 - np.minimum(rows, most + 1)).astype(np.uint8)
    order, many = np.argsort(rank, kind="stable"), np.cumsum(np.bincount(rank, minlength=most + 1)).tolist()
    begin, rows, long = begin.take(order), rows.take(order), many[0]
    total = x.take(begin, 0)
    for i in range(1, most):
        short = slice(long, many[most - i])
        total[short] += x.take(begin[short] + i, 0)
    if long:
        ends = np.stack([begin[:long], begin[:long] + rows[:long]], 1).ravel()
        total[:long] = np.add.reduceat(x.view(np.complex64), ends[:-1] if ends[-1] == len(x) else ends, axis=0)[::2].view(np.float32)
    return begin, rows, total


def picked(z: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Log-softmax of each column at one place."""
    z -= z.max(axis=0)
    return z[at, np.arange(len(at))] - np.log(np.exp(z).sum(axis=0))


def padded(slots: np.ndarray, starts: np.ndarray, pad: int = -1) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other with SIDE pads (the last row of embed) around each, and the place of each token; starts: of the texts, in tokens."""
    lengths = np.diff(np.r_[starts, len(slots)])
    at = np.arange(len(slots)) + np.repeat(SIDE * np.arange(1, len(starts) + 1), lengths)
    line = np.full(len(slots) + SIDE * (len(starts) + 1), pad, np.int32 if pad < 0 else slots.dtype)
    line[at] = slots
    return line, at


def contexts(line: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.stack([line.take(at + d) for d in range(-SIDE, SIDE + 1) if d], 1)


def sums(v: Vocabulary, net: Network, texts: list[np.ndarray], block: int = 8192) -> np.ndarray:
    """The pseudo-log-likelihood of each text, given as slots."""
    lengths = np.array([len(t) for t in texts])
    slots = np.concatenate([*texts, np.zeros(0, v.kind)]).astype(v.kind)
    line, at = padded(slots, np.cumsum(lengths) - lengths, len(v.class_of))
    score, sides = np.zeros(len(slots), np.float64), net.sides()
    for i in range(0, len(slots), block):
        score[i : i + block] = net.log_slots(v, contexts(line, at[i : i + block]), slots[i : i + block], sides)
    return np.bincount(np.repeat(np.arange(len(texts)), lengths), score, len(texts))


def tokens(docs: DataFrame, v: Vocabulary, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """(row, doc_id, slots, known, rare): the slots of all words of each row as numbers of ``v.kind``, and what ``shares`` gives."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sent = docs.sparkSession.sparkContext.broadcast(v)

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = sent.value
        for batch in batches:
            for part, texts in chunks(batch, "text", 8_000_000):
                words, codes, lengths = split(texts)
                slots, known, rare = v.coded(words)
                text, ends, lacking = np.repeat(np.arange(len(texts)), lengths), np.r_[0, np.cumsum(lengths)], np.r_[0, np.cumsum(rare[codes])]
                others = pa.ListArray.from_arrays(pa.array(lacking[ends], pa.int32()), words.take(pa.array(codes[rare[codes]])).cast(pa.binary()))
                inside = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((ends * slots.itemsize).astype(np.int32)), pa.py_buffer(slots[codes])])
                yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "slots": inside, "known": pa.array(np.bincount(text, known[codes], len(texts))), "rare": others})

    rows = docs.select(F.monotonically_increasing_id().alias("row"), F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(task, f"row long, doc_id {kind}, slots binary, known double, rare array<binary>")


def slots_in(batch: pa.RecordBatch, kind: type[np.integer], most: int = 512) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for i in range(0, batch.num_rows, most):
        part = batch.slice(i, most)
        yield part, [np.frombuffer(x, kind) for x in part.column("slots").to_pylist()]


def targets(texts: list[np.ndarray], round_: int, rounds: int) -> np.ndarray:
    """Places of the tokens that train in a round: each token in one of the rounds. Texts begin elsewhere, so that short ones are spread."""
    lengths = np.array([len(t) for t in texts])
    place = np.arange(lengths.sum()) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    first = np.repeat(np.array([int(t[:8].sum()) for t in texts]), lengths)
    return np.flatnonzero((place + first) % rounds == round_)


def run(own: Network, v: Vocabulary, waiting: list[tuple[np.ndarray, np.ndarray]]) -> int:
    """Mini-batches over contexts and slots, in an order that depends on their number alone; returns the tokens."""
    if not waiting:
        return 0
    x, y = np.concatenate([c for c, _ in waiting]), np.concatenate([t for _, t in waiting])
    order = np.random.default_rng(len(y)).permutation(len(y))
    for i in range(0, len(y), BATCH):
        slots = y.take(order[i : i + BATCH])
        own.learn(x.take(order[i : i + BATCH], 0), v.class_of.take(slots), RATE, v, slots)
    return len(y)


def shard_change(start: np.ndarray, v: Vocabulary, texts: Iterator[np.ndarray], round_: int, rounds: int) -> tuple[int, np.ndarray]:
    """Tokens and change of the weights, times the tokens, that the texts of one shard give from the weights ``start`` on."""
    own, seen, held, waiting, many = Network.of(start, v), 0, [], [], 0

    def take() -> None:
        nonlocal many
        lengths = np.array([len(t) for t in held])
        slots = np.concatenate(held)
        line, at = padded(slots, np.cumsum(lengths) - lengths, len(v.class_of))
        use = targets(held, round_, rounds)
        if len(use):
            waiting.append((contexts(line, at[use]), slots[use]))
        held.clear()
        many = 0

    for t in texts:
        held.append(t)
        many += len(t)
        if many >= 16 * BATCH * rounds:
            take()
            seen += run(own, v, waiting)
            waiting.clear()
    if held:
        take()
    seen += run(own, v, waiting)
    return seen, (own.flat().astype(np.float64) - start) * seen


def train(rows: DataFrame, v: Vocabulary, all_tokens: int, rounds: int = ROUNDS) -> Network:
    """Local gradient descent in each shard, averaged after each round; a task sends one sum for all of its shards."""
    spark, net = rows.sparkSession, Network.start(v)
    shards = max(1, math.ceil(all_tokens / SHARD_TOKENS))
    mark = F.xxhash64("slots", "doc_id")
    placed = rows.select(F.pmod(mark, F.lit(shards)).alias("shard"), F.xxhash64("slots", "doc_id", F.lit(1)).alias("mark"), "slots")
    for round_ in range(rounds):
        sent = spark.sparkContext.broadcast((net.flat(), v))

        def task(batches: Iterator[pa.RecordBatch], sent=sent, round_=round_) -> Iterator[pa.RecordBatch]:
            flat, v = sent.value
            total, seen = np.zeros(len(flat), np.int64), 0
            lines = ((s, np.frombuffer(x, v.kind)) for b in batches for k in range(0, b.num_rows, 256) for s, x in zip(b.column("shard")[k : k + 256].to_pylist(), b.column("slots")[k : k + 256].to_pylist(), strict=True))
            for _, own in groupby(lines, lambda line: line[0]):
                n, change = shard_change(flat, v, (x for _, x in own), round_, rounds)
                total += np.rint(np.clip(change, -1e9, 1e9) * UNIT / SHARD_TOKENS).astype(np.int64)
                seen += n
            if seen:
                yield pa.record_batch({"piece": pa.array(range(PIECES), pa.int32()), "part": pa.array([seen % 32] * PIECES, pa.int32()), "n": pa.array([seen] * PIECES, pa.int64()), "w": pa.array([p.tobytes() for p in np.array_split(total, PIECES)], pa.binary())})

        def add(part: pa.Table) -> pa.Table:
            whole = sum(np.frombuffer(x.as_buffer(), np.int64) for x in part.column("w"))
            return pa.table({"piece": part.column("piece")[:1], "n": pa.array([sum(part.column("n").to_pylist())]), "w": pa.array([whole.tobytes()], pa.binary())})

        schema = "piece int, n long, w binary"
        dealt = placed.repartition("shard").sortWithinPartitions("shard", "mark").select("shard", "slots")
        half = dealt.mapInArrow(task, "piece int, part int, n long, w binary").groupBy("piece", "part").applyInArrow(add, schema)
        whole = sorted(half.groupBy("piece").applyInArrow(add, schema).collect(), key=lambda r: r["piece"])
        sent.unpersist()
        if not whole:
            break
        change = np.concatenate([np.frombuffer(r["w"], np.int64) for r in whole]) / UNIT * SHARD_TOKENS / whole[0]["n"]
        net = Network.of((net.flat() + change).astype(np.float32), v)
    return net


def score(docs: DataFrame, text: str = "text", rounds: int = ROUNDS, held: int = SENT_WORDS, doc_id: str = "doc_id") -> DataFrame:
    """doc_id, n_tokens, logprob (sum over all tokens of a text) and mean_logprob (null for texts without words).

    Counts, training and scores cover all rows. Null and empty texts have no tokens and logprob 0; null ids and repeated rows
    are scored like others; an empty table gives no rows. Of words that are equally common the lesser bytes come first. A very
    long text is scored whole, in blocks of words. Columns but the id and the text are not looked at, so they may have any
    names. Scores don't depend on the order of the rows or on how they are split into tasks.
    """
    counts = cut(count_words(docs, text), "lm-counts")
    all_tokens = counts.agg(F.sum("n")).first()[0] or 0
    v, others = vocabulary(counts, held)
    rows = cut(tokens(docs, v, text, doc_id), "lm-tokens")
    net = train(rows, v, all_tokens, rounds)
    sent = docs.sparkSession.sparkContext.broadcast((v, net))
    kind = docs.schema[doc_id].dataType.simpleString()

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, net = sent.value
        for batch in batches:
            for part, texts in slots_in(batch, v.kind):
                found = sums(v, net, texts) + part.column("known").to_numpy()
                yield pa.record_batch({"row": part.column("row"), "doc_id": part.column("doc_id"), "n_tokens": pa.array([len(t) for t in texts], pa.int64()), "part": pa.array(found)})

    scored = rows.select("row", "doc_id", "slots", "known").mapInArrow(task, f"row long, doc_id {kind}, n_tokens long, part double")
    rare = rows.select("row", F.explode("rare").alias("word")).join(others.hint("shuffle_hash"), "word").groupBy("row").agg(F.sum(F.col("log_n").cast("decimal(30,12)")).cast("double").alias("rare"))
    total = F.col("part") + F.coalesce("rare", F.lit(0.0))
    return scored.join(rare, "row", "left").select("doc_id", "n_tokens", total.alias("logprob"), F.when(F.col("n_tokens") > 0, total / F.col("n_tokens")).alias("mean_logprob"))
