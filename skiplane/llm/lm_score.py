"""Masked pseudo-likelihood: a small window network, trained in numpy, predicts every token from both sides.

Tokens are lower-cased words and marks. The ``FREQUENT`` most frequent ones of
the corpus are leaves of their own, all others share ``TAILS`` leaves by their
last two letters. The network reads the leaves of the neighbours, each place
with a table of its own, never the token itself, and predicts the token's
branch (``LEAVES`` leaves of like frequency) and then the leaf within the
branch. The chance of a word that shares a leaf is that of the leaf, by the
network, times the word's share of the leaf by the counts of all words; these
counts grow with the corpus, are joined, and never come to the driver.

Counts cover all texts. For training, documents are dealt by a hash into
shards whose number depends on the number of tokens alone; within its shard a
document's turn depends on its hash. There are ``ROUNDS`` rounds, in which a
shard starts from the common weights and takes one in ``ROUNDS`` positions of
each of its documents, others each round, so that every position is trained on
once. Weights are then averaged by positions, in the order of shards. So the
result doesn't depend on how the input is partitioned.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiplane.llm import textbytes as tb
from skiplane.llm.common import Remembered, cut, pick

#: Leaf 0 stands beyond the ends of a text; then the frequent words; then the shared leaves. A branch has LEAVES consecutive ones.
BRANCHES, LEAVES, TAILS = 32, 64, 512
SIZE = BRANCHES * LEAVES
FREQUENT = SIZE - 1 - TAILS
#: Neighbours on each side, width of the hidden layer.
SIDE, HIDDEN = 2, 16
ROUNDS, BATCH, RATE = 3, 4096, 0.1
#: Tokens of a shard, about, and shards at most (beyond that, shards are larger); shards whose weights one task adds up.
SHARD_TOKENS, MOST_SHARDS, ADDED = 2_000_000, 4096, 64
#: Distinct words that a part may list before the next one begins.
GATHERED = 400_000
SLICE = 1 << 22
#: Characters of the documents that share a list of words, about (a longer text stands alone).
PART = 1 << 24
#: Added to the count of a word that shares a leaf, and once a leaf for unseen words.
UNSEEN = 0.5
#: Largest logit, in absolute value, whose exponential needs no shift in 32 bits.
SAFE = 75.0
WORD = re.compile(r"\w+|[^\w\s]")

TOKENS = "part bigint, doc_id bigint, key bigint, codes binary, words array<string>, counts array<bigint>"


def _packed(values: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """The values of each row, one row after the other, as compressed bytes."""
    raw, width, squeeze = memoryview(np.ascontiguousarray(values).view(np.uint8)), values.itemsize, zstandard.ZstdCompressor(level=1).compress
    ends = np.cumsum(sizes) * width
    return pa.array([squeeze(raw[a:b]) for a, b in zip((ends - sizes * width).tolist(), ends.tolist(), strict=True)], pa.binary())


def _unpacked(column: pa.Array, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """The values of all rows, and how many each row has."""
    open_ = zstandard.ZstdDecompressor().decompress
    parts = [open_(x) for x in column.to_pylist()]
    return np.frombuffer(b"".join(parts), dtype=kind), np.array([len(p) for p in parts], dtype=np.int64) // np.dtype(kind).itemsize


def _tokenised(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of texts: part, doc_id, key and codes, which are places in the list of the part. One row more a part has that list, with counts."""
    part, size = TaskContext.get().partitionId() << 32, 0
    places: dict[str, int] = {}
    counts = np.zeros(1024, dtype=np.int64)
    names = ["part", "doc_id", "key", "codes", "words", "counts"]

    def codes(raw: str) -> bytes:
        return np.array([places.setdefault(w, len(places)) for w in WORD.findall(raw)], dtype="<u4").tobytes()

    def listed() -> pa.RecordBatch:
        long = pa.nulls(1, pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), long, long, pa.nulls(1, pa.binary()), pa.array([list(places)], pa.list_(pa.string())), pa.array([counts[: len(places)]], pa.list_(pa.int64()))], names=names)

    of = Remembered(codes, GATHERED)
    for batch in tb.slices(batches, "text", SLICE):
        texts = batch.column("text").to_pylist()
        found = [b"".join(map(of.__getitem__, (text or "").lower().split())) for text in texts]
        n = len(texts)
        sizes = np.array([len(x) // 4 for x in found], dtype=np.int64)
        code = np.frombuffer(b"".join(found), dtype="<u4")
        if len(places) > len(counts):
            counts = np.concatenate([counts, np.zeros(max(len(places), 2 * len(counts)) - len(counts), np.int64)])
        held = np.bincount(code, minlength=1)
        counts[: len(held)] += held
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, part, np.int64)), batch.column("doc_id"), batch.column("key"), _packed(code, sizes), pa.nulls(n, pa.list_(pa.string())), pa.nulls(n, pa.list_(pa.int64()))], names=names)
        size += sum(len(text or "") for text in texts)
        if size >= PART or len(places) >= GATHERED:
            yield listed()
            places.clear()
            of.clear()
            counts[:] = 0
            part, size = part + 1, 0
    if places:
        yield listed()


def tail_leaf(word: Column) -> Column:
    """The leaf that a word shares with others of the same last two characters."""
    return (F.lit(1 + FREQUENT) + F.crc32(F.substring(word, -2, 2).cast("binary")) % TAILS).cast("int")


def tail_leaf_of(word: str) -> int:
    return 1 + FREQUENT + zlib.crc32(word[-2:].encode()) % TAILS


def vocabulary(words: DataFrame) -> tuple[DataFrame, np.ndarray, np.ndarray]:
    """Counts of words (word, n) to (word, n, leaf), and by leaf the tokens and the words that it has."""
    spark = words.sparkSession
    top = [(r["word"], 1 + i) for i, r in enumerate(words.orderBy(F.desc("n"), "word").limit(FREQUENT).collect())]
    own = spark.createDataFrame(top, "word string, own int")  # FREQUENT rows at most
    leaved = words.join(F.broadcast(own), "word", "left").select("word", "n", F.coalesce("own", tail_leaf(F.col("word"))).alias("leaf"))
    tokens, kinds = np.zeros(SIZE, dtype=np.int64), np.zeros(SIZE, dtype=np.int64)
    for r in leaved.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("kinds")).collect():
        tokens[r["leaf"]], kinds[r["leaf"]] = r["n"], r["kinds"]
    return leaved, tokens, kinds


def shares(leaf: np.ndarray, n: np.ndarray, tokens: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Logarithm of each word's share of its leaf; 0 for leaves of one word."""
    out = np.log(n + UNSEEN) - np.log(tokens[leaf] + UNSEEN * (kinds[leaf] + 1))
    out[leaf <= FREQUENT] = 0
    return out


def _mapped(held):
    """Codes of a part's documents, and what its list of words is known to be, to leaves and the sum of the words' shares."""

    def run(docs: pa.Table, known: pa.Table) -> pa.Table:
        tokens, kinds = held.value
        leaf_of, share_of = np.zeros(known.num_rows, np.uint16), np.zeros(known.num_rows)
        place, leaf = known.column("place").to_numpy(), known.column("leaf").to_numpy()
        leaf_of[place], share_of[place] = leaf, shares(leaf, known.column("n").to_numpy(), tokens, kinds)
        out = []
        for batch in tb.slices(iter(docs.combine_chunks().to_batches()), "codes", SLICE):
            code, sizes = _unpacked(batch.column("codes"), "<u4")
            sums, ends = np.concatenate([[0], np.cumsum(share_of[code])]), np.cumsum(sizes)
            out.append(pa.RecordBatch.from_arrays([batch.column("key"), batch.column("doc_id"), _packed(leaf_of[code], sizes), pa.array(sums[ends] - sums[ends - sizes])], names=["key", "doc_id", "ids", "shared"]))
        return pa.Table.from_batches(out, schema=pa.schema([("key", pa.int64()), ("doc_id", pa.int64()), ("ids", pa.binary()), ("shared", pa.float64())]))

    return run


class Network:
    """near: a table of vectors for each neighbouring place; bias; top and low: to logits of branches, and of leaves within each branch. Their last rows are added whatever the neighbours."""

    SHAPES = ((2 * SIDE, SIZE, HIDDEN), (HIDDEN,), (HIDDEN + 1, BRANCHES), (BRANCHES, HIDDEN + 1, LEAVES))

    def __init__(self, tokens: np.ndarray | None = None, flat: np.ndarray | None = None):
        if flat is None:
            rng = np.random.default_rng(17)
            parts = [rng.normal(0, s, shape) for s, shape in zip((0.3, 0, 0.1, 0.1), self.SHAPES, strict=True)]
            by_branch = tokens.reshape(BRANCHES, LEAVES) + 0.5
            parts[2][-1] = np.log(by_branch.sum(axis=1) / by_branch.sum())
            parts[3][:, -1] = np.log(by_branch / by_branch.sum(axis=1, keepdims=True))
            flat = np.concatenate([p.ravel() for p in parts])
        self.flat = flat.astype(np.float32)
        self.near, self.bias, self.top, self.low = self.views(self.flat)

    def views(self, flat: np.ndarray) -> list[np.ndarray]:
        out, at = [], 0
        for s in self.SHAPES:
            n = int(np.prod(s))
            out.append(flat[at : at + n].reshape(s))
            at += n
        return out

    def layer(self, around: np.ndarray) -> np.ndarray:
        """The hidden layer, with a column of ones."""
        total = self.bias + self.near[0].take(around[0], axis=0)
        for k in range(1, 2 * SIDE):
            total += self.near[k].take(around[k], axis=0)
        out = np.ones((len(total), HIDDEN + 1), dtype=np.float32)
        np.tanh(total, out=out[:, :HIDDEN])
        return out

    def safe(self) -> bool:
        """Whether no exponential of a logit can overflow: the hidden layer is within -1 and 1."""
        return bool(max(np.abs(self.top).sum(axis=0).max(), np.abs(self.low).sum(axis=1).max()) < SAFE)

    @staticmethod
    def _powers(logits: np.ndarray, safe: bool) -> tuple[np.ndarray, np.ndarray]:
        """Exponentials, in place, and their sums by row."""
        if not safe:
            logits -= logits.max(axis=1, keepdims=True)
        np.exp(logits, out=logits)
        return logits, logits @ np.ones(logits.shape[1], dtype=np.float32)

    def _slopes(self, logits: np.ndarray, of: np.ndarray, safe: bool) -> np.ndarray:
        """Of the loss by logit: chances, less one at ``of``."""
        p, total = self._powers(logits, safe)
        p *= (1 / total)[:, None]
        p[np.arange(len(of)), of] -= 1
        return p

    def _log_chance(self, logits: np.ndarray, of: np.ndarray, safe: bool) -> np.ndarray:
        if not safe:
            logits -= logits.max(axis=1, keepdims=True)
        picked = logits[np.arange(len(of)), of].astype(np.float64)
        return picked - np.log(self._powers(logits, True)[1])

    @staticmethod
    def _by_branch(target: np.ndarray) -> tuple[np.ndarray, list[tuple[int, slice]]]:
        """An order by branch, and in it each branch that occurs and where it stands."""
        branch = (target // LEAVES).astype(np.uint8)
        order = np.argsort(branch, kind="stable")
        edges = np.searchsorted(branch[order], np.arange(BRANCHES + 1)).tolist()
        return order, [(b, slice(edges[b], edges[b + 1])) for b in range(BRANCHES) if edges[b] < edges[b + 1]]

    def log_probabilities(self, around: np.ndarray, target: np.ndarray) -> np.ndarray:
        out, safe = np.empty(len(target), dtype=np.float64), self.safe()
        for i in range(0, len(target), 4 * BATCH):
            order, runs = self._by_branch(target[i : i + 4 * BATCH])
            t, h = target[i + order], self.layer(around[:, i + order])
            one, leaf = self._log_chance(h @ self.top, t // LEAVES, safe), t % LEAVES
            for b, at in runs:
                one[at] += self._log_chance(h[at] @ self.low[b], leaf[at], safe)
            out[i + order] = one
        return out

    def learn(self, around: np.ndarray, target: np.ndarray, held: list[np.ndarray]) -> None:
        """One step of Adagrad on a batch; ``held`` sums squared gradients, in the form of ``views``."""
        n, safe = len(target), self.safe()
        order, runs = self._by_branch(target)
        around, target = around[:, order], target[order]
        h, leaf = self.layer(around), target % LEAVES
        p = self._slopes(h @ self.top, target // LEAVES, safe)
        top, low, back = (h.T @ p) / n, np.zeros_like(self.low), p @ self.top[:HIDDEN].T
        for b, at in runs:
            q = self._slopes(h[at] @ self.low[b], leaf[at], safe)
            back[at] += q @ self.low[b, :HIDDEN].T
            np.dot(h[at].T, q, out=low[b])
        low /= n
        back *= (1 - h[:, :HIDDEN] ** 2) / n
        for weights, slope, squares in ((self.low, low, held[3]), (self.top, top, held[2]), (self.bias, back.sum(axis=0), held[1])):
            self._step(weights, slope, squares)
        for k in range(2 * SIDE):
            order = np.argsort(around[k].astype(np.uint16), kind="stable")
            ids = around[k][order]
            starts = np.flatnonzero(np.append(True, ids[1:] != ids[:-1]))
            some, slope = ids[starts], np.add.reduceat(back[order], starts)
            squares = held[0][k][some] + slope * slope
            held[0][k][some] = squares
            self.near[k][some] -= RATE * slope / np.sqrt(squares + 1e-8)

    @staticmethod
    def _step(weights: np.ndarray, slope: np.ndarray, squares: np.ndarray) -> None:
        squares += slope * slope
        weights -= RATE * slope / np.sqrt(squares + 1e-8)


def _windows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Leaves of all tokens of a batch, those around each, tokens of each text, and the place of each token in its text."""
    ids, sizes = _unpacked(batch.column("ids"), "<u2")
    at = tb.ranges(SIDE + np.concatenate([[0], np.cumsum(sizes + SIDE)[:-1]]), sizes)
    padded = np.zeros(len(ids) + SIDE * (len(sizes) + 1), dtype=np.uint16)
    padded[at] = ids
    around = np.stack([padded[at + k] for k in (*range(-SIDE, 0), *range(1, SIDE + 1))]) if len(at) else np.zeros((2 * SIDE, 0), np.uint16)
    return ids, around, sizes, tb.ranges(np.zeros(len(sizes), np.int64), sizes)


def _trained(held, round_: int, rounds: int):
    """The rows of one shard, which are a partition, to its weights and the positions that they have learned from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network, seen = Network(flat=held.value), 0
        squares = network.views(np.full_like(network.flat, 1e-6))
        around, target = np.zeros((2 * SIDE, 0), np.uint16), np.zeros(0, np.uint16)
        for batch in tb.slices(batches, "ids", SLICE):
            ids, near, _, place = _windows(batch)
            take = place % rounds == round_
            around, target = np.concatenate([around, near[:, take]], axis=1), np.concatenate([target, ids[take]])
            at = 0
            while len(target) - at >= BATCH:
                network.learn(around[:, at : at + BATCH], target[at : at + BATCH], squares)
                at += BATCH
            seen += at
            around, target = around[:, at:], target[at:]
        if len(target):
            network.learn(around, target, squares)
            seen += len(target)
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([seen], pa.int64()), pa.array([network.flat.tobytes()], pa.binary())], names=["shard", "n", "weights"])

    return run


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weights times positions, added up in the order of shards."""
    total, n, first = None, 0, 0
    for batch in batches:
        for shard, seen, weights in zip(*(batch.column(c).to_pylist() for c in ("shard", "n", "weights")), strict=True):
            own = np.frombuffer(weights, dtype=np.float32).astype(np.float64) * seen
            total, n, first = (own, seen, shard) if total is None else (total + own, n + seen, first)
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([n], pa.int64()), pa.array([total.tobytes()], pa.binary())], names=["shard", "n", "weights"])


def train(shards: DataFrame, n_shards: int, tokens: np.ndarray, rounds: int = ROUNDS) -> Network:
    """The weights after ``rounds`` rounds of training by shard and averaging. Each partition of ``shards`` is a shard."""
    spark = shards.sparkSession
    network = Network(tokens)
    kind = "shard int, n bigint, weights binary"
    for round_ in range(rounds):
        told = shards.select("ids").mapInArrow(_trained(spark.sparkContext.broadcast(network.flat), round_, rounds), kind)
        groups = told.repartitionById(-(-n_shards // ADDED), F.expr(f"shard div {ADDED}").cast("int")).sortWithinPartitions("shard")
        sums = sorted(groups.mapInArrow(_added, kind).collect(), key=lambda r: r["shard"])  # MOST_SHARDS / ADDED rows at most
        if sums:
            flat = sum(np.frombuffer(r["weights"], dtype=np.float64) for r in sums) / sum(r["n"] for r in sums)
            network = Network(flat=flat)
    return network


SCORES = ["doc_id", "n_tokens", "log_likelihood", "mean_log_likelihood"]


def _scored(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        network = Network(flat=held.value)
        for batch in tb.slices(batches, "ids", SLICE >> 2):
            ids, around, sizes, _ = _windows(batch)
            sums, ends = np.concatenate([[0], np.cumsum(network.log_probabilities(around, ids))]), np.cumsum(sizes)
            total = sums[ends] - sums[ends - sizes] + batch.column("shared").to_numpy()
            mean = pa.array(np.where(sizes > 0, total / np.maximum(sizes, 1), 0), mask=sizes == 0)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes), pa.array(total), mean], names=SCORES)

    return run


def pseudo_likelihood(docs: DataFrame, shard_tokens: int = SHARD_TOKENS) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_tokens, log_likelihood (sum over tokens, each given those around it), mean_log_likelihood.

    Null and empty texts, and texts without tokens: 0 tokens, sum 0, mean null.
    Null doc_id and repeated rows: trained on and scored like any other. Empty
    table: no rows. Only doc_id and text are read; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = pick(docs, doc_id="bigint", text="string").select("doc_id", F.xxhash64("doc_id", "text").alias("key"), "text")
    told = cut(docs.mapInArrow(_tokenised, TOKENS))
    lists = told.where("words IS NOT NULL").select("part", F.posexplode(F.arrays_zip("words", "counts")).alias("place", "x")).select("part", "place", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    words, tokens, kinds = vocabulary(cut(lists.groupBy("word").agg(F.sum("n").alias("n"))))
    known = lists.drop("n").join(words, "word").select(F.col("part").alias("of"), "place", "leaf", "n")
    held = spark.sparkContext.broadcast((tokens, kinds))
    texts = told.where("codes IS NOT NULL").select("part", "key", "doc_id", "codes")
    leaves = texts.groupBy("part").cogroup(known.groupBy("of")).applyInArrow(_mapped(held), "key bigint, doc_id bigint, ids binary, shared double")
    n_shards = min(max(math.ceil(int(tokens.sum()) / shard_tokens), 1), MOST_SHARDS)
    shards = cut(leaves.repartitionById(n_shards, F.pmod("key", F.lit(n_shards)).cast("int")).sortWithinPartitions("key", "doc_id"))
    network = train(shards, n_shards, tokens)
    return shards.mapInArrow(_scored(spark.sparkContext.broadcast(network.flat)), "doc_id bigint, n_tokens bigint, log_likelihood double, mean_log_likelihood double")
