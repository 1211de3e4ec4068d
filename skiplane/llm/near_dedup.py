"""MinHash near-duplicates with sequential Bayesian verification (after BayesLSH, Satuluri and Parthasarathy, 2012).

Documents with equal shingle sets are one node from the start. Banded MinHash
values of the nodes give buckets; within a bucket, pairs are compared by
batches of signature values and dropped as soon as the posterior probability
that their similarity reaches the threshold falls below the miss probability.
Survivors are verified on their full shingle sets, and only a spanning forest
of the verified links leaves a bucket, so output never grows with pairs.

A bucket of more than ``BLOCK`` nodes is dealt into blocks by a hash. Blocks
are first treated on their own; the links found settle most of a large group.
Then only nodes outside a bucket's main component are compared with the rest
of that bucket, block by block. No partner is left out.
"""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiplane.llm import textbytes as tb
from skiplane.llm.common import cut, join_spread, pick, whole_groups
from skiplane.llm.components import components

#: Nodes of a bucket that one group compares with each other.
BLOCK = 512
#: Shingles of a block's nodes, on average, before a bucket gets more blocks.
BLOCK_SHINGLES = 400_000
#: Bytes of text handled at a time.
SLICE = 1 << 21
#: MinHash values at most.
MOST_VALUES = 192
SEED = 0x5EED


def banding(threshold: float, miss: float) -> tuple[int, int]:
    """Rows a band and bands: as many rows as fit, with a chance of at most ``miss`` that a pair at the threshold shares no band."""
    best = (1, max(1, math.ceil(math.log(miss) / math.log1p(-min(threshold, 0.999999)))))
    for rows in range(2, 17):
        bands = math.ceil(math.log(miss) / math.log1p(-(min(threshold, 0.999999) ** rows)))
        if rows * bands <= MOST_VALUES:
            best = (rows, bands)
    return best


def least_matches(n: int, threshold: float, miss: float) -> int:
    """Fewest of ``n`` equal values at which similarity >= threshold still has a posterior probability of ``miss`` (uniform prior).

    The posterior is Beta(m + 1, n - m + 1), and its upper tail at t is the
    chance of at most m successes in n + 1 trials of probability t.
    """
    total = 0.0
    for m in range(n + 1):
        total += math.exp(math.lgamma(n + 2) - math.lgamma(m + 1) - math.lgamma(n + 2 - m) + m * math.log(threshold) + (n + 1 - m) * math.log1p(-threshold))
        if total >= miss:
            return m
    return n


def shingle_sets(texts: tb.Texts, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text, one after the other, and where each text's begin (one more than texts)."""
    start, end, first = texts.words(tb.BLANK_SEPARATED)
    word = texts.word_hashes(start, end, SEED, fold_case=True)
    n_words = np.diff(first)
    full = tb.windows(word, size)
    counts = np.maximum(n_words - size + 1, 0)
    values = [full[tb.ranges(first[:-1], counts)]]
    owner = [np.repeat(np.arange(len(texts)), counts)]
    for n in range(1, size):
        short = np.flatnonzero(n_words == n)
        if len(short):
            values.append(tb.windows(word, n)[first[short]])
            owner.append(short)
    values, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    new = np.ones(len(values), dtype=bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    values, owner = values[new], owner[new]
    return values, np.searchsorted(owner, np.arange(len(texts) + 1))


def signatures(values: np.ndarray, bounds: np.ndarray, n: int) -> np.ndarray:
    """``n`` MinHash values (rows) of each non-empty set (columns)."""
    sets = np.flatnonzero(np.diff(bounds))
    out = np.empty((n, len(sets)), dtype=np.uint32)
    if len(sets):
        rule = tb.mix(np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(tb.STEP))
        factor, shift = rule[:n] | np.uint64(1), rule[n:]
        starts = bounds[:-1][sets]
        for j in range(n):
            out[j] = np.minimum.reduceat(((values * factor[j] + shift[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def _described(size: int, rows: int, bands: int):
    kind = pa.schema([("doc_id", pa.int64()), ("set_a", pa.int64()), ("set_b", pa.int64()), ("n_shingles", pa.int64()), ("buckets", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE):
            values, bounds = shingle_sets(tb.Texts(batch.column("text")), size)
            n = np.diff(bounds)
            filled = np.flatnonzero(n)
            prints = np.zeros((2, len(n)), dtype=np.uint64)
            lists: list = [None] * len(n)
            if len(filled):
                starts = bounds[:-1][filled]
                prints[0, filled] = np.add.reduceat(tb.mix(values ^ np.uint64(tb.BASE)), starts)
                prints[1, filled] = np.bitwise_xor.reduceat(tb.mix(values + np.uint64(tb.MIX_A)), starts)
                held = signatures(values, bounds, rows * bands)
                key = np.empty((bands, len(filled)), dtype=np.uint64)
                for b in range(bands):
                    h = np.full(len(filled), b + 1, dtype=np.uint64)
                    for r in range(rows):
                        h = tb.mix(h * np.uint64(tb.STEP) + held[b * rows + r])
                    key[b] = h
                flat = np.ascontiguousarray(key.T).view(np.int64)
                for i, row in zip(filled.tolist(), flat, strict=True):
                    lists[i] = row
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(prints[0].view(np.int64)), pa.array(prints[1].view(np.int64)), pa.array(n.astype(np.int64)), pa.array(lists, type=pa.list_(pa.int64()))], schema=kind)

    return run


def _intersections(values: np.ndarray, bounds: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of pairs of sets: bit rows over the values that more than one set holds."""
    lengths = np.diff(bounds)
    shared, place, count = np.unique(values, return_inverse=True, return_counts=True)
    column = np.cumsum(count > 1) - 1
    owner = np.repeat(np.arange(len(lengths)), lengths)
    keep = count[place] > 1
    width = (int((count > 1).sum()) + 63) // 64
    out = np.zeros(len(left), dtype=np.int64)
    if not width:
        return out
    bits = np.zeros((len(lengths), width * 64), dtype=bool)
    bits[owner[keep], column[place[keep]]] = True
    packed = np.packbits(bits, axis=1).view(np.uint64)
    step = max(1, (1 << 20) // width)
    for i in range(0, len(left), step):
        out[i : i + step] = np.bitwise_count(packed[left[i : i + step]] & packed[right[i : i + step]]).sum(axis=1)
    return out


class _Forest:
    def __init__(self, labels: np.ndarray):
        self.of = {int(x): int(x) for x in labels}

    def root(self, x: int) -> int:
        of = self.of
        while of[x] != x:
            of[x] = of[of[x]]
            x = of[x]
        return x

    def join(self, a: int, b: int) -> bool:
        a, b = self.root(a), self.root(b)
        if a != b:
            self.of[max(a, b)] = min(a, b)
        return a != b


def word_set(text: str, size: int) -> set[tuple[bytes, ...]]:
    """The shingles themselves, of words as bytes: what ``shingle_sets`` gives hashes of."""
    words = text.encode().lower().split()  # bytes know ASCII white space and letters alone
    return set(zip(*(words[k:] for k in range(size)), strict=False)) if len(words) >= size else {tuple(words)} if words else set()


def linked(values: np.ndarray, bounds: np.ndarray, held: np.ndarray, node: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int, least: list[tuple[int, int]], words) -> tuple[list[int], list[int]]:
    """Links of a spanning forest of the candidate pairs (left, right) that hold on the full sets: first on hashes of shingles, then on ``words(i)``, the shingles of the i-th text."""
    same = np.zeros(len(left), dtype=np.int64)
    done = 0
    for n, fewest in least:
        same += (held[done:n, left] == held[done:n, right]).sum(axis=0)
        stay = same >= fewest
        left, right, same, done = left[stay], right[stay], same[stay], n
        if not len(left):
            return [], []
    n = np.diff(bounds)
    common = _intersections(values, bounds, left, right)
    fits = 100 * common >= percent * (n[left] + n[right] - common)
    left, right = left[fits], right[fits]
    forest, u, v = _Forest(node), [], []
    for i, j in zip(left.tolist(), right.tolist(), strict=True):
        a, b = int(node[i]), int(node[j])
        if forest.root(a) != forest.root(b):
            one, other = words(i), words(j)
            both = len(one & other)
            if 100 * both >= percent * (len(one) + len(other) - both):
                forest.join(a, b)
                u.append(a)
                v.append(b)
    return u, v


def _verified(size: int, percent: int, miss: float, n_values: int, batch_size: int):
    """Groups (bucket, block, other) of rows (node, side, component, text) to forest links. Side 0 is compared with itself, or with side 1 where there is one, across components."""
    kind = pa.schema([("u", pa.int64()), ("v", pa.int64())])
    least = [(n, least_matches(n, percent / 100, miss)) for n in [*range(batch_size, n_values, batch_size), n_values]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in whole_groups(batches, ["bucket", "block", "other"]):
            keys = [batch.column(k).to_numpy() for k in ("bucket", "block", "other")]
            n = batch.num_rows
            new = np.ones(n, dtype=bool)
            new[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
            edges = np.append(np.flatnonzero(new), n).tolist()
            u: list[int] = []
            v: list[int] = []
            start = 0
            while start < len(edges) - 1:  # whole groups, about SLICE bytes of text at a time
                stop, sizes = start + 1, 0
                while stop < len(edges) - 1 and sizes < SLICE:
                    sizes += int(pa.compute.sum(pa.compute.binary_length(batch.column("text").slice(edges[stop - 1], edges[stop] - edges[stop - 1]))).as_py() or 0)
                    stop += 1
                part = batch.slice(edges[start], edges[stop] - edges[start])
                values, bounds = shingle_sets(tb.Texts(part.column("text")), size)
                filled = np.flatnonzero(np.diff(bounds))
                held = np.zeros((n_values, part.num_rows), dtype=np.uint32)
                held[:, filled] = signatures(values, bounds, n_values)
                text = part.column("text")
                node, side, comp = (part.column(c).to_numpy() for c in ("node", "side", "component"))
                for g in range(start, stop):
                    lo, hi = edges[g] - edges[start], edges[g + 1] - edges[start]
                    if hi - lo < 2:
                        continue
                    if side[lo:hi].any():
                        a, b = np.flatnonzero(side[lo:hi] == 0), np.flatnonzero(side[lo:hi] == 1)
                        left, right = np.repeat(a, len(b)), np.tile(b, len(a))
                    else:
                        left, right = np.triu_indices(hi - lo, 1)
                    apart = (node[lo:hi][left] != node[lo:hi][right]) & (comp[lo:hi][left] != comp[lo:hi][right])
                    left, right = left[apart], right[apart]
                    if len(left):
                        words = functools.cache(lambda i, lo=lo: word_set(text[lo + i].as_py(), size))
                        found = linked(values[bounds[lo] : bounds[hi]], bounds[lo : hi + 1] - bounds[lo], held[:, lo:hi], node[lo:hi], left, right, percent, least, words)
                        u += found[0]
                        v += found[1]
                start = stop
            if u:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], schema=kind)

    return run


def near_duplicates(docs: DataFrame, percent: int = 80, size: int = 5, miss: float = 1e-6, batch_size: int = 30) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_shingles, component_id (smallest doc_id reachable over links), kept (doc_id = component_id).

    Texts are lower-cased (A-Z) and split at ASCII white space. A set holds the
    distinct runs of ``size`` words, or the whole sequence if there are fewer.
    Two documents are linked if 100 * |A & B| >= percent * |A | B|. ``miss`` is
    both the chance that a pair at the threshold shares no band and the
    posterior probability below which a pair is dropped.

    Null and empty texts, and texts without words: an empty set, linked with
    nothing. Null doc_id: linked with nothing, component_id null, kept. Rows
    that share a doc_id get the smallest component of their texts. Empty table:
    no rows. Only the columns doc_id and text are read.
    """
    spark = docs.sparkSession
    rows, bands = banding(percent / 100, miss)
    docs = pick(docs, doc_id="bigint", text="string")
    told = cut(docs.mapInArrow(_described(size, rows, bands), "doc_id bigint, set_a bigint, set_b bigint, n_shingles bigint, buckets array<bigint>"))
    sets = told.where("n_shingles > 0 AND doc_id IS NOT NULL")
    nodes = sets.groupBy("set_a", "set_b").agg(F.min("doc_id").alias("node"), F.first("buckets").alias("buckets"), F.first("n_shingles").alias("n"), F.count("*").alias("copies"))
    places = nodes.select("node", "n", F.explode("buckets").alias("bucket"))
    full = places.groupBy("bucket").agg(F.count("*").alias("members"), F.sum("n").alias("total")).where("members > 1")
    blocks = full.select("bucket", F.greatest(F.ceil(F.col("members") / BLOCK), F.ceil(F.col("total") / BLOCK_SHINGLES)).cast("int").alias("blocks"))
    members = cut(places.join(blocks, "bucket").select("bucket", "node", "blocks"))
    verify = _verified(size, percent, miss, rows * bands, batch_size)
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").withColumnRenamed("doc_id", "node")

    def compare(groups: DataFrame) -> DataFrame:
        rows_ = groups.join(texts, "node").select("bucket", "block", "other", "node", "side", "component", "text")
        n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
        dealt = rows_.repartition(n, "bucket", "block", "other").sortWithinPartitions("bucket", "block", "other")
        return cut(dealt.mapInArrow(verify, "u bigint, v bigint"))

    block = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    zero = F.lit(0)
    links = compare(members.select("bucket", block.alias("block"), zero.alias("other"), "node", zero.alias("side"), F.col("node").alias("component")))
    found = components(links)

    large = members.where("blocks > 1").join(found, "node", "left").withColumn("component", F.coalesce("component", "node"))
    if not members.where("blocks > 1").isEmpty():
        large = cut(large)
        by_class = large.groupBy("bucket", "component").agg(F.count("*").alias("n"))
        main = by_class.groupBy("bucket").agg(F.max_by("component", F.struct("n", "component")).alias("main"), (F.sum("n") - F.max("n")).alias("outside")).where("outside > 0")
        main = main.select("bucket", "main", F.greatest(F.ceil(F.col("outside") / BLOCK), F.lit(1)).cast("int").alias("others"))
        rest = large.join(main, "bucket")
        outside = rest.where("component <> main").select("bucket", F.explode(F.sequence(zero, F.col("blocks") - 1)).alias("block"), F.pmod(F.xxhash64("node"), F.col("others")).cast("int").alias("other"), "node", zero.alias("side"), "component")
        inside = rest.select("bucket", block.alias("block"), F.explode(F.sequence(zero, F.col("others") - 1)).alias("other"), "node", F.lit(1).alias("side"), "component")
        more = compare(outside.union(inside))
        found = components(links.union(more))

    of_set = nodes.join(found, "node", "left").select("set_a", "set_b", F.coalesce("component", "node").alias("component"), "copies")
    label = join_spread(sets.select("doc_id", "set_a", "set_b"), cut(of_set), ["set_a", "set_b"], "copies").groupBy("doc_id").agg(F.min("component").alias("component_id"))
    out = told.select("doc_id", "n_shingles").join(label, "doc_id", "left")
    component = F.coalesce("component_id", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs``, all columns as they are, without those that have a near-duplicate of smaller doc_id in their group.

    Of rows that agree in doc_id and text one stays; rows of one doc_id with
    different texts stay or go together. Null doc_id: stays, like null and
    empty texts, which have no near-duplicates. Empty table: no rows.
    """
    gone = near_duplicates(docs, percent, **options).where("NOT kept").select(F.col("doc_id").alias("__gone")).distinct()
    left = docs.join(gone, docs["doc_id"] == gone["__gone"], "left_anti")
    doc, mark = F.col("doc_id").cast("bigint"), F.xxhash64("text")
    twice = cut(docs.where("doc_id IS NOT NULL").groupBy(doc.alias("__doc"), mark.alias("__mark")).count().where("count > 1").select("__doc", "__mark"))
    same = (doc == F.col("__doc")) & (mark == F.col("__mark"))
    return left.join(twice, same, "left_anti").union(left.join(twice, same, "left_semi").dropDuplicates(["doc_id", "text"]))
