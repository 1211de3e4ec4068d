"""Repeated byte strings by bucket-pointer refinement (after Schürmann and Stoye, 2005), spread over a cluster.

A suffix belongs to the bucket of its first q bytes, and a bucket is refined
by the bucket identifiers of later offsets: the identifier of 2q bytes at p is
made of those of q bytes at p and at p + q, and so on up to the length asked
for. On one machine identifiers are ranks in a sorted array. Here they are
64-bit names made the same way (``_identifiers``), so that any executor names
a bucket without seeing the rest, and the sort that refines buckets is Spark's.

Only suffixes whose bucket can hold another are refined:

1. Every window of ``length`` bytes elects one of its q-grams, the one with the
   least identifier. Equal windows elect the same one at the same place, so
   they meet in its bucket. Adjacent windows with one elected q-gram form a
   piece, and (bucket, identifier of the whole piece) names it. Copies within
   one slice of texts are settled on the spot.
2. Pieces are sorted by bucket and refined identifier. A piece that has an
   earlier copy is repeated as a whole; a bucket of one piece ends here.
3. The first copies that remain in buckets with several different pieces go
   through the same two steps with longer q-grams, whose identifiers are made
   of those before; the last q is ``length``, where a piece is one window.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skiplane.llm import textbytes as tb
from skiplane.llm.common import cut, pick

#: Bytes of text handled at a time.
SLICE = 1 << 21
#: Bytes whose windows elect at a time.
PART = 1 << 15
#: Repeated doc_ids that are broadcast, at most; more are joined by shuffle.
MOST_BROADCAST = 100_000
_U = np.uint64


def _refine(a: np.ndarray, offset: int) -> np.ndarray:
    """Identifiers of longer strings: those at p and at p + offset, updated together."""
    n = len(a) - offset
    return tb.mix(a[:n] * _U(tb.STEP) + (a[offset:] ^ _U(tb.MIX_B))) if n > 0 else np.zeros(0, np.uint64)


def levels(length: int) -> list[int]:
    """The q of each round: the largest power of two up to a third of ``length``, then nearer to it by two thirds, then ``length``."""
    q = 1
    while 2 * q <= max(1, length // 3):
        q *= 2
    out, rest = [q], (length - q) // 3
    while rest > 3:
        out.append(length - rest)
        rest //= 3
    return out + [length] * (out[-1] != length)


def _identifiers(data: np.ndarray, q: int) -> np.ndarray:
    """Identifiers of the q-grams, by start; refined from those of single bytes, or of eight where q is that long."""
    if q >= 8 and len(data) >= 8:
        held = np.ascontiguousarray(data)
        ids, size = tb.mix(np.ndarray(len(held) - 7, dtype="<u8", buffer=held, strides=(1,)) ^ _U(tb.BASE)), 8
    else:
        ids, size = tb.byte_values(11)[data], 1
    while 2 * size <= q:
        ids, size = _refine(ids, size), 2 * size
    return ids if size == q else _refine(ids, q - size)


def _whole(grams: np.ndarray, q: int, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Identifiers of strings of at least q bytes, each made of those of its q-grams at every q-th offset and at its end."""
    out, at, some = tb.mix((hi - lo).astype(np.uint64)), lo, np.arange(len(lo))
    while len(some):
        out[some] = tb.mix(out[some] * _U(tb.STEP) + grams[np.minimum(at, hi[some] - q)])
        more = at + q < hi[some]
        some, at = some[more], at[more] + q
    return out


def _elected(grams: np.ndarray, width: int) -> np.ndarray:
    """For each run of ``width`` identifiers the place of the least one, the leftmost of equals."""
    n = len(grams) - width + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    least, place, span = grams, np.arange(len(grams), dtype=np.int32), 1

    def fold(v: np.ndarray, p: np.ndarray, by: int) -> tuple[np.ndarray, np.ndarray]:
        m = len(v) - by
        right = v[by:] < v[:m]
        return np.where(right, v[by:], v[:m]), np.where(right, p[by:], p[:m])

    while 2 * span <= width:
        least, place = fold(least, place, span)
        span *= 2
    if span < width:
        least, place = fold(least, place, width - span)
    return place[:n]


def _named(data: np.ndarray, q: int, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Identifiers of all q-grams, and for each window of ``length`` bytes the place of its elected one; made in parts that fit a cache."""
    grams, place = np.zeros(max(len(data) - q + 1, 0), np.uint64), np.zeros(max(len(data) - length + 1, 0), np.int64)
    for at in range(0, max(len(place), 1), PART):
        own = _identifiers(data[at : at + PART + length - 1], q)
        grams[at : at + len(own)] = own
        chosen = _elected(own, length - q + 1)
        np.add(chosen, at, out=place[at : at + len(chosen)])
    return grams, place


def _windows(texts: tb.Texts, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts of the windows that lie in one text, and the text of each."""
    counts = np.maximum(np.diff(texts.starts) - length + 1, 0)
    return tb.ranges(texts.starts[:-1], counts), np.repeat(np.arange(len(texts)), counts)


def _runs(row: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ranges [lo, hi) of rows, sorted and joined where they meet."""
    order = np.lexsort((lo, row))
    row, lo, hi = row[order], lo[order], hi[order]
    new = np.ones(len(row), dtype=bool)
    top = np.maximum.accumulate(hi + row * (1 << 40)) - row * (1 << 40)
    new[1:] = (row[1:] != row[:-1]) | (lo[1:] > top[:-1])
    at = np.flatnonzero(new)
    return row[at], lo[at], np.maximum.reduceat(hi, at) if len(at) else hi


RANGE = "kind tinyint, doc bigint, twin bigint, lo int, hi int"
PIECE = "kind tinyint, bucket bigint, name bigint, doc bigint, twin bigint, lo int, hi int"
_RANGE = pa.schema([("kind", pa.int8()), ("doc", pa.int64()), ("twin", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
_PIECE = pa.schema([("kind", pa.int8()), ("bucket", pa.int64()), ("name", pa.int64()), ("doc", pa.int64()), ("twin", pa.int64()), ("lo", pa.int32()), ("hi", pa.int32())])
#: Kinds of rows: a piece (windows lo to hi - 1), bytes lo to hi - 1 that repeat, a first copy to refine further.
PIECES, REPEATED, OPEN = 0, 1, 2


def _rows(schema: pa.Schema, *parts: tuple) -> pa.RecordBatch:
    """One batch of the parts, each a tuple of arrays in the order of the schema."""
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(column).astype(field.type.to_pandas_dtype())) for field, column in zip(schema, zip(*parts, strict=True), strict=True)], schema=schema)


def _firsts(*keys: np.ndarray) -> np.ndarray:
    """True where a row differs from the one before in any of the keys."""
    out = np.ones(len(keys[0]), dtype=bool)
    out[1:] = np.logical_or.reduce([k[1:] != k[:-1] for k in keys])
    return out


def _again(first: np.ndarray, *places: np.ndarray, carried: tuple | None = None) -> np.ndarray:
    """True where a row isn't the first of its group and stands at another place than that. ``carried`` is the place of the group that goes on at row 0."""
    head = np.maximum.accumulate(np.where(first, np.arange(len(first)), -1))
    out = np.zeros(len(first), dtype=bool)
    for k, p in enumerate(places):
        out |= p != np.where(head >= 0, p[head], carried[k] if carried else p[0])
    return out & ~first


def _spread(doc: np.ndarray, lo: np.ndarray) -> np.ndarray:
    """Any even key for rows that only pass through an exchange."""
    return tb.mix(doc.view(np.uint64) * _U(tb.STEP) + lo.astype(np.uint64)).view(np.int64)


def _pieces(length: int, q: int):
    """Texts, or only their windows in the ranges of the column ``open``, to pieces by elected q-grams."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE):
            texts = tb.Texts(batch.column("text"))
            if "open" in batch.schema.names:
                lists = batch.column("open")
                row = np.repeat(np.arange(len(texts)), pa.compute.list_value_length(lists).to_numpy())
                row, lo, hi = _runs(row, *(pa.compute.struct_field(lists.flatten(), i).to_numpy().astype(np.int64) for i in (0, 1)))
                start, row = tb.ranges(lo + texts.starts[row], hi - lo), np.repeat(row, hi - lo)
            else:
                start, row = _windows(texts, length)
            if not len(start):
                continue
            doc, twin = batch.column("doc").to_numpy(), batch.column("twin").to_numpy()
            grams, place = _named(texts.data, q, length)
            place = place[start]
            at = np.flatnonzero(_firsts(place, row, start - np.arange(len(start))))
            lo, hi, row = start[at], start[np.append(at[1:], len(start)) - 1] + 1, row[at]
            bucket = grams[place[at]]
            name = _whole(grams, q, lo, hi + length - 1) ^ tb.mix((place[at] - lo).astype(np.uint64))
            lo, hi = lo - texts.starts[row], hi - texts.starts[row]
            order = np.lexsort((lo, twin[row], doc[row], name, bucket))
            first = _firsts(bucket[order], name[order])
            again = _again(first, *(x[order] for x in (doc[row], twin[row], lo)))
            kept, gone = np.sort(order[first]), order[again]
            r, a, b = _runs(row[gone], lo[gone], hi[gone] + length - 1)
            zero = np.zeros(len(r), np.int64)
            yield _rows(
                _PIECE,
                (np.full(len(kept), PIECES), bucket[kept].view(np.int64), name[kept].view(np.int64), doc[row[kept]], twin[row[kept]], lo[kept], hi[kept]),
                (np.full(len(r), REPEATED), _spread(doc[r], a), zero, doc[r], twin[r], a, b),
            )

    return run


def _refined_pieces(length: int):
    """Rows sorted by kind, bucket, name, doc, twin and lo: pieces with an earlier copy become REPEATED, first copies in buckets of several pieces OPEN."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # bucket, name and place of the first copy of the piece before
        wait: list = []  # the first copy of the bucket's first piece, while no second piece has come
        for batch in batches:
            passing = batch.filter(pa.compute.equal(batch.column("kind"), REPEATED))
            batch = batch.filter(pa.compute.equal(batch.column("kind"), PIECES))
            out = [tuple(passing.column(c).to_numpy() for c in ("kind", "doc", "twin", "lo", "hi"))]
            if batch.num_rows:
                bucket, name, doc, twin, lo, hi = (batch.column(c).to_numpy() for c in ("bucket", "name", "doc", "twin", "lo", "hi"))
                new_bucket, new_piece = _firsts(bucket), _firsts(bucket, name)
                if last is not None:
                    new_bucket[0] = bucket[0] != last[0]
                    new_piece[0] = new_bucket[0] or name[0] != last[1]
                heads, gone = np.flatnonzero(new_piece), np.flatnonzero(_again(new_piece, doc, twin, lo, carried=last and last[2:]))
                last = (bucket[-1], name[-1], *([doc[heads[-1]], twin[heads[-1]], lo[heads[-1]]] if len(heads) else last[2:]))
                opens = new_bucket[heads]
                several = ~opens
                several[:-1] |= ~opens[1:]
                open_ = heads[several]
                waited = np.array(wait if len(heads) and not opens[0] else [], dtype=np.int64).reshape(-1, 4)
                if len(heads):
                    tail = heads[-1]
                    wait = [[doc[tail], twin[tail], lo[tail], hi[tail]]] if opens[-1] else []
                out += [
                    (np.full(len(gone), REPEATED), doc[gone], twin[gone], lo[gone], hi[gone] + length - 1),
                    (np.full(len(open_), OPEN), doc[open_], twin[open_], lo[open_], hi[open_]),
                    (np.full(len(waited), OPEN), *waited.T),
                ]
            yield _rows(_RANGE, *out)

    return run


def _cleaned(with_bytes: bool):
    spans = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE):
            texts = tb.Texts(batch.column("text"))
            lists = batch.column("ranges")
            row = np.repeat(np.arange(len(texts)), pa.compute.fill_null(pa.compute.list_value_length(lists), 0).to_numpy())
            lo, hi = (pa.compute.struct_field(lists.flatten(), i).to_numpy().astype(np.int64) for i in (0, 1))
            row, lo, hi = _runs(row, lo, hi)
            change = np.zeros(len(texts.data) + 1, dtype=np.int8)
            at = texts.starts[row]
            change[lo + at] += 1
            change[hi + at] -= 1
            stay = np.cumsum(change[:-1], dtype=np.int8) == 0
            rest = texts.data[stay].tobytes()
            ends = np.concatenate([[0], np.cumsum(stay)])[texts.starts].tolist()
            kept = [rest[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]
            removed = pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(texts) + 1)).astype(np.int32)), pa.StructArray.from_arrays([pa.array(lo), pa.array(hi)], fields=list(spans.value_type)))
            columns = [batch.column("doc_id"), pa.array(np.diff(texts.starts)), removed, pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string())]
            yield pa.RecordBatch.from_arrays(columns + [pa.array(kept, pa.binary())] * with_bytes, names=["doc_id", "n_bytes", "removed", "kept_sha256", "kept"][: 4 + with_bytes])

    return run


def remove_repeats(docs: DataFrame, length: int = 100, with_bytes: bool = True) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, removed (array of lo, hi byte ranges), kept_sha256 and, on request, kept (the bytes left).

    A text is its UTF-8 bytes. Each byte that lies in a string of ``length``
    bytes is removed if that string also starts earlier: in a smaller doc_id,
    or in the same one at a smaller start. Strings don't cross texts and are
    judged on the input.

    Null and empty texts: no bytes. Texts shorter than ``length``: all stays.
    Null doc_id: compared neither way, all stays. Rows of one doc_id with
    different texts are different documents, in the order of a hash of the
    text; rows that agree in both are one document, and each loses what it
    loses. Empty table: no rows. Only doc_id and text are read; extra columns
    are ignored.
    """
    spark = docs.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 1)
    docs = pick(docs, doc_id="bigint", text="string")
    known = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").alias("doc"), "text")
    again = cut(known.groupBy("doc").agg(F.count("*").alias("n")).where("n > 1").select("doc", F.lit(True).alias("again")))
    if again.count() <= MOST_BROADCAST:
        again = F.broadcast(again)
    # 0 where the doc_id alone tells a document
    known = known.join(again, "doc", "left").select("doc", F.when(F.col("again"), F.xxhash64("text")).otherwise(F.lit(0)).alias("twin"), "text")
    texts = known.where(f"octet_length(text) >= {length}")
    dealt = known.repartition(n, "doc", "twin")
    key = ["doc", "twin"]

    def refined(source: DataFrame, q: int) -> DataFrame:
        pieces = source.mapInArrow(_pieces(length, q), PIECE).repartition(n, "bucket").sortWithinPartitions("kind", "bucket", "name", "doc", "twin", "lo")
        return pieces.mapInArrow(_refined_pieces(length), RANGE)

    first, *rest = levels(length)
    found = [cut(refined(texts, first))]
    for q in rest:
        left = found[-1].where(F.col("kind") == OPEN).groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("open"))
        found.append(refined(dealt.join(left, key).select("doc", "twin", "text", "open"), q))
    repeats = [f.where(F.col("kind") == REPEATED).select("doc", "twin", "lo", "hi") for f in found]
    ranges = reduce(DataFrame.union, repeats).groupBy(*key).agg(F.collect_list(F.struct("lo", "hi")).alias("ranges"))
    # The exchange of the texts by document is the same for all levels, and for the removal.
    held = dealt.join(ranges, key, "left").select(F.col("doc").alias("doc_id"), "text", "ranges")
    other = docs.where("doc_id IS NULL").withColumn("ranges", F.lit(None).cast(ranges.schema["ranges"].dataType))
    kinds = "doc_id bigint, n_bytes bigint, removed array<struct<lo: bigint, hi: bigint>>, kept_sha256 string" + ", kept binary" * with_bytes
    return held.union(other).mapInArrow(_cleaned(with_bytes), kinds)
