"""Benchmark decontamination: a broadcast hash set of normalised test n-grams, scanned over every training window.

The benchmark is a stated query set. The pairs of its windows and items are
counted first and dealt into blocks of at most about ``MOST_WINDOWS``. There is
one block at a time on the driver and in the executors: each is a stage of its
own over the documents, and what it finds is kept in the checkpoint folder
before the next one is read. So what is held doesn't grow with the benchmark.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from skiplane.llm import textbytes as tb
from skiplane.llm.common import cut, pick

#: Windows, or pairs of window and item, that one broadcast holds, about: 100 MB with their words.
MOST_WINDOWS = 500_000
#: Bytes of text handled at a time.
SLICE = 1 << 21


def _item_windows(size: int):
    """Windows of the items, by length and hash, with the words themselves for verification."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE):
            texts = tb.Texts(batch.column("text"))
            start, end, first = texts.words(tb.ALPHANUMERIC)
            word = texts.word_hashes(start, end, 21, fold_case=True)
            items = batch.column("item").to_pylist()
            lower = bytes(texts.data).translate(bytes(tb.LOWER))
            out: dict[str, list] = {"item": [], "n": [], "hash": [], "words": []}
            for i, item in enumerate(items):
                a, b = int(first[i]), int(first[i + 1])
                n = min(size, b - a)
                if not n:
                    continue
                for k, h in enumerate(tb.windows(word[a:b], n).view(np.int64).tolist()):
                    out["item"].append(item)
                    out["n"].append(n)
                    out["hash"].append(h)
                    out["words"].append(b" ".join(lower[start[j] : end[j]] for j in range(a + k, a + k + n)))
            yield pa.RecordBatch.from_arrays([pa.array(out["item"], pa.string()), pa.array(out["n"], pa.int32()), pa.array(out["hash"], pa.int64()), pa.array(out["words"], pa.binary())], names=list(out))

    return run


class Windows:
    """A block of the hash set: for each window length the sorted hashes, the words, and the items of each window."""

    def __init__(self, rows: list):
        self.by_length: dict[int, tuple[np.ndarray, list[list[tuple[bytes, list[str]]]]]] = {}
        held: dict[int, dict[int, dict[bytes, list[str]]]] = {}
        for r in rows:
            held.setdefault(r["n"], {}).setdefault(r["hash"], {})[bytes(r["words"])] = r["items"]
        for n, hashes in held.items():
            keys = sorted(hashes)
            self.by_length[n] = np.array(keys, dtype=np.int64), [list(hashes[k].items()) for k in keys]


def _scanned(held, schema: pa.Schema):
    """Adds n_words, hits (ranges of words, first and past the last) and items (sorted) to rows that have a text."""
    names = schema.names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block: Windows = held.value
        for batch in tb.slices(batches, "__text", SLICE):
            texts = tb.Texts(batch.column("__text"))
            start, end, first = texts.words(tb.ALPHANUMERIC)
            word = texts.word_hashes(start, end, 21, fold_case=True)
            owner = np.repeat(np.arange(len(texts)), np.diff(first))
            items: list[set[str | None]] = [set() for _ in range(len(texts))]
            hits: list[tuple[int, int]] = []
            if "__hits" in batch.schema.names:  # what the blocks before have found
                for i, (old, of) in enumerate(zip(batch.column("__hits").to_pylist(), batch.column("__items").to_pylist(), strict=True)):
                    items[i].update(of)
                    hits += [(r["first"] + int(first[i]), r["past"] + int(first[i])) for r in old]
            for n, (keys, groups) in block.by_length.items():
                seen = tb.windows(word, n).view(np.int64)
                if not len(seen):
                    continue
                at = np.searchsorted(keys, seen)
                at[at == len(keys)] = 0
                found = np.flatnonzero(keys[at] == seen)
                found = found[owner[found] == owner[found + n - 1]]
                for p in found.tolist():  # verified on the words
                    text = b" ".join(bytes(tb.LOWER[texts.data[start[j] : end[j]]]) for j in range(p, p + n))
                    for words, of in groups[at[p]]:
                        if words == text:
                            items[owner[p]].update(of)
                            hits.append((p, p + n))
            spans: list[list[tuple[int, int]]] = [[] for _ in range(len(texts))]
            for a, b in sorted(hits):
                i = int(owner[a])
                a, b = a - int(first[i]), b - int(first[i])
                if spans[i] and a <= spans[i][-1][1]:
                    spans[i][-1] = (spans[i][-1][0], max(b, spans[i][-1][1]))
                else:
                    spans[i].append((a, b))
            more = [
                pa.array(np.diff(first)),
                pa.array([[{"first": a, "past": b} for a, b in s] for s in spans], type=schema.field("__hits").type),
                pa.array([sorted(s, key=lambda x: (x is None, x or "")) for s in items], type=schema.field("__items").type),
            ]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in names if c not in ("__n_words", "__hits", "__items")] + more, names=names)

    return run


def _blocks(benchmark: DataFrame, size: int, most: int) -> Iterator[tuple[list, bool]]:
    """The distinct windows with their items, in blocks, one at least, read one by one; and whether another block follows."""
    windows = pick(benchmark, item="item_id:string", text="string").mapInArrow(_item_windows(size), "item string, n int, hash bigint, words binary").distinct()
    n = windows.count()
    items = F.sort_array(F.collect_set("item"))  # without null, which is put back
    listed = F.when(F.bool_or(F.col("item").isNull()), F.array_append(items, F.lit(None).cast("string"))).otherwise(items).alias("items")
    blocks = 1 if n <= most else -(-n * 5 // (4 * most))
    if blocks > 1:
        windows = cut(windows.withColumn("block", F.pmod(F.xxhash64("n", "hash", "words", "item"), F.lit(blocks))))
    for k in range(blocks):
        own = windows.where(F.col("block") == k) if blocks > 1 else windows
        yield own.groupBy("n", "hash", "words").agg(listed).collect(), k + 1 < blocks


def scan(docs: DataFrame, benchmark: DataFrame, size: int = 10, most_windows: int | None = None) -> DataFrame:
    """``docs`` with three more columns: __n_words, __hits (array of first, past: ranges of words) and __items (sorted item_ids as text, a null id last).

    Words are runs of ASCII letters and digits and of all characters beyond
    ASCII, A-Z lower-cased. An item's windows are its runs of ``size`` words;
    an item of fewer words, but not none, is one window. Null texts have no
    words; items without words have no windows. All items without id count as one. Needs the column text.
    """
    spark = docs.sparkSession
    columns = docs.columns
    out = docs.withColumn("__text", F.col("text").cast("string"))
    target = StructType(out.schema.fields + StructType.fromDDL("__n_words bigint, __hits array<struct<first: bigint, past: bigint>>, __items array<string>").fields)
    for rows, more in _blocks(benchmark, size, most_windows or MOST_WINDOWS):
        out = out.mapInArrow(_scanned(spark.sparkContext.broadcast(Windows(rows)), to_arrow_schema(target)), target)
        if more:
            out = cut(out)
    return out.select(*[F.col(f"`{c}`") for c in columns], "__n_words", "__hits", "__items")


def contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """One row per row of ``docs``: doc_id, n_words, n_hit, items (sorted item_ids that occur), hits (ranges of words), contaminated.

    A word of a document is hit if it lies in any occurrence of a window.
    Null and empty texts: no words, not contaminated. Repeated rows are judged
    one by one. Empty tables: no rows, or nothing hit. Extra columns are
    ignored.
    """
    found = scan(pick(docs, doc_id="bigint", text="string"), benchmark, size)
    n_hit = F.aggregate("__hits", F.lit(0).cast("bigint"), lambda n, r: n + r["past"] - r["first"])
    return found.select("doc_id", F.col("__n_words").alias("n_words"), n_hit.alias("n_hit"), F.col("__items").alias("items"), F.col("__hits").alias("hits"), (F.size("__hits") > 0).alias("contaminated"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` that hold no window of the benchmark, all columns as they are.

    Null and empty texts stay; repeated rows go or stay alike. Empty tables: no
    rows, or all of them.
    """
    return scan(docs, benchmark, size).where(F.size("__hits") == 0).select(*[F.col(f"`{c}`") for c in docs.columns])


def cut_contaminated(docs: DataFrame, benchmark: DataFrame, size: int = 10) -> DataFrame:
    """All rows of ``docs`` with every hit word, and what stands between hit words of one span, taken out of the text.

    Null and empty texts stay as they are; repeated rows are cut alike. Empty
    tables: no rows, or nothing cut.
    """
    found = scan(docs, benchmark, size)
    kind = to_arrow_schema(found.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in tb.slices(batches, "text", SLICE):
            texts = tb.Texts(batch.column("text"))
            start, end, first = texts.words(tb.ALPHANUMERIC)
            out = batch.column("text").to_pylist()
            for i, spans in enumerate(batch.column("__hits").to_pylist()):
                if spans:
                    data, at, rest = texts.data[texts.starts[i] : texts.starts[i + 1]].tobytes(), 0, []
                    for r in spans:
                        a, b = start[first[i] + r["first"]] - texts.starts[i], end[first[i] + r["past"] - 1] - texts.starts[i]
                        rest.append(data[at:a])
                        at = b
                    out[i] = b"".join([*rest, data[at:]]).decode()
            columns = [pa.array(out, pa.string()) if c == "text" else batch.column(c) for c in kind.names]
            yield pa.RecordBatch.from_arrays(columns, names=kind.names)

    return found.mapInArrow(run, found.schema).select(*[F.col(f"`{c}`") for c in docs.columns])
