"""What the operators of this subpackage share: lineage cuts, input columns, groups of rows in Arrow batches."""

from __future__ import annotations

import tempfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where it may be unset."""
    context = spark.sparkContext
    if (held := context._jsc.sc().getCheckpointDir()).isDefined():
        return held.get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not context.master.startswith("local[") and context.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="skiplane-checkpoint-")
    context.setCheckpointDir(folder)
    return folder


def cut(df: DataFrame) -> DataFrame:
    """``df`` computed once and kept in the checkpoint folder, so that lost executors cost no more than a read."""
    checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, typed: name="type" or name="source column:type"; columns that are missing are null."""
    out = []
    for name, kind in columns.items():
        source, _, kind = kind.rpartition(":")
        source = source or name
        out.append((F.col(f"`{source}`") if source in df.columns else F.lit(None)).cast(kind).alias(name))
    return df.select(*out)


def ascii_lower(column: Column) -> Column:
    """A-Z lower-cased, all else as it is."""
    return F.translate(column, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def let(value: Column, body) -> Column:
    """``body(value)`` with ``value`` computed once a row, however often ``body`` uses it."""
    return F.transform(F.array(value), body)[0]


#: Keys whose rows are broadcast by ``join_spread``, at most.
MOST_HOT = 2000


def running(values: Column, start: Column, op: Callable[[Column, Column], Column], block: int = 256) -> Column:
    """For each element of an array the fold of those before it by an associative ``op`` from its neutral ``start``.

    Blocks are folded first; an element's fold is that of the blocks before its
    own and of the elements before it in its block. So the work is linear up to
    ``block`` cubed elements or so.
    """
    fold = lambda part: F.aggregate(part, start, op)
    at = lambda i: F.floor(i / block).cast("int")

    def of(held: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), at(F.size(held))), lambda b: fold(F.slice(held, b * block + 1, F.lit(block))))
        before = let(blocks, lambda folds: F.transform(folds, lambda x, i: fold(F.slice(folds, F.lit(1), i))))
        return let(before, lambda folds: F.transform(held, lambda x, i: op(F.get(folds, at(i)), fold(F.slice(held, at(i) * block + 1, i % block)))))

    return let(values, of)


def join_spread(rows: DataFrame, table: DataFrame, on: list[str], weight: str, how: str = "inner") -> DataFrame:
    """``rows`` joined to ``table``, which has one row a key and in ``weight`` about how many of ``rows`` the key has.

    Keys of more than 1 / ``MOST_HOT`` of all rows, of which there are fewer than
    ``MOST_HOT``, are broadcast; the other keys are dealt by hash. So no task
    gets more than its share, and nothing is dropped. Keys are not null.
    """
    least = (table.agg(F.sum(weight)).first()[0] or 0) / MOST_HOT
    hot = table.where(F.col(weight) > least).withColumn("__hot", F.lit(True)).drop(weight)
    held = rows.join(F.broadcast(hot), on, "left")
    more = [c for c in table.columns if c not in on and c != weight]
    names = [*rows.columns, *more]
    found = held.where("__hot").select(names)
    rest = held.where("__hot IS NULL").select(*rows.columns).join(table.where(F.col(weight) <= least).drop(weight), on, how).select(names)
    return found.union(rest)


class Remembered(dict):
    """``f`` of strings, kept for up to ``most`` strings of at most ``longest`` characters; longer ones are computed each time."""

    def __init__(self, f: Callable[[str], object], most: int = 300_000, longest: int = 64):
        super().__init__()
        self.f, self.most, self.longest = f, most, longest

    def __missing__(self, key: str):
        out = self.f(key)
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.clear()
            self[key] = out
        return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], most_bytes: int = 1 << 24) -> Iterator[pa.RecordBatch]:
    """Batches regrouped so that rows of one key, adjacent in the input, are never split; groups are gathered up to ``most_bytes``."""
    held: list[pa.RecordBatch] = []
    size = 0

    def last_start(batch: pa.RecordBatch) -> int:
        start = 0
        for key in keys:
            values = batch.column(key).to_numpy(zero_copy_only=False)
            changed = (values[1:] != values[:-1]).nonzero()[0]
            start = max(start, int(changed[-1]) + 1 if len(changed) else 0)
        return start

    def joined() -> pa.RecordBatch:
        return pa.Table.from_batches(held).combine_chunks().to_batches()[0]

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.nbytes
        if size >= most_bytes:
            whole = joined()
            at = last_start(whole)
            if at:
                yield whole.slice(0, at)
            held = [whole.slice(at)]
            size = held[0].nbytes
    if held:
        yield joined()
