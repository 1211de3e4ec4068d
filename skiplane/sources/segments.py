"""Segment tables: Parquet files by bucket, and commits that say what is in them.

Folder: ``data/batch=…/bx=…/by_=…``, ``_meta/layout`` and one commit a batch,
``_meta/commits/<batch>``: JSON with the schema, the rows of each combination
of buckets, and statistics of each segment. A batch counts once its commit is
there; writing it again replaces it, so a retried batch is never counted twice.
A commit may replace others (``compact``).

Commits are read once and kept as long as the listing of their folder is the
same. Their size is bounded by the layout, which has at most ``MOST_CELLS``
combinations, so that pruning needs no Spark job.
"""

from __future__ import annotations

import json
import re
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiplane.functions import bits, routing
from skiplane.operators.layout import BUCKETS, Layout
from skiplane.plans.predicate import Predicate, Range

#: Rows of one file at most.
FILE_ROWS = 5_000_000
#: Combinations of buckets that a layout may have.
MOST_CELLS = 1 << 18
#: Numbers of streamed batches start here; loads by hand are below.
FIRST_STREAMED = 1 << 32


def scratch(spark: SparkSession, name: str) -> str:
    """A folder for derived tables: in the shared checkpoint folder; a temporary one only in local mode."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        shared = tempfile.mkdtemp(prefix="skiplane-")
    return f"{shared}/{re.sub(r'[^A-Za-z0-9_.-]', '_', name)}"


@dataclass(frozen=True)
class PruneReport:
    segments_scanned: int
    segments_total: int

    @property
    def skipped_percent(self) -> float:
        return 100.0 * (1 - self.segments_scanned / self.segments_total) if self.segments_total else 0.0


@dataclass(frozen=True)
class WriterStats:
    """What a write has put down: its batch, rows and segments. Nothing stays buffered."""

    batch: int
    rows: int
    segments: int
    buffered_rows: int = 0


class Folder:
    """A folder of any file system that Hadoop knows."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm, self.path = spark._jvm, path
        self._fs = self._jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self._fs.exists(self._at(name))

    def files(self, name: str = "") -> dict[str, tuple[int, int]]:
        """Names to modification time and length."""
        return {s.getPath().getName(): (s.getModificationTime(), s.getLen()) for s in self._fs.listStatus(self._at(name)) if s.isFile() and not s.getPath().getName().startswith((".", "_"))} if self.exists(name) else {}

    def read(self, name: str) -> str:
        stream = self._fs.open(self._at(name))
        try:
            return self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """The whole file or nothing: written beside and renamed."""
        beside = self._at(f"_{name.replace('/', '_')}.writing")
        stream = self._fs.create(beside, True)
        stream.write(bytearray(text.encode()))
        stream.close()
        self._fs.mkdirs(self._at(name).getParent())
        self._fs.delete(self._at(name), False)
        if not self._fs.rename(beside, self._at(name)):
            raise OSError(f"could not write {self.path}/{name}")

    def remove(self, name: str) -> None:
        self._fs.delete(self._at(name), True)


@dataclass
class State:
    """All commits that count, merged."""

    schema: T.StructType
    cells: dict[tuple[int, int, int], int] = field(default_factory=dict)
    stats: dict[tuple[int, int, str], list] = field(default_factory=dict)
    places: dict[tuple[int, int], list[int]] = field(default_factory=dict)  # batches of each segment
    batches: list[int] = field(default_factory=list)
    all_batches: list[int] = field(default_factory=list)

    @classmethod
    def merged(cls, commits: dict[int, dict]) -> State:
        out = cls(T.StructType([]))
        replaced = {b for c in commits.values() for b in c["replaces"]}
        out.all_batches = sorted(commits)
        for batch in out.all_batches:
            commit = commits[batch]
            known = out.schema.fieldNames()
            out.schema = T.StructType([*out.schema.fields, *[f for f in T.StructType.fromJson(commit["schema"]).fields if f.name not in known]])
            if batch in replaced:
                continue
            out.batches.append(batch)
            for bx, by, bz, n in commit["cells"]:
                out.cells[bx, by, bz] = out.cells.get((bx, by, bz), 0) + n
            for x, y in sorted({(c[0], c[1]) for c in commit["cells"]}):
                out.places.setdefault((x, y), []).append(batch)
            for bx, by, column, *x in commit["stats"]:
                out.stats[bx, by, column] = _both(out.stats.get((bx, by, column)), x)
        return out


def _both(a: list | None, b: list) -> list:
    """Statistics (n, total, least, most) of two sets of rows together; null where there is no value."""
    if a is None:
        return b
    fold = lambda f, x, y: y if x is None else x if y is None else f(x, y)
    return [a[0] + b[0], fold(lambda x, y: x + y, a[1], b[1]), fold(_least, a[2], b[2]), fold(_most, a[3], b[3])]


def _least(a: float, b: float) -> float:
    return b if a != a else a if b != b else min(a, b)


def _most(a: float, b: float) -> float:
    """NaN is above all numbers, as in SQL."""
    return a if a != a else b if b != b else max(a, b)


class SegmentTable:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._folder = Folder(spark, self.path)
        self._layout: Layout | None = None
        self._version: dict | None = None
        self._commits: dict[int, dict] = {}
        self._merged: State | None = None
        self.last_write: WriterStats | None = None

    @property
    def data_path(self) -> str:
        return f"{self.path}/data"

    def exists(self) -> bool:
        return self._layout is not None or self._folder.exists("_meta/layout")

    @property
    def layout(self) -> Layout:
        if self._layout is None:
            self._layout = Layout.from_json(self._folder.read("_meta/layout"))
        return self._layout

    def state(self) -> State:
        """What the commits say, read anew only where their folder has changed."""
        found = self._folder.files("_meta/commits")
        if self._merged is None or found != self._version:
            before = self._version or {}
            self._commits = {int(n): self._commits[int(n)] if before.get(n) == at else json.loads(self._folder.read(f"_meta/commits/{n}")) for n, at in found.items()}
            self._merged, self._version = State.merged(self._commits), found
        return self._merged

    @property
    def schema(self) -> T.StructType:
        return self.state().schema

    def kinds(self) -> dict[str, str]:
        """Types of the columns by name."""
        return {f.name: f.dataType.simpleString() for f in self.schema.fields}

    def write(self, df: DataFrame, layout: Layout | None = None, batch: int | None = None, replaces: list[int] | None = None) -> WriterStats:
        """Adds ``df`` as one batch. The first write fixes the layout and the types of its columns; one shuffle, by segment, splits what is large. -0.0 is stored as 0.0, which it equals in SQL, since Parquet's filters tell them apart."""
        if not self.exists():
            if layout is None:
                raise ValueError("the first write needs a layout")
            self._folder.write("_meta/layout", layout.to_json())
        elif layout is not None and layout != self.layout:
            raise ValueError("the table has another layout")
        x, y, z = self.layout.sizes()
        if x * y * z > MOST_CELLS:
            raise ValueError(f"a layout has at most {MOST_CELLS} combinations of buckets")
        if clash := {*BUCKETS, "batch"} & set(df.columns):
            raise ValueError(f"columns {sorted(clash)} are the table's own")
        state, own = self.state(), {f.name: f.dataType.simpleString() for f in df.schema.fields}
        if other := [n for n, kind in self.kinds().items() if own.get(n, kind) != kind]:
            raise ValueError(f"columns {other} have other types in the table")
        if batch is None:
            batch = max((b for b in state.all_batches if b < FIRST_STREAMED), default=0) + 1
        zero = {f.name: F.when(F.col(f"`{f.name}`") == 0, F.lit(0.0).cast(f.dataType)).otherwise(F.col(f"`{f.name}`")) for f in df.schema.fields if isinstance(f.dataType, (T.FloatType, T.DoubleType))}
        routed = self.layout.routed(df.withColumns(zero) if zero else df).withColumn("batch", F.lit(batch).cast("bigint"))
        self._folder.remove(f"data/batch={batch}")
        routed.hint("rebalance", "bx", "by_").write.options(maxRecordsPerFile=str(FILE_ROWS)).mode("append").partitionBy("batch", "bx", "by_").parquet(self.data_path)
        cells, stats = self._described(df.schema, batch)
        self._folder.write(f"_meta/commits/{batch}", json.dumps({"schema": json.loads(df.schema.json()), "cells": cells, "stats": stats, "replaces": replaces or []}))
        self.last_write = WriterStats(batch, sum(c[3] for c in cells), len({(c[0], c[1]) for c in cells}))
        return self.last_write

    def _described(self, schema: T.StructType, batch: int) -> tuple[list, list]:
        """Counts of combinations and statistics of segments of a batch that has been written, in one pass; as many rows come back as the layout has combinations, at most."""
        if not self._folder.exists(f"data/batch={batch}"):
            return [], []
        held = self.spark.read.schema(self._stored(schema)).parquet(self.data_path).where(F.col("batch") == batch)
        numbers = [f.name for f in schema.fields if isinstance(f.dataType, T.NumericType)]
        v = lambda c: F.col(f"`{c}`").cast("double")
        each = F.array(*[F.struct(F.count(F.col(f"`{c}`")).alias("n"), F.sum(v(c)).alias("total"), F.min(v(c)).alias("least"), F.max(v(c)).alias("most")) for c in numbers])
        rows = held.groupBy(*BUCKETS).agg(F.count("*").alias("n"), *[each.alias("stats")] * bool(numbers)).collect()
        stats: dict[tuple[int, int, str], list] = {}
        for r in rows:
            for c, x in zip(numbers, r["stats"] if numbers else [], strict=True):
                key = (r["bx"], r["by_"], c)
                stats[key] = _both(stats.get(key), list(x))
        return sorted([r["bx"], r["by_"], r["bz"], r["n"]] for r in rows), [[*k, *s] for k, s in sorted(stats.items())]

    @staticmethod
    def _stored(schema: T.StructType) -> T.StructType:
        return T.StructType([*schema.fields, T.StructField("bz", T.IntegerType()), T.StructField("batch", T.LongType()), T.StructField("bx", T.IntegerType()), T.StructField("by_", T.IntegerType())])

    def compact(self) -> None:
        """All batches as one, so that a long stream doesn't leave ever more files. The new commit replaces the others in one step; their files go afterwards."""
        old = self.state().batches
        if len(old) > 1:
            self.write(self.read(), replaces=old)
            for b in old:
                self._folder.remove(f"data/batch={b}")

    def _local(self, rows: list[tuple], schema: str) -> DataFrame:
        return self.spark.createDataFrame(rows, schema)

    def counts(self) -> DataFrame:
        """(bx, by_, bz, n) over committed batches: the existence bits in long form, with their rows."""
        return self._local([(*k, n) for k, n in self.state().cells.items()], "bx int, by_ int, bz int, n bigint")

    def stats(self) -> DataFrame:
        """(bx, by_, column, n, sum, min, max), merged over committed batches."""
        return self._local([(*k, *s) for k, s in self.state().stats.items()], "bx int, by_ int, column string, n bigint, sum double, min double, max double")

    def bitsets(self) -> DataFrame:
        """(bx, by_, bits): per segment a binary whose bits, lowest first, are the bz that occur."""
        found: dict[tuple[int, int], bytes] = {}
        for bx, by, bz in self.state().cells:
            found[bx, by] = bits.with_bit(found.get((bx, by), b""), bz)
        return self._local([(*k, bytearray(b)) for k, b in found.items()], "bx int, by_ int, bits binary").withColumn("bits", bits.padded(F.col("bits")))

    def _cells(self, predicate: Predicate) -> list[tuple[tuple[int, int, int], int]]:
        """Combinations that the predicate allows, with their rows."""
        state = self.state()
        allowed = [None if b is None else set(b) for b in predicate.buckets(self.layout, self.kinds()).values()]
        return [(k, n) for k, n in state.cells.items() if all(a is None or k[i] in a for i, a in enumerate(allowed))]

    def segments(self, predicate: Predicate | None = None, nan_is_high: bool = False) -> list[tuple[int, int]]:
        """Segments in which an allowed combination of buckets occurs.

        In SQL, NaN is above all numbers; ``nan_is_high`` keeps the segments
        that hold one, as their statistics tell, for ranges that are open above.
        """
        predicate = predicate or Predicate()
        found = {k[:2] for k, _ in self._cells(predicate)}
        for dim in self.layout.dimensions if nan_is_high else ():
            ranges = [x for x in predicate.of(dim.name) if isinstance(x, Range)]
            if dim.kind == routing.MAGNITUDE and ranges and all(x.high is None for x in ranges):
                found |= {(bx, by) for (bx, by, c), s in self.state().stats.items() if c == dim.name and s[3] is not None and s[3] != s[3]}
        return sorted(found)

    def surviving(self, predicate: Predicate, nan_is_high: bool = False) -> DataFrame:
        """(bx, by_) of ``segments``."""
        return self._local(self.segments(predicate, nan_is_high), "bx int, by_ int")

    def paths(self, segments: list[tuple[int, int]]) -> list[str]:
        places = self.state().places
        return [f"{self.data_path}/batch={b}/bx={x}/by_={y}" for x, y in segments for b in places[x, y]]

    def scan(self, segments: list[tuple[int, int]], with_buckets: bool = False) -> DataFrame:
        """All rows of these segments: only their folders are listed, and no footer is read for the schema."""
        schema = self._stored(self.schema)
        paths = self.paths(segments)
        df = self.spark.read.schema(schema).option("basePath", self.data_path).parquet(*paths) if paths else self.spark.createDataFrame([], schema)
        return df if with_buckets else df.select(*[F.col(f"`{c}`") for c in self.schema.fieldNames()])

    def read(self, predicate: Predicate | None = None, with_buckets: bool = False) -> DataFrame:
        """All rows, or those that match: folders pruned by segment, row groups by pushed filters, then filtered exactly."""
        df = self.scan(self.segments(predicate), with_buckets)
        return df if predicate is None else df.where(predicate.column())

    def segment_filter(self, predicate: Predicate, nan_is_high: bool = False) -> Column:
        """Condition on bx and by_ of the surviving segments."""
        by_x: dict[int, list[int]] = {}
        for bx, by in self.segments(predicate, nan_is_high):
            by_x.setdefault(bx, []).append(by)
        out = F.lit(False)
        for bx, bys in sorted(by_x.items()):
            out = out | ((F.col("bx") == bx) & F.col("by_").isin(*bys))
        return out

    def report(self, predicate: Predicate, nan_is_high: bool = False) -> PruneReport:
        return PruneReport(len(self.segments(predicate, nan_is_high)), len(self.state().places))

    def info(self) -> DataFrame:
        """segments, rows and whole rows a segment."""
        segments, rows = len(self.state().places), sum(self.state().cells.values())
        return self._local([(segments, rows, rows // segments if segments else 0)], "segments bigint, rows bigint, rows_per_segment bigint")

    def count_upper_bound(self, predicate: Predicate) -> DataFrame:
        """Rows in the allowed bucket combinations, from metadata alone: never fewer than match."""
        return self._local([(sum(n for _, n in self._cells(predicate)),)], "n bigint")

    def approx_aggregates(self, predicate: Predicate, column: str) -> DataFrame:
        """count, sum, min, max and avg of whole surviving segments, from metadata alone; null where there are none."""
        found = set(self.segments(predicate))
        rows = [s for (bx, by, c), s in self.state().stats.items() if c == column and (bx, by) in found]
        rows = self._local(rows, "n bigint, sum double, min double, max double")
        return rows.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.sum("sum").alias("total"), F.min("min").alias("least"), F.max("max").alias("most")).withColumn("mean", F.try_divide("total", "n"))

    def files(self) -> DataFrame:
        """(path, bytes) of the data files of committed batches, from the listing that Spark keeps."""
        paths = [f"{self.data_path}/batch={b}" for b in self.state().batches if self._folder.exists(f"data/batch={b}")]
        if not paths:
            return self._local([], "path string, bytes bigint")
        return self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.parquet").load(paths).select("path", F.col("length").alias("bytes"))

    def file_stats(self) -> DataFrame:
        """files, data_bytes, metadata_bytes and whole data bytes a file."""
        meta = sum(n for _, n in self._folder.files("_meta/commits").values()) + sum(n for _, n in self._folder.files("_meta").values())
        each = self.files().agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("data_bytes"))
        return each.select("files", "data_bytes", F.lit(meta).cast("bigint").alias("metadata_bytes"), F.when(F.col("files") > 0, F.expr("data_bytes div files")).otherwise(0).alias("mean_bytes"))
