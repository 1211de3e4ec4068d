"""``spark.read.format("segments")``: a Python data source that prunes segments from pushed filters.

The convenience path for plain SQL; ``SegmentTable.read`` stays on the JVM and
is the fast one. Options: path (a folder that executors can open). Needs
``spark.sql.python.filterPushdown.enabled``.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.dataset as ds
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

from skiplane.operators.layout import Layout
from skiplane.plans.predicate import Predicate
from skiplane.sources.segments import State


def _system(path: str) -> tuple[fs.FileSystem, str]:
    """A local path, or the address of a store that pyarrow knows."""
    return fs.FileSystem.from_uri(path) if ":/" in path else (fs.LocalFileSystem(), path)


def _state(path: str) -> tuple[Layout, State]:
    system, at = _system(path)
    text = lambda p: system.open_input_stream(p).read().decode()
    names = [i for i in system.get_file_info(fs.FileSelector(f"{at}/_meta/commits", allow_not_found=True)) if i.base_name.isdigit()]
    return Layout.from_json(text(f"{at}/_meta/layout")), State.merged({int(i.base_name): json.loads(text(i.path)) for i in names})


class SegmentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "segments"

    def schema(self):
        return _state(self.options["path"])[1].schema

    def reader(self, schema) -> DataSourceReader:
        return SegmentReader(self.options["path"], schema.fieldNames())


class SegmentReader(DataSourceReader):
    def __init__(self, path: str, names: list[str]):
        self.path, self.names, self.predicate = path, names, Predicate()

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            column = f.attribute[0] if len(getattr(f, "attribute", ())) == 1 else None
            if column is not None and isinstance(f, EqualTo):
                self.predicate.eq(column, f.value)
            elif column is not None and isinstance(f, In):
                self.predicate.eq(column, *f.value)
            elif column is not None and isinstance(f, (GreaterThan, GreaterThanOrEqual)) and isinstance(f.value, (int, float)):
                self.predicate.between(column, low=f.value)
            elif column is not None and isinstance(f, (LessThan, LessThanOrEqual)) and isinstance(f.value, (int, float)):
                self.predicate.between(column, high=f.value)
            yield f  # Spark still filters exactly

    def partitions(self) -> list[InputPartition]:
        layout, state = _state(self.path)
        allowed = list(self.predicate.buckets(layout, {f.name: f.dataType.simpleString() for f in state.schema.fields}).values())
        kept = {c[:2] for c in state.cells if all(a is None or c[i] in a for i, a in enumerate(allowed))}
        system, at = _system(self.path)
        out = []
        for x, y in sorted(kept):
            for batch in state.places[x, y]:
                found = system.get_file_info(fs.FileSelector(f"{at}/data/batch={batch}/bx={x}/by_={y}"))
                out += [InputPartition(i.path) for i in found if i.base_name.endswith(".parquet") and not i.base_name.startswith((".", "_"))]
        return out

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is not None:
            held = ds.dataset(partition.value, format="parquet", filesystem=_system(self.path)[0])
            there = [n for n in self.names if n in held.schema.names]
            for batch in held.to_batches(columns=there):
                yield pa.RecordBatch.from_arrays([batch.column(n) if n in there else pa.nulls(batch.num_rows) for n in self.names], names=self.names)
