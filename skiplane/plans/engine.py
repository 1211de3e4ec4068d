"""The front door: load tables, query them in SQL with pruning, look at what there is."""

from __future__ import annotations

import re
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplane.operators.layout import Layout
from skiplane.plans.predicate import Predicate, read_plan
from skiplane.sources.segments import PruneReport, SegmentTable
from skiplane.sources.text import read_csv


#: Rows that a response may have.
MOST_ROWS = 100_000


class UnknownTable(KeyError):
    pass


@dataclass
class QueryResult:
    """Rows, and for each table how many of its segments were read."""

    df: DataFrame
    reports: dict[str, PruneReport] = field(default_factory=dict)
    began: float = field(default_factory=time.perf_counter)

    @property
    def columns(self) -> list[str]:
        return self.df.columns

    @property
    def schema(self):
        return self.df.schema

    def arrow(self):
        return self.df.toArrow()

    def envelope(self, most_rows: int = MOST_ROWS) -> dict:
        """columns (by name), rows, row_count, segments_scanned, segments_total and elapsed_ms. A result of more than ``most_rows`` is an error: it belongs in a table, not in a response."""
        columns = sorted(self.columns)
        rows = self.df.select(*[F.col(f"`{c}`") for c in columns]).limit(most_rows + 1).collect()
        if len(rows) > most_rows:
            raise ValueError(f"more than {most_rows} rows; write the result to a table or add a LIMIT")
        segments = list(self.reports.values())
        return {"columns": columns, "rows": [list(r) for r in rows], "row_count": len(rows), "segments_scanned": sum(r.segments_scanned for r in segments), "segments_total": sum(r.segments_total for r in segments), "elapsed_ms": round((time.perf_counter() - self.began) * 1000, 3)}


class Engine:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._tables: dict[str, SegmentTable] = {}
        self._lock = threading.RLock()

    def _path(self, name: str) -> str:
        if not re.fullmatch(r"[A-Za-z0-9_]+", name):
            raise ValueError(f"bad table name {name!r}")
        return f"{self.root}/{name}"

    def _table(self, name: str) -> SegmentTable:
        if name not in self._tables:
            self._tables[name] = SegmentTable(self.spark, self._path(name))
        return self._tables[name]

    def names(self) -> list[str]:
        """Tables in the folder; layouts are read from what was saved, so a restart changes nothing."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(self.root)
        fs = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        found = [s.getPath().getName() for s in fs.listStatus(path) if s.isDirectory()] if fs.exists(path) else []
        return sorted(n for n in found if re.fullmatch(r"[A-Za-z0-9_]+", n) and self._table(n).exists())

    def table(self, name: str) -> SegmentTable:
        table = SegmentTable(self.spark, self._path(name)) if name not in self._tables else self._tables[name]
        if not table.exists():
            raise UnknownTable(name)
        return self._table(name)

    def load(self, name: str, rows: DataFrame | str, layout: Layout | None = None) -> SegmentTable:
        """Creates the table or appends to it; text is the path of a CSV with a header."""
        table = self._table(name)
        table.write(read_csv(self.spark, rows) if isinstance(rows, str) else rows, layout)
        return table

    def tables(self) -> DataFrame:
        """(name, segments, rows, rows_per_segment), from metadata alone."""
        each = [(n, *self.table(n).info().first()) for n in self.names()]
        return self.spark.createDataFrame(each, "name string, segments bigint, rows bigint, rows_per_segment bigint")

    def health(self) -> dict:
        return {"status": "ok", "tables": len(self.names())}

    @contextmanager
    def _views(self, frames: dict[str, DataFrame]) -> Iterator[None]:
        """Views of these names while SQL is analysed; what the session had under them comes back."""
        catalog = self.spark.catalog
        with self._lock:
            held = {n: self.spark.table(n) for n in frames if any(t.name == n.lower() and t.isTemporary for t in catalog.listTables(pattern=n.lower()))}
            try:
                for n, df in frames.items():
                    df.createOrReplaceTempView(n)
                yield
            finally:
                for n in frames:
                    if n in held:
                        held[n].createOrReplaceTempView(n)
                    else:
                        catalog.dropTempView(n)

    def query(self, sql: str, args: dict | None = None) -> QueryResult:
        """Any SQL over the tables. Conditions are read back from the optimized plan, and segments that can't match aren't read; the result is that of the plain query. The session's views stay as they are."""
        began = time.perf_counter()
        words = set(re.findall(r"\w+", sql.lower()))
        used = {n: self._table(n) for n in self.names() if n.lower() in words}
        everything = {n: t.segments() for n, t in used.items()}
        # One segment of each table is enough to see what the query asks of it.
        with self._views({n: t.scan(everything[n][:1]) for n, t in used.items()}):
            plan = self.spark.sql(sql, args=args or {})._jdf.queryExecution().optimizedPlan()
        predicates = read_plan(plan, {n: t.data_path for n, t in used.items()})
        chosen = {n: t.segments(predicates.get(n), nan_is_high=True) for n, t in used.items()}
        with self._views({n: t.scan(chosen[n]) for n, t in used.items()}):
            df = self.spark.sql(sql, args=args or {})
        return QueryResult(df, {n: PruneReport(len(chosen[n]), len(everything[n])) for n in used}, began)

    def aggregate(self, name: str, column: str, predicate: Predicate | None = None, approx: bool = False) -> DataFrame:
        """n, total, least, most, mean of a column: exact, or of whole segments from metadata alone."""
        table = self.table(name)
        if approx:
            return table.approx_aggregates(predicate or Predicate(), column)
        c = F.col(f"`{column}`")
        return table.read(predicate).agg(F.count(c).alias("n"), F.sum(c).alias("total"), F.min(c).alias("least"), F.max(c).alias("most"), F.avg(c).alias("mean"))
