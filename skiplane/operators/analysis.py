"""Studies of layouts: zone maps, equi-depth buckets, pruning lag, bytes touched, scale tiling."""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiplane.functions import routing

#: Dollars for a terabyte scanned.
DOLLARS_A_TB = 5.0


def chunked(df: DataFrame, order: str, chunk_rows: int) -> DataFrame:
    """``df`` with ``chunk``: rows in order of arrival, so many each. ``order`` must be dense from 0, so that no global sort is needed."""
    return df.withColumn("chunk", F.expr(f"`{order}` div {int(chunk_rows)}"))


def zone_map(df: DataFrame, value: str, chunk: str = "chunk") -> DataFrame:
    """(chunk, n, least, most) of each chunk."""
    return df.groupBy(chunk).agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def touched(zones: DataFrame, low: float | None = None, high: float | None = None) -> DataFrame:
    """Zones that a range may have rows in."""
    if low is not None:
        zones = zones.where(F.col("most") >= low)
    return zones.where(F.col("least") <= high) if high is not None else zones


#: Rows of a span of values that one task puts in order; wider spans are narrowed first.
ROWS_A_SPAN = 100_000
#: Of the sketch that narrows spans: a rank is off by one part in so many.
ACCURACY = 10_000


def _place(v: Column, edges: list[float]) -> Column:
    """How many of the edges are at most the value: a sum of comparisons, which stays in generated code."""
    return reduce(lambda a, b: a + b, [(v >= e).cast("int") for e in edges]) if edges else F.lit(0)


@dataclass
class _Span:
    """Values from ``low`` to ``high``, both included: rows below, rows inside, and the ranks looked for there."""

    low: float
    high: float
    before: int
    rows: int
    ranks: list[int]

    def has(self, v: Column) -> Column:
        return (v >= self.low) & (v <= self.high)


def _narrowed(rows: DataFrame, wide: list[_Span], slack: float) -> list[_Span]:
    """Spans around the ranks of ``wide`` by a sketch of each, overlapping ones joined, with exact counts; two passes, and one row to the driver in each."""
    v, told = F.col("v"), []
    for s in wide:
        near = [min(max((k - s.before + 0.5) / s.rows + side * slack, 0.0), 1.0) for k in s.ranks for side in (-1, 1)]
        told.append(F.percentile_approx(F.when(s.has(v), v), near, ACCURACY))
    spans: list[_Span] = []
    for s, cuts in zip(wide, rows.agg(*told).first(), strict=True):
        own: list[_Span] = []
        for k, low, high in zip(s.ranks, cuts[::2], cuts[1::2], strict=True):
            if own and low <= own[-1].high:
                own[-1].high = max(own[-1].high, high)
                own[-1].ranks.append(k)
            else:
                own.append(_Span(low, high, 0, 0, [k]))
        spans += own
    found = rows.agg(*[F.count(F.when(c, 1)) for s in spans for c in (v < s.low, s.has(v))]).first()
    for s, before, inside in zip(spans, found[::2], found[1::2], strict=True):
        s.before, s.rows = before, inside
    return spans


def quantiles(df: DataFrame, value: str, shares: list[float], most: int = ROWS_A_SPAN) -> list[float]:
    """Exact quantiles, interpolated between the two values around a rank; null and NaN don't count. Empty: no numbers.

    A sketch gives a span of values around each rank, and exact counts place
    it; spans of more than ``most`` rows are narrowed again, to about 4 /
    ``ACCURACY`` of their rows each time. Only values inside the last spans are
    grouped and put in order, each span in a task of its own.
    """
    v = F.col("v")
    rows = df.select(F.col(f"`{value}`").cast("double").alias("v")).where("v IS NOT NULL AND NOT isnan(v)")
    total = rows.count()
    if not total:
        return []
    places = [s * (total - 1) for s in shares]
    spans = [_Span(-math.inf, math.inf, 0, total, sorted({k for p in places for k in (math.floor(p), math.ceil(p))}))]
    slack = 2 / ACCURACY
    while slack < 1 and (wide := [s for s in spans if s.rows > most and s.low < s.high]):
        tight = _narrowed(rows, wide, slack)
        if not all(t.before <= k < t.before + t.rows for t in tight for k in t.ranks):
            slack *= 4  # the sketch was off by more than it says
        elif sum(t.rows for t in tight) < sum(s.rows for s in wide):
            spans = [s for s in spans if s not in wide] + tight
        else:  # what is left is mostly equal values, which grouping makes few
            break
    span = reduce(lambda a, b: a.when(b[1].has(v), b[0]), enumerate(spans[1:], 1), F.when(spans[0].has(v), 0))
    counts = rows.select("v", span.alias("span")).where("span IS NOT NULL").groupBy("span", "v").agg(F.count("*").alias("n"))
    upto = counts.withColumn("upto", F.sum("n").over(Window.partitionBy("span").orderBy("v")))
    ranks = df.sparkSession.createDataFrame([(i, k, k - s.before) for i, s in enumerate(spans) for k in s.ranks], "span int, k bigint, own bigint")  # two rows for each share at most
    at = {r["k"]: r["v"] for r in upto.join(F.broadcast(ranks), "span").where("own < upto AND own >= upto - n").select("k", "v").collect()}
    return [at[math.floor(p)] + ((at[math.ceil(p)] - at[math.floor(p)]) * (p - math.floor(p)) if p > math.floor(p) else 0.0) for p in places]


def equi_depth(df: DataFrame, value: str, buckets: int) -> DataFrame:
    """``df`` with ``depth``: how many of the interpolated quantile cuts are at most the value."""
    cuts = quantiles(df, value, [i / buckets for i in range(1, buckets)])
    depth = _place(F.col(f"`{value}`").cast("double"), cuts)
    return df.withColumn("depth", depth)


def skippable(bucket: Column, threshold: float) -> Column:
    """Whether a magnitude bucket lies below a threshold as a whole."""
    return F.pow(F.lit(2.0), bucket + 1) <= threshold


def _summed(df: DataFrame, order: str, columns: list[str], block: int = 4096) -> DataFrame:
    """``df`` with running sums ``all_…``: within blocks of the order, plus the sums of the blocks before, so that no task sees more than a block or one row a block."""
    rows = df.withColumn("__block", F.expr(f"`{order}` div {block}"))
    before = rows.groupBy("__block").agg(*[F.sum(c).alias(c) for c in columns])
    up = Window.orderBy("__block")
    before = before.select("__block", *[(F.sum(c).over(up) - F.col(c)).alias(f"__{c}") for c in columns])
    within = Window.partitionBy("__block").orderBy(order)
    return rows.join(before, "__block").select(*df.columns, *[(F.sum(c).over(within) + F.col(f"__{c}")).alias(f"all_{c}") for c in columns])


def pruning_lag(df: DataFrame, order: str, value: str, threshold: float, chunk_rows: int, compact_every: int) -> DataFrame:
    """By chunk of arrival, the share of rows so far that ``value >= threshold`` can skip.

    zone_map: rows of full chunks whose maximum is below, of the rows in full
    chunks. compacted: rows below that had arrived when chunks were last merged
    in value order, every ``compact_every`` full ones, of all rows.
    compacted_and_zones: those, and since then the chunks that a zone map skips.
    magnitude: rows in magnitude buckets that lie below as a whole, of all rows.
    """
    rows = chunked(df, order, chunk_rows)
    below, v = F.col(value) < threshold, F.col(value)
    each = rows.groupBy("chunk").agg(
        F.count("*").alias("n"),
        F.max(value).alias("most"),
        F.sum(below.cast("bigint")).alias("below"),
        F.sum(((v < 1) & F.lit(threshold >= 2) | (v >= 1) & skippable(routing.exact_log2(F.greatest(v, F.lit(1.0))), threshold)).cast("bigint")).alias("skip"),
    )
    full = F.col("n") == chunk_rows
    each = each.withColumns({"closed": F.when(full, F.col("n")).otherwise(0), "zone": F.when(full & (F.col("most") < threshold), F.col("n")).otherwise(0)})
    each = _summed(each, "chunk", ["n", "below", "skip", "closed", "zone"])
    # A round begins with the chunk that is merged last; what came in it since then isn't merged.
    round_ = F.expr(f"(chunk + 1) div {int(compact_every)}")
    since = Window.partitionBy("round").orderBy("chunk")
    late = {c: F.sum(F.when(F.col("merges"), 0).otherwise(F.col(c))).over(since) for c in ("below", "zone")}
    each = each.withColumns({"round": round_, "merges": ((F.col("chunk") + 1) % compact_every == 0) & full}).withColumns({"late_below": late["below"], "late_zone": late["zone"]})
    merged = F.when(F.col("round") > 0, F.col("all_below") - F.col("late_below")).otherwise(0)
    share = lambda c, of: F.round(F.try_divide(c, F.col(of)), 6)
    return each.select("chunk", F.coalesce(share(F.col("all_zone"), "all_closed"), F.lit(0.0)).alias("zone_map"), share(merged, "all_n").alias("compacted"), share(merged + F.col("late_zone"), "all_n").alias("compacted_and_zones"), share(F.col("all_skip"), "all_n").alias("magnitude"))


def row_groups(df: DataFrame, column: str) -> DataFrame:
    """(path, row_group, n, least, most, bytes) of the Parquet row groups behind ``df``, read from footers on the executors.

    Footers are read by pyarrow, whose file systems are local folders, HDFS and
    the common object stores; other addresses are an error.
    """
    from collections.abc import Iterator

    import pandas as pd

    def footers(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import pyarrow.parquet as pq
        from pyarrow import fs

        for batch in batches:
            out = []
            for path in batch["path"]:
                system, at = fs.FileSystem.from_uri(path if "://" in path else "file://" + path.removeprefix("file:"))
                meta = pq.ParquetFile(system.open_input_file(at)).metadata
                place = meta.schema.to_arrow_schema().names.index(column)
                for g in range(meta.num_row_groups):
                    c = meta.row_group(g).column(place)
                    s = c.statistics if c.is_stats_set else None
                    out.append((path, g, meta.row_group(g).num_rows, float(s.min) if s and s.has_min_max else None, float(s.max) if s and s.has_min_max else None, c.total_compressed_size))
            yield pd.DataFrame(out, columns=["path", "row_group", "n", "least", "most", "bytes"])

    files = df.select(F.col("_metadata.file_path").alias("path")).distinct()
    return files.mapInPandas(footers, "path string, row_group int, n bigint, least double, most double, bytes bigint")


def byte_cost(groups: DataFrame, low: float | None, high: float | None) -> DataFrame:
    """(groups, n, bytes, dollars) of the row groups that a range touches; groups without statistics count."""
    hit = F.lit(True)
    if low is not None:
        hit = hit & (F.col("most").isNull() | (F.col("most") >= low))
    if high is not None:
        hit = hit & (F.col("least").isNull() | (F.col("least") <= high))
    out = groups.where(hit).agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    return out.withColumn("dollars", F.col("bytes") / 1e12 * DOLLARS_A_TB)


def tiled(df: DataFrame, times: int, value: str | None = None, jitter: float = 0.0, seed: int = 7) -> DataFrame:
    """``df`` so many times over, with ``copy``; ``value`` off by up to ``jitter`` of itself."""
    out = df.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    return out.withColumn(value, F.col(value) * (1 + (F.rand(seed) * 2 - 1) * jitter)) if value and jitter else out
