"""The registered queries of the engine and their SQL.

Each filter query reads a segment table with pruning; its SQL reads the raw
table, so equal results mean that pruning has lost nothing.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplane.functions import bits, routing
from skiplane.operators import analysis, layouts
from skiplane.operators.layout import Layout
from skiplane.plans.engine import Engine
from skiplane.plans.predicate import Predicate, Range
from skiplane.sources import datagen, segments, text

LAYOUTS = {
    "events": Layout.of(event_type=("hash", 4), value=("magnitude", 16), user_id=("hash", 24)),
    "orders": Layout.of(o_orderpriority=("hash", 4), o_totalprice=("magnitude", 20), o_orderstatus=("hash", 4)),
    "lineitem": Layout.of(l_returnflag=("hash", 4), l_extendedprice=("magnitude", 20), l_linestatus=("hash", 4)),
    "customer": Layout.of(c_mktsegment=("hash", 8), c_acctbal=("magnitude", 16)),
}
#: Tables with columns made for pruning by types: name to the raw table, the columns, and the layout.
MADE = {
    "orders_typed": ("orders", "o_orderkey, o_totalprice, cast(o_totalprice AS decimal(12,2)) AS price, cast(o_orderdate AS date) AS day, o_orderstatus = 'F' AS filled, cast(o_custkey AS double) AS customer", Layout.of(customer=("hash", 16), day=("hash", 16), price=("magnitude", 20))),
    "orders_priced": ("orders", "o_orderkey, cast(o_totalprice AS decimal(12,2)) AS price, o_orderstatus = 'F' AS filled", Layout.of(price=("hash", 16), filled=("hash", 2))),
}
_engines: dict[tuple[str, str], Engine] = {}


def _engine(spark: SparkSession, sf_dir: str, *names: str) -> Engine:
    """Segment tables made once a session from the raw ones."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _engines:
        _engines[key] = Engine(spark, segments.scratch(spark, f"segments-{key[0]}-{zlib.crc32(sf_dir.encode())}"))
    for n in names:
        if n not in _engines[key].names():
            source, columns, layout = MADE.get(n) or (n, "*", LAYOUTS[n])
            _engines[key].load(n, raw(spark, sf_dir, source).selectExpr(*_split(columns)), layout)
    return _engines[key]


def _split(columns: str) -> list[str]:
    """The items of a select list; commas in brackets don't part."""
    return [c.strip() for c in re.split(r",(?![^()]*\))", columns)]


def raw(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_sql: dict[str, str] = {}


def _register(name: str, sql: str | None):
    def add(f):
        _queries[name] = f
        if sql:
            _sql[name] = sql
        return f

    return add


def _filtered(name: str, table: str, predicate: Callable[[], Predicate], columns: str, where: str) -> None:
    _register(name, f"SELECT {columns} FROM {table} WHERE {where}")(lambda spark, sf: _engine(spark, sf, table).table(table).read(predicate()).select(*columns.split(", ")))


EVENT, ORDER, LINE, CUSTOMER = "event_id, user_id, event_type, value", "o_orderkey, o_orderstatus, o_totalprice, o_orderpriority", "l_orderkey, l_linenumber, l_quantity, l_extendedprice", "c_custkey, c_acctbal, c_mktsegment"
P = Predicate
for args in (
    ("eq_categorical", "events", lambda: P().eq("event_type", "click"), EVENT, "event_type = 'click'"),
    ("in_list", "events", lambda: P().eq("event_type", "click", "error"), EVENT, "event_type IN ('click', 'error')"),
    ("range_closed", "events", lambda: P().between("value", 64, 127.5), EVENT, "value BETWEEN 64 AND 127.5"),
    ("range_open_low", "events", lambda: P().between("value", high=2.5), EVENT, "value <= 2.5"),
    ("range_open_high", "events", lambda: P().between("value", low=200), EVENT, "value >= 200"),
    ("range_strict", "lineitem", lambda: P().above("l_quantity", 10).below("l_quantity", 20), LINE, "l_quantity > 10 AND l_quantity < 20"),
    ("between_pruned", "lineitem", lambda: P().between("l_extendedprice", 32768, 40000), LINE, "l_extendedprice BETWEEN 32768 AND 40000"),
    ("eq_and_range", "events", lambda: P().eq("event_type", "error").between("value", 100, 500), EVENT, "event_type = 'error' AND value BETWEEN 100 AND 500"),
    ("three_dim", "orders", lambda: P().eq("o_orderpriority", "1-URGENT").between("o_totalprice", 100000, 200000).eq("o_orderstatus", "F"), ORDER, "o_orderpriority = '1-URGENT' AND o_totalprice BETWEEN 100000 AND 200000 AND o_orderstatus = 'F'"),
    ("negatives", "customer", lambda: P().between("c_acctbal", -500, 50), CUSTOMER, "c_acctbal BETWEEN -500 AND 50"),
    ("range_on_hash_dim", "events", lambda: P().between("user_id", 20, 60), EVENT, "user_id BETWEEN 20 AND 60"),
    ("narrowed_twice", "events", lambda: P().between("value", low=50).where("value", Range(high=300)).above("value", 75).eq("event_type", "view", "click").eq("event_type", "click"), EVENT, "value > 75 AND value <= 300 AND event_type = 'click'"),
):
    _filtered(*args)


def _front_door(name: str, table: str, sql: str, *more: str) -> None:
    _register(name, sql)(lambda spark, sf: _engine(spark, sf, table, *more).query(sql).df)


_front_door("or_not_like_residual", "orders", f"SELECT {ORDER} FROM orders WHERE (o_orderstatus = 'F' OR o_totalprice > 450000) AND o_orderpriority NOT IN ('1-URGENT', '2-HIGH') AND o_orderpriority LIKE '%O%' AND o_totalprice NOT BETWEEN 1000 AND 50000")
_front_door("reversed_literal", "lineitem", f"SELECT {LINE} FROM lineitem WHERE 100000 <= l_extendedprice AND 45 > l_quantity")
_front_door("limit_ordered", "events", f"SELECT {EVENT} FROM events WHERE event_type = 'error' ORDER BY event_id LIMIT 100")
_front_door("count_exact", "lineitem", "SELECT count(*) AS n FROM lineitem WHERE l_extendedprice >= 65536")
_front_door("agg_all", "lineitem", "SELECT count(l_quantity) AS n, round(sum(l_extendedprice), 2) AS total, round(avg(l_extendedprice), 4) AS mean, min(l_extendedprice) AS least, max(l_extendedprice) AS most FROM lineitem WHERE l_returnflag = 'R' AND l_extendedprice BETWEEN 5000 AND 70000")
_front_door("agg_empty", "events", "SELECT count(*) AS n, sum(value) AS total FROM events WHERE value >= 100000")
_front_door("group_having", "orders", "SELECT o_orderpriority, o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders WHERE o_totalprice >= 131072 GROUP BY o_orderpriority, o_orderstatus HAVING count(*) > 5")
_front_door("join_pruned", "orders", "SELECT c_mktsegment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_totalprice > 262144 AND c_acctbal < 1000 GROUP BY c_mktsegment", "customer")
_front_door("semi_anti", "orders", "SELECT count(*) AS n FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_totalprice > 400000) AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'P')", "customer")
_front_door("window_rank", "orders", "SELECT o_orderkey, o_orderpriority, r FROM (SELECT o_orderkey, o_orderpriority, CAST(row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS BIGINT) AS r FROM orders WHERE o_totalprice >= 262144) t WHERE r <= 10")
_front_door("set_operations", "events", "SELECT user_id FROM events WHERE event_type = 'error' EXCEPT SELECT user_id FROM events WHERE event_type = 'click' AND value >= 128")
_front_door("cte_union", "events", "WITH big AS (SELECT event_id, value FROM events WHERE value >= 256) SELECT event_id, value FROM big UNION ALL SELECT event_id, value FROM events WHERE value < 0.5")
_front_door("distinct_combinations", "events", "SELECT DISTINCT event_type, user_id FROM events WHERE value BETWEEN 128 AND 256")
_front_door("rollup_totals", "lineitem", "SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem WHERE l_extendedprice < 16384 GROUP BY ROLLUP (l_returnflag, l_linestatus)")

_DAYS = ", ".join(f"DATE '1995-{m:02d}-{d:02d}'" for m in range(1, 7) for d in (3, 17, 28))


def _typed(name: str, table: str, where: str, sql_where: str) -> None:
    _register(name, f"SELECT o_orderkey FROM orders WHERE {sql_where}")(lambda spark, sf: _engine(spark, sf, table).query(f"SELECT o_orderkey FROM {table} WHERE {where}").df)


_typed("eq_double_hash", "orders_typed", "customer = 100.0D", "o_custkey = 100")
_typed("in_dates_hash", "orders_typed", f"day IN ({_DAYS})", f"CAST(o_orderdate AS DATE) IN ({_DAYS})")
_typed("eq_decimal_magnitude", "orders_typed", "price = (SELECT max(price) FROM orders_typed) OR price BETWEEN 262144.00 AND 262500.25", "CAST(o_totalprice AS DECIMAL(12,2)) = (SELECT max(CAST(o_totalprice AS DECIMAL(12,2))) FROM orders) OR CAST(o_totalprice AS DECIMAL(12,2)) BETWEEN 262144.00 AND 262500.25")
_PRICES = ", ".join(f"{p}.50" for p in range(100000, 400000, 1300))
_typed("in_decimals_hash", "orders_priced", f"price BETWEEN 200000 AND 200500 OR price IN ({_PRICES}) OR price = 150000.00", f"CAST(o_totalprice AS DECIMAL(12,2)) BETWEEN 200000 AND 200500 OR CAST(o_totalprice AS DECIMAL(12,2)) IN ({_PRICES}) OR CAST(o_totalprice AS DECIMAL(12,2)) = 150000.00")
_typed("eq_boolean_hash", "orders_priced", "filled = true AND price >= 400000", "o_orderstatus = 'F' AND o_totalprice >= 400000")


#: Bucket rules as DuckDB text.
def _hb(c: str, n: int) -> str:
    return f"CAST(('0x' || substr(md5(CAST({c} AS VARCHAR)), 1, 8))::BIGINT % {n} AS INTEGER)"


def _mb(c: str, n: int) -> str:
    b = f"floor(log2({c}))"
    return f"CAST(CASE WHEN {c} IS NULL OR isnan({c}) OR {c} < 1 THEN 0 WHEN {c} >= pow(2.0, {n - 1}) THEN {n - 1} ELSE {b} + (CASE WHEN {c} >= pow(2.0, {b} + 1) THEN 1 ELSE 0 END) - (CASE WHEN {c} < pow(2.0, {b}) THEN 1 ELSE 0 END) END AS INTEGER)"


_routed = f"(SELECT *, {_hb('event_type', 4)} AS bx, {_mb('value', 16)} AS by_, {_hb('user_id', 24)} AS bz FROM events)"
_error = f"bx = {routing.hash_bucket_of('error', 4)} AND by_ BETWEEN 6 AND 8"
_flag = lambda: P().eq("event_type", "error").between("value", 100, 500)
_events = lambda spark, sf: _engine(spark, sf, "events").table("events")


@_register("magnitude_histogram", f"SELECT {_mb('value', 16)} AS bucket, count(*) AS n, min(value) AS least, max(value) AS most FROM events GROUP BY 1")
def _(spark, sf):
    return raw(spark, sf, "events").groupBy(routing.magnitude_bucket(F.col("value"), 16).alias("bucket")).agg(F.count("*").alias("n"), F.min("value").alias("least"), F.max("value").alias("most"))


@_register("hash_histogram", f"SELECT {_hb('o_orderpriority', 4)} AS bucket, count(*) AS n FROM orders GROUP BY 1")
def _(spark, sf):
    return raw(spark, sf, "orders").groupBy(routing.hash_bucket(F.col("o_orderpriority"), 4).alias("bucket")).agg(F.count("*").alias("n"))


@_register("segment_keys", f"SELECT bx, by_, CAST(count(*) AS BIGINT) AS n FROM {_routed} GROUP BY bx, by_")
def _(spark, sf):
    return _events(spark, sf).counts().groupBy("bx", "by_").agg(F.sum("n").alias("n"))


@_register("bitset_index_counts", f"SELECT bx * 384 + by_ * 24 + bz AS idx, CAST(count(*) AS BIGINT) AS n FROM {_routed} GROUP BY 1")
def _(spark, sf):
    return _events(spark, sf).counts().select(routing.bitset_index(F.col("bx"), F.col("by_"), F.col("bz"), 16, 24).alias("idx"), "n")


_RANGES = ((1, 7), (4, 6), (1, 1000), (100, 200), (50, 500), (10, 5), (-5, -1), (-5, 3), (0.25, 0.5), (1000, 1e9))


@_register("range_buckets", "SELECT lo, hi, CAST(b AS INTEGER) AS bucket FROM (SELECT lo, hi, unnest(CASE WHEN lo > hi THEN [] WHEN hi < 1 THEN [0] ELSE range(CAST(least(floor(log2(greatest(lo, 1))), 15) AS BIGINT), CAST(least(floor(log2(greatest(hi, 1))), 15) AS BIGINT) + 1) END) AS b FROM (VALUES " + ", ".join(f"({float(a)}::DOUBLE, {float(b)}::DOUBLE)" for a, b in _RANGES) + ") t(lo, hi))")
def _(spark, sf):
    return spark.createDataFrame([(float(a), float(b), k) for a, b in _RANGES for k in routing.range_buckets(a, b, 16)], "lo double, hi double, bucket int")


@_register("bound_check", "SELECT a, b, CAST(floor(log2(b)) - floor(log2(a)) + 1 AS BIGINT) AS touched, CAST(ceil(log2(b / a)) + 1 AS BIGINT) AS bound FROM (VALUES (100.0::DOUBLE, 200.0::DOUBLE), (50, 500), (100, 1000), (1, 1000), (3, 5)) t(a, b)")
def _(spark, sf):
    return spark.createDataFrame([(float(a), float(b), len(routing.range_buckets(a, b, 64)), routing.most_buckets(a, b)) for a, b in ((100, 200), (50, 500), (100, 1000), (1, 1000), (3, 5))], "a double, b double, touched bigint, bound bigint")


@_register("surviving_segments", f"SELECT DISTINCT bx, by_ FROM {_routed} WHERE {_error}")
def _(spark, sf):
    return _events(spark, sf).surviving(_flag())


@_register("mask_third_dimension", f"SELECT DISTINCT bx, by_ FROM {_routed} WHERE {_error} AND bz IN ({routing.hash_bucket_of(7, 24)}, {routing.hash_bucket_of(8, 24)})")
def _(spark, sf):
    return _events(spark, sf).surviving(_flag().eq("user_id", 7, 8))


@_register("bitset_bits", f"SELECT bx, by_, CAST(count(DISTINCT bz) AS BIGINT) AS bits FROM {_routed} GROUP BY bx, by_")
def _(spark, sf):
    return _events(spark, sf).bitsets().select("bx", "by_", F.bitmap_count("bits").alias("bits"))


@_register("bitset_merge", f"SELECT bx, CAST(count(DISTINCT bz) AS BIGINT) AS bits FROM {_routed} GROUP BY bx")
def _(spark, sf):
    return _events(spark, sf).bitsets().groupBy("bx").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("bits"))


@_register("query_bitset_indices", f"SELECT DISTINCT {_hb('a', 4)} * 384 + {_hb('b', 16)} * 24 + {_hb('c', 24)} AS idx FROM (VALUES ('OK'), ('ERROR')) x(a), (VALUES ('NYC'), ('SF')) y(b), (VALUES ('9'), ('10'), ('11')) z(c)")
def _(spark, sf):
    each = spark.range(1).select(F.explode(F.array(F.lit("OK"), F.lit("ERROR"))).alias("a")).select("a", F.explode(F.array(F.lit("NYC"), F.lit("SF"))).alias("b")).select("a", "b", F.explode(F.array(F.lit("9"), F.lit("10"), F.lit("11"))).alias("c"))
    h = routing.hash_bucket
    return each.select(routing.bitset_index(h(F.col("a"), 4), h(F.col("b"), 16), h(F.col("c"), 24), 16, 24).alias("idx")).distinct()


@_register("prune_report", f"SELECT CAST(count(DISTINCT CASE WHEN {_error} THEN bx * 100 + by_ END) AS BIGINT) AS scanned, CAST(count(DISTINCT bx * 100 + by_) AS BIGINT) AS total FROM {_routed}")
def _(spark, sf):
    r = _events(spark, sf).report(_flag())
    return spark.createDataFrame([(r.segments_scanned, r.segments_total)], "scanned bigint, total bigint")


@_register("segment_stats", f"SELECT bx, by_, CAST(count(value) AS BIGINT) AS n, min(value) AS least, max(value) AS most, round(sum(value), 2) AS total FROM {_routed} GROUP BY bx, by_")
def _(spark, sf):
    return _events(spark, sf).stats().where("column = 'value'").select("bx", "by_", "n", F.col("min").alias("least"), F.col("max").alias("most"), F.round("sum", 2).alias("total"))


@_register("table_info", f"SELECT CAST(count(*) AS BIGINT) AS segments, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(n) // count(*) AS BIGINT) AS rows_per_segment FROM (SELECT count(*) AS n FROM {_routed} GROUP BY bx, by_)")
def _(spark, sf):
    return _events(spark, sf).info()


@_register("catalog_tables", "SELECT 'events' AS name, CAST(count(*) AS BIGINT) AS rows FROM events")
def _(spark, sf):
    return _engine(spark, sf, "events").tables().where("name = 'events'").select("name", "rows")


@_register("count_upper_bound", f"SELECT CAST(count(*) AS BIGINT) AS n FROM {_routed} WHERE {_error}")
def _(spark, sf):
    return _events(spark, sf).count_upper_bound(_flag())


@_register("approx_aggregates", f"SELECT CAST(count(value) AS BIGINT) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most, round(avg(value), 6) AS mean FROM {_routed} WHERE {_error}")
def _(spark, sf):
    return _events(spark, sf).approx_aggregates(_flag(), "value").select("n", F.round("total", 2).alias("total"), "least", "most", F.round("mean", 6).alias("mean"))


@_register("exact_aggregates", "SELECT CAST(count(value) AS BIGINT) AS n, round(sum(value), 2) AS total, min(value) AS least, max(value) AS most FROM events WHERE event_type = 'error' AND value BETWEEN 100 AND 500")
def _(spark, sf):
    return _engine(spark, sf, "events").aggregate("events", "value", _flag()).select("n", F.round("total", 2).alias("total"), "least", "most")


def _typed_sql(c: str) -> str:
    return f"CASE WHEN lower({c}) IN ('true', '1', 'yes') THEN true WHEN lower({c}) IN ('false', '0', 'no') THEN false END"


@_register("typed_cast_nulls", f"SELECT event_id, TRY_CAST(CASE WHEN regexp_full_match(t, '-?[0-9]+') THEN t END AS BIGINT) AS as_long, TRY_CAST(t AS DOUBLE) AS as_double, {_typed_sql('t')} AS as_bool, CAST(NULL AS VARCHAR) AS missing FROM (SELECT event_id, CASE CAST(event_id % 6 AS INTEGER) WHEN 0 THEN 'yes' WHEN 1 THEN 'No' WHEN 2 THEN '0' WHEN 3 THEN 'n/a' WHEN 4 THEN CAST(user_id AS VARCHAR) ELSE '3.5' END AS t FROM events)")
def _(spark, sf):
    from pyspark.sql import types as T

    t = F.element_at(F.array(F.lit("yes"), F.lit("No"), F.lit("0"), F.lit("n/a"), F.col("user_id").cast("string"), F.lit("3.5")), (F.col("event_id") % 6 + 1).cast("int"))
    rows = raw(spark, sf, "events").select(F.col("event_id").cast("string").alias("event_id"), *[t.alias(c) for c in ("as_long", "as_double", "as_bool")])
    kinds = {"event_id": T.LongType(), "as_long": T.LongType(), "as_double": T.DoubleType(), "as_bool": T.BooleanType(), "missing": T.StringType()}
    return text.typed(rows, T.StructType([T.StructField(k, v) for k, v in kinds.items()]))


@_register("distribution_profile", "SELECT 'rows' AS name, CAST(NULL AS VARCHAR) AS value, count(*) AS n FROM orders UNION ALL SELECT 'combinations', NULL, count(*) FROM (SELECT DISTINCT o_orderstatus, o_orderpriority FROM orders) UNION ALL SELECT 'o_orderstatus', o_orderstatus, count(*) FROM orders GROUP BY o_orderstatus UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY o_orderpriority")
def _(spark, sf):
    return datagen.profile(raw(spark, sf, "orders"), "o_orderstatus", "o_orderpriority")


def _log2(v: str) -> str:
    b = f"floor(log2({v}))"
    return f"({b} + (CASE WHEN {v} >= pow(2.0, {b} + 1) THEN 1 ELSE 0 END) - (CASE WHEN {v} < pow(2.0, {b}) THEN 1 ELSE 0 END))"


@_register("dense_refinement", f"SELECT CASE WHEN value >= 2 THEN 'b' || {_mb('value', 16)} ELSE 's' || CAST(CASE WHEN value <= 0 THEN -17 ELSE greatest(least({_log2('value')}, 0), -17) END AS INTEGER) END AS label, count(*) AS n FROM events GROUP BY 1")
def _(spark, sf):
    return raw(spark, sf, "events").groupBy(routing.refined_label(F.col("value"), 16).alias("label")).agg(F.count("*").alias("n"))


@_register("offset_refinement", f"SELECT CAST(CASE WHEN value - 8 <= 0 THEN -10 ELSE greatest(least({_log2('(value - 8)')}, 2), -10) END AS INTEGER) AS sub, count(*) AS n FROM events WHERE value >= 8 AND value < 16 GROUP BY 1")
def _(spark, sf):
    return raw(spark, sf, "events").where("value >= 8 AND value < 16").groupBy(routing.offset_label(F.col("value"), 3).alias("sub")).agg(F.count("*").alias("n"))


@_register("equi_depth", "WITH c AS (SELECT quantile_cont(l_extendedprice, [" + ", ".join(f"{i}/16.0::DOUBLE" for i in range(1, 16)) + "]) AS cuts FROM lineitem) SELECT CAST(len(list_filter(cuts, lambda x : x <= l_extendedprice)) AS INTEGER) AS depth, count(*) AS n FROM lineitem, c GROUP BY 1")
def _(spark, sf):
    return analysis.equi_depth(raw(spark, sf, "lineitem"), "l_extendedprice", 16).groupBy("depth").agg(F.count("*").alias("n"))


@_register("quantiles", "SELECT round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.9), 6) AS p90 FROM events")
def _(spark, sf):
    p50, p90 = analysis.quantiles(raw(spark, sf, "events"), "value", [0.5, 0.9])
    return spark.createDataFrame([(round(p50, 6), round(p90, 6))], "p50 double, p90 double")


_chunks = "(SELECT (rn - 1) // 1000 AS chunk, value FROM (SELECT value, row_number() OVER (ORDER BY event_id) AS rn FROM events))"


def _arrived(spark: SparkSession, sf: str) -> DataFrame:
    """Events with ``arrival``; event_id is dense, so its least value is all that has to be known."""
    events = raw(spark, sf, "events")
    least = events.agg(F.min("event_id").alias("first"))
    return events.join(F.broadcast(least), F.lit(True)).withColumn("arrival", F.col("event_id") - F.col("first"))


@_register("zone_map", f"SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(value) AS least, max(value) AS most FROM {_chunks} GROUP BY chunk HAVING max(value) >= 300")
def _(spark, sf):
    return analysis.touched(analysis.zone_map(analysis.chunked(_arrived(spark, sf), "arrival", 1000), "value"), low=300)


@_register("pruning_lag", f"""WITH c AS (SELECT CAST(chunk AS BIGINT) AS chunk, count(*) AS n, max(value) AS most, sum((value < 64)::INT) AS below, sum((CASE WHEN value < 1 THEN true ELSE pow(2.0, {_log2('greatest(value, 1.0)')} + 1) <= 64 END)::INT) AS bk FROM {_chunks} GROUP BY chunk),
s AS (SELECT chunk, n AS own, sum(n) OVER w AS n, sum(CASE WHEN n = 1000 THEN n ELSE 0 END) OVER w AS closed, sum(CASE WHEN n = 1000 AND most < 64 THEN n ELSE 0 END) OVER w AS z, sum(below) OVER w AS b, sum(bk) OVER w AS m FROM c WINDOW w AS (ORDER BY chunk)),
t AS (SELECT *, coalesce(max(CASE WHEN (chunk + 1) % 5 = 0 AND own = 1000 THEN b END) OVER (ORDER BY chunk), 0) AS mb, coalesce(max(CASE WHEN (chunk + 1) % 5 = 0 AND own = 1000 THEN z END) OVER (ORDER BY chunk), 0) AS mz FROM s)
SELECT chunk, round(coalesce(z / nullif(closed, 0), 0), 6) AS zone_map, round(mb / n, 6) AS compacted, round((mb + z - mz) / n, 6) AS compacted_and_zones, round(m / n, 6) AS magnitude FROM t""")
def _(spark, sf):
    return analysis.pruning_lag(_arrived(spark, sf), "arrival", "value", 64.0, 1000, 5)


_folders: dict[tuple, str] = {}


def _layouts(spark: SparkSession, sf: str) -> str:
    """The layouts of events.value, written once a session."""
    key = (spark.sparkContext.applicationId, sf)
    if key not in _folders:
        folder = segments.scratch(spark, f"layouts-{key[0]}-{zlib.crc32(sf.encode())}")
        for kind in layouts.KINDS:
            layouts.write(raw(spark, sf, "events"), "value", f"{folder}/{kind}", kind)
        _folders[key] = folder
    return _folders[key]


_REFINED = f"CASE WHEN value >= 2 THEN 'b' || {_mb('value', 16)} ELSE 's' || CAST(CASE WHEN value <= 0 THEN -17 ELSE greatest(least({_log2('value')}, 0), -17) END AS INTEGER) END"


@_register("layout_segments", "SELECT layout, count(DISTINCT seg) AS segments, count(DISTINCT CASE WHEN most >= 100 THEN seg END) AS segments_touched, CAST(sum(k) AS BIGINT) AS rows FROM (SELECT layout, seg, max(value) AS most, count(CASE WHEN value >= 100 THEN 1 END) AS k FROM (" + f"SELECT 'magnitude' AS layout, CAST({_mb('value', 16)} AS VARCHAR) AS seg, value FROM events UNION ALL SELECT 'refined', {_REFINED}, value FROM events UNION ALL SELECT 'equi_depth', CAST(len(list_filter(cuts, lambda x : x <= value)) AS VARCHAR), value FROM events, (SELECT quantile_cont(value, [" + ", ".join(f"{i}/16.0::DOUBLE" for i in range(1, 16)) + "]) AS cuts FROM events)) GROUP BY layout, seg) GROUP BY layout")
def _(spark, sf):
    each = [layouts.touched(spark, f"{_layouts(spark, sf)}/{k}", low=100).select(F.lit(k).alias("layout"), "segments", "segments_touched", "rows") for k in ("magnitude", "refined", "equi_depth")]
    return each[0].union(each[1]).union(each[2])


@_register("layout_rows", "SELECT layout, (SELECT count(*) FROM events WHERE value BETWEEN 0.5 AND 100) AS rows, true AS fewer FROM (VALUES ('arrival'), ('sorted'), ('magnitude'), ('refined'), ('equi_depth')) t(layout)")
def _(spark, sf):
    out = None
    for k in layouts.KINDS:
        one = layouts.touched(spark, f"{_layouts(spark, sf)}/{k}", 0.5, 100).select(F.lit(k).alias("layout"), "rows", (F.col("bytes_touched") <= F.col("bytes")).alias("fewer"))
        out = one if out is None else out.union(one)
    return out


@_register("layout_bytes", None)
def _(spark, sf):
    out = None
    for k in layouts.KINDS:
        one = layouts.touched(spark, f"{_layouts(spark, sf)}/{k}", low=100).select(F.lit(k).alias("layout"), "*")
        out = one if out is None else out.union(one)
    return out


@_register("file_counts", "SELECT CAST(count(DISTINCT bx * 100 + by_) AS BIGINT) <= 1000000 AS bounded, true AS has_metadata FROM " + _routed)
def _(spark, sf):
    return _events(spark, sf).file_stats().select((F.col("files") <= 1000000).alias("bounded"), (F.col("metadata_bytes") > 0).alias("has_metadata"))


@_register("bit_get", f"SELECT bx, by_, CAST(max(CASE WHEN bz = 5 THEN 1 ELSE 0 END) AS BOOLEAN) AS has_5, false AS has_beyond FROM {_routed} GROUP BY bx, by_")
def _(spark, sf):
    return _events(spark, sf).bitsets().select("bx", "by_", bits.get(F.col("bits"), F.lit(5)).alias("has_5"), bits.get(F.col("bits"), F.lit(10**6)).alias("has_beyond"))


@_register("predicate_range", "SELECT count(*) AS n FROM events WHERE value >= 64 AND value < 128")
def _(spark, sf):
    p = P().between("value", 10, 500).between("value", 64).below("value", 128)
    r = p.range("value")
    return _events(spark, sf).read(P().where("value", r)).agg(F.count("*").alias("n"))


@_register("headerless_csv", "SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events GROUP BY event_type")
def _(spark, sf):
    path = segments.scratch(spark, f"bare-{spark.sparkContext.applicationId}-{zlib.crc32(sf.encode())}")
    raw(spark, sf, "events").select("event_id", "event_type").write.mode("overwrite").csv(path, header=False)
    return text.read_csv(spark, path, ["event_id", "event_type"], header=False).groupBy("event_type").agg(F.count("*").alias("n"), F.sum(F.col("event_id").cast("bigint")).alias("ids"))


@_register("scale_tile", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events, range(3) GROUP BY event_type")
def _(spark, sf):
    return analysis.tiled(raw(spark, sf, "events"), 3).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@_register("skippable_buckets", f"SELECT {_mb('value', 16)} AS bucket, pow(2.0, {_mb('value', 16)} + 1) <= 64 AS skippable, count(*) AS n FROM events GROUP BY 1, 2")
def _(spark, sf):
    b = routing.magnitude_bucket(F.col("value"), 16)
    return raw(spark, sf, "events").select(b.alias("bucket")).select("bucket", analysis.skippable(F.col("bucket"), 64.0).alias("skippable")).groupBy("bucket", "skippable").agg(F.count("*").alias("n"))


@_register("union_by_name", "SELECT event_id AS id, value, CAST(NULL AS VARCHAR) AS kind FROM events WHERE value >= 400 UNION ALL SELECT o_orderkey, NULL, o_orderstatus FROM orders WHERE o_totalprice >= 490000")
def _(spark, sf):
    a = _events(spark, sf).read(P().between("value", low=400)).select(F.col("event_id").alias("id"), "value")
    b = _engine(spark, sf, "orders").table("orders").read(P().between("o_totalprice", low=490000)).select(F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("kind"))
    return a.unionByName(b, allowMissingColumns=True)


@_register("appended_batches", "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value >= 100 GROUP BY event_type")
def _(spark, sf):
    engine = _engine(spark, sf)
    if "events_parts" not in engine.names():
        for k in range(3):
            engine.load("events_parts", raw(spark, sf, "events").where(F.col("event_id") % 3 == k), LAYOUTS["events"])
    return engine.table("events_parts").read(P().between("value", low=100)).groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.sum("value"), 2).alias("total"))


@_register("csv_load", "SELECT event_type, count(*) AS n FROM events GROUP BY event_type")
def _(spark, sf):
    path = segments.scratch(spark, f"csv-{spark.sparkContext.applicationId}-{zlib.crc32(sf.encode())}")
    text.write_csv(raw(spark, sf, "events").select("event_id", "event_type"), path, mode="overwrite")
    return text.read_csv(spark, path).groupBy("event_type").agg(F.count("*").alias("n"))


@_register("byte_cost", None)
def _(spark, sf):
    return analysis.byte_cost(analysis.row_groups(_events(spark, sf).read(with_buckets=True), "value"), 100, None)


@_register("file_sizes", None)
def _(spark, sf):
    return _events(spark, sf).files().agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"), F.expr("sum(bytes) div count(*)").alias("mean"))


@_register("generated_requests", None)
def _(spark, sf):
    return datagen.profile(datagen.requests(spark, 10000, skewed=True), "status", "region", "hour")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _queries["eq_and_range"](spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_queries)


def oracle_sql() -> dict[str, str]:
    return dict(_sql)
