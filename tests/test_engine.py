import math
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skiplane.functions import routing
from skiplane.operators.layout import Layout
from skiplane.plans import catalogue
from skiplane.plans.engine import Engine, UnknownTable
from skiplane.plans.predicate import Predicate, Range
from skiplane.sources import text
from skiplane.streaming.ingest import ingest

LAYOUT = Layout.of(status=("hash", 4), value=("magnitude", 16), hour=("hash", 24))
VALUES = [50.0, 80.0, 150.0, 200.0, 450.0, 800.0, 1200.0, 0.0, -3.0, 0.5, 1.0, 2.0, 1024.0, math.nextafter(64, 0), 64.0, 1e6, float("inf"), float("nan"), None]


def rows(spark, n=400, seed=1):
    rng = random.Random(seed)
    data = [(i, rng.choice(["OK", "ERROR", "WARN", None]), rng.choice(VALUES), rng.randrange(24)) for i in range(n)]
    return spark.createDataFrame(data, "id bigint, status string, value double, hour int")


def test_magnitude_is_exact(spark):
    edges = [f(2.0**k) for k in range(-5, 40) for f in (lambda x: x, lambda x: math.nextafter(x, 0), lambda x: math.nextafter(x, math.inf))] + [0.0, -5.0, float("nan"), float("inf"), None]
    got = spark.createDataFrame([(v,) for v in edges], "v double").select("v", routing.magnitude_bucket(F.col("v"), 16).alias("b")).collect()
    assert all(r["b"] == routing.magnitude_bucket_of(r["v"], 16) for r in got)
    assert [routing.magnitude_bucket_of(v, 16) for v in (1.0, 1.5, 2, 3.99, 4, 15, 1024, 1e6, 0, -5)] == [0, 0, 1, 1, 2, 3, 10, 15, 0, 0]
    words = spark.createDataFrame([("text",), ("",), ("3.99",)], "v string").select(routing.magnitude_bucket(F.col("v"), 16).alias("b")).collect()
    assert [r["b"] for r in words] == [0, 0, 1]


def test_ranges_and_hash(spark):
    assert [list(routing.range_buckets(a, b, 16)) for a, b in ((1, 7), (4, 6), (1, 1000), (10, 5))] == [[0, 1, 2], [2], list(range(10)), []]
    assert list(routing.range_buckets(None, -1, 16)) == [0] and list(routing.range_buckets(4, None, 4)) == [2, 3]
    got = spark.createDataFrame([("OK", 9), (None, 10)], "s string, i int").select(routing.hash_bucket(F.col("s"), 7).alias("s"), routing.hash_bucket(F.col("i"), 7).alias("i")).collect()
    assert [(r["s"], r["i"]) for r in got] == [(routing.hash_bucket_of("OK", 7), routing.hash_bucket_of(9, 7)), (routing.hash_bucket_of(None, 7), routing.hash_bucket_of(10, 7))]
    with pytest.raises(ValueError):
        routing.hash_bucket_of("x", 0)


def test_pruning_never_loses_rows(spark, tmp_path):
    table = Engine(spark, str(tmp_path)).load("t", rows(spark), LAYOUT)
    rng, all_rows = random.Random(3), rows(spark).cache()
    for _ in range(12):
        p = Predicate()
        if rng.random() < 0.6:
            p.eq("status", *rng.sample(["OK", "ERROR", "WARN", "NONE"], rng.randint(1, 2)))
        if rng.random() < 0.8:
            low = rng.choice([None, -5.0, 0.5, 64.0, 100.0, 1e7])
            p.where("value", Range(low, rng.choice([None, -1.0, 64.0, 500.0]), rng.random() < 0.5, rng.random() < 0.5))
        if rng.random() < 0.5:
            p.between("hour", rng.choice([None, 3]), 12)
        want = sorted(r["id"] for r in all_rows.where(p.column()).collect())
        assert sorted(r["id"] for r in table.read(p).collect()) == want
        assert table.count_upper_bound(p).first()["n"] >= len(want)
    selective = table.report(Predicate().eq("status", "OK").between("value", 128, 200))
    assert 0 < selective.segments_scanned <= 2 < selective.segments_total
    assert "PartitionFilters" in table.read(Predicate().eq("status", "OK"))._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("where", ["status = 'OK' AND value BETWEEN 100 AND 500", "status NOT IN ('OK')", "100 <= value", "status = 'OK' OR value > 1000", "status = 'OK' OR status = 'WARN'", "NOT (value BETWEEN 1 AND 100)", "value > 150 AND value < 450", "status IS NULL", "status IN ('OK', 'WARN', NULL)", "hour >= 3 AND hour < 5", "status LIKE '%R%' AND value >= 64"])
def test_sql_is_that_of_the_plain_table(spark, tmp_path, where):
    engine = Engine(spark, str(tmp_path))
    engine.load("t", rows(spark, 150), LAYOUT)
    got = sorted(r["id"] for r in engine.query(f"SELECT id FROM t WHERE {where}").df.collect())
    assert got == sorted(r["id"] for r in rows(spark, 150).where(where).collect())


def test_engine_surface(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    assert engine.health() == {"status": "ok", "tables": 0}
    engine.load("t", rows(spark, 40), LAYOUT)
    engine.load("t", rows(spark, 20))
    again = Engine(spark, str(tmp_path))  # a restart reads the saved layout
    assert again.table("t").layout == LAYOUT and again.table("t").read().count() == 60
    assert again.tables().first()["rows"] == 60
    exact, bound = (again.aggregate("t", "value", Predicate().between("value", 100, 500), approx=a).first()["n"] for a in (False, True))
    assert exact <= bound
    with pytest.raises(UnknownTable):
        engine.table("nothing")
    with pytest.raises(ValueError):
        engine.table("../x")


def test_stream_is_loaded_once(spark, tmp_path):
    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    rows(spark, 50).write.parquet(source)
    stream = lambda: spark.readStream.schema("id bigint, status string, value double, hour int").parquet(source)
    table = Engine(spark, str(tmp_path / "root"))
    from skiplane.sources.segments import SegmentTable

    target = SegmentTable(spark, f"{table.root}/t")
    for extra in (0, 0, 30):
        if extra:
            rows(spark, extra, 9).write.mode("append").parquet(source)
        ingest(stream(), target, LAYOUT, checkpoint).awaitTermination()
    assert target.read().count() == 80
    target.write(rows(spark, 30, 9), batch=(1 << 32) + 1)  # a replayed batch
    assert target.read().count() == 80


def test_text_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b\n1,x\n2,y\n")
    (tmp_path / "bad.csv").write_text("a,b\n1\n")
    assert text.read_csv(spark, str(tmp_path / "a.csv")).count() == 2
    with pytest.raises(Exception):
        text.read_csv(spark, str(tmp_path / "bad.csv")).count()
    (tmp_path / "log").write_text('{"a": "1"}\n\n{"a": "2"}\n')
    assert text.read_log(spark, str(tmp_path / "log"), ["a"]).where("a IS NOT NULL").count() == 2
    got = text.typed(spark.createDataFrame([("x", "YES"), ("7", "maybe")], "n string, b string"), T.StructType.fromDDL("n bigint, b boolean, c string")).collect()
    assert [tuple(r) for r in got] == [(None, True, None), (7, None, None)]


def test_flagship(spark):
    assert catalogue.flagship(spark, "/root/testdata/sf0.001").count() == 23
    assert set(catalogue.oracle_sql()) <= set(catalogue.queries())


TYPES = {"n": "bigint", "d": "double", "m": "decimal(10,2)", "day": "date", "b": "boolean", "s": "string", "f": "float"}


def typed_rows(spark, n=600):
    rng = random.Random(5)
    import datetime
    import decimal

    data = [(i, rng.randrange(40) * 10**rng.randrange(9), rng.choice([10.0**7, 0.1, 1e-5, 64.0, -0.0, 0.0, float("nan")] + [float(k) for k in range(30)]), decimal.Decimal(rng.randrange(5000)) / 4, datetime.date(2024, 1, 1) + datetime.timedelta(days=rng.randrange(60)), rng.random() < 0.5, f"v{rng.randrange(50)}", float(rng.randrange(9)) / 2) for i in range(n)]
    data += [(1000, *[None] * 7)]
    return spark.createDataFrame(data, "id bigint, " + ", ".join(f"{k} {v}" for k, v in TYPES.items()))


def test_pruned_is_plain_for_all_types_and_long_lists(spark, tmp_path):
    rng, plain = random.Random(7), typed_rows(spark).cache()
    text_of = {"n": lambda v: f"{v}L", "d": lambda v: f"double('{v!r}')", "m": lambda v: f"cast('{v}' AS decimal(10,2))", "day": lambda v: f"DATE '{v}'", "b": lambda v: str(v).lower(), "s": lambda v: f"'{v}'", "f": lambda v: f"float('{v!r}')"}
    values = {c: [r[0] for r in plain.select(c).distinct().where(f"{c} IS NOT NULL").collect()] for c in TYPES}
    plain.createOrReplaceTempView("plain_rows")
    for c in TYPES:
        for kind in ("hash", "magnitude") if c in "ndmf" else ("hash",):
            engine = Engine(spark, str(tmp_path / f"{c}{kind}"))
            table = engine.load("t", plain, Layout.of(**{c: (kind, 16)}))
            few, many = rng.sample(values[c], 2), rng.sample(values[c], min(len(values[c]), 14))
            wheres = [f"{c} = {text_of[c](few[0])}", f"{c} IN ({', '.join(map(text_of[c], many))}, NULL)"]
            wheres += [f"{c} >= {text_of[c](few[1])} AND {c} <= {text_of[c](max(few))}"] if c != "b" else []
            for where in wheres:
                want = sorted(r["id"] for r in spark.sql(f"SELECT id FROM plain_rows WHERE {where}").collect())
                assert sorted(r["id"] for r in engine.query(f"SELECT id FROM t WHERE {where}").df.collect()) == want, (c, kind, where)
            for some in (few, many):
                p = Predicate().eq(c, *some)
                assert sorted(r["id"] for r in table.read(p).collect()) == sorted(r["id"] for r in plain.where(p.column()).collect()), (c, kind)
    engine = Engine(spark, str(tmp_path / "dayhash"))
    assert engine.query("SELECT id FROM t WHERE day = DATE '2024-01-05'").reports["t"].segments_scanned == 1
    p = Predicate().eq("n", 5.0).eq("s", 3)  # not of the column's type: nothing is narrowed
    assert set(p.buckets(Layout.of(n=("hash", 4), s=("hash", 4)), TYPES).values()) == {None}


def test_views_of_the_session_survive_a_query(spark, tmp_path):
    engine = Engine(spark, str(tmp_path))
    engine.load("t", rows(spark, 100), LAYOUT)
    spark.range(7).createOrReplaceTempView("t")
    assert engine.query("SELECT * FROM t WHERE status = 'OK'").df.count() < 100
    assert spark.table("t").count() == 7
    spark.catalog.dropTempView("t")
    engine.query("SELECT * FROM t WHERE status = 'OK'")
    assert not spark.catalog.tableExists("t")


def test_stream_load_stream_and_compaction(spark, tmp_path):
    from skiplane.sources.segments import SegmentTable

    source, checkpoint = str(tmp_path / "in"), str(tmp_path / "checkpoint")
    stream = lambda: spark.readStream.schema("id bigint, status string, value double, hour int").parquet(source)
    target = SegmentTable(spark, str(tmp_path / "root/t"))
    rows(spark, 10).write.parquet(source)
    ingest(stream(), target, LAYOUT, checkpoint).awaitTermination()
    done = target.write(rows(spark, 10, 2))
    assert (done.batch, done.rows, done.buffered_rows) == (1, 10, 0)
    rows(spark, 10, 3).write.mode("append").parquet(source)
    ingest(stream(), target, LAYOUT, checkpoint).awaitTermination()
    assert target.read().count() == 30
    before = sorted(map(str, target.read().collect()))
    stats, bits_ = sorted(map(str, target.stats().collect())), sorted(map(str, target.bitsets().collect()))
    target.compact()
    again = SegmentTable(spark, target.path)
    assert sorted(map(str, again.read().collect())) == before and len(again.state().batches) == 1
    assert sorted(map(str, again.bitsets().collect())) == bits_ and len(again.stats().collect()) == len(stats)
    target.write(rows(spark, 10), batch=1 << 32)  # a replay of what has been compacted
    assert again.read().count() == 30
    ingest(stream(), target, LAYOUT, checkpoint).awaitTermination()
    assert again.read().count() == 30
    with pytest.raises(ValueError):
        target.write(rows(spark, 5).withColumn("hour", F.col("hour").cast("string")))
    wider = rows(spark, 5).withColumn("extra", F.lit("x"))
    target.write(wider)
    assert again.read().where("extra = 'x'").count() == 5 and again.read().count() == 35


def test_statistics_merge(spark, tmp_path):
    table = Engine(spark, str(tmp_path)).load("t", rows(spark, 150), LAYOUT)
    table.write(rows(spark, 150, 4))
    want = table.read(with_buckets=True).groupBy("bx", "by_").agg(F.count("value").alias("n"), F.sum("value").alias("sum"), F.min("value").alias("min"), F.max("value").alias("max")).collect()
    got = {(r["bx"], r["by_"]): r for r in table.stats().where("column = 'value'").collect()}
    same = lambda a, b: a == b or (a != a and b != b) or (a is not None and b is not None and math.isclose(a, b))
    assert len(got) == len(want) and all(same(got[r["bx"], r["by_"]][c], r[c]) for r in want for c in ("n", "sum", "min", "max"))
    stats = table.file_stats().first()
    assert stats["files"] > 0 and stats["data_bytes"] > stats["mean_bytes"] > 0 and stats["metadata_bytes"] > 0


def test_bits(spark):
    from skiplane.functions import bits

    held = b""
    for at in (0, 9, 23, -1, 10**6):
        held = bits.with_bit(held, at)
    assert [at for at in range(-1, 40) if bits.has_bit(held, at)] == [0, 9, 23]
    assert bits.from_text(bits.to_text(held)) == held and bits.intersect(held, b"\x01") and not bits.intersect(held, b"\x02")
    got = spark.createDataFrame([(bytearray(held), at) for at in range(-1, 40)], "h binary, at int").select("at", bits.get(F.col("h"), F.col("at")).alias("x")).collect()
    assert [r["at"] for r in got if r["x"]] == [0, 9, 23]
    with pytest.raises(ValueError):
        bits.from_text("not base64!")


def test_predicate_accessors():
    p = Predicate().eq("a", 1, 2).above("b", 3).between("b", 1, 9).below("b", 7)
    assert p.values("a") == [1, 2] and p.range("b") == Range(3, 7, True, True) and p.range("a") is None


def test_csv_without_header_and_union(spark, tmp_path):
    (tmp_path / "a.csv").write_text("1,x\n2,y\n")
    got = text.read_csv(spark, str(tmp_path / "a.csv"), ["n", "s"], header=False)
    assert sorted(map(tuple, got.collect())) == [("1", "x"), ("2", "y")] and got.select("n").count() == 2
    with pytest.raises(ValueError):
        text.read_csv(spark, str(tmp_path / "a.csv"), header=False)


def test_data_source(spark, tmp_path):
    from skiplane.sources.datasource import SegmentSource

    Engine(spark, str(tmp_path)).load("t", rows(spark, 200), LAYOUT)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(SegmentSource)
    df = spark.read.format("segments").option("path", str(tmp_path / "t")).load()
    for where in ("status = 'OK'", "value >= 100 AND value < 1000", "hour IN (3, 4, 5)"):
        assert sorted(r["id"] for r in df.where(where).collect()) == sorted(r["id"] for r in rows(spark, 200).where(where).collect())


def test_quantiles_and_layouts(spark, tmp_path):
    import numpy as np

    from skiplane.operators import analysis, layouts

    rng = np.random.default_rng(1)
    for values in (rng.lognormal(0, 3, 5000).tolist(), [3.0] * 900 + [1.0, 9.0], [7.0]):
        df = spark.createDataFrame([(v,) for v in [*values, None, float("nan")]], "v double")
        shares = [0, 0.01, 0.25, 0.5, 0.9, 1]
        for most in (20, 100_000):  # spans are narrowed by the sketch, or not at all
            assert np.allclose(analysis.quantiles(df, "v", shares, most), np.quantile(values, shares))
    assert analysis.quantiles(df.limit(0), "v", [0.5]) == []
    df = spark.createDataFrame([(float(v),) for v in rng.uniform(0.001, 1, 30000)] + [(float(v),) for v in rng.uniform(1, 5000, 300)], "q double")
    got = {r["layout"]: r for r in layouts.compared(spark, df, "q", str(tmp_path), low=0.5).collect()}
    want = df.where("q >= 0.5").count()
    assert set(got) == set(layouts.KINDS) and all(r["rows"] == want for r in got.values())
    assert got["refined"]["bytes_touched"] < got["magnitude"]["bytes_touched"] and got["refined"]["segments"] > got["magnitude"]["segments"]


def test_server(spark, tmp_path):
    import json
    import threading
    import urllib.error
    import urllib.request

    from skiplane.server import serve

    server = serve(Engine(spark, str(tmp_path)), port=0)
    threading.Thread(target=server.serve_forever, daemon=True).start()

    def ask(method, path, body=None):
        request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}{path}", method=method, data=None if body is None else body if isinstance(body, bytes) else json.dumps(body).encode())
        try:
            with urllib.request.urlopen(request, timeout=60) as r:
                return r.status, json.loads(r.read())
        except urllib.error.HTTPError as e:
            return e.code, json.loads(e.read())

    try:
        assert ask("GET", "/health") == (200, {"status": "ok", "tables": 0})
        data = "category,value,region\nA,150,x\nA,900,y\nB,450,x\nB,80,z\nC,120,x\nA,5,x\n"
        status, said = ask("POST", "/load", {"table": "t", "data": data, "dimensions": ["category", "value", "region"], "numeric_dimensions": ["value"], "bucket_counts": [4, 16, 8]})
        assert (status, said["rows_loaded"]) == (200, 6)
        status, said = ask("POST", "/query", {"sql": "SELECT * FROM t WHERE value BETWEEN 100 AND 500"})
        assert status == 200 and said["columns"] == ["category", "region", "value"] and said["row_count"] == 3 and 0 < said["segments_scanned"] < said["segments_total"] and said["elapsed_ms"] > 0
        assert ask("POST", "/load", {"table": "t", "data": "category,value,region\nC,7,x\n"})[1]["rows_loaded"] == 1
        assert ask("GET", "/tables")[1][0]["rows"] == 7
        assert [ask("POST", "/query", {"sql": s})[0] for s in ("SELEC", "SELECT nothing FROM t", "SELECT * FROM other")] == [400, 400, 404]
        assert ask("POST", "/load", {"table": "u", "data": "a,b\n1\n"})[0] == 400 and ask("POST", "/query", b"{")[0] == 400 and ask("GET", "/nowhere")[0] == 404
    finally:
        server.shutdown()
