import random
import re
import zlib

from pyspark.sql import functions as F

from skiplane.llm import quality, sharding


def base(text):
    text = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {p for i, g in enumerate(grams) if grams.count(g) > 1 for p in range(i, i + 3)}
    n = len(w)
    return n, sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), n < 50 or 100 * len(hit) > 50 * n


def test_base_counts(spark):
    rng = random.Random(4)
    part = lambda k: "".join(rng.choice(["a", "bé", "c", "#x", "d|", "😀"][:k]) + rng.choice([" ", " ", "\n", "\t ", "\r\n"]) for _ in range(rng.choice([0, 1, 2, 3, 60, 150])))
    rows = [(i, part(rng.choice([1, 3, 6])) + " ".join(str(rng.random()) for _ in range(rng.choice([0, 80]))), rng.choice(["en", None]), "s") for i in range(80)] + [(90, None, None, None), (91, "", "en", "s"), (1, "x y z " * 40000, "en", "s"), (None, "q", "en", "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string").withColumn("kept", F.lit(1))
    got = quality.quality_rules(df)
    want = [(i, *(base(t) if len(t or "") < 100_000 else (120000, 120000, 0, 0, 120000, True))) for i, t, _, _ in rows]
    assert sorted((tuple(r)[:7] for r in got.collect()), key=str) == sorted(want, key=str)
    assert all(not r["kept"] for r in got.where("base_failed").collect())
    assert quality.quality_rules(df.limit(0)).count() == 0


def test_outliers_of_their_group_go(spark):
    rng = random.Random(5)
    clean = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 8))) for _ in range(90))
    rows = [(i, clean(), "en", "a") for i in range(300)] + [(1000, clean().replace(" ", "### "), "en", "a"), (1001, clean().replace(" ", "### "), "en", "b")]
    rows += [(2000 + i, clean().replace(" ", "### "), "en", "c") for i in range(250)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string")
    got = {r["doc_id"]: r for r in quality.quality_rules(df, least_docs=200).collect()}
    assert all(got[i]["kept"] for i in range(300)) and not got[1000]["kept"] and got[1000]["level"] == "group"
    assert got[1001]["level"] == "lang" and all(got[2000 + i]["kept"] for i in range(250))
    kept = quality.drop_low_quality(df, least_docs=200)
    assert kept.columns == df.columns and {r["doc_id"] for r in kept.collect()} == {i for i, r in got.items() if r["kept"]}


def test_bins_are_within_their_error(spark):
    values = spark.range(0, 40000, 7).select("id", quality.bin_of(F.col("id")).alias("b"))
    rows = values.select("id", "b", quality.bin_floor(values["b"]).alias("f")).collect()
    assert all(r["f"] <= r["id"] and (r["id"] - r["f"]) * 32 <= max(r["id"], 1) for r in rows)
    assert [r["b"] for r in sorted(rows, key=lambda r: r["id"])] == sorted(r["b"] for r in rows)


def test_rendezvous(spark):
    rows = [(i, "t" * (i % 9) + "é") for i in range(3000)] + [(None, None), (5, "t" * 5 + "é"), (-7, "")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("shard", F.lit("x"))
    got = sharding.rendezvous(df, [1.0] * 10, next_weight=1.0).collect()
    grown = {r["doc_id"]: r["shard"] for r in sharding.rendezvous(df, [1.0] * 11).collect()}
    assert len(got) == len(rows)
    for s in range(10):
        own = [r for r in got if r["shard"] == s]
        assert sorted(r["slot"] for r in own) == list(range(len(own))) and 200 < len(own) < 400
    assert all(r["grown_shard"] in (r["shard"], 10) and r["grown_shard"] == grown[r["doc_id"]] for r in got)
    text = dict(rows)
    assert all(r["size"] == 16 + len((text[r["doc_id"]] or "").encode()) and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    heavy = sharding.rendezvous(df, [3.0, 1.0]).groupBy("shard").count().orderBy("shard").collect()
    assert 2.5 < heavy[0]["count"] / heavy[1]["count"] < 3.5
    assert sharding.rendezvous(df.limit(0), [1.0]).count() == 0
