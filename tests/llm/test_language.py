import zlib

import numpy as np

from skiplane.llm import language


def test_backs_off_to_shorter_grams():
    one = lambda *x: np.array(x, dtype=np.float32)
    model = language.Model(["a", "b"], {"the": one(-1, -9)}, {5: {}, 4: {"\x02abc": one(-2, -1)}, 3: {"xyz": one(-1, -5), "yzq": one(-3, -5)}, 2: {}, 1: {"q": one(0, -1)}})
    assert model.unknown("abc").tolist() == [-2, -1]
    assert model.unknown("xyzq").tolist() == [-2, -5]
    assert model.unknown("q").tolist() == [0, -1] and model.unknown("é") is None


def test_held_out_accuracy(spark):
    df = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    truth = {r["doc_id"]: r["lang"] for r in df.select("doc_id", "lang").collect()}
    got = language.identify(df).collect()
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(truth) and all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in got)
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in out) >= 0.9 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_edge_cases(spark):
    rows = [(1, None, "en"), (2, "", "en"), (3, "12 34", "en"), (4, "hello world", "en"), (4, "hello world", "en"), (9, "hola mundo " * 30000, "es"), (None, "hello", None), (11, "hallo welt", None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, lang string").selectExpr("*", "'x' AS lang_pred")
    got = {(r["doc_id"]): r for r in language.identify(df).collect()}
    assert all(got[i]["lang_pred"] == "und" and got[i]["score"] == 0 for i in (1, 2, 3))
    assert language.identify(df.limit(0)).count() == 0
    nothing = language.identify(df.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")).collect()
    assert {r["lang_pred"] for r in nothing} == {"und"}
