import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from skiplane.llm import packing

tokenizers = pytest.importorskip("public_tokenizers")


def test_ids_are_those_of_the_tokenizer():
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    rng = random.Random(1)
    parts = ["the", " ", " ", "Th,", "a.b", ")", ":", ".", "  ", "\n", " \n", "don't", "it's", "Ünï", "12", "3.5", "!!", "\t", " ", "　", "日本", "<|endoftext|>", "'", "_", "é", "\x1c", "​", "😀"]
    for _ in range(6000):
        text = "".join(rng.choice(parts) for _ in range(rng.randint(0, 12)))
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text)


def test_every_character_and_long_runs_are_encoded_alike():
    from tokenizers import Tokenizer

    path = tokenizers.path("byte_bpe_50k.json")
    whole, encode = Tokenizer.from_file(path), packing.Encoder(path)
    assert encode.plain is not None
    points = [c for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"a{chr(c)} {chr(c)}1 " for c in points[i : i + 256]) for i in range(0, len(points), 256)]
    for text in [*texts, "a" * 1_000_000, " " * 300_000, "x \n " * 50_000]:
        assert encode(text) == np.array(whole.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes(), repr(text[:40])


def test_column_generation_says_whether_it_is_done():
    rng = np.random.default_rng(4)
    histogram = np.zeros(513, dtype=np.int64)
    for at in (190, 260):
        for k in np.clip(rng.normal(at, 25, 200_000).astype(int), 1, 512):
            histogram[k] += 1
    plan = packing.patterns(histogram, 512)
    assert plan.proved and plan.bound <= plan.uses.sum() <= plan.bound * 1.001 + 1 + np.count_nonzero(histogram)
    assert (plan.uses @ plan.rows == histogram).all()
    assert not packing.patterns(histogram, 512, rounds=1).proved


def test_patterns_cover_the_histogram():
    rng = np.random.default_rng(2)
    for n in (5, 3000):
        histogram = np.zeros(257, dtype=np.int64)
        for k in rng.integers(1, 257, n):
            histogram[k] += 1
        rows, uses, *_ = packing.patterns(histogram, 256)
        assert (uses @ rows == histogram).all() and ((rows @ np.arange(257)) <= 256).all()
        least = int(np.ceil((histogram @ np.arange(257)) / 256))
        assert uses.sum() <= max(least * 1.06, least + 2)


def test_pieces_tile_documents_and_sequences(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "be", "c"]) for _ in range(rng.choice([0, 1, 30, 60, 200, 700])))) for i in range(300)] + [(None, None), (5, "x"), (5, "x"), (900, "word " * 20000)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").withColumn("length", F.lit("q"))
    path = tokenizers.path("byte_bpe_50k.json")
    got = [r.asDict() for r in packing.pack(df, path, capacity=128).collect()]
    encode = packing.Encoder(path)
    ids = {i: encode(t or "") + (1).to_bytes(4, "little") for i, t in rows if i != 5}
    for i, b in ids.items():
        own = sorted((r for r in got if r["doc_id"] == i), key=lambda r: r["start"])
        assert [r["start"] for r in own] == list(range(0, len(b) // 4, 128)) and sum(r["length"] for r in own) == len(b) // 4
        assert all(r["ids_crc32"] == zlib.crc32(b[4 * r["start"] : 4 * (r["start"] + r["length"])]) and r["doc_tokens"] == len(b) // 4 for r in own)
    by: dict = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append(r)
    for own in by.values():
        at = 0
        for r in sorted(own, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 128
    total = sum(r["length"] for r in got)
    assert sorted(by) == list(range(len(by))) and len(by) * 128 <= total * 1.08 + 256
    assert packing.pack(df.limit(0), path).count() == 0
