import hashlib
import random

import pytest

from skiplane.llm import repeats


def brute(rows, length):
    seen, out = set(), []
    for i, text in sorted(rows):
        data = (text or "").encode()
        gone = [False] * len(data)
        for p in range(len(data) - length + 1):
            w = data[p : p + length]
            if w in seen:
                gone[p : p + length] = [True] * length
            seen.add(w)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out.append((i, len(data), sum(gone), spans, hashlib.sha256(bytes(b for b, g in zip(data, gone) if not g)).hexdigest()))
    return out


def digest(df):
    rows = df.collect()
    return sorted((r["doc_id"], r["n_bytes"], sum(x["hi"] - x["lo"] for x in r["removed"]), len(r["removed"]), r["kept_sha256"]) for r in rows)


def corpus(seed, n, letters="ab cdé"):
    rng = random.Random(seed)
    passages = ["".join(rng.choice(letters) for _ in range(rng.randint(5, 90))) for _ in range(12)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.5 else "".join(rng.choice(letters) for _ in range(rng.randint(0, 40))) for _ in range(rng.randint(0, 8))]
        rows.append((i * 3 - 40, "".join(parts)))
    return rows


def test_same_as_brute_force(spark, monkeypatch):
    for length, slice_, letters in ((12, 300, "ab cdé"), (30, 1 << 20, "ab cdé"), (20, 500, "aab"), (3, 200, "abcdefgh")):
        monkeypatch.setattr(repeats, "SLICE", slice_)
        monkeypatch.setattr(repeats, "PART", 37)
        rows = corpus(length, 60, letters)
        df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
        assert digest(repeats.remove_repeats(df, length)) == brute(rows, length)


def test_edge_cases(spark):
    text = "x" * 130
    rows = [(1, None, 1), (2, "", 1), (3, text, 1), (4, text, 2), (4, text, 2), (5, "short", 3), (6, "word " * 30000, 1), (7, "abc", 1), (7, text + "y", 1)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, kind int")
    got = {(r["doc_id"], r["n_bytes"]): sum(x["hi"] - x["lo"] for x in r["removed"]) for r in repeats.remove_repeats(df).collect()}
    assert got == {(1, 0): 0, (2, 0): 0, (3, 130): 129, (4, 130): 130, (5, 5): 0, (6, 150000): 149995, (7, 3): 0, (7, 131): 130}
    assert repeats.remove_repeats(df.limit(0)).count() == 0
    none = spark.createDataFrame([(None, text), (1, text)], "doc_id bigint, text string")
    assert sorted((str(r["doc_id"]), len(r["kept"])) for r in repeats.remove_repeats(none).collect()) == [("1", 1), ("None", 130)]


@pytest.mark.parametrize("most", [100_000, 0])
def test_rows_of_one_id_are_documents_of_their_own(spark, monkeypatch, most):
    monkeypatch.setattr(repeats, "MOST_BROADCAST", most)
    rows = [(i // 3, t) for i, t in corpus(9, 60)]
    rows += [(-5, "q" * 50), (-5, "q" * 50)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    twin = {r["text"]: r["h"] for r in df.selectExpr("text", "xxhash64(text) AS h").collect()}
    once = sorted(set(rows), key=lambda r: (r[0], twin[r[1]]))
    of = dict(zip(once, brute([(k, t) for k, (_, t) in enumerate(once)], 12), strict=True))
    want = sorted((r[0], *of[r][1:]) for r in rows)
    assert digest(repeats.remove_repeats(df, 12)) == want
    x = "".join(chr(97 + k * k % 26) for k in range(150))
    got = {(r["doc_id"], r["n_bytes"]): r["n_bytes"] - len(r["kept"]) for r in repeats.remove_repeats(spark.createDataFrame([(1, "p" + x), (2, x + "q"), (2, x + "zz")], "doc_id bigint, text string")).collect()}
    assert got[2, 151] >= 150 and got[2, 152] >= 150


def test_long_texts(spark):
    line = "the quick brown fox jumps over the lazy dog and then some more words follow here, up to a hundred bytes and beyond it"
    rows = [(1, line), (2, " ".join(f"{k} {line}" for k in range(9000))), (3, "a" * 1_200_000)]
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"]) for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id bigint, text string"), with_bytes=False).selectExpr("doc_id", "n_bytes", "aggregate(removed, 0L, (n, r) -> n + r.hi - r.lo) AS n_removed").collect()}
    assert got[1] == (len(line), 0) and got[2][1] >= 9000 * len(line) and got[3] == (1_200_000, 1_199_999)


def test_spans_of_like_structure_have_different_hashes():
    import numpy as np
    import pyarrow as pa

    from skiplane.llm import textbytes as tb

    morse = "a"
    while len(morse) < 4096:
        morse += morse.translate(str.maketrans("ab", "ba"))
    other = morse.translate(str.maketrans("ab", "ba"))
    texts = tb.Texts(pa.array([morse, other, morse, "Ab", "aB"]))
    start, end = texts.starts[:-1], texts.starts[1:]
    words = texts.word_hashes(start, end, 5, fold_case=True)
    for q in (1, 32, 100):
        wholes = repeats._whole(repeats._identifiers(texts.data, q), q, start[:3], end[:3])
        assert wholes[0] == wholes[2] != wholes[1]
    assert words[0] == words[2] != words[1] and words[3] == words[4]
    assert len(np.unique(texts.word_hashes(np.zeros(4096, np.int64), np.arange(1, 4097), 5))) == 4096
