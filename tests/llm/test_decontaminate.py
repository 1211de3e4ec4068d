import random
import re

from skiplane.llm import decontaminate as dc


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = []
    for i, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(str(i), w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for d, text in docs:
        w, hit, of = words(text), set(), set()
        for i, x in windows:
            for p in range(len(w) - len(x) + 1):
                if w[p : p + len(x)] == x:
                    hit.update(range(p, p + len(x)))
                    of.add(i)
        out.append((d, len(w), len(hit), sorted(of), bool(hit)))
    return sorted(out, key=str)


def test_same_as_brute_force(spark):
    rng = random.Random(5)
    text = lambda n: "".join(rng.choice(["a", "b", "Cé", "d1"]) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))
    items = [(i, text(rng.choice([0, 2, 3, 6, 20]))) for i in range(9)] + [(10, None), (9, text(8)), (9, text(8))]
    docs = [(i, text(rng.randint(0, 30)) + (rng.choice(items)[1] or "") * rng.randint(0, 1) + text(5)) if i % 9 else (i, None) for i in range(1, 60)]
    d = spark.createDataFrame([(*r, 1) for r in docs], "doc_id bigint, text string, n_hit int")
    b = spark.createDataFrame(items, "item_id bigint, text string")
    for most in (None, 7):
        dc.MOST_WINDOWS = most or 500_000
        got = dc.contaminated(d, b, 5).select("doc_id", "n_words", "n_hit", "items", "contaminated").collect()
        assert sorted(map(tuple, got), key=str) == brute(docs, items, 5)
    dc.MOST_WINDOWS = 500_000
    dirty = {r[0] for r in brute(docs, items, 5) if r[4]}
    assert {r["doc_id"] for r in dc.drop_contaminated(d, b, 5).collect()} == {r[0] for r in docs} - dirty
    assert dc.drop_contaminated(d, b, 5).columns == d.columns
    cut = {r["doc_id"]: len(words(r["text"])) for r in dc.cut_contaminated(d, b, 5).collect()}
    assert cut == {r[0]: r[1] - r[2] for r in brute(docs, items, 5)}


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, "a b"), (None, "a b " * 40000)], "doc_id bigint, text string")
    b = spark.createDataFrame([(1, "a b a b")], "item_id bigint, text string")
    assert [r["contaminated"] for r in dc.contaminated(d, b.limit(0)).collect()] == [False, False]
    assert dc.contaminated(d.limit(0), b).count() == 0
    assert sorted(r["n_hit"] for r in dc.contaminated(d, b).collect()) == [0, 80000]


def test_items_without_id(spark):
    docs = [(1, "x a b c d y"), (2, "a b c d e"), (3, "p q"), (4, "r s t"), (5, "none of it")]
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    b = spark.createDataFrame([(None, "a b c d"), (7, "b c d e"), (None, "p q"), (None, "r s t"), (8, "r s t")], "item_id bigint, text string")
    want = {1: (4, [None]), 2: (5, ["7", None]), 3: (2, [None]), 4: (3, ["8", None]), 5: (0, [])}
    for most in (500_000, 2):
        dc.MOST_WINDOWS = most
        assert {r["doc_id"]: (r["n_hit"], r["items"]) for r in dc.contaminated(d, b, 4).collect()} == want
        assert [r["doc_id"] for r in dc.drop_contaminated(d, b, 4).collect()] == [5]
    dc.MOST_WINDOWS = 500_000
