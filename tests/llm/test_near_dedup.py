import random
import re

from skiplane.llm import near_dedup as nd


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows, percent):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    return sorted((i, len(s), root(i), root(i) == i) for i, s in sets)


def corpus(n, seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 5)))
    base = [[word() for _ in range(rng.choice([3, 4, 5, 40, 120]))] for _ in range(max(2, n // 12))]
    rows = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 6])):
            words[rng.randrange(len(words))] = word()
        rows.append((i * 7 - 50, rng.choice([" ", "\n", "\t "]).join(words).upper() if rng.random() < 0.3 else " ".join(words)))
    return rows


def run(spark, rows, percent):
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return sorted(tuple(r) for r in nd.near_duplicates(df, percent).select("doc_id", "n_shingles", "component_id", "kept").collect())


def test_same_as_all_pairs(spark):
    for percent in (80, 85):
        rows = corpus(160, percent)
        assert run(spark, rows, percent) == brute(rows, percent)


def test_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(nd, "BLOCK", 4)
    rng = random.Random(3)
    base = [str(rng.random()) for _ in range(60)]
    rows = []
    for i in range(90):
        words = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            words[rng.randrange(60)] = str(rng.random())
        rows.append((i, " ".join(words)))
    assert run(spark, rows, 70) == brute(rows, 70)


def test_edge_cases(spark):
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, " \n\t", "x"), (4, "one two", "x"), (5, "One  TWO", "x"), (None, "one two", "x"), (6, "a b " * 30000, "x"), (7, "a b " * 30000, "x"), (7, "a b " * 30000, "x")], "doc_id bigint, text string, component_id string")
    got = sorted(map(tuple, nd.near_duplicates(df).select("doc_id", "n_shingles", "component_id", "kept").collect()), key=str)
    assert got == sorted([(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (5, 1, 4, False), (None, 1, None, True), (6, 2, 6, True), (7, 2, 6, False), (7, 2, 6, False)], key=str)
    assert nd.near_duplicates(df.limit(0)).count() == 0


def test_posterior_bounds():
    assert nd.least_matches(30, 0.85, 1e-6) < 0.85 * 30
    bounds = [nd.least_matches(n, 0.85, 1e-6) / n for n in (30, 60, 120, 240)]
    assert bounds == sorted(bounds)
    rows, bands = nd.banding(0.85, 1e-6)
    assert (1 - 0.85**rows) ** bands <= 1e-6 and rows * bands <= nd.MOST_VALUES
