import math
import random
from collections import Counter

import numpy as np
import pyarrow as pa

from skiplane.llm import lm_score as lm


def by_hand(network, around, target):
    """Log-probabilities by the definition, in 64 bits, one token after the other."""
    out = []
    for j, t in enumerate(target):
        total = network.bias.astype(float) + sum(network.near[k][around[k][j]].astype(float) for k in range(2 * lm.SIDE))
        h = np.append(np.tanh(total), 1.0)
        top, low = h @ network.top.astype(float), h @ network.low[t // lm.LEAVES].astype(float)
        one = lambda x, i: x[i] - x.max() - np.log(np.exp(x - x.max()).sum())
        out.append(one(top, t // lm.LEAVES) + one(low, t % lm.LEAVES))
    return np.array(out)


def test_log_probabilities_by_hand():
    rng = np.random.default_rng(1)
    network = lm.Network(rng.integers(1, 50, lm.SIZE))
    around, target = rng.integers(0, lm.SIZE, (2 * lm.SIDE, 300)), rng.integers(0, lm.SIZE, 300)
    assert np.allclose(network.log_probabilities(around, target), by_hand(network, around, target), atol=1e-4)
    network.low *= 300  # great logits
    assert np.allclose(network.log_probabilities(around, target), by_hand(network, around, target), atol=1e-1)


def test_learning_follows_the_slope(monkeypatch):
    rng = np.random.default_rng(2)
    around, target = rng.integers(0, lm.SIZE, (2 * lm.SIDE, 40)), rng.integers(0, lm.SIZE, 40)
    network = lm.Network(rng.integers(1, 50, lm.SIZE))
    start = network.flat.copy()
    squares = network.views(np.full_like(network.flat, 1.0))
    monkeypatch.setattr(lm, "RATE", 1.0)
    network.learn(around, target, squares)
    slope = (start - network.flat) * np.sqrt(np.concatenate([s.ravel() for s in squares]) + 1e-8)
    for at in rng.choice(np.flatnonzero(np.abs(slope) > 2e-3), 20, replace=False):
        ends = []
        for step in (1e-2, -1e-2):
            flat = start.copy()
            flat[at] += step
            ends.append(-by_hand(lm.Network(flat=flat), around, target).mean())
        assert np.isclose((ends[0] - ends[1]) / 2e-2, slope[at], rtol=0.05, atol=2e-4)


def test_every_position_is_a_target_once(monkeypatch):
    seen = []
    monkeypatch.setattr(lm.Network, "learn", lambda self, around, target, held: seen.extend(target.tolist()))
    monkeypatch.setattr(lm, "TaskContext", type("C", (), {"get": staticmethod(lambda: type("T", (), {"partitionId": staticmethod(lambda: 0)}))}))

    class Held:
        value = lm.Network(np.ones(lm.SIZE)).flat

    ids = np.arange(1, lm.SIZE, dtype="<u2")  # each leaf at one place
    texts = lm._packed(ids, np.array([1, 5, 20, len(ids) - 26, 0]))
    counted = 0
    for round_ in range(lm.ROUNDS):
        for b in lm._trained(Held, round_, lm.ROUNDS)(iter([pa.RecordBatch.from_arrays([texts], names=["ids"])])):
            counted += b.column("n")[0].as_py()
    assert sorted(seen) == ids.tolist() and counted == len(ids)


def corpus(n=300):
    rng = random.Random(2)
    words = [f"{a}{b}" for a in ("ka", "lo", "mi", "ru", "se") for b in ("n", "r", "st", "x", "l", "p")]
    texts = [" ".join(words[(s + 7 * k) % len(words)] for k in range(60)) + f" rare{i % 97}" for i, s in ((i, rng.randrange(30)) for i in range(n))]
    return [*enumerate(texts), (None, None), (999, ""), (998, " \n"), (5, "red green " * 3000), (7, texts[7])]


def test_scores_are_sums_over_windows_and_beat_the_unigram(spark):
    rows = corpus()
    df = spark.createDataFrame(rows, "doc_id bigint, text string").selectExpr("*", "'x' AS ids", "1 AS n")
    caught = {}
    train = lm.train

    def keep(*args, **options):
        caught["network"] = train(*args, **options)
        return caught["network"]

    lm.train = keep
    try:
        got = lm.pseudo_likelihood(df).collect()
    finally:
        lm.train = train
    assert len(got) == len(rows)
    split = lambda t: lm.WORD.findall((t or "").lower())
    counts = Counter(w for _, t in rows for w in split(t))
    ranked = sorted(counts, key=lambda w: (-counts[w], w))
    leaf = {w: 1 + i if i < lm.FREQUENT else lm.tail_leaf_of(w) for i, w in enumerate(ranked)}
    want = Counter()
    gain = total = 0
    for i, t in rows:
        ids = np.array([leaf[w] for w in split(t)], dtype=np.int64)
        padded = np.concatenate([np.zeros(lm.SIDE, np.int64), ids, np.zeros(lm.SIDE, np.int64)])
        around = np.array([padded[lm.SIDE + k : lm.SIDE + k + len(ids)] for k in (-2, -1, 1, 2)]).reshape(4, -1)
        score = by_hand(caught["network"], around, ids).sum() if len(ids) else 0.0
        gain += score - sum(math.log(counts[w] / sum(counts.values())) for w in split(t))
        total += len(ids)
        want[i, len(ids), round(score, 1)] += 1
    have = Counter((r["doc_id"], r["n_tokens"], round(r["log_likelihood"], 1)) for r in got)
    close = lambda a, b: all(any(k[:2] == m[:2] and abs(k[2] - m[2]) < 0.3 for m in b) for k in a)
    assert close(want, have) and close(have, want)
    assert gain / total > 0.5
    assert all(r["mean_log_likelihood"] is None if not r["n_tokens"] else math.isclose(r["log_likelihood"], r["mean_log_likelihood"] * r["n_tokens"]) for r in got)
    assert lm.pseudo_likelihood(df.limit(0)).count() == 0


def test_partitions_do_not_matter(spark):
    df = spark.createDataFrame(corpus(), "doc_id bigint, text string")
    runs = []
    for n in (2, 16):
        got = lm.pseudo_likelihood(df.repartition(n), shard_tokens=4000).collect()
        runs.append(sorted((r["doc_id"] or -1, r["n_tokens"], r["log_likelihood"]) for r in got))
    assert np.allclose(runs[0], runs[1], atol=1e-3)


def test_words_of_one_leaf_are_told_apart(spark):
    frequent = " ".join(f"f{i}q" for i in range(lm.FREQUENT)) + " "
    rows = [(1, "oftenzz"), (2, "rarezz"), (3, " ".join(["oftenzz"] * 9)), (4, frequent * 20), (None, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(5)
    got = {r["doc_id"]: r["log_likelihood"] for r in lm.pseudo_likelihood(df).collect()}
    assert len(got) == 5 and np.isclose(got[1] - got[2], np.log(10.5 / 1.5), atol=1e-5)
    tokens, kinds = np.zeros(lm.SIZE), np.zeros(lm.SIZE)
    tokens[-1], kinds[-1] = 11, 2  # the words of a leaf, and the unseen, share it whole
    assert np.isclose(np.exp(lm.shares(np.full(3, lm.SIZE - 1), np.array([10, 1, 0]), tokens, kinds)).sum(), 1)
