import itertools
import random
import re

import pytest

import corpus_pipeline
from skiplane.llm import packing, secrets

pytest.importorskip("public_tokenizers")


def shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)}


def made():
    rng = random.Random(6)
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(600)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    benchmark = [(k, text(rng.choice([6, 12, 30]))) for k in range(6)] + [(9, None)]
    docs = [(i, text(rng.randint(60, 140))) for i in range(120)]
    docs += [(200 + i, docs[i][1]) for i in range(8)]  # exact copies
    docs += [(300 + i, docs[i][1] + " " + text(2)) for i in range(8)]  # near copies
    docs += [(400 + i, f"{text(60)} {benchmark[i % 6][1].upper()} {text(10)}") for i in range(8)]
    docs += [(500 + i, f"{text(70)} password=hunter{i:04d}22 é {text(5)} AKIA{'Q' * 15}{i} {'0123456789abcdef' * 2}") for i in range(5)]
    docs += [(600, text(20)), (601, "a b c " * 50), (602, None), (603, ""), (5, docs[5][1])]
    return [(i, t, "en", f"s{i % 3}", None if t is None else len(t)) for i, t in docs], benchmark


def test_each_stage_by_brute_force(spark, tmp_path):
    docs, benchmark = made()
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(benchmark, "item_id bigint, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_duplicates", "decontamination", "secret_scan", "packing"]
    now, held = spark.read.parquet(str(tmp_path / "documents.parquet")), docs
    columns = now.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, now, str(tmp_path))
        assert out.columns == columns
        got = sorted(map(tuple, out.collect()))
        if name == "quality_rules":
            repeats = lambda t: len({p for i, g in enumerate(zip(*(t.split()[k:] for k in range(3)))) if list(zip(*(t.split()[k:] for k in range(3)))).count(g) > 1 for p in range(i, i + 3)})
            want = [r for r in held if len((r[1] or "").split()) >= 50 and 2 * repeats(r[1]) <= len(r[1].split())]
        elif name == "near_duplicates":
            once, of = sorted(set(held)), {}
            for r in once:
                of[r] = r[0]
            sets = {r: shingles(r[1]) for r in once}
            for _ in range(len(once)):
                before = dict(of)
                for a, b in itertools.combinations(once, 2):
                    both = len(sets[a] & sets[b])
                    if both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                        of[a] = of[b] = min(of[a], of[b])
                if of == before:
                    break
            want = [r for r in once if of[r] == r[0]]
        elif name == "decontamination":
            norm = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").lower())
            grams = {tuple(w[i : i + min(10, len(w))]) for w in (norm(t) for _, t in benchmark) for i in range(max(len(w) - 9, 1)) if w}
            want = [r for r in held if not any(tuple(norm(r[1])[i : i + n]) in grams for n in (6, 10) for i in range(len(norm(r[1])) - n + 1))]
        else:
            hide = lambda t: re.sub(r"[0-9a-f]{24,}", secrets.REDACTED, re.sub(r"AKIA[A-Z0-9]{16,}", secrets.REDACTED, re.sub(r"password=[A-Za-z0-9]+", secrets.REDACTED, t)))
            want = [(i, hide(t), lang, source, len(hide(t))) for i, t, lang, source, _ in held]
        assert got == sorted(want), name
        assert name == "secret_scan" or len(got) < len(held)
        out.write.parquet(str(tmp_path / name))
        now, held = spark.read.parquet(str(tmp_path / name)), want
    pieces = sorted(map(tuple, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "start", "length", "doc_tokens").collect()))
    import public_tokenizers

    encode = packing.Encoder(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, t, *_ in held:
        n = len(encode(t)) // 4 + 1
        want += [(i, s, min(2048, n - s), n) for s in range(0, n, 2048)]
    assert pieces == sorted(want)
