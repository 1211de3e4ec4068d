import hashlib
import random
import re

from pyspark.sql import functions as F

from skiplane.llm import secrets

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def brute(text):
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text or "") if len(m[2]) >= 6]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text or "") if len(m[0]) >= 20]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text or "") if len(m[0]) >= 24]
    return sorted(out)


def test_base_spans(spark):
    rng = random.Random(2)
    parts = ["password", "PassWd", "secret", " token", "api_key", "APIKEY", '"', "'", " ", " = ", ":", "=", "abc", "hunter22", "AKIA", "ABCDEFGH12345678", "0123456789abcdef", "00ff00ff", "é😀", "\n", "ſecret", "Zx9+/_.-"]
    rows = [(i, "".join(rng.choice(parts) for _ in range(rng.randint(0, 14))), "s") for i in range(400)] + [(400, None, None), (401, "", "s"), (402, "x " * 60000 + "token=abcdef1", "s"), (None, "token=abcdef1", "s"), (1, "token = zzzzzzz", "t")]
    got = secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).select("doc_id", F.expr("transform(filter(secrets, s -> s.rank < 3), s -> struct(s.start, s.rank, s.end))").alias("x")).collect()
    key = lambda x: (x[0] is None, x)
    assert sorted(((r[0], [tuple(s) for s in r[1]]) for r in got), key=key) == sorted(((i, brute(t)) for i, t, _ in rows), key=key)


def test_ownership_separates_live_from_copied(spark):
    live, copied = "Zx81kQpVb73LmNtR40yWcAe2", "Qw3rTy77UiOp1AsDfGhJ2kLz"
    rows = [(i, f"see {copied} here", f"src{i % 5}") for i in range(30)] + [(100 + i, f"mine {live}, really", "src1") for i in range(3)] + [(200, f"password={copied}", "src2"), (200, f"password={copied}", "src2")]
    got = {(r["doc_id"]): r["secrets"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert all(not got[i] for i in range(30))
    assert all([(s["start"], s["end"], s["live"], s["owners"], s["repositories"]) for s in got[100 + i]] == [(5, 29, True, 1, 3)] for i in range(3))
    assert [(s["rank"], s["live"], s["owners"]) for s in got[200]] == [(0, False, 5)]


def test_redact(spark):
    live = "Zx81kQpVb73LmNtR40yWcAe2"
    rows = [(1, f"é token='{'a' * 30}' and {live}", 7, "x"), (2, None, None, "x"), (3, "clean", 5, "x"), (3, "clean", 5, "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, n_chars bigint, secrets string")
    out = secrets.redact(df)
    assert out.columns == df.columns
    got = sorted(map(tuple, out.collect()), key=str)
    assert got == sorted([(1, "é [REDACTED]' and [REDACTED]", 28, "x"), *rows[1:]], key=str)
    assert secrets.redact(df.limit(0)).count() == 0 and secrets.scan(df.limit(0)).count() == 0


def test_digest(spark):
    row = secrets.scan(spark.createDataFrame([(1, "token=abcdef0123456789abcdef0123456789", "s")], "doc_id bigint, text string, source string")).select(secrets.digest(F.col("secrets"), 3).alias("d")).first()
    assert row["d"] == "assign:0:38,hex:6:38" and len(hashlib.sha256(row["d"].encode()).hexdigest()) == 64


def test_long_runs_and_many_secrets(spark):
    many = " ".join(f"token=é abcdef{i:06d} AKIA{'Z' * 16}" if i % 2 else f"token=abcdef{i:06d}" for i in range(50_000))
    rows = [(1, "x" * 1_000_000, "s"), (2, many, "s"), (3, "password" + " " * 1_000_000, "s"), (4, "aA" * 500_000, "s"), (5, "aA1" * 300_000, "s")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string").cache()
    got = {r["doc_id"]: r["secrets"] for r in secrets.scan(df).collect()}
    assert [(s["start"], s["rank"], s["end"]) for s in got[2]] == brute(many)
    assert not got[1] and not got[3] and not got[4] and [(s["start"], s["end"]) for s in got[5]] == [(0, 900_000)]
    raw = many.encode()
    assert all(raw[s["lo"] : s["hi"]] == many[s["start"] : s["end"]].encode() for s in got[2][::997])
    clean, at, out = {r["doc_id"]: r["text"] for r in secrets.redact(df).collect()}, 0, []
    for a, _, b in brute(many):
        if a >= at:
            out += [many[at:a], secrets.REDACTED]
        at = max(at, b)
    assert clean[2] == "".join([*out, many[at:]]) and clean[1] == rows[0][1] and clean[5] == secrets.REDACTED


def test_a_value_in_a_third_of_all_texts(spark):
    shared = "Qw3rTy77UiOp1AsDfGhJ2kLz"
    rows = [(i, f"token={shared}" if i % 3 == 0 else f"token=own{i:06d}", f"src{i % 7}") for i in range(3000)]
    got = {r["doc_id"]: r["secrets"] for r in secrets.scan(spark.createDataFrame(rows, "doc_id bigint, text string, source string")).collect()}
    assert len(got) == 3000 and all([(s["owners"], s["live"]) for s in got[i]] == ([(7, False)] if i % 3 == 0 else [(1, True)]) for i in range(3000))
