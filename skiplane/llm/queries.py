"""The registered query of each operator, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skiplane.llm import decontaminate, language, lm_score, near_dedup, packing, quality, repeats, secrets, sharding, urls
from skiplane.llm.secrets import BASE, MORE

#: Words with their places, windows of items, their occurrences, the words these cover.
OP9 = r"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT item, n, array_to_string(w[p : p + n - 1], ' ') AS words FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - least(10, len(w)) + 2, 1))) AS p FROM b WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT doc_id, n, p, array_to_string(w[p : p + n - 1], ' ') AS words FROM (SELECT doc_id, w, n.n, unnest(range(1, greatest(len(w) - n.n + 2, 1))) AS p FROM d, n)),
hit AS (SELECT dw.doc_id, bw.item, dw.p, dw.n FROM dw JOIN bw USING (n, words)),
per AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hit) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN per USING (doc_id) LEFT JOIN its USING (doc_id)
"""


#: Places of the matches of each kind, from the pieces between them; owners of each value; added spans that are live and outside base ones.
_KINDS = BASE | {"owned": (*MORE["owned"][:2], 24)}
_MATCHES = " UNION ALL ".join(f"SELECT r, source, {k} AS rank, {least} AS least, string_split_regex(t, '{p}') AS p, regexp_extract_all(t, '{p}', 0) AS m, regexp_extract_all(t, '{p}', {g}) AS v FROM d" for k, (p, g, least) in enumerate((p.replace("'", "''"), g, least) for p, g, least in _KINDS.values()))
_DIGEST = "coalesce(string_agg(['assign', 'access', 'hex', 'owned'][rank + 1] || ':' || s || ':' || e, ',' ORDER BY s, rank){}, '')"
OP7 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents),
k AS ({_MATCHES}),
i AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM k),
f AS (SELECT r, source, rank, list_sum(list_transform(p[1:i], lambda x: len(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: len(x))), 0) AS s, len(m[i]) AS n, v[i] AS v FROM i
      WHERE len(v[i]) >= least AND (rank < 3 OR (regexp_matches(v[i], '[0-9]') AND regexp_matches(v[i], '[a-z]') AND regexp_matches(v[i], '[A-Z]')))),
o AS (SELECT v, count(DISTINCT coalesce('=' || source, 'null')) <= 1 AS live FROM f GROUP BY v),
c AS (SELECT r, rank, CAST(s AS BIGINT) AS s, CAST(s + n AS BIGINT) AS e, live FROM f JOIN o USING (v)),
b AS (SELECT * FROM c WHERE rank < 3),
x AS (SELECT * FROM b UNION ALL SELECT * FROM c WHERE rank = 3 AND live AND NOT EXISTS (SELECT 1 FROM b WHERE b.r = c.r AND b.s < c.e AND c.s < b.e)),
g AS (SELECT r, count(*) FILTER (rank = 0) AS n0, count(*) FILTER (rank = 1) AS n1, count(*) FILTER (rank = 2) AS n2, {_DIGEST.format(" FILTER (rank < 3)")} AS base, {_DIGEST.format("")} AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_copied FROM x GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_copied, 0) AS n_copied
FROM d LEFT JOIN g USING (r)
"""


_UNPIVOT = " UNION ALL ".join(f"SELECT lang, source, '{r}' AS rule, {r} AS x FROM m WHERE NOT base_failed" for r in quality.RULES)
_SLACK = "CASE rule " + " ".join(f"WHEN '{r}' THEN {x}" for r, x in quality.SLACK.items()) + " END"
_FLOOR = "(({0} - greatest(({0} >> 5) - 1, 0) * 32) << CAST(greatest(({0} >> 5) - 1, 0) AS INTEGER))"


def _bounds(keys: str) -> str:
    """Fences by the quartiles of the merged histograms of ``keys``."""
    by = f"{keys}, " if keys else ""
    q1, q3 = _FLOOR.format("q1"), _FLOOR.format("q3")
    return f"""SELECT {by}rule, docs, {q1} - {quality.FENCE} * ({q3} - {q1}) - {_SLACK} AS low, {_FLOOR.format("(q3 + 1)")} + {quality.FENCE} * ({q3} - {q1}) + {_SLACK} AS high FROM (
      SELECT {by}rule, max(docs) AS docs, min(bin) FILTER (upto * 4 >= docs) AS q1, min(bin) FILTER (upto * 4 >= docs * 3) AS q3 FROM (
      SELECT {by}rule, bin, sum(n) OVER (PARTITION BY {by}rule ORDER BY bin) AS upto, sum(n) OVER (PARTITION BY {by}rule) AS docs FROM (SELECT {by}rule, bin, CAST(sum(n) AS BIGINT) AS n FROM h GROUP BY {by}rule, bin)) GROUP BY {by}rule)"""


_JUDGED = ", ".join(f"max(CASE WHEN b.rule = '{r}' AND (x > high OR ({'true' if low else 'false'} AND x < low)) THEN '{r}' END) AS broken_{r}" for r, low in quality.RULES.items())
OP2 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, 'null') AS lang, coalesce('=' || source, 'null') AS source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
g AS (SELECT r, p, w[p:p + 2] AS g FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 1, 1))) AS p FROM w)),
n AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest(range(p, p + 3)) AS q FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS k FROM g) WHERE k > 1) GROUP BY r),
c AS (SELECT r, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(list_sum(list_transform(w, lambda x: len(x))), 0) AS BIGINT) AS word_chars, CAST(len(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, len(l) AS n_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words FROM w LEFT JOIN n USING (r)),
m AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, n_symbols * 1000 // greatest(word_chars, 1) AS symbols, greatest(n_dup_lines - 1, 0) * 1000 // greatest(n_lines, 1) AS dup_lines, n_repeat_words * 1000 // greatest(n_words, 1) AS repeats, word_chars * 1000 // greatest(n_words, 1) AS word_length FROM c),
h AS (SELECT lang, source, rule, greatest(len(bin(x)) - 6, 0) * 32 + (x >> CAST(greatest(len(bin(x)) - 6, 0) AS INTEGER)) AS bin, count(*) AS n FROM ({_UNPIVOT}) GROUP BY ALL),
bg AS ({_bounds("lang, source")}), bl AS ({_bounds("lang")}), ba AS ({_bounds("")}),
b AS (SELECT lang, source, rule, CASE WHEN bg.docs >= 200 THEN 'group' WHEN bl.docs >= 200 THEN 'lang' ELSE 'all' END AS level,
      CASE WHEN bg.docs >= 200 THEN bg.low WHEN bl.docs >= 200 THEN bl.low ELSE ba.low END AS low, CASE WHEN bg.docs >= 200 THEN bg.high WHEN bl.docs >= 200 THEN bl.high ELSE ba.high END AS high
      FROM bg JOIN bl USING (lang, rule) JOIN ba USING (rule)),
u AS (SELECT r, lang, source, rule, x FROM m, LATERAL (SELECT unnest(['symbols', 'dup_lines', 'repeats', 'word_length']) AS rule, unnest([symbols, dup_lines, repeats, word_length]) AS x)),
j AS (SELECT r, max(level) AS level, {_JUDGED} FROM u JOIN b USING (lang, source, rule) GROUP BY r)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND concat_ws(',', broken_symbols, broken_dup_lines, broken_repeats, broken_word_length) = '' AS kept,
       CAST(symbols AS BIGINT) AS symbols, CAST(dup_lines AS BIGINT) AS dup_lines, CAST(repeats AS BIGINT) AS repeats, CAST(word_length AS BIGINT) AS word_length, level, concat_ws(',', broken_symbols, broken_dup_lines, broken_repeats, broken_word_length) AS broken
FROM m LEFT JOIN j USING (r)
"""


def _mixed(x: str) -> str:
    for m in sharding.MULTIPLIERS:
        x = f"((xor({x}, {x} >> 16) * {m}) & 4294967295)"
    return f"xor({x}, {x} >> 16)"


#: CRC-32 by half bytes: what each does to the register.
_NIBBLES = [0] * 16
for _k in range(16):
    _c = _k
    for _ in range(4):
        _c = (_c >> 1) ^ (0xEDB88320 if _c & 1 else 0)
    _NIBBLES[_k] = _c
_CRC = f"xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(regexp_replace(hex(encode(t)), '(.)(.)', '\\2\\1', 'g'), ''), lambda h: CAST('0x' || h AS BIGINT))), lambda c, h: xor(c >> 4, ({_NIBBLES}::BIGINT[])[CAST(xor(c, h) & 15 AS INTEGER) + 1])), 4294967295)"
_SCORED = "arg_max(shard, [-1.0 / ln(((" + _mixed("xor(h, g)") + ")::DOUBLE + 0.5) / 4294967296.0), -shard::DOUBLE])"
_PART = _mixed("xor(h, text_crc32)") + " % (SELECT greatest(count(*) // 1000000 + CAST(count(*) % 1000000 > 0 AS BIGINT), 16) FROM documents)"
OP3 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t, CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), chr(0))), 1, 8) AS BIGINT) AS h FROM documents),
c AS (SELECT r, doc_id, h, CAST(strlen(t) + 16 AS BIGINT) AS size, CAST(CASE WHEN t = '' THEN 0 ELSE {_CRC} END AS BIGINT) AS text_crc32 FROM d),
g AS (SELECT shard, {_mixed("(shard + 1)")} AS g FROM (SELECT unnest(range(0, 41)) AS shard)),
s AS (SELECT r, {_SCORED} FILTER (shard < 40) AS shard, {_SCORED} AS grown FROM c, g GROUP BY r)
SELECT doc_id, size, text_crc32, 'key' AS law, CAST(shard AS INTEGER) AS shard, row_number() OVER (PARTITION BY shard ORDER BY {_PART}, doc_id NULLS FIRST, text_crc32, size) - 1 AS slot, CAST(grown AS INTEGER) AS grown_shard
FROM c JOIN s USING (r)
"""


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Fixed values.
URL_RULES = (("com/en/", "block"), ("example.com/en/7", "allow"), ("net/de/", "allow"), ("example.net/de/8", "block"), ("org/es/", "block"))


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES)


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(_table(spark, sf_dir, "documents")).withColumn("broken", F.array_join("broken", ","))


def op3_rendezvous_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.rendezvous(_table(spark, sf_dir, "documents"), weights=[1.0] * 40)


def op4_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.pseudo_likelihood(_table(spark, sf_dir, "documents"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), percent=85)


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(_table(spark, sf_dir, "documents"))
    n = lambda rank: F.size(F.filter("secrets", lambda s: s["rank"] == rank)).cast("bigint")
    live = lambda yes: F.size(F.filter("secrets", lambda s: s["live"] == yes)).cast("bigint")
    base, all_ = len(secrets.BASE), len(secrets.KINDS)
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(secrets.digest(F.col("secrets"), base), 256).alias("base_sha256"), secrets.digest(F.col("secrets"), all_).alias("spans"), live(True).alias("n_live"), live(False).alias("n_copied"))


def op8_cutting_stock_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), capacity=2048, end_id=1)


def op9_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), size=10)
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


def op10_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=100, with_bytes=False)
    removed = F.aggregate("removed", F.lit(0).cast("bigint"), lambda n, r: n + r["hi"] - r["lo"])
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("bigint").alias("n_spans"), "kept_sha256")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for name, f in globals().items() if name.startswith("op") and callable(f)}


def oracle_sql() -> dict[str, str]:
    return {"op2_quality_rules": OP2, "op3_rendezvous_sharding": OP3, "op7_secret_scan": OP7, "op9_benchmark_decontamination": OP9}
