"""Rendezvous hashing of record keys over weighted shards (Thaler and Ravishankar, 1998; weights after Schindelhauer and Schomaker, 2005).

DataFrame functions only. A key's score for a shard depends on that key, that
shard and its weight alone, and the highest score wins; so one more shard
takes keys only into itself, and one less gives up only its own.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiplane.llm.common import cut, pick

#: Multipliers of the 32-bit mixer; products stay below 2**63.
MULTIPLIERS = (0x45D9F3B, 0x119DE1F3)
#: Rows of one shard that one task numbers, about.
ROWS_A_TASK = 1_000_000


def _mix(x: Column) -> Column:
    """A 32-bit mixer on non-negative longs, in arithmetic that any SQL engine shares."""
    for m in MULTIPLIERS:
        x = x.bitwiseXOR(F.shiftright(x, 16))
        x = (x * F.lit(m).cast("bigint")).bitwiseAND(F.lit(0xFFFFFFFF).cast("bigint"))
    return x.bitwiseXOR(F.shiftright(x, 16))


def key_hash(key: Column) -> Column:
    """32 bits of a key's text; null is a key of its own."""
    return F.conv(F.substring(F.md5(F.coalesce(key.cast("string"), F.lit("\x00")).cast("binary")), 1, 8), 16, 10).cast("bigint")


def shard_of(hashed: Column, weights: Sequence[float]) -> Column:
    """The shard (0, 1, ...) of each key hash: the greatest -weight / ln(u), u in (0, 1) by the mix of key and shard; the lower shard of equals."""
    if not weights or any(not w > 0 for w in weights):
        raise ValueError("weights must be positive")

    def score(weight: Column, shard: Column) -> Column:
        u = (_mix(hashed.bitwiseXOR(_mix(shard.cast("bigint") + 1))).cast("double") + 0.5) / F.lit(4294967296.0)
        return F.struct((-weight / F.log(u)).alias("score"), (-shard).alias("shard"))

    return -F.array_max(F.transform(F.array(*[F.lit(float(w)) for w in weights]), score))["shard"]


def rendezvous(docs: DataFrame, weights: Sequence[float], key: str = "doc_id", next_weight: float = 1.0) -> DataFrame:
    """One row per row of ``docs``: doc_id, size, text_crc32, law, shard, slot, grown_shard.

    size: bytes of the text as UTF-8 plus 16; text_crc32: of the same bytes.
    law is ``key``. grown_shard: where the row goes with one more shard of
    ``next_weight``. slot numbers the rows of a shard from 0 without gaps:
    shards are dealt into parts by another hash of key and text, parts are numbered
    on their own, and the counts of the parts before are added.

    Null text: no bytes. Null key: a key like any other. Repeated rows: one
    shard, a slot each. Empty table: no rows. Other columns are ignored.
    """
    rows = pick(docs, doc_id=f"{key}:bigint", text="string")
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = rows.select("doc_id", (F.octet_length(text) + 16).cast("bigint").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"), key_hash(F.col("doc_id")).alias("__hash"))
    rows = rows.select("*", shard_of(F.col("__hash"), weights).cast("int").alias("shard"), shard_of(F.col("__hash"), [*weights, next_weight]).cast("int").alias("grown_shard"))
    rows = cut(rows)
    parts = max(-(-rows.count() // ROWS_A_TASK), 16)  # one shard may hold most rows
    rows = rows.withColumn("part", F.pmod(_mix(F.col("__hash").bitwiseXOR(F.col("text_crc32"))), F.lit(parts)).cast("int"))
    counts = rows.groupBy("shard", "part").agg(F.count("*").alias("n"))
    before = counts.select("shard", "part", (F.sum("n").over(Window.partitionBy("shard").orderBy("part")) - F.col("n")).alias("before"))
    turn = F.row_number().over(Window.partitionBy("shard", "part").orderBy("doc_id", "text_crc32", "size")) - 1
    numbered = rows.withColumn("turn", turn.cast("bigint")).join(before, ["shard", "part"])
    return numbered.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", (F.col("turn") + F.col("before")).alias("slot"), "grown_shard")
