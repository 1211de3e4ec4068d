"""Packing by cutting-stock column generation (Gilmore and Gomory, 1961).

Full sequences are cut off each document; what is left of it is a piece
shorter than a sequence. A histogram of these lengths, in classes, is all that
comes to the driver: its size is bounded by the capacity, not by the corpus. A
linear program over patterns (how many pieces of each class share a sequence)
is solved there, with a knapsack dynamic program to price new patterns, and
rounded down to whole patterns; the rest is filled first-fit, again by class.
Documents, ranked within their class, then look up their place: rank r of a
class belongs to a known copy of a known pattern.
"""

from __future__ import annotations

import functools
import json
import os
import struct
import warnings
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from skiplane.llm import textbytes as tb
from skiplane.llm.common import cut, pick

#: Bytes of text handled at a time.
SLICE = 1 << 21
#: Rows of one class that one task ranks, about.
ROWS_A_TASK = 500_000
#: Width of a class of lengths: a piece counts as the next multiple.
GRAIN = 4
#: Columns that may enter, at most; ``Plan.proved`` says whether that was enough.
ROUNDS = 4_000
#: The linear program counts as solved when its value is so near to the lower bound, as a share.
GAP = 1e-7


#: The pattern of byte-level BPE's pre-tokens, and how it writes each byte: printable Latin-1 characters as themselves, the others as 256, 257, ...
PRE_TOKENS = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
_PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_OF = {chr(b): b for b in _PRINTED} | {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(_PRINTED)))}


class Encoder:
    """Ids of texts by a tokenizer file, as little-endian unsigned 32-bit bytes.

    Plain byte-level BPE whose ids grow in the order of its merges is handed to
    tiktoken with the file's own vocabulary, which gives the same ids several
    times faster. Texts that hold the string of an added token, and all texts
    of other tokenizers, are encoded by the tokenizers library.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # tasks are the parallelism
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        self.added = [t["content"] for t in told.get("added_tokens", [])]
        self.plain = self._plain(told)

    def _plain(self, told: dict):
        before, model = told.get("pre_tokenizer") or {}, told["model"]
        odd = [told.get("normalizer"), told.get("post_processor"), *(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))]
        if any(odd) or model.get("type") != "BPE" or before.get("type") != "ByteLevel" or not before.get("use_regex", True) or before.get("add_prefix_space"):
            return None
        merged = [model["vocab"]["".join(m.split(" ") if isinstance(m, str) else m)] for m in model["merges"]]
        ranks = {bytes(map(BYTE_OF.__getitem__, t)): i for t, i in model["vocab"].items() if t not in self.added}
        if merged != sorted(merged) or any(bytes([b]) not in ranks for b in range(256)) or len(ranks) != 256 + len(merged):
            return None
        import tiktoken

        return tiktoken.Encoding("plain", pat_str=PRE_TOKENS, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.plain is None or any(a in text for a in self.added):
            ids = self.whole.encode(text, add_special_tokens=False).ids
            return struct.pack(f"<{len(ids)}I", *ids)
        return self.plain.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


@functools.lru_cache(maxsize=1)
def encoder(path: str) -> Encoder:
    """One a process: the tables of the tokenizer, nothing of the texts."""
    return Encoder(path)


def _pieces(path: str, capacity: int, end_id: int | None):
    kind = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64())])
    tail = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in tb.slices(batches, "text", SLICE):
            out: list[list[int | None]] = [[], [], [], [], []]
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                ids = encode(text or "") + tail
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    part = ids[4 * start : 4 * (start + capacity)]
                    for column, x in zip(out, (doc, start, len(part) // 4, zlib.crc32(part), n), strict=True):
                        column.append(x)
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], schema=kind)

    return run


def _knapsack(value: np.ndarray, capacity: int) -> np.ndarray:
    """Counts of classes 1..n (of size 1..n grains) with the greatest total value in ``capacity`` grains."""
    n = len(value) - 1
    best, choice = np.zeros(capacity + 1), np.zeros(capacity + 1, dtype=np.int64)
    for c in range(1, capacity + 1):
        m = min(c, n)
        gains = value[1 : m + 1] + best[c - m : c][::-1]
        k = int(np.argmax(gains))
        if gains[k] > best[c - 1]:
            best[c], choice[c] = gains[k], k + 1
        else:
            best[c], choice[c] = best[c - 1], 0
    counts, c = np.zeros(n + 1, dtype=np.int64), capacity
    while c > 0:
        k = int(choice[c])
        if k:
            counts[k] += 1
            c -= k
        else:
            c -= 1
    return counts


def _first_basis(used: np.ndarray, left: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """Fractional first-fit by decreasing size: each pattern uses up a class that later ones don't hold, so the patterns (columns) are a basis."""
    n = len(used)
    basis, amount, settled = np.zeros((n, n)), np.zeros(n), np.zeros(n, dtype=bool)
    for p in range(n):
        row, room = np.zeros(n), capacity
        for k in np.flatnonzero(~settled)[::-1]:
            if used[k] <= room:
                row[k] = room // used[k]
                room -= int(used[k] * row[k])
        held = np.flatnonzero(row)
        times = left[held] / row[held]
        least = int(held[np.argmin(times)])
        basis[:, p], amount[p] = row, times.min()
        left = np.maximum(left - row * amount[p], 0)
        left[least], settled[least] = 0, True
    return basis, amount


class Plan(NamedTuple):
    """Patterns (rows: counts of each class), how often each is used, a lower bound of sequences, and whether the linear program was solved."""

    rows: np.ndarray
    uses: np.ndarray
    bound: float
    proved: bool


def patterns(histogram: np.ndarray, capacity: int, rounds: int = ROUNDS) -> Plan:
    """Whole numbers of patterns that cover the histogram exactly.

    ``histogram[k]`` pieces take k grains; ``capacity`` is in grains. The
    master program is solved by the revised simplex method from the patterns of
    a fractional first-fit; a column enters while the knapsack finds one worth
    more than a sequence. The knapsack's value also bounds the optimum from
    below (Farley, 1990), which tells when to stop. The solution is rounded
    down, and the few pieces left over are packed first-fit by decreasing size.
    """
    n = len(histogram) - 1
    used = np.flatnonzero(histogram[1:]) + 1
    if not len(used):
        return Plan(np.zeros((0, n + 1), dtype=np.int64), np.zeros(0, dtype=np.int64), 0.0, True)
    asked = histogram[used].astype(float)
    basis, amount = _first_basis(used, asked, capacity)
    inverse = np.linalg.inv(basis)
    bound, proved = 0.0, False
    for round_ in range(rounds):
        dual = inverse.sum(axis=0)  # all costs are 1
        value = np.zeros(n + 1)
        value[used] = np.maximum(dual, 0)
        counts = _knapsack(value, capacity)
        worth = float(value @ counts)
        bound = max(bound, float(asked @ value[used]) / max(worth, 1.0))
        if dual @ counts[used] <= 1 + 1e-9 or amount.sum() - bound <= GAP * bound:
            proved = True
            break
        column = counts[used].astype(float)
        step = inverse @ column
        ratio = np.where(step > 1e-9, amount / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(np.argmin(ratio))
        if not np.isfinite(ratio[leave]):
            break
        amount -= step * ratio[leave]
        amount[leave] = ratio[leave]
        amount = np.maximum(amount, 0)
        basis[:, leave] = column
        if round_ % 50 == 49:
            inverse = np.linalg.inv(basis)
            amount = np.maximum(inverse @ asked, 0)
        else:
            pivot = inverse[leave] / step[leave]
            inverse -= np.outer(step, pivot)
            inverse[leave] = pivot
    times = np.floor(amount + 1e-9).astype(np.int64)
    shape = np.zeros((len(used), n + 1), dtype=np.int64)
    shape[:, used] = np.rint(basis.T).astype(np.int64)
    left = histogram - times @ shape
    for p in range(len(shape)):  # a pattern that covers more than there is gives up copies
        while times[p] and (left < 0).any() and (shape[p][left < 0] > 0).any():
            times[p] -= 1
            left = left + shape[p]
    rows, uses = list(shape[times > 0]), list(times[times > 0])
    while left.any():  # first-fit decreasing, many copies of a pattern at a time
        row, room = np.zeros(n + 1, dtype=np.int64), capacity
        for k in range(n, 0, -1):
            if left[k] and k <= room:
                row[k] = min(int(left[k]), room // k)
                room -= k * row[k]
        k = row > 0
        times_ = max(1, int((left[k] // row[k]).min()))
        rows.append(row)
        uses.append(times_)
        left = left - row * times_
    return Plan(np.array(rows, dtype=np.int64), np.array(uses, dtype=np.int64), bound, proved)


def _places(rows: np.ndarray, uses: np.ndarray) -> dict[str, np.ndarray]:
    """For each class, its patterns in order: rank at which each begins, pieces in one copy, sequence of the first copy."""
    first = np.concatenate([[0], np.cumsum(uses)[:-1]]) if len(uses) else np.zeros(0, np.int64)
    out: dict[str, list] = {"class": [], "begin": [], "each": [], "sequence": []}
    for k in range(1, rows.shape[1]):
        has = np.flatnonzero(rows[:, k])
        n = rows[has, k] * uses[has]
        out["class"] += [k] * len(has)
        out["begin"] += (np.cumsum(n) - n).tolist()
        out["each"] += rows[has, k].tolist()
        out["sequence"] += first[has].tolist()
    return {k: np.array(v, dtype=np.int64) for k, v in out.items()}


def _looked_up(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = held.value
        key = at["class"] * (1 << 48) + at["begin"]
        for batch in batches:
            of, rank = batch.column("class").to_numpy(), batch.column("rank").to_numpy()
            p = np.searchsorted(key, of * (1 << 48) + rank, side="right") - 1
            sequence = at["sequence"][p] + (rank - at["begin"][p]) // at["each"][p]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(sequence)], names=[*names, "sequence_id"])

    return run


def pack(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = 1, grain: int = GRAIN) -> DataFrame:
    """Pieces of documents in sequences of at most ``capacity`` tokens: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    start: tokens of the document before the piece. ids_crc32: of its ids as
    little-endian unsigned 32-bit numbers. offset: where it stands in its
    sequence; pieces of a sequence follow each other without a gap.

    Null and empty texts: only the end id (no piece without one). Null doc_id:
    packed like any other. Repeated rows: pieces of their own. Empty table: no
    rows. Only doc_id and text are read; extra columns are ignored.
    """
    spark = docs.sparkSession
    docs = pick(docs, doc_id="bigint", text="string")
    pieces = cut(docs.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"))
    size = -(-capacity // grain)
    pieces = pieces.withColumn("class", F.when(F.col("length") > capacity // grain * grain, F.lit(size)).otherwise(F.ceil(F.col("length") / grain)).cast("bigint"))
    counted = pieces.groupBy("class").agg(F.count("*").alias("n")).collect()  # as many rows as there are classes, at most
    histogram = np.zeros(size + 1, dtype=np.int64)
    for r in counted:
        histogram[r["class"]] = r["n"]
    parts = max(16, int(-(-histogram.sum() // ROWS_A_TASK)))
    pieces = pieces.withColumn("part", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(parts)).cast("int"))
    counts = pieces.groupBy("class", "part").agg(F.count("*").alias("n"))
    before = counts.select("class", "part", (F.sum("n").over(Window.partitionBy("class").orderBy("part")) - F.col("n")).alias("before"))
    turn = (F.row_number().over(Window.partitionBy("class", "part").orderBy("doc_id", "start", "ids_crc32")) - 1).cast("bigint")
    ranked = pieces.withColumn("turn", turn).join(before, ["class", "part"]).withColumn("rank", F.col("turn") + F.col("before")).drop("turn", "before", "part")
    plan = patterns(histogram, size)
    if not plan.proved:
        warnings.warn(f"column generation stopped early: {plan.uses.sum()} sequences, the bound is {plan.bound:.0f}", stacklevel=2)
    held = spark.sparkContext.broadcast(_places(plan.rows, plan.uses))
    placed = ranked.mapInArrow(_looked_up(held), "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint")
    order = Window.partitionBy("sequence_id").orderBy(F.desc("length"), "doc_id", "start")
    offset = F.sum("length").over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("length")
    return placed.withColumn("offset", offset)
