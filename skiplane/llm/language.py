"""Language identification by words first, then shorter and shorter character n-grams.

A word that the model knows adds the logarithm of its frequency in each
language. An unknown word is taken apart into its longest n-grams; if none of
these is known, into the next shorter ones, down to single characters.

Counts cover all training texts. The model keeps every word and n-gram whose
share of its language is ``LEAST_SHARE`` or more, so that it holds at most
1 / LEAST_SHARE words, and as many n-grams of each length, a language: a bound
that doesn't depend on the corpus. Rarer words count as unknown.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiplane.llm import textbytes as tb
from skiplane.llm.common import cut, pick

#: Lengths of n-grams, longest first. A word is framed by "\x02" and "\x03".
LENGTHS = (5, 4, 3, 2, 1)
LEAST_SHARE = 2e-5
#: Stands in for the frequency of what a language doesn't have.
FLOOR_SHARE = 1e-7
#: Entries that a task gathers before it hands them on.
GATHERED = 400_000
#: Characters of the texts that these entries come from, at most.
GATHERED_SIZE = 1 << 26
SLICE = 1 << 22
WORD = re.compile(r"[^\W\d_]+")


def held_out(doc_id: Column) -> Column:
    """True where the crc32 of the id's text leaves 2 when divided by 4; null counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def words_of(raw: str) -> list[str]:
    return [raw] if raw.isalpha() else WORD.findall(raw)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, Counter] = {}  # of what stands between blanks
    size = 0

    def told() -> pa.RecordBatch:
        langs, words, counts = [], [], []
        for lang, raws in held.items():
            found: dict[str, int] = {}
            for raw, n in raws.items():
                for w in words_of(raw):
                    found[w] = found.get(w, 0) + n
            langs += [lang] * len(found)
            words += found.keys()
            counts += found.values()
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(words, pa.string()), pa.array(counts, pa.int64())], names=["lang", "word", "n"])

    for batch in tb.slices(batches, "text", SLICE):
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            held.setdefault(lang, Counter()).update((text or "").lower().split())
            size += len(text or "")
        if sum(map(len, held.values())) > GATHERED or size > GATHERED_SIZE:
            yield told()
            size = 0
    if held:
        yield told()


def grams(word: str, n: int) -> list[str]:
    framed = f"\x02{word}\x03"
    return [framed[i : i + n] for i in range(len(framed) - n + 1)]


def _grams_counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["lang", "size", "gram", "n"]
    held: dict[str, dict[str, int]] = {}

    def told() -> pa.RecordBatch:
        pieces = [g for found in held.values() for g in found]
        langs = [lang for lang, found in held.items() for _ in found]
        counts = [n for found in held.values() for n in found.values()]
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(map(len, pieces), pa.int32()), pa.array(pieces, pa.string()), pa.array(counts, pa.int64())], names=names)

    for batch in batches:
        for lang, word, n in zip(*(batch.column(c).to_pylist() for c in ("lang", "word", "n")), strict=True):
            found = held.setdefault(lang, {})
            for size in LENGTHS:
                for g in grams(word, size):
                    found[g] = found.get(g, 0) + n
            if len(found) > GATHERED:
                yield told()
    if held:
        yield told()


class Model:
    """Logarithms of shares: ``words`` and ``grams`` map a string to an array with an entry for each of ``langs``."""

    def __init__(self, langs: list[str], words: dict[str, np.ndarray], grams_: dict[int, dict[str, np.ndarray]]):
        self.langs, self.words, self.grams = langs, words, grams_

    def unknown(self, word: str) -> np.ndarray | None:
        for size in LENGTHS:
            found = [g for g in map(self.grams.get(size, {}).get, grams(word, size)) if g is not None]
            if found:
                return np.add.reduce(found, dtype=np.float64) / len(found)
        return None

    def sums(self, raw: str) -> np.ndarray:
        """Of the words in ``raw``, summed: an entry for each language, and whether there is a letter."""
        out = np.zeros(len(self.langs) + 1)
        for word in words_of(raw):
            of = self.words.get(word)
            of = self.unknown(word) if of is None else of
            if of is not None:
                out[:-1] += of
        out[-1] = any(map(str.isalpha, raw))
        return out


class Places(dict):
    """Rows of ``table`` that hold ``model.sums`` of strings; emptied between texts by ``trim``."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.size = model, 0
        self.table = np.zeros((1024, len(model.langs) + 1))

    def __missing__(self, raw: str) -> int:
        at = self[raw] = len(self)
        if at == len(self.table):
            self.table = np.concatenate([self.table, np.zeros_like(self.table)])
        self.table[at] = self.model.sums(raw)
        self.size += len(raw)
        return at

    def trim(self) -> None:
        if len(self) > GATHERED or self.size > GATHERED_SIZE:
            self.clear()
            self.size = 0


def _table(rows: pd.DataFrame, key: str, langs: list[str]) -> dict[str, np.ndarray]:
    if not len(rows):
        return {}
    at = {lang: i for i, lang in enumerate(langs)}
    keys, place = np.unique(rows[key].to_numpy(dtype=object), return_inverse=True)
    out = np.full((len(keys), len(langs)), math.log(FLOOR_SHARE), dtype=np.float32)
    out[place, rows["lang"].map(at).to_numpy()] = np.log(rows["share"].to_numpy())
    return dict(zip(keys.tolist(), out, strict=True))


def fit(docs: DataFrame) -> Model:
    """The model of all rows with a text and a language that aren't held out; columns doc_id, text, lang."""
    train = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    words = train.select("lang", "text").mapInArrow(_counted, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    words = cut(words)
    seen = sorted(r["lang"] for r in train.select("lang").distinct().collect())

    def frequent(counts: DataFrame, *keys: str) -> pd.DataFrame:
        totals = counts.groupBy(*keys).agg(F.sum("n").alias("total"))
        share = F.col("n") / F.col("total")
        return counts.join(F.broadcast(totals), list(keys)).withColumn("share", share).where(share >= LEAST_SHARE).drop("n", "total").toPandas()

    known = frequent(words, "lang")
    parts = words.mapInArrow(_grams_counted, "lang string, size int, gram string, n bigint").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n"))
    pieces = frequent(cut(parts), "lang", "size")
    return Model(seen, _table(known, "word", seen), {n: _table(pieces[pieces["size"] == n], "gram", seen) for n in LENGTHS})


def _predicted(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model = held.value
        langs = model.langs
        places = Places(model)
        for batch in tb.slices(batches, "text", SLICE):
            pred, scores = [], []
            for text in batch.column("text").to_pylist():
                raws = (text or "").lower().split()
                places.trim()
                at = np.fromiter(map(places.__getitem__, raws), dtype=np.int64, count=len(raws))
                total = sum((places.table[at[i : i + 65536]].sum(axis=0) for i in range(0, len(at), 65536)), np.zeros(len(langs) + 1))
                if not total[-1] or not langs:
                    pred.append("und")
                    scores.append(0.0)
                    continue
                total = total[:-1]
                best = int(np.argmax(total))
                pred.append(langs[best])
                scores.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(pred, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of ``docs``: doc_id, held_out, lang_pred, score (posterior of that language, all alike before the text)."""
    spark = docs.sparkSession
    rows = pick(docs, doc_id="bigint", text="string").withColumn("held_out", held_out(F.col("doc_id")))
    return rows.mapInArrow(_predicted(spark.sparkContext.broadcast(model)), "doc_id bigint, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame) -> DataFrame:
    """``predict`` for all of ``docs`` with a model fitted to those that aren't held out.

    Words are runs of letters, lower-cased. Null or empty text, or one without
    a letter, and any text if nothing could be learned: ``und``, score 0. Equal
    sums: the first language by name. Null doc_id: counts as an empty text for
    holding out. Repeated rows are learned and judged one by one. Empty table:
    no rows. Only doc_id, text and lang are read, lang for learning alone.
    """
    return predict(docs, fit(pick(docs, doc_id="bigint", text="string", lang="string")))
