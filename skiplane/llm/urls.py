"""URL filters: rules first; where none fits, host word segmentation and naive Bayes.

A host label is a concatenation of words. A unigram model of the pages' own
words splits it by Viterbi search, and a multinomial naive Bayes model over
hashed tokens of host and path scores the url. What it learns from is not the
url but the page: one whose text holds a word of the seed list counts as to
block, any other as to allow. So a seed word in a url is no verdict by itself,
and hosts that share words with pages of that kind are blocked without one.
A page's own url and text are left out of the counts that it is scored by.

The unigram model keeps words of a share of ``LEAST_SHARE`` or more, at most
1 / LEAST_SHARE of them; the Bayes model has ``FEATURES`` numbers a class.
Both bounds hold whatever the corpus.
"""

from __future__ import annotations

import math
import re
import zlib
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiplane.llm.common import ascii_lower, cut, pick

#: Words that mark a page's text as to block while the model is trained.
SEEDS = ("adult", "bet", "bets", "casino", "cheap", "crack", "escort", "farm", "gambling", "pills", "poker", "porn", "sex", "slots", "spam", "torrent", "viagra", "warez", "xxx")
LEAST_SHARE = 2e-6
LONGEST = 24
FEATURES = 1 << 18
#: Entries that a task remembers or gathers.
GATHERED = 200_000
TAG = re.compile(r"<(script|style)\b.*?</\1\s*>|<[^>]*>", re.S | re.I)
WORD = re.compile(r"[^\W\d_]+")


def parts(url: Column) -> tuple[Column, Column]:
    """Host (after the first ``://`` up to /, ?, # or the end, A-Z lower-cased) and path (from there up to ?, # or the end); both empty without ``://``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url)))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def fitting_rule(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest of the rules (text, verdict) that fits, and its verdict. A rule ``name/rest`` fits the host ``name``, and its subdomains, if the path starts with ``/rest``."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):  # later ones stand before the others
        name, slash, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def text_words(html: str | None) -> list[str]:
    return WORD.findall(TAG.sub(" ", html).lower()) if html else []


def _words_of(rows: Iterator[tuple[str | None, str, str]], add) -> None:
    for html, host, path in rows:
        add(text_words(html))
        add(w for label in host.split(".") if "-" in label for w in WORD.findall(label))
        add(WORD.findall(path.lower()))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: Counter = Counter()
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in ("html", "host", "path")), strict=True):
            _words_of([row], held.update)
            if len(held) > GATHERED:
                yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])
                held.clear()
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], names=["word", "n"])


class Splitter:
    """Viterbi search for the likeliest words of a run of letters. An unknown word of n letters counts as a tenth of the share of one word, and a tenth less for each letter more."""

    def __init__(self, counts: dict[str, int]):
        self.total = sum(counts.values()) or 1
        self.log = {w: math.log(n / self.total) for w, n in counts.items()}
        self.held: dict[str, list[str]] = {}

    def cost(self, word: str) -> float:
        return self.log.get(word) or (0.0 if word in self.log else -math.log(self.total) - (len(word) - 1) * math.log(10) - math.log(10))

    def __call__(self, letters: str) -> list[str]:
        if letters in self.held:
            return self.held[letters]
        best, last = [0.0], [0]
        for j in range(1, len(letters) + 1):
            score, i = max((best[i] + self.cost(letters[i:j]), i) for i in range(max(0, j - LONGEST), j))
            best.append(score)
            last.append(i)
        out, j = [], len(letters)
        while j:
            out.append(letters[last[j] : j])
            j = last[j]
        if len(self.held) > GATHERED:
            self.held.clear()
        self.held[letters] = out[::-1]
        return out[::-1]


def tokens(host: str, path: str, split: Splitter) -> list[str]:
    """Words of the host's labels and of the path, each marked with where it stands."""
    return [f"h:{w}" for run in WORD.findall(host) for w in split(run)] + [f"p:{w}" for w in WORD.findall(path.lower())]


def feature(token: str) -> int:
    return zlib.crc32(token.encode()) % FEATURES


def _sided(seeds: frozenset[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            side = [int(not seeds.isdisjoint(text_words(html))) for html in batch.column("html").to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), pa.array(side, pa.int8())], names=["page_id", "host", "path", "side"])

    return run


def _classed(held):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split = Splitter(held.value)
        counts, rows = np.zeros((2, FEATURES), dtype=np.int64), np.zeros(2, dtype=np.int64)
        for batch in batches:
            for host, path, side in zip(*(batch.column(c).to_pylist() for c in ("host", "path", "side")), strict=True):
                rows[side] += 1
                for t in tokens(host, path, split):
                    counts[side, feature(t)] += 1
        at = np.flatnonzero(counts.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1).astype(np.int32)), pa.array(np.append(counts[0, at], rows[0])), pa.array(np.append(counts[1, at], rows[1]))], names=["at", "allow", "block"])

    return run


class Bayes:
    """Counts of features and of pages by class, allow and block, with one added to each."""

    def __init__(self, counts: np.ndarray, pages: Sequence[int]):
        self.counts, self.pages = counts.astype(np.int64), pages
        self.totals = [int(c.sum()) for c in self.counts]
        self.kinds = int((self.counts.sum(axis=0) > 0).sum())

    def score(self, found: list[str], side: int | None = None) -> float:
        """Logarithm of the odds that the url is to be blocked. ``side``: the class under which these tokens were counted; they are left out."""
        own = Counter(map(feature, found))
        out, whole = [], []
        for k in range(2):
            left = k == side
            out.append(math.log(self.pages[k] - left + 1))
            whole.append(math.log(self.totals[k] - left * len(found) + self.kinds + 1))
        odds = out[1] - out[0]
        for f, n in own.items():
            allow, block = (int(self.counts[k, f]) - n * (k == side) for k in range(2))
            if allow + block > 0:  # a token that no other page has tells nothing
                odds += n * (math.log(block + 1) - whole[1] - math.log(allow + 1) + whole[0])
        return odds


def _scored(lexicon, model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        split, bayes = Splitter(lexicon.value), model.value
        for batch in batches:
            rows = list(zip(*(batch.column(c).to_pylist() for c in ("host", "path", "side")), strict=True))
            found = [tokens(h, p, split) for h, p, _ in rows]
            more = [pa.array(found, pa.list_(pa.string())), pa.array([bayes.score(f, side) for f, (_, _, side) in zip(found, rows, strict=True)], pa.float64())]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("page_id", "host", "path")), *more], names=["page_id", "host", "path", "tokens", "block_odds"])

    return run


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], seeds: Sequence[str] = SEEDS) -> DataFrame:
    """One row per row of ``pages``: page_id, host, path, rule, verdict (allow or block), tokens, block_odds (logarithm).

    verdict is that of the longest rule that fits; without one, block if the
    odds are above 1, else allow. Null url, or one without ``://``: empty host
    and path, judged by the prior alone. Null html: no words, counts as to allow. Repeated rows
    count and are judged one by one. Empty table: no rows. Only page_id, url
    and html are read; extra columns are ignored.
    """
    spark = pages.sparkSession
    rows = pick(pages, page_id="bigint", url="string", html="string")
    host, path = parts(F.col("url"))
    rows = rows.select("page_id", "html", host.alias("host"), path.alias("path"))
    words = cut(rows.select("html", "host", "path").mapInArrow(_counted, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")))
    total = words.agg(F.sum("n")).first()[0] or 1
    frequent = words.where((F.col("n") >= LEAST_SHARE * total) & (F.length("word") <= LONGEST)).collect()  # 1 / LEAST_SHARE rows at most
    lexicon = spark.sparkContext.broadcast({s: 1 for s in seeds} | {r["word"]: r["n"] for r in frequent})
    keys = cut(rows.mapInArrow(_sided(frozenset(seeds)), "page_id bigint, host string, path string, side tinyint"))
    sides = keys.mapInArrow(_classed(lexicon), "at int, allow bigint, block bigint").groupBy("at").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")).toPandas()  # FEATURES + 1 rows at most
    counts, n = np.zeros((2, FEATURES), dtype=np.int64), (0, 0)
    for at, allow, block in sides.itertuples(index=False):
        if at < 0:
            n = (int(allow), int(block))
        else:
            counts[:, at] = allow, block
    model = spark.sparkContext.broadcast(Bayes(counts, n))
    scored = keys.mapInArrow(_scored(lexicon, model), "page_id bigint, host string, path string, tokens array<string>, block_odds double")
    rule, says = fitting_rule(F.col("host"), F.col("path"), rules)
    verdict = F.coalesce(says, F.when(F.col("block_odds") > 0, F.lit("block")).otherwise(F.lit("allow")))
    return scored.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("verdict"), "tokens", "block_odds")
