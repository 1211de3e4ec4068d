"""Quality rules with adaptive thresholds from mergeable quantile sketches, per language and source.

DataFrame functions only. The sketch is a log-linear histogram (DDSketch and
HdrHistogram have this form): a non-negative integer falls into one of 32
equal bins of its power of two, so a quantile is off by 1/32 of its value at
most, whatever the distribution. Sketches merge by adding counts, exactly and
in any order; a group's sketch, its language's and the whole table's are sums
over the same counts, and the result doesn't depend on partitions or retries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from skiplane.llm.common import cut, join_spread, let

#: Bins of one power of two, as bits.
BITS = 5
#: Rules, in thousandths: name and whether too low also counts.
RULES = {"symbols": False, "dup_lines": False, "repeats": False, "word_length": True}
#: A group needs so many documents for thresholds of its own; else its language's hold, then the whole table's.
LEAST_DOCS = 200
#: Tukey's fence: so many interquartile ranges beyond the outer quartiles.
FENCE = 6.0
#: Room beyond the fence, in thousandths. A metric that is 0 in three documents of four has no spread, and this is all that its fence is.
SLACK = {"symbols": 50, "dup_lines": 100, "repeats": 150, "word_length": 1500}
BLANK = r"[\x20\x09-\x0D]+"


def word_list(text: Column) -> Column:
    """Runs of characters outside [\\x20\\x09-\\x0D]."""
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def repeated_words(words: Column) -> Column:
    """How many words lie in a window of three words that occurs twice or more.

    Windows are sorted by hash, words and place; neighbours that are equal mark
    each other, and the marked places, in order, cover up to three words each.
    """

    def of(w: Column) -> Column:
        def window(i: Column) -> Column:
            a, b, c = (F.get(w, i + k) for k in range(3))
            return F.struct(F.xxhash64(a, b, c).alias("h"), a.alias("a"), b.alias("b"), c.alias("c"), i.alias("p"))

        def alike(x: Column, y: Column) -> Column:
            return (x["h"] == y["h"]) & (x["a"] == y["a"]) & (x["b"] == y["b"]) & (x["c"] == y["c"])

        windows = F.array_sort(F.transform(F.sequence(F.lit(0), F.size(w) - 3), window))

        def marked(s: Column) -> Column:
            near = lambda x, i: F.coalesce(alike(x, F.get(s, i - 1)), F.lit(False)) | F.coalesce(alike(x, F.get(s, i + 1)), F.lit(False))
            return F.array_sort(F.transform(F.filter(s, near), lambda x: x["p"]))

        def covered(p: Column) -> Column:
            return F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(p, i + 1) - x, F.lit(3)))), F.lit(0), lambda n, x: n + x)

        return F.when(F.size(w) < 4, 0).otherwise(let(let(windows, marked), covered))

    return let(words, of)


def _described(docs: DataFrame, text: str) -> DataFrame:
    """``docs`` with the base counts in columns that start with two underscores."""
    t = F.coalesce(F.col(text).cast("string"), F.lit(""))
    lines = F.filter(F.split(t, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def counted(w: Column) -> Column:
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.aggregate(w, F.lit(0).cast("bigint"), lambda n, x: n + F.length(x)).alias("word_chars"),
            F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("bigint").alias("n_symbols"),
            let(lines, lambda x: (F.size(x) - F.size(F.array_distinct(x))).cast("bigint")).alias("n_dup_lines"),
            let(lines, F.size).cast("bigint").alias("n_lines"),
            repeated_words(w).cast("bigint").alias("n_repeat_words"),
        )

    return docs.withColumn("__base", let(word_list(t), counted))


def bin_of(value: Column) -> Column:
    """Bin of a non-negative long: exact below 2**(BITS + 1), then 2**BITS bins a power of two."""
    extra = F.greatest(F.length(F.bin(value)) - (BITS + 1), F.lit(0)).cast("int")
    return extra.cast("bigint") * (1 << BITS) + F.call_function("shiftright", value, extra)


def bin_floor(index: Column) -> Column:
    """The least value of a bin."""
    extra = F.greatest(F.shiftright(index, BITS) - 1, F.lit(0)).cast("int")
    return F.call_function("shiftleft", index - extra.cast("bigint") * (1 << BITS), extra)


def _metrics(base: Column) -> dict[str, Column]:
    """In thousandths: symbols a character, repeated lines beyond one a line, words in repeated windows a word, characters a word."""
    words, chars = F.greatest(base["n_words"], F.lit(1)), F.greatest(base["word_chars"], F.lit(1))
    per = lambda a, b: F.call_function("div", a * 1000, b)
    return {"symbols": per(base["n_symbols"], chars), "dup_lines": per(F.greatest(base["n_dup_lines"] - 1, F.lit(0)), F.greatest(base["n_lines"], F.lit(1))), "repeats": per(base["n_repeat_words"], words), "word_length": per(base["word_chars"], words)}


def thresholds(rows: DataFrame, least_docs: int, fence: float) -> DataFrame:
    """Rows (lang, source, metrics, none base_failed) to one row a (lang, source): low and high bounds of each metric, and the level they come from."""
    long = rows.select("lang", "source", F.explode(F.array(*[F.struct(F.lit(name).alias("rule"), bin_of(F.col(name)).alias("bin")) for name in RULES])).alias("x"))
    sketch = long.groupBy("lang", "source", F.col("x.rule").alias("rule"), F.col("x.bin").alias("bin")).agg(F.count("*").alias("n"))
    levels = [("group", ["lang", "source"]), ("lang", ["lang"]), ("all", [])]
    out = None
    for level, keys in levels:
        merged = sketch.groupBy(*keys, "rule", "bin").agg(F.sum("n").alias("n"))
        part = Window.partitionBy(*keys, "rule")
        ranked = merged.select("*", F.sum("n").over(part.orderBy("bin")).alias("up_to"), F.sum("n").over(part).alias("docs"))
        at = lambda q: F.min(F.when(F.col("up_to") * 4 >= F.col("docs") * q, F.col("bin")))
        quartiles = ranked.groupBy(*keys, "rule").agg(F.max("docs").alias("docs"), at(1).alias("q1"), at(3).alias("q3"))
        spread = F.lit(fence) * (bin_floor(F.col("q3")) - bin_floor(F.col("q1")))
        slack = F.element_at(F.create_map(*[F.lit(x) for pair in SLACK.items() for x in pair]), F.col("rule"))
        bounds = quartiles.select(*keys, "rule", "docs", (bin_floor(F.col("q1")) - spread - slack).alias("low"), (bin_floor(F.col("q3") + 1) + spread + slack).alias("high"))
        pivot = bounds.groupBy(*keys).agg(F.max("docs").alias(f"docs_{level}"), *[F.max(F.when(F.col("rule") == r, F.col(side))).alias(f"{side}_{r}_{level}") for r in RULES for side in ("low", "high")])
        if out is None:
            out = pivot
        elif keys:
            out = out.join(pivot, keys)
        else:
            out = out.join(F.broadcast(pivot), F.lit(True))  # one row
    own, lang = F.col("docs_group") >= least_docs, F.col("docs_lang") >= least_docs
    pick_ = lambda name: F.when(own, F.col(f"{name}_group")).when(lang, F.col(f"{name}_lang")).otherwise(F.col(f"{name}_all"))
    level = F.when(own, "group").when(lang, "lang").otherwise("all")
    return out.select("lang", "source", level.alias("level"), *[pick_(f"{side}_{r}").alias(f"{side}_{r}") for r in RULES for side in ("low", "high")])


def _mark(docs: DataFrame, text: str, lang: str, source: str) -> Column:
    """Names what a verdict depends on besides the thresholds; a column that is missing counts as null."""
    return F.xxhash64(*[(F.col(f"`{c}`") if c in docs.columns else F.lit(None)).cast("string") for c in (text, lang, source)])


def _measured(docs: DataFrame, text: str, lang: str, source: str) -> DataFrame:
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(f"`{c}`").cast("string")), F.lit("null")) if c in docs.columns else F.lit("null")
    rows = _described(docs, text).select(F.col("doc_id").cast("bigint").alias("doc_id"), _mark(docs, text, lang, source).alias("mark"), group(lang).alias("lang"), group(source).alias("source"), F.col("__base").alias("base"))
    b = F.col("base")
    failed = (b["n_words"] < 50) | (100 * b["n_repeat_words"] > 50 * b["n_words"])
    return cut(rows.select("*", failed.alias("base_failed"), *[c.alias(n) for n, c in _metrics(b).items()]))


def quality_rules(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, fence: float = FENCE) -> DataFrame:
    """One row per row of ``docs``: doc_id, the base counts, base_failed, kept, the metrics, the level of the thresholds, and broken (names of the rules that it breaks).

    Base: n_words (runs of non-blank characters), word_chars, n_symbols,
    n_dup_lines (lines with a word that equal an earlier one), n_repeat_words
    (words in 3-word windows that occur twice or more). base_failed: fewer than
    50 words, or more than half of them in repeated windows. Thresholds are
    Tukey fences of each metric over the documents of one language and source
    that don't fail the base rules.

    Null text: as if empty. Null language or source: a group of its own. A
    group with no document that passes the base rules has none to judge.
    Repeated rows count and are judged one by one. Empty table: no rows.
    """
    rows = _judged(_measured(docs, text, lang, source), least_docs, fence)
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    return rows.select("doc_id", *[F.col("base")[n].alias(n) for n in counts], "base_failed", "kept", *RULES, "level", "broken")


def _judged(rows: DataFrame, least_docs: int, fence: float) -> DataFrame:
    bounds = thresholds(rows.where("NOT base_failed"), least_docs, fence)
    sizes = rows.groupBy("lang", "source").agg(F.count("*").alias("size"))
    judged = join_spread(rows, cut(sizes.join(bounds, ["lang", "source"], "left")), ["lang", "source"], "size")
    broken = [F.when((F.col(r) > F.col(f"high_{r}")) | (F.lit(low) & (F.col(r) < F.col(f"low_{r}"))), F.lit(r)) for r, low in RULES.items()]
    judged = judged.withColumn("broken", F.array_compact(F.array(*broken)))
    return judged.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def drop_low_quality(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least_docs: int = LEAST_DOCS, fence: float = FENCE) -> DataFrame:
    """The rows of ``docs`` that ``quality_rules`` keeps, all columns as they are.

    Rejected rows are found by doc_id and a hash of text, language and source,
    on which alone a verdict depends. Null and empty texts fail the base rules
    and go; repeated rows go or stay alike. Empty table: no rows.
    """
    gone = _judged(_measured(docs, text, lang, source), least_docs, fence).where("NOT kept").select(F.col("doc_id").alias("__gone"), F.col("mark").alias("__mark")).distinct()
    same = docs["doc_id"].cast("bigint").eqNullSafe(gone["__gone"]) & (_mark(docs, text, lang, source) == gone["__mark"])
    return docs.join(gone, same, "left_anti")
