"""Secret scans with corpus-wide ownership frequency.

DataFrame functions only. Patterns find candidates with their places; the hash
of each candidate is counted over distinct owners and the repositories they
own. A value that many owners hold is an example that was copied; one that a
single owner holds looks live. Counting goes in three steps that each
aggregate before the exchange, so that a value in a third of all texts stays a
handful of rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skiplane.llm.common import cut, join_spread, let, running

#: The patterns, the group that holds the secret, its least length. Order settles ties of start.
BASE = {
    "assign": (r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    "access": (r"AKIA[A-Z0-9]+", 0, 20),
    "hex": (r"[0-9a-f]{24,}", 0, 24),
}
#: What the method adds, if the value belongs to few owners: long runs of letters and digits that have both cases and a digit.
MORE = {"owned": (r"[A-Za-z0-9+/_-]{24,}", 0, 24)}
MIXED = (r"[0-9]", r"[a-z]", r"[A-Z]")
#: Owners of a value that still looks live, at most.
LIVE_OWNERS = 1
KINDS = (*BASE, *MORE)
#: What stands in for a secret in redacted texts.
REDACTED = "[REDACTED]"


SPANS = "array<struct<start: int, rank: int, end: int, hash: string, lo: int, hi: int>>"


#: Characters and bytes are added up as one number, characters times this.
PAIR = 1 << 32


def _size(text: Column) -> Column:
    return F.length(text).cast("bigint") * PAIR + F.octet_length(text)


def _found(text: Column, kind: str, pattern: str, group: int, least: int) -> Column:
    """Structs (start, rank, end, hash, lo, hi) of the leftmost matches that don't overlap and are long enough. Places are those of the whole match, start and end in characters, lo and hi in bytes: running sums over the pieces between the matches, and the matches."""

    def placed(whole: Column) -> Column:
        def of(pieces: Column) -> Column:
            steps = F.zip_with(F.slice(pieces, 1, F.size(whole)), whole, lambda p, m: F.struct(_size(p).alias("p"), _size(m).alias("m")))
            sums = running(F.transform(steps, lambda x: x["p"] + x["m"]), F.lit(0).cast("bigint"), lambda a, b: a + b)
            return F.zip_with(sums, steps, lambda s, x: F.struct((s + x["p"]).alias("from"), (s + x["p"] + x["m"]).alias("to")))

        values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        spans = F.zip_with(let(F.split(text, pattern, -1), of), values, lambda s, v: F.struct(s.alias("at"), v.alias("value")))
        chars, octets = lambda x: F.call_function("div", x, F.lit(PAIR)).cast("int"), lambda x: (x % PAIR).cast("int")
        fits = lambda v: reduce(lambda a, b: a & b, [F.length(v) >= least, *[v.rlike(p) for p in MIXED if kind in MORE]])
        return F.transform(F.filter(spans, lambda s: fits(s["value"])), lambda s: F.struct(chars(s["at"]["from"]).alias("start"), F.lit(KINDS.index(kind)).alias("rank"), chars(s["at"]["to"]).alias("end"), F.sha2(s["value"], 256).alias("hash"), octets(s["at"]["from"]).alias("lo"), octets(s["at"]["to"]).alias("hi")))

    return F.when(text.rlike(pattern), let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), placed)).otherwise(F.array().cast(SPANS))


def candidates(text: Column) -> Column:
    """All candidates of a text by start, then kind; null text: none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    return F.array_sort(F.concat(*[_found(text, kind, *rule) for kind, rule in (BASE | MORE).items()]))


def _column(docs: DataFrame, name: str) -> Column:
    return (F.col(f"`{name}`") if name in docs.columns else F.lit(None)).cast("string")


def ownership(rows: DataFrame) -> DataFrame:
    """Rows (hash, owner, repository) to (hash, owners, repositories, copies); a repository is one of its owner's, null is an owner like any other, copies are rows."""
    known = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("null"))
    each = rows.groupBy("hash", known("owner").alias("owner"), known("repository").alias("repository")).agg(F.count("*").alias("copies"))
    owned = each.groupBy("hash", "owner").agg(F.count("*").alias("n"), F.sum("copies").alias("copies"))
    return owned.groupBy("hash").agg(F.count("*").alias("owners"), F.sum("n").alias("repositories"), F.sum("copies").alias("copies"))


def _key(docs: DataFrame, owner: str, repository: str) -> tuple[Column, Column]:
    """doc_id, and a hash of what else the secrets of a row depend on."""
    return F.col("doc_id").cast("bigint"), F.xxhash64(_column(docs, "text"), _column(docs, owner), _column(docs, repository))


def _by_doc(docs: DataFrame, live_owners: int, owner: str, repository: str) -> DataFrame:
    """__doc, __mark, __secrets of the rows that have any."""
    doc, mark = _key(docs, owner, repository)
    rows = docs.select(doc.alias("__doc"), mark.alias("__mark"), _column(docs, owner).alias("owner"), _column(docs, repository).alias("repository"), candidates(_column(docs, "text")).alias("found"))
    rows = cut(rows.where(F.size("found") > 0))
    each = rows.select("__doc", "__mark", "owner", "repository", F.explode("found").alias("f"), F.col("f.hash").alias("hash"))
    of = lambda c: F.col(f"f.{c}").alias(c)
    secret = F.struct(of("start"), of("rank"), of("end"), "hash", "owners", "repositories", (F.col("owners") <= live_owners).alias("live"), of("lo"), of("hi"))
    judged = join_spread(each.select("__doc", "__mark", "hash", "f"), cut(ownership(each)), ["hash"], "copies")
    judged = judged.groupBy("__doc", "__mark").agg(F.array_sort(F.collect_set(secret)).alias("all"))
    return judged.select("__doc", "__mark", let(F.col("all"), _fitting).alias("__secrets")).where(F.size("__secrets") > 0)


def _fitting(secrets: Column) -> Column:
    """Of secrets by start, then kind: those of base kinds, and the live ones of others that no base span overlaps."""
    base, far = lambda s: s["rank"] < len(BASE), F.lit(2**31 - 1)
    before = running(F.transform(secrets, lambda s: F.when(base(s), s["end"]).otherwise(0)), F.lit(0), lambda a, b: F.greatest(a, b))
    after = F.reverse(running(F.reverse(F.transform(secrets, lambda s: F.when(base(s), s["start"]).otherwise(far))), far, lambda a, b: F.least(a, b)))
    return let(before, lambda b: let(after, lambda a: F.filter(secrets, lambda s, i: base(s) | (s["live"] & (F.get(b, i) <= s["start"]) & (F.get(a, i) >= s["end"])))))


def scan(docs: DataFrame, live_owners: int = LIVE_OWNERS, owner: str = "source", repository: str = "doc_id") -> DataFrame:
    """One row per row of ``docs``: doc_id, secrets: array of structs (start, rank, end, hash, owners, repositories, live, lo, hi) by start, then kind.

    rank is the place of the kind in KINDS; start and end are characters, lo and
    hi the same places in bytes, end and hi past the last. Candidates of the added kinds are there only if they are live:
    held by at most ``live_owners`` owners, and outside all base spans.

    Null and empty texts: no secrets. Null owner or repository: one like any
    other. Repeated rows: one repository, scanned one by one. Empty table: no
    rows. Extra columns are ignored.
    """
    found = _by_doc(docs, live_owners, owner, repository)
    doc, mark = _key(docs, owner, repository)
    keys = docs.select(doc.alias("doc_id"), mark.alias("mark"))
    held = keys.join(found, keys["doc_id"].eqNullSafe(found["__doc"]) & (keys["mark"] == found["__mark"]), "left")
    return held.select("doc_id", F.coalesce("__secrets", F.array().cast(found.schema["__secrets"].dataType)).alias("secrets"))


def redact(docs: DataFrame, live_owners: int = LIVE_OWNERS, owner: str = "source", repository: str = "doc_id", length: str = "n_chars") -> DataFrame:
    """All rows of ``docs``, with secrets in the text replaced by ``REDACTED`` and the column ``length``, if there is one, counted anew.

    Base spans go whether live or copied, since either may be a credential;
    added spans go if live. Spans that overlap are replaced as one.
    """
    found = _by_doc(docs, live_owners, owner, repository)
    doc, mark = _key(docs, owner, repository)
    held = docs.join(found, doc.eqNullSafe(found["__doc"]) & (mark == found["__mark"]), "left").drop("__doc", "__mark")

    def cleaned(raw: Column) -> Column:
        def of(ends: Column) -> Column:
            def piece(s: Column, i: Column) -> Column:
                at = F.get(ends, i)
                return F.when(s["lo"] >= at, F.concat(F.substring(raw, at + 1, s["lo"] - at).cast("string"), F.lit(REDACTED))).otherwise(F.lit(""))

            last = F.array_max(F.transform("__secrets", lambda s: s["hi"]))
            return F.concat(F.array_join(F.transform("__secrets", piece), ""), F.substring(raw, last + 1, F.octet_length(raw)).cast("string"))

        return let(running(F.transform("__secrets", lambda s: s["hi"]), F.lit(0), lambda a, b: F.greatest(a, b)), of)

    held = held.withColumn("__clean", F.when(F.col("__secrets").isNotNull(), let(F.col("text").cast("string").cast("binary"), cleaned)))
    new = {"text": F.coalesce("__clean", "text")}
    if length in docs.columns:
        new[length] = F.coalesce(F.length("__clean").cast(docs.schema[length].dataType), F.col(f"`{length}`"))
    for name, value in new.items():
        held = held.withColumn(name, value)
    return held.select(*[F.col(f"`{c}`") for c in docs.columns])


def digest(secrets: Column, kinds: int) -> Column:
    """kind:start:end of the first ``kinds`` kinds, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    of = F.filter(secrets, lambda s: s["rank"] < kinds)
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", F.get(names, s["rank"]), s["start"].cast("string"), s["end"].cast("string"))), ",")
