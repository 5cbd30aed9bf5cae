"""Removing repeated runs of lines found by winnowing. DataFrame operations only.

Every line is hashed; in each window of ``run`` lines the least hash, the last one of equals, is the
window's fingerprint. Equal windows have equal fingerprints at the same place, so a run of at least
``run`` lines that occurs twice cannot be missed, and fingerprints that occur once rule out most
windows at once. The positions of the others are joined by fingerprint; around each the
match is extended to both sides as far as a window reaches, by the digest of the window's lines, and
chained windows make up the whole run however long it is.

With ``words`` a window is no number of lines but as many as hold that many words: from each line the
fewest that reach them, and up to each line the fewest. A long line is a window of its own, of short ones
several are needed, and any run of lines of at least ``words`` words that occurs twice is covered whole
by such windows. Lines without a word take no part in the match and stay.

A window's first occurrence, by document id and line, stays; the lines of its later ones go.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rankloom.llm.common import attach, free_name, stored, text_of

RUN = 2
#: The least length of a passage that counts as repeated, in words.
WORDS = 50


def _windows(docs: DataFrame, id: str, text: str, run: int) -> DataFrame:
    """(doc_id, own, at, places, fingerprint, digest) of every window of ``run`` lines; ``places`` are its lines, ``at`` the first."""
    lines = docs.filter(F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").alias("doc_id"), F.xxhash64(text_of(text)).alias("own"), F.split(text_of(text), "\n").alias("lines")
    )
    hashed = lines.withColumn("h", F.transform("lines", lambda x: F.xxhash64(x))).filter(F.size("lines") >= run)
    at = F.sequence(F.lit(0), F.size("lines") - F.lit(run))
    windows = F.transform(
        at,
        lambda i: F.struct(
            i.alias("at"),
            F.sequence(i, i + F.lit(run - 1)).alias("places"),
            F.array_min(F.slice("h", i + 1, F.lit(run))).alias("fingerprint"),
            # joined by a character that no line holds
            F.unhex(F.sha2(F.array_join(F.slice("lines", i + 1, F.lit(run)), "\n"), 256)).alias("digest"),
        ),
    )
    return hashed.select("doc_id", "own", F.inline(windows))


def _windows_of_words(docs: DataFrame, id: str, text: str, words: int) -> DataFrame:
    """(doc_id, own, at, places, fingerprint, digest) of every least window of ``words`` words, from each line and up to each line."""
    texts = docs.filter(F.col(f"`{id}`").isNotNull()).select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("t")).distinct()
    lines = texts.select("doc_id", F.xxhash64("t").alias("own"), F.posexplode(F.split("t", "\n")).alias("at", "line"))
    lines = lines.withColumn("n", F.size(F.regexp_extract_all("line", F.lit(r"\S+"), 0)).cast("bigint")).filter("n > 0")
    whole = Window.partitionBy("doc_id", "own")
    upto = F.sum("n").over(whole.orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow))
    # words up to a line and before it: both grow with every line, so a range of them is a range of lines
    lines = lines.withColumn("upto", upto).withColumn("before", F.col("upto") - F.col("n")).withColumn("h", F.xxhash64("line"))

    def windows(frame) -> DataFrame:
        found = lines.select(
            "doc_id", "own", F.min("at").over(frame).alias("at"), F.collect_list("at").over(frame).alias("places"), F.sum("n").over(frame).alias("held"),
            F.min("h").over(frame).alias("fingerprint"), F.collect_list("line").over(frame).alias("lines"),
        ).filter(F.col("held") >= words)
        # joined by a character that no line holds
        return found.select("doc_id", "own", "at", "places", "fingerprint", F.unhex(F.sha2(F.array_join("lines", "\n"), 256)).alias("digest"))

    return windows(whole.orderBy("before").rangeBetween(Window.currentRow, words - 1)).union(
        windows(whole.orderBy("upto").rangeBetween(1 - words, Window.currentRow))
    )


def repeated_runs(docs: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = None) -> DataFrame:
    """(doc_id, own, at, places, first_doc, first_at): every window of ``run`` lines, or of ``words`` words, that an earlier place holds too.

    The earlier place is the first in the corpus by id and line (0-based). Rows that repeat an id and its
    text are one document; with another text (``own`` is the text's hash) they are another one, ordered by
    that hash. Rows without an id take no part.
    """
    windows = _windows(docs, id, text, run) if words is None else _windows_of_words(docs, id, text, words)
    windows = stored(windows.distinct(), "line-windows")
    prints = stored(
        windows.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-fingerprints"
    )
    total = prints.agg(F.sum("n")).first()[0] or 0
    matched = stored(attach(windows, prints, "fingerprint", "n", total).drop("n"), "matched-windows")
    first = stored(
        matched.groupBy("digest").agg(F.min(F.struct("doc_id", "own", "at")).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1"),
        "first-windows",
    )
    total = first.agg(F.sum("n")).first()[0] or 0
    return attach(matched, first, "digest", "n", total).filter(
        F.struct("doc_id", "own", "at") != F.col("first")
    ).select("doc_id", "own", "at", "places", F.col("first.doc_id").alias("first_doc"), F.col("first.at").alias("first_at"))


def without_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", run: int = RUN, words: int | None = None, removed: str | None = None
) -> DataFrame:
    """``docs`` with the lines of later repeated runs deleted from ``text``; no other column changes.

    ``removed`` names a column to add: how many lines went; underscores go before a name that is taken. A text whose lines all go becomes empty; null
    stays null. Texts of fewer than ``run`` lines, or ``words`` words where given, stay. No rows give no rows.
    """
    found = repeated_runs(docs, id=id, text=text, run=run, words=words)
    gone, key, of = (free_name(docs.columns, n) for n in ("_gone", "_key", "_of"))
    # at most one entry per line of a document
    lines = F.array_distinct(F.flatten(F.collect_list("places")))
    by_doc = found.groupBy(F.col("doc_id").alias(key), F.col("own").alias(of)).agg(lines.alias(gone))
    by_doc = stored(by_doc, "lines-to-delete")
    # always by a sort-merge join: deletions grow with the texts, and the plan (and its disk) is alike at every size
    joined = docs.join(by_doc.hint("merge"), (docs[id] == by_doc[key]) & (F.xxhash64(text_of(text)) == by_doc[of]), "left")
    column = F.col(f"`{text}`")
    kept = F.array_join(F.transform(
        F.filter(
            F.transform(F.split(column, "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: ~_contains(F.col(gone), s["i"])
        ),
        lambda s: s["x"],
    ), "\n")
    out = [F.when(F.col(gone).isNull(), column).otherwise(kept).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns]
    extra = [F.coalesce(F.size(gone), F.lit(0)).cast("bigint").alias(free_name(docs.columns, removed))] if removed else []
    return joined.select(*out, *extra)


def _contains(places: Column, i: Column) -> Column:
    return F.array_contains(places, i)
