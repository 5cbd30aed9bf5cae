"""Repeated passages by FM-indexes that hold what may repeat, one index per shard.

1. Texts with the same words are one text, standing at the smallest id; only that one is searched.
2. Every window of ``window`` words has an anchor, the least hash of its runs of ANCHOR words, the first
   of them on a tie. Windows in a row with their anchor at one place form a piece. Equal windows have
   equal anchors equally far in, so an anchor that one piece alone has proves all its windows unique, and all occurrences of a window meet in the shard of their anchor.
3. Equal pieces are one class, standing at its first occurrence; the others are repeats as a whole.
   Pieces of an anchor with more than HOT of them are cut into single windows, dealt by their words.
4. A shard's classes are indexed (``fm_index``) and streamed through it: backward search gives the
   matching statistics, and where a match has a whole window, its interval's first occurrence.
   Windows that also occur before their own place are reported as intervals of words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import attach, stored, text_of
from rankloom.llm.fm_index import FmIndex
from rankloom.llm.shingles import _mix, word_hashes
from rankloom.operators.skew import sent_if_small

WINDOW = 20
ANCHOR = 6  # words whose hash is an anchor
HOT = 4096  # pieces of one anchor above which they are cut into windows
SHARD = 1_000_000  # words of one index at most, on average; every core has one at least
EMPTY = hashlib.sha256(b"").hexdigest()
_U = np.uint64


def _least(values: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """The least of each ``size`` neighbours and where it is first."""
    out, at, have = values, np.arange(len(values), dtype=np.int32), 1
    while have < size:
        step = min(have, size - have)
        right = out[step:] < out[:-step]
        out, at = np.where(right, out[step:], out[:-step]), np.where(right, at[step:], at[:-step])
        have += step
    return out, at


def pieces_of(raw: bytes, window: int, anchor: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(anchors, first words, numbers of windows) of the pieces of one text."""
    w = word_hashes(np.frombuffer(raw, np.uint8), lower=False)
    if len(w) < window:
        return np.empty(0, np.int64), np.empty(0, np.int32), np.empty(0, np.int32)
    g = np.zeros(len(w) - anchor + 1, _U)
    for k in range(anchor):
        g = g * _U(0x9E3779B97F4A7C15) + w[k : len(w) - anchor + 1 + k]
    least, where = _least(_mix(g), window - anchor + 1)
    # by place, not by value: so no window occurs twice in one piece
    start = np.concatenate(([0], np.flatnonzero(np.diff(where)) + 1))
    size = np.diff(np.concatenate((start, [len(where)])))
    return least[start].view(np.int64), start.astype(np.int32), size.astype(np.int32)


def _bytes(column: pa.Array) -> Iterator[bytes]:
    for x in column.cast(pa.large_binary()):
        yield x.as_py()


def _words(docs: DataFrame, id_type: T.DataType) -> DataFrame:
    """(doc_id, n_words, sha): words and SHA-256 of the words joined by spaces."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            for raw in _bytes(batch.column(1)):
                words = raw.split()  # at bytes 20 and 09 to 0D
                n.append(len(words))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(sha, pa.binary())], ["doc_id", "n_words", "sha"])

    return docs.select("doc_id", "t").mapInArrow(run, T.StructType([T.StructField("doc_id", id_type), T.StructField("n_words", T.LongType()), T.StructField("sha", T.BinaryType())]))


def _pieces(docs: DataFrame, id_type: T.DataType, window: int, anchor: int) -> DataFrame:
    """(doc_id, part, pieces): the pieces of each text as arrays (anchors, starts, sizes)."""
    longs, ints = T.ArrayType(T.LongType(), False), T.ArrayType(T.IntegerType(), False)
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.LongType()), T.StructField("anchors", longs), T.StructField("starts", ints), T.StructField("sizes", ints)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 1024):
                own = batch.slice(lo, 1024)
                found = [pieces_of(raw, window, anchor) for raw in _bytes(own.column(2))]
                ends = pa.array(np.cumsum([0, *(len(a) for a, _, _ in found)]), pa.int32())
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(c))) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(1), *lists], schema.names)

    return docs.select("doc_id", "part", "t").mapInArrow(run, schema)


def _cut(docs: DataFrame, id_type: T.DataType, window: int) -> DataFrame:
    """(route, piece, doc_id, part, start, size) of the listed pieces; hot ones window by window."""
    schema = T.StructType(
        [T.StructField("route", T.LongType()), T.StructField("piece", T.BinaryType()), T.StructField("doc_id", id_type), T.StructField("part", T.LongType()), T.StructField("start", T.IntegerType()), T.StructField("size", T.IntegerType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, parts, texts, lists = (batch.column(k) for k in range(4))
            route, piece, row, start, size = [], [], [], [], []

            def full() -> pa.RecordBatch:
                at = pa.array(row, pa.int64())
                return pa.RecordBatch.from_arrays(
                    [pa.array(route, pa.int64()), pa.array(piece, pa.binary()), ids.take(at), parts.take(at), pa.array(start, pa.int32()), pa.array(size, pa.int32())], schema.names
                )

            for k, raw in enumerate(_bytes(texts)):
                words = raw.split()
                for x in lists[k].as_py():
                    whole = [(x["start"], x["size"])] if not x["hot"] else [(x["start"] + j, 1) for j in range(x["size"])]
                    for s, n in whole:
                        text = b" ".join(words[s : s + n + window - 1])
                        route.append(int.from_bytes(hashlib.blake2b(text, digest_size=8).digest(), "little", signed=True) if x["hot"] else x["anchor"])
                        piece.append(text)
                        row.append(k)
                        start.append(s)
                        size.append(n)
                if len(row) > 50_000:
                    yield full()
                    route, piece, row, start, size = [], [], [], [], []
            yield full()

    return docs.select("doc_id", "part", "t", "found").mapInArrow(run, schema)


def earlier_windows(table: pa.Table, window: int) -> pa.Table:
    """The windows of a shard's classes that also occur at an earlier place, as intervals of words.

    ``table``: piece, doc (ranks of the documents in their order), start, size.
    """
    lists = pc.split_pattern(table.column("piece").combine_chunks().cast(pa.large_binary()).cast(pa.large_string()), " ")
    coded = pc.list_flatten(lists).dictionary_encode()
    sizes = pc.list_value_length(lists).to_numpy().astype(np.int64)
    codes = coded.indices.to_numpy().astype(np.int64) + 1
    text = np.zeros(len(codes) + len(sizes), np.int64)  # a 0 after every piece
    ends = np.cumsum(sizes + 1) - 1
    inside = np.ones(len(text), bool)
    inside[ends] = False
    text[inside] = codes
    doc, start = table.column("doc").to_numpy().astype(np.int64), table.column("start").to_numpy().astype(np.int64)
    own = np.arange(len(text)) + np.repeat(start - (ends - sizes), sizes + 1)
    place = (np.repeat(doc, sizes + 1) << 40) + own  # order of all places; a text has under 2**40 words
    index = FmIndex(text, window + 1)
    repeated = np.zeros(len(text), bool)
    firsts = np.concatenate((np.flatnonzero(index.lcp < window), [])).astype(np.int64)
    least = np.minimum.reduceat(place[index.sa], firsts)
    for _, at, length, low, _ in index.matching(text, ends, sizes, window):
        hit = length >= window
        group = np.searchsorted(firsts, low[hit], "right") - 1
        repeated[at[hit]] = least[group] < place[at[hit]]
    edge = np.diff(np.concatenate(([False], repeated, [False])).astype(np.int8))
    a, b = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)  # a 0 parts the pieces, so no run goes over
    row = np.searchsorted(ends, a, "left")
    return pa.table({"row": pa.array(row), "from": pa.array(own[a]), "to": pa.array(own[b - 1] + window)})


def _searched(classes: DataFrame, id_type: T.DataType, window: int, shard: int) -> DataFrame:
    """(doc_id, part, from, to): covered words of the first occurrences of all classes."""
    words = classes.agg(F.sum(F.col("size") + window - 1)).first()[0] or 0
    shards = max(-(-words // shard), int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([T.StructField("doc_id", id_type), T.StructField("part", T.LongType()), T.StructField("from", T.LongType()), T.StructField("to", T.LongType())])

    def run(table: pa.Table) -> pa.Table:
        order = pa.table({"i": table.column("doc_id"), "p": table.column("part")})
        ranked = pc.sort_indices(order, sort_keys=[("i", "ascending"), ("p", "ascending")]).to_numpy()
        i, p = order.column("i").take(ranked).combine_chunks(), order.column("p").take(ranked).to_numpy()
        new = np.concatenate(([0], (pc.not_equal(i[1:], i[:-1]).to_numpy(zero_copy_only=False) | (np.diff(p) != 0))))
        doc = np.empty(len(ranked), np.int64)
        doc[ranked] = np.cumsum(new)
        found = earlier_windows(table.append_column("doc", pa.array(doc)), window)
        row = found.column("row")
        return pa.table([table.column("doc_id").take(row), table.column("part").take(row), found.column("from"), found.column("to")], schema.names)

    dealt = classes.withColumn("shard", F.pmod(F.xxhash64("route"), F.lit(shards)))
    return dealt.select("shard", "doc_id", "part", "start", "size", "piece").groupBy("shard").applyInArrow(run, schema)


_SPANS = T.ArrayType(T.StructType([T.StructField("from", T.LongType()), T.StructField("to", T.LongType())]))


def _without(docs: DataFrame, id_type: T.DataType) -> DataFrame:
    """(doc_id, sha, n_removed, kept_sha256, removed) of texts with the intervals ``found`` taken out."""
    schema = T.StructType(
        [T.StructField("doc_id", id_type), T.StructField("sha", T.BinaryType()), T.StructField("n_removed", T.LongType()), T.StructField("kept_sha256", T.StringType()), T.StructField("removed", _SPANS)]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sha, n, kept, removed = [], [], [], []
            for k, raw in enumerate(_bytes(batch.column(1))):
                words = raw.split()
                deep = np.zeros(len(words) + 1, np.int64)
                spans = np.array([(x["from"], x["to"]) for x in batch.column(2)[k].as_py()], np.int64)
                np.add.at(deep, spans[:, 0], 1)
                np.add.at(deep, spans[:, 1], -1)
                gone = np.cumsum(deep) > 0  # nothing goes on behind the last word
                edge = np.diff(np.concatenate(([False], gone)).astype(np.int8))
                sha.append(hashlib.sha256(b" ".join(words)).digest())
                n.append(int(gone.sum()))
                kept.append(hashlib.sha256(b" ".join(w for w, g in zip(words, gone.tolist()) if not g)).hexdigest())
                removed.append([{"from": int(x), "to": int(y)} for x, y in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))])
            kind = pa.list_(pa.struct([("from", pa.int64()), ("to", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sha, pa.binary()), pa.array(n, pa.int64()), pa.array(kept, pa.string()), pa.array(removed, kind)], schema.names)

    return docs.select("doc_id", "t", "found").mapInArrow(run, schema)


def without_repeats(
    docs: DataFrame, *, id: str = "doc_id", text: str = "text", window: int = WINDOW, anchor: int = ANCHOR, hot: int = HOT, shard: int = SHARD
) -> DataFrame:
    """One row per input row: doc_id, n_words, n_removed, kept_sha256 and removed, the
    intervals of words that go.

    Words are runs of bytes other than space and tab to carriage return, in any case as they are. A word
    goes if it is in a run of ``window`` words that also starts at a smaller id, or earlier in the same
    document; kept words are joined by one space. Null text has no words. Rows without an id keep all
    their words and are not searched. Rows that repeat id and words are one document and are marked
    alike; rows that repeat an id with other words are documents of their own, in the order of the
    hash of their text. No rows give no rows; other columns are not read.
    """
    id_type = docs.schema[id].dataType
    rows = docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("t"))
    known = stored(_words(rows, id_type), "words-of-texts")
    total = known.count()
    same = known.groupBy("sha").agg(F.min("doc_id").alias("first_id"), F.count(F.lit(1)).alias("n"))
    marked = stored(attach(known, stored(same, "equal-texts"), "sha", "n", total).drop("n"), "marked-texts")
    searched = marked.filter((F.col("n_words") >= window) & (F.col("doc_id") == F.col("first_id"))).select("doc_id", "sha").distinct()
    searched = stored(searched.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts")), "searched-ids")
    copies = stored(marked.filter((F.col("n_words") < window) | F.col("doc_id").isNull() | (F.col("doc_id") != F.col("first_id"))).select("doc_id").distinct(), "other-ids")
    copies = copies.join(searched, "doc_id", "left_anti")
    clashing = stored(marked.filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.count_distinct("sha").alias("texts")).filter("texts > 1").select("doc_id"), "repeated-ids")
    own = rows.filter(F.col("doc_id").isNotNull()).join(sent_if_small(stored(copies, "copies")), "doc_id", "left_anti")
    if clashing.isEmpty():
        own = own.withColumn("part", F.lit(0).cast("long"))
    else:
        own = own.join(sent_if_small(clashing.withColumn("again", F.lit(True))), "doc_id", "left")
        words_only = F.trim(F.regexp_replace("t", r"[ \t-\r]+", " "))
        own = own.withColumn("part", F.when(F.col("again"), F.xxhash64(words_only)).otherwise(0)).drop("again")

    lists = stored(_pieces(own, id_type, window, anchor), "pieces")
    pieces = lists.select("doc_id", "part", F.explode(F.arrays_zip(F.col("anchors").alias("anchor"), F.col("starts").alias("start"), F.col("sizes").alias("size"))).alias("x"))
    pieces = pieces.select(F.col("x.anchor").alias("anchor"), "doc_id", "part", F.col("x.start").alias("start"), F.col("x.size").alias("size"))
    anchors = stored(pieces.groupBy("anchor").agg(F.count(F.lit(1)).alias("n")).filter("n > 1"), "repeated-anchors")
    met = attach(pieces, anchors, "anchor", "n", anchors.agg(F.sum("n")).first()[0] or 0)
    met = met.groupBy("doc_id", "part").agg(F.collect_list(F.struct("anchor", "start", "size", (F.col("n") > hot).alias("hot"))).alias("found"))
    met = stored(met, "met-pieces")
    some = own.join(sent_if_small(met.select("doc_id", "part")), ["doc_id", "part"], "left_semi")
    cut = _cut(some.join(met, ["doc_id", "part"]), id_type, window).withColumn("pid", F.unhex(F.substring(F.sha2("piece", 256), 1, 32)))
    cut = stored(cut, "cut-pieces")
    classes = cut.groupBy("route", "pid").agg(
        F.min(F.struct("doc_id", "part", "start")).alias("first"), F.count(F.lit(1)).alias("n"), F.first("piece").alias("piece"), F.first("size").alias("size")
    )
    classes = stored(classes.select("route", "pid", "n", "piece", "size", "first.doc_id", "first.part", "first.start"), "classes")
    later = classes.filter("n > 1").select("route", "pid", "n", F.struct("doc_id", "part", "start").alias("first"))
    later = attach(cut.drop("piece"), later, ["route", "pid"], "n", cut.count()).filter(F.struct("doc_id", "part", "start") != F.col("first"))
    later = later.select("doc_id", "part", F.col("start").cast("long").alias("from"), (F.col("start") + F.col("size") + (window - 1)).cast("long").alias("to"))
    spans = later.unionByName(_searched(classes, id_type, window, shard))
    spans = stored(spans.groupBy("doc_id", "part").agg(F.collect_set(F.struct("from", "to")).alias("found")), "repeated-words")
    some = own.join(sent_if_small(spans.select("doc_id", "part")), ["doc_id", "part"], "left_semi")
    cleared = stored(_without(some.join(spans, ["doc_id", "part"]), id_type).distinct(), "cleared-texts")
    whole = (F.col("n_words") >= window) & F.col("doc_id").isNotNull() & (F.col("doc_id") != F.col("first_id"))
    every = F.array(F.struct(F.lit(0).cast("long").alias("from"), F.col("n_words").alias("to")))
    return marked.join(cleared, ["doc_id", "sha"], "left").select(
        "doc_id", "n_words",
        F.when(whole, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(whole, F.lit(EMPTY)).otherwise(F.coalesce("kept_sha256", F.lower(F.hex("sha")))).alias("kept_sha256"),
        F.when(whole, every).otherwise(F.coalesce("removed", F.array().cast(_SPANS))).alias("removed"),
    )
