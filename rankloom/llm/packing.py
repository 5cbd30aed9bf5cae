"""Best-fit packing of documents into sequences of a fixed number of tokens.

Bounded-space online best fit: at most ``open_bins`` sequences are open. Their free spaces are
the set bits of one integer, so the best fit for a piece is the lowest bit at or above its
length. A piece that fits nowhere opens a sequence; beyond the bound the fullest one closes.

Pieces arrive longest first within a shard of about ``shard_pieces`` pieces, which lets best fit
fill almost every gap: with fewer open sequences than a shard needs, or in random order, about one
in a hundred positions stays empty, this way about one in several thousand.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import stored, text_of

CAPACITY = 2048
OPEN_BINS = 8192
SHARD_PIECES = 10_000
END = 0

#: Pre-tokenization of the byte-level vocabulary; fixed values of the public tokenizer.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+"
#: In texts of these characters Python's classes and the tokenizer's are the same.
PLAIN = r"[\t\n\r\x20-\x7eÀ-ÖØ-öø-ſ]*"
#: Tabs and white space in a row. In PLAIN texts without these and without white space at the end, a space always
#: belongs to the word behind it and a line feed is alone, so such a text may be cut before each of them.
UNEVEN = ("\t", "\r", "  ", " \n", "\n ", "\n\n")
#: Bytes of words a worker remembers, about; further words are encoded each time they come.
MEMO = 200_000_000

PIECES = "doc_id {id}, piece int, start bigint, length bigint, ids_crc32 bigint"


class Encoder:
    """Token ids as little-endian unsigned 32-bit bytes.

    A word's ids come from the BPE model of the ``tokenizers`` library and are remembered up to MEMO, as frequent
    words come early. Words are what stands between single spaces and line feeds; in UNEVEN texts they are the
    tokenizer's own pre-tokens. Texts with characters outside PLAIN or with one of the tokenizer's own tokens go
    to the library whole.
    """

    def __init__(self, spec: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(spec)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.words = re.compile(PATTERN)
        self.plain = re.compile(PLAIN)
        # the byte-level alphabet: bytes that do not print stand for themselves plus 256, counted up
        shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
        self.marks = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in shown)}
        self.space = chr(self.marks[32])
        self.line = len(self._exact("\n"))
        self.spaced: dict[str, bytes] = {}  # a word that starts with a line feed, else one with a space before it
        self.exact: dict[str, bytes] = {}  # pre-tokens as they are
        self.room = MEMO

    def _whole(self, text: str) -> bytes:
        found = self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]
        return np.asarray(found.ids, "<u4").tobytes()

    def _exact(self, token: str) -> bytes:
        if token.isascii() and token.isprintable():
            shown = token.replace(" ", self.space)
        else:
            shown = token.encode().decode("latin-1").translate(self.marks)
        found = self.model.tokenize(shown)
        return struct.pack(f"<{len(found)}I", *[t.id for t in found])

    def _spaced(self, word: str) -> bytes:
        return b"".join(map(self._exact, self.words.findall(word if word[0] == "\n" else " " + word)))

    def _joined(self, words: list[str], memo: dict[str, bytes], encode: Callable[[str], bytes]) -> bytes:
        new = set(words).difference(memo)
        if new:
            coded = {w: encode(w) for w in new}
            self.room -= sum(150 + len(w) + len(ids) for w, ids in coded.items())
            if self.room < 0:
                return b"".join([coded[w] if w in coded else memo[w] for w in words])
            memo.update(coded)
        return b"".join(map(memo.__getitem__, words))

    def ids(self, text: str) -> bytes:
        if not self.plain.fullmatch(text) or any(s in text for s in self.special):
            return self._whole(text)
        even = "\n" + text
        if even[-1] in " \n" or any(s in even for s in UNEVEN):
            return self._joined(self.words.findall(text), self.exact, self._exact)
        return self._joined(even.replace("\n", " \n")[1:].split(" "), self.spaced, self._spaced)[self.line :]


_ENCODERS: dict[int, Encoder] = {}  # one per Python worker and tokenizer


def _encoder(spec) -> Encoder:
    key = zlib.crc32(spec.value.encode())
    if key not in _ENCODERS:
        _ENCODERS[key] = Encoder(spec.value)
    return _ENCODERS[key]


def cut(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``length`` tokens: all full, but maybe the first."""
    first = length % capacity or min(length, capacity)
    return [(0, first), *((at, capacity) for at in range(first, length, capacity))]


def pieces(
    docs: DataFrame, tokenizer: str, *, id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, with_ids: bool = False
) -> DataFrame:
    """Tokenize every whole text and cut it: doc_id, piece, start, length, ids_crc32 (and ids).

    ``tokenizer`` is the path of a tokenizers JSON file on the driver. A document's ids are those
    of its text and then id 0; only documents of more than ``capacity`` ids are cut. Null text
    counts as empty and gives one piece of length 1. Rows with equal ids are separate documents.
    """
    with open(tokenizer, encoding="utf-8") as f:
        spec = docs.sparkSession.sparkContext.broadcast(f.read())  # one vocabulary file
    schema = PIECES.format(id=docs.schema[id].dataType.simpleString()) + (", ids binary" if with_ids else "")
    names = [x.strip().split(" ")[0] for x in schema.split(",")]
    end = np.asarray([END], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(spec)
        for batch in batches:
            at, cols = [], [[] for _ in names[1:]]
            for k, t in enumerate(batch.column(1)):
                ids = encoder.ids(t.as_py()) + end
                for n, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                    own = ids[4 * start : 4 * (start + length)]
                    at.append(k)
                    for c, v in zip(cols, (n, start, length, zlib.crc32(own), own)):
                        c.append(v)
            kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(at, pa.int32())), *(pa.array(c, k) for c, k in zip(cols, kinds))], names=names
            )

    return docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("t")).mapInArrow(run, schema)


class BestFit:
    """The packer of one shard: ``place(length)`` gives (sequence, offset)."""

    def __init__(self, capacity: int, open_bins: int):
        self.capacity, self.open_bins = capacity, open_bins
        self.free = 0  # bit f is set when an open sequence has f positions free
        self.at: dict[int, list[int]] = {}
        self.open = self.count = 0

    def _take(self, free: int) -> int:
        own = self.at[free]
        sequence = own.pop()
        if not own:
            self.free &= ~(1 << free)
        self.open -= 1
        return sequence

    def place(self, length: int) -> tuple[int, int]:
        fits = self.free >> length
        if fits:
            free = length + (fits & -fits).bit_length() - 1
            sequence = self._take(free)
        else:
            free, sequence = self.capacity, self.count
            self.count += 1
        left = free - length
        if left:
            self.at.setdefault(left, []).append(sequence)
            self.free |= 1 << left
            self.open += 1
            if self.open > self.open_bins:  # the fullest closes
                self._take((self.free & -self.free).bit_length() - 1)
        return sequence, self.capacity - free


def pack(
    rows: DataFrame, *, length: str = "length", order: tuple[str, ...] = ("doc_id", "piece"), capacity: int = CAPACITY,
    open_bins: int = OPEN_BINS, shard_pieces: int = SHARD_PIECES, total: int | None = None,
) -> DataFrame:
    """Add sequence_id and offset to ``rows`` (a stored table of pieces no longer than ``capacity``).

    Rows are spread over shards by a hash of all their columns and ordered by length (longest
    first) and ``order``, so a task that is run again after a loss places them alike. A shard is
    only a key: memory of a task is ``open_bins`` numbers, whatever the table's size. No rows give
    no rows; columns named sequence_id or offset must not be there before.
    """
    total = rows.count() if total is None else total
    shards = max(1, -(-total // shard_pieces))
    parts = min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    columns = [F.col(f"`{c}`") for c in rows.columns]
    dealt = (
        rows.withColumn("_shard", F.pmod(F.xxhash64(*columns), F.lit(shards)).cast("bigint"))
        .repartition(parts, "_shard")
        .sortWithinPartitions("_shard", F.desc(length), *order, *columns)
    )
    schema = T.StructType([*rows.schema, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, fit = None, None
        for batch in batches:
            sequence, offset = [], []
            own = batch.column(batch.schema.get_field_index("_shard")).to_pylist()
            for s, n in zip(own, batch.column(batch.schema.get_field_index(length)).to_pylist()):
                if s != shard:
                    shard, fit = s, BestFit(capacity, open_bins)
                a, b = fit.place(n)
                sequence.append((s << 32) + a)
                offset.append(b)
            kept = batch.select([c for c in batch.schema.names if c != "_shard"])
            yield pa.RecordBatch.from_arrays(
                [*kept.columns, pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())],
                names=[*kept.schema.names, "sequence_id", "offset"],
            )

    return dealt.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """One row per piece with its place: ``pieces`` then ``pack``."""
    own = {k: options[k] for k in ("id", "text", "capacity", "with_ids") if k in options}
    rest = {k: options[k] for k in ("capacity", "open_bins", "shard_pieces") if k in options}
    return pack(stored(pieces(docs, tokenizer, **own), "pieces"), **rest)


def sequences(packed: DataFrame) -> DataFrame:
    """The packed token ids: sequence_id, tokens (array of bigint), from ``pack_documents(with_ids=True)``.

    A group is one sequence, so at most ``capacity`` tokens.
    """
    joined = F.array_join(
        F.transform(F.sort_array(F.collect_list(F.struct("offset", F.hex("ids").alias("h")))), lambda x: x["h"]), ""
    )
    tokens = F.transform(
        F.sequence(F.lit(0), (F.length("h") / 8 - 1).cast("int")),
        lambda i: F.conv(
            F.concat(*[F.substring(F.col("h"), i * 8 + 7 - 2 * k, F.lit(2)) for k in range(4)]), 16, 10
        ).cast("bigint"),
    )
    return packed.groupBy("sequence_id").agg(joined.alias("h")).select("sequence_id", tokens.alias("tokens"))
