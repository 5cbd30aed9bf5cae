"""Toxicity by compression distance: which of two zstandard dictionaries codes a window shorter?

One dictionary is trained on windows of ordinary text, one on windows typical of toxic text. Every
window (a word with its spaces, behind a fixed pad that gives zstandard enough bytes to work on)
of a whole text is compressed with both; the difference of the lengths is the window's gain. A text is
judged by how many of its windows reach gains of 2, 3, ... bytes, and by their share; the weights
of these thresholds are calibrated by logistic regression on labelled texts that trained neither
dictionary. Windows compress alike wherever they stand, so each distinct one is compressed once per
worker.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rankloom.llm.common import stored, text_of

#: Labelled texts used for fitting, at most; half train the dictionaries, half calibrate.
LABELLED = 20_000
TOXIC_WORDS, ORDINARY_WORDS = 3000, 60_000  # windows collected for training, at most
TOXIC_BYTES, ORDINARY_BYTES = 8 << 10, 64 << 10
LEVEL, PAD, LONGEST, MEMO = 19, b" " * 16, 64, 400_000
GAINS = (2, 3, 4, 5, 6)
SHIFT = 128  # gains are kept as bytes

_WORD = re.compile(rb"[^\x00-\x40\x5b-\x60\x7b-\x7f]{1,%d}" % LONGEST)


def windows(text: str) -> list[bytes]:
    """The windows of a whole text: its words, lower-cased; words over LONGEST bytes are cut."""
    return _WORD.findall(text.lower().encode("utf-8", "replace"))


def _compressor(dictionary: bytes):
    import zstandard

    data = zstandard.ZstdCompressionDict(dictionary)
    settings = zstandard.ZstdCompressionParameters.from_level(
        LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS
    )
    data.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(compression_params=settings, dict_data=data)


def _framed(word: bytes) -> bytes:
    return PAD + b" " + word + b" "


def _lengths(compressor, words: list[bytes]) -> np.ndarray:
    out = [0] * len(words)
    for at in range(0, len(words), 4096):
        for k, x in enumerate(compressor.multi_compress_to_buffer([_framed(w) for w in words[at : at + 4096]]), at):
            out[k] = len(x)
    return np.asarray(out, np.int64)


@dataclass
class Judge:
    """The two dictionaries and the calibrated weights; small enough to send with a task."""

    toxic: bytes
    ordinary: bytes
    weights: list[float] = field(default_factory=list)
    _memo: dict = field(default_factory=dict, repr=False)
    _pair: tuple = field(default=(), repr=False)  # the compressors: loading a dictionary costs as much as hundreds of windows

    def __getstate__(self):
        return {"toxic": self.toxic, "ordinary": self.ordinary, "weights": self.weights, "_memo": {}, "_pair": ()}

    def gains(self, words: list[bytes]) -> np.ndarray:
        """Bytes that the toxic dictionary saves against the ordinary one, for each window."""
        if not self._pair or self._pair[0] is not self.ordinary:
            self._pair = (self.ordinary, _compressor(self.ordinary), _compressor(self.toxic))
        return _lengths(self._pair[1], words) - _lengths(self._pair[2], words)

    def _learn(self, words: set[bytes]) -> None:
        new = sorted(words - self._memo.keys())
        if len(self._memo) + len(new) > MEMO:
            self._memo.clear()
            new = sorted(words)
        if new:
            self._memo.update(zip(new, np.clip(self.gains(new) + SHIFT, 0, 255).astype(int).tolist()))

    def counts(self, texts: list[str]) -> np.ndarray:
        """For each text: its windows, and how many of them reach each gain of GAINS."""
        out = np.zeros((len(texts), 1 + len(GAINS)))
        cut = [(k, words[at : at + MEMO // 2]) for k, words in enumerate(map(windows, texts)) for at in range(0, len(words), MEMO // 2)]
        while cut:  # as many texts at once as the memo holds the windows of: compressing a few is dear
            now, new = [], set()
            while cut and (not now or len(new) < MEMO // 2):
                now.append(cut.pop())
                new.update(now[-1][1])
            self._learn(new)
            for k, own in now:
                found = np.bincount(np.frombuffer(bytes(map(self._memo.__getitem__, own)), np.uint8), minlength=256)
                out[k, 0] += len(own)
                out[k, 1:] += [found[SHIFT + g :].sum() for g in GAINS]
        return out

    def scores(self, texts: list[str]) -> np.ndarray:
        """Probability of label 1 for each text."""
        x = _features(self.counts(texts)) @ np.asarray(self.weights)
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _features(counts: np.ndarray) -> np.ndarray:
    n, hits = counts[:, :1], counts[:, 1:]
    return np.hstack([np.ones_like(n), np.log1p(n) / 5, np.log1p(hits), np.log((hits + 0.5) / (n + 100)) / 2])


def _regression(x: np.ndarray, y: np.ndarray, ridge: float = 1.0) -> np.ndarray:
    """Logistic regression by Newton's method."""
    w, keep = np.zeros(x.shape[1]), np.full(x.shape[1], ridge)
    keep[0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + np.diag(keep), x.T @ (p - y) + keep * w)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _dictionary(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; of samples too few to train on, their content itself."""
    import zstandard

    random.Random(7).shuffle(samples)
    try:
        return zstandard.train_dictionary(size, samples, k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:] or b" " * 16


def _dictionaries(toxic: list[tuple[bytes, int]], ordinary: list[tuple[bytes, int]]) -> Judge:
    """Train both; then once more with the ordinary windows that gained, weighted up."""
    weight = lambda n: 1 + int(3 * math.log2(n))
    samples = [_framed(w) for w, n in toxic for _ in range(weight(n))]
    usual = [_framed(w) for w, n in ordinary for _ in range(weight(n))]
    judge = Judge(_dictionary(samples, TOXIC_BYTES), _dictionary(list(usual), ORDINARY_BYTES))
    wrong = {w: n for w, n in ordinary if n > 1}
    words = list(wrong)
    for w, g in zip(words, judge.gains(words) if words else ()):
        if g >= GAINS[0]:
            usual += [_framed(w)] * (4 * weight(wrong[w]))
    judge.ordinary = _dictionary(usual, ORDINARY_BYTES)
    return judge


def _frequencies(rows: DataFrame) -> DataFrame:
    """(word, toxic, ordinary): in how many texts of each label a window occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = (Counter(), Counter())
            for text, y in zip(batch.column(0), batch.column(1).to_pylist()):
                found[y].update(set(windows(text.as_py())))
            words = sorted(found[0].keys() | found[1].keys())
            yield pa.RecordBatch.from_arrays(
                [pa.array(words, pa.binary()), *(pa.array([found[y][w] for w in words], pa.int64()) for y in (1, 0))],
                names=["word", "toxic", "ordinary"],
            )

    counted = rows.select("t", "y").mapInArrow(run, "word binary, toxic bigint, ordinary bigint")
    return counted.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def fit(docs: DataFrame, labels: DataFrame, *, id: str = "doc_id", text: str = "text", label: str = "toxic", limit: int = LABELLED) -> Judge:
    """Fit a judge on at most ``limit`` labelled texts (the first by a hash of their ids).

    ``labels``: id and label (1 toxic, else 0). Rows without id or label do not count; of several
    labels the largest does. Without texts of both labels the judge scores all alike.
    """
    chosen = (
        labels.select(F.col(id).alias("_id"), F.col(label).cast("int").alias("y")).filter("_id IS NOT NULL AND y IS NOT NULL")
        .groupBy("_id").agg(F.max((F.col("y") == 1).cast("int")).alias("y"))
        .orderBy(F.xxhash64("_id"), "_id").limit(limit)
    )
    rows = docs.select(F.col(f"`{id}`").alias("_id"), text_of(text).alias("t")).join(F.broadcast(chosen), "_id")  # at most ``limit`` rows
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.withColumn("half", F.pmod(F.xxhash64("_id", F.lit("half")), F.lit(2))).repartition(parts, "_id")
    rows = stored(rows, "labelled")
    learn = rows.filter("half = 0")
    sizes = {r["y"]: r["n"] for r in learn.groupBy("y").agg(F.count(F.lit(1)).alias("n")).collect()}
    nt, no = sizes.get(1, 0), sizes.get(0, 0)
    if not (nt and no):
        return Judge(b" " * 16, b" " * 16, [0.0] * (2 + 2 * len(GAINS)))
    words = stored(_frequencies(learn), "window-counts")
    contrast = (F.col("toxic") / nt - F.col("ordinary") / no) / F.sqrt((F.col("toxic") + F.col("ordinary") + 1) / (nt + no) * (1 / nt + 1 / no))
    typical = words.withColumn("z", contrast).filter("z > 3.5 AND toxic >= 3").orderBy(F.desc("z"), "word").limit(TOXIC_WORDS)
    usual = words.filter("ordinary > 0").orderBy(F.desc("ordinary"), "word").limit(ORDINARY_WORDS)
    judge = _dictionaries(
        [(bytes(r["word"]), r["toxic"]) for r in typical.collect()], [(bytes(r["word"]), r["ordinary"]) for r in usual.collect()]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = judge.counts(batch.column(0).to_pylist())
            yield pa.RecordBatch.from_arrays([pa.array(found.tolist(), pa.list_(pa.float64())), batch.column(1)], names=["counts", "y"])

    held = rows.filter("half = 1").select("t", "y").mapInArrow(run, "counts array<double>, y int").collect()  # a few numbers per text
    y = np.asarray([r["y"] for r in held], float)
    if len(set(y)) < 2:
        judge.weights = [0.0] * (2 + 2 * len(GAINS))
    else:
        judge.weights = _regression(_features(np.asarray([r["counts"] for r in held])), y).tolist()
    return judge


_WORKER: dict[int, Judge] = {}  # keeps the judge's memo between tasks of one Python worker


def _here(sent) -> Judge:
    judge = sent.value
    key = hash((judge.toxic, judge.ordinary, tuple(judge.weights)))
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = judge
    return _WORKER[key]


def score(docs: DataFrame, judge: Judge, *, id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and score (0 to 1, higher is likelier toxic) of every row. Null text counts as empty."""
    sent = docs.sparkSession.sparkContext.broadcast(judge)  # two dictionaries, under 100 kB

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _here(sent)
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(own.scores(part.column(1).to_pylist()), pa.float64())], names=["doc_id", "score"]
                )

    schema = T.StructType([T.StructField("doc_id", docs.schema[id].dataType), T.StructField("score", T.DoubleType())])
    return docs.select(F.col(f"`{id}`").alias("doc_id"), text_of(text).alias("t")).mapInArrow(run, schema)


def keep_ordinary(docs: DataFrame, judge: Judge, threshold: float, *, text: str = "text") -> DataFrame:
    """The rows of ``docs``, whole, that score under ``threshold``; the text stays where its row is."""
    sent = docs.sparkSession.sparkContext.broadcast(judge)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = _here(sent)
            for k in range(0, batch.num_rows, 256):
                part = batch.slice(k, 256)
                low = own.scores([t or "" for t in part.column(at).to_pylist()]) < threshold
                yield part.filter(pa.array(low))

    return docs.mapInArrow(run, docs.schema)
