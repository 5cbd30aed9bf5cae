"""Collocations by vertical partitioning of the suffixes of all pieces of text.

1. Word prefixes of suffixes are hashed into buckets and all texts are counted: how many suffixes
   start in each bucket. Buckets with more suffixes than a task may hold are split by one word more,
   until the prefix is as long as the phrases asked for; equal suffixes are then summed up before
   they are sent. Whole buckets are dealt into groups of at most twice the memory budget.
2. Every group is independent: its suffixes, truncated at the longest phrase, are sorted, which is the
   suffix subtree below its prefixes in depth-first order. The run of equal first d words is the node
   of a phrase of d words and its leaf total the phrase's count. Only phrases shorter than a split
   prefix have their leaves in several groups; their counts are added up.
3. Cuts, scores and the choice among overlapping phrases are joins on the counted phrases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import attach, running, stored

BUDGET = 1_000_000  # suffixes that one task sorts at once; a group has fewer than twice as many
SLICE = 16 << 20  # bytes of text cut into words at once
BUCKETS = 64  # per shuffle partition

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.zeros(256, np.uint8)  # 0 in a word, 1 between words, 2 between pieces
_KIND[[0x20, 0x09]] = 1
_KIND[[*b".,;:!?", *range(0x0A, 0x0E)]] = 2
_U = np.uint64


def _buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column without nulls."""
    texts = texts.cast(pa.large_string())
    _, at, data = texts.buffers()
    at = np.frombuffer(at, np.int64)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def _slices(raw: np.ndarray, at: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Stretches of about SLICE bytes with the starts of texts in them, cut between texts or pieces."""
    lo = 0
    while lo < len(raw):
        hi = min(lo + SLICE, len(raw))
        if hi < len(raw):
            between = int(at[np.searchsorted(at, hi, "right") - 1])
            if between > lo:
                hi = between
            else:  # inside one long text: after its last break so far, else before its next one
                here = np.flatnonzero(_KIND[raw[lo:hi]] == 2)
                if len(here):
                    hi = lo + int(here[-1]) + 1
                else:
                    end = int(at[np.searchsorted(at, hi, "left")])
                    later = np.flatnonzero(_KIND[raw[hi:end]] == 2)
                    hi = hi + int(later[0]) + 1 if len(later) else end
        starts = at[np.searchsorted(at, lo, "left") : np.searchsorted(at, hi, "left")] - lo
        yield raw[lo:hi], starts
        lo = hi


def words_of(raw: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(code of each word, words left in its piece from it on, the distinct words by code)."""
    kind = _KIND[raw]
    word = kind == 0
    opens, closes = word.copy(), word.copy()
    opens[1:] &= ~word[:-1]
    closes[:-1] &= ~word[1:]
    starts = np.unique(starts[starts < len(raw)])
    opens[starts] |= word[starts]
    closes[starts[starts > 0] - 1] |= word[starts[starts > 0] - 1]
    first, last = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    if not len(first):
        return np.empty(0, np.int32), np.empty(0, np.int32), pa.array([], pa.large_string())
    breaks = kind == 2
    breaks[starts] = True
    piece = np.cumsum(breaks, dtype=np.int32)[first]
    ends = np.concatenate((np.flatnonzero(np.diff(piece)) + 1, [len(piece)]))
    sizes = np.diff(np.concatenate(([0], ends)))
    room = np.repeat(ends, sizes) - np.arange(len(piece))
    offsets = np.concatenate(([0], np.cumsum(last - first))).astype(np.int64)
    strings = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(_LOWER[raw[word]]))
    coded = strings.dictionary_encode()
    return coded.indices.to_numpy().astype(np.int32), room.astype(np.int32), coded.dictionary


def _by_lang(batch: pa.RecordBatch) -> Iterator[tuple[str, np.ndarray, np.ndarray, pa.Array]]:
    """(lang, codes, room, distinct words) of every stretch of a batch of (text, lang)."""
    texts, langs = batch.column(0), batch.column(1)
    for lang in pc.unique(langs).to_pylist():
        for raw, starts in _slices(*_buffers(texts.filter(pc.equal(langs, lang)))):
            yield lang, *words_of(raw, starts)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


class _Prefixes:
    """Hashes of ever longer prefixes of the suffixes of one stretch of text."""

    def __init__(self, lang: str, codes: np.ndarray, room: np.ndarray, words: pa.Array):
        values = pd.util.hash_array(words.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(words) else np.empty(0, _U)
        self.of = np.concatenate(([_U(0)], values.astype(_U)))
        self.codes, self.room = codes, room
        self.seed = _U(int(pd.util.hash_array(np.array([lang], object), categorize=False)[0]))

    def column(self, rows: np.ndarray, k: int) -> np.ndarray:
        """1 + code of the word k places on; 0 behind the end of the piece."""
        at = np.minimum(rows + k, len(self.codes) - 1)
        return np.where(self.room[rows] > k, self.codes[at] + 1, 0).astype(np.int32)

    def longer(self, hashes: np.ndarray | None, rows: np.ndarray, k: int) -> np.ndarray:
        start = np.full(len(rows), self.seed, _U) if hashes is None else hashes
        return _mixed(start * _U(0x9E3779B97F4A7C15) + self.of[self.column(rows, k)])


def _routed(prefixes: _Prefixes, levels: list[np.ndarray], upto: int):
    """Per level the rows that stay there with their buckets; then the rows left, with their hashes."""
    rows, hashes, found = np.arange(len(prefixes.codes)), None, []
    for k, group_of in enumerate(levels[:upto]):
        hashes = prefixes.longer(hashes, rows, k)
        groups = group_of[(hashes % _U(len(group_of))).astype(np.int64)]
        found.append((rows[groups >= 0], groups[groups >= 0]))
        rows, hashes = rows[groups < 0], hashes[groups < 0]
    return found, rows, hashes


def _partitioned(docs: DataFrame, words: int, budget: int, buckets: int) -> tuple[list[np.ndarray], list[int], int, DataFrame]:
    """(group of each bucket per prefix length, -1 where split; first group of each length; groups of
    whole phrases; words per lang)."""
    spark = docs.sparkSession
    levels: list[np.ndarray] = []
    firsts, total, n = [], 0, None
    while True:
        def count(batches: Iterator[pa.RecordBatch], known: list[np.ndarray] = list(levels)) -> Iterator[pa.RecordBatch]:
            held: dict[str, np.ndarray] = {}
            for batch in batches:
                for lang, codes, room, distinct in _by_lang(batch):
                    if len(codes):
                        own = _Prefixes(lang, codes, room, distinct)
                        _, rows, hashes = _routed(own, known, len(known))
                        at = (own.longer(hashes, rows, len(known)) % _U(buckets)).astype(np.int64)
                        held[lang] = held.get(lang, 0) + np.bincount(at, minlength=buckets)
            for lang, sums in held.items():
                at = np.flatnonzero(sums)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at)), pa.array(at), pa.array(sums[at])], ["lang", "bucket", "n"])

        sums = stored(docs.mapInArrow(count, "lang string, bucket long, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")), "prefix-totals")
        if n is None:
            n = stored(sums.groupBy("lang").agg(F.sum("n").alias("n")), "words-per-lang")
        sizes = np.zeros(buckets, np.int64)
        for bucket, size in sums.groupBy("bucket").agg(F.sum("n")).toLocalIterator():  # one number a bucket
            sizes[bucket] = size
        group_of = np.where(sizes > budget, -1, total + (np.cumsum(np.where(sizes > budget, 0, sizes)) - 1).clip(0) // budget).astype(np.int64)
        levels.append(group_of)
        firsts.append(total)
        total = max(total, int(group_of.max()) + 1)
        left = int(sizes[sizes > budget].sum())
        if left == 0 or len(levels) == words - 1:
            return levels, [*firsts, total], -(-left // budget), n


def counted_phrases(docs: DataFrame, words: int, least: int, budget: int = BUDGET) -> tuple[DataFrame, DataFrame]:
    """(phrases, n): all phrases of up to ``words`` words that occur at least ``least`` times.

    phrases: lang, words, phrase (joined by spaces), f; n: lang, n, all word occurrences.
    ``docs``: text, lang, without nulls.
    """
    spark = docs.sparkSession
    buckets = BUCKETS * max(64, int(spark.conf.get("spark.sql.shuffle.partitions")))
    levels, firsts, last_groups, n = _partitioned(docs, words, budget, buckets)
    sent = spark.sparkContext.broadcast(levels)  # eight bytes a bucket and level

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, codes, room, distinct in _by_lang(batch):
                if not len(codes):
                    continue
                own = _Prefixes(lang, codes, room, distinct)
                found, rows, hashes = _routed(own, sent.value, len(levels))
                for k in range(len(levels), words):
                    hashes = own.longer(hashes, rows, k) if len(rows) else hashes
                parts = [(r, g, None) for r, g in found]
                if len(rows):  # whole phrases: equal ones are one row with a count
                    _, at, times = np.unique(hashes, return_index=True, return_counts=True)
                    groups = firsts[-1] + (hashes[at] % _U(last_groups)).astype(np.int64)
                    parts.append((rows[at], groups, times))
                for r, g, times in parts:
                    order = np.argsort(g, kind="stable")
                    r, g = r[order], g[order]
                    ends = np.concatenate((np.flatnonzero(np.diff(g)) + 1, [len(g)])) if len(g) else []
                    lo = 0
                    for hi in ends:
                        cols = np.concatenate([own.column(r[lo:hi], k) for k in range(words)])
                        own_codes, used = pd.factorize(cols)
                        strings = distinct.take(pa.array(used[used > 0] - 1))
                        zero = np.flatnonzero(used == 0)
                        if len(zero):  # 0 stands for no word, the others move up behind it
                            own_codes = np.where(own_codes == zero[0], 0, own_codes + (own_codes < zero[0]))
                        else:
                            own_codes = own_codes + 1
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array([g[lo]], pa.int64()), pa.array([lang]),
                                pa.array([" ".join(strings.to_pylist())], pa.large_string()).cast(pa.string()),
                                pa.array([own_codes.astype(_code_type(len(strings))).tobytes()], pa.binary()),
                                pa.array([b"" if times is None else times[order][lo:hi].astype(np.int64).tobytes()], pa.binary()),
                            ],
                            ["part", "lang", "vocabulary", "codes", "times"],
                        )
                        lo = hi

    def subtree(table: pa.Table) -> pa.Table:
        part = table.column("part")[0].as_py()
        split = int(np.searchsorted(firsts, part, "right"))  # words in the prefixes of this group
        out = []
        for lang in pc.unique(table.column("lang")).to_pylist():
            own = table.filter(pc.equal(table.column("lang"), lang))
            lists = pc.split_pattern(own.column("vocabulary").combine_chunks(), " ")
            coded = pc.list_flatten(lists).dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            sizes, dictionary, every = pc.list_value_length(lists).to_pylist(), coded.dictionary, coded.indices.to_numpy() + 1
            del lists, coded
            places = [
                codes.as_buffer().size // (words * _code_type(size).itemsize) for size, codes in zip(sizes, own.column("codes"))
            ]
            cols, weights, at, lo = np.empty((words, sum(places)), np.int32), None, 0, 0
            for size, n, codes, times in zip(sizes, places, own.column("codes"), own.column("times")):
                codes = np.frombuffer(codes.as_buffer(), _code_type(size)).reshape(words, n)
                cols[:, lo : lo + n] = np.concatenate(([0], every[at : at + size]))[codes]
                if times.as_buffer().size:
                    weights = np.ones(sum(places), np.int64) if weights is None else weights
                    weights[lo : lo + n] = np.frombuffer(times.as_buffer(), np.int64)
                at, lo = at + size, lo + n
            del own, every
            out += _leaf_totals(cols, weights, dictionary, lang, split, least)
        return pa.concat_tables(out) if out else pa.table({c: pa.array([], t) for c, t in _TOTALS.items()})

    groups = docs.mapInArrow(cut, "part long, lang string, vocabulary string, codes binary, times binary").groupBy("part")
    totals = groups.applyInArrow(subtree, "lang string, words long, phrase string, f long")
    phrases = totals.groupBy("lang", "words", "phrase").agg(F.sum("f").alias("f")).filter(F.col("f") >= least)
    return stored(phrases, "phrases"), n


_TOTALS = {"lang": pa.string(), "words": pa.int64(), "phrase": pa.string(), "f": pa.int64()}


def _code_type(words: int) -> np.dtype:
    """Of the codes 0 to ``words``."""
    return np.dtype(np.uint16 if words < 1 << 16 else np.int32)


def _leaf_totals(cols: np.ndarray, weights: np.ndarray | None, dictionary: pa.Array, lang: str, split: int, least: int) -> list[pa.Table]:
    """Nodes of the subtree of the suffixes ``cols`` (a row per place, 0 for no word) with their totals.

    ``weights``: None if each suffix counts once.
    """
    (words, n), bits = cols.shape, max(1, int(cols.max()).bit_length())
    # what is held for each suffix tells how large a task gets: a key, its difference and no columns of it
    if packed := words * bits <= 63:
        key = cols[0].astype(np.int64)
        for c in cols[1:]:
            key <<= bits
            key |= c
        order = None if weights is None else np.argsort(key)
        if order is None:
            key.sort()
        else:
            key = key[order]
        step = key[1:] ^ key[:-1]
    else:
        order = np.lexsort(cols[::-1])
    upto = None if weights is None else np.concatenate(([0], np.cumsum(weights[order])))
    out, new = [], np.zeros(n, bool)
    new[0] = True
    for d in range(1, words + 1):
        if packed:
            new[1:] = step >= 1 << bits * (words - d)
        else:
            own = cols[d - 1][order]
            new[1:] |= own[1:] != own[:-1]
        first = np.flatnonzero(new)
        f = np.diff(np.append(first, n)) if upto is None else np.diff(np.append(upto[first], upto[-1]))
        codes = lambda k: (key[first] >> bits * (words - 1 - k)) & ((1 << bits) - 1) if packed else cols[k][order[first]]  # noqa: B023, E731
        stay = (codes(d - 1) > 0) & ((f >= least) | (d < split))
        first, f = first[stay], f[stay]
        if len(first):
            parts = [dictionary.take(pa.array(codes(k) - 1)) for k in range(d)]
            phrase = pc.binary_join_element_wise(*parts, " ") if d > 1 else parts[0]
            out.append(pa.table({"lang": pa.array([lang] * len(f)), "words": pa.array([d] * len(f), pa.int64()), "phrase": phrase.cast(pa.string()), "f": pa.array(f)}))
    return out


def _looked_up(rows: DataFrame, phrases: DataFrame, part: str, name: str) -> DataFrame:
    """``rows`` with the count of the phrase in column ``part``; one part may be in any share of them."""
    asked = rows.groupBy("lang", part).agg(F.count(F.lit(1)).alias("_asked"))
    known = asked.join(phrases.select("lang", F.col("phrase").alias(part), F.col("f").alias(name)), ["lang", part])
    return attach(rows, stored(known, "phrase-parts"), ["lang", part], "_asked", rows.count()).drop("_asked")


def collocations(
    docs: DataFrame, *, text: str = "text", lang: str = "lang", least_words: int = 2, words: int = 3, least: int = 10,
    percent: int = 50, top: int = 2000, budget: int = BUDGET,
) -> DataFrame:
    """The first ``top`` phrases per language: lang, rank, phrase, a, l, r, n, score.

    A candidate has ``least_words`` to ``words`` words of one piece and occurs a >= ``least`` times. Its
    score is the least floor(1000000 a a / (l r)) over its cuts, l and r the counts of the two parts.
    Candidates inside a longer one that is at least ``percent`` as frequent are dropped. Null text is
    empty, null language `und`; repeated rows count as often as they come; only these two columns are
    read. Texts without a word add nothing; no words, no rows.
    """
    rows = docs.select(
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"), F.coalesce(F.col(f"`{lang}`").cast("string"), F.lit("und")).alias("lang")
    )
    phrases, n = counted_phrases(rows, words, least, budget)
    found = phrases.filter(F.col("words") >= max(2, least_words))
    cuts = stored(
        found.select("lang", "phrase", F.col("f").alias("a"), "words", F.explode(F.sequence(F.lit(1), F.col("words") - 1)).alias("k"))
        .withColumns({"left": F.expr("substring_index(phrase, ' ', cast(k as int))"), "right": F.expr("substring_index(phrase, ' ', cast(k - words as int))")}),
        "cuts",
    )
    cuts = _looked_up(stored(_looked_up(cuts, phrases, "left", "l"), "cuts-left"), phrases, "right", "r")
    whole = lambda c: f"cast({c} as decimal(19, 0))"
    score = F.expr(f"(cast(1000000 as decimal(7, 0)) * {whole('a')} * {whole('a')}) div ({whole('l')} * {whole('r')})")
    scored = cuts.withColumn("score", score).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("best"))
    inside = found.filter(F.col("words") > max(2, least_words)).withColumn("w", F.split("phrase", " "))
    inside = inside.select(
        "lang", "f", "words", "w", F.explode(F.sequence(F.lit(max(2, least_words)).cast("long"), F.col("words") - 1)).alias("size")
    ).select("lang", "f", "w", "size", F.explode(F.expr("sequence(1L, words - size + 1)")).alias("at"))
    inside = inside.select("lang", "f", F.expr("array_join(slice(w, cast(at as int), cast(size as int)), ' ')").alias("phrase"))
    inside = inside.groupBy("lang", "phrase").agg(F.max("f").alias("longer"))
    kept = scored.join(inside, ["lang", "phrase"], "left").filter(~F.coalesce(F.col("longer") * 100 >= F.col("a") * percent, F.lit(False)))
    kept = kept.select("lang", "phrase", "a", F.col("best.l").alias("l"), F.col("best.r").alias("r"), F.col("best.score").alias("score"))
    ranked = running(kept, ["lang"], [F.col("score").desc(), F.col("a").desc(), F.col("phrase")], rank=F.lit(1))
    return ranked.filter(F.col("rank") <= top).join(n, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
