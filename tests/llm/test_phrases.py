import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from rankloom.llm import phrases as P


def brute(rows, words=3, least=10, percent=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for text, lang in rows:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", text):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und"] += len(w)
            for i in range(len(w)):
                for d in range(1, words + 1):
                    if i + d <= len(w):
                        f[lang or "und"][tuple(w[i : i + d])] += 1
    out = []
    for lang, own in f.items():
        found = {p: a for p, a in own.items() if len(p) > 1 and a >= least}
        longer = Counter()
        for p, a in found.items():
            for d in range(2, len(p)):
                for i in range(len(p) - d + 1):
                    longer[p[i : i + d]] = max(longer[p[i : i + d]], a)
        kept = []
        for p, a in found.items():
            if not (p in longer and 100 * longer[p] >= percent * a):
                s, k = min((10**6 * a * a // (own[p[:k]] * own[p[k:]]), k) for k in range(1, len(p)))
                kept.append((-s, -a, " ".join(p).encode(), own[p[:k]], own[p[k:]]))
        for rank, (s, a, p, l, r) in enumerate(sorted(kept)[:top], 1):
            out.append((lang, rank, p.decode(), -a, l, r, n[lang], -s))
    return sorted(out)


def found(df, **options):
    return sorted(tuple(r) for r in P.collocations(df, **options).collect())


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x") for r in rows], "text string, lang string, f int, phrase string").repartition(5)


def noisy(n, seed=5):
    rng = random.Random(seed)
    some = ["The", "the", "of", "ok", "naïve", "Ünder", "x", "y", "  ", "\t", ", ", ". ", "\n", "!", "a-b"]
    return [(" ".join(rng.choices(some, [30, 20, 9, 9, 9, 9, 2, 2, 2, 2, 3, 3, 2, 1, 1], k=rng.randrange(60))), rng.choice(["en", "de", None])) for _ in range(n)]


def test_whole_table(spark, documents):
    want = brute([(r["text"], r["lang"]) for r in documents.collect()])
    assert want and found(documents) == want


@pytest.mark.parametrize("budget", [150, 100_000])
def test_split_prefixes_and_hot_phrases(spark, monkeypatch, budget):
    monkeypatch.setattr(P, "SLICE", 700)
    rows = noisy(300) + [("the " * 400, "en"), (None, "en"), ("", None), ("x" * 5000 + " the of", "en"), ("the of ok. " * 300, "de")]
    assert found(frame(spark, rows), budget=budget) == brute(rows)


def test_longer_phrases_and_a_short_list(spark):
    rows = noisy(150, 8)
    options = dict(words=4, least=5, percent=70, top=9)
    assert found(frame(spark, rows), budget=2000, **options) == brute(rows, 4, 5, 70, 9)


def test_no_words(spark):
    assert found(frame(spark, [])) == []
    assert found(frame(spark, [(None, None), (" .. ", "en")])) == []


def test_products_beyond_64_bits(spark):
    from pyspark.sql import functions as F

    row = spark.sql("select 20000000000L a, 30000000000L l, 40000000000L r")
    got = row.select(F.expr("(cast(1000000 as decimal(7,0)) * cast(a as decimal(19,0)) * cast(a as decimal(19,0))) div (cast(l as decimal(19,0)) * cast(r as decimal(19,0)))").alias("s"))
    assert got.first()["s"] == 10**6 * 20000000000**2 // (30000000000 * 40000000000)


def test_a_group_of_suffixes_fits_a_task():
    rng, n = np.random.default_rng(3), 300_000
    words = pa.array([f"w{k}" for k in range(20_000)], pa.large_string())
    cols = rng.integers(1, 20_001, (3, n), np.int32)
    tracemalloc.start()
    P._leaf_totals(cols, None, words, "en", 0, 10)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert (most + cols.nbytes) / n * 2 * P.BUDGET < 250e6
