import hashlib
import random
import re

import numpy as np
import pytest

from rankloom.llm import substring_dedup as S
from rankloom.llm.fm_index import FmIndex

FIELDS = "doc_id bigint, text string, part string, anchor int, found string, sha string"


def brute(rows, window=20):
    docs = [(i, re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in rows]
    seen = {}
    for i, w in docs:
        if i is not None:
            for s in range(len(w) - window + 1):
                key = tuple(w[s : s + window])
                seen[key] = min(seen.get(key, (i, s)), (i, s))
    out = []
    for i, w in docs:
        gone = set()
        if i is not None:
            for s in range(len(w) - window + 1):
                if seen[tuple(w[s : s + window])] < (i, s):
                    gone |= set(range(s, s + window))
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out)


def found(df, **options):
    rows = S.without_repeats(df, **options).collect()
    assert all(sum(x["to"] - x["from"] for x in r["removed"]) == r["n_removed"] for r in rows)
    return sorted((str(r["doc_id"]), r["n_words"], r["n_removed"], r["kept_sha256"]) for r in rows)


def frame(spark, rows):
    return spark.createDataFrame([(*r, "p", 1, "f", "s") for r in rows], FIELDS).repartition(4)


def passages(n, seed=1):
    rng = random.Random(seed)
    some = [" ".join(rng.choices("abcdefgh", k=rng.randrange(15, 60))) for _ in range(8)]
    gaps = ["\n", " ", "\t", "\x0b", " A "]
    return [(i, rng.choice(gaps).join(rng.choice([rng.choice(some), " ".join(f"w{rng.randrange(999)}" for _ in range(30))]) for _ in range(rng.randrange(7)))) for i in range(n)]


def test_whole_table(documents):
    assert found(documents) == brute([(r["doc_id"], r["text"]) for r in documents.collect()])


@pytest.mark.parametrize("hot", [3, 10_000])
def test_passages_shards_and_hot_anchors(spark, hot):
    rows = passages(150) + [(900 + i, "one text of many copies " * 9) for i in range(60)] + [(2000, "x " * 400), (2001, "x " * 300), (None, "x " * 50), (3000, None), (3001, "")]
    rows += [(4000, "zero " + "x " * 40_000)]
    assert found(frame(spark, rows), hot=hot, shard=3000) == brute(rows)


def test_repeated_ids_and_nothing(spark):
    base = " ".join(f"w{i}" for i in range(60))
    rows = [(1, base), (1, base), (1, base.replace(" ", "  ")), (2, base + " tail"), (2, "head " + base), (3, "short")]
    out = found(frame(spark, rows))
    assert [x[2] for x in out if x[0] == "1"] == [0, 0, 0] and sorted(x[2] for x in out if x[0] == "2") == [60, 60]
    assert found(frame(spark, [])) == []


def test_other_windows(spark):
    rows = passages(60, 3)
    assert found(frame(spark, rows), window=9, anchor=3) == brute(rows, 9)


def test_matching_statistics():
    rng = np.random.default_rng(4)
    text = np.concatenate([np.append(rng.integers(1, 4, rng.integers(1, 40)), 0) for _ in range(30)])
    patterns = rng.integers(1, 5, 200)
    known = np.where(patterns == 4, -1, patterns)
    sizes = np.array([70, 0, 130])
    index = FmIndex(text, 8)
    hay = "".join(map(str, text))
    got = {}
    for _, at, length, lo, hi in index.matching(known, np.cumsum(sizes), sizes, 7):
        for a, n, x, y in zip(at, length, lo, hi):
            got[int(a)] = (int(n), int(y - x))
    for a in range(200):
        end = 70 if a < 70 else 200
        n = max(k for k in range(8) if a + k <= end and "".join(map(str, patterns[a : a + k])) in hay)
        want = sum(hay.startswith("".join(map(str, patterns[a : a + n])), i) for i in range(len(hay))) if n else len(text)
        assert got[a] == (n, want)
