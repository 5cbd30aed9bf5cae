import hashlib
import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from rankloom.llm import conversation_trie as T
from rankloom.llm import list_ranking

FIELDS = "conv_id bigint, turn bigint, role string, text string, depth int, bytes string, next string"


def brute(rows):
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            own[c].append(((turn is not None, turn or 0), role or "", hashlib.sha256((text or "").encode()).digest(), text or ""))
    told = {c: [(r, t) for _, r, _, t in sorted(v)] for c, v in own.items()}
    members, bytes_of = defaultdict(list), {}
    rebuilt = {}
    for c, turns in told.items():
        h = zlib.crc32(str(c).encode()) % 9
        rebuilt[c] = told.get(c - int(c % 5 if c >= 0 else -(-c % 5)), [])[:h] + turns[h:]
        for d in range(len(rebuilt[c]) + 1):
            members[tuple(rebuilt[c][:d])].append(c)
            bytes_of[tuple(rebuilt[c][:d])] = len(rebuilt[c][d - 1][1].encode()) if d else 0
    children = defaultdict(int)
    for k in members:
        if k:
            children[k[:-1]] += 1
    leaves, saved = defaultdict(int), defaultdict(int)
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(m) - 1) * bytes_of[k]
    return sorted(
        (
            min(m), len(k), min(members[k[:-1]]) if k else -1, len(m), children[k], leaves[k], saved[k],
            hashlib.sha256(",".join(str(c) for c in sorted(m) if len(rebuilt[c]) == len(k)).encode()).hexdigest(),
        )
        for k, m in members.items()
    )


def found(table):
    out = T.prefix_trie(*T.shared_starts(T.ordered_turns(table), 5, 9)).fillna(-1, ["parent_conv_id"])
    rows = out.collect()
    assert len({r["enters_at"] for r in rows}) == len(rows)
    return sorted(tuple(r)[:-1] for r in rows)


def table(spark, rows):
    return spark.createDataFrame([(*r, 1, "b", "n") for r in rows], FIELDS).repartition(3)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert found(table(spark, rows)) == brute(rows)


def test_odd_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 3)
    monkeypatch.setattr(T, "IDS", 4)
    monkeypatch.setattr(list_ranking, "LEFT", 60)
    rows = [(1, None, "user", "a"), (1, 0, None, None), (1, 0, None, None), (2, 5, "user", "x" * 200_000), (None, 1, "user", "lost")]
    rows += [(-7, t, "user", str(t)) for t in range(30)] + [(-5, t, "user", str(t)) for t in range(40)]
    rng = random.Random(3)
    rows += [(c, t, rng.choice(["user", "", None]), rng.choice(["a", "", None])) for c in range(20, 80) for t in range(rng.randrange(1, 14))]
    rows += [(c, 0, "system", "same") for c in range(100, 200)]  # many equal, many turnless
    assert found(table(spark, rows)) == brute(rows)


def test_one_conversation_holds_most_rows(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK", 16)
    rows = [(5, t, "user", f"{t % 7}") for t in range(600)] + [(c, t, "user", "hi") for c in range(6, 60) for t in range(3)]
    assert found(table(spark, rows)) == brute(rows)


def test_no_rows(spark):
    assert found(table(spark, [])) == []
    assert found(table(spark, [(None, 1, "a", "b")])) == []


def test_as_they_are(spark):
    rows = [(c, t, "user", f"{t}{c if t > 2 else ''}") for c in (1, 2, 3) for t in range(5)]
    out = {(r["conv_id"], r["depth"]): r for r in T.prefix_trie(*T.whole(T.ordered_turns(table(spark, rows)))).collect()}
    assert len(out) == 4 + 3 * 2 and out[1, 3]["n_children"] == 3 and out[1, 0]["n_leaves"] == 3 and out[1, 0]["saved_tokens"] == 6


def test_sums_along_a_list(spark, monkeypatch):
    monkeypatch.setattr(list_ranking, "LEFT", 20)
    order = list(range(60))
    random.Random(1).shuffle(order)
    rows = [(a, b, a % 7) for a, b in zip(order, [*order[1:], None])]
    links = spark.createDataFrame(rows, "at int, next int, w bigint").repartition(4)
    want, total = {}, 0
    for a in order:
        want[a] = total
        total += a % 7
    assert {r["at"]: r["w"] for r in list_ranking.sums_before(links, ["w"]).collect()} == want
    ring = links.withColumn("next", F.coalesce("next", F.lit(order[0])))
    with pytest.raises(Exception, match="not one list"):
        list_ranking.sums_before(ring, ["w"]).collect()
