import random
import re
from collections import defaultdict
from pathlib import Path

import pytest

from rankloom.llm import minhash
from rankloom.llm.common import shared_dir
from rankloom.llm.components import components


def word_sets(text, words=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(w[i : i + words]) for i in range(len(w) - words + 1)} if len(w) >= words else ({tuple(w)} if w else set())


def brute(rows, percent):
    """Sizes and components by comparing all pairs that share a shingle."""
    sets = {i: word_sets(t) for i, t in rows if i is not None}
    at, links = defaultdict(set), {i: i for i in sets}

    def root(x):
        while links[x] != x:
            x = links[x]
        return x

    for i, s in sets.items():
        for x in s:
            at[x].add(i)
    pairs = {(a, b) for members in at.values() for a in members for b in members if a < b}
    for a, b in pairs:
        shared = len(sets[a] & sets[b])
        if 100 * shared >= percent * (len(sets[a]) + len(sets[b]) - shared):
            x, y = sorted((root(a), root(b)))
            links[y] = x
    return {i: (len(s), root(i)) for i, s in sets.items()}


def found(df):
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in df.collect() if r["doc_id"] is not None}


@pytest.mark.parametrize("percent", [80, 85])
def test_whole_table(documents, percent):
    out = minhash.near_duplicates(documents, percent=percent)
    assert found(out) == brute([(r["doc_id"], r["text"]) for r in documents.collect()], percent)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in out.collect())


def test_odd_rows(odd_docs, no_docs):
    out = minhash.near_duplicates(odd_docs)
    assert found(out) == brute([(r["doc_id"], r["text"]) for r in odd_docs.collect()], 80)
    assert [r["component_id"] for r in out.collect() if r["doc_id"] is None] == [None]
    assert minhash.near_duplicates(no_docs).count() == 0
    assert minhash.one_of_each(odd_docs).schema == odd_docs.schema


def test_chains_templates_and_hubs(spark):
    """Chains whose ends are unlike, a template too thin to link, copies, and one large group."""
    rng, rows = random.Random(5), []
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(200)
    for _ in range(40):
        rows.append(template + fresh(90))
    chain = fresh(300)
    for k in range(12):
        chain = chain[:]
        chain[20 * k : 20 * k + 8] = fresh(8)
        rows.append(chain)
    hub = fresh(400)
    for _ in range(60):
        near = hub[:]
        near[rng.randrange(390)] = "changed"
        rows.append(near)
    rows += [hub] * 5 + [fresh(rng.randrange(1, 30)) for _ in range(30)]
    data = [(i, " ".join(r)) for i, r in enumerate(rows)]
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(4)
    for percent in (80, 85, 95):
        assert found(minhash.near_duplicates(docs, percent=percent)) == brute(data, percent)


def test_components(spark):
    rng = random.Random(2)
    pairs = [(k, k + 1) for k in range(100, 160)] + [(7, x) for x in range(300, 400)] + [(rng.randrange(50), rng.randrange(50)) for _ in range(30)]
    links = {x: x for p in pairs for x in p}

    def root(x):
        while links[x] != x:
            x = links[x]
        return x

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        links[y] = x
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {x: root(x) for x in links if any(x in p and p[0] != p[1] for p in pairs)}


def test_group_whose_copies_differ_and_a_chain(spark):
    """Copies of one text, most of them too far from each other, and a chain of small steps."""
    import random

    rng = random.Random(9)
    base = [f"b{i}" for i in range(160)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(rng.choice([1, 2, 5, 7])):
            words[rng.randrange(160)] = f"x{rng.randrange(10**6)}"
        rows.append((1000 + i, " ".join(words)))
    rows.append((5000, " ".join(base)))  # the one in the middle has the largest id
    chain = [f"c{i}" for i in range(120)]
    for i in range(60):
        chain[2 * i] = f"y{i}"
        rows.append((2000 + (i * 37) % 60, " ".join(chain)))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    out = {r["doc_id"]: r["component_id"] for r in minhash.near_duplicates(docs, percent=85).collect()}
    sets = {i: frozenset(zip(*[t.split()[k:] for k in range(5)])) for i, t in rows}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            both = len(sets[i] & sets[j])
            if 100 * both >= 85 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    assert out == {i: root(i) for i in ids}
    assert len(set(out.values())) > 3 and sum(v == out[2000] for v in out.values()) == 60


def test_stored_lists_grow_with_the_set_and_not_its_square(spark):
    """Long texts a little too far apart, so that their full sets are listed: a value carries few earlier ones along."""
    rng = random.Random(11)
    fresh = lambda n: [f"w{rng.randrange(10**9)}" for _ in range(n)]
    template = fresh(1740)
    data = [(i, " ".join(template + fresh(260))) for i in range(3)]
    shared = Path(shared_dir(spark).removeprefix("file:"))
    there = {*shared.iterdir()}
    docs = spark.createDataFrame(data, "doc_id bigint, text string").repartition(2)
    assert found(minhash.near_duplicates(docs)) == brute(data, 80)
    new = {p.name.rsplit("-", 1)[0]: spark.read.parquet(str(p)) for p in {*shared.iterdir()} - there}
    assert "before" not in new["listed-values"].columns
    sizes = [r[0] for r in new["full-listed"].selectExpr("size(before)").collect()]
    assert len(sizes) > 300 and max(sizes) == minhash.BEFORE
