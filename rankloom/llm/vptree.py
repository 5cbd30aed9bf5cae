"""Nearest neighbours by vantage-point trees, one per shard of the vectors.

Inner products are searched as distances: every vector of a shard gets one more component that brings
it to the length M of the shard's longest, queries get a zero, and the largest inner product is then the
smallest distance. A node keeps a vantage point and, for either half of its vectors, the range of their
distances to it. A half is skipped when ``factor`` times the gap between the query's distance and that
range reaches the distance of its k-th best vector so far: factor 1 is exact. Larger ones skip more, and
are no bound at all where lengths differ: all distances are then about M, however well a vector fits.

Equal vectors of a shard stand in its tree once, with their smallest k + 1 ids; more cannot be among k
results. Trees are searched by blocks of queries with matrix products; the scores returned are sums in
double precision over the original components.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankloom.llm.common import stored

K = 20
#: The only factor that misses nothing whatever the lengths of the vectors are.
FACTOR = 1.0
#: Share of the lengths that rounding can take from or add to a distance.
ROUNDING = 1e-6
SHARD, LEAF, BLOCK = 16_384, 512, 1024


def usable(vector: str) -> Column:
    """Not null, without null or non-finite components, not zero."""
    v = F.col(f"`{vector}`")
    bad = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return v.isNotNull() & ~bad & F.exists(v, lambda x: x != 0)


class Tree:
    """A vantage-point tree over the rows of ``points`` (distances are Euclidean)."""

    def __init__(self, points: np.ndarray, leaf: int, seed: int = 1):
        self.points, self.order, self.nodes = points, np.arange(len(points)), []
        self.rng = np.random.default_rng(seed)
        self.leaf = leaf
        self.longest = np.sqrt((points**2).sum(1).max(initial=0))
        self._build(0, len(points))

    def _build(self, lo: int, hi: int) -> int:
        at = len(self.nodes)
        self.nodes.append(None)
        if hi - lo <= self.leaf:
            self.nodes[at] = (lo, hi, None)
            return at
        own = self.order[lo:hi]
        vantage = self.points[own[self.rng.integers(hi - lo)]]
        far = np.sqrt(((self.points[own] - vantage) ** 2).sum(1))
        half = (hi - lo) // 2
        split = np.argpartition(far, half)
        self.order[lo:hi] = own[split]
        far = far[split]
        ranges = (far[:half].min(), far[:half].max(), far[half:].min(), far[half:].max())
        self.nodes[at] = (lo, hi, (vantage, ranges, self._build(lo, lo + half), self._build(lo + half, hi)))
        return at

    def search(self, queries: np.ndarray, k: int, factor: float, skip: np.ndarray | None = None) -> list[np.ndarray]:
        """For each query the rows of ``points`` that may be among its k nearest (ties and rounding included)."""
        n = len(queries)
        best = np.full((n, k), np.inf)
        found: list[list[tuple[np.ndarray, np.ndarray]]] = [[] for _ in range(n)]
        norms = (queries**2).sum(1)
        slack = ROUNDING * (np.sqrt(norms) + self.longest)

        def leaf(node: int, active: np.ndarray) -> None:
            lo, hi, _ = self.nodes[node]
            rows = self.order[lo:hi]
            own = self.points[rows]
            d2 = norms[active, None] + (own**2).sum(1)[None] - 2 * queries[active] @ own.T
            d = np.sqrt(np.maximum(d2, 0))
            merged = np.concatenate([best[active], d], 1)
            kth = min(k, merged.shape[1]) - 1
            best[active] = np.partition(merged, kth, 1)[:, :k]
            limit = best[active].max(1) + slack[active]
            for i, q in enumerate(active):
                near = d[i] <= limit[i]
                if near.any():
                    found[q].append((rows[near], d[i][near]))

        def walk(node: int, active: np.ndarray) -> None:
            _, _, inner = self.nodes[node]
            if inner is None:
                leaf(node, active)
                return
            vantage, (a, b, c, d), near, far = inner
            at = np.sqrt(((queries[active] - vantage) ** 2).sum(1))
            first = np.abs(at - (a + b) / 2) <= np.abs(at - (c + d) / 2)
            sides = ((near, a, b), (far, c, d))
            for mine, turn in ((first, (0, 1)), (~first, (1, 0))):
                if not mine.any():
                    continue
                for side in turn:
                    child, lo, hi = sides[side]
                    gap = np.maximum(0, np.maximum(at[mine] - hi, lo - at[mine]))
                    go = factor * gap <= best[active[mine]].max(1) + slack[active[mine]]
                    if go.any():
                        walk(child, active[mine][go])

        if n and len(self.points):
            walk(0, np.arange(n))
        out = []
        for q in range(n):
            rows = np.concatenate([r for r, _ in found[q]]) if found[q] else np.empty(0, np.int64)
            d = np.concatenate([x for _, x in found[q]]) if found[q] else np.empty(0)
            out.append(rows[d <= best[q].max() + slack[q]])
        return out


def _exact(q: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Inner products summed in one fixed order, so equal vectors score exactly alike."""
    total = np.zeros(len(rows))
    for j in range(rows.shape[1]):
        total += rows[:, j] * q[j]
    return total


def nearest(
    vectors: DataFrame, queries: DataFrame, *, id: str = "vec_id", vector: str = "embedding", k: int = K, factor: float = FACTOR,
    shard: int = SHARD, block: int = BLOCK,
) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k largest inner products of each query, found by trees.

    Candidates are all rows but those with the query's own id. Ties go to the smaller id. Vectors that
    are null, zero or hold null or non-finite components take no part; all others must have one length.
    Every vector is indexed, in the shard its id's hash gives; a shard holds about ``shard`` of them and
    is one task's memory, a block of queries meets every shard. Rows that repeat an id are candidates
    each. No vectors or no queries give no rows.
    """
    spark = vectors.sparkSession
    own = vectors.filter(usable(vector) & F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").cast("bigint").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v")
    )
    count = own.count()
    if not count:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    shards = -(-count // shard)
    asked = queries.filter(usable(vector) & F.col(f"`{id}`").isNotNull()).select(
        F.col(f"`{id}`").cast("bigint").alias("id"), F.transform(F.col(f"`{vector}`"), lambda x: x.cast("double")).alias("v")
    )
    blocks = max(1, -(-asked.count() // block))

    def packed(rows: DataFrame, key: str, parts: int, salt: str) -> DataFrame:
        """One row per ``key`` with its ids and vectors as bytes, by the hash of the id."""

        def run(frame: pd.DataFrame) -> pd.DataFrame:
            order = np.argsort(frame["id"].values, kind="stable")
            ids = frame["id"].values[order].astype("<i8")
            data = np.stack(frame["v"].values)[order].astype("<f8")
            return pd.DataFrame({key: [frame[key].iloc[0]], "ids": [ids.tobytes()], "data": [data.tobytes()]})

        keyed = rows.withColumn(key, F.pmod(F.xxhash64("id", F.lit(salt)), F.lit(parts)).cast("int"))
        return keyed.groupBy(key).applyInPandas(run, f"{key} int, ids binary, data binary")

    index = stored(packed(own, "shard", shards, "shard"), "vector-shards")
    asked = stored(packed(asked, "block", blocks, "block"), "query-blocks")
    everywhere = asked.withColumnRenamed("ids", "q_ids").withColumnRenamed("data", "q_data").withColumn(
        "shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))
    )
    pairs = everywhere.join(index, "shard").repartition(min(shards * blocks, 10_000), "shard", "block")

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        built, tree = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                one = {n: batch.column(c)[row].as_py() for c, n in enumerate(batch.schema.names)}
                if one["shard"] != built:
                    ids, starts, points, lifted = _prepared(one)
                    tree, built = Tree(lifted, LEAF), one["shard"]
                q_ids = np.frombuffer(one["q_ids"], "<i8")
                q = np.frombuffer(one["q_data"], "<f8").reshape(len(q_ids), -1)
                # one more, as the query's own vector does not count
                near = tree.search(np.hstack([q, np.zeros((len(q), 1))]), k + 1, factor)
                out = ([], [], [])
                for qid, own_q, rows in zip(q_ids, q, near):
                    score = _exact(own_q, points[rows])
                    best = sorted(
                        (-s, int(i)) for r, s in zip(rows, score) for i in ids[starts[r] : min(starts[r + 1], starts[r] + k + 1)] if i != qid
                    )[:k]
                    out[0].extend([int(qid)] * len(best))
                    out[1].extend(i for _, i in best)
                    out[2].extend(-s for s, _ in best)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(out[0], pa.int64()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.float64())],
                    names=["query_id", "vec_id", "score"],
                )

    hits = pairs.mapInArrow(search, "query_id bigint, vec_id bigint, score double")
    # at most k rows per query and shard
    top = hits.groupBy("query_id").agg(
        F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("less"), "vec_id", "score"))), 1, k).alias("best")
    )
    return top.select("query_id", F.posexplode("best").alias("at", "x")).select(
        "query_id", (F.col("at") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score")
    )


def _prepared(one: dict):
    """Ids grouped by equal vector (ascending), where each group starts, the distinct vectors, and these lifted."""
    ids = np.frombuffer(one["ids"], "<i8")
    data = np.frombuffer(one["data"], "<f8").reshape(len(ids), -1) + 0.0
    points, group = np.unique(data, axis=0, return_inverse=True)
    group = group.reshape(-1)
    order = np.lexsort((ids, group))
    starts = np.concatenate([np.searchsorted(group[order], np.arange(len(points))), [len(ids)]])
    squares = (points**2).sum(1)
    rest = np.sqrt(squares.max() - squares)
    return ids[order], starts, points, np.hstack([points, rest[:, None]])
