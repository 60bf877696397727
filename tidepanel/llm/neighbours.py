"""Approximate nearest neighbours by learned partitions.

A bounded sample (``SAMPLE`` vectors) gives a graph of nearest neighbours. The graph is cut into balanced parts with few
edges between them, and a small classifier learns which parts a vector's neighbours lie in. The classifier then gives
every vector of the table its part, and routes each query to its most probable parts, as many as together have the
probability ``REACH``; all their vectors are compared with the query exactly.

Equal vectors are one candidate with its smallest ids, as many as can matter. A part is compared in blocks: a cell
holds one block of a part's vectors and one block of the queries routed to it, so no task's memory depends on how many
vectors or queries a part has, and a cell returns k rows per query.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, staged

SAMPLE = 4096
"""Bound of the vectors that the partition and the classifier are fitted on, chosen by a hash of their id."""
PART_SAMPLE = 128
"""Sampled vectors per part; hence SAMPLE / PART_SAMPLE parts at most."""
GRAPH_NEIGHBOURS = 10
REACH = 0.95
LEAST_PARTS = 2
BLOCK = 8192
QUERY_BLOCK = 1024
SALTS = 64


def unit(vectors: np.ndarray) -> np.ndarray:
    vectors = vectors / np.abs(vectors).max(axis=1, keepdims=True)  # first, so that squares neither overflow nor vanish
    return vectors / np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))


def neighbour_graph(vectors: np.ndarray, k: int) -> np.ndarray:
    """The k nearest other vectors of each vector, by cosine."""
    near = np.empty((len(vectors), k), dtype=np.int64)
    for at in range(0, len(vectors), 1024):
        likeness = vectors[at : at + 1024] @ vectors.T
        likeness[np.arange(len(likeness)), np.arange(at, at + len(likeness))] = -2
        near[at : at + 1024] = np.argpartition(-likeness, k - 1, axis=1)[:, :k]
    return near


def balanced_parts(near: np.ndarray, parts: int, seed: int = 7, sweeps: int = 30, slack: float = 1.1) -> np.ndarray:
    """Part of each node: parts of nearly equal size with few edges between them.

    Nodes start in runs of a breadth-first walk; sweeps then move nodes to the part of most of their neighbours, best
    gain first, into parts that have room and out of parts that can spare them.
    """
    n, k = near.shape
    rng = np.random.default_rng(seed)
    seen, walk = np.zeros(n, dtype=bool), []
    for start in rng.permutation(n):
        if seen[start]:
            continue
        seen[start] = True
        queue = [start]
        for node in queue:
            fresh = [x for x in near[node].tolist() if not seen[x]]
            seen[fresh] = True
            queue += fresh
        walk += queue
    part = np.empty(n, dtype=np.int64)
    part[walk] = np.arange(n) * parts // n
    sources, ends = np.repeat(np.arange(n), k), near.ravel()
    most, least = int(np.ceil(slack * n / parts)), int(n / parts / slack)
    for _ in range(sweeps):
        pull = np.zeros((n, parts))
        np.add.at(pull, (sources, part[ends]), 1.0)
        np.add.at(pull, (ends, part[sources]), 1.0)
        gain = pull - pull[np.arange(n), part][:, None]
        best = gain.argmax(axis=1)
        best_gain = gain[np.arange(n), best]
        sizes, moved = np.bincount(part, minlength=parts), 0
        for node in np.argsort(-best_gain):
            if best_gain[node] <= 0:
                break
            a, b = part[node], best[node]
            if sizes[b] < most and sizes[a] > least and rng.random() < 0.7:
                part[node] = b
                sizes[a] -= 1
                sizes[b] += 1
                moved += 1
        if not moved:
            break
    return part


@dataclass
class Router:
    """A softmax classifier of unit vectors into parts."""

    weights: np.ndarray
    bias: np.ndarray

    def probabilities(self, vectors: np.ndarray) -> np.ndarray:
        logits = vectors @ self.weights + self.bias
        logits -= logits.max(axis=1, keepdims=True)
        p = np.exp(logits)
        return p / p.sum(axis=1, keepdims=True)


def fit(sample: np.ndarray) -> Router:
    """The classifier, fitted on where each sampled vector and its neighbours lie. A small sample gives one part."""
    dim = sample.shape[1] if len(sample) else 1
    parts = len(sample) // PART_SAMPLE
    if parts < 2:
        return Router(np.zeros((dim, 1)), np.zeros(1))
    vectors = unit(sample)
    near = neighbour_graph(vectors, min(GRAPH_NEIGHBOURS, len(vectors) - 1))
    part = balanced_parts(near, parts)
    target = np.zeros((len(vectors), parts))
    for column in (np.arange(len(vectors)), *near.T):
        np.add.at(target, (np.arange(len(vectors)), part[column]), 1.0)
    target /= target.sum(axis=1, keepdims=True)
    router = Router(np.zeros((dim, parts)), np.zeros(parts))
    state = [[np.zeros_like(router.weights), np.zeros_like(router.weights)], [np.zeros_like(router.bias), np.zeros_like(router.bias)]]
    for step in range(1, 401):  # Adam on the cross entropy of all sampled vectors, with a small ridge
        error = (router.probabilities(vectors) - target) / len(vectors)
        for value, grad, (mean, square) in zip((router.weights, router.bias), (vectors.T @ error + 1e-6 * router.weights, error.sum(axis=0)), state, strict=True):
            mean += 0.1 * (grad - mean)
            square += 0.01 * (grad * grad - square)
            value -= 0.2 * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-12)
    return router


def usable(vector: Column) -> Column:
    """Neither null nor empty or zero, and without null or non-finite components."""
    whole = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vector.isNotNull() & F.coalesce(whole & F.exists(vector, lambda x: x != 0), F.lit(False))


def as_matrix(cells: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(cells), dtype="<f8").reshape(len(cells), -1)


def nearest(vectors: DataFrame, k: int = 5, every: int = 50) -> DataFrame:
    """The ``k`` nearest found of each row whose ``vec_id`` is divisible by ``every``, among all other rows.

    ``query_id``, ``rank`` from 1, ``vec_id``, ``score``: the cosine in double precision, ties to the smaller vec_id.
    A query that has fewer candidates gets them all. Rows with a null id or an unusable vector, or one whose length
    isn't the commonest one, take no part. Of rows that repeat an id, a query counts once, by its first vector in
    binary order, and a candidate as often as it has different vectors.
    """
    spark = vectors.sparkSession
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), F.desc("dim")).limit(1).collect()
    empty = "query_id bigint, rank int, vec_id bigint, score double"
    if not sizes:
        return spark.createDataFrame([], empty)
    dim, n = sizes[0]
    rows = rows.where(F.size("v") == dim)
    share = min(1.0, SAMPLE / n)
    chosen = rows.where(F.pmod(F.xxhash64(F.lit("fit"), "vec_id"), F.lit(1_000_000)) < int(share * 1_000_000)).select("v").limit(2 * SAMPLE)
    sample = np.array([r["v"] for r in chosen.collect()], dtype=np.float64).reshape(-1, dim)
    shared = spark.sparkContext.broadcast(fit(sample))  # dim x parts, both bounded
    parts = len(shared.value.bias)

    def placed(batches: Batches) -> Batches:
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.stack(batch["v"].to_numpy()).astype("<f8") + 0.0  # no negative zeros
            part = shared.value.probabilities(unit(matrix)).argmax(axis=1)
            keys = pd.Series([row.tobytes() for row in matrix])
            ids = pd.DataFrame({"vector": keys, "part": part, "vec_id": batch["vec_id"].to_numpy()}).drop_duplicates().sort_values("vec_id")
            ids = ids.groupby("vector", sort=False).head(k + 1)  # more of equal vectors can't be among the nearest
            yield ids.groupby(["vector", "part"], sort=False)["vec_id"].agg(list).reset_index(name="ids")

    # equal vectors of all tasks meet in two steps, so that a very common one is spread first
    found = rows.mapInPandas(placed, "vector binary, part int, ids array<bigint>").withColumn("salt", F.pmod(F.monotonically_increasing_id(), F.lit(SALTS)))
    fewest = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1).alias("ids")
    candidates = found.groupBy("vector", "part", "salt").agg(fewest).groupBy("vector", "part").agg(fewest)
    candidates = staged(candidates.withColumn("block_key", F.xxhash64("vector")))
    asked = rows.where(F.pmod("vec_id", F.lit(every)) == 0).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("v").alias("v"))
    counts = {r["part"]: (r["n"], r["ids"]) for r in candidates.groupBy("part").agg(F.count("*").alias("n"), F.sum(F.size("ids")).alias("ids")).collect()}
    blocks = [-(-counts.get(p, (0, 0))[0] // BLOCK) for p in range(parts)]
    members = np.array([counts.get(p, (0, 0))[1] for p in range(parts)])

    def routed(batches: Batches) -> Batches:
        for batch in batches:
            if not len(batch):
                continue
            matrix = np.stack(batch["v"].to_numpy()).astype("<f8") + 0.0
            p = shared.value.probabilities(unit(matrix))
            order = np.argsort(-p, axis=1, kind="stable")
            before = np.cumsum(np.take_along_axis(p, order, axis=1), axis=1) - np.take_along_axis(p, order, axis=1)
            met = np.cumsum(members[order], axis=1) - members[order]
            go = (before < REACH) | (np.arange(parts) < LEAST_PARTS) | (met < k + 1)
            rows, places = np.nonzero(go & (members[order] > 0))
            yield pd.DataFrame({"query_id": batch["query_id"].to_numpy()[rows], "vector": [matrix[r].tobytes() for r in rows], "part": order[rows, places]})

    queries = staged(asked.mapInPandas(routed, "query_id bigint, vector binary, part int"))
    query_counts = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count("*").alias("n")).collect()}
    query_blocks = [-(-query_counts.get(p, 0) // QUERY_BLOCK) for p in range(parts)]

    def at(values: list[int]) -> Column:
        return F.element_at(F.array(*map(F.lit, values)), F.col("part") + 1)

    def spread(side: DataFrame, key: Column, own: str, own_blocks: list[int], other: str, other_blocks: list[int]) -> DataFrame:
        """Every row in its own block, once for each block of the other side."""
        side = side.where((at(own_blocks) > 0) & (at(other_blocks) > 0)).withColumn(own, F.pmod(key, at(own_blocks)).cast("int"))
        return side.withColumn(other, F.explode(F.sequence(F.lit(0), at(other_blocks) - 1)))

    left = spread(candidates, F.col("block_key"), "block", blocks, "query_block", query_blocks).drop("block_key")
    right = spread(queries, F.xxhash64("query_id"), "query_block", query_blocks, "block", blocks)

    def compared(block: pd.DataFrame, asked: pd.DataFrame) -> pd.DataFrame:
        if not len(block) or not len(asked):
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        a, b = as_matrix(asked["vector"]), as_matrix(block["vector"])
        a_size, b_size = np.sqrt((a * a).sum(axis=1)), np.sqrt((b * b).sum(axis=1))
        keep = min(k + 1, len(b))
        out = []
        scores = (a @ b.T) / a_size[:, None] / b_size
        ids = block["ids"].to_numpy()
        for query, row, own in zip(asked["query_id"].to_numpy(), scores, a, strict=True):
            limit = np.partition(row, len(row) - keep)[len(row) - keep] - 1e-12
            near = np.flatnonzero(row >= limit)
            exact = (b[near] * own).sum(axis=1) / (np.sqrt((own * own).sum()) * b_size[near])
            pairs = sorted({(-s, i) for c, s in zip(near, exact.tolist(), strict=True) for i in ids[c] if i != query})[:k]
            out += [(query, i, -s) for s, i in pairs]
        return pd.DataFrame(out, columns=["query_id", "vec_id", "score"])

    cell = ["part", "block", "query_block"]
    near = left.groupBy(*cell).cogroup(right.groupBy(*cell)).applyInPandas(compared, "query_id bigint, vec_id bigint, score double")
    # k rows per query and cell it was compared in
    ranked = near.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")))
    return ranked.where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
