"""Hard-negative mining over an inverted multi-index, exact by certified windows.

Vectors are cut into two halves, each with a codebook fitted on a bounded sample; a pair of codewords is a cell, and
every row lies in one. A row's score for an anchor is at most, for each half, the anchor's product with the codeword
plus the anchor's length times the codeword's radius. A multi-sequence heap visits cells in falling order of the two
bounds' sum, and stops where no further cell can hold a row that still matters:

* positives: the cells that come first hold a few candidates, whose last score is the window's floor; every other cell
  that reaches the floor is visited next, none beyond;
* negatives: the same within each positive's window of scores, without the cells that lie wholly above all windows.

So each search takes two passes, and its result is exact whatever the codebooks are. A cell's rows lie in blocks of
bounded size, and the anchors that visit a block stream past it; no task holds more than one block and one batch of
anchors, and a block returns at most k rows for each window of an anchor.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, staged

SAMPLE = 4096
"""Bound of the vectors that the codebooks are fitted on, chosen by a hash of their id."""
CODEWORDS = 16
BLOCK = 4096
SEED_ROWS = 1024
"""Rows, about, of the cells that set the floor of a window."""
HASHES = 1 << 62
LEAST, MOST = -(1 << 63), (1 << 63) - 1
#: Fixed values of the contract: scale of components, labels, and the share of a positive's score that negatives may have.
SCALE, LABELS, LOW, HIGH = 256, 10, 30, 90


def quantised(vectors: pd.Series, kind: str) -> np.ndarray:
    with np.errstate(over="ignore"):
        found = np.floor(SCALE * np.stack(vectors.to_numpy()).astype(np.float64))
    return np.nan_to_num(found).astype(kind)


def codebook(points: np.ndarray, k: int, rounds: int = 12, seed: int = 5) -> np.ndarray:
    """``k`` centres, or fewer for fewer different points."""
    different = np.unique(points, axis=0)
    centres = different[np.sort(np.random.default_rng(seed).permutation(len(different))[:k])]
    for _ in range(rounds):
        nearest, _ = assigned(points, centres)
        sums = np.zeros_like(centres)
        np.add.at(sums, nearest, points)
        counts = np.bincount(nearest, minlength=len(centres))[:, None]
        centres = np.where(counts > 0, sums / np.maximum(counts, 1), centres)
    return centres


def assigned(points: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Nearest centre of each point and its distance, not understated by rounding."""
    with np.errstate(over="ignore", invalid="ignore"):
        far = (points * points).sum(axis=1)[:, None] - 2 * points @ centres.T + (centres * centres).sum(axis=1)
        nearest = np.nan_to_num(far, nan=np.inf).argmin(axis=1)
        gap = points - centres[nearest]
        distance = np.sqrt((gap * gap).sum(axis=1)) * (1 + 1e-9) + 1e-9
    return nearest, np.nan_to_num(distance, nan=np.inf, posinf=np.inf)


@dataclass
class Index:
    """Codebooks of the halves, and for each cell its rows, and the radii of its halves. ``CODEWORDS`` squared numbers."""

    centres: tuple[np.ndarray, np.ndarray]
    rows: np.ndarray
    radii: tuple[np.ndarray, np.ndarray]
    dim: int
    kind: str

    def halves(self, vector: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return vector[..., : self.dim // 2], vector[..., self.dim // 2 :]

    def blocks(self, cell: int) -> int:
        return -(-int(self.rows.flat[cell]) // BLOCK)

    def scores(self, vector: np.ndarray) -> tuple[list[np.ndarray], list[float], list[np.ndarray]]:
        """For both halves: products with the codewords, the vector's length, and the bound of each codeword."""
        products, lengths, bounds = [], [], []
        with np.errstate(over="ignore", invalid="ignore"):
            for half, centres, radii, axis in zip(self.halves(vector), self.centres, self.radii, (1, 0), strict=True):
                length = float(np.sqrt((half * half).sum()))
                product = centres @ half
                slack = 1e-9 * (1 + length * np.sqrt((centres * centres).sum(axis=1)))
                bound = product + length * radii.max(axis=axis) + slack
                products.append(product)
                lengths.append(length)
                bounds.append(np.nan_to_num(bound, nan=np.inf, posinf=np.inf))
        return products, lengths, bounds

    def visits(self, vector: np.ndarray) -> Iterator[tuple[float, float, float, int]]:
        """``(bound of this and all later cells, most, least, cell)`` of the cells that hold rows, by falling bound."""
        products, lengths, bounds = self.scores(vector)
        first, second = (np.argsort(-b, kind="stable") for b in bounds)
        b1, b2 = bounds[0][first].tolist(), bounds[1][second].tolist()
        with np.errstate(over="ignore", invalid="ignore"):
            middle = products[0][:, None] + products[1][None, :]
            reach = lengths[0] * self.radii[0] + lengths[1] * self.radii[1]
            reach = reach + 1e-9 * (2 + np.abs(middle) + lengths[0] * lengths[1])
            most, least = np.nan_to_num(middle + reach, nan=np.inf, posinf=np.inf), np.nan_to_num(middle - reach, nan=-np.inf, neginf=-np.inf)
        heap, seen = [(-(b1[0] + b2[0]), 0, 0)], {(0, 0)}
        while heap:
            bound, i, j = heapq.heappop(heap)
            for i2, j2 in ((i + 1, j), (i, j + 1)):
                if i2 < len(b1) and j2 < len(b2) and (i2, j2) not in seen:
                    seen.add((i2, j2))
                    heapq.heappush(heap, (-(b1[i2] + b2[j2]), i2, j2))
            a, b = int(first[i]), int(second[j])
            if self.rows[a, b]:
                yield -bound, float(most[a, b]), float(least[a, b]), a * self.rows.shape[1] + b

    def seeds(self, vector: np.ndarray, low: float, high: float) -> list[int]:
        """The first cells of the sequence that may hold scores from ``low`` to ``high``, about ``SEED_ROWS`` rows."""
        out, rows = [], 0
        for bound, most, least, cell in self.visits(vector):
            if bound < low or rows >= SEED_ROWS:
                break
            if least <= high and most >= low:
                out.append(cell)
                rows += int(self.rows.flat[cell])
        return out

    def certified(self, vector: np.ndarray, lows: list[int], highs: list[int]) -> list[int]:
        """Every cell that may hold a score inside one of the windows; the sequence ends below the lowest one."""
        out, floor = [], min(lows)
        for bound, most, least, cell in self.visits(vector):
            if bound < floor:
                break
            if any(most >= low and least <= high for low, high in zip(lows, highs, strict=True)):
                out.append(cell)
        return out


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact integer inner products; beyond the range of a long its ends."""
    size = max(a.shape[1], 1) * float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0))
    if size < 1 << 53:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    whole = [[int(x) for x in row] for row in b.tolist()]
    out = [[min(max(sum(int(x) * y for x, y in zip(row, other, strict=True)), LEAST), MOST) for other in whole] for row in a.tolist()]
    return np.array(out, dtype=np.int64).reshape(len(a), len(b))


FOUND = "anchor_id bigint, place int, vec_id bigint, score bigint"
REQUEST = "cell int, block int, anchor_id bigint, label bigint, vector binary, lows array<bigint>, highs array<bigint>"


def searched(placed: DataFrame, requests: DataFrame, index: Index, same: bool, k: int) -> DataFrame:
    """For each window of a request, the best ``k`` rows of the block, of the anchor's own label or of others."""

    def compared(batches: Batches) -> Batches:
        at, held, ids, labels, matrix = None, [], None, None, None

        def vectors(column: pd.Series) -> np.ndarray:
            return np.frombuffer(b"".join(column), dtype=index.kind).reshape(len(column), index.dim)

        for batch in batches:
            out = []
            for place, rows in batch.groupby(["cell", "block"], sort=False):
                if place != at:
                    at, held, matrix = place, [], None
                asks = rows["lows"].notna()
                if not asks.all():
                    held.append(rows.loc[~asks, ["vec_id", "label", "vector"]])
                rows = rows[asks]
                if not len(rows) or not held:
                    continue
                if matrix is None:
                    block = pd.concat(held)
                    ids, labels, matrix = block["vec_id"].to_numpy(np.int64), block["label"].to_numpy(np.int64), vectors(block["vector"])
                scores = products(vectors(rows["vector"]), matrix)
                lows, highs = rows["lows"].to_numpy(), rows["highs"].to_numpy()
                own = rows["label"].to_numpy(np.int64)[:, None] == labels
                anchors = rows["anchor_id"].to_numpy(np.int64)
                fits = (own == same) & (ids != anchors[:, None])
                fits &= (scores >= np.array([min(x) for x in lows])[:, None]) & (scores <= np.array([max(x) for x in highs])[:, None])
                for r in np.flatnonzero(fits.any(axis=1)):
                    near = np.flatnonzero(fits[r])
                    near = near[np.lexsort((ids[near], -scores[r, near]))]
                    found = scores[r, near]
                    for w, (low, high) in enumerate(zip(lows[r], highs[r], strict=True)):
                        best = near[(found >= low) & (found <= high)][:k]
                        out += [(anchors[r], w, ids[c], scores[r, c]) for c in best]
            yield pd.DataFrame(out, columns=["anchor_id", "place", "vec_id", "score"])

    rows = placed.select("cell", "block", "vec_id", "label", "vector").unionByName(requests, allowMissingColumns=True)
    rows = rows.repartition("cell", "block").sortWithinPartitions("cell", "block", F.col("lows").isNotNull())
    return rows.mapInPandas(compared, FOUND)


def best(found: DataFrame, k: int) -> DataFrame:
    """The best ``k`` rows of each window: of at most k from each block that was visited."""
    rank = F.row_number().over(Window.partitionBy("anchor_id", "place").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def mined(vectors: DataFrame, every: int = 100, positives: int = 5, negatives: int = 10) -> DataFrame:
    """Hard negatives of each anchor (a row whose ``vec_id`` is divisible by ``every``) and each of its positives.

    ``anchor_id``, ``positive_id``, ``rank`` (from 1), ``negative_id``, ``positive_score``, ``negative_score``. Scores are
    integer inner products of floor(256 * x), higher ones first, ties by smaller id. Positives are an anchor's first
    ``positives`` other rows of its label; negatives the first ``negatives`` rows of other labels whose score is 30 to 90
    hundredths of the positive's, so a negative positive score has none. A label moves on by one, modulo 10, where
    vec_id is divisible by 7.

    Rows with a null id, label, vector or component, or a component that isn't finite, take no part, nor do vectors
    whose length isn't the commonest one (of equally common ones the longest). Of rows that repeat an id the one of the
    smallest label, then of the smallest quantised vector in binary order, counts. Scores beyond a long are its ends. An empty table gives no rows;
    columns beyond vec_id, embedding and label play no part, whatever their names.
    """
    spark = vectors.sparkSession
    result = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"
    rows = vectors.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), F.col("embedding").cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = rows.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull() & F.coalesce(finite, F.lit(False)))
    widest = F.max(F.array_max(F.transform("v", lambda x: F.abs(x))))
    sizes = rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), widest.alias("widest")).orderBy(F.desc("n"), F.desc("dim")).first()
    if sizes is None:
        return spark.createDataFrame([], result)
    dim, n = sizes["dim"], sizes["n"]
    limit = SCALE * (sizes["widest"] or 0) + 1
    kind = "<i2" if limit < 1 << 15 else "<i4" if limit < 1 << 31 else "<f8"
    rows = rows.where(F.size("v") == dim)
    rows = rows.withColumn("label", F.when(F.pmod("vec_id", F.lit(7)) == 0, F.pmod(F.col("label") + 1, F.lit(LABELS))).otherwise(F.col("label")))

    chosen = rows.where(F.pmod(F.xxhash64(F.lit("codebook"), "vec_id"), F.lit(HASHES)) < int(HASHES * min(1.0, SAMPLE / n))).select("v").limit(2 * SAMPLE)
    sample = chosen.toPandas()["v"]
    points = quantised(sample, "<f8") if len(sample) else np.zeros((1, dim))
    centres = codebook(points[:, : dim // 2], CODEWORDS), codebook(points[:, dim // 2 :], CODEWORDS)
    wide = len(centres[1])

    def packed(batches: Batches) -> Batches:
        for batch in batches:
            if len(batch):
                yield batch[["vec_id", "label"]].assign(vector=[x.tobytes() for x in quantised(batch["v"], kind)])

    def assign(batches: Batches) -> Batches:
        for batch in batches:
            if not len(batch):
                continue
            v = np.frombuffer(b"".join(batch["vector"]), dtype=kind).reshape(len(batch), dim).astype(np.float64)
            (first, far), (second, further) = assigned(v[:, : dim // 2], centres[0]), assigned(v[:, dim // 2 :], centres[1])
            yield batch.assign(cell=first * wide + second, d1=far, d2=further)

    single = rows.mapInPandas(packed, "vec_id bigint, label bigint, vector binary").groupBy("vec_id").agg(F.min(F.struct("label", "vector")).alias("row"))
    single = single.select("vec_id", "row.label", "row.vector")
    placed = staged(single.mapInPandas(assign, "vec_id bigint, label bigint, vector binary, cell int, d1 double, d2 double"))
    shape = len(centres[0]), wide
    counts, radii = np.zeros(shape, dtype=np.int64), (np.zeros(shape), np.zeros(shape))
    for r in placed.groupBy("cell").agg(F.count("*").alias("n"), F.max("d1").alias("d1"), F.max("d2").alias("d2")).collect():  # a row per cell
        counts.flat[r["cell"]], radii[0].flat[r["cell"]], radii[1].flat[r["cell"]] = r["n"], r["d1"], r["d2"]
    index = Index(centres, counts, radii, dim, kind)
    shared = spark.sparkContext.broadcast(index)
    blocks = F.element_at(F.array(*(F.lit(max(index.blocks(c), 1)) for c in range(counts.size))), F.col("cell") + 1)
    placed = placed.withColumn("block", F.pmod(F.xxhash64("vec_id"), blocks).cast("int"))
    anchors = placed.where(F.pmod("vec_id", F.lit(every)) == 0).select(F.col("vec_id").alias("anchor_id"), "label", "vector")

    def requests(asked: DataFrame, first: bool) -> DataFrame:
        """Visits of the cells that set floors, or of those that the floors leave; without the former ones."""

        def visit(batches: Batches) -> Batches:
            index = shared.value
            for batch in batches:
                out = []
                for row in batch.to_dict("records"):
                    vector = np.frombuffer(row["vector"], dtype=index.kind).astype(np.float64)
                    lows, highs, floors = ([int(x) for x in row[c]] for c in ("lows", "highs", "floors"))
                    cells = index.seeds(vector, min(lows), max(highs))
                    if not first:
                        met = set(cells)
                        cells = [c for c in index.certified(vector, floors, highs) if c not in met]
                    own = (row["anchor_id"], row["label"], row["vector"], lows if first else floors, highs)
                    out += [(c, b, *own) for c in cells for b in range(index.blocks(c))]
                yield pd.DataFrame(out, columns=[x.split()[0] for x in REQUEST.split(", ")])

        return asked.mapInPandas(visit, REQUEST)

    def search(asked: DataFrame, same: bool, k: int) -> DataFrame:
        """Two passes over the index for ``asked(anchor_id, label, vector, lows, highs)``."""
        asked = staged(asked)
        seeds = staged(best(searched(placed, requests(asked.withColumn("floors", F.col("lows")), True), index, same, k), k).drop("rank"))
        full = seeds.groupBy("anchor_id", "place").agg(F.count("*").alias("n"), F.min("score").alias("floor")).where(F.col("n") >= k)
        full = full.groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("place", "floor"))).alias("full"))  # a window each
        floors = F.transform("lows", lambda low, w: F.coalesce(F.try_element_at("full", w.cast("int")), low))
        again = asked.join(full, "anchor_id", "left").withColumn("floors", F.coalesce(floors, F.col("lows"))).drop("full")
        return staged(best(seeds.unionByName(searched(placed, requests(again, False), index, same, k)), k))

    whole = anchors.withColumns({"lows": F.array(F.lit(LEAST)), "highs": F.array(F.lit(MOST))})
    near = search(whole, True, positives).select("anchor_id", (F.col("rank") - 1).alias("place"), F.col("vec_id").alias("positive_id"), F.col("score").alias("positive_score"))
    score = F.col("positive_score").cast("decimal(20,0)")
    windows = near.withColumns({"low": F.ceil(score * LOW / 100).cast("bigint"), "high": F.floor(score * HIGH / 100).cast("bigint")}).where("low <= high")
    asked = windows.groupBy("anchor_id").agg(F.array_sort(F.collect_list(F.struct("place", "low", "high"))).alias("w"))  # ``positives`` at most
    # a window keeps its number even where one before it is empty
    asked = asked.withColumns({"lows": F.col("w.low"), "highs": F.col("w.high"), "places": F.col("w.place")}).drop("w")
    asked = staged(asked)
    found = search(anchors.join(asked.drop("places"), "anchor_id"), False, negatives)
    found = found.join(asked.select("anchor_id", "places"), "anchor_id").withColumn("place", F.element_at("places", F.col("place") + 1)).drop("places")
    return found.join(near, ["anchor_id", "place"]).select(
        "anchor_id", "positive_id", F.col("rank").cast("int").alias("rank"), F.col("vec_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
