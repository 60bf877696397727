"""Document fingerprints from prefix polynomial hashes.

For a text c_0 c_1 ... the array P[i] = sum of (c_k + 1) b^k over k < i, modulo 2**31 - 1, gives the hash of any span
as (P[j] - P[i]) b^-i, so two spans are compared in constant time, and the longest common extension of two places is
found by binary search. Two bases together tell whole texts apart; the spans of ``SPAN`` code points are hashed with
the first one.

A fingerprint is the text's length, its two whole hashes, and the ``KEPT`` smallest mixed hashes of its spans, a
bottom-k sketch. Likeness of two fingerprints is the Dice share of common spans, 2 J / (1 + J), estimated on the
smallest hashes of both together; it is exact where both texts have at most ``KEPT`` different spans.

A text whose second part is replaced needs no hashing of its own: its prefix hashes and spans follow from the two
texts' arrays, but for the few spans across the joint.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, code_points, texts_of

MODULUS = np.uint64((1 << 31) - 1)
BASES = (1_000_003, 805_306_457)
SPAN = 12
KEPT = 64


def reduced(x: np.ndarray) -> np.ndarray:
    """``x`` modulo 2**31 - 1, for x below 2**62."""
    x = (x & MODULUS) + (x >> np.uint64(31))
    x = (x & MODULUS) + (x >> np.uint64(31))
    return np.where(x == MODULUS, np.uint64(0), x)


class Powers:
    """Powers of a base and of its inverse, as many as have been asked for."""

    def __init__(self, base: int) -> None:
        self.up = np.array([1], dtype=np.uint64)
        self.down = self.up
        self.steps = [base, pow(base, -1, int(MODULUS))]

    def upto(self, n: int) -> None:
        while len(self.up) <= n:
            k = len(self.up)
            self.up = np.concatenate((self.up, reduced(self.up * np.uint64(pow(self.steps[0], k, int(MODULUS))))))
            self.down = np.concatenate((self.down, reduced(self.down * np.uint64(pow(self.steps[1], k, int(MODULUS))))))


POWERS = [Powers(b) for b in BASES]


def mixed(hashes: np.ndarray) -> np.ndarray:
    """31-bit hashes spread over 32 bits."""
    x = hashes * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    return ((x * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(32)).astype(np.uint32)


class Prefixes:
    """The prefix hashes of one text and what they answer."""

    def __init__(self, text: str) -> None:
        self.text, self.points = text, code_points(text).astype(np.uint64)
        self.n = len(self.points)
        self.sums = []
        for power in POWERS:
            power.upto(self.n)
            steps = reduced((self.points + np.uint64(1)) * power.up[: self.n])
            self.sums.append(np.concatenate((np.zeros(1, np.uint64), reduced(np.cumsum(steps)))))
        self.spans = span_hashes(self.sums[0], SPAN)

    def hash(self, start: int, end: int) -> tuple[int, int]:
        """Hashes of the span from ``start`` to before ``end``."""
        p = int(MODULUS)
        return tuple((int(s[end]) - int(s[start])) * int(w.down[start]) % p for s, w in zip(self.sums, POWERS, strict=True))  # type: ignore[return-value]

    def extension(self, start: int, other: Prefixes, at: int) -> int:
        """Length of the longest span that begins at ``start`` here and at ``at`` in the other text."""
        low, high = 0, min(self.n - start, other.n - at)
        while low < high:
            mid = (low + high + 1) // 2
            if self.hash(start, start + mid) == other.hash(at, at + mid):
                low = mid
            else:
                high = mid - 1
        return low


def span_hashes(sums: np.ndarray, width: int) -> np.ndarray:
    """Mixed hashes of all spans of ``width`` points; of the whole text, if it is shorter; none of an empty one."""
    n = len(sums) - 1
    width = min(width, n)
    if not width:
        return np.zeros(0, np.uint32)
    hashes = reduced((sums[width:] + MODULUS - sums[:-width]) * POWERS[0].down[: n - width + 1])
    return mixed(hashes)


def smallest(hashes: np.ndarray) -> np.ndarray:
    """The ``KEPT`` smallest different hashes, ascending."""
    if len(hashes) > 16 * KEPT:
        found = np.unique(np.partition(hashes, 4 * KEPT)[: 4 * KEPT])
        if len(found) >= KEPT:
            return found[:KEPT]
    return np.unique(hashes)[:KEPT]


def written(n: int, whole: tuple[int, ...], kept: np.ndarray) -> str:
    """A fingerprint as text: length, whole hashes and the sketch, in hexadecimal."""
    return f"{n:x}-{whole[0]:08x}{whole[1]:08x}-{kept.astype('>u4').tobytes().hex()}"


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Dice share of common spans of two sketches; 1 for two empty ones."""
    if not len(a) and not len(b):
        return 1.0
    both = np.union1d(a, b)
    if len(a) >= KEPT or len(b) >= KEPT:
        both = both[:KEPT]
    common = np.isin(both, a, assume_unique=True) & np.isin(both, b, assume_unique=True)
    jaccard = common.mean()
    return float(2 * jaccard / (1 + jaccard))


def joined(a: Prefixes, keep: int, b: Prefixes, take: int) -> tuple[tuple[int, ...], np.ndarray]:
    """Whole hashes and sketch of the first ``keep`` points of ``a`` followed by the first ``take`` of ``b``."""
    p = int(MODULUS)
    for power in POWERS:
        power.upto(keep + take)
    whole = tuple((int(x[keep]) + int(w.up[keep]) * int(y[take])) % p for x, y, w in zip(a.sums, b.sums, POWERS, strict=True))
    around = np.concatenate((a.points[max(0, keep - SPAN + 1) : keep], b.points[: min(take, SPAN - 1)]))
    if keep + take < SPAN:
        around = np.concatenate((a.points[:keep], b.points[:take]))
    steps = reduced((around + np.uint64(1)) * POWERS[0].up[: len(around)])
    sums = np.concatenate((np.zeros(1, np.uint64), reduced(np.cumsum(steps))))
    across = span_hashes(sums, SPAN) if len(around) >= SPAN or keep + take < SPAN else np.zeros(0, np.uint32)
    parts = [a.spans[: keep - SPAN + 1] if keep >= SPAN else across[:0], across, b.spans[: take - SPAN + 1] if take >= SPAN else across[:0]]
    return whole, smallest(np.concatenate(parts))


COLUMNS = (
    "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
    "near_edited double, near_next double, shared_prefix bigint"
)


def compared(doc_id: int | None, here: Prefixes, after: Prefixes) -> tuple:
    half = here.n // 2
    keep, take = here.n - half, min(half, after.n)
    kept, whole = smallest(here.spans), here.hash(0, here.n)
    edited_whole, edited = joined(here, keep, after, take)
    text = here.text[:keep] + after.text[:take]
    return (
        doc_id, here.n, hashlib.sha256(text.encode("utf-8", "replace")).hexdigest(), written(here.n, whole, kept),
        written(keep + take, edited_whole, edited), likeness(kept, edited), likeness(kept, smallest(after.spans)), here.extension(0, after, 0),
    )


def compare_batches(batches: Batches) -> Batches:
    """Rows come in order within their slice; each slice ends with the first document of the next one."""
    last: tuple | None = None
    for batch in batches:
        out = []
        for cut, ahead, doc_id, text in zip(batch["_slice"], batch["_ahead"], batch["doc_id"].array, texts_of(batch), strict=True):
            if ahead and (last is None or last[0] != cut):
                continue
            here = Prefixes(text)
            if last is not None and last[0] == cut:
                out.append(compared(last[1], last[2], here))
            last = None if ahead else (cut, None if pd.isna(doc_id) else doc_id, here)
        yield pd.DataFrame(out, columns=[c.split()[0] for c in COLUMNS.split(", ")]).astype({"doc_id": "Int64"})


def document_fingerprints(documents: DataFrame) -> DataFrame:
    """Fingerprints of each whole text and of its edited text, with their likeness and that to the next document's.

    The edited text has its last floor(n / 2) code points replaced by the first as many (or all) of the next document
    in ascending doc_id; the last document's next is the first. Null ids come first; rows of equal id are ordered by a
    hash of their text, so repeated rows follow each other. A null text counts as empty. ``shared_prefix`` is the
    length of the longest common prefix with the next document. No rows give no rows.

    Texts are shuffled once, into slices of the id order; the first document of each slice goes to the slice before
    as well, and slices are read in order as a stream.
    """
    spark = documents.sparkSession
    slices = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = documents.selectExpr("cast(doc_id as bigint) doc_id", "coalesce(text, '') text")
    rows = rows.select("doc_id", "text", F.xxhash64("text").alias("_tie"), F.coalesce(F.col("doc_id").cast("double"), F.lit(float("-inf"))).alias("_place"))
    cuts = documents.select(F.col("doc_id").cast("double").alias("d")).na.drop().approxQuantile("d", [k / slices for k in range(1, slices)], 0.25 / slices)
    splits = [float("-inf"), *sorted(set(cuts)), float("inf")]
    if len(splits) > 2:
        rows = Bucketizer(splits=splits, inputCol="_place", outputCol="_bucket").transform(rows).withColumn("_slice", F.col("_bucket").cast("int"))
    else:  # fewer than two different cuts
        rows = rows.withColumn("_slice", F.lit(0))
    # one row per slice; their number is the count of shuffle partitions, so the window and the broadcast are bounded
    firsts = rows.groupBy("_slice").agg(F.min(F.struct("doc_id", "_tie")).alias("_first"))
    order = Window.partitionBy(F.lit(0)).orderBy("_slice")
    whole = Window.partitionBy(F.lit(0))
    firsts = firsts.select(
        F.coalesce(F.lag("_slice").over(order), F.max("_slice").over(whole)).alias("_before"),
        F.col("_first.doc_id").alias("_id"), F.col("_first._tie").alias("_hash"),
    )
    sent = rows.join(F.broadcast(firsts), rows.doc_id.eqNullSafe(F.col("_id")) & (rows["_tie"] == F.col("_hash")), "left")
    own, ahead = F.struct(F.col("_slice").alias("s"), F.lit(0).alias("a")), F.struct(F.col("_before").alias("s"), F.lit(1).alias("a"))
    sent = sent.select("doc_id", "text", "_tie", F.explode(F.when(F.col("_before").isNull(), F.array(own)).otherwise(F.array(own, ahead))).alias("_to"))
    sent = sent.select("doc_id", "text", "_tie", F.col("_to.s").alias("_slice"), F.col("_to.a").alias("_ahead"))
    placed = sent.repartition(slices, "_slice").sortWithinPartitions("_slice", "_ahead", "doc_id", "_tie")
    return placed.drop("_tie").mapInPandas(compare_batches, COLUMNS)
