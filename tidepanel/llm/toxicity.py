"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios.

Features are the presence of hashed n-grams of the lower-cased text. Each is scaled by the log ratio of its smoothed
shares among toxic and other training texts; a logistic regression with a ridge penalty is fitted on the scaled
features. Counts come from one aggregate over the training texts, the fit is MLlib's, and scoring is a map over whole
texts with a table of fixed size: no text is ever shuffled.

The fit takes a bounded sample of the labelled rows (``TRAINING_ROWS``), the model has ``FEATURES`` weights at most.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.linalg import Vectors, VectorUDT
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, bounded_batches, code_points, free_name, giving_back, labelled_sample, staged, texts_of, with_scores

ORDERS = (3, 4, 5)
BITS = 22
TRAINING_ROWS = 20_000
"""Bound of the labelled rows that the classifier is fitted on, chosen by a hash of their id."""
FEATURES = 4_000
"""Bound of the n-grams that have a weight: those that tell the classes apart best by the chi-square statistic."""
LEAST_TEXTS = 5
SMOOTHING = 1.0
PENALTY = 1e-3


def hashed_ngrams(text: str) -> np.ndarray:
    """Slots below 2**BITS of all n-grams of the lower-cased text, with repetitions."""
    points = code_points(text.lower()).astype(np.uint64)
    step, out = np.uint64(0x9E3779B97F4A7C15), []
    hashes = points + np.uint64(1)
    for n in range(2, max(ORDERS) + 1):
        if len(points) < n:
            break
        hashes = hashes[:-1] * np.uint64(0x100000001B3) + points[n - 1 :] + np.uint64(n)
        if n in ORDERS:
            out.append(((hashes * step) >> np.uint64(64 - BITS)).astype(np.int64))
    return np.concatenate(out) if out else np.zeros(0, np.int64)


@dataclass
class Model:
    slots: np.ndarray  # slot of each feature
    ratios: np.ndarray  # its log-count ratio
    weights: np.ndarray  # its weight after scaling
    intercept: float

    def lookup(self) -> np.ndarray:
        """Feature of each slot, -1 where there is none: one table of fixed size."""
        table = np.full(1 << BITS, -1, dtype=np.int32)
        table[self.slots] = np.arange(len(self.slots))
        return table


def present(text: str, lookup: np.ndarray) -> np.ndarray:
    """The features that a text has, ascending."""
    found = lookup[hashed_ngrams(text)]
    return np.unique(found[found >= 0])


def slot_counts(batches: Batches) -> Batches:
    """How many toxic and other texts of a task have each slot."""
    for batch in batches:
        found = [np.unique(hashed_ngrams(t)) for t in texts_of(batch)]
        labels = batch["label"].to_numpy().astype(int)
        sides = [np.unique(np.concatenate([np.zeros(0, np.int64), *(f for f, x in zip(found, labels, strict=True) if x == label)]), return_counts=True) for label in (0, 1)]
        for name, (slots, n) in zip(("other", "toxic"), sides, strict=True):
            yield pd.DataFrame({"slot": slots, "toxic": 0, "other": 0} | {name: n})


def fit(training: DataFrame) -> Model:
    """The model of a bounded table ``training(text, label)``. With one class alone it gives that class's share everywhere."""
    bounded_batches(training.sparkSession)
    training = staged(training)
    sizes = {r["label"]: r["n"] for r in training.groupBy("label").agg(F.count("*").alias("n")).collect()}
    toxic, other = sizes.get(1, 0), sizes.get(0, 0)
    if not toxic or not other:
        share = (toxic + 0.5) / (toxic + other + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), float(np.log(share / (1 - share))))
    counts = training.mapInPandas(giving_back(slot_counts), "slot int, toxic int, other int").groupBy("slot").agg(F.sum("toxic").alias("p"), F.sum("other").alias("q"))
    counts = staged(counts.where(F.col("p") + F.col("q") >= LEAST_TEXTS))
    totals = counts.agg(F.sum(F.col("p") + SMOOTHING).alias("p"), F.sum(F.col("q") + SMOOTHING).alias("q")).first()
    all_rows = float(toxic + other)
    have = F.col("p") + F.col("q")
    gap = (F.col("p") * other - F.col("q") * toxic).cast("double")
    chi_square = gap * gap / (have * (F.lit(all_rows) - have + 1))
    kept = counts.orderBy(chi_square.desc(), "slot").limit(FEATURES).toPandas().sort_values("slot")  # at most FEATURES rows
    p, q = kept["p"].to_numpy(dtype=float), kept["q"].to_numpy(dtype=float)
    ratios = np.log((p + SMOOTHING) / (totals["p"] or 1) / ((q + SMOOTHING) / (totals["q"] or 1)))
    model = Model(kept["slot"].to_numpy(dtype=np.int64), ratios, np.zeros(len(ratios)), 0.0)
    if not len(ratios):
        return Model(model.slots, ratios, model.weights, float(np.log(toxic / other)))
    shared = training.sparkSession.sparkContext.broadcast(model)  # at most FEATURES entries

    def features(batches: Batches) -> Batches:
        lookup = shared.value.lookup()
        for batch in batches:
            rows = [present(t, lookup) for t in texts_of(batch)]
            yield pd.DataFrame({"label": batch["label"].astype(float), "at": rows, "ratio": [shared.value.ratios[r] for r in rows]})

    width = len(ratios)
    # vectors of the bounded training sample alone are built row by row
    to_vector = F.udf(lambda at, ratio: Vectors.sparse(width, at, ratio), VectorUDT())
    vectors = training.mapInPandas(giving_back(features), "label double, at array<int>, ratio array<double>").select("label", to_vector("at", "ratio").alias("features"))
    fitted = LogisticRegression(regParam=PENALTY, standardization=False, maxIter=100).fit(staged(vectors))
    return Model(model.slots, ratios, fitted.coefficients.toArray(), float(fitted.intercept))


def scored(documents: DataFrame, model: Model, name: str = "score") -> DataFrame:
    """``documents`` with the score of each whole text as ``name``, the probability of the label.

    Texts without any weighted n-gram, empty and null ones included, get the model's prior.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)  # FEATURES entries at most

    def begin() -> Callable[[list[str]], list[list]]:
        model, lookup = shared.value, shared.value.lookup()
        scaled = model.ratios * model.weights

        def score(texts: list[str]) -> list[list]:
            sums = np.array([scaled[present(t, lookup)].sum() for t in texts]) + model.intercept
            return [(1 / (1 + np.exp(-np.clip(sums, -700, 700)))).tolist()]

        return score

    return with_scores(documents, [name], begin)


def held_out(key: str = "doc_id") -> F.Column:
    """Rows that training never sees: crc32 of the id as text is divisible by 5. A null id is held out too."""
    return F.coalesce(F.pmod(F.crc32(F.col(key).cast("string").cast("binary")), F.lit(5)) == 0, F.lit(True))


def training_rows(documents: DataFrame, labels: DataFrame, bound: int = TRAINING_ROWS) -> DataFrame:
    """Texts and labels of the training folds, of about ``bound`` labelled ids at most.

    Repeated labels of an id count once, as the larger. The ids are sampled before they meet the texts; so few may be
    broadcast, and no text is shuffled.
    """
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy("doc_id").agg(F.max(F.col("toxic").cast("int")).alias("label"))
    return documents.select("doc_id", "text").join(F.broadcast(labelled_sample(known, "doc_id", bound)), "doc_id")


def document_toxicity(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """Score of each whole text of ``documents``; label, language, source and id take no part in it."""
    documents = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    result = scored(documents, fit(training_rows(documents, labels)))
    return result.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those of a score of 0.5 or more; the columns stay as they are."""
    name = free_name(documents, "score")
    kept = scored(documents, fit(training_rows(documents, labels)), name)
    return kept.where(F.col(name) < 0.5).drop(name)
