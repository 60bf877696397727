"""Language identification by rank-order profiles.

A language's profile is the list of its most frequent character n-grams (one to three characters, words enclosed in
blanks), counted over all learning texts. A document's own most frequent n-grams are compared to each profile by
out-of-place distance: the sum of the differences of their ranks, where an n-gram that the profile doesn't hold counts
as the length of a profile. The least distance names the language.

N-grams are numbers: three code points of 21 bits, so that any script is exact. Counting is an aggregate over
(language, n-gram) with partial sums in each task; only the profiles, ``PROFILE`` rows a language, leave it.
"""

from __future__ import annotations

import unicodedata
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidepanel.llm.common import Batches, bounded_batches, code_points, texts_of

ORDER = 3
BITS = 21
"""Bits of a code point; ORDER of them fill 63."""
PROFILE = 400
STRETCH = 1 << 20
"""Code points that are counted at a time."""
HELD = 1 << 21
"""Different n-grams a task holds, about, before it passes its partial sums on."""
BLANK = 1
"""No letter, and not 0, so that n-grams that begin with it differ from shorter ones."""
UNKNOWN = "und"
FOLDS, HELD_FOLD = 4, 2


@cache
def letters() -> np.ndarray:
    """Lower case, where that is one code point, of each letter and combining mark; ``BLANK`` for others."""
    table = np.full(0x110000, BLANK, dtype=np.int64)
    for point in range(0x110000):
        if unicodedata.category(chr(point))[0] in "LM":
            low = chr(point).lower()
            table[point] = ord(low) if len(low) == 1 else point
    return table


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def counted(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams, ascending, with their (summed) counts."""
    if counts is None:
        return np.unique(grams, return_counts=True)
    order = np.argsort(grams, kind="stable")
    grams, counts = grams[order], counts[order]
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1]))) if len(grams) else np.zeros(0, dtype=np.int64)
    return grams[first], np.add.reduceat(counts, first) if len(first) else counts


def ngrams(text: str) -> np.ndarray:
    """Every n-gram of a text, within words and their enclosing blanks; runs of other characters are one blank."""
    found = letters()[code_points(text)]
    blank = found == BLANK
    single = np.ones(len(found), dtype=bool)
    single[1:] = ~(blank[1:] & blank[:-1])
    s = np.concatenate(([BLANK], found[single], [BLANK]))
    word = s != BLANK
    one, two = s[word], (s[:-1] << BITS) | s[1:]
    three = (two[:-1] << BITS) | s[2:]
    # a blank may only begin or end an n-gram; two blanks alone say nothing
    return np.concatenate((one, two[word[:-1] | word[1:]], three[word[1:-1]]))


def stretches(text: str) -> list[str]:
    """A text in bounded stretches that end between words where one is near."""
    out, at = [], 0
    while len(text) - at > STRETCH:
        end = text.rfind(" ", at + STRETCH // 2, at + STRETCH)
        end = at + STRETCH if end < 0 else end
        out.append(text[at:end])
        at = end
    return [*out, text[at:]]


def text_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    parts = [counted(ngrams(t)) for t in stretches(text)]
    return parts[0] if len(parts) == 1 else counted(np.concatenate([g for g, _ in parts]), np.concatenate([n for _, n in parts]))


def most_frequent(grams: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """The ``k`` most frequent n-grams, most frequent first; of equally frequent ones the smaller number."""
    if len(grams) > k:
        least = np.partition(counts, len(counts) - k)[len(counts) - k]
        near = counts >= least
        grams, counts = grams[near], counts[near]
    return grams[np.lexsort((grams, -counts))][:k]


def profiles(documents: DataFrame, size: int = PROFILE) -> dict[str, np.ndarray]:
    """The ``size`` most frequent n-grams of each language, counted over all texts of ``documents(text, lang)``.

    Gathered are ``size`` rows a language. Null texts and languages teach nothing.
    """
    bounded_batches(documents.sparkSession)

    def count(batches: Batches) -> Batches:
        held: dict[str, list] = {}
        total = 0

        def passed() -> Batches:
            for lang, p in held.items():
                grams, n = counted(np.concatenate([g for g, _ in p]), np.concatenate([n for _, n in p]))
                yield pd.DataFrame({"lang": lang, "gram": grams, "n": n})
            held.clear()

        for batch in batches:
            for lang, own in batch.groupby("lang", sort=False)["text"]:
                waiting, size_of = [], 0
                for text in [t for x in own for t in stretches(x)] + [None]:
                    if text is not None:
                        waiting.append(text)
                        size_of += len(text)
                    if waiting and (text is None or size_of >= STRETCH):
                        held.setdefault(lang, []).append(counted(ngrams(" ".join(waiting))))
                        total += len(held[lang][-1][0])
                        waiting, size_of = [], 0
            if total > HELD:
                for lang, p in held.items():
                    held[lang] = [counted(np.concatenate([g for g, _ in p]), np.concatenate([n for _, n in p]))]
                total = sum(len(p[0][0]) for p in held.values())
                if total > HELD // 2:
                    yield from passed()
                    total = 0
        yield from passed()

    known = documents.where(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("lang", "text")
    counts = known.mapInPandas(count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # each task passes on no more than ``size`` rows of a language, so the window isn't a whole language in one task
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).where(F.col("place") <= size).select("lang", "gram", "place").collect()
    out: dict[str, list] = {}
    for r in sorted(top, key=lambda r: (r["lang"], r["place"])):
        out.setdefault(r["lang"], []).append(r["gram"])
    return {lang: np.array(grams, dtype=np.int64) for lang, grams in out.items()}


class Ranks:
    """All profiles side by side: place of each n-gram that any of them holds."""

    def __init__(self, found: dict[str, np.ndarray], size: int) -> None:
        self.size, self.names = size, sorted(found)
        self.grams = np.unique(np.concatenate([*found.values(), np.zeros(0, dtype=np.int64)]))
        self.places = np.full((len(self.grams) + 1, len(self.names)), -1, dtype=np.int32)
        for k, name in enumerate(self.names):
            self.places[np.searchsorted(self.grams, found[name]), k] = np.arange(len(found[name]))

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance of a document's n-grams, in order of rank, to each profile."""
        at = np.minimum(np.searchsorted(self.grams, top), len(self.grams) - 1)
        places = self.places[np.where(self.grams[at] == top, at, len(self.grams))]  # the last row is of no profile
        out = np.abs(places - np.arange(len(top), dtype=np.int32)[:, None])
        return np.where(places < 0, self.size, out).sum(axis=0)

    def best(self, text: str) -> tuple[str, float]:
        """The nearest language and how near it is, from 0 to 1; of equally near ones the first by name."""
        if not self.names or not has_letter(text):
            return UNKNOWN, 0.0
        top = most_frequent(*text_counts(text), self.size)
        distance = self.distances(top)
        k = int(distance.argmin())
        return self.names[k], float(1 - distance[k] / (self.size * len(top)))


def held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % FOLDS == HELD_FOLD, F.lit(False))


def document_languages(documents: DataFrame, size: int = PROFILE) -> DataFrame:
    """Predicted language of every whole text of ``documents(doc_id, text, lang)``.

    ``doc_id``, ``held_out``, ``lang_pred`` and ``score`` (1 less the distance as a share of the largest possible).
    Profiles are learned from the rows that aren't held out (those whose CRC-32 of the id leaves 2 by 4), with a text and
    a language; a null id isn't held out. A null text and one without a letter give ``und`` and 0, and so does every
    text where no row teaches a language. Equal texts have equal results, repeated rows are counted as often as they
    come, and of languages at equal distance the first by name wins. Texts of any length are counted whole, in bounded
    stretches. An empty table gives no rows; columns beyond the three play no part, whatever their names.
    """
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"))
    rows = rows.withColumn("held_out", held_out())
    shared = spark.sparkContext.broadcast(profiles(rows.where(~F.col("held_out")), size))  # ``size`` numbers a language

    def predict(batches: Batches) -> Batches:
        ranks = Ranks(shared.value, size)
        for batch in batches:
            found = [ranks.best(t) for t in texts_of(batch)]
            yield batch[["doc_id", "held_out"]].assign(lang_pred=[n for n, _ in found], score=[s for _, s in found])

    bounded_batches(spark)
    return rows.select("doc_id", "held_out", "text").mapInPandas(predict, "doc_id bigint, held_out boolean, lang_pred string, score double")
