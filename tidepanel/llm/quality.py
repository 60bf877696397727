"""Quality: perplexity under an interpolated modified Kneser-Ney n-gram model of trusted text.

The units are characters: each one that the trusted texts hold at least twice is a class of its own, in any script;
capital letters, digits, all other characters and the start of a text are one class each. Case and punctuation thus
stay visible, and what is met once stands for what isn't met at all.

Nothing of the model is gathered but its alphabet. Counts run over all trusted texts: an aggregate sharded by n-gram
adds them up, and joins between the count tables of neighbouring orders give discounts, back-off weights and
probabilities. To be scored, texts are dealt out into chunks of about ``CHUNK`` bytes by their place in the input files;
the different n-grams of each chunk, found where the texts are read, meet the sharded tables in joins, and each chunk's
texts meet its own n-grams' log probabilities. That is the one shuffle of texts: every document is scored once, and the
limits come from the scores of the trusted ones.

A document is kept when its perplexity is at most a high quantile of the trusted documents' perplexities in its
language. Short texts scatter, so what is compared is the perplexity's lower bound, ``SIGMAS`` standard errors of the
mean log probability below it. The quantiles are exact but for values within a factor of 1 + ``STEP``, of which the largest
counts: they come from a histogram over all rows, of some ten thousand bins a language at most.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from tidepanel.llm.common import Batches, bounded_batches, code_points, free_name, give_back, giving_back, staged, texts_of

ORDER = 4
SYMBOLS = 1 << 16
"""Numbers of classes; ORDER of them fill 64 bits."""
START, CAPITAL, DIGIT, RARE = 0, 1, 2, 3
QUANTILE = 0.998
SIGMAS = 3.0
MARGIN = 1.05
"""Allowance for texts that the model hasn't seen, as trusted ones are part of its counts: limits lie 5 % above the quantile."""
STEP = 0.001
PIECE = 1 << 18
"""Code points whose n-grams are sorted at a time."""
BROADCAST_IDS = 4_000_000
"""Label ids that may be broadcast (32 MB)."""
WIDE = 0x110000
CHUNK = 16 << 20
"""Bytes of text, about, whose n-grams are looked up together."""


@cache
def kinds() -> np.ndarray:
    """Class of each code point that isn't in an alphabet."""
    return np.array([CAPITAL if c.isupper() else DIGIT if c.isdigit() else RARE for c in map(chr, range(WIDE))] + [RARE], dtype=np.uint16)


def folds(common: list[int]) -> np.ndarray:
    """Class of each code point. Beyond the numbers there are, the rarest characters share the upper half of them."""
    table, room = kinds().copy(), SYMBOLS - RARE - 1
    rank = np.arange(len(common))
    table[common] = (RARE + 1 + np.where(rank < room, rank, room // 2 + rank % (room // 2))).astype(np.uint16)
    return table


def points_of(text: str) -> np.ndarray:
    return np.minimum(code_points(text), WIDE)


def ngrams(text: str, table: np.ndarray) -> np.ndarray:
    """Number of the n-gram that ends at each character; the text's beginning is filled up with start signs."""
    symbols = np.concatenate((np.full(ORDER - 1, START, dtype=np.uint64), table[points_of(text)].astype(np.uint64)))
    n, out = len(symbols) - ORDER + 1, np.zeros(len(symbols) - ORDER + 1, dtype=np.uint64)
    for k in range(ORDER):
        out = out * np.uint64(SYMBOLS) + symbols[k : k + n]
    return out


def suffix(gram: str, k: int) -> Column:
    """The last ``k`` symbols of an n-gram."""
    return F.col(gram).bitwiseAND(F.lit((1 << 16 * k) - 1))


def context_of(gram: str) -> Column:
    return F.shiftrightunsigned(gram, 16)


def merged(grams: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Different n-grams, ascending, with the sums of their counts."""
    every, n = np.concatenate(grams), np.concatenate(counts)
    if not len(every):
        return every, n
    order = np.argsort(every, kind="stable")
    every, n = every[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], every[1:] != every[:-1])))
    return every[first], np.add.reduceat(n, first)


def different(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different n-grams of texts with their counts, sorted in small steps."""
    grams, counts, waiting, size = [], [], [], 0
    for text in [*texts, None]:
        if text is not None:
            waiting.append(ngrams(text, table))
            size += len(waiting[-1])
        if waiting and (text is None or size >= PIECE):
            found = np.unique(waiting[0] if len(waiting) == 1 else np.concatenate(waiting), return_counts=True)
            grams.append(found[0])
            counts.append(found[1])
            waiting, size = [], 0
    return merged(grams, counts) if len(grams) > 1 else (grams[0], counts[0])


def alphabet(trusted: DataFrame) -> list[int]:
    """The characters, met twice or more in all trusted texts, that are neither capitals nor digits; the commonest first."""

    def count(batches: Batches) -> Batches:
        totals = np.zeros(WIDE + 1, dtype=np.int64)
        for batch in batches:
            for text in texts_of(batch):
                totals += np.bincount(points_of(text), minlength=WIDE + 1) if len(text) > WIDE else 0
                if len(text) <= WIDE:
                    points, counts = np.unique(points_of(text), return_counts=True)
                    totals[points] += counts
        found = np.flatnonzero(totals)
        yield pd.DataFrame({"point": found, "n": totals[found]})

    counts = trusted.select("text").mapInPandas(giving_back(count), "point int, n bigint").groupBy("point").agg(F.sum("n").alias("n"))
    letters = F.expr("decode(unhex(lpad(hex(point), 8, '0')), 'UTF-32')")
    counts = counts.where((F.col("point") < WIDE) & (F.col("n") > 1)).withColumn("c", letters)
    plain = counts.where((F.col("c") == F.lower("c")) & ~F.col("c").rlike(r"^\d$"))
    # a row per different character: Unicode bounds them
    return [r["point"] for r in plain.orderBy(F.desc("n"), "point").collect()]


def counted(trusted: DataFrame, common: list[int]) -> DataFrame:
    """``(gram, n)`` of all trusted texts at the highest order."""

    def count(batches: Batches) -> Batches:
        table = folds(common)
        for batch in batches:
            if len(batch):
                grams, counts = different(texts_of(batch), table)
                yield pd.DataFrame({"gram": grams.view(np.int64), "n": counts})

    return trusted.select("text").mapInPandas(giving_back(count), "gram bigint, n bigint").groupBy("gram").agg(F.sum("n").alias("n"))


def discounts(counts: DataFrame) -> tuple[float, float, float]:
    """The three discounts of an order from its counts of counts; a missing count of counts discounts nothing more than one."""
    row = counts.agg(*(F.count(F.when(F.col("n") == k, 1)).alias(f"n{k}") for k in range(1, 5))).first()
    n1, n2, n3, n4 = (row[f"n{k}"] for k in range(1, 5))
    y = n1 / (n1 + 2 * n2) if n1 else 0.5
    raw = (1 - 2 * y * n2 / n1 if n1 else 0.5, 2 - 3 * y * n3 / n2 if n2 else 1.0, 3 - 4 * y * n4 / n3 if n3 else 1.5)
    return tuple(min(max(d, 0.05), k - 0.05) for k, d in zip((1, 2, 3), raw, strict=True))  # type: ignore[return-value]


def probabilities(counts: DataFrame) -> list[tuple[DataFrame, DataFrame]]:
    """For each order from 1: ``(gram, p)`` of seen n-grams, and ``(context, weight)`` for backing off; tables sharded by their keys.

    Below the highest order the counts are numbers of different characters that come before the n-gram.
    """
    tables = [staged(counts)]
    for k in range(ORDER - 1, 0, -1):
        tables.append(staged(tables[-1].groupBy(suffix("gram", k).alias("gram")).agg(F.count("*").alias("n"))))
    out, lower = [], None
    for table in reversed(tables):
        d1, d2, d3 = discounts(table)
        n, context = F.col("n"), context_of("gram")
        cut = F.when(n == 1, d1).when(n == 2, d2).otherwise(d3)
        contexts = table.groupBy(context.alias("context")).agg(F.sum("n").alias("total"), F.sum(cut).alias("freed"))
        contexts = staged(contexts.select("context", "total", (F.col("freed") / F.col("total")).alias("weight")))
        rows = table.select("gram", n, (n - cut).alias("left"), context.alias("context")).join(contexts, "context")
        if lower is None:
            rows = rows.withColumn("below", F.lit(1.0 / SYMBOLS))
        else:
            rows = rows.withColumn("suffix", suffix("gram", len(out))).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
        lower = staged(rows.select("gram", (F.col("left") / F.col("total") + F.col("weight") * F.col("below")).alias("p")))
        out.append((lower, contexts.select("context", "weight")))
    return out


def looked_up(grams: DataFrame, orders: list[tuple[DataFrame, DataFrame]], k: int = ORDER) -> DataFrame:
    """``(gram, p)`` of the different n-grams ``grams(gram)`` of order ``k``: seen ones, and others by backing off."""
    seen, weights = orders[k - 1]
    rows = grams.join(seen.withColumnRenamed("p", "seen"), "gram", "left").withColumn("context", context_of("gram")).join(weights, "context", "left")
    if k == 1:
        rows = rows.withColumn("below", F.lit(1.0 / SYMBOLS))
    else:
        rows = rows.withColumn("suffix", suffix("gram", k - 1))
        lower = looked_up(staged(grams.select(suffix("gram", k - 1).alias("gram")).distinct()), orders, k - 1)
        rows = rows.join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below")), "suffix")
    return staged(rows.select("gram", F.coalesce("seen", F.coalesce("weight", F.lit(1.0)) * F.col("below")).alias("p")))


def bounds(values: np.ndarray) -> tuple[float, float]:
    """Perplexity and its lower bound from a text's log probabilities."""
    mean, error = -values.mean(), values.std() / np.sqrt(len(values))
    return float(np.exp(mean)), float(np.exp(mean - SIGMAS * error))


def placed(documents: DataFrame, file: str, row: str) -> DataFrame:
    """``documents`` with the place of each row as ``file`` (a hash) and ``row``, the same whenever they are read.

    Rows that come from no file are staged first and take their place there.
    """
    try:
        place = documents.metadataColumn("_metadata")
        documents.select(place["row_index"])
        return documents.withColumns({file: F.xxhash64(place["file_path"]), row: place["row_index"]})
    except AnalysisException:
        return staged(documents).withColumns({file: F.lit(0).cast("bigint"), row: F.monotonically_increasing_id()})


def chunked(rows: DataFrame, file: str, row: str, chunk: str) -> DataFrame:
    """Placed rows with the number of their chunk: about ``CHUNK`` bytes of rows that follow each other in a file.

    As places stay, no exchange is needed to find a chunk's n-grams. A long text is a chunk of its own.
    """
    size = rows.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("bytes")).first()
    run = max(1, int(CHUNK * size["n"] / max(size["bytes"] or 0, 1)))
    alone = F.coalesce(F.octet_length("text") > CHUNK // 16, F.lit(False))
    part = F.when(alone, -1 - F.col(row)).otherwise(F.floor(F.col(row) / run))
    return rows.withColumn(chunk, F.xxhash64(file, part))


def with_perplexity(documents: DataFrame, chunk: str, common: list[int], orders: list[tuple[DataFrame, DataFrame]], names: list[str]) -> DataFrame:
    """Rows of :func:`chunked`, but for text and chunk, with the perplexity of each whole text and its lower bound as ``names``; null for empty and null texts."""
    spent = [chunk, "text"]
    schema = StructType([*(f for f in documents.schema.fields if f.name not in spent), *(StructField(x, DoubleType()) for x in names)])

    def find(batches: Batches) -> Batches:
        table = folds(common)
        held: dict[int, np.ndarray] = {}

        def passed(numbers: list[int]) -> Batches:
            for number in numbers:
                yield pd.DataFrame({"chunk": number, "gram": held.pop(number).view(np.int64)})

        for batch in batches:
            for number, texts in batch.groupby("chunk", sort=False):
                found = different(texts_of(texts), table)[0]
                held[number] = np.union1d(held[number], found) if number in held else found
            yield from passed(list(held)[:-1])  # rows come in the order of their file
        yield from passed(list(held))

    def score(texts: pa.Table, found: pa.Table) -> pa.Table:
        table, grams, values = folds(common), found["gram"].to_numpy(), found["log_p"].to_numpy()
        order = np.argsort(grams)
        grams, values = grams[order], values[order]
        got = [bounds(values[np.searchsorted(grams, ngrams(t, table).view(np.int64))]) if t else (None, None) for t in texts["text"].to_pylist()]
        texts = texts.drop_columns(spent)
        for k, name in enumerate(names):
            texts = texts.append_column(name, pa.array([g[k] for g in got], type=pa.float64()))
        give_back()
        return texts

    # a chunk that two tasks read has some n-grams twice, which does no harm
    grams = staged(documents.select(F.col(chunk).alias("chunk"), "text").mapInPandas(giving_back(find), "chunk bigint, gram bigint"))
    p = looked_up(staged(grams.select("gram").distinct()), orders)
    known = grams.join(p, "gram").select("chunk", "gram", F.log(F.greatest("p", F.lit(1e-12))).alias("log_p"))
    return documents.groupBy(chunk).cogroup(known.groupBy("chunk")).applyInArrow(score, schema)


def marked(documents: DataFrame, labels: DataFrame, mark: str) -> DataFrame:
    """``documents`` with ``mark``: whether labels of quality 1 name them. Up to ``BROADCAST_IDS`` ids are sent to the texts; more of them meet the texts in a shuffle."""
    known = labels.where((F.col("quality") == 1) & F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("_known")).distinct()
    if known.count() <= BROADCAST_IDS:
        known = F.broadcast(known)
    return documents.join(known, F.col("doc_id") == F.col("_known"), "left").withColumn(mark, F.col("_known").isNotNull()).drop("_known")


def limits(scores: DataFrame, quantile: float = QUANTILE) -> DataFrame:
    """``(lang, limit)`` from ``scores(lang, lower_bound)``: the end of the first bin up to which a share ``quantile`` of a language's rows lies.

    The row of null language is the limit over all rows; a language of its own falls to it if it has no scores.
    """
    width = float(np.log1p(STEP))
    bins = scores.where(F.col("lower_bound").isNotNull()).withColumn("bin", F.ceil(F.log("lower_bound") / width))
    counts = staged(bins.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.max("lower_bound").alias("top")))
    counts = counts.where(F.col("lang").isNotNull()).unionByName(counts.groupBy("bin").agg(F.sum("n").alias("n"), F.max("top").alias("top")).withColumn("lang", F.lit(None).cast("string")))
    by = Window.partitionBy("lang")  # rows here are histogram bins: perplexities up to 10**12 have fewer than 30,000
    upto = counts.withColumn("upto", F.sum("n").over(by.orderBy("bin"))).withColumn("all", F.sum("n").over(by))
    return upto.where(F.col("upto") >= F.col("all") * quantile).groupBy("lang").agg((F.min("top") * MARGIN).alias("limit"))


def judged(rows: DataFrame, labels: DataFrame) -> tuple[DataFrame, Column]:
    """Placed ``rows(doc_id, text, lang, file, row)`` with ``perplexity`` and ``lower_bound`` instead of the text, staged, and the limit of a row's language as an expression."""
    bounded_batches(rows.sparkSession)
    rows = marked(chunked(rows, "file", "row", "chunk"), labels, "trusted")
    trusted = rows.where("trusted").select("text")
    common = alphabet(trusted)
    orders = probabilities(counted(trusted, common))
    scores = staged(with_perplexity(rows, "chunk", common, orders, ["perplexity", "lower_bound"]))
    found = limits(scores.where("trusted").select("lang", "lower_bound")).collect()  # one row per language of trusted documents
    by_lang = {r["lang"]: r["limit"] for r in found if r["lang"] is not None}
    overall = F.lit(next((r["limit"] for r in found if r["lang"] is None), float("inf")))
    limit = F.coalesce(F.create_map(*(F.lit(x) for kv in by_lang.items() for x in kv))[F.col("lang")], overall) if by_lang else overall
    return scores.drop("trusted"), limit


def document_quality(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``lang``, ``perplexity``, its ``lower_bound``, the ``limit`` of its language and ``kept`` for every document.

    Trusted are the documents that ``labels.quality`` marks with 1. Empty and null texts have no perplexity and aren't
    kept. Without any trusted text there is no limit, and every text that isn't empty is kept. A null language, and
    one without trusted documents, has the limit of all trusted documents; a null id is never trusted. Repeated rows are
    scored, and counted where trusted, as often as they come. Texts are read whole; a long one is looked up by itself. An
    empty table gives no rows. Columns beyond doc_id, text and lang play no part, whatever their names.
    """
    scores, limit = judged(placed(documents, "file", "row").select("doc_id", "text", "lang", "file", "row"), labels)
    kept = F.coalesce(F.col("lower_bound") <= limit, F.lit(False))
    return scores.select(F.col("doc_id").cast("bigint").alias("doc_id"), "lang", "perplexity", "lower_bound", limit.alias("limit"), kept.alias("kept"))


def without_poor(documents: DataFrame, labels: DataFrame) -> DataFrame:
    """``documents`` without those that :func:`document_quality` doesn't keep; the columns and the other rows stay as they are.

    Rows that go are known by their place: up to ``BROADCAST_IDS`` places are sent to the texts, more meet them in a shuffle.
    """
    file, row = free_name(documents, "file"), free_name(documents, "row")
    rows = placed(documents, file, row)
    scores, limit = judged(rows.select("doc_id", "text", "lang", F.col(file).alias("file"), F.col(row).alias("row")), labels)
    poor = scores.where(~F.coalesce(F.col("lower_bound") <= limit, F.lit(False))).select(F.col("file").alias(file), F.col("row").alias(row))
    poor = F.broadcast(poor) if poor.count() <= BROADCAST_IDS else poor
    return rows.join(poor, [file, row], "left_anti").select(documents.columns)
