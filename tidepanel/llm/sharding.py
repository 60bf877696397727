"""Sharding by a Feistel permutation of the global row numbers.

Rows get numbers 0..n-1 in the order of their key; a keyed permutation of those numbers shuffles them, and shard and
slot are the remainder and quotient of the new number. Any row's place can thus be computed from its number alone,
and the place's row number by running the rounds backwards. Counts of shards differ by one at most.

The permutation works on Z_a x Z_b with a = ceil(sqrt(n)), b = ceil(n / a): each round adds a function of one half to
the other half. Numbers of n and above, fewer than a of them, are walked on along their cycle until they fall below
n. A walk meets each such number once at most, so as many steps as there are such numbers always suffice.

All of it is DataFrame expressions; the only exchange is the range sort of three narrow columns.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidepanel.llm.common import numbered, staged

#: A prime below 2**31, and a multiplier and an addend for each round.
PRIME = 2_147_483_629
ROUNDS = ((1_103_515_245, 12_345), (1_664_525, 1_013_904_223), (214_013, 2_531_011), (69_069, 907_133_923), (1_140_671_485, 12_820_163), (22_695_477, 1_406_932_606))


def sides(n: int) -> tuple[int, int]:
    """Lengths of the two halves of a domain of at least ``n`` numbers."""
    a = max(1, math.isqrt(max(0, n - 1)) + 1)
    return a, max(1, -(-n // a))


def round_value(half: Column, k: int) -> Column:
    """The value that round ``k`` makes of one half: an affine map and a square, both modulo a prime."""
    mul, add = ROUNDS[k]
    once = F.pmod(half * F.lit(mul).cast("bigint") + F.lit(add).cast("bigint"), F.lit(PRIME).cast("bigint"))
    return F.pmod(once * once + half, F.lit(PRIME).cast("bigint"))


def encipher(number: Column, n: int) -> Column:
    """One application of the permutation of the domain, as a number of the domain."""
    a, b = (F.lit(x).cast("bigint") for x in sides(n))
    state = F.struct(F.pmod(number, a).alias("l"), F.floor(number / a).cast("bigint").alias("r"))
    if n < 2:
        return number

    def left(k: int):
        return lambda s: F.struct(F.pmod(s["l"] + round_value(s["r"], k), a).alias("l"), s["r"].alias("r"))

    def right(k: int):
        return lambda s: F.struct(s["l"].alias("l"), F.pmod(s["r"] + round_value(s["l"], k), b).alias("r"))

    for k in range(len(ROUNDS)):
        # transform over one element binds the state, so that no expression is repeated
        state = F.transform(F.array(state), right(k) if k % 2 else left(k))[0]
    return F.transform(F.array(state), lambda s: s["r"] * a + s["l"])[0]


def permuted(number: Column, n: int) -> Column:
    """The row's place in the shuffle of 0..n-1."""
    a, b = sides(n)
    first = encipher(number, n)
    beyond = a * b - n
    if not beyond:
        return first
    limit = F.lit(n).cast("bigint")

    def walk(x: Column) -> Column:
        steps = F.sequence(F.lit(1), F.lit(beyond))
        return F.when(x < limit, x).otherwise(F.aggregate(steps, x, lambda acc, _: F.when(acc < limit, acc).otherwise(encipher(acc, n))))

    return F.transform(F.array(first), walk)[0]


def shard_rows(rows: DataFrame, order: list[Column], shards: int) -> DataFrame:
    """All rows with ``shard`` (int, 0 to shards-1) and ``slot`` (long, gapless from 0 in its shard).

    ``order`` numbers the rows; rows that tie in it are interchangeable. Null keys come first. An empty table stays
    empty. Columns named row_no, n_rows, shard or slot are replaced.
    """
    placed = numbered(rows, order)
    n = rows.count()
    place = permuted(F.col("row_no"), n) if n else F.col("row_no")
    return (
        placed.withColumn("_place", place)
        .withColumn("shard", F.pmod("_place", F.lit(shards)).cast("int"))
        .withColumn("slot", F.floor(F.col("_place") / F.lit(shards)).cast("bigint"))
        .drop("_place", "row_no", "n_rows")
    )


def document_shards(documents: DataFrame, shards: int = 16) -> DataFrame:
    """Shard and slot of each document, by law ``rows``.

    ``size`` is the UTF-8 length of the text plus 1 (a null text: 1), ``text_crc32`` its unsigned CRC-32 (null: 0).
    Repeated rows each get a place of their own; other columns of the table are not read.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    narrow = documents.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        (F.octet_length(text) + 1).cast("bigint").alias("size"),
        F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"),
    )
    # equal rows are interchangeable: the spread keeps a hot one from filling a range of its own
    narrow = staged(narrow.withColumn("_spread", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(1 << 20))))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text_crc32"), F.col("size"), F.col("_spread")]
    return shard_rows(narrow, order, shards).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )
