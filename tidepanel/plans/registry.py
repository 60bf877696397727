"""Named queries over the given tables, each beside its SQL check."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

QueryFn = Callable[[SparkSession, str], DataFrame]

# Half-way cases at the sixth place would round by the last bit of a sum, which depends on the
# order of addition. Both sides therefore add this before they round.
HALF_WAY = 1e-9

QUERIES: dict[str, QueryFn] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[QueryFn], QueryFn]:
    def register(fn: QueryFn) -> QueryFn:
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.replace(", 6)", f" + {HALF_WAY}, 6)")
        return fn

    return register


def r6(column: Column | str) -> Column:
    column = F.col(column) if isinstance(column, str) else column
    return F.round(column.cast("double") + HALF_WAY, 6)


def tidy(df: DataFrame) -> DataFrame:
    """Round doubles to six places and widen ints, as the SQL side does."""
    out = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (T.DoubleType, T.FloatType)):
            c = r6(c)
        elif isinstance(field.dataType, (T.IntegerType, T.ShortType, T.ByteType)):
            c = c.cast("bigint")
        out.append(c.alias(field.name))
    return df.select(*out)
