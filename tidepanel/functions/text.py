"""Text expressions for station keys, file names and labels."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The stem of a source file is <5-character station><wq or nut><suffix>.
FILE_STEM_PATTERN = r"(?i)^([a-z0-9]{5})(wq|nut)([a-z0-9_-]*)$"


def key_text(c: Column | str) -> Column:
    return F.lower(F.trim(c))


def suffix_code(c: Column) -> Column:
    """Trailing two letters, or the last two characters if they are not letters."""
    letters = F.regexp_extract(c, r"([A-Za-z]{2})$", 1)
    return F.lower(F.coalesce(F.nullif(letters, F.lit("")), F.right(c, F.lit(2))))


def longitude(value: Column, text: Column) -> Column:
    """Sign from the compass letter in ``text``; east wins over west, none means west."""
    return F.when(F.coalesce(text.rlike("(?i)e"), F.lit(False)), F.abs(value)).otherwise(-F.abs(value))


def number(c: Column) -> Column:
    """Text to double; unreadable text and NaN become NULL."""
    v = F.trim(c).try_cast("double")
    return F.when(~F.isnan(v), v)


def header_name(name: str) -> str:
    return name.strip().lower().replace(" ", "_").replace("-", "_")


def station_label(name: Column, region: Column, station: Column, region_name: Column) -> Column:
    """Readable label ``(key) station name, region name``; a blank station name is left out."""
    blank = name.isNull() | (F.trim(name) == "")
    key = F.concat(F.lit("("), region, station.cast("string"), F.lit(") "))
    place = F.coalesce(region_name, region)
    return F.when(blank, F.concat(key, place)).otherwise(F.concat(key, name, F.lit(", "), place))
