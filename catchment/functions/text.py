"""Keys, numbers in words, dates and fingerprints: column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Names of rows that sum other sites.
AGGREGATES = ["all cancers", "all cancers excl. nmsc", "all cancers excl nmsc"]


def site_key(name: Column) -> Column:
    """Letters and digits, in lower case."""
    return F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", "")


def is_aggregate(name: Column) -> Column:
    return F.lower(F.trim(name)).isin(AGGREGATES)


def number(text: Column) -> Column:
    """A text as double; null if it is none."""
    return F.trim(text).try_cast("double")


def human(x: Column) -> Column:
    """1.2 M, 3.4 k, one decimal below; 0 stands bare and null is N/A. Half of the last
    decimal rounds away from zero."""
    one = lambda v, unit: F.concat(F.format_string("%.1f", v), F.lit(unit))
    big = F.abs(x)
    return F.when(x.isNull(), "N/A").when(x == 0, "0").when(big >= 1e6, one(x / 1e6, " M")).when(big >= 1e3, one(x / 1e3, " k")).otherwise(one(x, ""))


def next_wednesday(day: Column) -> Column:
    """The Wednesday after a day, at 8:00; never the day itself."""
    return F.next_day(day, "WED").cast("timestamp") + F.expr("interval 8 hours")


def fingerprint(parts: Column) -> Column:
    """Eight hex digits of an array of texts, whatever its order."""
    return F.left(F.md5(F.array_join(F.sort_array(parts), ";")), F.lit(8))
