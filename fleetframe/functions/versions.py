"""Version functions over tag text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetframe import fixed
from fleetframe.functions.labels import to_int


def _prefix(text: Column, pattern: str) -> Column:
    return F.nullif(F.regexp_extract(text, pattern, 1), F.lit(""))


def _parts(major: Column, minor: Column, patch: Column, error: Column) -> Column:
    return F.struct(
        major.cast("int").alias("major"),
        minor.cast("int").alias("minor"),
        patch.cast("int").alias("patch"),
        error.alias("parse_error"),
    )


def parse_version(text: Column) -> Column:
    """``a.b.c`` or ``a.b`` to ``struct<major, minor, patch, parse_error>``; anything else is an error."""
    numbers = F.transform(F.split(text, r"\."), to_int)
    good = F.size(numbers).isin(2, 3) & F.forall(numbers, lambda n: n.isNotNull())
    at = lambda i: F.when(good, F.get(numbers, F.lit(i)))
    return _parts(at(0), at(1), at(2), F.coalesce(~good & text.isNotNull(), F.lit(False)))


def tag_version(tag: Column) -> Column:
    """Version at the start of a tag: the longest of ``a.b.c``, ``a.b`` and ``a``; all null if it has none.

    The character between minor and patch may be any, so ``7.0-2024`` is read as three parts, fails to parse and is
    flagged, while ``7.012`` gives (7, 12, null). A leading number beyond 32 bits, as in a date tag, is flagged too.
    """
    dotted = F.coalesce(_prefix(tag, fixed.PATCH_PREFIX), _prefix(tag, fixed.MINOR_PREFIX))
    major = to_int(_prefix(tag, fixed.MAJOR_PREFIX))
    none = F.lit(None)
    too_long = _prefix(tag, fixed.MAJOR_PREFIX).isNotNull() & major.isNull()
    return F.when(dotted.isNotNull(), parse_version(dotted)).otherwise(
        _parts(major, none, none, F.coalesce(too_long, F.lit(False)))
    )


def tag_group(tag: Column) -> Column:
    """Grouping key of a tag: ``major.minor``, else ``major``, else the group of all others."""
    return F.coalesce(
        _prefix(tag, fixed.MINOR_PREFIX), _prefix(tag, fixed.MAJOR_PREFIX), F.lit(fixed.OTHER_TAGS)
    )
