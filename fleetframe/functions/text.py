"""Text functions: masking, log clean-up, delimited parsing, endpoints."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetframe import fixed


def strip(text: Column) -> Column:
    """Remove white space of every kind from both ends (``trim`` alone removes only blanks)."""
    return F.btrim(text, F.lit(fixed.WHITE_SPACE))


def mask_credentials(text: Column, strict: bool = False) -> Column:
    """Replace the password of every connection string in ``text``.

    The default reads up to the next ``@``. ``strict`` reads up to the last ``@`` before a slash or white space, so a
    password that itself holds an ``@`` is hidden in full.
    """
    pattern = fixed.URI_SECRET_STRICT if strict else fixed.URI_SECRET
    # Text without an @ has nothing to mask and is not searched.
    return F.when(text.contains("@"), F.regexp_replace(text, pattern, f"$1{fixed.MASK}$3")).otherwise(text)


def mask_list(values: Column, strict: bool = False) -> Column:
    """Mask every element of a string array."""
    return F.transform(values, lambda v: mask_credentials(v, strict))


def mask_map(values: Column, strict: bool = False) -> Column:
    """Mask every value of a string map."""
    return F.transform_values(values, lambda _, v: mask_credentials(v, strict))


def is_log_line(line: Column) -> Column:
    """True for a line that starts with a server log timestamp and severity."""
    return F.regexp_like(line, F.lit(fixed.SERVER_LOG_LINE))


def drop_log_lines(text: Column) -> Column:
    """Remove server log lines from multi-line text; empty text if nothing is left."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda line: ~is_log_line(line)), "\n")


def _literal(delimiter: str) -> str:
    return "\\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def parse_pairs(text: Column, outer: str = ",", inner: str = "=") -> Column:
    """Parse ``k=v,k=v`` to ``struct<pairs map, parse_error boolean>``.

    Null or empty text gives null pairs without an error. A part that lacks exactly one inner delimiter makes the row
    an error. Keys and values are stripped; the last value of a repeated key wins.
    """
    parts = F.transform(F.split(text, _literal(outer)), lambda p: F.split(p, _literal(inner)))
    blank = text.isNull() | (text == "")
    good = F.forall(parts, lambda p: F.size(p) == 2)
    # Sorted by key and place, the last entry of each key is the one whose successor has another key.
    entries = F.array_sort(F.transform(parts, lambda p, i: F.struct(
        strip(F.get(p, F.lit(0))).alias("key"), i.alias("place"), strip(F.get(p, F.lit(1))).alias("value")
    )))
    last = F.filter(entries, lambda e, i: ~F.get(entries, i + 1)["key"].eqNullSafe(e["key"]))
    pairs = F.map_from_entries(F.transform(last, lambda e: F.struct(e["key"], e["value"])))
    return F.struct(
        F.when(~blank & good, pairs).alias("pairs"), F.coalesce(~blank & ~good, F.lit(False)).alias("parse_error")
    )


def endpoint_uri(node: Column, port: Column) -> Column:
    """Connection string of one node."""
    return F.concat(F.lit("mongodb://"), node, F.lit(":"), port.cast("string"), F.lit("/"))


def manager_urls(node: Column, port: Column) -> Column:
    """``struct<network_url, external_url>`` of a manager."""
    tail = F.concat(F.lit(":"), port.cast("string"))
    return F.struct(
        F.concat(F.lit("http://"), node, tail).alias("network_url"),
        F.concat(F.lit("http://localhost"), tail).alias("external_url"),
    )


def safe_path(path: Column) -> Column:
    """True for a path that may be acted on: not null, not blank, not the root."""
    return path.isNotNull() & ~strip(path).isin("", "/")
