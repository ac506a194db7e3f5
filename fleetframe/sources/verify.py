"""Order-free digests of table contents: what was sent against what was landed."""

from __future__ import annotations

from decimal import Decimal
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F

_TEXT = {"ignoreNullFields": "false", "timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX", "timestampNTZFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"}


class Digest(NamedTuple):
    """Number of rows and the sums of two 64-bit hashes of every row. Equal contents have equal digests, in whatever order their rows lie."""

    rows: int
    low: Decimal
    high: Decimal


def _quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def row_hashes(df: DataFrame) -> tuple[Column, Column]:
    """Two hashes of a whole row. The row is hashed as text that tells nulls, empty values, nesting and the column apart."""
    text = F.to_json(F.struct(*[_quoted(c) for c in df.columns]), _TEXT)
    # Wide enough that sums over 10^19 equal rows do not overflow.
    wide = lambda h: h.cast("decimal(28,0)")
    return wide(F.xxhash64(text)), wide(F.xxhash64(F.lit(1), text))


def _measures(df: DataFrame) -> list[Column]:
    low, high = row_hashes(df)
    total = lambda h: F.coalesce(F.sum(h), F.lit(0).cast("decimal(38,0)"))
    return [F.count(F.lit(1)).alias("rows"), total(low).alias("low"), total(high).alias("high")]


def content_digest(df: DataFrame) -> Digest:
    """The digest of a table, in one pass that map tasks combine to one row each."""
    row = df.agg(*_measures(df)).first()
    return Digest(row["rows"], row["low"], row["high"])


def observed(df: DataFrame) -> tuple[DataFrame, Observation]:
    """The same table, whose digest is taken by the job that writes it; ``digest_of`` reads it afterwards."""
    seen = Observation("content")
    return df.observe(seen, *_measures(df)), seen


def digest_of(seen: Observation) -> Digest:
    got = seen.get
    return Digest(got["rows"], got["low"], got["high"])


def differing(sent: DataFrame, landed: DataFrame, by: list[str]) -> DataFrame:
    """The groups in which two tables of the same columns differ: ``by``, ``sent_rows``, ``landed_rows``.

    Finds rows that were changed, lost, doubled or moved to another group, also where the counts agree. Rows are combined before the one shuffle, so a
    group that holds most rows costs no more than others. Rows with a null key make a group of their own.
    """
    both = None
    for df, side in ((sent, 1), (landed.select(*[_quoted(c) for c in sent.columns]), -1)):
        low, high = row_hashes(df)
        signed = df.select(*[_quoted(c) for c in by], F.lit(side).alias("__side"), (low * side).alias("__low"), (high * side).alias("__high"))
        both = signed if both is None else both.union(signed)
    sums = both.groupBy(*[_quoted(c) for c in by]).agg(
        F.count_if(F.col("__side") == 1).alias("sent_rows"), F.count_if(F.col("__side") == -1).alias("landed_rows"),
        F.sum("__low").alias("__low"), F.sum("__high").alias("__high"),
    )
    changed = (F.col("sent_rows") != F.col("landed_rows")) | (F.col("__low") != 0) | (F.col("__high") != 0)
    return sums.where(changed).drop("__low", "__high")
