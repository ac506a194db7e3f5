"""Grouped positions and keyed joins that hold up when a few keys own most of the rows.

A window or a hash join sends all rows of a key to one task. Both are right for ordinary keys. Keys above a row limit
are found first with one partial-aggregated count, and only their rows go another way:

* positions: a range sort spreads a hot group over many tasks; each task's start is a running total over task sizes;
* joins: the rows stay where they are and the few matching rows of the other side are broadcast.

With more hot keys than may be broadcast nothing is joined on the bare key: the whole table is numbered by the range sort, and joins deal the
rows of every key over ``SALTS`` tasks, next to as many copies of the other side's one row per key.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from fleetframe.session import pinned, setting

HOT_ROWS = 1_000_000
BROADCAST_ROWS = 10_000
SALTS = 16

_MARK = "__mark"
_RUN = "__run"
_SALT = "__salt"


def broadcast_rows(spark: SparkSession) -> int:
    """Rows of a small table that may be broadcast: setting ``spark.fleetframe.broadcastRows``."""
    return setting(spark, "broadcastRows", BROADCAST_ROWS)


def _other(key: str) -> str:
    return f"__other_{key}"


def _same(keys: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(_other(k))) for k in keys], F.lit(True))


@dataclass
class HotKeys:
    """Keys above the row limit: none (``rows`` is None), a few to broadcast, or ``many`` (``rows`` is None, ``count`` unknown).

    The columns of ``rows`` are named by ``_other``.
    """

    keys: list[str]
    rows: DataFrame | None
    count: int = 0
    many: bool = False

    def __bool__(self) -> bool:
        return self.rows is not None or self.many

    def _join(self, df: DataFrame, how: str) -> DataFrame:
        return df.join(F.broadcast(self.rows), _same(self.keys), how)

    def only(self, df: DataFrame) -> DataFrame:
        """Rows of hot keys."""
        return self._join(df, "left_semi")

    def without(self, df: DataFrame) -> DataFrame:
        """Rows of all other keys."""
        return self._join(df, "left_anti")


def hot_keys(df: DataFrame, keys: list[str], limit: int | None = None) -> HotKeys:
    """Find the keys with more than ``limit`` rows (default: setting ``spark.fleetframe.hotRows``).

    There are at most (rows / limit) of them. Up to ``broadcast_rows`` come back as a local table to broadcast; of more only the fact
    that they are many is kept.
    """
    spark = df.sparkSession
    limit, most = limit or setting(spark, "hotRows", HOT_ROWS), broadcast_rows(spark)
    counts = df.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > limit)
    counts = counts.select(*[F.col(k).alias(_other(k)) for k in keys])
    found = counts.limit(most + 1).collect()
    if not found:
        return HotKeys(keys, None)
    if len(found) > most:
        return HotKeys(keys, None, many=True)
    return HotKeys(keys, spark.createDataFrame(found, counts.schema), len(found))


def window_positions(
    df: DataFrame,
    keys: list[str],
    order: list,
    name: str = "position",
    size: str | None = None,
    first: dict[str, str] | None = None,
) -> DataFrame:
    """Number the rows of each group with a window: each group is sorted in one task."""
    group = Window.partitionBy(*keys)
    ordered = group.orderBy(*order)
    new = {name: F.row_number().over(ordered).cast("long")}
    if size:
        new[size] = F.count(F.lit(1)).over(group)
    for out, source in (first or {}).items():
        new[out] = F.first(source).over(ordered)
    return df.withColumns(new)


def range_positions(
    df: DataFrame,
    keys: list[str],
    order: list,
    name: str = "position",
    size: str | None = None,
    first: dict[str, str] | None = None,
    n_keys: int | None = 1,
) -> DataFrame:
    """Number the rows of each group with a range sort: a group may cover many tasks.

    ``n_keys`` is the number of groups, or the most there can be; None if that is not known.
    """
    first = first or {}
    by = [*keys, *order]
    few = (n_keys or 0) + int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The row mark numbers rows in sorted order within each task. It is written out, so both uses below see one order.
    marked = pinned(
        df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn(_MARK, F.monotonically_increasing_id())
    ).withColumn(_RUN, F.shiftright(_MARK, 33))
    parts = [*keys, _RUN]
    runs = marked.groupBy(*[F.col(k).alias(_other(k)) for k in parts]).agg(
        F.min(_MARK).alias("__start"),
        F.count("*").alias("__rows"),
        *[F.min_by(F.struct(source), _MARK).alias(f"__{out}") for out, source in first.items()],
    )
    # One row per (key, task): no key has more rows here than there are sort tasks, and all keys together have at most
    # (keys + sort tasks) rows.
    group = Window.partitionBy(*[_other(k) for k in keys])
    ordered = group.orderBy(_other(_RUN))
    before = F.coalesce(F.sum("__rows").over(ordered.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    extra = {"__before": before}
    if size:
        extra[size] = F.sum("__rows").over(group)
    for out, source in first.items():
        extra[out] = F.first(f"__{out}").over(ordered)[source]
    runs = runs.withColumns(extra)
    if n_keys is not None and broadcast_rows(df.sparkSession) >= few:
        runs = F.broadcast(runs)
    return marked.join(runs, _same(parts)).select(
        *df.columns,
        (F.col(_MARK) - F.col("__start") + 1 + F.col("__before")).alias(name),
        *([size] if size else []),
        *first,
    )


def positions(
    df: DataFrame,
    keys: list[str],
    order: list,
    name: str = "position",
    size: str | None = None,
    first: dict[str, str] | None = None,
    hot: HotKeys | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in ``order``, which must end in a unique column.

    ``size`` names a column for the group's row count; ``first`` maps new columns to columns whose value in the
    group's first row is wanted. Without ``keys`` the whole table is one group and is numbered by a range sort.
    """
    if not keys:
        return range_positions(df, [], order, name, size, first)
    hot = hot if hot is not None else hot_keys(df, keys)
    if not hot:
        return window_positions(df, keys, order, name, size, first)
    if hot.many:
        return range_positions(df, keys, order, name, size, first, None)
    usual = window_positions(hot.without(df), keys, order, name, size, first)
    return usual.unionByName(range_positions(hot.only(df), keys, order, name, size, first, hot.count))


def keyed_join(
    left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner", hot: HotKeys | None = None
) -> DataFrame:
    """Join ``left`` to a table with at most one row per ``on`` value (inner, left_semi or left_anti).

    Rows of a hot key of ``left`` do not move. Rows without a key never match and are kept out of the shuffle.
    """
    on = [on] if isinstance(on, str) else list(on)
    has_key = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in on])
    keyed = left.where(has_key)
    hot = hot if hot is not None else hot_keys(keyed, on)
    if hot.many:
        joined = _salted_join(keyed, right, on, how)
    else:
        joined = (hot.without(keyed) if hot else keyed).join(right, on, how)
        if hot:
            joined = joined.unionByName(hot.only(keyed).join(F.broadcast(hot.only(right)), on, how))
    if how == "left_anti":
        joined = joined.unionByName(left.where(~has_key))
    return joined


def _salted_join(left: DataFrame, right: DataFrame, on: list[str], how: str) -> DataFrame:
    """The same join with the rows of every key dealt over ``SALTS`` tasks."""
    salts = setting(left.sparkSession, "salts", SALTS)
    # A hash of the row itself: a task that is run again deals its rows the same way.
    plain = [f.name for f in left.schema.fields if "map<" not in f.dataType.simpleString()]
    dealt = left.withColumn(_SALT, F.pmod(F.xxhash64(*plain), F.lit(salts)).cast("int"))
    copies = right.withColumn(_SALT, F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return dealt.join(copies, [*on, _SALT], how).drop(_SALT)


def matching(left: DataFrame, keys: DataFrame, on: str | list[str], hot: HotKeys | None = None) -> DataFrame:
    """Rows of ``left`` whose ``on`` value occurs in ``keys``."""
    return keyed_join(left, keys.select(on).distinct(), on, "left_semi", hot)


def not_matching(left: DataFrame, keys: DataFrame, on: str | list[str], hot: HotKeys | None = None) -> DataFrame:
    """Rows of ``left`` whose ``on`` value does not occur in ``keys``."""
    return keyed_join(left, keys.select(on).distinct(), on, "left_anti", hot)
