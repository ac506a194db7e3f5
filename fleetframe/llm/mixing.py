"""Mixing sources to target weights: hash-random order within each source, distributed prefix sums of sizes, a cut at the exact budget.

All steps are DataFrame functions. A source is cut into key ranges of about RANGE_ROWS documents, so no task holds a whole source, however
large: sums of the ranges give each range its offset, and documents are numbered within their range only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import BROADCAST_ROWS, written

WORD = r"[^\x20\x09-\x0D]+"
RANGE_ROWS = 4_000


def targets(sizes: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2) -> DataFrame:
    """(source, source_size, target) from (source, size) rows; one row per source, which is all that any step here holds.

    Sources ordered by code point, null last, get the weights in turn. They share `share` times the sum of all sizes by weight; a target
    stops at `most` times its source's size and the excess is shared again. In closed form: with sources sorted by cap / weight, those
    before the first whose cap is at least level * weight get their cap, the others level * weight.
    """
    each = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count(F.lit(1)).alias("rows"))
    turn = (F.row_number().over(Window.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    each = each.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), turn + 1))
    each = each.withColumn("cap", F.col("source_size") * most)
    up = Window.orderBy(F.col("cap") / F.col("weight"), F.asc_nulls_last("source"))
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    since = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    every = up.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.sum("source_size").over(every) * F.lit(share) - F.coalesce(F.sum("cap").over(before), F.lit(0))) / F.sum("weight").over(since)
    each = each.withColumn("level", level)
    # Levels rise up to the first source that does not reach its cap and fall after it.
    fits = F.max(F.when(F.col("cap") / F.col("weight") >= F.col("level"), F.col("level"))).over(every)
    target = F.least(F.col("cap").cast("double"), F.coalesce(fits * F.col("weight"), F.col("cap").cast("double")))
    return each.select("source", "source_size", "rows", target.alias("target"))


def mixture(docs: DataFrame, share: float = 1.5, weights: tuple[int, ...] = (3, 1, 2), most: int = 2, seed: str = "mix") -> DataFrame:
    """How many words the mix takes of each document.

    docs needs doc_id, text and source; other columns are ignored. Result, one row per row of docs: doc_id, source, size (words; null
    text 0), source_size, target, taken. A source's budget is its target, rounded. Whole epochs of the source come first, then its
    documents in the order of md5(seed:doc_id) up to the budget; the document at the cut gives the words that are left, so taken
    words sum to the budget exactly. Ties in the order (repeated ids) go to the smaller id, then the smaller size. A null source is a source
    of its own. Sources without words have target 0. An empty table gives an empty result.
    """
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"))
    size = F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    rows = written(docs.select("doc_id", "source", size.alias("size"), key.alias("key")), "sizes")
    plan = written(targets(rows, share, weights, most), "targets")
    if plan.count() <= BROADCAST_ROWS:
        plan = F.broadcast(plan)
    same = rows["source"].eqNullSafe(plan["source"])
    place = F.conv(F.substring("key", 1, 8), 16, 10).cast("long")
    n_ranges = F.ceil(F.col("rows") / RANGE_ROWS)
    dealt = rows.join(plan, same).select(
        "doc_id", rows["source"], "size", "key", "source_size", "target", F.floor(place * n_ranges / F.lit(1 << 32)).alias("range")
    )
    sums = dealt.groupBy("source", "range").agg(F.sum("size").alias("sum"))
    ahead = Window.partitionBy("source").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select(F.col("source").alias("s"), F.col("range").alias("r"), F.coalesce(F.sum("sum").over(ahead), F.lit(0)).alias("offset"))
    within = Window.partitionBy("source", "range").orderBy("key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("inner", F.coalesce(F.sum("size").over(within), F.lit(0)))
    placed = placed.join(offsets, placed["source"].eqNullSafe(offsets["s"]) & (placed["range"] == offsets["r"]))
    budget = F.round("target").cast("long")
    epochs = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(F.lit(0))
    rest = budget - epochs * F.col("source_size")
    cut = F.least(F.greatest(rest - F.col("offset") - F.col("inner"), F.lit(0)), F.col("size"))
    return placed.select("doc_id", "source", "size", "source_size", "target", (epochs * F.col("size") + cut).cast("long").alias("taken"))


def mixed(docs: DataFrame, **how) -> DataFrame:
    """The mix itself: the columns of docs, epoch (from 1) and n_words. A document taken in part in its last epoch gives its first words,
    joined by single spaces. Documents of which nothing is taken give no row. Rows that share a doc_id and a source give the words of all of them.
    Columns of docs named epoch or n_words give way to those of the mix."""
    plan = mixture(docs, **how).groupBy("doc_id", "source").agg(F.sum("taken").alias("taken"), F.sum("size").alias("size")).filter("taken > 0")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    took = packed.join(plan, F.col("row.doc_id").eqNullSafe(plan["doc_id"]) & F.col("row.source").eqNullSafe(plan["source"]))
    words = F.coalesce(F.regexp_count(F.col("row.text").cast("string"), F.lit(WORD)), F.lit(0))
    took = took.select("row", words.alias("n"), (F.col("taken") / F.col("size")).alias("times"))
    took = took.withColumn("taken", F.round(F.col("times") * F.col("n")).cast("long")).filter("taken > 0")
    took = took.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.ceil(F.col("taken") / F.col("n")).cast("int"))))
    took = took.withColumn("n_words", F.least(F.col("n"), F.col("taken") - (F.col("epoch") - 1) * F.col("n")).cast("long"))
    cut = F.concat_ws(" ", F.slice(F.regexp_extract_all("row.text", F.lit(f"({WORD})"), 1), F.lit(1), F.col("n_words").cast("int")))
    text = F.when(F.col("n_words") < F.col("n"), cut).otherwise(F.col("row.text"))
    own = [text.alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in ("epoch", "n_words")]
    return took.select(*own, "epoch", "n_words")
