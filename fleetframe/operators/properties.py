"""Property tables: parse ``key=value`` lines and put settings over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fleetframe.functions import strip
from fleetframe.operators.skew import keyed_join


def overlay_properties(base: DataFrame, settings: DataFrame, document: str = "doc") -> DataFrame:
    """``base`` (document, key, value) without the keys that ``settings`` sets, followed by ``settings``.

    ``settings`` has a column ``seq``; of several values for one (document, key) the last counts, as if they had been
    applied one after another.
    """
    last = settings.groupBy(document, "key").agg(F.max_by("value", "seq").alias("value"))
    kept = keyed_join(base, last.select(document, "key"), [document, "key"], "left_anti")
    return kept.select(document, "key", "value").unionByName(last.select(document, "key", "value"))


def property_lines(texts: DataFrame, document: str = "doc", text: str = "text", separator: str = "\n") -> DataFrame:
    """One row per ``key=value`` line of each text: ``document, key, value``; lines without ``=`` are left out."""
    line = F.col("line")
    at = F.instr(line, "=")
    return (
        texts.select(document, F.explode(F.split(text, "\\Q" + separator + "\\E")).alias("line"))
        .where(at > 0)
        .select(
            document,
            strip(F.substring(line, F.lit(1), at - 1)).alias("key"),
            F.substring(line, at + 1, F.length(line)).alias("value"),
        )
    )


def file_lines(texts: DataFrame, document: str = "doc", text: str = "text", separator: str = "\n") -> DataFrame:
    """Every line of each text: ``document, line_no, line, key, value``; key and value are null for comments, blanks and lines without ``=``."""
    line = F.col("line")
    at = F.instr(line, "=")
    setting = (at > 0) & ~F.coalesce(F.startswith(F.ltrim(line), F.lit("#")), F.lit(False))
    return texts.select(document, F.posexplode(F.split(text, "\\Q" + separator + "\\E")).alias("line_no", "line")).select(
        document, "line_no", "line",
        F.when(setting, strip(F.substring(line, F.lit(1), at - 1))).alias("key"),
        F.when(setting, F.substring(line, at + 1, F.length(line))).alias("value"),
    )


def overlay_file(lines: DataFrame, settings: DataFrame, document: str = "doc") -> DataFrame:
    """``document, line_no, line`` of files with settings put over them: lines that set a given key go, all others stay in place.

    The settings follow at the end by key, the last value of each. ``lines`` is the result of ``file_lines``.
    """
    last = settings.groupBy(document, "key").agg(F.max_by("value", "seq").alias("value"))
    kept = keyed_join(lines, last.select(document, "key"), [document, "key"], "left_anti").select(document, "line_no", "line")
    ends = lines.groupBy(document).agg((F.max("line_no") + 1).alias("start"))
    gathered = last.groupBy(document).agg(F.array_sort(F.collect_list(F.struct("key", "value"))).alias("all"))
    added = gathered.join(ends, document, "left").select(document, "start", F.posexplode("all").alias("place", "x"))
    added = added.select(document, (F.coalesce("start", F.lit(0)) + F.col("place")).alias("line_no"), F.concat("x.key", F.lit("="), "x.value").alias("line"))
    return kept.unionByName(added)
