"""Functions over label maps and environment arrays."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from fleetframe import fixed


@dataclass(frozen=True)
class LabelScheme:
    """How node labels are spelled: set ``prefix`` and ``source_value`` to those your fleet was labelled with."""

    prefix: str = "fleet-"
    source_key: str = "source"
    source_value: str = "fleet"

    def key(self, name: str) -> str:
        """Full label key of a field, e.g. ``group`` to ``fleet-group``."""
        return self.prefix + name

    def label(self, labels: Column, name: str) -> Column:
        """Value of a field, null if the key is absent."""
        return F.try_element_at(labels, F.lit(self.key(name)))


def to_int(text: Column) -> Column:
    """Whole number of a text, null if it is not one. Single underscores between digits are allowed."""
    plain = F.regexp_replace(text, "(?<=[0-9])_(?=[0-9])", "")
    return F.coalesce(text.try_cast("int"), F.when(text.contains("_"), plain.try_cast("int")))


def default_to(value: Column, default) -> Column:
    """``value``, or ``default`` where it is null."""
    return F.coalesce(value, F.lit(default))


def env_value(env: Column, variable: str) -> Column:
    """Value of the first ``variable=...`` entry, cut at a second ``=``; null if there is none."""
    hit = F.try_element_at(F.filter(env, lambda e: e.startswith(f"{variable}=")), F.lit(1))
    return F.split_part(hit, F.lit("="), F.lit(2))


def canonical_type(raw: Column) -> Column:
    """Canonical deployment type; blanks, underscores and case do not matter. Null if unknown."""
    names = F.create_map(*[F.lit(x) for pair in fixed.TYPE_NAMES.items() for x in pair])
    return F.try_element_at(names, F.lower(F.translate(raw, " _", "--")))


def known_type(raw: Column) -> Column:
    """Canonical type, raising an error for an unknown one."""
    name = canonical_type(raw)
    return F.coalesce(name, F.raise_error(F.concat(F.lit("unknown deployment type: "), raw)).cast("string"))


def short_id(full: Column) -> Column:
    """First 12 characters of an identifier."""
    return F.substring(full, 1, 12)


def overlay(labels: Column, values: dict[str, Column], prefix: str | None = None) -> Column:
    """``labels`` with ``values`` put over them, with ``prefix`` only those labels that start with it.

    Does not depend on the session's duplicate-key policy.
    """
    names = list(values)

    def stays(key: Column, _: Column) -> Column:
        other = ~key.isin(names)
        return other & F.startswith(key, F.lit(prefix)) if prefix else other

    flat = [x for k, v in values.items() for x in (F.lit(k), v)]
    return F.map_concat(F.map_filter(labels, stays), F.create_map(*flat))


def prefixed_only(labels: Column, prefix: str) -> Column:
    """Only the entries whose key starts with ``prefix``."""
    return F.map_filter(labels, lambda k, _: F.startswith(k, F.lit(prefix)))
