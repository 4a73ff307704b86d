"""Modifiers of a play, from the JSON that comes with it: list, variant key and speed class."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MODS_SCHEMA = "mods array<struct<acronym:string>>"
FAST, SLOW = ("DT", "NC"), ("HT",)


def modifiers(data: Column) -> Column:
    """Acronyms listed in the JSON; an empty array for null, malformed or other JSON. Nulls in the list are left out."""
    listed = F.from_json(data, MODS_SCHEMA)["mods"]
    names = F.filter(F.transform(listed, lambda m: m["acronym"]), lambda a: a.isNotNull())
    return F.coalesce(names, F.array().cast("array<string>"))


def variant_key(mods: Column) -> Column:
    """Acronyms sorted by code point and joined with commas; '' for none; repeated ones stay."""
    return F.array_join(F.array_sort(mods), ",")


def speed_class(mods: Column) -> Column:
    """'DT' with a fast modifier, else 'HT' with a slow one, else null."""
    has = lambda names: F.arrays_overlap(mods, F.array(*[F.lit(n) for n in names]))
    return F.when(has(FAST), "DT").when(has(SLOW), "HT")


def requested_variant(mods: list[str] | None) -> str | None:
    """The key of a requested list of modifiers, in the order of stored keys; None for no request."""
    return ",".join(sorted(mods)) if mods else None
