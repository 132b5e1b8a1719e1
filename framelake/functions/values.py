"""Functions over arrays, maps and numbers, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_match(values: Column, fits: Callable[[Column], Column], otherwise: Column) -> Column:
    """The first element that fits, or another value."""
    return F.coalesce(F.get(F.filter(values, fits), F.lit(0)), otherwise)


def lookup(held: Column, key: Column, otherwise: Column) -> Column:
    """A map's value for a key, or another value where it has none."""
    return F.coalesce(F.try_element_at(held, key), otherwise)


def flattened(lists: Column, inner: Callable[[Column], Column]) -> Column:
    """What `inner` makes of each element, in one array."""
    return F.flatten(F.transform(lists, inner))


def merged_times(earlier: Column, later: Column) -> Column:
    """Seconds by step; a step that is in both has its later value."""
    return F.map_concat(F.map_filter(F.coalesce(earlier, F.create_map().cast("map<string,double>")), lambda k, _: ~F.map_contains_key(later, k)), later)


def guarded_ratio(part: Column, whole: Column, least: float = 1e-6) -> Column:
    """part / whole with a whole of at least `least`, within 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), part / F.greatest(whole, F.lit(least))))


def percent(share: Column) -> Column:
    """0.256 as 26%."""
    return F.format_string("%d%%", F.bround(share * 100, 0).cast("long"))


def grouped(n: Column) -> Column:
    """1234567 as 1,234,567."""
    return F.format_number(n, 0)


def canonical_json(**fields: Column) -> Column:
    """An object as JSON with its keys in order and no spaces, so that equal values have one text and one hash. Null fields are left out."""
    return F.to_json(F.struct(*(fields[k].alias(k) for k in sorted(fields))))
