"""Lists kept as JSON text in a key/value store, and array functions over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: How many entries a history keeps and shows.
KEEP, SHOW = 12, 4
ENTRY = "array<struct<url:string,name:string,img:string,price:string,brand:string>>"


def parse_list(text: Column, schema: str = ENTRY) -> Column:
    """SC4, JS2: the stored list; empty for a missing or broken value."""
    empty = F.from_json(F.lit("[]"), schema)
    return F.coalesce(F.from_json(text, schema), empty)


def without(items: Column, url: Column) -> Column:
    """FL24, AR2"""
    return F.filter(items, lambda x: x["url"] != url)


def shown(items: Column, url: Column, most: int = SHOW) -> Column:
    """OR2, AR3: what a visitor of ``url`` is shown of the history."""
    return F.slice(without(items, url), 1, most)


def visited(items: Column, entry: Column, most: int = KEEP) -> Column:
    """SO4, SK4: the history after a visit: the new entry first, its older one gone, cut to ``most``."""
    return F.slice(F.array_prepend(without(items, entry["url"]), entry), 1, most)


def join(items: Column, separator: str, render: Callable[[Column], Column]) -> Column:
    """AR1, ST3: the elements rendered and joined in order."""
    return F.array_join(F.transform(items, render), separator)
