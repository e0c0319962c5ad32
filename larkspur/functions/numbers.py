"""Money, shares and scores. Money is decimal; rounding is half up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MONEY = "decimal(12,2)"


def money(value: Column) -> Column:
    return F.round(value.cast("decimal(20,6)"), 2).cast(MONEY)


def parse_number(text: Column, default: float, kind: str = "double") -> Column:
    """ST8, SC5, SC6: the number that a text is, or the default."""
    return F.coalesce(text.try_cast(kind), F.lit(default).cast(kind))


def at_least_one(qty: Column) -> Column:
    """ST9"""
    return F.greatest(F.coalesce(qty, F.lit(1)), F.lit(1))


def gift_percent(cart: Column, threshold: Column) -> Column:
    """MA1: per cent of the threshold, 100 at most; decimal for decimals."""
    return F.least(F.lit(100), cart / threshold * 100)


def gift_left(cart: Column, threshold: Column) -> Column:
    """MA2: what is still to spend, 0 once unlocked (at the threshold itself)."""
    return F.greatest(threshold - cart, F.lit(0).cast(MONEY))


def save_percent(rrp: Column, price: Column) -> Column:
    """MA3: whole per cent."""
    return F.round((rrp - price).cast("decimal(20,8)") / F.nullif(rrp, F.lit(0).cast(MONEY)).cast("decimal(20,8)") * 100, 0).cast("long")


def save_amount(rrp: Column, price: Column) -> Column:
    return (rrp - price).cast(MONEY)


def ratio(a: Column, b: Column) -> Column:
    """MA4 to MA7: null for a zero divisor."""
    return a.cast("double") / F.nullif(b.cast("double"), F.lit(0.0))


def sku_score(in_stock: Column, margin: Column, volume: Column) -> Column:
    """MA8, FL31"""
    return in_stock.cast("int").cast("double") * margin * volume


def worth_listing(in_stock: Column, margin: Column, volume: Column, least_margin: float, least_volume: float) -> Column:
    """FL31: the gate of three parts: in stock, a margin above the least, a volume not below it; what isn't known fails."""
    return in_stock & (margin > least_margin) & (volume >= least_volume)


def scroll_percent(y: Column, height: Column) -> Column:
    """MA9: a page that can't scroll is read to its end."""
    return F.when(height > 0, y.cast("double") / height * 100).otherwise(100.0)


def engaged(percent: Column, elapsed_ms: Column, least_percent: float, delay_ms: int) -> Column:
    """FL32"""
    return (percent >= least_percent) & (elapsed_ms >= delay_ms)


def price_band(price: Column, edges: list[float]) -> Column:
    """FL16: disjoint bands, numbered from 0: below the first edge, ..., from the last edge on."""
    out = F.when(price < edges[0], 0)
    for k, edge in enumerate(edges[1:], 1):
        out = out.when(price < edge, k)
    return out.otherwise(len(edges)).cast("long")
