"""Text functions as column expressions."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F


def template(pattern: str, **values: Column) -> Column:
    """ST1: ``{name}`` slots filled with columns; null in any slot makes null."""
    parts: list[Column] = []
    rest = pattern
    while rest:
        before, found, after = rest.partition("{")
        if before:
            parts.append(F.lit(before))
        if not found:
            break
        name, _, rest = after.partition("}")
        parts.append(values[name].cast("string"))
    return F.concat(*parts) if parts else F.lit("")


def fill_tokens(html: Column, values: Mapping[str, Column]) -> Column:
    """ST4: ``{{NAME}}`` slots; a null value leaves its slot, so that ``unfilled`` finds it."""
    for name, value in values.items():
        slot = "{{" + name + "}}"
        html = F.replace(html, F.lit(slot), F.coalesce(value.cast("string"), F.lit(slot)))
    return html


def unfilled(html: Column) -> Column:
    """FL29"""
    return F.instr(html, "{{") > 0


def word_count(text: Column) -> Column:
    """Words between white space; 0 for null and blank text."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("long")


def within_words(text: Column, low: int = 150, high: int = 250) -> Column:
    """FL28"""
    return word_count(text).between(low, high)


def starts_with_any(path: Column, prefixes: list[str]) -> Column:
    """ST5, FL25"""
    return F.exists(F.array(*[F.lit(p) for p in prefixes]), lambda p: F.startswith(path, p))


def fixed(value: Column, places: int) -> Column:
    """ST6: decimal places by half-up rounding of the decimal value."""
    return F.round(value.cast("decimal(30,10)"), places).cast(f"decimal(30,{places})").cast("string")


def pad2(value: Column) -> Column:
    """ST7: two digits at least; longer numbers stay whole."""
    return F.when(value < 10, F.concat(F.lit("0"), value.cast("string"))).otherwise(value.cast("string"))


def falsy(value: Column, default: Column) -> Column:
    """CN2: the default for null and empty text."""
    return F.coalesce(F.nullif(value, F.lit("")), default)


def title(brand: Column, model: Column, blade: Column, steel: Column, tail: str = "In Stock") -> Column:
    """ST10"""
    return template('{brand} {model} {blade}" {steel} — ' + tail, brand=brand, model=model, blade=blade, steel=steel)


def permalink(path: Column) -> Column:
    """ST11: dated paths move below /blog/."""
    return F.regexp_replace(path, r"^/\d{4}/\d{2}/\d{2}/([^/]+)/?$", "/blog/$1/")


def canonical(url: Column, host: str | None = None) -> Column:
    """ST12: https, one host, lower-case, a closing slash, no query or fragment."""
    own = F.lit(host) if host else F.lower(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""))
    path = F.coalesce(F.nullif(F.try_parse_url(url, F.lit("PATH")), F.lit("")), F.lit("/"))
    return F.concat(F.lit("https://"), own, F.when(F.endswith(path, F.lit("/")), path).otherwise(F.concat(path, F.lit("/"))))


def escape(text: Column) -> Column:
    """ST13: text that is safe in markup and in quoted attributes."""
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(raw), F.lit(safe))
    return text


def site_search(text: Column, words: str) -> Column:
    """SK6: all words of a search occur, in any case."""
    found = F.lit(True)
    for w in words.lower().split():
        found = found & F.contains(F.lower(text), F.lit(w))
    return found
