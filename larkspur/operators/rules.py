"""Collection rules: a small typed tree that compiles to one column expression.

Conditions are plain comparisons, so they push down to the scan, and any number of rules is evaluated in a single pass. A rule
that meets a null attribute doesn't hold (it fails closed), also under negation.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from decimal import Decimal
from functools import reduce
from operator import and_, or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class Rule:
    def column(self) -> Column:
        """True or false, never null: for flags."""
        return F.coalesce(self.condition(), F.lit(False))

    def condition(self) -> Column:
        """For filters, where null fails like false; nothing wraps the comparisons, so the scan can take them over."""
        raise NotImplementedError

    def attributes(self) -> frozenset[str]:
        raise NotImplementedError


@dataclass(frozen=True)
class In(Rule):
    """FL3 to FL5, FL10, FL11, FL13, FL14, FL18 to FL21"""

    attribute: str
    values: tuple

    def condition(self) -> Column:
        return F.col(self.attribute).isin(*self.values)

    def attributes(self) -> frozenset[str]:
        return frozenset([self.attribute])


@dataclass(frozen=True)
class NotIn(Rule):
    """FL7: a missing value is not known to be outside, so it fails."""

    attribute: str
    values: tuple

    def condition(self) -> Column:
        return ~F.col(self.attribute).isin(*self.values)

    def attributes(self) -> frozenset[str]:
        return frozenset([self.attribute])


@dataclass(frozen=True)
class Bound(Rule):
    """FL8, FL9, FL15, FL17: lower and upper bounds, each with or without its own value."""

    attribute: str
    low: Decimal | None = None
    high: Decimal | None = None
    low_included: bool = True
    high_included: bool = False

    def condition(self) -> Column:
        c = F.col(self.attribute)
        out = [c.isNotNull()]
        if self.low is not None:
            out.append(c >= self.low if self.low_included else c > self.low)
        if self.high is not None:
            out.append(c <= self.high if self.high_included else c < self.high)
        return reduce(and_, out)

    def attributes(self) -> frozenset[str]:
        return frozenset([self.attribute])


@dataclass(frozen=True)
class All(Rule):
    """FL6, and with no parts: everything."""

    parts: tuple[Rule, ...] = ()

    def condition(self) -> Column:
        return reduce(and_, [p.condition() for p in self.parts]) if self.parts else F.lit(True)

    def attributes(self) -> frozenset[str]:
        return frozenset().union(*[p.attributes() for p in self.parts])


@dataclass(frozen=True)
class Any(Rule):
    parts: tuple[Rule, ...]

    def condition(self) -> Column:
        return reduce(or_, [p.condition() for p in self.parts]) if self.parts else F.lit(False)

    def attributes(self) -> frozenset[str]:
        return frozenset().union(*[p.attributes() for p in self.parts])


@dataclass(frozen=True)
class Curated(Rule):
    """FL12: no predicate; members come from a list of (slug, sku)."""

    slug: str = ""

    def condition(self) -> Column:
        return F.lit(False)

    def attributes(self) -> frozenset[str]:
        return frozenset()


_TERM = re.compile(r"(?P<attribute>[a-z_]+)\s*(?P<op><=|<|=|\bNOT\b)\s*(?P<value>.+)")


def _term(text: str) -> Rule:
    m = _TERM.fullmatch(text.strip())
    if not m:
        raise ValueError(f"not a rule: {text!r}")
    attribute, op, value = m["attribute"], m["op"], m["value"].strip()
    if op in ("<", "<="):
        return Bound(attribute, high=Decimal(value), high_included=op == "<=")
    values = tuple(v.strip() for v in re.split(r"/|\bOR\b", value))
    return NotIn(attribute, values) if op == "NOT" else In(attribute, values)


#: The attribute that tells knives from the rest of the catalogue: "All knives" leaves sharpeners and lights out.
KNIFE = "is_knife"

#: Cells that stand for a hand-kept list, by how they begin.
CURATED_CELLS = ("Curated", "Existing category", "Gut hooks")


def parse(cell: str, slug: str = "") -> Rule:
    """A rule from one of the enumerated shapes of a cell; anything else is an error."""
    cell = cell.strip()
    if re.match(r"All knives\b", cell):
        return In(KNIFE, (True,))
    if cell.startswith(CURATED_CELLS):
        return Curated(slug)
    parts = tuple(_term(t) for t in re.split(r"\bAND\b", cell))
    return parts[0] if len(parts) == 1 else All(parts)


def membership(products: DataFrame, rules: dict[str, Rule], key: str, curated: DataFrame | None = None, slug: str = "slug") -> DataFrame:
    """JN6: (slug, key) of every product in every collection, in one scan whatever the number of rules."""
    found = F.array_compact(F.array(*[F.when(rule.condition(), F.lit(name)) for name, rule in rules.items() if not isinstance(rule, Curated)]))
    out = products.select(F.explode(found).alias(slug), F.col(key))
    return out if curated is None else out.unionByName(curated.select(slug, key).distinct())


#: What a state's pages must never show.
AUTOMATIC = In("opening", ("automatic", "OTF"))
BANS: dict[str, Rule] = {
    "CA": AUTOMATIC,
    "NY": AUTOMATIC,
    "IL": AUTOMATIC,
    "MI": Any((In("edge_count", ("double",)), In("blade_shape", ("dagger", "stiletto", "dirk")))),
}


def violations(shown: DataFrame, bans: dict[str, Rule] = BANS, state: str = "state") -> DataFrame:
    """JN9: rows (a state, and the attributes of a product that its pages show) that the state's ban holds for; none may be left.

    One pass, whatever the number of states. An attribute that isn't known breaks no ban: the feed's validation reports it."""
    hit = F.lit(False)
    for name, rule in bans.items():
        hit = F.when(F.col(state) == name, rule.column()).otherwise(hit)
    return shown.where(hit)
