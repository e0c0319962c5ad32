"""JN6 with rules as data: a predicate index over any number of collection rules, read from a table.

A rule's cell is parsed by column expressions into conjuncts. One conjunct of each rule, the one that the fewest products
can meet by the counts of the products' own values, gives the rule's entries in the index; products meet entries by an equi-join, and
only rules met there are checked in full, on the row. So the plan has the same size for ten rules and for a million, and work follows
the pairs that can be members, not products times rules.

Entries: (attribute, value) for equalities; for bounds the number line is cut in blocks of 16 ** level hundredths, and a bound
has the few blocks that fill it exactly (15 a level at most), which a value meets in one block a level; (attribute, known) for
exclusions; one entry for rules without a condition. A rule that meets a null attribute doesn't hold, also under negation. Cells outside the
shapes of ``rules.parse`` fail the query; hand-kept collections have no entry, their members come from a list.

Values are compared as text, bounds as decimals with two places in -10^12 to 10^12. A slug must be unique; a null cell has no members.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.operators.rules import CURATED_CELLS, KNIFE
from larkspur.sources.scratch import stored

_TERM = r"^([a-z_]+)\s*(<=|<|=|\bNOT\b)\s*(\S.*)$"
_LEVELS, _BITS, _SHIFT = 12, 4, 10**14

#: Letters of an index, as JSON, up to which it is sent to all tasks; a larger one is dealt out with the products' entries.
SENT = 16 << 20


def parse_cells(rules: DataFrame, slug: str = "slug", cell: str = "filter_rule") -> DataFrame:
    """``slug`` and ``conjuncts`` (attribute, op, values, bound) of every rule that has a predicate."""
    text = F.trim(cell)
    by_hand = F.lit(False)
    for begin in CURATED_CELLS:
        by_hand = by_hand | text.startswith(begin)
    # Null for the others, so that none of them is parsed wherever the condition below is evaluated.
    parts = F.transform(F.split(F.when(by_hand, None).when(text.rlike(r"^All knives\b"), f"{KNIFE} = true").otherwise(text), r"\bAND\b"), lambda p: F.trim(p))

    def conjunct(part: Column) -> Column:
        value = lambda i: F.regexp_extract(part, _TERM, i)
        op = value(2)
        bound = F.when(op.isin("<", "<="), value(3).try_cast("decimal(14,2)"))
        exact = op.isin("=", "NOT") | (bound.isNotNull() & (bound == value(3).try_cast("decimal(30,12)")))
        checked = F.when(exact, op).otherwise(F.raise_error(F.concat(F.lit("not a rule: "), part)))
        values = F.when(op.isin("=", "NOT"), F.array_distinct(F.transform(F.split(value(3), r"/|\bOR\b"), lambda v: F.trim(v))))
        return F.struct(value(1).alias("attribute"), checked.alias("op"), values.alias("values"), bound.alias("bound"))

    return rules.where(text.isNotNull() & ~by_hand).select(F.col(slug).alias("slug"), F.transform(parts, conjunct).alias("conjuncts"))


def _offset(value: Column) -> Column:
    """A number as hundredths from the lower end of the line."""
    return (value.cast("decimal(20,2)") * 100).cast("long") + F.lit(_SHIFT)


def _blocks_below(end: Column) -> Column:
    """The blocks ("level:number") that fill the line from its beginning up to, without, ``end``."""

    def level(k: int) -> Column:
        first = F.shiftleft(F.shiftright(end, _BITS * (k + 1)), _BITS)  # the block at this level that begins where the one above does
        own = F.shiftright(end, _BITS * k)
        numbers = F.when(own > first, F.sequence(first, own - 1)).otherwise(F.array().cast("array<bigint>"))
        return F.transform(numbers, lambda i: F.concat(F.lit(f"{k}:"), i.cast("string")))

    return F.flatten(F.array(*[level(k) for k in range(_LEVELS)]))


def _keys(conjunct: Column) -> Column:
    """The entries (attribute, key) of a conjunct."""
    entry = lambda key: F.struct(conjunct["attribute"].alias("attribute"), key.alias("key"))
    end = _offset(conjunct["bound"]) + F.when(conjunct["op"] == "<=", 1).otherwise(0)
    return (
        F.when(conjunct["op"] == "=", F.transform(conjunct["values"], lambda v: entry(F.concat(F.lit("="), v))))
        .when(conjunct["op"] == "NOT", F.array(entry(F.lit("known"))))
        .otherwise(F.transform(_blocks_below(end), lambda b: entry(b)))
    )


def _entries(attributes: Column, numeric: list[str]) -> Column:
    """All entries that a product meets: its values, that they are known, and its numbers' blocks."""
    entry = lambda a, key: F.struct(a.alias("attribute"), key.alias("key"))
    known = F.flatten(F.transform(F.map_entries(attributes), lambda x: F.array(entry(x["key"], F.concat(F.lit("="), x["value"])), entry(x["key"], F.lit("known")))))
    blocks = [F.array(*[entry(F.lit(a), F.concat(F.lit(f"{k}:"), F.shiftright(_offset(attributes[a]), _BITS * k).cast("string"))) for k in range(_LEVELS)]) for a in numeric]
    return F.concat(known, *[F.when(attributes[a].isNotNull(), b).otherwise(F.array().cast("array<struct<attribute:string,key:string>>")) for a, b in zip(numeric, blocks, strict=True)])


def _holds(conjunct: Column, attributes: Column) -> Column:
    value = F.try_element_at(attributes, conjunct["attribute"])
    number = value.try_cast("decimal(14,2)")
    met = (
        F.when(conjunct["op"] == "=", F.array_contains(conjunct["values"], value))
        .when(conjunct["op"] == "NOT", ~F.array_contains(conjunct["values"], value))
        .when(conjunct["op"] == "<", number < conjunct["bound"])
        .otherwise(number <= conjunct["bound"])
    )
    return F.coalesce(met, F.lit(False))


def index(parsed: DataFrame, described: DataFrame) -> DataFrame:
    """The rules by entry (attribute, key): each by that conjunct which the fewest of the products ``described`` can meet.

    Products are counted by value, map-side combined; exclusions and bounds count as met by all that have the attribute."""
    counts = described.select(F.explode("attributes").alias("attribute", "value")).groupBy("attribute", "value").agg(F.count(F.lit(1)).alias("n"))
    conjuncts = parsed.select("slug", F.posexplode("conjuncts").alias("at", "c"))
    valued = conjuncts.select("slug", "at", F.col("c.attribute").alias("attribute"), F.explode_outer("c.values").alias("value"), F.col("c.op").alias("op"))
    exact = valued.where("op = '='").join(counts, ["attribute", "value"], "left").groupBy("slug", "at").agg(F.sum(F.coalesce("n", F.lit(0))).alias("n"))
    wide = valued.where("op <> '='").select("slug", "at", "attribute", "op").distinct().join(counts.groupBy("attribute").agg(F.sum("n").alias("n")), "attribute", "left")
    either = exact.select("slug", "at", "n", F.lit(0).alias("kind")).unionByName(wide.select("slug", "at", F.coalesce("n", F.lit(0)).alias("n"), F.when(F.col("op") == "NOT", 2).otherwise(1).alias("kind")))
    best = either.groupBy("slug").agg(F.min_by("at", F.struct("n", "kind", "at")).alias("at"))
    return parsed.join(best, "slug").select("slug", "conjuncts", F.explode(_keys(F.element_at("conjuncts", F.col("at") + 1))).alias("entry")).select("slug", "conjuncts", "entry.*")


def members(products: DataFrame, rules: DataFrame, key: str, attributes: list[str], curated: DataFrame | None = None, slug: str = "slug", cell: str = "filter_rule") -> DataFrame:
    """(slug, key) of every product in every collection of the table ``rules``."""
    numeric = [a for a in attributes if products.schema[a].dataType.typeName() in ("decimal", "integer", "long", "short", "byte", "double", "float")]
    shown = {a: F.col(a).cast("decimal(14,2)").cast("string") if products.schema[a].dataType.typeName() == "decimal" else F.col(a).cast("string") for a in attributes}
    described = products.select(F.col(key), F.map_filter(F.create_map(*[x for a in attributes for x in (F.lit(a), shown[a])]), lambda _, v: v.isNotNull()).alias("attributes"))
    found = stored(index(parse_cells(rules, slug, cell), described), "index")
    # Never the products' side: Spark takes its size for that of the table before the entries are exploded. A product has many pairs, so a small file is spread over all tasks.
    built = F.broadcast(found) if (found.agg(F.sum(F.length(F.to_json(F.struct("*"))))).first()[0] or 0) <= SENT else found.hint("merge")
    spread = described.repartition(int(products.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)
    met = spread.select(key, "attributes", F.explode(_entries(F.col("attributes"), numeric)).alias("e")).select(key, "attributes", "e.*").join(built, ["attribute", "key"])
    # After the join, not as its condition: there Spark may look for the map on the side of the rules.
    held = F.when(F.forall("conjuncts", lambda c: _holds(c, F.col("attributes"))), F.array("slug"))
    out = met.select(key, F.explode_outer(held).alias(slug)).where(F.col(slug).isNotNull()).select(slug, key)
    return out if curated is None else out.unionByName(curated.select(slug, key).distinct())
