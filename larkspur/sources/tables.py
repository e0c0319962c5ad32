"""Readers and schemas of the catalogue's tables.

Schemas are explicit; nothing is inferred. On read the word ``none`` and empty cells become null, YES/NO become booleans.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

PAIR = "struct<cls:string,text:string>"
SCHEMAS = {
    "states": "ord int, slug string, name string, abbr string, h1 string, hero string, tile struct<title:string,sub:string,slug:string>, chip string, "
    "cats array<struct<name:string,slug:string,img:string>>, legal array<struct<label:string,cls:string,pill:string,text:string>>, notice string, sources array<struct<title:string,url:string>>",
    "siblings": "ord int, name string, slug string",
    "hub": f"slug string, tagline string, blade string, auto {PAIR}, concealed {PAIR}, preemption {PAIR}",
    "brands": "ord int, name string, slug string",
    "products": "brand string, name string, slug string, blade decimal(5,2), steel string, rrp decimal(10,2), price decimal(10,2)",
    "product_attrs": "sku string, opening string, blade_type string, blade_length decimal(5,2), edge_count string, blade_shape string, steel string, lock string, origin string, handle string, brand string, price decimal(10,2), category string, is_knife boolean",
    "collections_state": "slug string, title string, group string, filter_rule string, attributes_needed string, build_priority int, notes string",
    "collections_product": "slug string, title string, group string, url_pattern string, driven_by string, indexable string, priority int, notes string",
    "reviews": "sku string, reviewer string, rating int, verified boolean, review_date date, text string, images array<string>",
    "page_views": "visitor string, url string, name string, img string, price string, brand string, ts timestamp",
    "popup_actions": "visitor string, action string, ts timestamp",
    "search_perf": "url string, position double, impressions bigint, clicks bigint",
    "seasons": "state string, zone string, weapon string, open date, close date, agency string",
    "links": "src string, dst string, anchor string",
}


def driver_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def literal(spark: SparkSession, name: str, rows: Sequence[tuple]) -> DataFrame:
    """A small table given in code (SC1)."""
    return spark.createDataFrame(rows, SCHEMAS[name])


def none_as_null(df: DataFrame) -> DataFrame:
    """Empty strings and the word ``none`` mean that a value is absent."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType)]
    return df.withColumns({c: F.when(F.trim(c).isin("", "none"), None).otherwise(F.col(c)) for c in strings})


def read_csv(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A CSV with header, quoted commas and UTF-8, under its schema; a malformed row fails the read."""
    return spark.read.schema(SCHEMAS[name]).options(header=True, mode="FAILFAST", encoding="UTF-8", enforceSchema=False).csv(path)


def state_collections(spark: SparkSession, path: str) -> DataFrame:
    """SC2"""
    return none_as_null(read_csv(spark, path, "collections_state"))


def product_collections(spark: SparkSession, path: str) -> DataFrame:
    """SC3: ``indexable`` as a boolean; anything but YES and NO is an error."""
    flag = F.when(F.col("indexable") == "YES", True).when(F.col("indexable") == "NO", False).otherwise(F.raise_error(F.concat(F.lit("indexable: "), F.coalesce("indexable", F.lit("null")))))
    return none_as_null(read_csv(spark, path, "collections_product").withColumn("indexable", flag))


def search_performance(spark: SparkSession, path: str) -> DataFrame:
    """SC7"""
    return read_csv(spark, path, "search_perf")


#: The domains of the closed attributes (shapes are open-ended).
DOMAINS = {"opening": ("manual", "assisted", "automatic", "OTF"), "blade_type": ("folding", "fixed"), "edge_count": ("single", "double")}


def validate_feed(feed: DataFrame) -> DataFrame:
    """SC8: a row for each value of a feed outside its attribute's domain; empty when the feed is sound. One scan."""
    checks = [F.when(F.col(c).isNotNull() & ~F.col(c).isin(*values), F.struct(F.lit(c).alias("attribute"), F.col(c).alias("value"))) for c, values in DOMAINS.items()]
    checks.append(F.when(F.col("price") <= 0, F.struct(F.lit("price").alias("attribute"), F.col("price").cast("string").alias("value"))))
    return feed.select("sku", F.explode(F.filter(F.array(*checks), lambda x: x.isNotNull())).alias("bad")).select("sku", "bad.*")
