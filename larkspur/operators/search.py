"""SK6 by an inverted index: the same hits as a scan of all texts for all words, and an order among them.

A word is found inside a text's terms (maximal runs without white space, lower case), so a query first meets the vocabulary, which has each
term once, and then reads only the parts of the postings that hold the terms found: postings are partitioned by a term's
hash. The word with the fewest postings is read first; of the other words' postings only those of the same texts go on.

Score: for each word and term that contains it, the term's occurrences in the text times ln(1 + texts / texts with the term). Ties go by key."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Parts of the postings; a common term's are written by several tasks.
BUCKETS = 64


def _bucket(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(BUCKETS)).cast("int")


def _schema(key: T.DataType) -> T.StructType:
    """Of the postings, which an index without texts doesn't tell."""
    return T.StructType().add("term", "string").add("key", key).add("tf", "long").add("bucket", "integer")


def build(rows: DataFrame, path: str, key: str, text: str) -> None:
    """Write the index of ``rows`` (a key once) to a folder: postings, vocabulary, and the number of texts. Null texts have no terms."""
    terms = rows.select(F.col(key).alias("key"), F.explode(F.split(F.lower(F.btrim(text)), r"\s+")).alias("term")).where("term <> ''")
    postings = terms.groupBy("term", "key").agg(F.count(F.lit(1)).alias("tf")).withColumn("bucket", _bucket(F.col("term")))
    postings.repartition("bucket", F.pmod(F.xxhash64("key"), F.lit(8))).sortWithinPartitions("bucket", "term", "key").write.mode("overwrite").partitionBy("bucket").parquet(f"{path}/postings")
    rows.sparkSession.read.schema(_schema(rows.schema[key].dataType)).parquet(f"{path}/postings").groupBy("term").agg(F.count(F.lit(1)).alias("df")).write.mode("overwrite").parquet(f"{path}/vocabulary")
    rows.agg(F.count(F.lit(1)).alias("n"), F.first(F.lit(None).cast(rows.schema[key].dataType)).alias("key")).write.mode("overwrite").parquet(f"{path}/size")


def hits(spark: SparkSession, path: str, query: str) -> DataFrame:
    """``key`` and ``score`` of every text that holds all words of the query; a query without words finds nothing."""
    words = sorted(set(query.lower().split()))
    size = spark.read.parquet(f"{path}/size")
    postings, vocabulary, n = spark.read.schema(_schema(size.schema["key"].dataType)).parquet(f"{path}/postings"), spark.read.parquet(f"{path}/vocabulary"), size.first()["n"]
    found = {w: vocabulary.where(F.contains(F.col("term"), F.lit(w))) for w in words}
    sizes = {w: found[w].agg(F.coalesce(F.sum("df"), F.lit(0))).first()[0] for w in words}
    if not words or not all(sizes.values()):
        return postings.select("key", F.lit(0.0).alias("score")).limit(0)
    scored = []
    for word in sorted(words, key=lambda w: (sizes[w], w)):
        terms = found[word].select("term", F.log1p(n / F.col("df")).alias("idf"), _bucket(F.col("term")).alias("bucket"))
        own = postings.join(terms, ["bucket", "term"])
        own = own if not scored else own.join(scored[-1].select("key"), "key", "left_semi")
        scored.append(own.groupBy("key").agg(F.sum(F.col("tf") * F.col("idf")).alias("score")))
    kept = scored[-1].select("key")
    parts = [s if s is scored[-1] else s.join(kept, "key", "left_semi") for s in scored]
    return reduce(DataFrame.unionByName, parts).groupBy("key").agg(F.sum("score").alias("score"))


def top(spark: SparkSession, path: str, query: str, k: int) -> DataFrame:
    """The first ``k`` hits, with their rank; tasks keep k each."""
    best = hits(spark, path, query).withColumn("score", F.round("score", 6)).orderBy(F.desc("score"), "key").limit(k)
    return best.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("score"), "key")).cast("long"))
