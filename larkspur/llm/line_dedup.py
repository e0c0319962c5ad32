"""Line dedup with DataFrame operations only.

Lines are exploded with their positions and normalised to keys: ASCII white space stripped at both ends, A-Z
lower-cased. A key of at least ``min_chars`` code points in at least ``min_docs`` documents loses its lines
everywhere but in the document with the smallest id. Two independent 64-bit hashes stand for a key.

Shape of the plan: keys are counted with a map-side aggregate, so that a line in a third of all documents
costs a row for each map task; keys then meet their lines again in a join whose both sides are exchanged for
the join, which lets adaptive execution split a hot line's partition. Texts move once, by document.

Texts and lines of any length are split and compared whole. Ties don't occur: a key has one smallest id. Rows with equal ids are one document, though each keeps its own text. A null id names no document: such rows
count for no key and lose no line. A null or empty text is one empty line and stays null or empty. Columns
beyond id and text pass through, but for one with an output's name, which the output replaces.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The ASCII white space that a key loses at its ends.
ASCII_SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z only: other letters keep their case."""
    return F.when(F.length(c) == F.octet_length(c), F.lower(c)).otherwise(F.translate(c, UPPER, LOWER))


def line_key(line: Column) -> Column:
    return ascii_lower(F.btrim(line, F.lit(ASCII_SPACE)))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).alias("__line_d"), F.xxhash64(body).alias("__line_t"), F.posexplode(F.split(body, "\n")).alias("__line_p", "__line_line"))
    return rows.select("__line_d", "__line_t", "__line_p", line_key(F.col("__line_line")).alias("__line_k"))


def dedup_lines(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", min_chars: int = 10, min_docs: int = 2, n_lines: str = "n_lines", n_dropped: str = "n_dropped") -> DataFrame:
    """``docs`` with the kept text, and the columns n_lines (before) and n_dropped."""
    docs = docs.drop(n_lines, n_dropped)
    lines = _lines(docs, doc_id, text).where(F.length("__line_k") >= min_chars).select("__line_d", "__line_t", "__line_p", F.xxhash64("__line_k").alias("__line_a"), F.xxhash64(F.lit(min_chars), F.lit("line"), "__line_k").alias("__line_b"))
    if min_docs <= 2:  # two documents at least: the smallest and the largest id differ
        common = lines.groupBy("__line_a", "__line_b").agg(F.min("__line_d").alias("__line_first"), F.max("__line_d").alias("__line_last"))
        common = common.where(F.lit(min_docs <= 1) | (F.col("__line_first") != F.col("__line_last")))
    else:
        common = lines.groupBy("__line_a", "__line_b", "__line_d").agg(F.count(F.lit(1)).alias("__line_c")).groupBy("__line_a", "__line_b").agg(F.count(F.lit(1)).alias("__line_n"), F.min("__line_d").alias("__line_first")).where(F.col("__line_n") >= min_docs)
    # The third key is there so that neither side's partitioning fits already and both are exchanged.
    meet = F.xxhash64("__line_a", "__line_b")
    drops = (
        lines.withColumn("__line_m", meet)
        .join(common.select("__line_a", "__line_b", "__line_first", meet.alias("__line_m")), ["__line_m", "__line_a", "__line_b"])
        .where(F.col("__line_d") != F.col("__line_first"))
        .groupBy("__line_d", "__line_t")
        .agg(F.collect_set("__line_p").alias("__line_drop"))
    )
    body = F.coalesce(F.col(text), F.lit(""))
    keyed = docs.withColumn("__line_t", F.xxhash64(body))
    joined = keyed.join(drops, (F.col(doc_id) == F.col("__line_d")) & (keyed["__line_t"] == drops["__line_t"]), "left").drop(drops["__line_t"])
    cut = F.split(body, "\n")
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size(cut) - 1), F.col("__line_drop")), lambda i: F.get(cut, i))
    out = joined.withColumns(
        {
            n_lines: F.size(cut).cast("long"),
            n_dropped: F.coalesce(F.size("__line_drop"), F.lit(0)).cast("long"),
            "__line_kept": F.when(F.col("__line_drop").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n")),
        }
    )
    return out.select(*[F.col("__line_kept").alias(c) if c == text else F.col(c) for c in docs.columns], n_lines, n_dropped)


#: DuckDB SQL for the query op2.
SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(range(1, len(ls) + 1)) AS p, unnest(ls) AS line FROM d),
k AS (SELECT doc_id, p, line,
  translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, min(doc_id) AS first_doc FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2),
m AS (SELECT k.doc_id, k.p, k.line, c.key IS NOT NULL AND k.doc_id <> c.first_doc AS dropped FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (WHERE dropped) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
