"""Writers of pages, documents, key/value lists and sitemaps."""

from __future__ import annotations

import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspur.functions.text import escape
from larkspur.operators.ranking import gapless
from larkspur.sources.files import Files, drop, folder_of, put, take
from larkspur.sources.scratch import stored


def write_pages(pages: DataFrame, path: str, key: str = "slug", body: str = "html") -> None:
    """SK1: one folder of text for each key, old ones replaced."""
    _spread(pages.select(key, body), key).write.mode("overwrite").partitionBy(key).option("lineSep", "\n").text(path)


def _spread(pages: DataFrame, key: str) -> DataFrame:
    """Pages dealt out over all tasks. A page costs a task the making of a file, whatever its length; by their bytes, a hundred thousand would be one task's."""
    return pages.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)


_MANIFEST, _PAGE = "_manifest", "page.txt"


def publish_pages(pages: DataFrame, path: str, key: str = "slug", body: str = "html") -> DataFrame:
    """SK1 over again: only pages that are new or differ from what was published are written, pages that are gone are removed.

    A manifest of hashes is kept beside the pages, a version for each run, committed when all pages are written. Before a run touches pages,
    it lists them, and takes the list away when it is through: of pages that a failed run has listed it isn't known what is there, so the next
    run writes or removes them whatever the manifest says. Pages are written and removed by tasks, one file a page, replaced whole; the store is one that pyarrow
    opens. Returns what was done: ``key`` and ``change`` (new, changed, removed). A key is there once; pages without a key aren't published."""
    spark = pages.sparkSession
    files = Files(spark, path)
    done = [n for n in files.names(_MANIFEST) if "_SUCCESS" in files.names(f"{_MANIFEST}/{n}")]
    versions, lists = sorted(int(n.split("=")[1]) for n in done if n.startswith("v=")), [n for n in files.names(_MANIFEST) if n.startswith("touched-")]
    now = pages.where(F.col(key).isNotNull()).select(F.col(key).cast("string").alias(key), body, F.sha2(F.coalesce(body, F.lit("")).cast("binary"), 256).alias("sha256"))
    schema = f"`{key}` string, sha256 string"
    before = spark.read.schema(schema).parquet(f"{path}/{_MANIFEST}/v={versions[-1]}") if versions else spark.createDataFrame([], schema)
    before = before.withColumnRenamed("sha256", "_old")
    torn = [f"{path}/{_MANIFEST}/{n}" for n in lists if n in done]
    if torn:
        before = before.join(spark.read.schema(f"`{key}` string").parquet(*torn).distinct().withColumn("_torn", F.lit(True)), key, "full")
    else:
        before = before.withColumn("_torn", F.lit(None).cast("boolean"))
    met = now.select(key, "sha256").join(before, key, "full")
    change = F.when(F.col("sha256").isNull(), "removed").when(F.col("_old").isNull(), "new").when(F.col("_torn") | (F.col("_old") != F.col("sha256")), "changed")
    log = stored(met.select(key, change.alias("change")).where(F.col("change").isNotNull()), "published")
    log.select(key).write.parquet(f"{path}/{_MANIFEST}/touched-{uuid.uuid4().hex}")
    store = files.store()
    touched = _spread(now.join(log.where("change <> 'removed'").select(key), key, "left_semi").select(key, F.col(body).cast("binary").alias("_body")), key)
    touched.foreachPartition(lambda rows: put(store, ((folder_of(key, r[0]), bytes(r[1] or b"") + b"\n") for r in rows), _PAGE))
    now.select(key, "sha256").write.mode("overwrite").parquet(f"{path}/{_MANIFEST}/v={versions[-1] + 1 if versions else 0}")
    _spread(log.where("change = 'removed'").select(key), key).foreachPartition(lambda rows: drop(store, (folder_of(key, r[0]) for r in rows)))
    for n in files.names(_MANIFEST):
        if n.startswith("touched-") or n in [f"v={v}" for v in versions[:-1]]:
            files.delete(f"{_MANIFEST}/{n}")
    return log


def read_pages(spark: SparkSession, path: str, key: str = "slug", body: str = "html") -> DataFrame:
    """The pages of the last manifest, a row each: tasks open them by their keys. Spark's reader lists all folders first, and the driver's work on their names grows faster than they do."""
    files = Files(spark, path)
    version = max(int(n.split("=")[1]) for n in files.names(_MANIFEST) if n.startswith("v=") and "_SUCCESS" in files.names(f"{_MANIFEST}/{n}"))
    store, schema = files.store(), pa.schema([(key, pa.string()), (body, pa.string())])

    def read(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 100):
                keys = batch.column(0).slice(at, 100).to_pylist()
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), pa.array([take(store, folder_of(key, k)).removesuffix(b"\n").decode("utf-8", "replace") for k in keys], pa.string())], schema=schema)

    keys = spark.read.schema(f"`{key}` string").parquet(f"{path}/{_MANIFEST}/v={version}")
    return _spread(keys, key).mapInArrow(read, f"`{key}` string, `{body}` string")


def write_page(page: DataFrame, path: str, body: str = "html") -> None:
    """SK2: one page, one file."""
    page.select(body).coalesce(1).write.mode("overwrite").text(path)


def pretty_json(value: Column) -> Column:
    """SK3: indented JSON of a struct."""
    return F.to_json(value, {"pretty": "true"})


def capped_json(items: Column, most: int = 12) -> Column:
    """SK4: the list as it is put back into a key/value store."""
    return F.to_json(F.slice(items, 1, most))


def write_sitemap(urls: DataFrame, path: str) -> None:
    """SK5: ``urlset`` of ``url`` rows with ``loc``."""
    urls.select("loc").write.mode("overwrite").format("xml").options(rootTag='urlset xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"', rowTag="url").save(path)


#: The protocol's bound on the addresses of a file, and its name space.
MOST_ADDRESSES = 50_000
_SPACE = 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'


def write_sitemaps(urls: DataFrame, path: str, site: str, most: int = MOST_ADDRESSES) -> int:
    """SK5 for any number of addresses: files of ``most`` at most, in the order of addresses, and an index of them; returns how many.

    Addresses are numbered without being brought to one task, a file's are joined in one (``most`` of them). Each run writes files
    of new names; the index (``sitemap.xml``) is replaced last, so that it never names a file that isn't whole, and only then are older files
    removed. An address is listed once, null isn't listed."""
    spark, run = urls.sparkSession, uuid.uuid4().hex[:12]
    files = Files(spark, path)
    numbered = gapless(urls.where(F.col("loc").isNotNull()).select("loc").distinct(), ["loc"])
    entry = F.concat(F.lit("<url><loc>"), escape(F.col("loc")), F.lit("</loc></url>"))
    packed = numbered.select(F.expr(f"index div {most}").alias("file"), "index", entry.alias("entry")).groupBy("file").agg(F.array_sort(F.collect_list(F.struct("index", "entry"))).alias("entries"))
    body = F.concat(F.lit(f'<?xml version="1.0" encoding="UTF-8"?>\n<urlset {_SPACE}>\n'), F.array_join(F.transform("entries", lambda x: x["entry"]), "\n"), F.lit("\n</urlset>"))
    packed.select("file", body.alias("body")).write.partitionBy("file").text(f"{path}/_{run}")
    found = sorted(int(n.split("=")[1]) for n in files.names(f"_{run}") if n.startswith("file="))
    for n in found:
        (part,) = [x for x in files.names(f"_{run}/file={n}") if x.startswith("part-")]
        files.move(f"_{run}/file={n}/{part}", f"sitemap-{run}-{n}.xml")
    listed = "\n".join(f"<sitemap><loc>{site}/sitemap-{run}-{n}.xml</loc></sitemap>" for n in found)
    files.replace("sitemap.xml", f'<?xml version="1.0" encoding="UTF-8"?>\n<sitemapindex {_SPACE}>\n{listed}\n</sitemapindex>')
    for name in files.names():
        if name.startswith(("sitemap-", "_")) and not name.startswith(f"sitemap-{run}-"):
            files.delete(name)
    return len(found)


def read_sitemaps(spark: SparkSession, path: str) -> DataFrame:
    """``loc`` and ``file`` (its number) of all addresses that the index leads to."""
    index = spark.read.format("xml").option("rowTag", "sitemap").schema("loc string").load(f"{path}/sitemap.xml")
    names = [r["loc"].rsplit("/", 1)[1] for r in index.collect()]
    if not names:
        return spark.createDataFrame([], "loc string, file long")
    found = spark.read.format("xml").option("rowTag", "url").schema("loc string").load([f"{path}/{n}" for n in names])
    return found.withColumn("file", F.regexp_extract(F.input_file_name(), r"-(\d+)\.xml$", 1).cast("long"))
