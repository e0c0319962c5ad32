"""Near-duplicate embeddings by Euclidean p-stable hashing.

Vectors are normalised in double precision. Each of ``tables`` hash tables has ``projections`` Gaussian projections,
shifted at random and cut into cells of ``WIDTH``; vectors in the same cells share a bucket. For unit vectors the
distance follows from the cosine, and with it the chance of sharing a bucket. The number of projections grows
with the logarithm of the number of vectors, so that a vector shares a bucket with about ``MATES`` unrelated ones at most, however
many there are: to compare with those, a product of matrices, costs less than to send and sort the rows of more tables. The
number of tables then follows from the recall wanted at the threshold itself; cells of ``WIDTH`` are about those that take the
fewest. Where that would be over ``MOST_TABLES``, tables get fewer projections
until it isn't: buckets are fuller, and the recall is kept.

1. Equal vectors are one node, keyed by 128 bits of hash; a map task emits it once, so copies never meet in pairs. The 64
   bits by which nodes meet only bring candidates together.
2. Bucket rows carry the vector in 8 bits. In a bucket's run, cosines within the error bound of the threshold
   link candidates. The nodes of a run of over ``RUN`` form a group (:mod:`blocks`), compared by the same bound in blocks.
3. Components of candidates get their full vectors, once. As every node's links are counted, all pairs of a component are
   checked by exact cosine: it is cut into blocks of ``LEAST_BLOCK`` to ``BLOCK`` nodes and each pair of blocks is a task,
   which emits counts and a spanning forest.

Vectors that are null, zero, or hold a null or a non-finite component link with nothing; so do vectors of different
lengths. Repeated rows count as copies; an id repeated with other vectors stands for each of them, which aren't linked by
sharing it. Rows with a null id link like others but give a class no id: where no row of a class has one, its component
is null. A cosine equal to the threshold links. Vectors of any length are taken whole. Labels and other columns don't
matter, whatever their names. An empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import blocks, filters, ragged
from larkspur.llm.components import components, skew_join
from larkspur.llm.workspace import Stash

WIDTH, MATES, RUN, LEAST_BLOCK, BLOCK, CROWD, MOST_TABLES = 2.0, 256, 4096, 256, 2000, 1000, 1000
#: Cosines of a run that are held at a time.
HELD = 200_000


def _same_cell(distance: float) -> float:
    """Chance that a projection puts two vectors at this distance into the same cell (Datar et al. 2004)."""
    t = WIDTH / max(distance, 1e-9)
    return 1 - math.erfc(t / math.sqrt(2)) - 2 / (math.sqrt(2 * math.pi) * t) * (1 - math.exp(-t * t / 2))


def plan(n: int, threshold: float, recall: float) -> tuple[int, int]:
    """Projections a table and number of tables for n vectors."""
    projections = max(4, math.ceil(math.log(max(n, MATES) / MATES) / -math.log(_same_cell(math.sqrt(2)))))
    same = _same_cell(math.sqrt(2 - 2 * threshold))
    needed = lambda k: math.ceil(math.log(1 - recall) / math.log1p(-(same**k)))
    while projections > 1 and needed(projections) > MOST_TABLES:
        projections -= 1
    return projections, needed(projections)


def unit_vectors(column: pa.Array) -> tuple[np.ndarray, list[int], list[np.ndarray]]:
    """Which rows can link, their lengths and their unit vectors in double precision."""
    rows, vectors = [], []
    values = pc.fill_null(pc.cast(column.flatten(), pa.float64()), math.nan).to_numpy(zero_copy_only=False)
    at = np.append(0, np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)))
    for i in range(len(column)):
        v = values[at[i] : at[i + 1]]
        if len(v) and np.isfinite(v).all() and (top := np.abs(v).max()) > 0:
            v = v / top  # against overflow
            rows.append(i)
            vectors.append(v / math.sqrt(float(v @ v)))
    return np.array(rows, dtype=np.int64), [len(v) for v in vectors], vectors


def _node(raw: np.ndarray) -> tuple[int, int]:
    """A 128-bit fingerprint of a unit vector, as two signed numbers."""
    h = xxhash.xxh3_128_intdigest(raw.tobytes())
    return tuple(int.from_bytes(x.to_bytes(8, "little"), "little", signed=True) for x in (h >> 64, h & (1 << 64) - 1))


def _nodes(vectors: DataFrame) -> DataFrame:
    """(vec_id, node, more) of every row; both are null where the vector can't link."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, _, found = unit_vectors(batch.column("embedding"))
            own: list[tuple] = [(None, None)] * batch.num_rows
            for i, v in zip(rows.tolist(), found, strict=True):
                own[i] = _node(v)
            yield pa.RecordBatch.from_arrays([batch.column("vec_id"), *[pa.array(x, pa.int64()) for x in zip(*own, strict=True)]], names=["vec_id", "node", "more"])

    return vectors.mapInArrow(run, "vec_id long, node long, more long")


def packed(x: np.ndarray) -> np.ndarray:
    """Unit vectors in 8 bits a component, after their scale and the length of the error (rounded up)."""
    scale = (np.abs(x).max(axis=1, keepdims=True) / 127).astype(np.float32)
    small = np.rint(x / scale).astype(np.int8)
    error = np.linalg.norm(x - small * scale.astype(np.float64), axis=1).astype(np.float32)[:, None] * np.float32(1.0001)
    return np.concatenate([scale.view(np.uint8), error.view(np.uint8), small.view(np.uint8)], axis=1)


def unpacked(flat: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Vectors and the lengths of their errors, from rows as :func:`packed` makes them."""
    scale, error = (flat[:, a : a + 4].copy().view(np.float32) for a in (0, 4))
    return flat[:, 8:].view(np.int8) * scale, error[:, 0]


def _distinct(batch: pa.RecordBatch, seen: set[tuple[int, int]]) -> Iterator[tuple[list[tuple[int, int]], np.ndarray]]:
    """Nodes not seen before and their unit vectors, for each length of vector."""
    for a in range(0, batch.num_rows, 512):
        _, lengths, found = unit_vectors(batch.column("embedding").slice(a, 512))
        for size in sorted(set(lengths)):
            own = [v for v in found if len(v) == size]
            ids = [_node(v) for v in own]
            new = [i for i, x in enumerate(ids) if x not in seen and not seen.add(x)]
            if new:
                yield [ids[i] for i in new], np.array([own[i] for i in new])


def _binary(rows: np.ndarray) -> pa.Array:
    return pa.FixedSizeBinaryArray.from_buffers(pa.binary(rows.shape[1]), len(rows), [None, pa.py_buffer(rows.tobytes())]).cast(pa.binary())


def _buckets(vectors: DataFrame, projections: int, tables: int, seed: int) -> DataFrame:
    """(bucket, node, small) for every table; ``small`` is the vector as :func:`packed`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        planes: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for batch in batches:
            for ids, x in _distinct(batch, seen):
                size = x.shape[1]
                if size not in planes:
                    rng = np.random.default_rng([seed, size])
                    planes[size] = rng.standard_normal((size, tables * projections)), rng.uniform(0, WIDTH, tables * projections), rng.integers(1, 2**63, tables * projections, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
                plane, shift, odd = planes[size]
                cell = np.floor((x @ plane + shift) / WIDTH).astype(np.int64).view(np.uint64) * odd
                bucket = cell.reshape(len(ids), tables, projections).sum(axis=2, dtype=np.uint64) + (np.arange(tables, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(size))
                bucket = (bucket ^ bucket >> np.uint64(29)) * np.uint64(0xBF58476D1CE4E5B9)
                small, node = packed(x), np.array([i for i, _ in ids], dtype=np.int64)
                for t in range(0, tables, 64):
                    k = min(64, tables - t)
                    yield pa.RecordBatch.from_arrays([pa.array(bucket[:, t : t + k].ravel().view(np.int64)), pa.array(np.repeat(node, k)), _binary(np.repeat(small, k, axis=0))], names=["bucket", "node", "small"])

    return vectors.mapInArrow(run, "bucket long, node long, small binary")


def _candidates(buckets: DataFrame, threshold: float) -> DataFrame:
    """Links (a, b, crowd) of nodes; or, with a true ``crowd``, the nodes a of a bucket b whose run is long."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest, long_run = None, None  # rows of the run that may go on; the bucket of a run that is long already
        for batch in batches:
            table = pa.Table.from_batches([batch] if rest is None else [rest, batch]).combine_chunks()
            bucket = table.column(0).to_numpy()
            last = int(np.searchsorted(bucket, bucket[-1], side="left"))
            yield from _short_runs(table.slice(0, last), long_run, threshold)
            rest = table.slice(last).combine_chunks().to_batches()[0]
            if len(bucket) - last > RUN:  # let go of what there is
                long_run = int(bucket[-1])
                yield _crowd(rest.column(1).to_numpy(), rest.column(0).to_numpy())
                rest = None
        if rest is not None:
            yield from _short_runs(pa.Table.from_batches([rest]), long_run, threshold)

    return buckets.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, crowd boolean")


def _crowd(node: np.ndarray, bucket: np.ndarray) -> pa.RecordBatch:
    node, bucket = np.unique(np.stack([node, bucket]), axis=1)
    return pa.RecordBatch.from_arrays([pa.array(node), pa.array(bucket), pa.array(np.ones(len(node), dtype=bool))], names=["a", "b", "crowd"])


def _short_runs(rows: pa.Table, long_run: int | None, threshold: float) -> Iterator[pa.RecordBatch]:
    """All runs of a length at once: their cosines as one stack of products."""
    if not rows.num_rows:
        return
    rows = rows.combine_chunks()
    bucket, node, small = (rows.column(k).chunk(0) for k in range(3))
    bucket, node, length = bucket.to_numpy(), node.to_numpy(), pc.binary_length(small).to_numpy()
    found: list[tuple[int, int]] = []
    for width in np.unique(length).tolist():  # vectors of other lengths meet in a bucket by chance only
        own = np.flatnonzero(length == width)
        own = own[np.lexsort((node[own], bucket[own]))]
        own = own[np.append(True, (bucket[own][1:] != bucket[own][:-1]) | (node[own][1:] != node[own][:-1]))]
        flat = np.frombuffer(b"".join(small.take(pa.array(own)).to_pylist()), dtype=np.uint8).reshape(len(own), width)
        b, n = bucket[own], node[own]
        at = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        size = np.diff(np.append(at, len(b)))
        crowded = (size > RUN) | (b[at] == long_run if long_run is not None else False)
        if crowded.any():
            which = ragged.take(at[crowded], size[crowded])
            yield _crowd(n[which], b[which])
        for g in np.unique(size[~crowded & (size > 1)]).tolist():
            starts = at[~crowded & (size == g)]
            step = max(1, HELD // (g * max(g, width)))
            for k in range(0, len(starts), step):
                place = starts[k : k + step, None] + np.arange(g)
                x, error = unpacked(flat[place.ravel()])
                near = _may_link(x.reshape(len(place), g, -1), error.reshape(len(place), g, 1), threshold)
                for r in np.flatnonzero(near.any(axis=(1, 2))).tolist():
                    some = np.flatnonzero(near[r].any(axis=1))
                    ids = n[place[r, some]].tolist()
                    found += [(ids[p], ids[q]) for p, q in blocks.forest(lambda v, others, m=near[r][np.ix_(some, some)]: others[m[v, others]], len(ids))]
    if found:
        a, b = (pa.array(x, pa.int64()) for x in zip(*found, strict=True))
        yield pa.RecordBatch.from_arrays([a, b, pa.array(np.zeros(len(a), dtype=bool))], names=["a", "b", "crowd"])


def _may_link(x: np.ndarray, error: np.ndarray, threshold: float) -> np.ndarray:
    """For each of a stack of runs, which of its vectors their 8 bits allow to link; few rows of cosines at a time."""
    runs, g, _ = x.shape
    near = np.empty((runs, g, g), dtype=bool)
    step = max(1, HELD // (runs * g))
    for a in range(0, g, step):
        rows = slice(a, a + step)
        slack = error[:, rows] + error.transpose(0, 2, 1)
        near[:, rows] = x[:, rows] @ x.transpose(0, 2, 1) >= threshold - slack - slack * slack - 1e-5
    near |= near.transpose(0, 2, 1)  # rounding differs
    near[:, np.arange(g), np.arange(g)] = False
    return near


def may_link(threshold: float) -> blocks.Near:
    """Which vectors their 8 bits allow to link."""

    def near(payloads: list[bytes]):
        width = np.array([len(p) for p in payloads])
        pad = int(width.max())
        flat = np.frombuffer(b"".join(p.ljust(pad, b"\0") for p in payloads), dtype=np.uint8).reshape(len(payloads), pad)
        x, error = unpacked(flat)

        def compare(v: int, others: np.ndarray) -> np.ndarray:
            others = others[width[others] == width[v]]
            slack = error[others] + error[v]
            return others[x[others] @ x[v] >= threshold - slack - slack * slack - 1e-5]

        return compare

    return near


def _loaded(vectors: DataFrame, wanted: filters.Sieve, whole: bool) -> DataFrame:
    """(node, more, payload) of wanted nodes, each once in a task: the unit vector, or its 8 bits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[tuple[int, int]] = set()
        for batch in batches:
            for ids, x in _distinct(batch, seen):
                keep = np.flatnonzero(wanted.known(np.array([i for i, _ in ids], dtype=np.int64)))
                if len(keep):
                    node, more = (pa.array([ids[k][c] for k in keep], pa.int64()) for c in (0, 1))
                    yield pa.RecordBatch.from_arrays([node, more, _binary(x[keep].view(np.uint8) if whole else packed(x[keep]))], names=["node", "more", "payload"])

    return vectors.mapInArrow(run, "node long, more long, payload binary")


def _crowds(vectors: DataFrame, met: DataFrame, threshold: float) -> DataFrame:
    """Candidate links (a, b) within the long runs."""
    stash = Stash(vectors.sparkSession)
    members, path = stash.save(met.where("crowd").select(F.col("b").alias("g"), F.col("a").alias("node"), F.lit(1).cast("long").alias("size")).distinct(), "crowds")
    if members.isEmpty():
        stash.drop(path)
        return vectors.sparkSession.createDataFrame([], "a long, b long")
    known = _loaded(vectors, filters.sieve(members.select("node").distinct(), "node"), whole=False)
    known, packed_path = stash.save(known.groupBy("node", "more").agg(F.first("payload").alias("payload")).select("node", "payload"), "packed")
    found = blocks.link_groups(members, lambda rows: skew_join(rows, known, ["node"]), may_link(threshold), CROWD)
    stash.drop(path)
    stash.drop(packed_path)
    return found


def _check(tasks: DataFrame, threshold: float) -> DataFrame:
    """From rows (comp, i, j, block, node, copies, payload) sorted by task: (a, b) links, and (a, c) numbers of links."""

    def close(across: bool, rows: list[tuple]) -> Iterator[tuple[int, int | None, int]]:
        by_size: dict[int, dict[int, tuple]] = {}
        for r in rows:
            by_size.setdefault(len(r[3]), {})[r[1]] = r
        for own in by_size.values():
            own = [own[k] for k in sorted(own)]
            ids, copies = [r[1] for r in own], np.array([r[2] for r in own], dtype=np.int64)
            x = np.frombuffer(b"".join(r[3] for r in own), dtype=np.float64).reshape(len(own), -1)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if across:
                block = np.array([r[0] for r in own])
                linked &= block[:, None] != block[None, :]
            yield from ((ids[k], None, int(c)) for k, c in enumerate(linked @ copies) if c)
            yield from ((ids[p], ids[q], 0) for p, q in blocks.forest(lambda v, others, m=linked: others[m[v, others]], len(ids)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, rows = None, []
        for batch in batches:
            found: list[tuple] = []
            for a in range(0, batch.num_rows, 512):
                for comp, i, j, *r in zip(*[c.to_pylist() for c in batch.slice(a, 512).columns], strict=True):
                    if (comp, i, j) != now:
                        if rows:
                            found += close(now[1] != now[2], rows)
                        now, rows = (comp, i, j), []
                    rows.append(r)
            if found:
                yield _counted(found)
        if rows and (found := list(close(now[1] != now[2], rows))):
            yield _counted(found)

    return tasks.repartition("comp", "i", "j").sortWithinPartitions("comp", "i", "j").mapInArrow(run, "a long, b long, c long")


def _counted(found: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in zip(*found, strict=True)], names=["a", "b", "c"])


def near_duplicates(vectors: DataFrame, threshold: float = 0.95, recall: float = 0.999, seed: int = 7, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """For each row: vec_id, n_links, component_id and kept (the row has its class's id)."""
    stash = Stash(vectors.sparkSession)
    use = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).alias("embedding"))
    nodes, _ = stash.save(_nodes(use), "nodes")
    met, met_path = stash.save(_candidates(_buckets(use, *plan(nodes.count(), threshold, recall), seed), threshold), "met")
    found = components(met.where("not crowd").select("a", "b").unionByName(_crowds(use, met, threshold)))
    stash.drop(met_path)
    members = found.select("node", F.col("root").alias("comp")).unionByName(found.select(F.col("root").alias("node"), F.col("root").alias("comp")).distinct())
    # Each vector has a number of its own.
    sets = nodes.where(F.col("node").isNotNull()).groupBy("node", "more").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("copies"))
    sets, sets_path = stash.save(sets.join(members, "node", "left").where((F.col("copies") > 1) | F.col("comp").isNotNull()).withColumn("number", F.monotonically_increasing_id()), "classes")
    involved = sets.where(F.col("comp").isNotNull())
    each = F.least(F.lit(BLOCK), F.greatest(F.lit(LEAST_BLOCK), F.col("n") / 8))
    sizes = involved.groupBy("comp").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1).select("comp", F.ceil(F.col("n") / each).cast("int").alias("blocks"))
    placed = skew_join(involved, sizes, ["comp"]).withColumn("block", F.pmod(F.xxhash64("number"), F.col("blocks")).cast("int"))
    placed, path = stash.save(placed.select("node", "more", "number", "copies", "comp", "blocks", "block"), "placed")
    whole = _loaded(use, filters.sieve(placed, "node"), whole=True).join(placed, ["node", "more"])
    tasks = whole.withColumn("_o", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = tasks.select("comp", F.least("block", "_o").alias("i"), F.greatest("block", "_o").alias("j"), "block", "number", "copies", "payload")
    checked, checked_path = stash.save(_check(tasks, threshold), "checked")
    stash.drop(path)
    roots = components(checked.where(F.col("b").isNotNull()).select("a", "b")).withColumnRenamed("node", "number")
    counts = checked.where(F.col("b").isNull()).groupBy(F.col("a").alias("number")).agg(F.sum("c").alias("c"))
    named = sets.join(counts, "number", "left").join(roots, "number", "left").where((F.col("copies") > 1) | F.col("c").isNotNull())
    named, _ = stash.save(named.select("node", "more", "rep", F.coalesce("root", "number").alias("class"), (F.coalesce("c", F.lit(0)) + F.col("copies") - 1).alias("links")), "named")
    for path in (sets_path, checked_path):
        stash.drop(path)
    named = skew_join(named, named.groupBy("class").agg(F.min("rep").alias("component")), ["class"]).select("node", "more", "links", "component")
    component = F.coalesce("component", "vec_id")
    return skew_join(nodes, named, ["node", "more"], "left").select("vec_id", F.coalesce("links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
