"""SimHash near-dedup by tiled exact comparison.

Fingerprints are made per document without a shuffle, and equal ones become one
node.  Nodes are dealt by population count into tiles, written to the shared
folder.  A task compares two tiles with numpy exclusive-or and bit counts.
Population counts skip what can't be within the radius, at two levels: whole
tile pairs by the counts of all 64 bits, and inside a pair the cells of nodes
that have equal counts in each of four 16-bit parts, whose differences add up to
a lower bound of the distance.  Links of a pair shrink to a spanning forest
before they leave the task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.components import components, forest
from somaflow.llm.shared import commit_file, filesystem, new_folder, written
from somaflow.llm.textbytes import chunks

SHINGLE = 4
RADIUS = 4
SEED = 42
#: Nodes of a tile at most, about; a tile is 8 bytes a node.
TILE = 1 << 17
#: A table of the keys of rows (two longs) up to this many is broadcast.
BROADCAST_KEYS = 200_000
#: Elements of a comparison matrix.
MATRIX = 1 << 21


def fingerprints_of(texts: list[bytes], size: int = SHINGLE) -> np.ndarray:
    """64-bit fingerprints of UTF-8 texts."""
    from xxhash import xxh64_intdigest

    hashes: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, t in enumerate(texts):
        words = t.lower().split()
        if not words:
            continue
        if len(words) <= size:
            hashes.append(xxh64_intdigest(b" ".join(words), SEED))
            counts[i] = 1
            continue
        line, ends, at = b" ".join(words), [], -1
        for w in words:
            at += len(w) + 1
            ends.append(at)
        hashes += [xxh64_intdigest(line[a:b], SEED) for a, b in zip([0, *(e + 1 for e in ends[:-size])], ends[size - 1 :])]
        counts[i] = len(words) - size + 1
    out = np.zeros(len(texts), np.uint64)
    some = np.flatnonzero(counts)
    if len(some):
        bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.cumsum(counts[some]) - counts[some]
        ones = np.add.reduceat(bits, first, axis=0, dtype=np.int64)
        major = np.packbits(2 * ones > counts[some][:, None], axis=1, bitorder="little")
        out[some] = np.ascontiguousarray(major).view("<u8").reshape(-1)
    return out


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, fp): one row per document; fp holds the 64 bits as a signed long."""

    def task(batches):
        for batch in batches:
            for a, b, texts in chunks(batch, 1):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(fingerprints_of(texts).view(np.int64))], ["doc_id", "text_hash", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("text_hash"))
    return rows.mapInArrow(task, "doc_id long, text_hash long, fp long")


def _cells(fps: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted by cell: (nodes' order, first node of each cell and the end, counts of each cell's parts)."""
    parts = np.bitwise_count(np.ascontiguousarray(fps).view(np.uint16).reshape(-1, 4)).astype(np.int64)
    key = ((parts[:, 0] * 17 + parts[:, 1]) * 17 + parts[:, 2]) * 17 + parts[:, 3]
    order = np.argsort(key, kind="stable")
    key = key[order]
    first = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1]))) if len(key) else np.zeros(0, np.int64)
    return order, np.append(first, len(key)), parts[order[first]].astype(np.int16)


def pair_links(a: np.ndarray, b: np.ndarray | None, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """(node, root): a spanning forest of the links within ``radius`` between two tiles, or within one."""
    nodes = a if b is None else np.concatenate((a, b))
    shift = 0 if b is None else len(a)
    order_a, first_a, cells_a = _cells(a)
    order_b, first_b, cells_b = (order_a, first_a, cells_a) if b is None else _cells(b)
    left, right = a[order_a], (a if b is None else b)[order_b]
    root, us, vs, held = np.arange(len(nodes)), [], [], 0

    def settle():
        nonlocal root, us, vs, held
        if us:
            kept = np.flatnonzero(root != np.arange(len(root)))
            root = forest(np.concatenate([kept, *us]), np.concatenate([root[kept], *vs]), len(nodes))
            us, vs, held = [], [], 0

    for c in range(len(cells_a)):
        near = np.flatnonzero(np.abs(cells_b - cells_a[c]).sum(axis=1) <= radius)
        if b is None:
            near = near[near >= c]
        if not len(near):
            continue
        sizes = first_b[near + 1] - first_b[near]
        at = np.repeat(first_b[near] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        other = right[at]
        rows = max(1, MATRIX // len(other))
        for r in range(first_a[c], first_a[c + 1], rows):
            stop = min(r + rows, first_a[c + 1])
            close = np.bitwise_count(left[r:stop, None] ^ other) <= radius
            x, y = np.nonzero(close)
            if b is None:
                later = at[y] > x + r
                x, y = x[later], y[later]
            if len(x):
                us.append(order_a[x + r])
                vs.append(order_b[at[y]] + shift)
                held += len(x)
                if held > MATRIX:
                    settle()
    settle()
    hung = np.flatnonzero(root != np.arange(len(root)))
    return nodes[hung], nodes[root[hung]]


def _tiles(nodes: DataFrame, folder: str) -> DataFrame:
    """Writes the nodes (fp) in tiles of near population counts; returns tile, file, least and most counts."""
    n = nodes.count()
    tiles = max(1, -(-n // TILE), min(16, n // 4096))
    parts = F.bit_count("fp")

    def task(batches):
        from pyspark import TaskContext

        held = [np.asarray(b.column(0)) for b in batches]
        if held:
            fps = np.concatenate(held).view(np.uint64)
            count = np.bitwise_count(fps)
            part = TaskContext.get().partitionId()
            system, draft, final = commit_file(folder, f"tile-{part:06d}", ".u64")
            with system.open_output_stream(draft) as sink:
                sink.write(fps.astype("<u8").tobytes())
            system.move(draft, final)
            yield pa.RecordBatch.from_pylist([{"part": part, "file": final, "least": int(count.min()), "most": int(count.max())}])

    dealt = nodes.select("fp").repartitionByRange(tiles, parts, "fp")
    return written(dealt.mapInArrow(task, "part long, file string, least long, most long"), "tiles")


def _manifest(uri: str, cache: dict = {}) -> list[dict]:  # noqa: B006
    """The tiles, as the written table has them, in order; kept by the worker."""
    import pyarrow.parquet as pq

    if uri not in cache:
        cache.clear()
        system, path = filesystem(uri)
        cache[uri] = sorted(pq.read_table(path, filesystem=system).to_pylist(), key=lambda t: t["part"])
    return cache[uri]


def links(nodes: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): links that connect what the links within ``radius`` connect, of distinct fingerprints."""
    spark = nodes.sparkSession
    folder = new_folder(spark, "simhash")
    tiles = _tiles(nodes, folder)
    count = tiles.count()
    manifest = tiles.inputFiles()[0].rsplit("/", 1)[0] if count else ""

    def load(file: str) -> np.ndarray:
        with filesystem(folder)[0].open_input_file(file) as source:
            return np.frombuffer(source.read(), "<u8")

    def task(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                # tile i meets itself and the half of all tiles that follow it, around the end
                i, step = divmod(k, count // 2 + 1)
                j = (i + step) % count
                if step and 2 * step == count and i > j:
                    continue
                all_tiles = _manifest(manifest)
                one, two = all_tiles[i], all_tiles[j]
                if max(one["least"], two["least"]) - min(one["most"], two["most"]) > radius:
                    continue
                x, y = pair_links(load(one["file"]), load(two["file"]) if step else None, radius)
                yield pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)), pa.array(y.view(np.int64))], ["a", "b"])

    pairs = count * (count // 2 + 1)
    todo = spark.range(0, pairs, 1, max(1, min(pairs, 4 * spark.sparkContext.defaultParallelism + pairs // 64)))
    return todo.mapInArrow(task, "a long, b long")


def near_groups(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, text_hash, fp, component_id): one row per document.

    Fingerprints within ``radius`` bits link; component_id is the smallest
    doc_id that a document reaches, itself included.  Defined results: a null
    or wordless text has fingerprint zero, linked like any other; rows without
    an id take part, and a component of such rows alone has component_id null;
    repeated rows are rows of one group; an empty table gives no rows.
    """
    rows = written(fingerprints(docs), "simhash-rows")
    nodes = written(rows.groupBy("fp").agg(F.min("doc_id").alias("smallest")), "simhash-nodes")
    roots = components(links(nodes, radius)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    member = roots.unionByName(roots.select(F.col("root").alias("node"), "root").distinct())
    known = written(member.join(nodes, F.col("node") == F.col("fp")).select("node", "root", "smallest"), "simhash-members")
    least = known.groupBy(F.col("root").alias("r")).agg(F.min("smallest").alias("component"))
    of_node = known.join(least, F.col("root") == F.col("r")).select("node", "component")
    of_fp = nodes.join(of_node, F.col("fp") == F.col("node"), "left").select(F.col("fp").alias("f"), F.coalesce("component", "smallest").alias("component_id"))
    return rows.join(of_fp, F.col("fp") == F.col("f")).select("doc_id", "text_hash", "fp", "component_id")


def deduplicated(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """``docs`` with one document of each group: the one of smallest id (no id first), then text hash.

    What goes is decided on ids and text hashes alone.  The keys of rows that go
    are broadcast up to BROADCAST_KEYS of them, and then no text moves; beyond
    that texts are shuffled once.  Of rows equal in id and text any one stays,
    and only such rows are compared again.  Columns may have any names.
    """
    groups = near_groups(docs, radius)
    # a component without ids is one group as far as component_id tells; its fingerprints keep such groups apart
    groups = groups.withColumn("alone", F.when(F.col("component_id").isNull(), F.col("fp")))
    keys = groups.groupBy("component_id", "alone", "doc_id", "text_hash").agg(F.count("*").alias("n"))
    keys = written(keys, "simhash-keys")
    first = keys.groupBy("component_id", "alone").agg(F.min(F.struct("doc_id", "text_hash")).alias("k"))
    first = first.select(F.col("k.doc_id").alias("_d"), F.col("k.text_hash").alias("_h"))
    key = lambda d, h: d.eqNullSafe(F.col("_d")) & (h == F.col("_h"))
    same = key(F.col("doc_id"), F.col("text_hash"))
    renamed = lambda df: df.select(F.col("doc_id").alias("_d"), F.col("text_hash").alias("_h"))
    twice = keys.where("n > 1").join(first, same, "left_semi")
    gone = written(renamed(keys.join(first, same, "left_anti").unionByName(twice)), "simhash-gone")
    twice = written(renamed(twice), "simhash-twice")
    small = lambda df: F.broadcast(df) if df.count() <= BROADCAST_KEYS else df
    named = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"))
    here = key(F.col("d"), F.col("h"))
    kept = named.join(small(gone), here, "left_anti")
    if not twice.isEmpty():
        kept = kept.unionByName(named.join(small(twice), here, "left_semi").dropDuplicates(["d", "h"]))
    return kept.select("row.*")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
