"""MinHash near-dedup: one-permutation hashing, banded buckets, star-shaped candidates.

A document's set is hashed once: each of BINS ranges of the hash keeps its
smallest value, and an empty range takes that of the first non-empty one in an
order of its own that is the same for all documents (optimal densification).
ROWS ranges make a band, and sets that agree in a band share a bucket.

A bucket gives a star: its hub, the smallest member, is a candidate for each
other member.  Candidates are confirmed on full sets, texts of the members
meeting their hub's, compared by the bytes of their words.  Where a bucket then
still holds members that aren't linked to one hub, its own hub goes and the next
member takes over, for STARS rounds in all; so each round has as many pairs as
buckets have members.

What no star has settled is a small rest of buckets whose members neither link
nor fall apart, such as texts that share a passage and little else.  Their
members meet in tiles, by components of buckets: two of different components
whose sketches could be those of similar sets are confirmed in place, and only
links leave the task.  So no pair of a bucket is left out, however large it is.

Two sets with a Jaccard similarity s share no bucket with probability
(1 - s^ROWS)^BANDS: below 5e-7 for s = 0.8.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.shared import written
from somaflow.llm.components import components
from somaflow.llm.textbytes import _VALUE, NOT_SPACE, Vocabulary, Words, chunks, mix, powers

#: Similarity that links: HUNDREDTHS of the union's size.
HUNDREDTHS = 80
ROWS = 6
BANDS = 48
BINS = ROWS * BANDS
#: Rounds of stars before what is left meets in tiles.
STARS = 2
#: Members of a tile's side, about, and bytes of their texts.
TILE = 512
TILE_BYTES = 1 << 19
#: Of two sets with so many shingles at least, sketches that agree in fewer of their bins can't be similar:
#: at 0.8 the share is 0.8 with a deviation of 0.024, five of which lie between.  Smaller sets are always confirmed.
AGREE = 0.68
AGREE_FROM = 64
#: Members that meet their hub in one task, about.
LEAVES = 256
#: Texts are fetched by a broadcast of their keys (24 bytes each) up to so many.
BROADCAST_KEYS = 200_000
BATCH_BYTES = 1 << 18
#: Text whose sets are held at once; numpy takes about a hundred times as much.
SKETCH_BYTES = 1 << 18
_ODD = np.uint64(0x9E3779B97F4A7C15)
_TURN = np.uint64(0xC2B2AE3D27D4EB4F)


@cache
def _order() -> np.ndarray:
    """(bins, bins): the order in which each bin looks for a non-empty one, fixed values of a seeded generator."""
    return np.argsort(np.random.default_rng(13).random((BINS, BINS)), axis=1)


def densified(values: np.ndarray, filled: np.ndarray) -> np.ndarray:
    """``values`` (sets, bins) with every bin that isn't ``filled`` taking that of the first filled one in its order.

    Each set needs a filled bin.
    """
    out, order = values.copy(), _order()
    row, bin_ = np.nonzero(~filled)
    step = 0
    while len(row):
        look = order[bin_, step]
        found = filled[row, look]
        out[row[found], bin_[found]] = values[row[found], look[found]]
        row, bin_, step = row[~found], bin_[~found], step + 1
    return out


def sketches(set_of: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """(n, BINS): densified values of sets 0 to n - 1, none empty; hash i belongs to set ``set_of[i]``, both ascending."""
    cell = set_of * BINS + ((hashes >> np.uint64(32)) * np.uint64(BINS) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1]))) if len(cell) else np.zeros(0, np.int64)
    values, filled = np.zeros(n * BINS, np.uint64), np.zeros(n * BINS, bool)
    values[cell[first]], filled[cell[first]] = hashes[first], True
    return densified(values.reshape(n, BINS), filled.reshape(n, BINS))


def bands(sketch: np.ndarray) -> np.ndarray:
    """(n, BANDS): the bucket of each band."""
    out = np.broadcast_to(mix(np.arange(1, BANDS + 1, dtype=np.uint64) * _ODD), (len(sketch), BANDS)).copy()
    for r in range(ROWS):
        out = mix(out * _TURN + sketch.reshape(-1, BANDS, ROWS)[:, :, r])
    return out


def shingles(words: Words, ids: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, first word, second word): each text's distinct shingles of two words, as places of an occurrence.

    ``ids`` are the words' numbers, below ``size``; equal words have equal numbers.
    A text of one word has that word alone, its second word is -1.
    """
    text = words.text_of()
    n_words = np.diff(words.first)
    second = np.arange(1, len(text) + 1)
    pairs = np.flatnonzero(np.append(text[1:] == text[:-1], False)) if len(text) else np.zeros(0, np.int64)
    lone = words.first[:-1][n_words == 1]
    at = np.concatenate((pairs, lone))
    second = np.concatenate((second[pairs], np.full(len(lone), -1)))
    code = ids[at] * (size + 1) + np.where(second < 0, size, ids[second])
    order = np.lexsort((code, text[at]))
    at, second, code = at[order], second[order], code[order]
    new = np.concatenate(([True], (code[1:] != code[:-1]) | (text[at[1:]] != text[at[:-1]]))) if len(at) else np.zeros(0, bool)
    return text[at[new]], at[new], second[new]


def _word_hashes(words: Words) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit hashes of each word: by the powers of a base, and by those of its inverse with other values."""
    up, down = powers(len(words.data) + 1)
    sums = np.zeros(len(words.data) + 1, np.uint64)
    np.cumsum(_VALUE[words.data] * down[: len(words.data)], out=sums[1:])
    return words.hashes(), mix((sums[words.ends] - sums[words.starts]) * up[words.starts] + (words.ends - words.starts).astype(np.uint64) * _TURN)


def sets_of(texts: list[bytes]) -> list[tuple[int, bytes | None, bytes | None, list[int] | None]]:
    """(size of the set, its 128-bit digest, its sketch, its buckets) of each UTF-8 text.

    Shingles are told apart by 128 bits.  A sketch keeps a byte of each bin;
    sets too small to be near another one have no sketch.
    """
    words = Words(texts, NOT_SPACE)
    text, n_words = words.text_of(), np.diff(words.first)
    pairs = np.flatnonzero(text[1:] == text[:-1])
    lone = words.first[:-1][n_words == 1]
    of = np.concatenate((text[pairs], np.flatnonzero(n_words == 1)))
    low, high = (np.concatenate((mix(h[pairs] * _ODD + mix(h[pairs + 1] + _TURN)), mix(h[lone]))) for h in _word_hashes(words))
    # by text, then hash
    order = np.argsort(low)
    order = order[np.argsort(of[order].astype(np.uint16 if len(texts) <= 1 << 16 else np.int64), kind="stable")]
    of, low, high = of[order], low[order], high[order]
    new = np.concatenate(([True], (low[1:] != low[:-1]) | (high[1:] != high[:-1]) | (of[1:] != of[:-1]))) if len(of) else np.zeros(0, bool)
    of, low, high = of[new], low[new], high[new]
    sizes = np.bincount(of, minlength=len(texts))
    starts, both = np.concatenate(([0], np.cumsum(sizes))), np.stack((low, high), axis=1)
    large = np.flatnonzero(sizes >= least_size())
    number = np.full(len(texts), -1)
    number[large] = np.arange(len(large))
    mine = number[of] >= 0
    sketch = sketches(number[of[mine]], low[mine], len(large))
    buckets, short = bands(sketch).view(np.int64), sketch.astype(np.uint8)
    out = []
    for i, n in enumerate(sizes.tolist()):
        digest = blake2b(both[starts[i] : starts[i + 1]].tobytes(), digest_size=16).digest() if n else None
        k = number[i]
        out.append((n, digest, short[k].tobytes() if k >= 0 else None, buckets[k].tolist() if k >= 0 else None))
    return out


def least_size(hundredths: int = HUNDREDTHS) -> int:
    """The smaller of two different sets' sizes that can link: n of n + 1 is the most."""
    return next(n for n in range(1, 102) if 100 * n >= hundredths * (n + 1)) if hundredths < 100 else 1 << 62


def sketched(docs: DataFrame) -> DataFrame:
    """(doc_id, text_key, n, digest, sketch, buckets) of every document; text_key is the text's MD5."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, texts in chunks(batch, 2, SKETCH_BYTES):
                n, digests, sketch, buckets = zip(*sets_of(texts))
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(n, pa.int64()), pa.array(digests, pa.binary()), pa.array(sketch, pa.binary()), pa.array(buckets, pa.list_(pa.int64()))], ["doc_id", "text_key", "n", "digest", "sketch", "buckets"])

    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    return rows.mapInArrow(task, "doc_id long, text_key binary, n long, digest binary, sketch binary, buckets array<long>")


def similar_leaves(hub: bytes, n_hub: int, leaves: list[bytes], sizes: list[int], hundredths: int = HUNDREDTHS) -> np.ndarray:
    """Which of the leaves' sets link with the hub's; words are compared byte for byte."""
    words = Words([hub], NOT_SPACE)
    vocabulary = Vocabulary(words)
    ids, m = vocabulary.find(words), vocabulary.size + 1
    _, first, second = shingles(words, ids, vocabulary.size)
    code = lambda ids, first, second: ids[first] * m + np.where(second < 0, m - 1, ids[second])
    base = np.sort(code(ids, first, second))
    other = Words(leaves, NOT_SPACE)
    # words that the hub doesn't have are all alike here: their shingles can't be the hub's
    names = vocabulary.find(other)
    known = names >= 0
    text, first, second = shingles(other, np.where(known, names, m - 1), m)
    held = known[first] & ((second < 0) | known[second])
    text, first, second = text[held], first[held], second[held]
    met = code(names, first, second)
    at = np.minimum(np.searchsorted(base, met), max(0, len(base) - 1))
    common = np.bincount(text[base[at] == met] if len(base) else text[:0], minlength=len(leaves))
    return 100 * common >= hundredths * (n_hub + np.array(sizes) - common)


def confirmed(pairs: DataFrame, texts: DataFrame, hundredths: int = HUNDREDTHS) -> DataFrame:
    """(a, b) of the ``pairs`` (a, b; b is the hub) whose sets are similar; ``texts`` has id, n, text of every one.

    A hub's members are dealt into parts of about LEAVES, and the hub's text goes to each part.
    """
    spark = pairs.sparkSession
    parts = pairs.groupBy(F.col("b").alias("hub")).agg(F.ceil(F.count("*") / LEAVES).cast("int").alias("parts"))
    parts = written(parts, "minhash-parts")
    part = F.pmod(F.xxhash64("a"), F.col("parts")).cast("int")
    members = pairs.join(parts, F.col("b") == F.col("hub")).select("hub", part.alias("part"), F.lit(1).alias("leaf"), "a")
    hubs = parts.select("hub", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.lit(0).alias("leaf"), F.col("hub").alias("a"))
    met = members.unionByName(hubs).join(texts, F.col("a") == F.col("id")).select("hub", "part", "leaf", "a", "n", "text")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    met = met.repartition(count, "hub", "part").sortWithinPartitions("hub", "part", "leaf")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, hub, n_hub = None, b"", 0
        leaves: tuple[list, list, list] = ([], [], [])
        held = 0

        def flush():
            nonlocal leaves, held
            some, (ids, sizes, texts) = leaves, leaves
            leaves, held = ([], [], []), 0
            if not some[0]:
                return None
            found = np.array(ids)[similar_leaves(hub, n_hub, texts, sizes, hundredths)]
            return pa.RecordBatch.from_arrays([pa.array(found, pa.int64()), pa.array(np.full(len(found), key[0]), pa.int64())], ["a", "b"])

        for batch in batches:
            keys = list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
            leaf, ids, sizes = (batch.column(c).to_pylist() for c in (2, 3, 4))
            for i, text in enumerate(batch.column(5).cast(pa.binary())):
                if keys[i] != key or held >= BATCH_BYTES:
                    if (done := flush()) is not None:
                        yield done
                    key = keys[i]
                if not leaf[i]:
                    hub, n_hub = text.as_py(), sizes[i]
                    continue
                for x, y in zip(leaves, (ids[i], sizes[i], text.as_py())):
                    x.append(y)
                held += len(leaves[2][-1])
        if (done := flush()) is not None:
            yield done

    return met.mapInArrow(task, "a long, b long")


def links(docs: DataFrame, nodes: DataFrame, hundredths: int = HUNDREDTHS) -> DataFrame:
    """(a, b): links of similarity ``hundredths`` or more that connect all that those of the buckets connect."""
    spark = nodes.sparkSession
    filed = nodes.where("buckets is not null").select("id", "n", F.explode("buckets").alias("bucket"))
    shared = filed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("high")).where("low < high").select(F.col("bucket").alias("k"))
    alive = written(filed.join(shared, F.col("bucket") == F.col("k")).select("bucket", "id", "n", F.col("id").alias("root")), "minhash-buckets")
    none = spark.createDataFrame([], "a long, b long")
    found, tested, fetched = none, none, _Texts(docs, nodes)
    for _ in range(STARS):
        if alive.isEmpty():
            return found
        hubs = alive.groupBy("bucket").agg(F.min(F.struct("id", "n", "root")).alias("hub"))
        hubs = hubs.select(F.col("bucket").alias("k"), F.col("hub.id").alias("b"), F.col("hub.n").alias("m"), F.col("hub.root").alias("r"))
        near = F.expr(f"100 * least(n, m) >= {hundredths} * greatest(n, m)")  # else the union is too large
        met = written(alive.join(hubs, F.col("bucket") == F.col("k")).where("id <> b").select("bucket", "id", "n", "root", "b", (near & (F.col("root") != F.col("r"))).alias("asks")), "minhash-stars")
        pairs = met.where("asks").select(F.col("id").alias("a"), "b").distinct().join(tested, ["a", "b"], "left_anti")
        pairs = written(pairs, "minhash-pairs")
        rest = met.select("bucket", "id", "n", "root")
        if not pairs.isEmpty():
            tested = tested.unionByName(pairs)
            asked = pairs.select(F.col("a").alias("id")).unionByName(pairs.select(F.col("b").alias("id"))).distinct()
            found = found.unionByName(written(confirmed(pairs, fetched.of(asked), hundredths), "minhash-links"))
            rest = _rooted(rest, found)
        alive = _unsettled(rest)
    if alive.isEmpty():
        return found
    return found.unionByName(written(_rest_links(alive, nodes, fetched, hundredths), "minhash-links"))


def _rooted(rows: DataFrame, found: DataFrame) -> DataFrame:
    """``rows`` (bucket, id, n, root) with the smallest hub that each is linked to as root.

    Equal roots are connected; which unequal ones are, too, is left to the end:
    they meet once more than they need.
    """
    roots = found.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to"))
    return rows.join(roots, F.col("id") == F.col("node"), "left").select("bucket", "id", "n", F.least("id", F.coalesce("to", "id")).alias("root"))


def _unsettled(rows: DataFrame) -> DataFrame:
    """The rows (bucket, id, n, root) of buckets that hold several roots."""
    rows = written(rows, "minhash-rest")
    several = rows.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select(F.col("bucket").alias("k"))
    return written(rows.join(several, F.col("bucket") == F.col("k"), "left_semi"), "minhash-buckets")


def _rest_links(alive: DataFrame, nodes: DataFrame, fetched: _Texts, hundredths: int) -> DataFrame:
    """(a, b): links among the members of buckets (bucket, id, n, root), all that connect different roots.

    Members of buckets that share members meet: they are dealt into parts of
    bounded size, and each two parts into a tile, whose links shrink to a
    spanning forest.
    """
    spark = alive.sparkSession
    star = alive.groupBy("bucket").agg(F.min("id").alias("b")).select(F.col("bucket").alias("k"), "b")
    together = components(alive.join(star, F.col("bucket") == F.col("k")).select(F.col("id").alias("a"), "b"))
    members = alive.groupBy("id").agg(F.first("n").alias("n"), F.first("root").alias("root"))
    label = together.select(F.col("a").alias("node"), F.col("b").alias("of"))
    members = members.join(label, F.col("id") == F.col("node"), "left").select("id", "n", "root", F.coalesce("of", "id").alias("group"))
    texts = fetched.of(members.select("id")).select(F.col("id").alias("i"), "text")
    members = members.join(nodes.select(F.col("id").alias("j"), "sketch"), F.col("id") == F.col("j")).join(texts, F.col("id") == F.col("i"))
    members = written(members.select("group", "id", "n", "root", "sketch", "text"), "minhash-tiles")
    sizes = members.groupBy("group").agg(F.greatest(F.ceil(F.count("*") / TILE), F.ceil(F.sum(F.octet_length("text")) / TILE_BYTES)).cast("int").alias("parts"))
    part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
    dealt = members.join(sizes.select(F.col("group").alias("g"), "parts"), F.col("group") == F.col("g")).withColumn("part", part)
    # part p meets part q in tile (p, q), p at most q; tiles (p, p) get it once
    columns = ["id", "n", "root", "sketch", "text"]
    one = dealt.withColumn("q", F.explode(F.sequence("part", F.col("parts") - 1))).select("group", F.col("part").alias("p"), "q", F.lit(0).alias("side"), *columns)
    two = dealt.where("part > 0").withColumn("p", F.explode(F.sequence(F.lit(0), F.col("part") - 1))).select("group", "p", F.col("part").alias("q"), F.lit(1).alias("side"), *columns)
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    met = one.unionByName(two).repartition(count, "group", "p", "q").sortWithinPartitions("group", "p", "q", "side", "id")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, tile = None, None
        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in range(3))))
            rows = zip(*(batch.column(c).to_pylist() for c in range(3, 8)), batch.column(8).cast(pa.binary()).to_pylist())
            for k, row in zip(keys, rows):
                if k != key:
                    if tile is not None:
                        yield tile.links()
                    key, tile = k, Tile(hundredths)
                tile.rows.append(row)
        if tile is not None:
            yield tile.links()

    return met.mapInArrow(task, "a long, b long")


class Tile:
    """Sets of one part that meet each other, or those of another part: rows (side, id, n, root, sketch, text)."""

    def __init__(self, hundredths: int):
        self.hundredths = hundredths
        self.rows: list[tuple[int, int, int, int, bytes, bytes]] = []

    def links(self) -> pa.RecordBatch:
        side, ids, sizes, roots = (np.array([r[k] for r in self.rows], np.int64) for k in range(4))
        table = np.frombuffer(b"".join(r[4] for r in self.rows), np.uint8).reshape(-1, BINS)
        # all words of the tile get numbers, by their bytes; a set is a sorted array of shingles' numbers
        words = Words([r[5] for r in self.rows], NOT_SPACE)
        vocabulary = Vocabulary(words)
        names = vocabulary.find(words)
        text, first, second = shingles(words, names, vocabulary.size)
        codes = names[first] * (vocabulary.size + 1) + np.where(second < 0, vocabulary.size, names[second])
        starts = np.searchsorted(text, np.arange(len(self.rows) + 1))
        label = {r: k for k, r in enumerate(dict.fromkeys(roots.tolist()))}
        up = list(range(len(label)))

        def top(x: int) -> int:
            while up[x] != x:
                up[x] = up[up[x]]
                x = up[x]
            return x

        made = []
        others = np.flatnonzero(side == 0)
        for i in np.flatnonzero(side == side.max()).tolist():
            near = (100 * np.minimum(sizes[others], sizes[i]) >= self.hundredths * np.maximum(sizes[others], sizes[i])) & (roots[others] != roots[i])
            some = others[near if side[i] else near & (others < i)]
            some = some[((table[some] == table[i]).mean(axis=1) >= AGREE) | (np.minimum(sizes[some], sizes[i]) < AGREE_FROM)]
            mine = codes[starts[i] : starts[i + 1]]
            for k in some.tolist():
                a, b = top(label[int(roots[i])]), top(label[int(roots[k])])
                if a == b:
                    continue
                other = codes[starts[k] : starts[k + 1]]
                common = int((mine[np.minimum(np.searchsorted(mine, other), len(mine) - 1)] == other).sum())
                if 100 * common >= self.hundredths * (len(mine) + len(other) - common):
                    up[max(a, b)] = min(a, b)
                    made.append((int(ids[i]), int(ids[k])))
        a, b = zip(*made) if made else ((), ())
        return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


class _Texts:
    """Texts of nodes, each fetched from the documents once."""

    def __init__(self, docs: DataFrame, nodes: DataFrame):
        self.docs, self.nodes = docs, nodes
        self.held = docs.sparkSession.createDataFrame([], "id long, n long, text string")

    def of(self, ids: DataFrame) -> DataFrame:
        """(id, n, text) of at least the nodes ``ids`` (id)."""
        more = written(self.nodes.join(ids.join(self.held, "id", "left_anti"), "id", "left_semi").select("id", "n", "doc_id", "text_key"), "minhash-more")
        if not more.isEmpty():
            self.held = self.held.unionByName(written(_texts(self.docs, more), "minhash-texts"))
        return self.held


def _texts(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, n, text) of ``nodes``, from the document that stands for each."""
    keys = written(nodes.select("id", "n", F.col("doc_id").alias("d"), F.col("text_key").alias("k")), "minhash-keys")
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("text_key"), text.alias("text"))
    met = rows.join(F.broadcast(keys) if keys.count() <= BROADCAST_KEYS else keys, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("text_key") == F.col("k")))
    return met.select("id", "n", "text").dropDuplicates(["id"])  # repeated rows


def near_groups(docs: DataFrame, hundredths: int = HUNDREDTHS) -> DataFrame:
    """(doc_id, n_shingles, component_id): one row per document.

    Its set are the distinct shingles of two words of the whole text, A-Z in
    lower case.  Defined results: a text that is null or has no words has an
    empty set and is a component of its own, its component_id its doc_id; a
    text of one word has that word as its set; equal sets link; rows without an
    id take part, and a component of such rows alone has component_id null;
    repeated rows and ids are rows of their own; an empty table gives no rows.
    """
    rows = written(sketched(docs), "minhash-rows")
    held = rows.where("digest is not null")
    # equal sets are one node, which the row of smallest id and text key stands for
    stands = F.min(F.struct("doc_id", "text_key")).alias("row")
    least = F.min("doc_id").alias("smallest")
    nodes = held.groupBy("digest").agg(stands, least, F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.first("buckets").alias("buckets"))
    nodes = nodes.select(F.monotonically_increasing_id().alias("id"), "digest", "smallest", "n", F.col("row.doc_id").alias("doc_id"), F.col("row.text_key").alias("text_key"), "sketch", "buckets")
    nodes = written(nodes, "minhash-nodes")
    roots = components(links(docs, nodes, hundredths)).select(F.col("a").alias("node"), F.col("b").alias("root"))
    known = nodes.join(roots, F.col("id") == F.col("node"), "left").select("digest", F.coalesce("root", "id").alias("root"), "smallest")
    known = written(known, "minhash-members")
    of_root = known.groupBy(F.col("root").alias("r")).agg(F.min("smallest").alias("component_id"))
    of_set = known.join(of_root, F.col("root") == F.col("r")).select(F.col("digest").alias("s"), "component_id")
    linked = held.join(of_set, F.col("digest") == F.col("s")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")
    return linked.unionByName(rows.where("digest is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_groups(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
