"""Approximate nearest neighbours by cross-polytope hashing.

A table's hash rotates a unit vector by three rounds of random signs and a fast
Hadamard transform, and takes the nearest signed axis, or two such axes.  Every
vector is filed once in each table.  A query probes the buckets whose axes come
nearest to it, and all vectors there are ranked by their exact inner product, in
double precision.

How many tables, axes and probes that takes depends on dimension, size and shape
of the data, so it is measured: for a bounded sample of the queries the true
neighbours are found, and of the choices that find RECALL of them the cheapest
is taken.  Where every such choice meets over MEET of the rows, hashing doesn't
narrow the search, and all rows are ranked tile by tile instead.

Buckets meet their queries in tasks that hold a bounded number of vectors: a
bucket with more is split, and its queries visit every part.  So a hot bucket
costs time in proportion to its rows, and none of them is left out.

Vectors of unequal lengths are filed by ranges of their length, each with a
choice of its own.  In each range they are made unit vectors for the hash by one
more coordinate, which leaves the order of inner products as it is; it is small,
as the range is narrow.  A query visits every range whose longest vector could
still reach its results.  Ranges of few vectors aren't hashed: their vectors are
ranked against every query, and so are all vectors against a query whose buckets
held fewer than it asks for.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somaflow.llm.shared import written

TABLES = 16
#: Choices that are measured.
TABLE_STEPS = (2, 4, 8, 16)
PROBE_STEPS = (1, 2, 3, 4, 5, 6, 8, 10, 12, 16, 20, 24, 32, 48, 64, 96, 128)
#: Best axes of each half that pairs are made of.
AXES = 24
#: Share of the true neighbours that a choice has to find, and of the rows that it may meet.
RECALL = 0.99
MEET = 0.75
#: Queries and rows that are measured with, at most.
ASKED = 64
MET = 2048
#: Products that cost as much as moving a vector.
PRODUCTS = 200
BUCKET_PART = 4096
#: Bytes of the vectors, in double precision, that are held where all are ranked; scores that are held at once.
WHOLE_BYTES = 32 << 20
SCORES = 1 << 22
#: Pairs whose products are summed exactly at once.
EXACT = 1 << 14
#: Shortest to longest vector of a range, and the vectors up to which a range is ranked whole.
RANGE = 0.8
WHOLE = 4096
#: Queries that meet a part of what is ranked whole in one task.
ASK_SLICE = 32768
#: The longest vectors, whose scores bound a query's results from below: at most so many, and so many bytes.
HEADS = 1024
HEAD_BYTES = 4 << 20
#: Bits of a bucket's number; table and range stand above them.
BUCKET_BITS = 40
NEAREST = 20
EVERY = 20


class CrossPolytope:
    """Hashes of vectors of ``dim`` components in all tables."""

    def __init__(self, dim: int, scale: float, lift: bool, axes: int = 1, tables: int = TABLES, count: int = 8, seed: int = 5):
        self.dim, self.scale, self.lift, self.axes, self.tables, self.count = dim, scale, lift, axes, tables, count
        self.width = 1 << max(1, (dim + lift - 1).bit_length())
        self.signs = np.random.default_rng(seed).choice(np.array([-1.0, 1.0]), (tables * axes, 3, self.width))

    def _hadamard(self, x: np.ndarray) -> np.ndarray:
        n, half = len(x), 1
        while half < self.width:
            x = x.reshape(n, self.width // (2 * half), 2, half)
            x = np.stack((x[:, :, 0] + x[:, :, 1], x[:, :, 0] - x[:, :, 1]), axis=2).reshape(n, self.width)
            half *= 2
        return x / np.sqrt(self.width)

    def _unit(self, x: np.ndarray, query: bool) -> np.ndarray:
        out = np.zeros((len(x), self.width))
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query or not self.lift:
            out[:, : x.shape[1]] = x / norm
        else:
            out[:, : x.shape[1]] = x / self.scale
            out[:, x.shape[1]] = np.sqrt(np.maximum(0, 1 - (norm[:, 0] / self.scale) ** 2))
        return out

    def _turned(self, unit: np.ndarray, k: int) -> np.ndarray:
        for signs in self.signs[k]:
            unit = self._hadamard(unit * signs)
        return np.concatenate((unit, -unit), axis=1)  # nearness of the 2 width signed axes

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables): the bucket that each vector is filed in."""
        unit, out = self._unit(x, False), np.zeros((len(x), self.tables), np.int64)
        for k in range(self.tables * self.axes):
            out[:, k // self.axes] = out[:, k // self.axes] * 2 * self.width + self._turned(unit, k).argmax(axis=1)
        return out

    def _pairs(self, near: np.ndarray, other: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(a, b, order): the best axes of either half, and their pairs (a * AXES + b) by nearness."""
        a, b = (np.argsort(-y, axis=1, kind="stable")[:, :AXES] for y in (near, other))
        both = np.take_along_axis(near, a, 1)[:, :, None] + np.take_along_axis(other, b, 1)[:, None, :]
        return a, b, np.argsort(-both.reshape(len(near), -1), axis=1, kind="stable")

    def probes(self, x: np.ndarray) -> np.ndarray:
        """(vectors, tables, count): the buckets nearest to each query, its own among them."""
        unit, found = self._unit(x, True), []
        for t in range(self.tables):
            near = self._turned(unit, t * self.axes)
            if self.axes == 1:
                found.append(np.argsort(-near, axis=1, kind="stable")[:, : self.count])
                continue
            a, b, order = self._pairs(near, self._turned(unit, t * self.axes + 1))
            best = order[:, : self.count]
            found.append(np.take_along_axis(a, best // b.shape[1], 1) * 2 * self.width + np.take_along_axis(b, best % b.shape[1], 1))
        return np.stack(found, axis=1)

    def ranks(self, x: np.ndarray, codes: np.ndarray) -> np.ndarray:
        """(queries, vectors, tables): the place of each vector's bucket, ``codes`` (queries, vectors, tables), among those its query would probe."""
        unit, out = self._unit(x, True), np.zeros(codes.shape, np.int64)

        def place(order: np.ndarray, n: int) -> np.ndarray:
            made = np.full((len(order), n), 1 << 30)
            np.put_along_axis(made, order, np.arange(order.shape[1])[None], 1)
            return made

        for t in range(self.tables):
            near = self._turned(unit, t * self.axes)
            if self.axes == 1:
                out[:, :, t] = np.take_along_axis(place(np.argsort(-near, axis=1, kind="stable"), 2 * self.width), codes[:, :, t], 1)
                continue
            a, b, order = self._pairs(near, self._turned(unit, t * self.axes + 1))
            i, j = (np.take_along_axis(place(y, 2 * self.width), z, 1) for y, z in ((a, codes[:, :, t] // (2 * self.width)), (b, codes[:, :, t] % (2 * self.width))))
            pair = np.where((i < a.shape[1]) & (j < b.shape[1]), i * b.shape[1] + j, 0)
            out[:, :, t] = np.where((i < a.shape[1]) & (j < b.shape[1]), np.take_along_axis(place(order, order.shape[1]), pair, 1), 1 << 30)
        return out


def exact(query: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Inner products that depend on the two vectors alone, not on where they stand in a matrix."""
    return (vectors * query).sum(axis=1)


def usable(vectors: DataFrame, id_column: str, column: str) -> tuple[DataFrame, int]:
    """Rows (vec_id, embedding) that take part, and their dimension: the most frequent one, the larger on ties."""
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).alias("embedding")).where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    fine = F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))) & F.exists("embedding", lambda x: F.coalesce(x != 0, F.lit(False)))
    v = v.where(fine)
    sizes = v.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = sizes["d"] if sizes else 0
    return v.where(F.size("embedding") == dim), dim


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return np.asarray(column.flatten()).reshape(len(column), dim)


def _ranges(steps: list) -> list[tuple[float, float, int, list[int]]]:
    """(shortest, longest, vectors, steps) of the ranges with more than WHOLE vectors.

    Steps that together hold vectors of one length, but for rounding, are one range.
    """
    merged: list = []
    for r in sorted((r for r in steps if r["step"] is not None), key=lambda r: r["low"]):
        if merged and merged[-1][0] >= 0.999 * r["high"]:
            merged[-1][1:] = [r["high"], merged[-1][2] + r["n"], [*merged[-1][3], r["step"]]]
        else:
            merged.append([r["low"], r["high"], r["n"], [r["step"]]])
    return [tuple(m) for m in merged if m[2] > WHOLE]


def choose(low: float, high: float, asks: np.ndarray, near: list[np.ndarray], some: np.ndarray, n: int, share: float) -> CrossPolytope | None:
    """The cheapest hash of a range that finds RECALL of the ``near`` vectors of each of the ``asks`` and meets at most MEET of ``some`` of its rows; None if there is none.

    ``n`` rows of the range, ``share`` queries for each.  A vector is moved once
    for each table, a query once for each of its probes there.
    """
    best, least = None, np.inf
    dim, lift = asks.shape[1], bool(low < 0.999 * high)
    of = np.repeat(np.arange(len(asks)), list(map(len, near)))
    for axes in (1, 2):
        h = CrossPolytope(dim, high, lift, axes)
        hit = h.ranks(asks[of], h.codes(np.concatenate(near))[:, None])[:, 0] if len(of) else np.zeros((0, TABLES), np.int64)
        codes = h.codes(some)
        met = np.concatenate([h.ranks(asks[a : a + 8], np.broadcast_to(codes, (len(asks[a : a + 8]), *codes.shape))) for a in range(0, len(asks), 8)])
        for tables in TABLE_STEPS:
            first, any_ = hit[:, :tables].min(axis=1), met[:, :, :tables].min(axis=2)
            for count in PROBE_STEPS:
                if count > (2 * h.width if axes == 1 else AXES * AXES):
                    break
                if len(of) and (first < count).mean() < RECALL:
                    continue
                meets = float((any_ < count).mean())
                # rows in several probed buckets are multiplied as often
                products = float((met[:, :, :tables] < count).mean()) * tables * n
                cost = tables * (1 + share * count) + share * products / PRODUCTS
                if meets <= MEET and cost < least:
                    best, least = (axes, tables, count), cost
                break  # more probes cost more
    return None if best is None else CrossPolytope(dim, high, lift, *best)


def _keys(r: int, tables: int) -> np.ndarray:
    """What is added to the buckets of each table of range ``r``."""
    return (r * TABLES + np.arange(tables)) << BUCKET_BITS


def _measured(rows: DataFrame, n: int, n_asks: int, dim: int, every: int, k: int) -> tuple[np.ndarray, list[list], list]:
    """(some queries, their k nearest, some rows), the last two as (step, vector); at most ASKED, ASKED * k and MET of them.

    A row of a query's own id is none of its nearest here.
    """
    spread = lambda seed: F.xxhash64("vec_id", F.lit(seed))

    def thinned(df: DataFrame, seed: int, most: int, of: int) -> list:
        few = df.where(F.pmod(spread(seed), F.lit(max(1, of // (8 * most)))) == 0)
        return few.orderBy(spread(seed), "vec_id").limit(most).select("vec_id", "step", "embedding").collect()

    asks = thinned(rows.where(F.col("vec_id") % every == 0), 1, ASKED, n_asks)
    some = [(r["step"], np.array(r["embedding"], float)) for r in thinned(rows, 2, MET, n)]
    asks = list({r["vec_id"]: r for r in asks}.values())  # of one id one row
    ids, q = np.array([r["vec_id"] for r in asks], np.int64), np.array([r["embedding"] for r in asks], float).reshape(-1, dim)

    def task(batches):
        held: list = [[] for _ in ids]
        for batch in batches:
            for a in range(0, len(batch), 4096):
                part = batch.slice(a, 4096)
                x, names, step = _matrix(part.column(1), dim).astype(float), np.asarray(part.column(0)), part.column(2).to_pylist()
                score = q @ x.T
                score[names == ids[:, None]] = -np.inf
                top = np.argpartition(-score, min(k, len(x)) - 1, axis=1)[:, :k]
                for i, t in enumerate(top):
                    held[i] = sorted([*held[i], *((-score[i, j], names[j], step[j], x[j]) for j in t.tolist() if score[i, j] > -np.inf)], key=lambda r: r[:2])[:k]
        out = [(i, -s, step, v.tolist()) for i, best in enumerate(held) for s, _, step, v in best]
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.int32(), pa.float64(), pa.int32(), pa.list_(pa.float64())))], ["query", "score", "step", "vector"])

    near: list[list] = [[] for _ in asks]
    if asks:
        best = rows.select("vec_id", "embedding", "step").mapInArrow(task, "query int, score double, step int, vector array<double>")
        order = Window.partitionBy("query").orderBy(F.desc("score"), "vector")
        for r in best.withColumn("place", F.row_number().over(order)).where(F.col("place") <= k).collect():
            near[r["query"]].append((r["step"], np.array(r["vector"])))
    return q, near, some


def nearest(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", every: int = EVERY, k: int = NEAREST) -> DataFrame:
    """(query_id, rank, vec_id, score): each query's ``k`` nearest found, ties to the smaller vec_id.

    Queries are the rows whose id ``every`` divides; a query's own row is no
    candidate.  Defined results: rows without an id, or with a null, zero or
    partly null or non-finite vector, or of another dimension than most, take
    no part; rows of one id are queries and candidates of their own, which only
    their row tells apart, so that a repeated query has as many lists; an empty
    table gives no rows.
    """
    spark = vectors.sparkSession
    rows, dim = usable(vectors, id_column, column)
    schema = "query_id long, rank int, vec_id long, score double"
    if not dim:
        return spark.createDataFrame([], schema)
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))
    rows = rows.withColumn("norm", norm).withColumn("step", F.when((F.col("norm") > 0) & (F.col("norm") < float("inf")), F.floor(F.log("norm") / np.log(1 / RANGE) + 0.5).cast("int")))
    steps = rows.groupBy("step").agg(F.min("norm").alias("low"), F.max("norm").alias("high"), F.count("*").alias("n"), F.count_if(F.col("vec_id") % every == 0).alias("asks")).collect()
    n, n_asks = sum(r["n"] for r in steps), sum(r["asks"] for r in steps)
    hashers, of_step = [], {}
    if (ranges := _ranges(steps)) and n_asks:
        asks, near, some = _measured(rows, n, n_asks, dim, every, k)
        for low, high, size, own in ranges:
            mine = lambda vectors: np.array([v for step, v in vectors if step in own], float).reshape(-1, dim)  # noqa: E731,B023
            h = choose(low, high, asks, [mine(v) for v in near], mine(some), size, n_asks / n)
            if h is not None:
                of_step |= dict.fromkeys(own, len(hashers))
                hashers.append(h)
    n_whole = sum(r["n"] for r in steps if r["step"] not in of_step)
    tops = np.array([h.scale for h in hashers])
    head_ids, heads = np.zeros(0, np.int64), np.zeros((0, dim))
    if len(hashers) > 1:
        longest = rows.orderBy(F.desc("norm"), "vec_id").limit(max(k + 1, min(HEADS, HEAD_BYTES // (8 * dim)))).select("vec_id", "embedding").collect()
        head_ids, heads = np.array([r["vec_id"] for r in longest]), np.array([r["embedding"] for r in longest], float)
    single = "float" in vectors.schema[column].dataType.simpleString()
    stored = np.dtype("<f4" if single else "<f8")

    def visited(ids: np.ndarray, x: np.ndarray) -> np.ndarray:
        """(queries, ranges): whether a vector of the range can be among the query's nearest."""
        if len(heads) <= k:
            return np.ones((len(x), len(tops)), bool)
        score = x @ heads.T
        score[head_ids == ids[:, None]] = -np.inf
        least = np.partition(score, len(heads) - k, axis=1)[:, len(heads) - k]
        reach = np.linalg.norm(x, axis=1)[:, None] * tops
        return reach * (1 + 1e-9) >= least[:, None]

    def file(batches):
        for batch in batches:
            for a in range(0, len(batch), 2048):
                part = batch.slice(a, 2048)
                ids, x = np.asarray(part.column(1)), _matrix(part.column(2), dim)
                within = np.array([of_step.get(s, -1) for s in part.column(3).to_pylist()])
                codes: list = [None] * len(ids)
                for r in np.unique(within[within >= 0]).tolist():
                    mine = np.flatnonzero(within == r)
                    for i, c in zip(mine.tolist(), (hashers[r].codes(x[mine].astype(float)) + _keys(r, hashers[r].tables)).tolist()):
                        codes[i] = c
                asks = np.flatnonzero(ids % every == 0)
                probes: list = [None] * len(ids)
                if len(asks):
                    q, near = x[asks].astype(float), {}
                    visits: list = [[] for _ in asks]
                    for r, some in enumerate(visited(ids[asks], q).T):
                        h = hashers[r]
                        kind = h.lift, h.axes, h.tables, h.count
                        if kind not in near:  # these alone decide where a query looks
                            near[kind] = h.probes(q)
                        for i in np.flatnonzero(some).tolist():
                            visits[i].append((near[kind][i] + _keys(r, h.tables)[:, None]).reshape(-1))
                    for i, v in zip(asks.tolist(), visits):
                        probes[i] = np.concatenate(v).tolist() if v else []
                raw = x.astype(stored)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array([r.tobytes() for r in raw], pa.binary()), pa.array(codes, pa.list_(pa.int64())), pa.array(probes, pa.list_(pa.int64()))],
                    ["row", "vec_id", "vec", "codes", "probes"],
                )

    numbered = rows.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding", "step")
    filed = written(numbered.mapInArrow(file, "row long, vec_id long, vec binary, codes array<long>, probes array<long>"), "ann-filed")
    asking = filed.where("probes is not null")
    data = filed.select("row", "vec_id", "vec", F.explode("codes").alias("key"))
    queries = asking.select("row", "vec_id", "vec", F.explode("probes").alias("key"))
    parts = data.groupBy("key").agg(F.ceil(F.count("*") / BUCKET_PART).cast("int").alias("parts")).where("parts > 1")
    parts = written(parts, "ann-parts").select(F.col("key").alias("b"), "parts")
    here = F.col("key") == F.col("b")
    split = F.coalesce("parts", F.lit(1))
    data = data.join(parts, here, "left").select("key", F.pmod(F.xxhash64("row"), split).cast("int").alias("part"), F.lit(0).alias("asks"), "row", "vec_id", "vec")
    queries = queries.join(parts, here, "left").select("key", F.explode(F.sequence(F.lit(0), split - 1)).alias("part"), F.lit(1).alias("asks"), "row", "vec_id", "vec")
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)

    def whole(data: DataFrame, n: int, asking: DataFrame, n_asks: int) -> DataFrame:
        """All vectors of ``data`` meet all queries, parts of the one and slices of the other."""
        p, s = -(-n // max(256, WHOLE_BYTES // (8 * dim))), max(1, -(-n_asks // ASK_SLICE))
        part, piece = (F.pmod(F.xxhash64("row"), F.lit(m)).cast("int") for m in (p, s))
        spread = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
        data = data.select(spread(s).alias("at"), part.alias("part"), "row", "vec_id", "vec").select(F.lit(-1).cast("long").alias("key"), (F.col("part") * s + F.col("at")).alias("part"), F.lit(0).alias("asks"), "row", "vec_id", "vec")
        asking = asking.select(spread(p).alias("at"), piece.alias("piece"), "row", "vec_id", "vec").select(F.lit(-1).cast("long").alias("key"), (F.col("at") * s + F.col("piece")).alias("part"), F.lit(1).alias("asks"), "row", "vec_id", "vec")
        return data.unionByName(asking)

    def rank(batches):
        held_key, held = None, ([], [], [])  # rows, ids, vectors
        out: list[tuple] = []

        def ask(rows: list[int], ids: list[int], vecs: list[bytes]):
            if not held[0]:
                return
            base, names, labels = np.frombuffer(b"".join(held[2]), stored).reshape(-1, dim).astype(float), np.array(held[0]), np.array(held[1])
            step = max(1, min(512, SCORES // len(base)))
            for a in range(0, len(rows), step):
                q = np.frombuffer(b"".join(vecs[a : a + step]), stored).reshape(-1, dim).astype(float)
                score = q @ base.T
                score[names == np.array(rows[a : a + step])[:, None]] = -np.inf
                m = score.shape[1]
                edge = np.partition(score, m - k, axis=1)[:, m - k] if m > k else np.full(len(q), -np.inf)
                edge = edge - 1e-9 * np.maximum(1, np.abs(np.where(np.isfinite(edge), edge, 1)))
                # all pairs at or above their query's edge, each query's best by exact score
                of, some = np.nonzero((score >= edge[:, None]) & (score > -np.inf))
                s = np.concatenate([exact(q[of[c : c + EXACT]], base[some[c : c + EXACT]]) for c in range(0, len(of), EXACT)] or [np.zeros(0)])
                order = np.lexsort((names[some], labels[some], -s, of))
                of, some, s = of[order], some[order], s[order]
                best = np.arange(len(of)) - np.searchsorted(of, of) < k
                of, some = of[best], some[best]
                out.append((np.array(rows[a : a + step])[of], np.array(ids[a : a + step])[of], names[some], labels[some], s[best]))

        def flush():
            if not out:
                return None
            x = [np.concatenate(c) for c in zip(*out)]
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c) for c in x], ["query", "query_id", "row", "vec_id", "score"])

        for batch in batches:
            keys = list(zip(*(batch.column(c).to_pylist() for c in ("key", "part"))))
            asks, rows, ids, vecs = (batch.column(c).to_pylist() for c in ("asks", "row", "vec_id", "vec"))
            i = 0
            while i < len(keys):
                if keys[i] != held_key:
                    held_key, held = keys[i], ([], [], [])
                j = i
                while j < len(keys) and keys[j] == keys[i] and asks[j] == asks[i]:
                    j += 1
                if asks[i]:
                    ask(rows[i:j], ids[i:j], vecs[i:j])
                else:
                    for x, more in zip(held, (rows, ids, vecs)):
                        x += more[i:j]
                i = j
            if (done := flush()) is not None:
                yield done

    order = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "row")

    def ranked(met: DataFrame) -> DataFrame:
        met = met.repartition(count, "key", "part").sortWithinPartitions("key", "part", "asks")
        found = met.mapInArrow(rank, "query long, query_id long, row long, vec_id long, score double").dropDuplicates(["query", "row"])
        return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query", "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

    met = data.unionByName(queries) if hashers else None
    if n_whole and not hashers:
        met = whole(filed, n, asking, n_asks)
    elif n_whole:
        few = whole(filed.where("codes is null"), n_whole, asking, n_asks)
        met = few if met is None else met.unionByName(few)
    found = ranked(met)
    columns = ["query_id", "rank", "vec_id", "score"]
    if not hashers:
        return found.select(columns)
    found = written(found, "ann-found")
    full = found.where(F.col("rank") == min(k, n - 1)).select("query")
    short = written(asking.join(full, F.col("row") == F.col("query"), "left_anti").select("row", "vec_id", "vec"), "ann-short")
    if not (n_short := short.count()):
        return found.select(columns)
    return found.join(full, "query", "left_semi").unionByName(ranked(whole(filed, n, short, n_short))).select(columns)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
