"""Centroid clustering: plain Lloyd rounds in whole numbers.

Vectors become integers once, in a table of the shared folder.  In each round
the centroids, K times DIM integers, are broadcast; ``mapInPandas`` takes every
vector's squared differences to each centroid in NumPy and keeps one row of sums
per partition and cluster; a ``groupBy`` merges those, and the driver divides K
sums.  No result depends on the order of rows or on how they are partitioned.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from hashlib import sha256
from math import floor

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.shared import written

DIM = 64
CLUSTERS = 16
ROUNDS = 3
SCALE = 64
SEED = "1"
#: Components below this take part in 64-bit arithmetic: DIM squares of their differences stay below 2^60.
NARROW = 1 << 26
#: Bits of a part of a sum; the parts of all partitions add up in a long.
PART_BITS = 32
MOST = (1 << 63) - 1
BLOCK = 8192


def whole(x: float, scale: int = SCALE) -> int:
    """floor(scale * x), exactly."""
    return floor(Fraction(x) * scale)


def kept(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", dim: int = DIM) -> DataFrame:
    """(vec_id, embedding) of the vectors with exactly ``dim`` components, none of them null or non-finite."""
    v = vectors.select(F.col(id_column).cast("long").alias("vec_id"), F.col(column).cast("array<double>").alias("embedding"))
    return v.where((F.size("embedding") == dim) & F.forall("embedding", lambda x: F.coalesce(~F.isnan(x) & (F.abs(x) < float("inf")), F.lit(False))))


def quantised(vectors: DataFrame, dim: int = DIM, scale: int = SCALE) -> DataFrame:
    """(id, q, wide): 32-bit integers, or decimal text where a component has NARROW or more.

    Ids are text, since pandas would make doubles of longs among nulls.
    """

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            x = np.array(frame["embedding"].tolist(), float).reshape(-1, dim)
            with np.errstate(over="ignore"):
                t = np.floor(x * scale)
            narrow = (np.abs(t) < NARROW).all(axis=1)
            q, wide = np.full(len(x), None, object), np.full(len(x), None, object)
            q[narrow] = [r.tobytes() for r in t[narrow].astype("<i4")]
            wide[~narrow] = [",".join(str(whole(v, scale)) for v in r) for r in x[~narrow].tolist()]
            yield pd.DataFrame({"id": frame["id"], "q": q, "wide": wide})

    return vectors.select(F.col("vec_id").cast("string").alias("id"), "embedding").mapInPandas(task, "id string, q binary, wide string")


def distances(rows: np.ndarray, centroids: list[list[int]]) -> np.ndarray:
    """(rows, centroids): squared distances, as 64-bit integers where all fit, else as Python integers.

    A centroid so far from all NARROW vectors that another one is nearer to each
    of them gets the largest 64-bit integer there.
    """
    narrow = [max(map(abs, c), default=0) < NARROW for c in centroids]
    if rows.dtype != object:
        far = [any(narrow) and max(map(abs, c)) - NARROW >= 1 << 30 for c in centroids]
        if all(a or b for a, b in zip(narrow, far)):
            out = np.full((len(rows), len(centroids)), MOST, np.int64)
            for j in np.flatnonzero(narrow):
                d = rows - np.array(centroids[j], np.int64)
                out[:, j] = np.einsum("ij,ij->i", d, d)
            return out
        rows = rows.astype(object)
    out = np.zeros((len(rows), len(centroids)), object)
    for j, c in enumerate(centroids):
        d = rows - np.array(c, object)
        out[:, j] = (d * d).sum(axis=1)
    return out


def _blocks(frame: pd.DataFrame, dim: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places in the frame, integer vectors): those in 64 bits, then those in Python integers."""
    text = frame["wide"].notna().to_numpy()
    for some, wide in ((np.flatnonzero(~text), False), (np.flatnonzero(text), True)):
        for a in range(0, len(some), BLOCK):
            at = some[a : a + BLOCK]
            if wide:
                yield at, np.array([list(map(int, s.split(","))) for s in frame["wide"].iloc[at]], object)
            else:
                yield at, np.frombuffer(b"".join(frame["q"].iloc[at]), "<i4").reshape(-1, dim).astype(np.int64)


def _parts(x: int) -> list[int]:
    """``x`` as parts of PART_BITS, lowest first; the last one has the sign."""
    out = []
    while not -(1 << PART_BITS) < x < 1 << PART_BITS:
        out.append(x & ((1 << PART_BITS) - 1))
        x >>= PART_BITS
    return [*out, x]


def sums(table: DataFrame, centroids: list[list[int]], dim: int = DIM) -> dict[int, tuple[int, list[int]]]:
    """Of each cluster that has vectors: their number and the exact sum of each component."""
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        k = len(shared.value)
        count, small, large = [0] * k, np.zeros((k, dim), np.int64), np.zeros((k, dim), object)
        for frame in frames:
            for _, rows in _blocks(frame, dim):
                nearest = distances(rows, shared.value).argmin(axis=1)
                for j in np.unique(nearest).tolist():
                    mine = rows[nearest == j]
                    count[j] += len(mine)
                    if rows.dtype == object:
                        large[j] += mine.sum(axis=0)
                    else:
                        small[j] += mine.sum(axis=0)
        out = []
        for j in range(k):
            if not count[j]:
                continue
            cut = [_parts(a + b) for a, b in zip(small[j].tolist(), large[j].tolist())]
            for part in range(max(map(len, cut))):
                out.append((j, part, count[j] if part == 0 else 0, [c[part] if part < len(c) else 0 for c in cut]))
        if out:
            yield pd.DataFrame(out, columns=["cluster", "part", "n", "sums"])

    made = table.mapInPandas(task, "cluster int, part int, n long, sums array<long>")
    merged = made.groupBy("cluster", "part").agg(F.sum("n").alias("n"), F.array(*(F.sum(F.col("sums")[i]) for i in range(dim))).alias("sums"))
    found: dict[int, tuple[int, list[int]]] = {}
    for r in merged.collect():  # a row for each cluster and part
        n, total = found.get(r["cluster"], (0, [0] * dim))
        found[r["cluster"]] = n + r["n"], [t + (s << PART_BITS * r["part"]) for t, s in zip(total, r["sums"])]
    shared.destroy()
    return found


def cluster(vectors: DataFrame, id_column: str = "vec_id", column: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS, dim: int = DIM, scale: int = SCALE, seed: str = SEED) -> tuple[DataFrame, list[list[int]]]:
    """(vec_id, cluster, distance) of every vector kept, and the final centroids.

    Centroids start as the vectors whose ``seed:id`` has the smallest SHA-256;
    vectors without an id come after all others, ties go by components.  A
    vector is nearest to the centroid of the smallest squared distance, ties to
    the smaller number; an empty cluster keeps its centroid.

    Defined results: vectors that are null, of another length, or hold a null or
    non-finite component are left out; rows of one id are vectors of their own,
    and so may start as equal centroids; fewer vectors than clusters make as
    many centroids as vectors, none an empty result; components of any finite
    size are exact, but a distance beyond a long is given as the largest one.
    """
    v = kept(vectors, id_column, column, dim)
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    start = v.select(digest.alias("digest"), "embedding").orderBy(F.asc_nulls_last("digest"), "embedding").limit(clusters).collect()
    centroids = [[whole(x, scale) for x in r["embedding"]] for r in start]
    if not centroids:
        return v.sparkSession.createDataFrame([], "vec_id long, cluster int, distance long"), []
    table = written(quantised(v, dim, scale), "cluster-vectors")
    for _ in range(rounds):
        for j, (n, total) in sums(table, centroids, dim).items():
            centroids[j] = [t // n for t in total]
    shared = table.sparkSession.sparkContext.broadcast(centroids)

    def task(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            nearest, far = np.zeros(len(frame), np.int32), np.zeros(len(frame), np.int64)
            for at, rows in _blocks(frame, dim):
                d = distances(rows, shared.value)
                nearest[at] = d.argmin(axis=1)
                far[at] = np.minimum(d.min(axis=1), MOST).astype(np.int64)
            yield pd.DataFrame({"id": frame["id"], "cluster": nearest, "distance": far})

    found = table.mapInPandas(task, "id string, cluster int, distance long")
    return written(found.select(F.col("id").cast("long").alias("vec_id"), "cluster", "distance"), "clusters"), centroids


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector with its cluster's and the whole inertia; an inertia beyond a long is given as the largest one."""
    found, centroids = cluster(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    capped = lambda x: F.least(x, F.lit(MOST).cast("decimal(38,0)")).cast("long")
    total = F.sum(F.col("distance").cast("decimal(19,0)")).cast("decimal(38,0)")
    inertia = {r["cluster"]: r["inertia"] for r in found.groupBy("cluster").agg(total.alias("inertia")).collect()}  # a row for each cluster
    digests = [(j, inertia[j], sum(inertia.values()), sha256(",".join(map(str, c)).encode()).hexdigest()) for j, c in enumerate(centroids) if j in inertia]
    each = spark.createDataFrame(digests, "c int, ci decimal(38,0), i decimal(38,0), centroid_sha256 string")
    each = each.select("c", capped(F.col("ci")).alias("cluster_inertia"), capped(F.col("i")).alias("inertia"), "centroid_sha256")
    return found.join(F.broadcast(each), F.col("cluster") == F.col("c")).select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _oracle() -> str:
    """The rounds written out, for vectors whose distances fit in a long."""
    near = "list_sum([(z[1] - z[2]) * (z[1] - z[2]) for z in list_zip(v.q, c.q)])::BIGINT"
    text = [
        f"""kept AS (SELECT row_number() OVER () AS r, vec_id, [floor({SCALE} * x::DOUBLE)::BIGINT for x in embedding] AS q
  FROM embeddings WHERE len(embedding) = {DIM} AND len([x for x in embedding if x IS NULL OR NOT isfinite(x)]) = 0),
c0 AS (SELECT k, q FROM (SELECT row_number() OVER (ORDER BY sha256('{SEED}:' || vec_id), q) - 1 AS k, q FROM kept) WHERE k < {CLUSTERS})"""
    ]
    for i in range(ROUNDS + 1):
        text.append(f"a{i} AS (SELECT r, min(struct_pack(d := d, k := k)) AS best FROM (SELECT v.r, c.k, {near} AS d FROM kept v, c{i} c) GROUP BY r)")
        if i < ROUNDS:
            text.append(
                f"""m{i} AS (SELECT k, list(f ORDER BY i) AS q FROM (SELECT k, i, floor(sum(x) / count(*))::BIGINT AS f
  FROM (SELECT best.k AS k, unnest(q) AS x, unnest(range({DIM})) AS i FROM a{i} JOIN kept USING (r)) GROUP BY k, i) GROUP BY k),
c{i + 1} AS (SELECT c{i}.k, coalesce(m{i}.q, c{i}.q) AS q FROM c{i} LEFT JOIN m{i} USING (k))"""
            )
    last = ROUNDS
    return (
        "WITH " + ",\n".join(text) + f"""
SELECT vec_id, best.k::INTEGER AS cluster, best.d AS distance, (sum(best.d) OVER (PARTITION BY best.k))::BIGINT AS cluster_inertia,
  (sum(best.d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c{last}.q, ',')) AS centroid_sha256
FROM a{last} JOIN kept USING (r) JOIN c{last} ON c{last}.k = best.k"""
    )


ORACLE = _oracle()
