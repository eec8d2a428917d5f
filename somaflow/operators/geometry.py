"""Patches, rings, nearest centres and overlaps: the engine's range, nearest and self joins."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from decimal import ROUND_HALF_UP, Decimal, localcontext

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from somaflow.folders import filesystem, new_folder

#: Centres, patches and the like up to so many rows go to every task; more are an error that says so.
SMALL_SIDE = 200_000


def analysis_patches(h: int, w: int, grid: tuple[int, int], overlap: int) -> list[tuple[int, int, int, int, int]]:
    """(patch, y0, y1, x0, x1): equal parts, each side moved out by half the overlap and clipped."""
    ys, xs = (np.linspace(0, n, k + 1).astype(int) for n, k in zip((h, w), grid))
    half = overlap // 2
    return [
        (i * grid[1] + j, max(0, int(ys[i]) - half), min(h, int(ys[i + 1]) + half), max(0, int(xs[j]) - half), min(w, int(xs[j + 1]) + half))
        for i in range(grid[0])
        for j in range(grid[1])
    ]


def motion_patches(h: int, w: int, strides: tuple[int, int], overlaps: tuple[int, int]) -> list[tuple[int, int, int, int, int]]:
    """(patch, y0, y1, x0, x1): corners every stride, size stride + overlap, cut at the border."""
    corners = [(y, x) for y in range(0, h, strides[0]) for x in range(0, w, strides[1])]
    return [(n, y, min(h, y + strides[0] + overlaps[0]), x, min(w, x + strides[1] + overlaps[1])) for n, (y, x) in enumerate(corners)]


def in_patches(df: DataFrame, patches: list[tuple[int, int, int, int, int]]) -> DataFrame:
    """``df`` (y, x, ...) once for every patch that holds the pixel, with ``patch``.

    The list is a literal of the plan: each row filters it, nothing is joined.
    """
    every = F.array(*(F.struct(*(F.lit(v).alias(c) for v, c in zip(p, ("patch", "y0", "y1", "x0", "x1")))) for p in patches))
    holds = F.filter(every, lambda p: (F.col("y") >= p["y0"]) & (F.col("y") < p["y1"]) & (F.col("x") >= p["x0"]) & (F.col("x") < p["x1"]))
    return df.withColumn("patch", F.explode(F.transform(holds, lambda p: p["patch"])))


def ring_offsets(radius: int) -> list[tuple[int, int]]:
    """Offsets of disk(r + 1) that disk(r) doesn't hold."""
    r = radius + 1
    return [(y, x) for y in range(-r, r + 1) for x in range(-r, r + 1) if radius**2 < y * y + x * x <= r * r]


def ring_pairs(spark, h: int, w: int, radius: int) -> DataFrame:
    """(y, x, ny, nx): every pixel and its ring pixels inside the image."""
    offsets = F.array(*(F.struct(F.lit(y).alias("dy"), F.lit(x).alias("dx")) for y, x in ring_offsets(radius)))
    at = spark.range(h * w).select((F.col("id") / w).cast("int").alias("y"), (F.col("id") % w).cast("int").alias("x"), F.explode(offsets).alias("o"))
    out = at.select("y", "x", (F.col("y") + F.col("o.dy")).alias("ny"), (F.col("x") + F.col("o.dx")).alias("nx"))
    return out.where((F.col("ny") >= 0) & (F.col("ny") < h) & (F.col("nx") >= 0) & (F.col("nx") < w))


#: Distances that are held at once.
PAIRS = 1 << 20


def checked(df: DataFrame, what: str, most: int = SMALL_SIDE) -> list:
    """The rows of a side that is small by nature; an error if it isn't."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{what}: more than {most} rows; split them by patch")
    return rows


def nearest_center(points: DataFrame, centers: DataFrame, keys: list[str], coordinates: list[str], center_key: str) -> DataFrame:
    """``keys`` of each point with the nearest centre's key and the distance; ties to the smaller key.

    Centres are few (neurons or patches; the size is checked) and go to every
    task; points stay where they are.
    """
    rows = sorted(checked(centers.select(center_key, *coordinates), "centres"), key=lambda r: r[0])
    names, at = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows], float).reshape(len(rows), len(coordinates))
    kept = points.select(*keys, *(F.col(c).cast("double").alias(c) for c in coordinates))
    out = [f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema[: len(keys)]] + [f"`{center_key}` long", "distance double"]
    line = np.argsort(at[:, 0], kind="stable") if len(coordinates) == 1 else None

    def task(batches):
        for batch in batches:
            x = np.stack([np.asarray(batch.column(len(keys) + i)) for i in range(len(coordinates))], axis=1)
            best, dist = np.zeros(len(x), np.int64), np.full(len(x), np.nan)
            if len(rows) and line is not None:  # on a line: the two around the point
                s = at[line, 0]
                i = np.searchsorted(s, x[:, 0])
                left = np.searchsorted(s, s[np.maximum(i - 1, 0)])  # the first, so the smallest key, of equal centres
                right = np.minimum(i, len(s) - 1)
                dl, dr = np.abs(x[:, 0] - s[left]), np.abs(x[:, 0] - s[right])
                a, b = line[left], line[right]
                best = np.where((dl < dr) | ((dl == dr) & (a < b)), a, b)
                dist = np.minimum(dl, dr)
            elif len(rows):
                step = max(1, PAIRS // len(rows))
                for k in range(0, len(x), step):
                    d = sum((x[k : k + step, i, None] - at[:, i]) ** 2 for i in range(at.shape[1]))
                    best[k : k + step], dist[k : k + step] = d.argmin(axis=1), np.sqrt(d.min(axis=1))
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keys)], pa.array(names[best].astype(np.int64) if len(rows) else best), pa.array(dist)], [*batch.schema.names[: len(keys)], center_key, "distance"])

    return kept.mapInArrow(task, ", ".join(out))


def centers_of_mass(footprints: DataFrame, w: int, key: str = "k") -> DataFrame:
    """(key, cy, cx) of the positive weights."""
    y, x = (F.col("p") / w).cast("int"), F.col("p") % w
    return footprints.groupBy(key).agg((F.sum(F.col("a") * y) / F.sum("a")).alias("cy"), (F.sum(F.col("a") * x) / F.sum("a")).alias("cx"))


def _pixel_join(footprints: DataFrame, on: list[str]) -> DataFrame:
    a = footprints.select(*on, F.col("k").alias("i"), F.col("a").alias("wi"))
    b = footprints.select(*on, F.col("k").alias("j"), F.col("a").alias("wj"))
    return a.join(b, on).where("i < j").groupBy("i", "j").agg(F.sum(F.col("wi") * F.col("wj")).alias("overlap")).where("overlap > 0")


#: Footprints of a block, and weights of one.  A task holds two blocks of a patch and PAIRS of their products at once.
TILE, WEIGHTS = 8192, 1 << 20
#: Most tasks for tiles; where there are fewer tiles, each has its own.
TASKS = 4096


class _Block:
    """Footprints in order of their keys: these, whether they are ``many`` patches', and their weights by row and pixel."""

    def __init__(self, rows: pa.Table):
        self.k, self.many = np.asarray(rows["k"]), np.asarray(rows["many"])
        px = rows["px"].combine_chunks()
        self.at, self.p, self.a = np.append(0, np.cumsum(np.diff(np.asarray(px.offsets)))), np.asarray(px.flatten()), np.asarray(rows["a"].combine_chunks().flatten())
        self.row = np.repeat(np.arange(len(self.k)), np.diff(self.at))

    def dense(self, first: int, last: int, where: np.ndarray) -> np.ndarray:
        """(last - first, pixels): the weights at the pixels ``where``, in order."""
        row, p, a = (x[self.at[first] : self.at[last]] for x in (self.row, self.p, self.a))
        place = np.minimum(np.searchsorted(where, p), len(where) - 1)
        on = where[place] == p
        size = (last - first) * len(where)
        return np.bincount((row[on] - first) * len(where) + place[on], a[on], size).reshape(last - first, len(where))


def _products(left: _Block, right: _Block) -> Iterator[tuple[int, int, np.ndarray]]:
    """(first, start, products) of rows of the left side, from ``first`` on, with those of the right one from ``start`` on.

    Some rows are taken at a time, and where both sides are the same block, no
    rows before them.  Blocks of few pixels are laid out once.
    """
    step = max(1, PAIRS // max(1, len(right.k)))
    both = np.intersect1d(left.p, right.p)
    held = right.dense(0, len(right.k), both) if 0 < len(both) <= step else None
    for first in range(0, len(left.k) if len(both) else 0, step):
        last, start = min(first + step, len(left.k)), first if left is right else 0
        where = both if held is not None else np.intersect1d(left.p[left.at[first] : left.at[last]], both)
        out = np.zeros((last - first, len(right.k) - start))
        for n in range(0, len(where), step):
            part = where[n : n + step]
            x, y = left.dense(first, last, part), right.dense(start, len(right.k), part) if held is None else held[start:]
            if np.isfinite(x).all() and np.isfinite(y).all():
                out += x @ y.T
            else:  # no weight isn't a weight of nought: it has no product with infinity
                for c in range(len(part)):
                    i, j = np.flatnonzero(x[:, c]), np.flatnonzero(y[:, c])
                    out[np.ix_(i, j)] += np.outer(x[i, c], y[j, c])
        yield first, start, out


def rounded(v: np.ndarray, digits: int) -> np.ndarray:
    """``v`` as Spark rounds it: by its shortest decimal, halves away from nought.

    What floating point could place on the wrong side of a half, or is too
    large for it or not finite, goes by its text.
    """
    with np.errstate(invalid="ignore", over="ignore"):
        y = np.abs(v) * 10.0**digits
        n = np.floor(y + 0.5)
        y -= n
        odd = np.flatnonzero(~(np.abs(y, out=y) <= 0.5 - (n + 2) * 2.0**-50))
        out = np.copysign(np.divide(n, 10.0**digits, out=n), v, out=n)
    with localcontext(prec=400):
        for i in odd:
            out[i] = float(Decimal(repr(float(v[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if np.isfinite(v[i]) else v[i]
    return np.add(out, 0.0, out=out)  # never minus zero


class _Forest:
    """Of links between n nodes those that join what wasn't joined before."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def joining(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Places of the links (i, j) that are needed."""
        left, kept = np.arange(len(i)), [np.zeros(0, np.int64)]
        while True:
            a, b = self.root[i[left]], self.root[j[left]]
            left, a, b = left[a != b], a[a != b], b[a != b]
            if not len(left):
                return np.concatenate(kept)
            high, one = np.unique(np.maximum(a, b), return_index=True)
            kept.append(left[one])
            up = np.arange(len(self.root))
            up[high] = np.minimum(a, b)[one]
            while (up != up[up]).any():
                up = up[up]
            self.root = up[self.root]


def laid(footprints: DataFrame, within: str) -> DataFrame:
    """(g, block, many, file, at, size): where in the shared folder each block of a patch's footprints is, and how many of them are several patches'.

    A footprint is written once for each of its patches, whatever number of
    blocks it has to meet; a task's blocks share a file.
    """
    spark, folder = footprints.sparkSession, new_folder(footprints.sparkSession, "footprints")
    whole = F.col(within).isNotNull() & F.col("k").isNotNull() & F.col("p").isNotNull() & F.col("a").isNotNull()
    rows = footprints.where(whole).groupBy("k").agg(F.collect_list(F.struct(F.col(within).alias("g"), F.col("p").cast("long").alias("p"), F.col("a").cast("double").alias("a"))).alias("z"))
    groups = F.array_distinct(F.transform("z", lambda e: e["g"]))
    rows = rows.select("k", "z", (F.size(groups) > 1).alias("many"), F.explode(groups).alias("g")).select("k", "g", "many", F.filter("z", lambda e: e["g"] == F.col("g")).alias("z"))
    rows = rows.select("k", "g", "many", F.transform("z", lambda e: e["p"]).alias("px"), F.transform("z", lambda e: e["a"]).alias("a"))
    size = footprints.groupBy(F.col(within).alias("g")).agg(F.greatest(F.ceil(F.approx_count_distinct("k") / TILE), F.ceil(F.count("*") / WEIGHTS), F.lit(1)).cast("int").alias("blocks"))
    placed = rows.join(F.broadcast(size), "g").select("g", F.pmod(F.xxhash64("k"), F.col("blocks")).cast("int").alias("block"), "k", "many", "px", "a")
    placed = placed.repartition("g", "block").sortWithinPartitions("g", "block", "k")
    schema = StructType([placed.schema["g"], placed.schema["block"]]).add("many", "long").add("file", "string").add("at", "long").add("size", "long")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, path = filesystem(folder)
        name, sink, made = f"{uuid.uuid4().hex}.arrow", None, []

        def put(held: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(held).combine_chunks()
            at, kept = sink.tell(), table.drop(["g", "block"])
            with pa.ipc.new_stream(sink, kept.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as stream:
                stream.write_table(kept)
            told = (int(np.count_nonzero(np.asarray(table["many"]))), name, at, sink.tell() - at)
            made.append(pa.RecordBatch.from_arrays([*(table[c].chunk(0).slice(0, 1) for c in ("g", "block")), *(pa.array([v]) for v in told)], schema.names))

        try:
            held, now = [], None
            for batch in batches:
                if sink is None:
                    system.create_dir(path, recursive=True)
                    sink = system.open_output_stream(f"{path}/{name}")
                keys = [*map(repr, zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))]
                edges = [0, *(n for n in range(1, len(keys)) if keys[n] != keys[n - 1]), len(keys)]
                for first, last in zip(edges, edges[1:]):
                    if held and last > first and keys[first] != now:
                        put(held)
                        held = []
                    if last > first:
                        held, now = [*held, batch.slice(first, last - first)], keys[first]
            if held:
                put(held)
        finally:
            if sink is not None:
                sink.close()
        yield from made  # when the file is whole

    found, path = placed.mapInArrow(write, schema), new_folder(spark, "blocks")
    found.write.parquet(path)
    return spark.read.schema(schema).parquet(path).withColumn("file", F.concat(F.lit(f"{folder}/"), "file"))


def _block(file: str, at: int, size: int) -> _Block:
    system, path = filesystem(file)
    with system.open_input_file(path) as source:
        source.seek(at)
        return _Block(pa.ipc.open_stream(source.read(size)).read_all())


def _tiled(footprints: DataFrame, within: str, least: float | None, what: str, digits: int | None = None, blocks: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(found, rest): what tiles find, and the pairs (i, j, overlap) of footprints that lie in several patches both, whose parts add up.

    A tile is two blocks of a patch, which its task reads from the shared
    folder: no footprint is shuffled or stored for each tile, and no product
    leaves the task that made it but those that are asked for.
    """
    blocks = laid(footprints, within) if blocks is None else blocks
    side = lambda number, name: blocks.select("g", F.col("block").alias(number), F.struct("file", "at", "size").alias(name))
    tiles = side("x", "left").join(side("y", "right"), "g").where("x < y or x = y and left <= right")
    tiles = tiles.repartition(max(1, min(TASKS, tiles.count())), "g", "x", "y")

    def meet(left: _Block, right: _Block) -> Iterator[pa.RecordBatch]:
        met, forest = np.zeros(len(left.k) + len(right.k), bool), _Forest(len(left.k) + len(right.k))
        shift = 0 if left is right else len(left.k)
        for first, start, v in _products(left, right):
            known = ~(v <= 0) if least is None else ~(np.floor(v * 1e6 + 0.5) / 1e6 <= least)
            here, there = slice(first, first + len(v)), slice(start, None)
            if left.many.any():
                known &= ~(left.many[here, None] & right.many[there])
            if left is right:
                known &= left.k[here, None] < right.k[there]
            if what == "pairs":
                a, b, v = np.repeat(left.k[here], known.sum(axis=1)), np.broadcast_to(right.k[there], v.shape)[known], v[known]
                a, b = (a, b) if left is right else (np.minimum(a, b), np.maximum(a, b))
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), pa.array(v if digits is None else rounded(v, digits))], ["i", "j", "overlap"])
                continue
            i, j = np.nonzero(known)
            if what == "members":
                met[first + i], met[shift + start + j] = True, True
            else:
                one = forest.joining(first + i, shift + start + j)
                yield pa.RecordBatch.from_arrays([pa.array(left.k[first + i[one]]), pa.array(right.k[start + j[one]])], ["i", "j"])
        if what == "members":
            yield pa.RecordBatch.from_arrays([pa.array(np.append(left.k, right.k)[met])], ["k"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tile in batch.select(["left", "right"]).to_pylist():
                left = _block(**tile["left"])
                yield from meet(left, left if tile["left"] == tile["right"] else _block(**tile["right"]))

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for n, row in enumerate(batch.to_pylist()):
                block = _block(row["file"], row["at"], row["size"])
                on = block.many[block.row]
                g = batch.column(0).take(pa.array(np.full(int(on.sum()), n)))
                yield pa.RecordBatch.from_arrays([pa.array(block.k[block.row[on]]), g, pa.array(block.p[on]), pa.array(block.a[on])], ["k", "g", "p", "a"])

    found = tiles.groupBy("g", "x", "y").applyInArrow(run, {"pairs": "i long, j long, overlap double", "members": "k long", "links": "i long, j long"}[what])
    shared = blocks.where("many > 0").mapInArrow(several, StructType().add("k", "long").add("g", blocks.schema["g"].dataType).add("p", "long").add("a", "double"))
    rest = _pixel_join(shared, ["p", "g"])
    rest = rest if digits is None else rest.withColumn("overlap", F.round("overlap", digits))
    return found, rest if least is None else rest.where(F.round("overlap", 6) > least)


def overlap_graph(footprints: DataFrame, within: str | None = None, digits: int | None = None) -> DataFrame:
    """(i, j, overlap) of neurons i < j that share pixels, i.e. whose footprints' product is positive; rounded to ``digits``, if any.

    A pixel of a whole image holds few neurons, so that the join on pixels grows
    with the pixels.  ``within`` keeps pairs inside a patch, where all may
    overlap: its footprints meet by blocks, and only the pairs themselves are
    as many as there are.
    """
    if not within:
        found = _pixel_join(footprints, ["p"])
        return found if digits is None else found.withColumn("overlap", F.round("overlap", digits))
    found, rest = _tiled(footprints, within, None, "pairs", digits)
    return found.unionByName(rest)


def overlapping(footprints: DataFrame, within: str, least: float, blocks: DataFrame | None = None) -> DataFrame:
    """(k): neurons with an overlap inside a patch that, rounded to six places, is more than ``least``; pairs aren't made.

    ``blocks`` are the footprints as :func:`laid` has written them, where that has been done.
    """
    found, rest = _tiled(footprints, within, least, "members", None, blocks)
    return found.unionByName(rest.select(F.explode(F.array("i", "j")).alias("k"))).distinct()


def overlap_links(footprints: DataFrame, within: str, least: float) -> DataFrame:
    """(i, j): of the pairs that :func:`overlapping` looks at as many as connect what all of them do, a tree for each part of a tile."""
    found, rest = _tiled(footprints, within, least, "links")
    return found.unionByName(rest.select("i", "j"))


def merge_groups(edges: DataFrame, checkpoint=None) -> DataFrame:
    """(k, root): connected components of (i, j) links by smallest member, nodes with links only.

    Minimum labels spread until none changes; neurons are few, rounds are at
    most the longest shortest path.  ``checkpoint`` cuts the lineage of a round.
    """
    cut = checkpoint or (lambda df: df)
    both = cut(edges.select(F.col("i").alias("a"), F.col("j").alias("b")).unionByName(edges.select(F.col("j").alias("a"), F.col("i").alias("b"))).distinct())
    label = both.select(F.col("a").alias("k"), F.col("a").alias("root")).distinct()
    total = None
    while True:
        heard = both.join(label, both["b"] == label["k"]).select(F.col("a").alias("k"), "root")
        label = cut(label.unionByName(heard).groupBy("k").agg(F.min("root").alias("root")))
        now = label.agg(F.sum(F.pmod(F.xxhash64("k", "root"), F.lit(998_244_353)))).first()[0]
        if now == total:
            return label
        total = now


def max_shear(fields: DataFrame, h: int, w: int) -> DataFrame:
    """(t, shear) of shift images (t, a, b): upper quartile of the largest steps between neighbours, of both images along both axes."""

    def step(image: str, by: int, held):
        at = F.filter(F.sequence(F.lit(0), F.lit(h * w - 1)), held)
        return F.array_max(F.transform(at, lambda i: F.abs(F.get(F.col(image), i + by) - F.get(F.col(image), i))))

    down, right = (lambda i: i < h * w - w), (lambda i: i % w < w - 1)
    four = F.array_sort(F.array(*(step(c, by, held) for c in ("a", "b") for by, held in ((w, down), (1, right)))))
    m = fields.select("t", four.alias("m"))
    return m.select("t", (F.col("m")[2] + (F.col("m")[3] - F.col("m")[2]) * 0.25).alias("shear"))  # the quartile lies a quarter past the third


def vector_field(shifts: DataFrame, h: int, w: int, strides: tuple[int, int], size: tuple[int, int]) -> DataFrame:
    """``shifts`` (i, j, dy, dx, ...) of patches by row and column, as arrows: x, y, u, v, and xp, yp.

    An arrow starts at its patch's middle, at most at the image's border; a
    patch that didn't move has no arrow (u, v null) but a dot at xp, yp.
    """
    y, x = (F.least(s * F.col(c) + F.lit(d / 2), F.lit(float(n))) for c, s, d, n in zip(("i", "j"), strides, size, (h, w)))
    moved = (F.col("dy") != 0) | (F.col("dx") != 0)
    out = shifts.withColumns({"x": x, "y": y, "u": F.when(moved, F.col("dx")), "v": F.when(moved, F.col("dy"))})
    return out.withColumns({"xp": F.when(F.col("u").isNull(), F.col("x")), "yp": F.when(F.col("u").isNull(), F.col("y"))})
