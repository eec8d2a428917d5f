"""Exact substring dedup: every byte covered by a repeated 200-byte string.

The method asked for, external induced sorting of all suffixes, would move a
tuple of 16 bytes or more for every byte of text; see the README for why this
operator sorts a sample of the suffixes instead and induces the rest from it.

1. Sample.  In every 200-byte window the 64-byte string of smallest hash is an
   anchor, the last one on ties.  The choice depends on the window's bytes
   alone, so equal windows have equal anchors at equal offsets; about one byte
   in seventy is an anchor.
2. Sort.  Anchors are grouped by their string's hash; groups of one can't lie in
   a repeated window and go.  In a group, anchors with equal surroundings (all
   windows that hold the anchor) are one class, so copies are compared once.
3. Induce.  A class of two members or more repeats all its windows.  Otherwise
   the surroundings of the group's classes are compared window by window, each
   class's surroundings read once.  A group of many classes is cut first: by
   ranges of window starts, and by the bytes that all windows of a range hold.
   What differs outside a range is one class there, so the parts shrink.
4. The repeated windows of each class go back to its members, and each
   document's windows are united.

The rolling hashes only propose.  Windows that meet in a task count as equal if
their bytes are; across tasks, and for classes, 128-bit BLAKE2b digests of the
bytes decide.  Documents are numbered as they are written to the shared folder.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.shared import written
from somaflow.llm.textbytes import Hasher, chunks, mix

LENGTH = 200
GRAM = 64
#: Classes of a group that are compared inside one task (336 bytes each); larger groups are cut, and what is still larger is compared by shuffling windows.
CLASSES = 1024
#: Window starts to a range of a cut group.
STEP = 18
#: Windows that are hashed at once when classes are compared.
AT_ONCE = 1 << 18
PIECE = 1 << 18
_PLACE = np.uint64((1 << 31) - 1)


def _digests(data, ranges, marks: list[int]) -> np.ndarray:
    """(ranges, 2): 128 bits as two longs that tell apart the bytes of each range of ``data``, and its mark."""
    salts = {m: m.to_bytes(8, "little", signed=True) for m in set(marks)}
    view = memoryview(data)
    made = [hashlib.blake2b(view[a:b], digest_size=16, salt=salts[m]).digest() for (a, b), m in zip(ranges, marks)]
    return np.frombuffer(b"".join(made), "<i8").reshape(-1, 2)


def anchors_of(texts: list[bytes], length: int = LENGTH, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Anchors of some texts: text, place, hash of the anchor (g), digest (c, d), bytes before (l) and from (r) it of its surroundings."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    at = np.concatenate(([0], np.cumsum(sizes)))
    joined = b"".join(texts)
    data = np.frombuffer(joined, np.uint8)
    none = np.zeros(0, np.int64)
    if not (sizes >= length).any():
        return {"text": none, "place": none, "g": none.astype(np.uint64), "c": none, "d": none, "l": none, "r": none}
    hasher = Hasher(data)
    grams = len(data) - gram + 1
    g = mix((hasher.sums[gram:] - hasher.sums[:-gram]) * hasher.down[:grams])
    # smallest hash of each window, with its place from the end of the buffer below it
    low = (g & ~_PLACE) | (_PLACE - np.arange(grams, dtype=np.uint64))
    reach, span = 1, length - gram + 1
    while reach < span:
        step = min(reach, span - reach)
        low = np.minimum(low[:-step], low[step:])
        reach += step
    whole = np.zeros(len(low) + 1, np.int64)  # windows that lie within one text
    long = sizes >= length
    np.add.at(whole, at[:-1][long], 1)
    np.add.at(whole, np.minimum(at[1:][long] - length + 1, len(low)), -1)
    place = (_PLACE - (low[np.cumsum(whole[:-1]) > 0] & _PLACE)).astype(np.int64)
    place = place[np.concatenate(([True], place[1:] != place[:-1]))]
    text = np.searchsorted(at, place, side="right") - 1
    begin, end = np.maximum(at[text], place - (length - gram)), np.minimum(at[text + 1], place + length)
    left = place - begin
    c = _digests(joined, zip(begin.tolist(), end.tolist()), left.tolist())
    return {"text": text, "place": place - at[text], "g": g[place], "c": c[:, 0], "d": c[:, 1], "l": left, "r": end - place}


def _stored(docs: DataFrame) -> DataFrame:
    """(key, doc_id, packed), written: a number of each row, its id, and the whole text as Zstandard bytes."""

    def task(batches):
        import zstandard

        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            for a, b, texts in chunks(batch, "text", PIECE):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array([packer.compress(t) for t in texts], pa.binary())], ["key", "doc_id", "packed"])

    rows = docs.select(F.monotonically_increasing_id().alias("key"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return written(rows.mapInArrow(task, "key long, doc_id long, packed binary"), "texts", "none")


def _anchors(texts: DataFrame) -> DataFrame:
    def task(batches):
        for batch in batches:
            keys = np.asarray(batch.column(0))
            for a, held in _pieces(batch.column(1)):
                x = anchors_of(held)
                columns = [keys[a + x["text"]], x["place"].astype(np.int32), x["g"].view(np.int64), x["c"], x["d"], x["l"].astype(np.int16), x["r"].astype(np.int16)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["key", "place", "g", "c", "d", "l", "r"])

    return texts.select("key", "packed").mapInArrow(task, "key long, place int, g long, c long, d long, l short, r short")


def _pieces(packed: pa.Array):
    """(first row, texts) of packed texts, in runs of about PIECE bytes."""
    start, size, held = 0, 0, []
    for at in range(0, len(packed), 64):
        for text in _unpacked(packed.slice(at, 64)):
            held.append(text)
            size += len(text)
            if size >= PIECE:
                yield start, held
                start, size, held = start + len(held), 0, []
    if held:
        yield start, held


def _unpacked(column: pa.Array) -> list[bytes]:
    import zstandard

    unpacker = zstandard.ZstdDecompressor()
    return [b"" if x is None else unpacker.decompress(x) for x in column.to_pylist()]


def _united(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Maximal runs that the spans cover."""
    out: list[list[int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b) for a, b in out]


def _windows(sizes: np.ndarray, left: np.ndarray, low: int = -LENGTH, high: int = 1, length: int = LENGTH) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(class, first byte from the anchor, first byte of all) of the windows of joined surroundings that start from ``low`` to ``high`` - 1."""
    at = np.cumsum(sizes) - sizes
    start, stop = np.maximum(-left, low), np.minimum(sizes - length - left + 1, high)
    count = np.maximum(stop - start, 0)
    owner = np.repeat(np.arange(len(sizes)), count)
    first = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count) + start[owner]
    return owner, first, at[owner] + left[owner] + first


def _equal(data: np.ndarray, name: np.ndarray, first: np.ndarray, begin: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """Which windows have another one of their name, first byte and bytes."""
    words = np.ndarray(max(0, len(data) - 7), "<u8", data, strides=(1,))
    out, rest = np.zeros(len(name), bool), np.arange(len(name))
    while len(rest):
        _, at, kind = np.unique(name[rest], return_index=True, return_inverse=True)
        model = rest[at][kind]
        same = first[rest] == first[model]
        for k in [*range(0, length - 8, 8), length - 8]:
            same &= words[begin[rest] + k] == words[begin[model] + k]
        out[rest] = same & (np.bincount(kind, same) > 1)[kind]
        rest = rest[~same]  # equal hashes of different bytes: compared among themselves
    return out


def _compared(left: np.ndarray, group: np.ndarray, around: list[bytes]):
    """(class, its repeated windows' first bytes from the anchor) of whole groups of classes, by class."""
    sizes = np.fromiter(map(len, around), np.int64, len(around))
    data = np.frombuffer(b"".join(around), np.uint8)
    hasher = Hasher(data)
    step = max(1, AT_ONCE // len(around))
    owners, firsts = [], []
    for low in range(-LENGTH, 1, step):
        owner, first, begin = _windows(sizes, left, low, min(low + step, 1))
        name = mix(mix(hasher.ranges(begin, begin + LENGTH) + first.astype(np.uint64)) + group[owner].astype(np.uint64))
        _, kind, times = np.unique(name, return_inverse=True, return_counts=True)
        met = np.flatnonzero(times[kind] > 1)
        met = met[_equal(data, kind[met], first[met], begin[met])]
        owners.append(owner[met])
        firsts.append(first[met])
    owner, first = np.concatenate(owners), np.concatenate(firsts)
    order = np.argsort(owner, kind="stable")
    owner, first = owner[order], first[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    return [(int(o[0]), f.tolist()) for o, f in zip(np.split(owner, cuts), np.split(first, cuts)) if len(o)]


_SPAN = pa.list_(pa.struct([("s", pa.int32()), ("e", pa.int32())]))
_SPANS = "array<struct<s:int,e:int>>"
#: What names a class: its group, and its digest.
_CLASS = ["g", "c", "d"]


def _as_spans(starts: list[list[int]]) -> pa.Array:
    return pa.array([[{"s": a, "e": b} for a, b in _united([(f, f + LENGTH) for f in x])] for x in starts], _SPAN)


def _whole(classes: DataFrame) -> DataFrame:
    """(g, c, d, spans) of classes with l and r all of whose windows are repeated."""
    return classes.select(*_CLASS, F.array(F.struct((-F.col("l")).cast("int").alias("s"), F.col("r").cast("int").alias("e"))).alias("spans"))


def _named(df: DataFrame, *columns: str) -> DataFrame:
    """A side of a join by class: _g, _c, _d and the columns."""
    return df.select(*(F.col(c).alias(f"_{c}") for c in _CLASS), *columns)


def _same_class() -> Column:
    return (F.col("g") == F.col("_g")) & (F.col("c") == F.col("_c")) & (F.col("d") == F.col("_d"))


def _in_tasks(surroundings: DataFrame) -> DataFrame:
    """(g, c, d, spans): classes (g, c, d, l, around) compared within groups of at most CLASSES, a group in one task."""
    spark = surroundings.sparkSession

    def compare(batches):
        held: list[list] = [[], [], [], [], []]

        def done():
            g, c, d, left, around = held
            group = np.cumsum([0, *(x != y for x, y in zip(g[1:], g))])
            found = _compared(np.array(left, np.int64), group, around)
            return pa.RecordBatch.from_arrays([*(pa.array([x[o] for o, _ in found], pa.int64()) for x in (g, c, d)), _as_spans([f for _, f in found])], [*_CLASS, "spans"])

        for batch in (b.slice(a, 256) for b in batches for a in range(0, len(b), 256)):
            for row in zip(*(batch.column(n).to_pylist() for n in (*_CLASS, "l", "around"))):
                if len(held[0]) >= 2048 and row[0] != held[0][-1]:
                    yield done()
                    held = [[], [], [], [], []]
                for x, v in zip(held, row):
                    x.append(v)
        if held[0]:
            yield done()

    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    dealt = surroundings.select(*_CLASS, "l", "around").repartition(parts, "g").sortWithinPartitions("g")
    return dealt.mapInArrow(compare, f"g long, c long, d long, spans {_SPANS}")


def _by_windows(surroundings: DataFrame) -> DataFrame:
    """(g, c, d, spans): classes (g, c, d, l, around) of groups of any size, compared by shuffling their windows' digests."""

    def windows(batches):
        for batch in (b.slice(a, 512) for b in batches for a in range(0, len(b), 512)):
            around = batch.column("around").to_pylist()
            owner, first, begin = _windows(np.fromiter(map(len, around), np.int64, len(around)), np.asarray(batch.column("l")).astype(np.int64))
            h = _digests(b"".join(around), ((a, a + LENGTH) for a in begin.tolist()), first.tolist())
            names = [batch.column(n).take(pa.array(owner)) for n in _CLASS]
            yield pa.RecordBatch.from_arrays([*names, pa.array(first.astype(np.int32)), pa.array(h[:, 0]), pa.array(h[:, 1])], [*_CLASS, "first", "h", "i"])

    def unite(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in _CLASS), _as_spans(batch.column("x").to_pylist())], [*_CLASS, "spans"])

    each = written(surroundings.mapInArrow(windows, "g long, c long, d long, first int, h long, i long"), "windows")
    met = each.groupBy("h", "i").agg(F.count("*").alias("n")).where("n > 1").select(F.col("h").alias("hh"), F.col("i").alias("ii"))
    met = written(met, "windows-met")
    found = each.join(met, (F.col("h") == F.col("hh")) & (F.col("i") == F.col("ii"))).groupBy(*_CLASS).agg(F.collect_set("first").alias("x"))
    return found.mapInArrow(unite, f"g long, c long, d long, spans {_SPANS}")


def _in_parts(surroundings: DataFrame) -> DataFrame:
    """(g, c, d, spans): classes (g, c, d, l, around) of large groups, cut by ranges of window starts and the bytes common to a range.

    Equal windows start in the same range and hold the same common bytes, so
    they meet in one part.  The parts are groups of classes like those before.
    """

    def cut(batches):
        for batch in (b.slice(a, 512) for b in batches for a in range(0, len(b), 512)):
            arounds = batch.column("around").to_pylist()
            owner, marks, common, whole, ends = [], [], [], [], []
            at = 0
            for k, (left, around) in enumerate(zip(batch.column("l").to_pylist(), arounds)):
                for low in range(GRAM - LENGTH, 1, STEP):
                    last = min(low + STEP - 1, 0)
                    a, b = max(-left, low), min(len(around) - left - LENGTH, last)
                    if a <= b:
                        owner.append(k)
                        marks.append((low, a))
                        common.append((at + left + last, at + left + low + LENGTH))
                        whole.append((at + left + a, at + left + b + LENGTH))
                        ends.append(b + LENGTH)
                at += len(around)
            data = b"".join(arounds)
            g, c = _digests(data, common, [m for m, _ in marks]), _digests(data, whole, [a for _, a in marks])
            names = [batch.column(n).take(pa.array(owner, pa.int64())) for n in _CLASS]
            parts = [pa.array(g[:, 0]), pa.array(c[:, 0]), pa.array(c[:, 1]), pa.array([-a for _, a in marks], pa.int32()), pa.array(ends, pa.int32()), pa.array([data[a:b] for a, b in whole], pa.binary())]
            yield pa.RecordBatch.from_arrays([*names, *parts], ["of_g", "of_c", "of_d", *_CLASS, "l", "r", "around"])

    parts = written(surroundings.mapInArrow(cut, "of_g long, of_c long, of_d long, g long, c long, d long, l int, r int, around binary"), "parts")
    classes = parts.groupBy(*_CLASS).agg(F.count("*").alias("n"), F.first("l").alias("l"), F.first("r").alias("r"), F.first("around").alias("around"))
    classes = written(classes, "part-classes")
    kinds = written(classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.col("g").alias("gg"), "k"), "part-kinds")
    mixed = classes.join(kinds, F.col("g") == F.col("gg")).select(*_CLASS, "k", "l", "around")
    found = _whole(classes.where("n > 1")).unionByName(_in_tasks(mixed.where(F.col("k") <= CLASSES)))
    if not (large := mixed.where(F.col("k") > CLASSES)).isEmpty():
        found = found.unionByName(_by_windows(large))
    found = written(found, "part-verdicts")
    back = parts.select("of_g", "of_c", "of_d", *_CLASS).join(_named(found, "spans"), _same_class())
    return back.select(F.col("of_g").alias("g"), F.col("of_c").alias("c"), F.col("of_d").alias("d"), "spans")


def repeats(texts: DataFrame) -> DataFrame:
    """(key, spans): the repeated bytes of each of the stored texts that has any, as spans that may overlap."""
    anchors = written(_anchors(texts), "anchors")
    again = anchors.groupBy("g").agg(F.count("*").alias("m")).where("m > 1").select(F.col("g").alias("gg"))
    again = written(again, "anchors-again")  # read back, a join with it can split a hot group
    shared = written(anchors.join(again, F.col("g") == F.col("gg")).drop("gg"), "anchors-shared")
    # any member can stand for its class; of those in the text of smallest key, any
    member = [F.min("key").alias("key"), F.min_by("place", "key").alias("place"), F.first("l").alias("l"), F.first("r").alias("r")]
    classes = written(shared.groupBy(*_CLASS).agg(F.count("*").alias("n"), *member), "classes")
    kinds = classes.groupBy("g").agg(F.count("*").alias("k")).where("k > 1").select(F.col("g").alias("gg"), "k")
    kinds = written(kinds, "kinds")
    # a class of two or more repeats all its windows; only single ones have to find partners
    full = _whole(classes.where((F.col("n") > 1) & (F.col("l") + F.col("r") >= LENGTH)))
    mixed = classes.join(kinds, F.col("g") == F.col("gg")).where(F.col("l") + F.col("r") >= LENGTH)
    want = mixed.groupBy(F.col("key").alias("k_key")).agg(F.collect_list(F.struct(*_CLASS, "k", "l", "r", "place")).alias("want"))
    holding = texts.join(want, F.col("key") == F.col("k_key")).select("packed", "want")

    def around(batches):
        names, kinds = (*_CLASS, "k", "l", "around"), (pa.int64(),) * 4 + (pa.int32(), pa.binary())
        held: list[tuple] = []

        def flush():
            columns = zip(*held) if held else [()] * len(names)
            done = pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], list(names))
            held.clear()
            return done

        for batch in batches:
            for at in range(0, len(batch), 64):
                part = batch.slice(at, 64)
                for text, wanted in zip(_unpacked(part.column(0)), part.column(1).to_pylist()):
                    for w in wanted:
                        held.append((w["g"], w["c"], w["d"], w["k"], w["l"], text[w["place"] - w["l"] : w["place"] + w["r"]]))
                        if len(held) >= 8192:
                            yield flush()
        yield flush()

    surroundings = written(holding.mapInArrow(around, "g long, c long, d long, k long, l int, around binary"), "surroundings")
    verdicts = full.unionByName(_in_tasks(surroundings.where(F.col("k") <= CLASSES)))
    if not (large := surroundings.where(F.col("k") > CLASSES)).isEmpty():
        verdicts = verdicts.unionByName(_in_parts(large))
    verdicts = written(verdicts, "verdicts")
    members = shared.select("key", "place", *_CLASS).join(_named(verdicts, "spans"), _same_class()).select("key", "place", F.explode("spans").alias("x"))
    spans = F.struct((F.col("place") + F.col("x.s")).alias("s"), (F.col("place") + F.col("x.e")).alias("e"))
    return members.groupBy("key").agg(F.collect_set(spans).alias("spans"))


COLUMNS = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def trimmed(docs: DataFrame, with_text: bool = False) -> DataFrame:
    """The digest columns of every document, and its kept bytes as ``kept`` if ``with_text``.

    Spans are judged on the input.  Defined results: a null text is an empty
    one; texts of fewer bytes than a string keep everything; equal rows are
    documents of their own and repeat each other; an empty table gives no rows.
    Kept bytes may cut a character, and so are binary.
    """
    texts = _stored(docs)
    spans = written(repeats(texts), "repeats").select(F.col("key").alias("k_key"), "spans")
    rows = texts.join(spans, F.col("key") == F.col("k_key"), "left").select("doc_id", "packed", "spans")
    schema = COLUMNS + (", kept binary" if with_text else "")

    def task(batches):
        for batch in (b.slice(a, 512) for b in batches for a in range(0, len(b), 512)):
            size, removed, runs, digests, kept = [], [], [], [], []
            for text, found in zip(_unpacked(batch.column(1)), batch.column(2).to_pylist()):
                cut = _united([(x["s"], x["e"]) for x in found or ()])
                left = b"".join(text[a:b] for a, b in zip([0, *(b for _, b in cut)], [*(a for a, _ in cut), len(text)]))
                size.append(len(text))
                removed.append(len(text) - len(left))
                runs.append(len(cut))
                digests.append(hashlib.sha256(left).hexdigest())
                kept.append(left if with_text else None)
            columns = [batch.column(0), pa.array(size, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digests, pa.string())]
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array(kept, pa.binary())] if with_text else []), names)

    return rows.mapInArrow(task, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trimmed(spark.read.parquet(f"{sf_dir}/documents.parquet"))
