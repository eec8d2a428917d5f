"""Cross-tokenizer alignment by deduplicated segments.

A text is cut before white space that neither vocabulary can merge across, which
``cut_rules`` verifies on the vocabularies.  Texts are read in chunks; a chunk
keeps its distinct segments, with their counts, as rows of a table, and its
documents as places in that list, in a file of the shared folder.  Equal segments
of all chunks meet, are tokenised and aligned once, and the alignment goes back
to each chunk's list, where its documents are composed: what a document has is
the sum, or the concatenation, of what its segments have, since both tokenizers
end a token at every cut.

What is shuffled has a row for each segment of a chunk, however often it occurs
there; texts and documents' places stay where they are.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import cache
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.shared import commit_file, filesystem, new_folder, written

BYTE_LEVEL = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
#: A chunk ends after about so much text, or so many distinct segments.
CHUNK_CHARS = 8 << 20
CHUNK_SEGMENTS = 1 << 18
#: Segments whose links are held at once.
AT_ONCE = 1 << 15
#: Characters of segments that are tokenised in one call.
LINE = 1 << 12
#: Id pairs with their counts (17 bytes each) are broadcast up to so many; beyond that they are joined.
BROADCAST_PAIRS = 1_500_000
SPACE = "▁"
COUNTS = ["n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum"]


def path_of(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones themselves, the others from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers, and the bytes of each of their tokens."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a, self.b = Tokenizer.from_file(a), SentencePieceProcessor(model_file=b)
        self.a.encode_special_tokens = True
        byte_of = _byte_of()
        vocabulary = self.a.get_vocab(with_added_tokens=False)
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for t, i in vocabulary.items():
            self.bytes_a[i] = bytes(byte_of[c] for c in t)
        self.bytes_b = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            self.bytes_b.append(bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(SPACE, " ").encode())

        self.sizes_a, self.sizes_b = (np.array(list(map(len, x))) for x in (self.bytes_a, self.bytes_b))
        self.kind = np.dtype("<u2" if max(len(self.sizes_a), len(self.sizes_b)) <= 1 << 16 else "<u4")

    def encode(self, lines: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of each line; all start with a space, which the second tokenizer adds by itself."""
        a = [e.ids for e in self.a.encode_batch_fast(lines, add_special_tokens=False)]
        return a, self.b.encode([s[1:] for s in lines], num_threads=1)

    def has_bytes(self, a: list[int], b: list[int], text: str) -> bool:
        """Whether both tokenisations have the text's bytes."""
        raw = text.encode()
        return b"".join(map(self.bytes_a.__getitem__, a)) == raw and b"".join(map(self.bytes_b.__getitem__, b)) == raw


@cache
def tokenizers_for(a: str, b: str) -> Tokenizers:
    return Tokenizers(a, b)


def cut_rules(a: str, b: str) -> set[str] | None:
    """Characters after which a text may not be cut before a space; None if it may be cut nowhere.

    The first tokenizer has to be of the byte-level kind, whose pattern never
    goes from a character that isn't white space to a space.  In the second, a
    piece that has a character before a space forbids cuts after that character,
    and it must keep every space and put one before each text, which is tried.
    """
    import json

    with open(a, encoding="utf-8") as f:
        plan = json.load(f)
    before = plan.get("pre_tokenizer") or {}
    if plan.get("normalizer") is not None or before.get("type") != "ByteLevel" or not before.get("use_regex") or before.get("add_prefix_space"):
        return None
    both = tokenizers_for(a, b)
    tried = "a  b \n c   d"
    if b"".join(both.bytes_b[i] for i in both.b.encode(tried)) != (" " + tried).encode():
        return None
    pieces = [both.b.id_to_piece(i) for i in range(both.b.get_piece_size())]
    return {p[k] for p in pieces for k in range(len(p) - 1) if p[k] != SPACE and p[k + 1] == SPACE}


class Segments:
    """The distinct segments of a chunk, and texts as places in their list.

    A segment is a space and what follows it here: ``keys`` has it without the space.
    """

    def __init__(self, unsafe: set[str] | None):
        self.unsafe = unsafe
        self.keys: list[str] = []
        #: Places of segments without a further space that the next one may be cut from, and of all others.
        self.plain: dict[str, int] = {}
        self.odd: dict[str, int] = {}

    def _ends_well(self, piece: str) -> bool:
        return bool(piece) and not piece[-1].isspace() and piece[-1] not in self.unsafe

    def _place(self, key: str, where: dict[str, int]) -> int:
        if (at := where.get(key)) is None:
            at = where[key] = len(self.keys)
            self.keys.append(key)
        return at

    def places(self, text: str) -> list[int]:
        """The segments of a space and ``text``; concatenated, they are that."""
        if self.unsafe is None:
            return [self._place(text, self.odd)]
        pieces = text.split(" ")
        out = list(map(self.plain.get, pieces))
        if None not in out:
            return out
        new = dict.fromkeys(p for p, at in zip(pieces, out) if at is None)
        if all(map(self._ends_well, new)):
            for p in new:
                self._place(p, self.plain)
            return list(map(self.plain.__getitem__, pieces))
        # runs of white space start a segment, and stay with the last one at the end
        segments: list[list[str]] = []
        well = False
        for p in pieces:
            if well:
                segments.append([p])
            elif segments:
                segments[-1].append(p)
            else:
                segments = [[p]]
            well = self._ends_well(p)
        if len(segments) > 1 and not "".join(segments[-1]).strip():
            tail = segments.pop()
            segments[-1] += tail
        return [self._place(s[0], self.plain) if len(s) == 1 and self._ends_well(s[0]) else self._place(" ".join(s), self.odd) for s in segments]


_PLACES = pa.schema([("doc_id", pa.int64()), ("low", pa.binary()), ("high", pa.binary())])


def _places_written(at: np.ndarray) -> tuple[bytes, bytes]:
    """Lower 16 bits of places, and the others; frequent segments come early, so that the others are mostly nought."""
    return at.astype("<u2").tobytes(), (at >> 16).astype("<u2").tobytes() if len(at) and at.max() >> 16 else b""


def _places_read(low: bytes, high: bytes) -> np.ndarray:
    at = np.frombuffer(low, "<u2").astype(np.int64)
    return at + (np.frombuffer(high, "<u2").astype(np.int64) << 16) if high else at


def _documents(file: str, folder: str) -> Iterator[tuple[pa.Array, list[np.ndarray | None]]]:
    """(doc_ids, places of each; None without text) from a chunk's file."""
    with filesystem(folder)[0].open_input_stream(file) as source:
        for batch in pa.ipc.open_stream(source):
            yield batch.column(0), [None if x is None else _places_read(x, y) for x, y in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]


def chunked(docs: DataFrame, unsafe: set[str] | None, folder: str) -> DataFrame:
    """(chunk, place, segment, n, file): a chunk's distinct segments with their counts; at place -1 the file of its documents."""

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        class Chunk:
            def __init__(self, number: int):
                self.number, self.held, self.size, self.counts = number, Segments(unsafe), 0, np.zeros(0, np.int64)
                self.system, self.draft, self.final = commit_file(folder, f"chunk-{number:014x}", ".arrow")
                self.sink = self.system.open_output_stream(self.draft)
                self.stream = pa.ipc.new_stream(self.sink, _PLACES, options=pa.ipc.IpcWriteOptions(compression="zstd"))

            def take(self, ids: pa.Array, texts: list[str | None]) -> None:
                low: list[bytes | None] = []
                high: list[bytes | None] = []
                for text in texts:
                    if not text:
                        low.append(None)
                        high.append(None)
                        continue
                    at = np.array(self.held.places(text), np.int64)
                    self.size += len(text)
                    n = len(self.held.keys)
                    if len(self.counts) < n:
                        self.counts = np.concatenate((self.counts, np.zeros(n - len(self.counts) + (n >> 1), np.int64)))
                    np.add.at(self.counts, at, 1)
                    x, y = _places_written(at)
                    low.append(x)
                    high.append(y)
                self.stream.write_batch(pa.RecordBatch.from_arrays([ids, pa.array(low, pa.binary()), pa.array(high, pa.binary())], schema=_PLACES))

            def close(self) -> Iterator[pa.RecordBatch]:
                self.stream.close()
                self.sink.close()
                self.system.move(self.draft, self.final)
                for a in range(0, len(self.held.keys), 8192):
                    keys = self.held.keys[a : a + 8192]
                    yield self._rows(range(a, a + len(keys)), [" " + k for k in keys], self.counts[a : a + len(keys)], None)
                yield self._rows([-1], [None], [0], self.final)

            def _rows(self, places, segments, counts, file) -> pa.RecordBatch:
                n = len(segments)
                return pa.RecordBatch.from_arrays([pa.array([self.number] * n, pa.int64()), pa.array(places, pa.int32()), pa.array(segments, pa.string()), pa.array(counts, pa.int64()), pa.array([file] * n, pa.string())], ["chunk", "place", "segment", "n", "file"])

        number, chunk = TaskContext.get().partitionId() << 24, None
        for batch in batches:
            for start in range(0, len(batch), 64):
                part = batch.slice(start, 64)
                chunk = chunk or Chunk(number)
                chunk.take(part.column(0), part.column(1).to_pylist())
                if chunk.size >= CHUNK_CHARS or len(chunk.held.keys) >= CHUNK_SEGMENTS:
                    yield from chunk.close()
                    number, chunk = number + 1, None
        if chunk is not None:
            yield from chunk.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "chunk long, place int, segment string, n long, file string")


class Links:
    """Linked token occurrences of many texts, one text after the other.

    a, b: ids; state: 0 where both tokens are new, which starts a group, 1 where
    only the first is, 2 where only the second is; ends: where each text's end.
    """

    def __init__(self, a: np.ndarray, b: np.ndarray, state: np.ndarray, ends: np.ndarray):
        self.a, self.b, self.state, self.ends = a, b, state, ends

    @classmethod
    def of(cls, a: np.ndarray, b: np.ndarray, both: Tokenizers, text_ends: np.ndarray) -> Links | None:
        """Of texts that stand in one line, tokenised as a whole; None unless both end a token where each text ends.

        A link is a stretch of bytes between two ends of tokens, of either kind.
        """
        ends_a, ends_b = np.cumsum(both.sizes_a[a]), np.cumsum(both.sizes_b[b])
        cuts = np.union1d(ends_a, ends_b)
        at_a, at_b = np.searchsorted(ends_a, cuts), np.searchsorted(ends_b, cuts)
        if len(cuts) and (cuts[-1] != ends_a[-1] or cuts[-1] != ends_b[-1]):
            return None
        new_a, new_b = np.diff(at_a, prepend=-1) > 0, np.diff(at_b, prepend=-1) > 0
        where = np.searchsorted(cuts, text_ends)
        whole = np.isin(text_ends, ends_a) & np.isin(text_ends, ends_b)
        if not whole.all():
            return None
        state = np.where(new_a & new_b, 0, np.where(new_a, 1, 2)).astype(np.uint8)
        return cls(a[at_a], b[at_b], state, where + 1)

    def packed(self, kind: np.dtype) -> list[bytes]:
        """Each text's links as bytes."""
        a, b, starts = self.a.astype(kind), self.b.astype(kind), [0, *self.ends[:-1].tolist()]
        return [a[lo:hi].tobytes() + b[lo:hi].tobytes() + self.state[lo:hi].tobytes() for lo, hi in zip(starts, self.ends.tolist())]

    @classmethod
    def unpacked(cls, parts: list[bytes], kind: np.dtype) -> Links:
        w = kind.itemsize
        sizes = np.array([len(p) // (2 * w + 1) for p in parts], np.int64)
        a = np.frombuffer(b"".join(p[: n * w] for p, n in zip(parts, sizes.tolist())), kind)
        b = np.frombuffer(b"".join(p[n * w : 2 * n * w] for p, n in zip(parts, sizes.tolist())), kind)
        state = np.frombuffer(b"".join(p[2 * n * w :] for p, n in zip(parts, sizes.tolist())), np.uint8)
        return cls(a.astype(np.int64), b.astype(np.int64), state, np.cumsum(sizes))

    def codes(self) -> np.ndarray:
        return self.a << 32 | self.b

    def sums(self, values: np.ndarray) -> np.ndarray:
        """Of each text, over its links."""
        total = np.concatenate(([0], np.cumsum(values)))
        return total[self.ends] - total[np.concatenate(([0], self.ends[:-1]))]

    def groups(self) -> list[str]:
        """Each text's groups: ids of either kind in order."""
        names_a, names_b, state = list(map(str, self.a.tolist())), list(map(str, self.b.tolist())), self.state.tolist()
        firsts = np.flatnonzero(self.state == 0)
        made = []
        for lo, hi in zip(firsts.tolist(), [*firsts[1:].tolist(), len(state)]):
            if hi - lo == 1:
                made.append(f"{names_a[lo]}|{names_b[lo]}")
            else:
                made.append(",".join(names_a[k] for k in range(lo, hi) if state[k] != 2) + "|" + ",".join(names_b[k] for k in range(lo, hi) if state[k] != 1))
        ends = np.searchsorted(firsts, self.ends).tolist()
        return [";".join(made[lo:hi]) for lo, hi in zip([0, *ends[:-1]], ends)]


def align(segments: list[str], both: Tokenizers) -> list[bytes | None]:
    """The packed links of each segment; None where its tokens don't have its bytes.

    Segments that may stand side by side are tokenised in lines, since neither
    tokenizer goes across their ends; a line where that fails, or that has
    U+2581, is taken apart.
    """
    lines: list[list[str]] = []
    size = LINE
    for s in segments:
        if size >= LINE:
            lines.append([])
            size = 0
        lines[-1].append(s)
        size = LINE if s[-1].isspace() else size + len(s)  # white space at the end could go on

    def packed(parts: list[str], a: list[int], b: list[int]) -> list[bytes] | None:
        if not a or not both.has_bytes(a, b, "".join(parts)):
            return None
        ends = np.cumsum([len(s.encode()) for s in parts])
        links = Links.of(np.array(a, np.int64), np.array(b, np.int64), both, ends)
        return None if links is None else links.packed(both.kind)

    out: list[bytes | None] = []
    for parts, a, b in zip(lines, *both.encode(["".join(x) for x in lines])):
        if (made := packed(parts, a, b)) is None:
            for one, x, y in zip(parts, *both.encode(parts)):
                out.append((packed([one], x, y) or [None])[0])
        else:
            out += made
    return out


def aligned(lists: DataFrame, a: str, b: str) -> DataFrame:
    """(chunk, place, n, links): the packed links of the chunks' segments, null where a segment's tokens don't have its bytes.

    Equal segments meet, and are tokenised once (those at the edge of an Arrow batch once more).
    """
    spark = lists.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    met = lists.where("place >= 0").select("segment", "chunk", "place", "n").repartition(count, "segment").sortWithinPartitions("segment")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both = tokenizers_for(a, b)
        for batch in batches:
            segments = batch.column(0).dictionary_encode()
            made = pa.array(align(segments.dictionary.to_pylist(), both), pa.binary())
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], made.take(segments.indices)], ["chunk", "place", "n", "links"])

    return met.mapInArrow(task, "chunk long, place int, n long, links binary")


def _by_chunk(rows: DataFrame, folder: str, schema: str, make: Callable) -> DataFrame:
    """Batches of ``make(links of a chunk's list by place, documents' batches)`` for each chunk.

    ``rows`` (chunk, place, links, n_best, count_sum, file) has the chunk's file
    at place -1.
    """
    spark = rows.sparkSession
    count = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    met = rows.select("chunk", "place", "links", "n_best", "count_sum", "file").repartition(count, "chunk").sortWithinPartitions("chunk", "place")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        chunk, file, held = None, None, []
        for batch in batches:
            numbers = np.asarray(batch.column(0))
            edges = np.flatnonzero(np.diff(numbers)) + 1
            for lo, hi in zip([0, *edges.tolist()], [*edges.tolist(), len(batch)]):
                if hi == lo:
                    continue
                part = batch.slice(lo, hi - lo)
                if numbers[lo] != chunk:
                    if held:
                        yield from make(pa.Table.from_batches(held), _documents(file, folder))
                    chunk, file, held = numbers[lo], part.column(5)[0].as_py(), []
                    part = part.slice(1)
                    held.append(part)
                else:
                    held.append(part)
        if held:
            yield from make(pa.Table.from_batches(held), _documents(file, folder))

    return met.mapInArrow(task, schema)


_PAIRS = "x long, y long, count long"


def _pair_rows(codes: np.ndarray, counts: np.ndarray) -> pa.RecordBatch:
    """(x, y, count), equal pairs added up."""
    distinct, place = np.unique(codes, return_inverse=True)
    total = np.zeros(len(distinct), np.int64)
    np.add.at(total, place, counts)
    return pa.RecordBatch.from_arrays([pa.array(distinct >> 32), pa.array(distinct & 0xFFFFFFFF), pa.array(total)], ["x", "y", "count"])


def pair_counts(found: DataFrame, files: DataFrame, folder: str, kind: np.dtype) -> DataFrame:
    """(x, y, count): how many links hold each pair of ids, those of documents without tokens left out."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = Links.unpacked([x or b"" for x in batch.column(1).to_pylist()], kind)
            sizes = np.diff(links.ends, prepend=0)
            yield _pair_rows(links.codes(), np.repeat(np.asarray(batch.column(0)), sizes))

    pairs = found.select("n", "links").mapInArrow(count, _PAIRS)
    bad = written(found.where("links is null").select("chunk").distinct(), "align-invalid")
    if not bad.isEmpty():
        # documents that have a segment without valid tokens have none themselves: their other links go

        def less(table: pa.Table, documents) -> Iterator[pa.RecordBatch]:
            parts = table.column("links").to_pylist()
            wrong = np.array([x is None for x in parts], bool)
            links = Links.unpacked([x or b"" for x in parts], kind)
            sizes = np.diff(links.ends, prepend=0)
            for _, places in documents:
                mine = [p for p in places if p is not None and wrong[p].any()]
                if mine:
                    n = np.bincount(np.concatenate(mine), minlength=len(parts))
                    yield _pair_rows(links.codes(), -np.repeat(n, sizes))

        some = _with_files(found, files).join(bad, "chunk", "left_semi")
        pairs = pairs.unionByName(_by_chunk(some, folder, _PAIRS, less))
    return pairs.groupBy("x", "y").agg(F.sum("count").alias("count")).where("count > 0")


def _with_files(found: DataFrame, files: DataFrame, scores: DataFrame | None = None) -> DataFrame:
    rows = found if scores is None else found.join(scores, ["chunk", "place"], "left")
    for c in ("n_best", "count_sum"):
        rows = rows if c in rows.columns else rows.withColumn(c, F.lit(None).cast("long"))
    rows = rows.select("chunk", "place", "links", "n_best", "count_sum", F.lit(None).cast("string").alias("file"))
    none = [F.lit(None).cast(t).alias(c) for c, t in (("links", "binary"), ("n_best", "long"), ("count_sum", "long"))]
    return rows.unionByName(files.select("chunk", F.lit(-1).alias("place"), *none, "file"))


def alignments(docs: DataFrame, a: str | None = None, b: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    Defined results: a text that is null or empty, or whose tokens' bytes aren't
    a space and the text in either tokenizer (one that has U+2581 itself), has no
    tokens: zeros and '', and none of its links counts; rows of one id and equal
    rows are documents of their own, all counted; a text without a place to cut
    is one segment, whatever its length; an empty table gives no rows.
    """
    a, b, spark = a or path_of(BYTE_LEVEL), b or path_of(PIECES), docs.sparkSession
    folder, kind = new_folder(spark, "align-documents"), tokenizers_for(a, b).kind
    lists = written(chunked(docs, cut_rules(a, b), folder), "align-lists")
    files = lists.where("place = -1").select("chunk", "file")
    found = written(aligned(lists, a, b), "align-links")
    pairs = written(pair_counts(found, files, folder, kind), "align-pairs")
    most = pairs.groupBy(F.col("y").alias("of")).agg(F.max("count").alias("most"))  # a row for each id of a vocabulary
    pairs = pairs.join(F.broadcast(most), F.col("y") == F.col("of")).select("x", "y", "count", (F.col("count") == F.col("most")).alias("best"))
    table = scores = None
    if pairs.count() <= BROADCAST_PAIRS:
        rows = pairs.toPandas().sort_values(["x", "y"])
        table = spark.sparkContext.broadcast(((rows["x"].to_numpy() << 32 | rows["y"].to_numpy()), rows["count"].to_numpy(), rows["best"].to_numpy()))
    else:
        scores = _joined_scores(found, pairs, kind)

    def score(links: Links) -> list[np.ndarray]:
        """(n_best, count_sum) of each segment."""
        codes, counts, best = table.value
        at = np.minimum(np.searchsorted(codes, links.codes()), len(codes) - 1)
        known = codes[at] == links.codes()  # those that only documents without tokens have are in no table
        return [links.sums(known & best[at]), links.sums(np.where(known, counts[at], 0))]

    def make(held: pa.Table, documents) -> Iterator[pa.RecordBatch]:
        numbers, groups, valid = [np.zeros((0, len(COUNTS)), np.int64)], [], []
        for start in range(0, len(held), AT_ONCE):
            part = held.slice(start, AT_ONCE)
            packed = part.column("links").to_pylist()
            valid += [x is not None for x in packed]
            links = Links.unpacked([x or b"" for x in packed], kind)
            mine = [links.sums(links.state != 2), links.sums(links.state != 1), links.sums(links.state == 0), np.diff(links.ends, prepend=0)]
            if table is None:
                mine += [np.asarray(part.column(c).fill_null(0)) for c in ("n_best", "count_sum")]
            else:
                mine += score(links) if len(table.value[0]) else [np.zeros(len(packed))] * 2
            numbers.append(np.stack(mine, axis=1).astype(np.int64))
            groups += links.groups()
        numbers, valid = np.concatenate(numbers), np.array(valid, bool)
        for ids, places in documents:
            sums, digests = np.zeros((len(places), len(COUNTS)), np.int64), [""] * len(places)
            for i, p in enumerate(places):
                if p is not None and valid[p].all():
                    sums[i] = numbers[p].sum(axis=0)
                    digests[i] = sha256(";".join(map(groups.__getitem__, p.tolist())).encode()).hexdigest()
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(sums[:, k]) for k in range(len(COUNTS))), pa.array(digests, pa.string())], ["doc_id", *COUNTS, "groups_sha256"])

    schema = "doc_id long, " + ", ".join(f"{c} long" for c in COUNTS) + ", groups_sha256 string"
    return _by_chunk(_with_files(found, files, scores), folder, schema, make)


def _joined_scores(found: DataFrame, pairs: DataFrame, kind: np.dtype) -> DataFrame:
    """(chunk, place, n_best, count_sum) by a join, where the pairs are too many to be sent to every task."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = Links.unpacked([x or b"" for x in batch.column(2).to_pylist()], kind)
            sizes = np.diff(links.ends, prepend=0)
            chunk, place = (np.repeat(np.asarray(batch.column(c)), sizes) for c in (0, 1))
            yield pa.RecordBatch.from_arrays([pa.array(chunk), pa.array(place), pa.array(links.a), pa.array(links.b)], ["chunk", "place", "u", "v"])

    each = found.select("chunk", "place", "links").mapInArrow(spread, "chunk long, place int, u long, v long")
    met = each.join(pairs, (F.col("u") == F.col("x")) & (F.col("v") == F.col("y")))
    return met.groupBy("chunk", "place").agg(F.sum(F.col("best").cast("long")).alias("n_best"), F.sum("count").alias("count_sum"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignments(spark.read.parquet(f"{sf_dir}/documents.parquet"))
