"""Token-ID / binary output: whole texts encoded and packed into Simple-8b files.

Documents are dealt into ranges of ascending id; each task encodes its range
and streams one file to the shared folder.  The manifest (one row per file,
from the attempts that succeeded) gives every file its first position, and the
files are read back from it.
"""

from __future__ import annotations

import os
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from itertools import accumulate, compress, repeat
from operator import is_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from somaflow.llm import simple8b
from somaflow.llm.shared import commit_file, filesystem, new_folder, written

TOKENIZER = "byte_bpe_50k.json"
END_ID = 2
#: Pieces that a worker remembers; those met later are encoded anew each time, which changes speed only.
MEMORY_PIECES = 300_000
BATCH_CHARS = 1 << 20


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class PieceEncoder:
    """Ids of whole texts from the tokenizers library, each distinct piece encoded once.

    The byte-level pre-tokenizer never joins what stands before a space to the
    space itself when the character before is no white space.  So the ids of a
    text are those of its pieces: the text cut before each such space.  A text
    with white space before a space, where that does not hold, is given to the
    library whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.known: dict[str, bytes] = {}
        vocabulary = self.whole.get_vocab(with_added_tokens=True)
        #: Ids whose text starts with a space ("\u0120" in a byte-level vocabulary): each starts a piece.
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        for token, i in vocabulary.items():
            self.opens[i] = token.startswith("\u0120")

    def _fresh(self, words: list[str]) -> dict[str, bytes]:
        """Ids of pieces that are not known, many pieces to a call; remembered while there is room."""
        coded = self.whole.encode_batch_fast([" " + " ".join(words[i : i + 64]) for i in range(0, len(words), 64)], add_special_tokens=False)
        fresh: dict[str, bytes] = {}
        for i, e in enumerate(coded):
            ids = np.array(e.ids, "<u4")
            raw, cuts = ids.tobytes(), (4 * np.flatnonzero(self.opens[ids])).tolist()
            ends = cuts[1:]
            ends.append(len(raw))
            fresh.update(zip(words[64 * i : 64 * i + 64], map(raw.__getitem__, map(slice, cuts, ends)), strict=True))
        if len(self.known) < MEMORY_PIECES:
            self.known.update(fresh)
        return fresh

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        words = " ".join(texts).split(" ")
        sizes = [t.count(" ") + 1 for t in texts]
        ids = list(map(self.known.get, words))
        unknown = list(compress(range(len(words)), map(is_, ids, repeat(None))))
        missing = {words[i] for i in unknown}
        bad = {w for w in missing if not w or w[-1].isspace()}
        fresh = self._fresh(list(missing - bad))
        cannot = set()
        for i in unknown:
            if words[i] in bad:
                cannot.add(i)
            else:
                ids[i] = fresh[words[i]]
        ends = list(accumulate(sizes))
        whole = {bisect_right(ends, i) for i in cannot} if cannot else set()
        single = [t if n == 1 or k in whole else words[e - n] for k, (t, n, e) in enumerate(zip(texts, sizes, ends))]
        heads = [np.array(e.ids, "<u4").tobytes() for e in self.whole.encode_batch_fast(single, add_special_tokens=False)]
        return [h if n == 1 or k in whole else h + b"".join(ids[e - n + 1 : e]) for k, (h, n, e) in enumerate(zip(heads, sizes, ends))]


#: One encoder for all tasks of a Python worker.
_ENCODERS: dict[str, PieceEncoder] = {}


def encoder_for(path: str) -> PieceEncoder:
    if path not in _ENCODERS:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def _text_batches(batches: Iterator[pa.RecordBatch], limit: int = BATCH_CHARS):
    """(doc ids, null flags, texts) in pieces of about ``limit`` characters."""
    for batch in batches:
        ids, texts = batch.column(0), batch.column(1).to_pylist()
        nulls = np.asarray(ids.is_null())
        numbers = np.asarray(ids.fill_null(0))
        start = size = 0
        for k, t in enumerate(texts):
            size += len(t or "")
            if size >= limit or k + 1 == len(texts):
                yield numbers[start : k + 1], nulls[start : k + 1], [x or "" for x in texts[start : k + 1]]
                start, size = k + 1, 0


def write_tokens(docs: DataFrame, folder: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Encodes every whole text into files below ``folder``; returns their manifest.

    Manifest: part, file, n_docs, n_tokens, base (ids in all files before).
    Order: ascending doc_id, null first, ties by a hash of the text, then by
    place in the input, so that neither one id nor equal rows have to share a file.
    A null text is an empty one: its document holds the end id alone.  An empty
    table gives an empty manifest.
    """
    path = path or tokenizer_path()
    spark = docs.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    ranged = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("row"))
    ranged = ranged.repartitionByRange(parts, "doc_id", "tie", "row").sortWithinPartitions("doc_id", "tie", "row")

    def task(batches):
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        writer = encoder = None
        for numbers, nulls, texts in _text_batches(batches):
            if writer is None:
                system, draft, final = commit_file(folder, f"tokens-{part:06d}", ".s8b")
                sink = system.open_output_stream(draft)
                writer, encoder = simple8b.Writer(sink), encoder_for(path)
            end = np.array([end_id], "<u4").tobytes()
            coded = [x + end for x in encoder.encode(texts)]
            writer.add(numbers, nulls, np.array([len(x) // 4 for x in coded], np.int64), np.frombuffer(b"".join(coded), "<u4"))
        if writer is not None:
            n_docs, n_tokens = writer.close()
            sink.close()
            system.move(draft, final)
            yield pa.RecordBatch.from_pylist([{"part": part, "file": final, "n_docs": n_docs, "n_tokens": n_tokens}])

    made = written(ranged.mapInArrow(task, "part long, file string, n_docs long, n_tokens long"), "token-manifest")
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per file
    return written(made.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), "token-files")


def read_tokens(manifest: DataFrame, folder: str) -> DataFrame:
    """Digest of every document, from the files that the manifest names."""
    files = manifest.repartition(max(1, min(manifest.count(), 10_000)), "part")

    def task(batches):
        for batch in batches:
            for file, base in zip(batch.column("file").to_pylist(), batch.column("base").to_pylist()):
                system = filesystem(folder)[0]
                with system.open_input_file(file) as source:
                    reader = simple8b.Reader(source, source.size())
                    ends = np.cumsum(reader.counts)
                    crcs, doc, crc = np.zeros(reader.n_docs, np.int64), 0, 0
                    for place, ids in reader.batches():
                        raw = memoryview(ids.astype("<u4").tobytes())
                        done = place + len(ids)
                        while doc < reader.n_docs:
                            lo, hi = max(place, int(ends[doc] - reader.counts[doc])), min(done, int(ends[doc]))
                            crc = zlib.crc32(raw[4 * (lo - place) : 4 * (hi - place)], crc)
                            if ends[doc] > done:
                                break
                            crcs[doc], crc, doc = crc, 0, doc + 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(reader.doc_ids, mask=reader.nulls), pa.array(ends - reader.counts + base), pa.array(reader.counts), pa.array(crcs)],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )

    return files.mapInArrow(task, "doc_id long, start long, n_tokens long, ids_crc32 long")


def encode_documents(docs: DataFrame, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Writes the token files of ``docs`` and returns what is read back from them."""
    folder = new_folder(docs.sparkSession, "tokens")
    return read_tokens(write_tokens(docs, folder, path, end_id), folder)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
