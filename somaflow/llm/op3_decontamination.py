"""Benchmark decontamination by suffix arrays over the training documents.

Every task builds suffix arrays over its own shard of the documents' words, and
binary-searches every suffix of the benchmark's items in them, all at once.  The
suffix's neighbours in the array hold its longest verbatim match, of any length,
and where it stands; the windows that a match is long enough for are then
located everywhere in the shard.  Nothing is shuffled, and a document's result
depends on its own words alone.

The benchmark is cut into blocks of bounded size, which are built once and
stored in the shared folder, so that neither side has to fit anywhere as a
whole.  Only words that a block has can match it, so the suffix array holds the
runs of such words that are long enough; all other suffixes would sort apart
from every test suffix.
"""

from __future__ import annotations

import hashlib
import pickle
from collections import OrderedDict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.shared import commit_file, filesystem, new_folder, written
from somaflow.llm.textbytes import ALNUM, CHUNK, Vocabulary, Words, chunks

WINDOW = 13
#: Bytes of benchmark text to a block, blocks that a worker keeps, and bytes of documents to a shard where there are more.
BLOCK_BYTES = 8 << 20
BLOCKS_KEPT = 2
LONG_CHUNK = 8 << 20
SHARE = 20
COLUMNS = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
#: Words that are compared at once, and suffixes that are searched at once.
SLAB = 16
AT_ONCE = 1 << 16
_STEPS = np.arange(SLAB)


class Block:
    """The suffixes and windows of some benchmark items, over a vocabulary of their own."""

    def __init__(self, ids: list[str], texts: list[bytes], window: int = WINDOW):
        found = Words(texts, ALNUM)
        self.vocabulary = Vocabulary(found)
        self.items = np.array(ids, object)
        words, owner = self.vocabulary.find(found), found.text_of()
        n = len(words)
        count = np.diff(found.first)
        self.words = np.concatenate((words, np.full(SLAB, -1)))
        # every suffix: its first word, the words to its item's end, its item and its place there
        self.starts, self.owner = np.arange(n), owner
        self.places = self.starts - found.first[owner]
        self.lengths = count[owner] - self.places
        # a window begins where enough words follow, or at the start of an item that is shorter
        size = np.minimum(count, window)[owner]
        begins = np.flatnonzero((self.lengths >= size) & ((size == window) | (self.places == 0)))
        self.kind = np.full(n, -1)
        name = self.words[:n].copy()
        if len(begins):
            whole, reach, names = np.minimum(window, self.lengths), np.ones(n, np.int64), name
            while (reach < whole).any():  # names of the first ``reach`` words, doubled, until they name whole windows
                step = np.minimum(reach, whole - reach)
                ahead = np.where(step > 0, names[np.minimum(self.starts + step, n - 1)] + 1, 0)
                names = np.unique(np.stack((names, ahead, reach + step)), axis=1, return_inverse=True)[1].reshape(-1)
                reach = reach + step
            _, self.kind[begins] = np.unique(np.stack((names[begins], size[begins])), axis=1, return_inverse=True)
        self.n_kinds = int(self.kind.max()) + 1 if n else 0
        self.model = np.zeros(self.n_kinds, np.int64)
        self.model[self.kind[begins]] = begins
        self.sizes = size[self.model] if n else np.zeros(0, np.int64)
        self.shortest = int(self.sizes.min()) if self.n_kinds else 0
        # items of each window, each once
        pairs = np.unique(np.stack((self.kind[begins], owner[begins]), axis=1), axis=0)
        self.kind_first = np.searchsorted(pairs[:, 0], np.arange(self.n_kinds + 1))
        self.kind_items = pairs[:, 1]


class SuffixArray:
    """All suffixes of a sequence of words (-1: a break, which no match crosses), in order.

    Sorted by prefix doubling; only suffixes that are still equal to another
    one are sorted again.
    """

    def __init__(self, text: np.ndarray):
        n = len(text)
        breaks = np.flatnonzero(text < 0)
        text = text.copy()
        text[breaks] = -2 - np.arange(len(breaks))  # no two are equal
        self.text = np.concatenate((text, np.full(SLAB, -1)))
        index = np.arange(n)
        order = np.argsort(text, kind="stable")
        opens = np.append(True, text[order][1:] != text[order][:-1])[:n]
        rank = np.empty(n, np.int64)
        rank[order] = np.maximum.accumulate(np.where(opens, index, 0))
        live, reach = order[~(opens & np.append(opens[1:], True)[:n])], 1
        while len(live):
            ahead = np.where(live + reach < n, rank[np.minimum(live + reach, n - 1)] + 1, 0)  # 0: past the end, before all ranks
            key = rank[live] * (n + 1) + ahead
            by = np.argsort(key, kind="stable")
            live, key = live[by], key[by]
            opens, at = np.append(True, key[1:] != key[:-1]), np.arange(len(live))
            group = rank[live]
            first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), at, 0))
            rank[live] = group + np.maximum.accumulate(np.where(opens, at, 0)) - first
            live = live[~(opens & np.append(opens[1:], True))]
            reach *= 2
        self.order = np.empty(n, np.int64)
        self.order[rank] = index

    def _insert(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray, after: bool = False):
        """Where each pattern would stand, before or after suffixes that begin with it, and the words it shares with the ones on both sides."""
        low, high = np.zeros(len(starts), np.int64), np.full(len(starts), len(self.order))
        left, right = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        while len(live := np.flatnonzero(low < high)):
            mid = (low[live] + high[live]) // 2
            at, same = self.order[mid], np.minimum(left[live], right[live])
            less, going = np.zeros(len(live), bool), np.arange(len(live))
            while len(going):
                rows, j = live[going], same[going]
                ours, theirs = words[(starts[rows] + j)[:, None] + _STEPS], self.text[(at[going] + j)[:, None] + _STEPS]
                differs = ours != theirs
                rest = lengths[rows] - j
                first = np.minimum(np.where(differs.any(axis=1), differs.argmax(axis=1), SLAB), rest)
                same[going] += first
                ends, k = first == rest, np.minimum(first, SLAB - 1)
                row = np.arange(len(going))
                less[going] = np.where(ends, after, theirs[row, k] < ours[row, k])
                going = going[(first == SLAB) & ~ends]
            up, down = live[less], live[~less]
            low[up], left[up] = mid[less] + 1, same[less]
            high[down], right[down] = mid[~less], same[~less]
        return low, left, right

    def longest(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(words, place) of the longest prefix of each pattern that occurs; place -1 for none.

        A pattern is ``lengths`` words of ``words`` (which end in SLAB more) from ``starts`` on.
        """
        size, place = np.zeros(len(starts), np.int64), np.full(len(starts), -1)
        for a in range(0, len(starts), AT_ONCE):
            b = slice(a, a + AT_ONCE)
            low, left, right = self._insert(words, starts[b], lengths[b])
            size[b] = np.maximum(left, right)
            some = np.flatnonzero(size[b])
            place[a + some] = self.order[np.where(left >= right, low - 1, low)[some]]
        return size, place

    def bounds(self, words: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """[low, high) in ``order`` of the suffixes that begin with each pattern."""
        parts = [[self._insert(words, starts[a : a + AT_ONCE], lengths[a : a + AT_ONCE], after)[0] for a in range(0, max(1, len(starts)), AT_ONCE)] for after in (False, True)]
        return np.concatenate(parts[0]), np.concatenate(parts[1])


def _runs(ids: np.ndarray, owner: np.ndarray, least: int) -> np.ndarray:
    """Places of the words in runs of known words, within one text, of at least ``least``."""
    n = len(ids)
    known = ids >= 0
    opens = known.copy()
    opens[1:] &= ~(known[:-1] & (owner[1:] == owner[:-1]))
    starts = np.flatnonzero(opens)
    closes = known.copy()
    closes[:-1] &= ~(known[1:] & (owner[1:] == owner[:-1]))
    ends = np.flatnonzero(closes) + 1
    long = ends - starts >= least
    mark = np.zeros(n + 1, np.int64)
    np.add.at(mark, starts[long], 1)
    np.add.at(mark, ends[long], -1)
    return np.flatnonzero(np.cumsum(mark[:-1]))


def _shard(ids: np.ndarray, owner: np.ndarray, least: int) -> tuple[SuffixArray, np.ndarray]:
    """Suffix array over the runs, parted by breaks, and the word of each of its places (-1: break)."""
    places = _runs(ids, owner, least)
    apart = np.flatnonzero((np.diff(places) > 1) | (np.diff(owner[places]) > 0)) + 1 if len(places) else places
    where = np.insert(places, apart, -1)
    return SuffixArray(np.where(where < 0, -1, ids[where]) if len(where) else where), where


def _hits(block: Block, array: SuffixArray, where: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(window, word that it begins at) of all occurrences: those of the windows that a suffix's longest match reaches."""
    size, _ = array.longest(block.words, block.starts, block.lengths)
    reached = np.flatnonzero((block.kind >= 0) & (size >= block.sizes[block.kind])) if block.n_kinds else size
    found = np.unique(block.kind[reached])
    low, high = array.bounds(block.words, block.model[found], block.sizes[found])
    times = high - low
    at = array.order[np.repeat(low, times) + np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)]
    return np.repeat(found, times), where[at]


def scan(texts: list[bytes], blocks) -> dict[str, list]:
    """The result columns for one chunk of documents."""
    words = Words(texts, ALNUM)
    owner = words.text_of()
    count = np.diff(words.first)
    hit = np.zeros(len(owner) + 1, bool)
    items: dict[int, set[str]] = {}
    for block in blocks:
        if not block.shortest or not len(owner):
            continue
        array, where = _shard(block.vocabulary.find(words), owner, block.shortest)
        window, first = _hits(block, array, where)
        if not len(window):
            continue
        mark = np.zeros(len(owner) + 1, np.int64)
        np.add.at(mark, first, 1)
        np.add.at(mark, first + block.sizes[window], -1)
        hit |= np.cumsum(mark) > 0
        pairs = np.unique(np.stack((owner[first], window), axis=1), axis=0)
        for doc, w in pairs.tolist():
            items.setdefault(doc, set()).update(block.items[block.kind_items[block.kind_first[w] : block.kind_first[w + 1]]])
    n_hit = np.add.reduceat(np.append(hit[:-1], False), np.minimum(words.first[:-1], len(owner)), dtype=np.int64) if len(texts) else count
    n_hit = np.where(count > 0, n_hit, 0)
    digest = lambda names: hashlib.sha256(",".join(sorted(names)).encode()).hexdigest()
    return {
        "n_words": count.tolist(), "n_hit": n_hit.tolist(), "n_items": [len(items.get(d, ())) for d in range(len(texts))],
        "items_sha256": [digest(items.get(d, ())) for d in range(len(texts))], "contaminated": ((n_hit > 0) & (SHARE * n_hit >= count)).tolist(),
    }


class Blocks:
    """The stored blocks of a benchmark; a worker keeps some of them."""

    kept: OrderedDict = OrderedDict()

    def __init__(self, folder: str, files: list[str]):
        self.folder, self.files = folder, files
        self.chunk = CHUNK if len(files) <= BLOCKS_KEPT else LONG_CHUNK

    def __iter__(self):
        for file in self.files:
            if file not in Blocks.kept:
                with filesystem(self.folder)[0].open_input_stream(file) as source:
                    block = pickle.loads(source.read())
                while len(Blocks.kept) >= BLOCKS_KEPT:
                    Blocks.kept.popitem(last=False)
                Blocks.kept[file] = block
            yield Blocks.kept[file]


def prepare(benchmark: DataFrame, block_bytes: int | None = None) -> Blocks:
    """Builds blocks of about ``block_bytes`` of the items' text, in tasks, and stores them in the shared folder."""
    spark = benchmark.sparkSession
    folder = new_folder(spark, "benchmark")
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]

    def build(batches):
        limit = block_bytes or BLOCK_BYTES

        def store(ids, texts):
            system, draft, final = commit_file(folder, "block", ".pickle")
            with system.open_output_stream(draft) as sink:
                sink.write(pickle.dumps(Block(ids, texts), protocol=5))
            system.move(draft, final)
            return pa.RecordBatch.from_pylist([{"file": final}])

        ids: list[str] = []
        texts: list[bytes] = []
        for batch in batches:
            for a, b, held in chunks(batch, 1, limit // 4):
                ids += batch.column(0).slice(a, b - a).to_pylist()
                texts += held
                if sum(map(len, texts)) >= limit:
                    yield store(ids, texts)
                    ids, texts = [], []
        if ids:
            yield store(ids, texts)

    dealt = items.repartition(max(1, -(-size // (block_bytes or BLOCK_BYTES))))
    stored = written(dealt.mapInArrow(build, "file string"), "benchmark-blocks")
    return Blocks(folder, sorted(r["file"] for r in stored.collect()))  # one name for each block


def scanned(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with the result columns added; clashing names of ``docs`` are replaced.

    Defined results: a null or wordless text has no words, no hits and is not
    contaminated; items without words have no windows; a null item id counts
    as the empty string, and items with one id count once; an empty benchmark
    flags nothing.
    """
    blocks = prepare(benchmark)
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    docs = docs.drop(*names)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema] + [COLUMNS])

    def task(batches):
        for batch in batches:
            for a, b, texts in chunks(batch, text, blocks.chunk):
                found = scan(texts, blocks)
                part = batch.slice(a, b - a)
                kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns, *(pa.array(found[c], k) for c, k in zip(names, kinds))], [*part.schema.names, *names])

    return docs.mapInArrow(task, schema)


MATCHES = "item_id string, item_word long, n_words long, doc_id long, doc_word long"


def longest_matches(docs: DataFrame, benchmark: DataFrame, least: int = 1) -> DataFrame:
    """Longest verbatim match of every benchmark suffix over all documents, and a place where it stands.

    Returns item_id, item_word, n_words, doc_id, doc_word, for suffixes whose
    match has ``least`` words or more; items with one id
    count as one.  A task keeps the best of its documents, one row for a suffix, and
    the best over the tasks remain; of equally long matches that of the
    smallest doc_id (null last) stays that some shard proposes.
    """
    blocks = prepare(benchmark)

    def task(batches):
        held: list = [None] * len(blocks.files)  # for each block: words, document, word of the best match
        for batch in batches:
            for a, _, texts in chunks(batch, "text", blocks.chunk):
                ids = batch.column("doc_id").slice(a, len(texts)).to_pylist()
                words = Words(texts, ALNUM)
                owner = words.text_of()
                if not len(owner):
                    continue
                names = np.array([np.iinfo(np.int64).max if x is None else x for x in ids])
                for i, block in enumerate(blocks):
                    array, where = _shard(block.vocabulary.find(words), owner, least)
                    size, place = array.longest(block.words, block.starts, block.lengths)
                    at = where[place]  # where there is none, the last one, which isn't used
                    found = np.stack((size, names[owner[at]] if len(at) else size, at - words.first[owner[at]] if len(at) else size))
                    if held[i] is None:
                        held[i] = np.where(size >= least, found, 0)
                    better = (size >= least) & ((size > held[i][0]) | (size == held[i][0]) & (found[1] < held[i][1]))
                    held[i][:, better] = found[:, better]
        for block, best in zip(blocks, held):
            if best is None:
                continue
            k = np.flatnonzero(best[0])
            doc = pa.array([None if x == np.iinfo(np.int64).max else x for x in best[1][k].tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(block.items[block.owner[k]].tolist(), pa.string()), pa.array(block.places[k]), pa.array(best[0][k]), doc, pa.array(best[2][k])],
                ["item_id", "item_word", "n_words", "doc_id", "doc_word"],
            )

    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(task, MATCHES)
    best = F.min(F.struct((-F.col("n_words")).alias("n"), F.col("doc_id").isNull().alias("no_id"), "doc_id", "doc_word")).alias("b")
    return found.groupBy("item_id", "item_word").agg(best).select("item_id", "item_word", (-F.col("b.n")).alias("n_words"), "b.doc_id", "b.doc_word")


def clean_documents(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the contaminated ones, columns and clean rows untouched."""
    blocks = prepare(benchmark)

    def task(batches):
        for batch in batches:
            for a, b, texts in chunks(batch, "text", blocks.chunk):
                bad = scan(texts, blocks)["contaminated"]
                yield batch.slice(a, b - a).filter(pa.array([not x for x in bad], pa.bool_()))

    return docs.mapInArrow(task, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scanned(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("text")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
ORACLE = rf"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM documents),
b AS (
  SELECT item_id::VARCHAR AS item, coalesce(regexp_extract_all(translate(text, '{_UPPER}', '{_LOWER}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), []) AS w FROM benchmark),
win AS (
  SELECT DISTINCT item, least(len(w), {WINDOW}) AS n, array_to_string(w[k:k + least(len(w), {WINDOW}) - 1], ' ') AS s
  FROM b, unnest(range(1, greatest(len(w) - {WINDOW} + 2, 2))) AS u(k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT r, k, n, array_to_string(w[k:k + n - 1], ' ') AS s
  FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS u(k) WHERE len(w) >= n),
m AS (SELECT r, k, grams.n, item FROM grams JOIN win ON grams.n = win.n AND grams.s = win.s),
hits AS (SELECT r, count(DISTINCT k + j) AS n_hit FROM (SELECT DISTINCT r, k, n FROM m), unnest(range(0, n)) AS u(j) GROUP BY r),
its AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS names FROM m GROUP BY r)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND {SHARE} * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN hits ON d.r = hits.r LEFT JOIN its ON d.r = its.r
"""
