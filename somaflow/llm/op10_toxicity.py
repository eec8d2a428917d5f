"""Toxicity: subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its character n-grams (of
UTF-8 bytes, with marks at both ends), hashed into buckets; so an unseen
misspelling shares most of its vectors with the word that it hides.  Words are
averaged over windows of a few words, the softmax is applied to each window, and
a document is as toxic as its worst window: a few words in a long text count as
much as in a short one.  Embeddings and softmax are trained together, first on
all windows and then on each document's worst ones.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.textbytes import ALNUM, Words, chunks, mix

BUCKETS = 1 << 16
WIDTH = 8
GRAMS = (3, 4, 5)
WINDOW = 12
THRESHOLD = 0.7
#: Buckets of fewer training documents are not used.
LEAST_DOCUMENTS = 4
RATE, DECAY, EPSILON, SCALE = 0.05, 0.02, 1e-3, 40
#: Windows of a document that a round of training looks at.
ROUND_WINDOWS = 6
#: The sample that the model is fitted on: at most so many rows of each class, and so many bytes of text.
CLASS_ROWS = 2000
SAMPLE_BYTES = 12 << 20
HELD_OUT = 1
_STEP = np.uint64(0x100000001B3)


def subwords(words: Words, which: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, first bucket of each word and the end) of the words numbered ``which``."""
    starts, size = words.starts[which], words.ends[which] - words.starts[which]
    # "<word>" of all words in one buffer
    full = size + 2
    at = np.cumsum(full) - full
    data = np.full(int(full.sum()), 62, np.uint8)
    data[at] = 60
    inner = np.repeat(starts - (np.cumsum(size) - size), size) + np.arange(size.sum())
    data[np.repeat(at + 1 - (np.cumsum(size) - size), size) + np.arange(size.sum())] = words.data[inner]
    left = np.repeat(at + full, full) - np.arange(len(data))
    owner = np.repeat(np.arange(len(which)), full)
    keys, owners = [], []
    value = data.astype(np.uint64) + np.uint64(1)
    rolled = np.zeros(len(data), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        rolled[: len(data) - n + 1] = rolled[: len(data) - n + 1] * _STEP + value[n - 1 :]
        if n in GRAMS:
            inside = np.flatnonzero(left >= n)
            keys.append(rolled[inside] * _STEP + np.uint64(n))
            owners.append(owner[inside])
    keys.append(hashes[which])
    owners.append(np.arange(len(which)))
    owner = np.concatenate(owners)
    order = np.argsort(owner, kind="stable")
    bucket = (mix(np.concatenate(keys))[order] >> np.uint64(48)).astype(np.int64)
    return bucket, np.searchsorted(owner[order], np.arange(len(which) + 1))


def _distinct_subwords(texts: list[bytes], part: int = 1 << 19) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(number of each word, first word of each text and the end, buckets of the distinct words, first bucket of each and the end).

    Texts are looked at about ``part`` bytes at a time.
    """
    hashes, counts, known, sizes, buckets = [], [], np.zeros(0, np.uint64), [], []
    at = 0
    while at < len(texts):
        stop, held = at + 1, len(texts[at])
        while stop < len(texts) and held < part:
            held += len(texts[stop])
            stop += 1
        words = Words(texts[at:stop], ALNUM)
        hashes.append(words.hashes())
        counts.append(np.diff(words.first))
        kinds, example = np.unique(hashes[-1], return_index=True)
        new = ~np.isin(kinds, known)
        bucket, first = subwords(words, example[new], hashes[-1])
        known = np.concatenate((known, kinds[new]))
        sizes.append(np.diff(first))
        buckets.append(bucket.astype(np.int32))
        at = stop
    number = np.zeros(0, np.int32)
    if len(known):
        order = np.argsort(known)
        number = order[np.searchsorted(known, np.concatenate(hashes), sorter=order)].astype(np.int32)
    join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
    return number, np.concatenate(([0], np.cumsum(join(counts)))), join(buckets).astype(np.int32), np.concatenate(([0], np.cumsum(join(sizes))))


class Model:
    """What scoring needs: a number for each bucket, and the calibration of the worst window's logit."""

    def __init__(self, weight: np.ndarray, bias: float, slope: float = 1.0, offset: float = 0.0):
        self.weight, self.bias, self.slope, self.offset = weight.astype(np.float32), bias, slope, offset

    def worst(self, texts: list[bytes]) -> np.ndarray:
        """Logit of each text's worst window of WINDOW words (shorter texts: padded with nothing)."""
        kind, at, bucket, first = _distinct_subwords(texts, 1 << 23)
        count = np.diff(at)
        out = np.full(len(texts), self.bias)
        if not len(kind):
            return out
        mean = np.add.reduceat(self.weight[bucket], first[:-1], dtype=np.float64) / np.diff(first)
        sums = np.concatenate(([0.0], np.cumsum(mean[kind])))
        # windows start at each word and end within the text; a text shorter than a window is one
        last = np.repeat(at[1:], count)
        start = np.arange(len(last))
        start = np.maximum(np.minimum(start, last - WINDOW), np.repeat(at[:-1], count))
        logit = (sums[np.minimum(start + WINDOW, last)] - sums[start]) / WINDOW
        some = np.flatnonzero(count)
        out[some] += np.maximum.reduceat(logit, at[:-1][some])
        return out

    def score(self, texts: list[bytes]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.worst(texts) + self.offset, -500, 500)))


def _platt(logit: np.ndarray, label: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and offset of a weighted logistic fit, by Newton steps with a small ridge."""
    scale = logit.std() + 1e-9
    x = np.stack((logit / scale, np.ones(len(logit))), axis=1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        g = x.T @ (weight * (p - label)) + 1e-2 * w
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-2 * np.eye(2)
        w -= np.clip(np.linalg.solve(h, g), -2, 2)
    return max(float(w[0] / scale), 0.0), float(w[1])


class _Bags:
    """Some windows of words, laid out for forward and backward sums over the vectors of their subwords."""

    def __init__(self, kind: np.ndarray, window_first: np.ndarray, bucket: np.ndarray, first: np.ndarray):
        self.windows = window_first
        kinds, self.kind = np.unique(kind, return_inverse=True)
        sizes = np.diff(first)[kinds]
        self.first = np.cumsum(sizes) - sizes
        if len(kinds) + 1 == len(first):  # all words, so the layout is as it was
            self.bucket = bucket
        else:
            self.bucket = bucket[np.repeat(first[kinds] - self.first, sizes) + np.arange(sizes.sum())]
        self.per_word = sizes.astype(np.float32)
        by_bucket = np.argsort(self.bucket, kind="stable").astype(np.int32)
        sorted_buckets = self.bucket[by_bucket]
        self.bucket_first = np.flatnonzero(np.diff(sorted_buckets, prepend=-1))
        self.used = sorted_buckets[self.bucket_first]
        self.owner = np.repeat(np.arange(len(kinds), dtype=np.int32), sizes)[by_bucket]
        self.by_word = np.argsort(self.kind, kind="stable").astype(np.int32)
        self.word_first = np.searchsorted(self.kind[self.by_word], np.arange(len(kinds)))
        self.window = np.repeat(np.arange(len(window_first), dtype=np.int32), np.diff(np.append(window_first, len(kind))))

    def means(self, table: np.ndarray) -> np.ndarray:
        """Mean vector of each window; windows that are not full are padded with nothing."""
        vector = np.empty((len(self.first), WIDTH), np.float32)
        for a in range(0, len(self.first), 1 << 14):
            first = self.first[a : a + (1 << 14)]
            stop = self.first[a + (1 << 14)] if a + (1 << 14) < len(self.first) else len(self.bucket)
            vector[a : a + len(first)] = np.add.reduceat(table[self.bucket[first[0] : stop]], first - first[0], axis=0)
        vector /= self.per_word[:, None]
        return np.add.reduceat(vector[self.kind], self.windows, axis=0) / np.float32(WINDOW)

    def pull(self, error: np.ndarray) -> np.ndarray:
        """What each bucket's vector is pulled by, given the windows' errors."""
        per_kind = np.add.reduceat((error / np.float32(WINDOW))[self.window][self.by_word], self.word_first) / self.per_word
        out = np.zeros(BUCKETS, np.float32)
        out[self.used] = np.add.reduceat(per_kind[self.owner], self.bucket_first)
        return out


def train(texts: list[bytes], labels: np.ndarray, share: float | None = None, seed: int = 7, all_steps: int = 10, rounds: int = 10, round_steps: int = 30) -> Model:
    """Fits the model; one class or no rows give a model that says the labels' share for every text.

    Three quarters of the rows train embeddings and softmax: some steps over all
    windows, then rounds over each document's worst windows as the model then
    sees them.  The other rows calibrate, weighted so that ``share`` of them
    (default: as many as are) have label 1.
    """
    labels = np.asarray(labels, np.float64)
    if len(set(labels.tolist())) < 2:
        mean = np.clip(labels.mean() if len(labels) else 0.0, 0.01, 0.99)
        return Model(np.zeros(BUCKETS), float(np.log(mean / (1 - mean))))
    rng = np.random.default_rng(seed)
    fold = np.arange(len(texts)) % 4 == 3
    kept = [t for t, f in zip(texts, fold) if not f]
    y = labels[~fold]
    kind, text_first, bucket, first = _distinct_subwords(kept)
    doc = np.repeat(np.arange(len(kept), dtype=np.int32), np.diff(text_first))
    # buckets of few documents would only be learned by heart
    documents, per_word = np.zeros(BUCKETS, np.int32), np.diff(first)
    for a, b in zip(text_first[:-1], text_first[1:]):
        mine = np.unique(kind[a:b])
        sizes = per_word[mine]
        seen = np.repeat(first[mine] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        documents[np.unique(bucket[seen])] += 1
    common = (documents >= LEAST_DOCUMENTS).astype(np.float32)[:, None]
    # windows that follow one another inside each document
    opens = np.flatnonzero((np.arange(len(doc)) - text_first[doc]) % WINDOW == 0)
    size = np.diff(np.append(opens, len(doc)))
    window_doc = doc[opens]
    windows_of = np.bincount(window_doc, minlength=len(kept))
    even = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))

    table = (rng.standard_normal((BUCKETS, WIDTH)) * 0.02).astype(np.float32) * common
    out = rng.standard_normal(WIDTH).astype(np.float32)
    bias, moments, time = np.zeros(1, np.float32), {}, 0

    def adam(name, value, grad, rate):
        m, v = moments.setdefault(name, (np.zeros_like(value), np.zeros_like(value)))
        m += 0.1 * (grad - m)
        v += 0.01 * (grad * grad - v)
        value -= rate * (m / (1 - 0.9**time)) / (np.sqrt(v / (1 - 0.99**time)) + EPSILON)

    def step(bags, of, worst):
        nonlocal table, time
        time += 1
        mean = bags.means(table)
        logit = mean @ out * SCALE + bias[0]
        weight = even[of] / windows_of[of]
        if worst:  # the worst window of each document carries its weight, a clean document's others a little
            here, begin = np.unique(of, return_index=True)
            top = np.maximum.reduceat(logit, begin)
            best = logit >= np.repeat(top, np.diff(np.append(begin, len(of))))
            weight = np.where(best, even[of], 0.02 * weight * (y[of] == 0))
        error = ((1 / (1 + np.exp(-np.clip(logit, -30, 30))) - y[of]) * weight).astype(np.float32)
        pulled = bags.pull(error * np.float32(SCALE))
        table *= 1 - DECAY
        grad = error @ mean * np.float32(SCALE)
        adam("table", table, pulled[:, None] * out * common, RATE)
        adam("out", out, grad, 0.4 * RATE)
        adam("bias", bias, np.array([error.sum()], np.float32), 2 * RATE)

    every = _Bags(kind, opens, bucket, first)
    for _ in range(all_steps):
        step(every, window_doc, False)
    for _ in range(rounds):
        logit = every.means(table) @ out
        order = np.lexsort((-logit, window_doc))
        place = np.arange(len(order)) - np.searchsorted(window_doc[order], window_doc[order])
        chosen = np.sort(order[place < ROUND_WINDOWS])
        at = np.cumsum(size[chosen]) - size[chosen]
        some = _Bags(kind[np.repeat(opens[chosen] - at, size[chosen]) + np.arange(size[chosen].sum())], at, bucket, first)
        for _ in range(round_steps):
            step(some, window_doc[chosen], True)
    model = Model(table @ out * SCALE, float(bias[0]))
    rest = [x for x, f in zip(texts, fold) if f]
    own = min(max(labels[fold].mean(), 1e-3), 1 - 1e-3)
    share = own if share is None else share
    weight = np.where(labels[fold] > 0, share / own, (1 - share) / (1 - own))
    model.slope, model.offset = _platt(model.worst(rest), labels[fold], weight)
    return model


def _text_id(column):
    return F.coalesce(column.cast("string"), F.lit(""))


def is_held_out():
    """True where labels must not be learned from."""
    return F.pmod(F.crc32(_text_id(F.col("doc_id"))), F.lit(3)) == HELD_OUT


def fitting(rows: Iterable[tuple[bytes, int]], most: int) -> tuple[list[bytes], list[int]]:
    """The texts, and their labels, that fit in ``most`` bytes, in their order.

    Half of the bytes are for each class; what the classes leave goes to the texts that found
    no room, the shortest first.  A text that doesn't fit leaves itself out alone.
    """
    taken, later, used, held = [], [], [0, 0], 0
    for i, (text, mark) in enumerate(rows):
        if used[mark] + len(text) <= most // 2:
            used[mark] += len(text)
            taken.append((i, text, mark))
            continue
        heapq.heappush(later, (-len(text), -i, text, mark))
        held += len(text)
        while held > most:  # the longest can't find room any more
            held -= len(heapq.heappop(later)[2])
    room = most - sum(used)
    for size, i, text, mark in sorted(later, reverse=True):
        if -size <= room:
            room += size
            taken.append((-i, text, mark))
    taken.sort(key=lambda row: row[0])
    return [text for _, text, _ in taken], [mark for _, _, mark in taken]


def fit(docs: DataFrame, labels: DataFrame, class_rows: int = CLASS_ROWS, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """A model fitted on a bounded sample: of each class the ``class_rows`` labelled ids that
    hash lowest, those whose whole texts fit in ``sample_bytes`` (see ``fitting``); held-out ids never.
    Of the rows of one id, the text with the smallest digest is used."""
    marks = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out()).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
    order = [F.md5(_text_id(F.col("doc_id"))), F.col("doc_id")]
    chosen = [marks.where(F.col("toxic") == c).orderBy(*order).limit(class_rows) for c in (0, 1)]
    chosen = chosen[0].unionByName(chosen[1]).select(F.col("doc_id").alias("_d"), F.col("toxic").cast("int").alias("toxic"))
    # calibrated half-way, in odds, between the labels' share and even classes: a miss costs more than a false alarm
    share = min(max(marks.agg(F.avg("toxic")).first()[0] or 0.0, 1e-4), 1 - 1e-4)
    share = share**0.5 / (share**0.5 + (1 - share) ** 0.5)

    def task(batches):
        rows = ((text or "", mark) for batch in batches for text, mark in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()))
        texts, marked = fitting(((text.encode(), mark) for text, mark in rows), sample_bytes)
        m = train(texts, np.array(marked, float), share)
        yield pa.RecordBatch.from_pylist([{"weight": m.weight.astype("<f4").tobytes(), "bias": m.bias, "slope": m.slope, "off": m.offset}])

    # rows of one id count once, by the smallest digest of a text: one task trains on at most 2 class_rows rows, away from the driver
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    met = docs.select("doc_id", text.alias("text")).join(F.broadcast(chosen), F.col("doc_id") == F.col("_d"))
    each = met.groupBy("_d").agg(F.min(F.struct(F.md5("text").alias("digest"), "text")).alias("row"), F.max("toxic").alias("toxic"))
    sample = each.select(F.col("_d").alias("doc_id"), F.col("row.text").alias("text"), "toxic").repartition(1).sortWithinPartitions(*order)
    row = sample.select(F.col("text").cast("string").alias("text"), "toxic").mapInArrow(task, "weight binary, bias double, slope double, off double").first()
    if row is None:
        return train([], np.zeros(0))
    return Model(np.frombuffer(row.weight, "<f4"), row.bias, row.slope, row.off)


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every whole text; nothing but the text enters the score.

    Defined results: a null or wordless text gets the score of the bias alone;
    a null id counts as the empty text for held_out.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS numbers

    def task(batches):
        for batch in batches:
            for a, b, texts in chunks(batch, "text"):
                part = batch.slice(a, b - a)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(shared.value.score(texts))], ["doc_id", "held_out", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), is_held_out().alias("held_out"))
    found = rows.mapInArrow(task, "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def clean_documents(docs: DataFrame, model: Model) -> DataFrame:
    """``docs`` without those that the model rejects, columns and clean rows untouched."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def task(batches):
        for batch in batches:
            for a, b, texts in chunks(batch, "text"):
                yield batch.slice(a, b - a).filter(pa.array(shared.value.score(texts) < THRESHOLD))

    return docs.mapInArrow(task, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return scored(docs, fit(docs, labels))
