"""License scans by a positional rare-token index.

Licence texts and key phrases are templates in one index: word -> places in
each template.  IDF is counted over all documents.  A file's licence words are
weighed by it: a template of which the file can't hold enough weight is left
alone, and for each other one the file's own words of highest IDF are looked up.
Their places in the file and in the template give alignments (place in the file
minus place in the template); alignments that enough of the words agree on are
verified word by word, and near ones together, as names may stand between.  A
template counts only where its mandatory key phrases stand in the same file.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from somaflow.llm.licence_texts import TEXTS
from somaflow.llm.textbytes import ALNUM, Vocabulary, Words, chunks

#: Base phrases and their labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}
#: Rare words of a file that look a template up, and of them those that must agree on an alignment.
RARE = 8
AGREE = 2
#: Weighted share of a template's words that must fit, and words by which alignments of one copy may differ.
FIT = 0.7
SLACK = 12
#: Words of alignments that are verified at once.
AT_ONCE = 1 << 20


class Index:
    """Templates and phrases by word and place; ``df`` maps words to documents that hold them, of ``n``."""

    def __init__(self, df: dict[str, int] | None = None, n: int = 0):
        df = df or {}
        phrases = list(dict.fromkeys([*BASE, *(p for _, _, keys in TEXTS for p in keys)]))
        found = Words([t.encode() for t in [*phrases, *(t for _, t, _ in TEXTS)]], ALNUM)
        texts = [[found.word(k).decode() for k in range(a, b)] for a, b in zip(found.first[:-1], found.first[1:])]
        self.n_phrases = len(phrases)
        self.base = {i: BASE[p] for i, p in enumerate(phrases) if p in BASE}
        self.labels = [label for label, _, _ in TEXTS]
        self.needs = [[phrases.index(p) for p in keys] for _, _, keys in TEXTS]
        self.vocabulary = sorted({w for t in texts for w in t})
        words = Words([w.encode() for w in self.vocabulary], ALNUM)
        self.lookup = Vocabulary(words)
        place = {w: int(i) for w, i in zip(self.vocabulary, self.lookup.find(words))}
        self.words = [np.array([place[w] for w in t]) for t in texts]
        self.idf = np.zeros(len(self.vocabulary))
        for w, i in place.items():
            self.idf[i] = math.log((n + 1) / (df.get(w, 0) + 1)) + 1
        # (words, templates): the weight of a word's places; and a template's words from the rarest on
        self.weight = np.zeros((len(self.vocabulary), len(TEXTS)))
        for t, w in enumerate(self.words[self.n_phrases :]):
            np.add.at(self.weight[:, t], w, self.idf[w])
        self.total = self.weight.sum(axis=0)
        self.rarest = [sorted(set(w.tolist()), key=lambda i: (-self.idf[i], i)) for w in self.words]

    def _places(self, order: np.ndarray, first: np.ndarray, word: int, low: int, high: int) -> np.ndarray:
        """Places of a word among those from ``low`` to ``high`` - 1."""
        at = order[first[word] : first[word + 1]]
        return at[np.searchsorted(at, low) : np.searchsorted(at, high)]

    def _phrase(self, t: int, ids: np.ndarray, owner: np.ndarray, order: np.ndarray, first: np.ndarray) -> np.ndarray:
        """All places where a phrase begins, looked up by its rarest word."""
        words, n = self.words[t], len(ids)
        k = int(np.flatnonzero(words == self.rarest[t][0])[0])
        start = self._places(order, first, self.rarest[t][0], 0, n) - k
        start = start[(start >= 0) & (start + len(words) <= n)]
        for j, w in enumerate(words.tolist()):
            start = start[(ids[start + j] == w) & (owner[start + j] == owner[start])]
        return start

    def _fit(self, t: int, low: int, high: int, present: set[int], ids: np.ndarray, order: np.ndarray, first: np.ndarray) -> float:
        """The largest weighted share of a template's words that fits alignments with the file's words from ``low`` to ``high`` - 1."""
        words = self.words[self.n_phrases + t]
        rare = [w for w in self.rarest[self.n_phrases + t] if w in present][:RARE]
        starts = [self._places(order, first, w, low, high)[:, None] - np.flatnonzero(words == w) for w in rare]
        start, votes = np.unique(np.concatenate([np.unique(x) for x in starts]), return_counts=True)  # a word votes once
        start = start[votes >= min(AGREE, len(rare))]
        best, weight = 0.0, self.idf[words] / self.total[t]
        held, last = np.zeros(len(words), bool), None
        step = max(1, AT_ONCE // len(words))
        for a in range(0, len(start), step):
            at = start[a : a + step, None] + np.arange(len(words))
            same = (at >= low) & (at < high) & (ids[np.clip(at, 0, len(ids) - 1)] == words)
            # alignments that follow each other closely are one copy
            part = start[a : a + step]
            opens = np.append(True if last is None else part[0] - last > SLACK, np.diff(part) > SLACK)
            groups = np.flatnonzero(opens)
            if not opens[0]:
                groups = np.append(0, groups)
                same[0] |= held
            whole = np.logical_or.reduceat(same, groups, axis=0)
            best = max(best, float((whole @ weight).max()))
            held, last = whole[-1], part[-1]
        return best

    def scan(self, texts: list[bytes]) -> dict[str, list]:
        """Result columns of some files."""
        found = Words(texts, ALNUM)
        ids, owner = self.lookup.find(found), found.text_of()
        rows, size = len(texts), len(self.vocabulary)
        held = np.flatnonzero(ids >= 0)
        order = held[np.argsort(ids[held], kind="stable")]
        first = np.searchsorted(ids[order], np.arange(size + 1))
        out = {c: [0] * rows for c in ("n_words", "n_base")} | {"first_word": [None] * rows, "last_word": [None] * rows, "score": [0.0] * rows}
        out["n_words"] = np.diff(found.first).tolist()
        base_labels, labels = [set() for _ in texts], [set() for _ in texts]
        holds: list[set[int]] = []
        for t in range(self.n_phrases):
            place = self._phrase(t, ids, owner, order, first)
            file = owner[place]
            holds.append(set(file.tolist()))
            if t in self.base:
                for d, p in zip(file.tolist(), (place - found.first[file]).tolist()):
                    out["n_base"][d] += 1
                    out["first_word"][d] = p if out["first_word"][d] is None else min(p, out["first_word"][d])
                    out["last_word"][d] = p if out["last_word"][d] is None else max(p, out["last_word"][d])
                    base_labels[d].add(self.base[t])
                    out["score"][d] = 1.0
        needed = [set.intersection(*(holds[p] for p in keys)) for keys in self.needs]
        for d in sorted(set.union(*needed)):
            low, high = int(found.first[d]), int(found.first[d + 1])
            present = np.unique(ids[low:high])
            present = present[present >= 0]
            able = self.weight[present].sum(axis=0) >= FIT * self.total * (1 - 1e-12)
            known = set(present.tolist())
            for t in np.flatnonzero(able).tolist():
                if d in needed[t] and (f := self._fit(t, low, high, known, ids, order, first)) >= FIT:
                    labels[d].add(self.labels[t])
                    out["score"][d] = min(1.0, max(out["score"][d], f))
        out["base_labels"] = [",".join(sorted(x)) for x in base_labels]
        out["labels"] = [",".join(sorted(x | y)) for x, y in zip(base_labels, labels)]
        return out


def document_frequencies(docs: DataFrame) -> tuple[dict[str, int], int]:
    """(documents that hold each licence word, documents), over all whole texts; one number for each word of the index."""
    index = Index()

    def task(batches):
        counts = np.zeros(len(index.vocabulary) + 1, np.int64)
        for batch in batches:
            for _, _, texts in chunks(batch, 0):
                words = Words(texts, ALNUM)
                ids, owner = index.lookup.find(words), words.text_of()
                held = ids >= 0
                pairs = np.unique(owner[held] * len(index.vocabulary) + ids[held])
                counts[:-1] += np.bincount(pairs % len(index.vocabulary), minlength=len(index.vocabulary))
                counts[-1] += len(texts)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(counts))), pa.array(counts)], ["word", "n"])

    rows = docs.select(F.col("text").cast("string").alias("text")).mapInArrow(task, "word long, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    counts = {r.word: r.n for r in rows}
    places = index.lookup.find(Words([w.encode() for w in index.vocabulary], ALNUM)).tolist()
    return {w: counts.get(i, 0) for w, i in zip(index.vocabulary, places)}, counts.get(len(index.vocabulary), 0)


KINDS = {
    "n_words": "long", "n_base": "long", "first_word": "long", "last_word": "long", "base_labels": "string", "labels": "string", "score": "double",
}


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id and the result columns, one row per document.

    Defined results: a null or wordless text has no words, no places, null
    first_word and last_word, empty labels and score 0; places of one phrase
    count each, overlapping ones too; an empty table gives no rows.  The score
    is the largest weighted share of a template's words that fits, 1 for a base
    phrase.
    """
    index = Index(*document_frequencies(docs))
    kinds = {"long": pa.int64(), "string": pa.string(), "double": pa.float64()}

    def task(batches):
        for batch in batches:
            for a, b, texts in chunks(batch, 1):
                found = index.scan(texts)
                yield pa.RecordBatch.from_arrays(
                    [batch.slice(a, b - a).column(0), *(pa.array(found[c], kinds[k]) for c, k in KINDS.items())], ["doc_id", *KINDS]
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(task, "doc_id long, " + ", ".join(f"{c} {k}" for c, k in KINDS.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scanned(spark.read.parquet(f"{sf_dir}/documents.parquet"))
