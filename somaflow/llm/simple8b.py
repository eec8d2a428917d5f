"""Simple-8b word-aligned coding of id streams, and the file that holds them.

A 64-bit word has a 4-bit selector in its top bits and 60 payload bits; the
selector says how many ids of how many bits the payload holds, lowest bits
first.  Ids of more than 60 bits are escaped: a word of selector 0 announces
that the next word is the id itself.

Ids are packed in blocks of a fixed number of ids.  A block's words can be
found by its offset alone, so blocks are packed and unpacked side by side:
numpy steps through all blocks of a batch at once when packing, and unpacks
all words of one selector in one operation.

File layout, little-endian:

    words          u64[words]
    block offsets  u64[blocks + 1]   first word of each block
    document ids   i64[documents]
    null flags     u8[documents]     1: the document id is null
    counts         u64[documents]    ids of each document
    trailer        "S8BT" | u32 version | u64 documents | u64 ids | u64 words | u32 ids per block | u32 zero

The words come first so that they stream out while tokens are made.
"""

from __future__ import annotations

import struct

import numpy as np

MAGIC, VERSION, BLOCK = b"S8BT", 1, 1024
TRAILER = struct.Struct("<4sIQQQII")
#: Ids in a word by selector; 0 is the escape.
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1, 0], np.int64)
BITS = np.array([0, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60, 0], np.int64)
PACKED = range(1, 15)


#: Bits that an id below 2^16 needs, at least 1.
_SMALL = np.maximum(1, np.frexp(np.arange(1 << 16))[1]).astype(np.uint8)


def _width(ids: np.ndarray) -> np.ndarray:
    """Bits that each id needs, at least 1; more than 60 counts as 64."""
    large = ids >> np.uint64(16) > 0
    if not large.any():
        return _SMALL[ids]
    width = _SMALL[np.where(large, 0, ids)]
    some = ids[large]
    bits = np.full(len(some), 17, np.uint8)
    for b in range(17, 61):
        bits[some >> np.uint64(b) > 0] = b + 1 if b < 60 else 64
    width[large] = bits
    return width


def encode(ids: np.ndarray, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """(words, words of each block) of an id stream cut into blocks."""
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    ids = ids.astype(np.uint64)
    blocks = -(-n // block)
    # pick[i]: the selector that packs most ids from i on within i's block; widest[i]: largest
    # width of ids i .. i + reach - 1, 255 across the block's end
    pick = np.zeros(blocks * block, np.uint8)
    widest = np.full(blocks * block, 255, np.uint8)
    widest[:n] = _width(ids)
    widest, pick = widest.reshape(blocks, block), pick.reshape(blocks, block)
    reach = 1
    for s in reversed(PACKED):  # counts rise, bits fall
        count = int(COUNTS[s])
        while reach < count:
            step = min(reach, count - reach)
            wider = np.full((blocks, block), 255, np.uint8)
            np.maximum(widest[:, :-step], widest[:, step:], out=wider[:, :-step])
            widest, reach = wider, reach + step
        fits = widest <= BITS[s]
        if not fits.any():
            break
        pick[fits] = s
    pick = pick.reshape(-1)
    # all blocks advance together, a word a step
    taken, opens = np.maximum(COUNTS, 1), np.zeros(n, bool)
    pos = np.arange(blocks, dtype=np.int64) * block
    stop = np.minimum(pos + block, n)
    while len(pos):
        opens[pos] = True
        pos = pos + taken[pick[pos]]
        live = pos < stop
        if not live.all():
            pos, stop = pos[live], stop[live]
    first = np.flatnonzero(opens)
    selector = pick[first].astype(np.int64)
    escaped = selector == 0
    words = np.zeros(len(first), np.uint64)
    for s in PACKED:
        w = np.flatnonzero(selector == s)
        if len(w):
            base, acc = first[w], np.full(len(w), s, np.uint64) << np.uint64(60)
            for k in range(int(COUNTS[s])):
                acc |= ids[base + k] << np.uint64(k * int(BITS[s]))
            words[w] = acc
    size = 1 + escaped.astype(np.int64)
    per_block = np.bincount(first // block, weights=size, minlength=blocks).astype(np.int64)
    if escaped.any():
        place = np.cumsum(size) - size
        out = np.zeros(int(size.sum()), np.uint64)
        out[place] = words
        out[place[escaped] + 1] = ids[first[escaped]]
        words = out
    return words, per_block


def decode(words: np.ndarray) -> np.ndarray:
    """The ids of a run of whole blocks' words."""
    if not len(words):
        return np.zeros(0, np.uint64)
    selector = (words >> np.uint64(60)).astype(np.int64)
    raw = np.zeros(0, np.int64)
    if (selector == 0).any():
        # an escape's payload word may look like anything: walk the zero selectors in order
        candidates, skip, raw_at = np.flatnonzero(selector == 0), -1, []
        for c in candidates.tolist():
            if c != skip:
                raw_at.append(c + 1)
                skip = c + 1
        raw = np.array(raw_at, np.int64)
        selector[raw] = 15
    count = COUNTS[selector]
    place = np.cumsum(count) - count
    out = np.zeros(int(count.sum()), np.uint64)
    for s in PACKED:
        w = np.flatnonzero(selector == s)
        if len(w):
            bits = int(BITS[s])
            mask, base, payload = np.uint64((1 << bits) - 1), place[w], words[w]
            for k in range(int(COUNTS[s])):
                out[base + k] = (payload >> np.uint64(k * bits)) & mask
    if len(raw):
        out[place[raw - 1]] = words[raw]
    return out


class Writer:
    """Streams documents' ids into one file; whole blocks go out as they fill."""

    def __init__(self, sink, block: int = BLOCK):
        self.sink, self.block = sink, block
        self.pending: list[np.ndarray] = []
        self.waiting = self.ids = self.words = 0
        self.sizes: list[np.ndarray] = []
        self.docs: list[np.ndarray] = []
        self.nulls: list[np.ndarray] = []
        self.counts: list[np.ndarray] = []

    def add(self, doc_ids: np.ndarray, nulls: np.ndarray, counts: np.ndarray, ids: np.ndarray) -> None:
        self.docs.append(doc_ids.astype("<i8"))
        self.nulls.append(nulls.astype("u1"))
        self.counts.append(counts.astype("<u8"))
        self.pending.append(ids)
        self.waiting += len(ids)
        self.ids += len(ids)
        if self.waiting >= self.block * 512:
            self._pack(last=False)

    def _pack(self, last: bool) -> None:
        ids = np.concatenate(self.pending) if self.pending else np.zeros(0, np.uint32)
        cut = len(ids) if last else len(ids) // self.block * self.block
        words, sizes = encode(ids[:cut], self.block)
        self.sink.write(words.astype("<u8").tobytes())
        self.words += len(words)
        self.sizes.append(sizes)
        self.pending, self.waiting = [ids[cut:]], len(ids) - cut

    def close(self) -> tuple[int, int]:
        """Writes what is left, the tables and the trailer; (documents, ids)."""
        self._pack(last=True)
        offsets = np.concatenate(([0], np.cumsum(np.concatenate(self.sizes)))).astype("<u8")
        docs = sum(map(len, self.docs))
        for parts, kind in ((self.docs, "<i8"), (self.nulls, "u1"), (self.counts, "<u8")):
            if not parts:
                parts.append(np.zeros(0, kind))
        self.sink.write(offsets.tobytes())
        for parts in (self.docs, self.nulls, self.counts):
            self.sink.write(np.concatenate(parts).tobytes())
        self.sink.write(TRAILER.pack(MAGIC, VERSION, docs, self.ids, self.words, self.block, 0))
        return docs, self.ids


class Reader:
    """One file: its documents, and their ids from whole blocks in bounded batches."""

    def __init__(self, source, size: int):
        self.source = source
        source.seek(size - TRAILER.size)
        magic, version, self.n_docs, self.n_ids, self.n_words, self.block, _ = TRAILER.unpack(source.read(TRAILER.size))
        if magic != MAGIC or version != VERSION:
            raise ValueError("not a file of this format")
        blocks = -(-self.n_ids // self.block)
        source.seek(self.n_words * 8)
        self.offsets = np.frombuffer(source.read((blocks + 1) * 8), "<u8").astype(np.int64)
        self.doc_ids = np.frombuffer(source.read(self.n_docs * 8), "<i8")
        self.nulls = np.frombuffer(source.read(self.n_docs), "u1").astype(bool)
        self.counts = np.frombuffer(source.read(self.n_docs * 8), "<u8").astype(np.int64)

    def batches(self, blocks: int = 512):
        """(first id's place, ids) of consecutive block runs."""
        total = len(self.offsets) - 1
        for a in range(0, total, blocks):
            b = min(a + blocks, total)
            self.source.seek(int(self.offsets[a]) * 8)
            words = np.frombuffer(self.source.read(int(self.offsets[b] - self.offsets[a]) * 8), "<u8")
            yield a * self.block, decode(words)
