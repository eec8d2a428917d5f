"""Cross-tokenizer alignment, centroid clustering and MinHash near-dedup against brute force, with hard rows."""

import base64
import collections
import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from somaflow.llm import op11_alignment, op12_clusters, op13_minhash

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


# -- 11 alignment

ODD = [None, "", " ", "  ", "a ", " a", "a  b\n", "\n", "\n\n a", "x▁y z", "▁", "a x▁y and words", "<|endoftext|> <s> </s>", "tab\t b \t", "  nb   q", "日本語 テキスト  終"]
ODD += ["é" * 50, "x" * 30_000, " \x1c a \x85 b ", "'s don't 're", "🙂 a🙂 b", "end\n ", "a\x00 b", "word " * 5000, "word " * 5000, "many words " * 9000 + "▁"]


@pytest.fixture(scope="module")
def odd_docs(spark):
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(40).collect()
    rows = [tuple(r) for r in base] + [(10_000 + i, t, None, None, None) for i, t in enumerate(ODD)]
    rows += [tuple(base[3]), tuple(base[3]), (10_000, base[4][1], None, None, 1), (None, "no id", None, None, None), (None, None, None, None, None)]
    # further columns, with names that the operators use themselves
    df = spark.createDataFrame([(*r, i, "k", [1]) for i, r in enumerate(rows)], SCHEMA + ", chunk long, key string, buckets array<int>")
    return df.repartition(5).cache()


def aligned_by_hand(texts):
    """What each text (with repeats) gives, from whole texts and byte offsets."""
    a = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as f:
        raw = {int(i): base64.b64decode(t) for t, i in map(bytes.split, f)}
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    piece = lambda i: bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode()
    held, count = [], collections.Counter()
    for t in texts:
        if not t:
            held.append(None)
            continue
        x, y = a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)
        p, q = [raw[i] for i in x], [piece(i) for i in y]
        if b"".join(p) != (" " + t).encode() or b"".join(q) != (" " + t).encode():
            held.append(None)
            continue
        ends_p, ends_q = np.cumsum([0, *map(len, p)]).tolist(), np.cumsum([0, *map(len, q)]).tolist()
        at_p, at_q = {e: i for i, e in enumerate(ends_p)}, {e: i for i, e in enumerate(ends_q)}
        common = sorted(at_p.keys() & at_q.keys())
        groups, links = [], []
        for lo, hi in zip(common, common[1:]):
            mine_p, mine_q = range(at_p[lo], at_p[hi]), range(at_q[lo], at_q[hi])
            groups.append(",".join(str(x[i]) for i in mine_p) + "|" + ",".join(str(y[j]) for j in mine_q))
            links += [(x[i], y[j]) for i in mine_p for j in mine_q if ends_p[i] < ends_q[j + 1] and ends_q[j] < ends_p[i + 1]]
        count.update(links)
        held.append((len(x), len(y), len(groups), links, hashlib.sha256(";".join(groups).encode()).hexdigest()))
    best = collections.Counter()
    for (_, y), n in count.items():
        best[y] = max(best[y], n)
    return [(0,) * 6 + ("",) if h is None else (*h[:3], len(h[3]), sum(count[p] == best[p[1]] for p in h[3]), sum(count[p] for p in h[3]), h[4]) for h in held]


@pytest.mark.parametrize("small", [False, True])
def test_alignment_matches_whole_texts(odd_docs, small, monkeypatch):
    if small:  # many chunks, joins that don't broadcast
        monkeypatch.setattr(op11_alignment, "CHUNK_CHARS", 3000)
        monkeypatch.setattr(op11_alignment, "BROADCAST_PAIRS", 0)
    rows = odd_docs.select("doc_id", "text").collect()
    want = sorted(map(repr, ((r["doc_id"], *w) for r, w in zip(rows, aligned_by_hand([r["text"] for r in rows])))))
    assert sorted(map(repr, map(tuple, op11_alignment.alignments(odd_docs).collect()))) == want


def test_alignment_without_cuts_and_with_wide_places(spark, monkeypatch):
    rng = random.Random(4)
    texts = [" ".join(f"{rng.randrange(200_000)}" for _ in range(70_000)), "a b", None, "a b"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string").coalesce(1)
    want = [(i, *w) for i, w in enumerate(aligned_by_hand(texts))]
    assert sorted(map(tuple, op11_alignment.alignments(df).collect())) == want
    monkeypatch.setattr(op11_alignment, "cut_rules", lambda a, b: None)
    assert sorted(map(tuple, op11_alignment.alignments(df).collect())) == want


def test_alignment_of_nothing(spark):
    assert op11_alignment.alignments(spark.createDataFrame([], SCHEMA)).count() == 0
    nothing = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert sorted(map(tuple, op11_alignment.alignments(nothing).collect())) == [(i, 0, 0, 0, 0, 0, 0, "") for i in (1, 2)]


def test_cut_rules():
    a, b = op11_alignment.path_of(op11_alignment.BYTE_LEVEL), op11_alignment.path_of(op11_alignment.PIECES)
    assert op11_alignment.cut_rules(a, b) == set()
    assert op11_alignment.cut_rules(op11_alignment.path_of("word_bpe_49k.json"), b) is None


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="ab !.\n\t é日", max_size=30), st.sets(st.sampled_from("b!."), max_size=2))
def test_segments_are_the_text(text, unsafe):
    held = op11_alignment.Segments(unsafe)
    for _ in range(2):
        parts = [" " + held.keys[k] for k in held.places(text)]
        assert "".join(parts) == " " + text
        for one, two in zip(parts, parts[1:]):
            assert not one[-1].isspace() and one[-1] not in unsafe and two[0] == " " and two.strip()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab  !'s1.\n\t　é日🙂<|endoftext|>"), max_size=40))
def test_segments_have_the_texts_tokens(text):
    a, b = op11_alignment.path_of(op11_alignment.BYTE_LEVEL), op11_alignment.path_of(op11_alignment.PIECES)
    both = op11_alignment.tokenizers_for(a, b)
    held = op11_alignment.Segments(set())
    if not text:
        return
    x, y = both.encode([" " + held.keys[k] for k in held.places(text)])
    assert sum(x, []) == both.encode([" " + text])[0][0] and sum(y, []) == both.b.encode(text)


# -- 12 clustering


def lloyd(rows, k=16, rounds=3, dim=64):
    kept = [(i, [math.floor(Fraction(float(x)) * 64) for x in v]) for i, v in rows if v is not None and len(v) == dim and all(x is not None and math.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [q for _, q in sorted(kept, key=key)[:k]]
    near = lambda q: min((sum((a - b) ** 2 for a, b in zip(q, c)), j) for j, c in enumerate(centroids))
    for _ in range(rounds):
        groups = collections.defaultdict(list)
        for _, q in kept:
            groups[near(q)[1]].append(q)
        for j, mine in groups.items():
            centroids[j] = [sum(c) // len(mine) for c in zip(*mine)]
    return [(i, near(q)[1], min(near(q)[0], op12_clusters.MOST)) for i, q in kept], centroids


VECTORS = "vec_id long, embedding array<float>, label int"


def vectors_with_odd_ones(n, seed, huge):
    rng = np.random.default_rng(seed)
    rows = [(i, rng.normal(0, 0.3, 64).astype(np.float32).tolist(), 0) for i in range(n)]
    rows += [(n, None, 1), (n + 1, [], 1), (n + 2, [1.0] * 63, 1), (n + 3, [1.0] * 65, 1), (n + 4, [None] + [1.0] * 63, 1), (n + 5, [float("nan")] * 64, 1), (n + 6, [float("inf")] + [0.0] * 63, 1)]
    rows += [(3, rows[3][1], 0), (3, rows[4][1], 0), (None, rows[5][1], None), (None, rows[6][1], None), ((1 << 62) + 1, rows[7][1], 0), (n + 7, [0.0] * 64, 0), (n + 8, [-0.0] * 64, 0)]
    return rows + [(n + 20 + k, [v] * 32 + [-v] * 32, 0) for k, v in enumerate(huge)]


@pytest.mark.parametrize("huge", [[], [3e6, 1e30, -3.4e38], [1e7, 2e7], [1e12] * 40])
def test_clusters_match_plain_arithmetic(spark, huge):
    rows = vectors_with_odd_ones(60, 1, huge)
    df = spark.createDataFrame(rows, VECTORS).repartition(4)
    exact = [(r["vec_id"], r["embedding"]) for r in df.collect()]
    want, centroids = lloyd(exact)
    found, got = op12_clusters.cluster(df)
    assert got == centroids
    assert sorted(map(repr, map(tuple, found.collect()))) == sorted(map(repr, want))


def test_few_and_no_vectors(spark, tmp_path):
    few = spark.createDataFrame([(i, [float(i)] * 64, 0) for i in range(5)], VECTORS)
    found, centroids = op12_clusters.cluster(few)
    assert len(centroids) == 5 and found.where("distance > 0").count() == 0
    for name, df in (("none", few.limit(0)), ("unfit", spark.createDataFrame([(1, [1.0], 0), (2, None, 0)], VECTORS))):
        df.write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        assert op12_clusters.query(spark, f"{tmp_path}/{name}").collect() == []


def test_huge_inertia_is_the_largest_long(spark, tmp_path):
    rows = [(i, [1e30 if i % 2 else -1e30] * 64, 0) for i in range(50)] + [(90 + i, [float(i % 7) * 1e29] * 64, 0) for i in range(20)]
    spark.createDataFrame(rows, VECTORS).write.parquet(f"{tmp_path}/embeddings.parquet")
    got = op12_clusters.query(spark, str(tmp_path)).collect()
    assert len(got) == 70 and all(0 <= r["distance"] <= r["cluster_inertia"] <= r["inertia"] for r in got)


# -- 13 MinHash


def set_of(text):
    words = re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(zip(words, words[1:])) if len(words) > 1 else frozenset(words)


def grouped_by_hand(rows):
    sets = [set_of(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            if sets[i] and 100 * common >= 80 * (len(sets[i]) + len(sets[j]) - common) and sets[j]:
                root[max(find(i), find(j))] = min(find(i), find(j))
    least = {}
    for i, (doc, _) in enumerate(rows):
        if doc is not None:
            least[find(i)] = min(least.get(find(i), doc), doc)
    return sorted(repr((doc, len(sets[i]), least.get(find(i)))) for i, (doc, _) in enumerate(rows))


def grouped(df):
    return sorted(repr((r["doc_id"], r["n_shingles"], r["component_id"])) for r in op13_minhash.near_groups(df).collect())


def test_minhash_groups_of_odd_rows(odd_docs):
    assert grouped(odd_docs) == grouped_by_hand([tuple(r) for r in odd_docs.select("doc_id", "text").collect()])


@pytest.mark.parametrize("seed", [1, 2])
def test_minhash_finds_near_copies_of_all_sizes(spark, seed, monkeypatch):
    """Copies at every distance around the bound, chains of them, and sets of few shingles."""
    monkeypatch.setattr(op13_minhash, "LEAVES", 8)
    monkeypatch.setattr(op13_minhash, "BROADCAST_KEYS", 0)
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(3000)}"
    rows = []
    for size in [4, 5, 6, 7, 8, 9, 10, 12, 20, 40, 100, 400, 3000]:
        for _ in range(4):
            text = [word() for _ in range(size + 1)]
            rows.append(" ".join(text))
            for _ in range(6):
                text = list(text)
                for _ in range(max(1, round(size * rng.choice([0.02, 0.05, 0.08, 0.1, 0.12])))):
                    at = rng.randrange(len(text))
                    text[at : at + rng.randrange(2)] = [word()]
                rows.append(" ".join(text))
    rows = list(enumerate(rows))
    rng.shuffle(rows)
    assert grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)) == grouped_by_hand(rows)


@pytest.mark.parametrize("tile", [512, 16])
def test_minhash_takes_every_pair_of_a_bucket(spark, tile, monkeypatch):
    """Many texts of one template, most of them just too far from each other, among them pairs that link: no star of one hub finds those."""
    monkeypatch.setattr(op13_minhash, "TILE", tile)
    rng = random.Random(7)
    template = [f"t{i}" for i in range(100)]
    rows = []
    for i in range(120):
        own = template[:88] + [f"x{i}_{k}" for k in range(12)]
        rows.append((2 * i, " ".join(own)))
        if i % 3 == 0:
            own[-1] = "changed"
            rows.append((2 * i + 1, " ".join(own)))
    rng.shuffle(rows)
    got = grouped(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert got == grouped_by_hand(rows) and len(got) == 160


def test_minhash_hot_group_and_nothing(spark):
    same = [(i, "one and the same text of many copies " * 3) for i in range(300)]
    near = [(1000 + i, "a text of forty words that is nearly alike " * 5 + " ".join(f"w{j}" for j in range(40)) + f" end{i}") for i in range(300)]
    got = op13_minhash.near_groups(spark.createDataFrame(same + near, "doc_id long, text string")).groupBy("component_id").count().collect()
    assert sorted(map(tuple, got)) == [(0, 300), (1000, 300)]
    assert op13_minhash.near_groups(spark.createDataFrame([], SCHEMA)).count() == 0
    blank = spark.createDataFrame([(1, None), (2, ""), (3, " \n"), (None, "")], "doc_id long, text string")
    assert sorted(map(repr, map(tuple, op13_minhash.near_groups(blank).collect()))) == sorted(map(repr, [(1, 0, 1), (2, 0, 2), (3, 0, 3), (None, 0, None)]))


def test_sketches_of_similar_sets_agree():
    """Sets of similarity 0.8 and at least AGREE_FROM shingles agree in AGREE of their bins, with room."""
    rng = np.random.default_rng(5)
    least = 1.0
    for n in (64, 80, 150, 288, 1000):
        for _ in range(200):
            sets = []
            common, other = rng.integers(0, 1 << 63, -(-8 * n // 9)), rng.integers(0, 1 << 63, 2 * (n // 9))
            for own in (other[::2], other[1::2]):
                sets.append(np.sort(np.concatenate((common, own)).astype(np.uint64) * np.uint64(2)))
            x, y = op13_minhash.sketches(np.repeat([0, 1], list(map(len, sets))), np.concatenate(sets), 2).astype(np.uint8)
            least = min(least, (x == y).mean())
    assert least > op13_minhash.AGREE + 0.03


def test_densification_keeps_similarity():
    """Bins of sparse sets agree as often as their sets do."""
    rng = np.random.default_rng(3)
    agree = []
    for _ in range(300):
        common, own = rng.integers(0, 1 << 63, 8).astype(np.uint64) * np.uint64(2), rng.integers(0, 1 << 63, 2).astype(np.uint64) * np.uint64(2)
        hashes = np.concatenate((common, common, own))
        bins = ((hashes >> np.uint64(32)) * np.uint64(op13_minhash.BINS) >> np.uint64(32)).astype(int)
        values, filled = np.full((2, op13_minhash.BINS), np.iinfo(np.uint64).max), np.zeros((2, op13_minhash.BINS), bool)
        for s, b, h in zip([0] * 8 + [1] * 10, bins, hashes):
            values[s, b], filled[s, b] = min(values[s, b], h), True
        x, y = op13_minhash.densified(values, filled)
        agree.append((x == y).mean())
    assert abs(np.mean(agree) - 0.8) < 0.02
