"""The training-data operators against brute force, round trips and held-out accuracy, with hard rows."""

import collections
import hashlib
import random
import re
import zlib

import duckdb
import numpy as np
import pytest

import corpus_pipeline
from somaflow.llm import catalogue, components, op1_mixing, op2_tokens, op3_decontamination, op4_simhash, op5_warc, op6_neighbours, op7_licenses, op8_repeats, op9_pii, op10_toxicity, simple8b
from somaflow.llm.boosting import Boosted

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
ODD = [None, "", " ", "\n\t ", "a", "A  b", "é" * 300, "x" * 70_000, "tie tie tie", "tie tie tie", "\x00\x1c odd   space", "end ", "<|endoftext|> a <|endoftext|>"]


def lower(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t)


def words(t, pattern="[^\x00-\x2f\x3a-\x60\x7b-\x7f]+"):
    return re.findall(pattern, lower(t or ""))


@pytest.fixture(scope="module")
def docs(spark):
    """Documents of the smallest table with odd ones: nulls in every column, repeated rows and ids, an extra column."""
    base = spark.read.parquet(f"{SF}/documents.parquet").orderBy("doc_id").limit(60).collect()
    rows = [tuple(r) for r in base] + [(1000 + i, t, None, None if i % 2 else "src0", None) for i, t in enumerate(ODD)]
    rows += [(None, "no id", "en", "src1", 5), (None, None, None, None, None), tuple(base[3]), tuple(base[3]), (2000, base[4][1], "en", "src2", 1)]
    rows += [(2001, (base[5][1] or "") + " one more word", "en", "src2", 1)]
    df = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], SCHEMA + ", words long")
    return df.repartition(5).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


# -- against SQL, on a whole table


@pytest.mark.parametrize("name", sorted(catalogue.oracle_sql()))
def test_oracles(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    df = catalogue.queries()[name](spark, SF)
    rel = con.execute(catalogue.oracle_sql()[name])
    cols = [c[0] for c in rel.description]
    assert sorted(cols) == sorted(df.columns)
    assert sorted(map(repr, (tuple(r[c] for c in cols) for r in df.collect()))) == sorted(map(repr, rel.fetchall()))


# -- 1 mixing


def fill(sizes):
    """Targets by rounds of sharing and capping."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: op1_mixing.WEIGHTS[i % 3] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), set()
    while True:
        rest = total - sum(3 * sizes[s] for s in full)
        share = sum(weight[s] for s in order if s not in full)
        over = {s for s in order if s not in full and rest * weight[s] > 3 * sizes[s] * share}
        if not over:
            return {s: 3 * sizes[s] if s in full else rest * weight[s] / share for s in order}
        full |= over


def test_mixing_targets_and_limits(docs):
    rows = op1_mixing.mix(docs, keep=["doc_id", "source", "text"]).collect()
    size = lambda t: len(re.findall("[^\x20\x09-\x0d]+", t or ""))
    assert len(rows) == docs.count() and all(r["_size"] == size(r["text"]) and 0 <= r["_copies"] <= 3 for r in rows)
    sizes = collections.Counter()
    for r in rows:
        sizes[r["source"]] += r["_size"]
    for s, target in fill(dict(sizes)).items():
        mine = [r for r in rows if r["source"] == s]
        taken = sum(r["_size"] * r["_copies"] for r in mine)
        assert all(np.isclose(r["_target"], target) for r in mine)
        assert abs(taken - target) <= max(r["_size"] for r in mine)
    again = op1_mixing.mix(docs, keep=["doc_id", "source", "text"]).collect()
    assert sorted(map(repr, rows)) == sorted(map(repr, again))


def test_mixing_takes_a_hot_source_and_nothing(spark, empty):
    rows = [(i, "w " * (1 + i % 7), "en", "hot" if i % 3 else f"s{i % 11}", 0) for i in range(3000)]
    got = op1_mixing.mix(spark.createDataFrame(rows, SCHEMA), keep=["source"])
    for r in got.groupBy("source").agg({"_target": "max", "_source_size": "max"}).collect():
        assert r["max(_target)"] <= 3 * r["max(_source_size)"]
    assert op1_mixing.mix(empty).count() == 0
    mixed = op1_mixing.mixed_documents(spark.createDataFrame(rows, SCHEMA))
    assert mixed.columns == [c.split()[0] for c in SCHEMA.split(", ")]
    assert mixed.count() == got.selectExpr("sum(_copies) AS n").first()["n"]


def test_mixing_splits_rows_of_one_id(spark, monkeypatch):
    """Sources of one repeated id, of no id, of equal rows, and of rows apart: each comes near its target."""
    rows = [(7, f"w{i} " * 10, "en", "a", i) for i in range(200)] + [(None, f"w{i} " * 10, "en", "b", i) for i in range(200)]
    rows += [(9, "same " * 10, "en", "c", 5)] * 200 + [(None, None, None, None, None)] * 30 + [(i, "x " * 10, "en", "d", i) for i in range(100, 300)]
    names = {"_copies": "a", "_key": "b", "_hash": "c", "_row": "d", "_s": "e", "_k": "f", "_rank": "g", "_size": "h", "a.b": "i"}
    df = spark.createDataFrame(rows, SCHEMA).repartition(6)
    clashing = df
    for c, v in names.items():
        clashing = clashing.withColumn(c, op1_mixing.F.lit(v))
    results = []
    for part, most in ((df, 100_000), (df.repartition(3), 1), (clashing, 100_000)):
        monkeypatch.setattr(op1_mixing, "BROADCAST_KEYS", most)
        got = op1_mixing.mix(part, keep=["doc_id", "source", "text"]).collect()
        assert len(got) == len(rows)
        for s in "abcd":
            mine = [r for r in got if r["source"] == s]
            assert abs(sum(r["_size"] * r["_copies"] for r in mine) - mine[0]["_target"]) <= 10
        results.append(sorted(map(repr, got)))
        mixed = op1_mixing.mixed_documents(part)
        assert mixed.columns == part.columns
        taken = collections.Counter()
        for r in got:
            taken[r["doc_id"], r["source"], r["text"]] += r["_copies"]
        assert collections.Counter((r["doc_id"], r["source"], r["text"]) for r in mixed.collect()) == +taken
    assert results[0] == results[1] == results[2]


# -- 2 tokens


@pytest.mark.parametrize("high", [2, 50_257, 1 << 40, (1 << 64) - 1])
def test_simple8b_round_trip(high):
    rng = np.random.default_rng(0)
    for n in (0, 1, 59, 1024, 5000):
        x = rng.integers(0, high, n, dtype=np.uint64)
        x[rng.random(n) < 0.4] //= np.uint64(3)
        coded, sizes = simple8b.encode(x)
        assert (simple8b.decode(coded) == x).all() and sizes.sum() == len(coded)


def test_tokens(docs, spark, empty):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(op2_tokens.tokenizer_path())
    rows = docs.select("doc_id", "text").collect()
    want = collections.Counter()
    for r in rows:
        ids = t.encode(r["text"] or "", add_special_tokens=False).ids + [2]
        want[r["doc_id"], len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())] += 1
    got = sorted(op2_tokens.encode_documents(docs).collect(), key=lambda r: r["start"])
    assert collections.Counter((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == want
    assert [r["start"] for r in got] == np.cumsum([0, *(r["n_tokens"] for r in got[:-1])]).tolist()
    ids = [r["doc_id"] for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert op2_tokens.encode_documents(empty).count() == 0


def test_pieces_equal_whole_texts():
    e = op2_tokens.PieceEncoder(op2_tokens.tokenizer_path())
    rng = random.Random(1)
    texts = ["".join(rng.choice(["ab", " ", "  ", "\n", "'s", "1", "é", ".", " ", "<|endoftext|>", "the"]) for _ in range(rng.randrange(40))) for _ in range(400)]
    for _ in range(2):
        assert e.encode(texts) == [np.array(x.ids, "<u4").tobytes() for x in e.whole.encode_batch(texts, add_special_tokens=False)]


# -- 3 decontamination


def contamination(texts, items):
    out = []
    grams = collections.defaultdict(set)
    for name, text in items:
        w = words(text)
        for k in range(max(1, len(w) - 12) if w else 0):
            grams[tuple(w[k : k + 13])].add(name)
    for t in texts:
        w, hit, seen = words(t), set(), set()
        for n in {len(g) for g in grams}:
            for k in range(len(w) - n + 1):
                if (g := tuple(w[k : k + n])) in grams:
                    hit.update(range(k, k + n))
                    seen |= grams[g]
        out.append((len(w), len(hit), len(seen), hashlib.sha256(",".join(sorted(seen)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)))
    return out


def test_decontamination_with_short_items(docs, spark, empty):
    items = [("1", "tie Tie"), ("2", ""), ("3", None), ("10", docs.where("doc_id = 3").first()["text"][40:400]), ("2", "no id"), ("9", "one more word")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    rows = op3_decontamination.scanned(docs.withColumn("n_hit", docs.words), bench).collect()
    assert [tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows] == contamination([r["text"] for r in rows], [i for i in items])
    clean = op3_decontamination.clean_documents(docs, bench)
    assert clean.columns == docs.columns and clean.count() == sum(not r["contaminated"] for r in rows)
    assert op3_decontamination.scanned(docs, bench.limit(0)).where("contaminated").count() == 0
    assert op3_decontamination.scanned(empty, bench).count() == 0


def test_blocks_of_the_benchmark_agree(docs, spark):
    items = [(str(i), r["text"][30:300]) for i, r in enumerate(docs.where("length(text) > 400").limit(12).collect())]
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    make = lambda part: op3_decontamination.Block([i for i, _ in part], [t.encode() for _, t in part])
    assert op3_decontamination.scan(texts, [make(items)]) == op3_decontamination.scan(texts, [make(items[k::4]) for k in range(4)])


def test_stored_blocks(docs, spark, monkeypatch):
    """Several blocks, more than a worker keeps, through Spark."""
    items = [(str(i), r["text"][30:300]) for i, r in enumerate(docs.where("length(text) > 400").limit(12).collect())] + [("100", "tie tie"), (None, None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    assert len(op3_decontamination.prepare(bench).files) == 1
    monkeypatch.setattr(op3_decontamination, "BLOCK_BYTES", 500)
    assert len(op3_decontamination.prepare(bench).files) > op3_decontamination.BLOCKS_KEPT
    rows = op3_decontamination.scanned(docs, bench).collect()
    assert [tuple(r[c] for c in ("n_words", "n_hit", "n_items", "items_sha256", "contaminated")) for r in rows] == contamination([r["text"] for r in rows], items)
    assert any(r["n_hit"] for r in rows)


def longest(texts, item):
    """(words, texts that hold them) of the longest match of each suffix of the item, by brute force."""
    held, w = [" " + " ".join(words(t)) + " " for t in texts], words(item)
    for k in range(len(w)):
        n = next((n for n in range(len(w) - k, 0, -1) if any(f" {' '.join(w[k : k + n])} " in h for h in held)), 0)
        yield n, {i for i, h in enumerate(held) if n and f" {' '.join(w[k : k + n])} " in h}


def test_longest_matches(docs, spark, empty, monkeypatch):
    rows = docs.collect()
    long = next(r for r in rows if len(words(r["text"])) > 260)
    items = [("7", "zzqq " + " ".join(words(long["text"])[5:205]) + " zzqq"), ("8", "the tie tie unseenword odd space"), ("9", ""), ("a", None)]
    bench = spark.createDataFrame(items, "item_id string, text string")
    for size in (op3_decontamination.BLOCK_BYTES, 20):
        monkeypatch.setattr(op3_decontamination, "BLOCK_BYTES", size)
        best = {(r["item_id"], r["item_word"]): r for r in op3_decontamination.longest_matches(docs, bench).collect()}
        assert best["7", 1]["n_words"] == 200 and ("7", 0) not in best
        for name, text in items[:2]:
            for k, (n, where) in enumerate(longest([r["text"] for r in rows], text)):
                if n:
                    r = best.pop((name, k))
                    assert r["n_words"] == n and r["doc_id"] in {rows[i]["doc_id"] for i in where}
                    assert any(words(rows[i]["text"])[r["doc_word"] : r["doc_word"] + n] == words(text)[k : k + n] for i in where if rows[i]["doc_id"] == r["doc_id"])
        assert not best
    assert op3_decontamination.longest_matches(empty, bench).count() == 0 == op3_decontamination.longest_matches(docs, bench.limit(0)).count()


def test_suffixes_of_one_run_with_a_passage_standing_twice():
    rng = np.random.default_rng(12)
    for k in range(400):
        passage = rng.integers(0, 12, rng.integers(20, 51))
        ids = np.concatenate((passage, passage, [-1] * (k % 2), passage[: k % 7]))
        array = op3_decontamination.SuffixArray(ids)
        # breaks come first, in order of their place; the end comes before all
        spelled = [int(x) if x >= 0 else i - len(ids) for i, x in enumerate(ids)]
        assert array.order.tolist() == sorted(range(len(ids)), key=lambda i: spelled[i:])
        windows = np.lib.stride_tricks.sliding_window_view(ids, 13)
        whole = np.flatnonzero((windows >= 0).all(axis=1))
        low, high = array.bounds(np.concatenate((ids, [-1] * 16)), whole, np.full(len(whole), 13))
        assert (high - low).tolist() == [(windows == windows[i]).all(axis=1).sum() for i in whole]


def test_words_of_equal_hash_stay_apart(monkeypatch):
    """With hashes cut to two bits, nearly all words collide."""
    from somaflow.llm import textbytes

    real = textbytes.Words.hashes
    monkeypatch.setattr(textbytes.Words, "hashes", lambda self: real(self) & np.uint64(3 << 62))
    vocabulary = [b"ab", b"a", b"abcdefgh", b"abcdefghi", b"ab", b"abcdefgh\xc3\xa9", b"zz"]
    v = textbytes.Vocabulary(textbytes.Words([b" ".join(vocabulary)], textbytes.ALNUM))
    got = v.find(textbytes.Words([b"abcdefghi ab q zz abcdefgh a abcdefghj abcdefgh\xc3\xa9 ab"], textbytes.ALNUM)).tolist()
    assert v.size == 6 and got[1] == got[8] and [i for i, x in enumerate(got) if x < 0] == [2, 6]
    assert len({x for x in got if x >= 0}) == 6


# -- 4 simhash


def fingerprint(t):
    from xxhash import xxh64_intdigest

    w = words(t, "[^\x20\x09-\x0d]+")
    h = [xxh64_intdigest(" ".join(w[i : i + 4]).encode(), 42) for i in range(max(1, len(w) - 3))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def linked(fps):
    d = np.bitwise_count(fps[:, None] ^ fps) <= 4
    u, v = np.nonzero(np.triu(d, 1))
    return components.forest(u, v, len(fps))


def test_simhash(docs, empty, monkeypatch):
    rows = op4_simhash.near_groups(docs).collect()
    texts = {(r["doc_id"], r["text"]) for r in docs.collect()}
    assert collections.Counter((r["doc_id"], r["fp"] & (2**64 - 1)) for r in rows) == collections.Counter((r["doc_id"], fingerprint(r["text"])) for r in docs.collect())
    fps = np.array([r["fp"] for r in rows]).astype(np.int64).view(np.uint64)
    root = linked(fps)
    for g in set(root.tolist()):
        ids = [rows[i]["doc_id"] for i in np.flatnonzero(root == g)]
        assert {rows[i]["component_id"] for i in np.flatnonzero(root == g)} == {min((i for i in ids if i is not None), default=None)}
    want = collections.Counter()
    for g in set(root.tolist()):
        mine = [rows[i] for i in np.flatnonzero(root == g)]
        want[min(mine, key=lambda r: (r["doc_id"] is not None, r["doc_id"] or 0, r["text_hash"]))["doc_id"]] += 1
    clashing = docs
    for c in ("_d", "_h", "d", "h", "n", "row", "_text_hash", "text_hash", "alone", "component_id", "a.b"):
        clashing = clashing.withColumn(c, op4_simhash.F.lit(c))
    for df in (docs, clashing):
        for most in (op4_simhash.BROADCAST_KEYS, 0):
            monkeypatch.setattr(op4_simhash, "BROADCAST_KEYS", most)
            kept = op4_simhash.deduplicated(df)
            assert kept.columns == df.columns and collections.Counter(r["doc_id"] for r in kept.collect()) == want and texts
    assert op4_simhash.near_groups(empty).count() == 0


def test_tiles_equal_brute_force():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**63, 1500).astype(np.uint64)
    for _ in range(5):
        a = np.unique(np.concatenate((a, a[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)))))
    rng.shuffle(a)
    place, h = {v: i for i, v in enumerate(a.tolist())}, len(a) // 2
    parts = [op4_simhash.pair_links(a[:h], None), op4_simhash.pair_links(a[h:], None), op4_simhash.pair_links(a[:h], a[h:])]
    u, v = (np.array([place[x] for p in parts for x in p[k].tolist()]) for k in (0, 1))
    assert (components.forest(u, v, len(a)) == linked(a)).all()


def test_links_over_several_tiles(spark, monkeypatch):
    monkeypatch.setattr(op4_simhash, "TILE", 300)
    rng = np.random.default_rng(21)
    a = rng.integers(0, 2**63, 1000).astype(np.uint64)
    for _ in range(4):
        a = np.unique(np.concatenate((a, a[:300] ^ (np.uint64(1) << rng.integers(0, 64, 300).astype(np.uint64)))))
    nodes = spark.createDataFrame([(v,) for v in a.view(np.int64).tolist()], "fp long").repartition(3)
    place = {v: i for i, v in enumerate(a.view(np.int64).tolist())}
    found = [(place[r["a"]], place[r["b"]]) for r in op4_simhash.links(nodes).collect()]
    u, v = (np.array(x) for x in zip(*found))
    assert (components.forest(u, v, len(a)) == linked(a)).all()


def test_components_of_a_long_path(spark):
    n = 60
    order = list(range(n))
    random.Random(2).shuffle(order)
    links = [(order[i], order[i + 1]) for i in range(n - 1) if i != 40] + [(5, 5)]
    got = {r["a"]: r["b"] for r in components.components(spark.createDataFrame(links, "a long, b long")).collect()}
    first, second = order[:41], order[41:]
    assert all(got.get(x, x) == min(first) for x in first) and all(got.get(x, x) == min(second) for x in second)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


# -- 5 WARC


def test_warc(spark):
    big = "<p>" + "lorem ipsum " * 200 + "</p>"
    rows = [(i, f"http://e.com/{i}", big + str(i % 4) * 3) for i in range(40)]
    rows += [(None, "n1", "q" * 2000), (None, "n2", "q" * 2000), (60, "t", "z" * 1000), (60, "t", "z" * 1000), (60, "t2", "z" * 1000), (3, "s", "z" * 1000), (50, None, "tiny"), (51, "u", "tiny"), (52, "u\r\nX: 1", None), (None, "n", big + "000"), (53, "v", ""), (39, "again", big + "333"), (54, "w", "é" * 100_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = op5_warc.new_folder(spark, "warc-test")
    got = op5_warc.read_pages(op5_warc.write_pages(op5_warc.decided(df), folder), folder).collect()
    top = collections.defaultdict(lambda: -1)
    for i, _, h in rows:
        top[h or ""] = max(top[h or ""], -1 if i is None else i)
    want = collections.Counter()
    seen = set()
    for i, _, h in rows:
        data = (h or "").encode()
        again = len(data) >= 1000 and top[h] >= 0 and (i != top[h] or h in seen)
        if i == top[h]:  # one row of the largest id is the response
            seen.add(h)
        want[i, len(data), hashlib.sha1(data).hexdigest(), "revisit" if again else "response", top[h] if again else None] += 1
    assert collections.Counter((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got) == want
    assert op5_warc.archive(df.limit(0)).count() == 0


def test_warc_record_ids_are_distinct(spark, monkeypatch):
    """Equal rows, small and large, and several archives of one task: every record has an id of its own, and a revisit names another record's."""
    monkeypatch.setattr(op5_warc, "ARCHIVE_BYTES", 4000)
    rows = [(7, "u", "p" * 1500)] * 4 + [(8, "v", "small")] * 3 + [(None, None, None)] * 2 + [(i, "w", f"{i} " * 300) for i in range(20, 40)] + [(9, "u", "long " * 30_000)] * 2
    folder = op5_warc.new_folder(spark, "warc-ids")
    manifest = op5_warc.write_pages(op5_warc.decided(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)), folder)
    ids, kinds, named = [], collections.Counter(), []
    for r in manifest.collect():
        system, path = op5_warc.filesystem(folder)[0], r["file"]
        with system.open_input_stream(path, compression=None) as source:
            for fields, _ in map(op5_warc.parse, op5_warc.read_archive(source)):
                ids.append(fields["WARC-Record-ID"])
                kinds[fields["WARC-Type"]] += 1
                if fields["WARC-Type"] == "revisit":
                    named.append((fields["WARC-Record-ID"], fields["WARC-Refers-To"], fields["X-Page-Id"]))
                elif fields["WARC-Type"] == "response":
                    named.append((fields["WARC-Record-ID"], None, fields.get("X-Page-Id")))
    assert len(ids) == len(set(ids)) == len(rows) + manifest.count() and kinds["warcinfo"] > 2
    responses = {i: page for i, to, page in named if to is None}
    assert kinds["revisit"] == 4 and all(to in responses and to != i and responses[to] == page for i, to, page in named if to)


def test_archive_frames():
    import io
    import struct

    records = [op5_warc._record("response", [("X", str(i))], b"body %d " % i * 50) for i in range(200)]
    for part in (records, records[:1], [b""]):
        sink = io.BytesIO()
        op5_warc.write_archive(sink, part)
        data = sink.getvalue()
        assert list(op5_warc.read_archive(io.BytesIO(data))) == part
        if len(part) == 200:
            assert struct.unpack("<I", data[:4])[0] == op5_warc.SKIPPABLE_MAGIC and len(data) < sum(map(len, part))
    with pytest.raises(ValueError):
        list(op5_warc.read_archive(io.BytesIO(data + b"\x28\xb5\x2f\xfd")))


def test_toxicity_takes_a_repeated_id_once(spark):
    """Many rows of one labelled id reach the task that trains as one row."""
    docs = spark.range(60_000).selectExpr("5L AS doc_id", "concat('word ', id) AS text").unionByName(spark.createDataFrame([(i, f"text {i} vile{i % 3}" if i % 2 else f"text {i} nice") for i in range(6, 60)], "doc_id long, text string"))
    labels = spark.createDataFrame([(i, i % 2) for i in range(5, 60)], "doc_id long, toxic int")
    once = docs.where("doc_id > 5").unionByName(spark.createDataFrame([(5, min((f"word {i}" for i in range(60_000)), key=lambda t: hashlib.md5(t.encode()).hexdigest()))], "doc_id long, text string"))
    many, one = op10_toxicity.fit(docs, labels), op10_toxicity.fit(once, labels)
    assert np.array_equal(many.weight, one.weight) and (many.bias, many.slope, many.offset) == (one.bias, one.slope, one.offset)


# -- 6 neighbours


def test_neighbours_recall_and_hard_rows(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((40, 32))
    x = (centers[rng.integers(0, 40, 3000)] + 0.6 * rng.standard_normal((3000, 32))) * rng.uniform(0.5, 2, (3000, 1))
    x[100:900] = x[100]  # a hot bucket of equal vectors
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(5000, None), (5020, [0.0] * 32), (5040, [float("nan")] * 32), (5060, [None] * 32), (5080, [1.0] * 7), (None, [1.0] * 32)]
    op6_neighbours.BUCKET_PART = 256
    got = collections.defaultdict(list)
    for r in op6_neighbours.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(4)).collect():
        got[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    op6_neighbours.BUCKET_PART = 4096
    assert sorted(got) == list(range(0, 3000, 20))
    found = 0
    for q, hits in got.items():
        hits.sort()
        assert [h[0] for h in hits] == list(range(1, 21)) and q not in [h[1] for h in hits]
        assert all(np.isclose(h[2], x[h[1]] @ x[q], atol=1e-9) for h in hits)
        assert hits == sorted(hits, key=lambda h: (-h[2], h[1]))
        s = x @ x[q]
        s[q] = -np.inf
        found += (np.array([h[2] for h in hits]) >= np.sort(s)[-20] - 1e-9).sum()
    assert found / (20 * len(got)) >= 0.9


def test_few_vectors(spark):
    df = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.5, 0.5]), (20, [0.0, 1.0])], "vec_id long, embedding array<float>")
    got = op6_neighbours.nearest(df).collect()
    assert sorted((r["query_id"], r["rank"], r["vec_id"]) for r in got) == [(0, 1, 1), (0, 2, 20), (20, 1, 1), (20, 2, 0)]
    assert op6_neighbours.nearest(df.limit(0)).count() == 0


@pytest.mark.parametrize("whole", [4096, 100])
def test_rows_of_one_id_are_candidates_of_their_own(spark, whole, monkeypatch):
    monkeypatch.setattr(op6_neighbours, "WHOLE", whole)
    rng = np.random.default_rng(14)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[300:310] = x[0]
    ids = np.arange(600)
    ids[300:305], ids[305:320] = 0, 7
    df = spark.createDataFrame([(int(i), v) for i, v in zip(ids, x.tolist())], "vec_id long, embedding array<double>").repartition(3)
    got = collections.Counter()
    for r in op6_neighbours.nearest(df).collect():
        got[r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)] += 1
    want = collections.Counter()
    for q in np.flatnonzero(ids % 20 == 0):
        s = (x * x[q]).sum(axis=1)
        s[q] = -np.inf
        for k, v in enumerate(np.lexsort((ids, -np.round(s, 12)))[:20]):
            want[int(ids[q]), k + 1, int(ids[v]), round(float(s[v]), 9)] += 1
    assert sum(got.values()) == sum(want.values()) and sum((got & want).values()) >= 0.9 * sum(want.values())
    assert whole == 100 or got == want
    first = lambda c: {k: n for k, n in c.items() if k[0] == 0 and k[1] <= 10}
    assert first(got) == first(want)  # the equal vectors, of ids 0 and 7


def test_norms_whose_squares_leave_the_range_of_doubles(spark, monkeypatch):
    monkeypatch.setattr(op6_neighbours, "WHOLE", 100)
    rng = np.random.default_rng(18)
    x = rng.standard_normal((400, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    x[5] *= 1e200
    x[6:9] *= 1e-200
    x[20] *= 1e-170
    got = scores_of(spark, x)
    for q in range(0, 400, 20):
        assert len(got[q]) == 20 and [v for v, _ in got[q]][0] in np.argsort(-(x @ x[q]))[:2] and (5 in [v for v, _ in got[q]] or x[5] @ x[q] < 0)


def scores_of(spark, x):
    """nearest() of vectors numbered from 0, as {query: [(vec_id, score)]}."""
    got = collections.defaultdict(list)
    df = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())], "vec_id long, embedding array<double>").repartition(4)
    for r in op6_neighbours.nearest(df).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    return got


@pytest.mark.parametrize("skew", ["outlier", "lognormal", "ranges", "narrow"])
def test_neighbours_of_unequal_norms(spark, skew, monkeypatch):
    if skew == "ranges":  # all but the outermost are hashed
        monkeypatch.setattr(op6_neighbours, "WHOLE", 500)
    rng = np.random.default_rng(8)
    x = rng.standard_normal((12_000, 64))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    if skew == "outlier":
        x[77] *= 100
    else:
        x *= np.exp({"lognormal": 1, "ranges": 0.5, "narrow": 0.1}[skew] * rng.standard_normal((len(x), 1)))
    got, ids = scores_of(spark, x), np.arange(0, len(x), 20)
    score = x[ids] @ x.T
    score[np.arange(len(ids)), ids] = -np.inf
    want = np.argsort(-score, axis=1)[:, :20]
    recall = np.array([len(set(w) & {v for v, _ in got[q]}) / 20 for q, w in zip(ids.tolist(), want.tolist())])
    assert recall.mean() > 0.95 and recall.min() >= 0.5


@pytest.mark.parametrize("n, dim", [(15, 64), (3, 2)])
def test_few_vectors_meet_every_other(spark, n, dim):
    x = np.random.default_rng(9).standard_normal((n, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = scores_of(spark, x)
    assert {q: {v for v, _ in found} for q, found in got.items()} == {0: set(range(1, n))}


def test_queries_with_short_buckets_are_ranked_whole(spark):
    rng = np.random.default_rng(10)
    x = 0.02 * rng.standard_normal((5000, 64)) + np.eye(64)[0]
    alone = np.arange(0, 200, 20)
    x[alone] = 0.02 * rng.standard_normal((10, 64)) - np.eye(64)[0]
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    got = scores_of(spark, x)
    assert {len(found) for found in got.values()} == {20} and len(got) == 250
    for q in alone.tolist():
        score = x @ x[q]
        score[q] = -np.inf
        assert [v for v, _ in got[q]] == np.argsort(-score, kind="stable")[:20].tolist()


def test_two_axes_probe_their_own_bucket():
    h = op6_neighbours.CrossPolytope(20, 1.0, False, axes=2, tables=3)
    x = np.random.default_rng(4).standard_normal((50, 20))
    assert all(c in p for code, probe in zip(h.codes(x), h.probes(x)) for c, p in zip(code.tolist(), probe.tolist()))


@pytest.mark.parametrize("low, high, spread", [(1.0, 1.0, 0.0), (0.9, 1.1, 0.0), (1.0, 1.0, 0.4), (0.9, 1.1, 0.4)])
def test_choices_find_what_they_were_measured_to_find(low, high, spread):
    """Recall and rows met of the hash that is chosen for 100,000 vectors, isotropic or in clusters, by other queries than those it was chosen with."""
    rng, n = np.random.default_rng(11), 100_000
    x = rng.standard_normal((n, 64)) if not spread else rng.standard_normal((500, 64))[rng.integers(0, 500, n)] + spread * rng.standard_normal((n, 64))
    x *= rng.uniform(low, high, (n, 1)) / np.linalg.norm(x, axis=1, keepdims=True)

    def nearest(q):
        score = x[q] @ x.T
        score[np.arange(len(q)), q] = -np.inf
        return np.argpartition(-score, 20, axis=1)[:, :20]

    q, others = np.arange(64), np.arange(64, 128)
    h = op6_neighbours.choose(low, high, x[q], [x[v] for v in nearest(q)], x[5000:7048], n, 0.05)
    if h is None:
        assert not spread  # all are ranked, then
        return
    probes = h.probes(x[others])
    meets = lambda v: (h.codes(x[v])[:, None, :, None] == probes[None]).any(axis=(2, 3))
    near = nearest(others)
    assert np.mean([(h.codes(x[v])[:, :, None] == p[None]).any(axis=(1, 2)).mean() for v, p in zip(near, probes)]) > 0.9
    assert meets(np.arange(20_000, 22_000)).mean() < (0.4 if spread else op6_neighbours.MEET + 0.05)


@pytest.mark.parametrize("dim, shape, norms", [(256, "isotropic", 0.0), (768, "isotropic", 0.0), (256, "clusters", 0.0), (768, "clusters", 1.0), (768, "isotropic", 0.3), (64, "clusters", 0.0)])
def test_neighbours_recall_at_any_dimension(spark, dim, shape, norms):
    rng = np.random.default_rng(dim)
    n = 10_000
    x = rng.standard_normal((n, dim)) if shape == "isotropic" else rng.standard_normal((200, dim))[rng.integers(0, 200, n)] + 0.5 * rng.standard_normal((n, dim))
    x *= np.exp(norms * rng.standard_normal((n, 1))) / np.linalg.norm(x, axis=1, keepdims=True)
    got, ids = scores_of(spark, x), np.arange(0, n, 20)
    score = x[ids] @ x.T
    score[np.arange(len(ids)), ids] = -np.inf
    want = np.argpartition(-score, 20, axis=1)[:, :20]
    assert np.mean([len(set(w) & {v for v, _ in got[q]}) / 20 for q, w in zip(ids.tolist(), want.tolist())]) > 0.9


# -- 7 licences


def test_licences(docs, spark, empty):
    extra = ["All rights reserved. all Rights Reserved", "GNU General Public License", "cc-by; CC BY 4.0", "allrights reserved all rights", "all", "Licensed under the Apache License, Version 2.0"]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 9000)), "doc_id long, text string"))
    rows = op7_licenses.scanned(df).collect()
    want = collections.Counter()
    for r in df.collect():
        w = words(r["text"])
        at = [(k, label) for p, label in op7_licenses.BASE.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        want[r["doc_id"], len(w), len(at), min((k for k, _ in at), default=None), max((k for k, _ in at), default=None), ",".join(sorted({x for _, x in at}))] += 1
    assert collections.Counter(tuple(r[c] for c in ("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")) for r in rows) == want
    for r in rows:
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(",")) and 0 <= r["score"] <= 1
    assert next(r for r in rows if r["doc_id"] == 9005)["labels"] == "apache-2.0"
    assert op7_licenses.scanned(empty).count() == 0


def licence_labels(text, df, n):
    """Labels and score by word lists: every alignment that two of the file's rarest words of a template agree on."""
    w = words(text)
    idf = lambda x: np.log((n + 1) / (df.get(x, 0) + 1)) + 1
    holds = lambda p: any(w[k : k + len(p)] == p for k in range(len(w)))
    found, score = {label for p, label in op7_licenses.BASE.items() if holds(p.split())}, 0.0
    score = 1.0 if found else 0.0
    places = op7_licenses.Index(df, n).lookup
    number = lambda x: int(places.find(op7_licenses.Words([x.encode()], op7_licenses.ALNUM))[0])
    for label, template, keys in op7_licenses.TEXTS:
        t = words(template)
        if not all(holds(k.split()) for k in keys) or sum(idf(x) for x in t if x in w) < op7_licenses.FIT * sum(map(idf, t)):
            continue
        rare = sorted({x for x in t if x in w}, key=lambda x: (-idf(x), number(x)))[: op7_licenses.RARE]
        votes = collections.Counter(a for x in rare for a in {i - k for i, v in enumerate(w) if v == x for k, y in enumerate(t) if y == x})
        groups = []
        for a in sorted(a for a, v in votes.items() if v >= min(2, len(rare))):
            if groups and a - groups[-1][-1] <= op7_licenses.SLACK:
                groups[-1].append(a)
            else:
                groups.append([a])
        fit = max((sum(idf(y) for k, y in enumerate(t) if any(0 <= a + k < len(w) and w[a + k] == y for a in g)) for g in groups), default=0) / sum(map(idf, t))
        if fit >= op7_licenses.FIT:
            found.add(label)
            score = max(score, fit)
    return ",".join(sorted(found)), score


def test_licence_labels_equal_word_lists(docs, spark):
    """Whole licence texts with names, changed words and cuts, in files with other words around."""
    rng = random.Random(17)
    texts = ["" if r["text"] is None else r["text"][:3000] for r in docs.collect()]
    for _, t, _ in op7_licenses.TEXTS:
        w = t.split()
        for share in (0.0, 0.1, 0.4):
            new = [rng.choice(["Example", "Corporation", "2024"]) if rng.random() < share else x for x in w]
            at = rng.randrange(len(new))
            texts.append("some words here and there " * 3 + " ".join(new[:at] + ["by", "Some", "Authors"] + new[at:]) + " the end of it")
        texts.append(" ".join(w[: len(w) // 2]))
    texts.append(" ".join(t for _, t, _ in op7_licenses.TEXTS[:6]))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    counts, n = op7_licenses.document_frequencies(df)
    for r in op7_licenses.scanned(df).collect():
        label, score = licence_labels(texts[r["doc_id"]], counts, n)
        assert r["labels"] == label and np.isclose(r["score"], score)
    one = op7_licenses.scanned(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(op7_licenses.TEXTS)], "doc_id long, text string")).collect()
    assert all(op7_licenses.TEXTS[r["doc_id"]][0] in r["labels"].split(",") for r in one)


# -- 8 repeats


def removed(texts):
    count = collections.Counter(t[i : i + 200] for t in texts for i in range(len(t) - 199))
    for t in texts:
        gone = np.zeros(len(t) + 1, bool)
        for i in range(len(t) - 199):
            if count[t[i : i + 200]] > 1:
                gone[i : i + 200] = True
        kept = bytes(b for b, g in zip(t, gone) if not g)
        yield len(t), int(gone.sum()), int((np.diff(np.concatenate(([0], gone.astype(int)))) == 1).sum()), hashlib.sha256(kept).hexdigest()


def colliding():
    """Two texts of 200 bytes, equal in their first 64, whose rolling hashes are equal: blocks of alternating bytes, met in the middle."""
    from somaflow.llm import textbytes

    rng = np.random.default_rng(13)
    starts = rng.integers(97, 123, (20_000, 64), dtype=np.uint8)
    g = [int(textbytes.mix(textbytes.Hasher(x).sums[-1:])[0]) for x in starts]
    start = starts[int(np.argmin(g))]  # the anchor of both texts
    swap = np.array([bin(i).count("1") % 2 for i in range(32)], bool)
    power = textbytes.powers(200)[0]
    turn = int((np.where(swap, -1, 1).astype(np.int64).view(np.uint64) * power[:32]).sum(dtype=np.uint64))
    free = 64 - (turn & -turn).bit_length() + 1  # bits of a difference that can differ from zero
    letters = np.arange(33, 127)
    x, y = (k.reshape(-1) for k in np.meshgrid(letters, letters))
    x, y = x[x != y], y[x != y]
    d, mask = textbytes._VALUE[x] - textbytes._VALUE[y], np.uint64((1 << free) - 1)
    pick = rng.integers(0, len(d), (4, 1 << 24))
    sums = [d[p] * power[32 * j] for j, p in enumerate(pick)]
    one, two = (sums[0] + sums[1]) & mask, (np.uint64(0) - sums[2] - sums[3]) & mask
    order = np.argsort(two)
    at = np.minimum(np.searchsorted(two[order], one), len(two) - 1)
    i = int(np.flatnonzero(two[order][at] == one)[0])
    found = [pick[0, i], pick[1, i], pick[2, order[at[i]]], pick[3, order[at[i]]]]
    texts = [bytes(start) + b"".join(np.where(swap == k, x[p], y[p]).astype(np.uint8).tobytes() for p in found) + b"the same" for k in (False, True)]
    hashes = [textbytes.Hasher(np.frombuffer(t, np.uint8)).ranges(np.array([0]), np.array([200]))[0] for t in texts]
    assert hashes[0] == hashes[1] and texts[0] != texts[1]
    return [t.decode() for t in texts]


def test_equal_hashes_are_no_repeats(spark):
    one, two = colliding()
    x = op8_repeats.anchors_of([one.encode(), two.encode()])
    assert x["place"].tolist() == [0, 0] and x["g"][0] == x["g"][1]
    rows = [(1, one), (2, two), (3, "q" * 40 + one), (4, one[:150])]
    got = {r["doc_id"]: r["n_removed"] for r in op8_repeats.trimmed(spark.createDataFrame(rows[:2], "doc_id long, text string")).collect()}
    assert got == {1: 0, 2: 0}
    got = {r["doc_id"]: r["n_removed"] for r in op8_repeats.trimmed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: 200, 2: 0, 3: 200, 4: 0}


@pytest.mark.parametrize("classes", [50_000, 20, 3])
def test_repeats(docs, spark, empty, classes):
    rng = np.random.default_rng(5)
    base = [r["text"] for r in docs.where("length(text) > 700").limit(12).collect()]
    near = []
    for i in range(40):
        a = list(base[i % 3][:3000])
        for _ in range(3):
            a[int(rng.integers(len(a)))] = "Z"
        near.append("".join(a))
    extra = near + ["ab" * 300, "x" * 500, "x" * 199, "x" * 200, base[5][:250] + base[6][:250] + base[5][100:330], None, ""]
    df = docs.where("length(text) < 20000 OR text IS NULL").select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 5000)), "doc_id long, text string"))
    keep, op8_repeats.CLASSES = op8_repeats.CLASSES, classes
    try:
        got = collections.Counter(tuple(r) for r in op8_repeats.trimmed(df).collect())
    finally:
        op8_repeats.CLASSES = keep
    rows = df.collect()
    assert got == collections.Counter((r["doc_id"], *x) for r, x in zip(rows, removed([(r["text"] or "").encode() for r in rows])))
    assert op8_repeats.trimmed(empty).count() == 0


# -- 9 personal data

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def base_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            d = re.sub("[^0-9]", "", m[0])
            if kind == "ip" and any(int(x) > 255 for x in m[0].split(".")) or kind == "card" and not (16 <= len(d) <= 19 and op9_pii.luhn(d)) or kind == "phone" and not 8 <= len(d) <= 15:
                continue
            out.append((kind, m.start(), m.end()))
    return out


def test_base_spans_of_random_texts():
    rng = random.Random(6)
    texts = ["".join(rng.choice("a1.@-+ (4é%") for _ in range(50)) for _ in range(8000)] + ["4111 1111 1111 1111", "4111-1111-1111-1111 2", "1.2.3.4.5", "+1 (262) 555-3752.", "1" * 3000, "a" * 5000 + "@b", "0255.1.1.1"]
    for t in texts:
        assert op9_pii.base_spans(t) == base_spans(t)


def test_pii(docs, spark, empty):
    extra = ["mail a.b@c.org or call (269) 555-3296", "card 4111111111111111 ssn 123-45-6789", "write to joe at example dot com", "IBAN DE89 3704 0044 0532 0130 00."]
    df = docs.select("doc_id", "text").unionByName(spark.createDataFrame(list(enumerate(extra, 9000)), "doc_id long, text string"))
    texts = collections.defaultdict(list)
    for r in df.collect():
        texts[r["doc_id"]].append(base_spans(r["text"] or ""))
    line = lambda spans: ",".join(f"{k}:{a}:{b}" for k, a, b in spans)
    for r in op9_pii.detected(df).collect():
        want = [s for s in texts[r["doc_id"]] if hashlib.sha256(line(s).encode()).hexdigest() == r["base_sha256"]]
        assert want and [r[f"n_{k}"] for k in op9_pii.KINDS] == [sum(s[0] == k for s in want[0]) for k in op9_pii.KINDS]
        assert set(filter(None, line(want[0]).split(","))) <= set(filter(None, r["spans"].split(",")))
    more = op9_pii.found(extra, op9_pii.model())["spans"]
    assert "phone_local" in more[0] and "national" in more[1] and "email_text" in more[2] and "iban" in more[3]
    trees = op9_pii.model()
    assert all(trees[k].quality[0] >= 0.9 and trees[k].quality[1] >= 0.6 for k in op9_pii.MORE)  # on phrases that weren't learned
    key = "04dbebab91ab85687d33eeaaf9ac699e1188f962"
    yes = [f'x token = "{key}" y', f"export API_KEY={key}", "passport 123456789 of the guest", "her social security number is 123-45-6789"]
    no = [f"commit {key} fixes it", f"sha256 {key}", "Order 123-45-6789 shipped", "a population of 123456789", "https://example.com/a/b/2024-10-10-some-long-page.html", "on 9807915762804490 the"]
    assert all(op9_pii.found(yes, trees)["n_spans"]) and not any(op9_pii.found(no, trees)["n_spans"])
    assert op9_pii.redact("x a@b.c y", [("email", 2, 7)]) == "x [email] y"
    assert op9_pii.detected(empty).count() == 0


def test_added_spans_equal_every_candidate_judged_alone(docs):
    """Candidates by a plain scan of each pattern, containment and distance by comparing all pairs."""
    trees = op9_pii.model()
    rng = random.Random(16)
    bits = ["a.b@c.org", "4111111111111111", "123-45-6789", "(269) 555-3296", "token = \"" + "0a1" * 12 + "\"", "1.2.3.4", "DE89 3704 0044 0532 0130 00", "passport 123456789", "order", "joe at example dot com", "é", "and", "ssn:"]
    texts = [" ".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(150)] + [r["text"] or "" for r in docs.collect()]
    got = op9_pii.found(texts, trees)
    for t, line, n in zip(texts, got["spans"], got["n_spans"]):
        base = base_spans(t)
        held = []
        address = re.compile(r"(?<![\w.-])[._-]*([A-Za-z0-9][A-Za-z0-9._-]+ ?(?:\(at\)|\[at\]| at ) ?[A-Za-z0-9-]{2,} ?(?:\(dot\)|\[dot\]| dot ) ?[A-Za-z]{2,10}\b)")
        for kind, pattern in [("email_text", address), *op9_pii._LOOSE.items()]:
            for m in pattern.finditer(t):
                a, b = m.span(1) if kind == "email_text" else m.span()
                if any(x <= a and b <= y for _, x, y in base):
                    continue
                near = min([op9_pii.NEAR, *(max(0, a - y, x - b) for _, x, y in base)])
                if trees[kind].predict(np.array([op9_pii.features(t, kind, a, b, near)], float))[0] >= trees[kind].threshold:
                    held.append((kind, a, b))
        inner = lambda z: any(w[1] <= z[1] and z[2] <= w[2] and (w[2] - w[1], -op9_pii.MORE.index(w[0])) > (z[2] - z[1], -op9_pii.MORE.index(z[0])) for w in held)
        want = base + sorted((z for z in held if not inner(z)), key=lambda z: (op9_pii.MORE.index(z[0]), z[1]))
        assert line == ",".join(f"{k}:{a}:{b}" for k, a, b in want) and n == len(want)
        redacted = op9_pii.redact(t, [(k, a, b) for k, a, b in want])
        assert all(t[a:b] not in redacted or t.count(t[a:b]) > 1 for _, a, b in want)


def test_secrets_and_addresses_of_any_length():
    rng = random.Random(17)
    letters = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789-_"
    trees = op9_pii.model()
    for size in (103, 201, 202, 500, 1000, 5000):
        key = "eyJ" + "".join(rng.choice(letters) for _ in range(size - 4)) + "7"
        text = f'we set token = "{key}" there'
        assert ("secret", text.index(key), text.index(key) + size) in op9_pii.candidates(text)
        assert f"secret:{text.index(key)}:{text.index(key) + size}" in op9_pii.found([text], trees)["spans"][0]
        name = "a" + "b.c-" * (size // 4) + "d"
        text = f"contact {name} (at) {'x' * size} dot org now"
        assert op9_pii.candidates(text) == [("email_text", 8, len(text) - 4)]
    # long runs cost their length, not its square
    start = __import__("time").process_time()
    for run in ("a-" * 200_000, "1" * 400_000, "ab_" * 100_000 + " at ", "x1/" * 100_000 + "!", "a at " * 50_000 + "dot", "--" * 100_000 + "1"):
        op9_pii.candidates(run)
    assert __import__("time").process_time() - start < 5


def test_boosting_learns_an_interaction():
    rng = np.random.default_rng(7)
    x = rng.random((2000, 4))
    y = ((x[:, 0] > 0.5) != (x[:, 1] > 0.5)).astype(float)
    m = Boosted(rounds=40).fit(x[:1500], y[:1500]).calibrate(x[1500:], y[1500:], 0.95)
    p = m.predict(x[1500:]) >= m.threshold
    assert y[1500:][p].mean() >= 0.95 and p.mean() > 0.3


# -- 10 toxicity


@pytest.fixture(scope="module")
def toxic(spark):
    rng = random.Random(8)
    clean, bad = [f"word{i}" for i in range(300)], ["vilescum", "grossfool", "nastyrat"]
    rows, marks = [], []
    for i in range(900):
        w = [rng.choice(clean) for _ in range(rng.randrange(5, 120))]
        if i % 3 == 0:
            for _ in range(1 + len(w) // 30):
                b = rng.choice(bad)
                w.insert(rng.randrange(len(w)), b[:5] + rng.choice("xyz") * (i % 2) + b[5:])
        rows.append((i, " ".join(w), "en", "s", 0))
        marks.append((i, 1, int(i % 3 == 0)))
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_on_held_out_rows(spark, toxic, docs, empty):
    texts, labels = toxic
    model = op10_toxicity.fit(texts, labels)
    rows = op10_toxicity.scored(texts, model).collect()
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and r["predicted"] == int(r["score"] >= 0.7) for r in rows)
    held = [r for r in rows if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95
    kept = op10_toxicity.clean_documents(texts, model)
    assert kept.columns == texts.columns and kept.count() == sum(not r["predicted"] for r in rows)
    odd = op10_toxicity.scored(docs, model).collect()
    assert len(odd) == docs.count() and all(0 <= r["score"] <= 1 for r in odd)
    # held-out labels don't matter, nor do other columns
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 3 = 1 THEN 1 - toxic ELSE toxic END AS toxic")
    again = op10_toxicity.fit(texts.selectExpr("doc_id", "text", "'x' AS lang", "'y' AS source", "1L AS n_chars"), flipped)
    assert np.allclose(again.weight, model.weight, atol=1e-4)
    none = op10_toxicity.fit(texts, labels.limit(0))
    assert op10_toxicity.scored(texts, none).where("predicted = 1").count() == 0
    assert op10_toxicity.scored(empty, none).count() == 0


def test_a_text_too_long_to_learn_from_leaves_itself_out_alone(spark, toxic):
    texts, labels = toxic
    first = min((hashlib.md5(str(i).encode()).hexdigest(), i) for i in range(900) if zlib.crc32(str(i).encode()) % 3 != 1)[1]
    long = spark.createDataFrame([(first, "word1 word2 " * (13 << 20 >> 3) + "end", "en", "s", 0)], SCHEMA)
    model = op10_toxicity.fit(texts.where(f"doc_id <> {first}").unionByName(long), labels)
    held = [r for r in op10_toxicity.scored(texts, model).collect() if r["held_out"]]
    assert np.mean([r["predicted"] == (r["doc_id"] % 3 == 0) for r in held]) > 0.95


def test_each_class_has_its_share_of_the_sample():
    rows = [(b"x" * 9, 0), (b"c" * 3, 0), (b"d" * 3, 0), (b"t" * 4, 1), (b"u", 0)]
    assert op10_toxicity.fitting(rows, 8) == ([b"c" * 3, b"t" * 4, b"u"], [0, 1, 0])
    assert op10_toxicity.fitting(rows, 11) == ([b"c" * 3, b"d" * 3, b"t" * 4, b"u"], [0, 0, 1, 0])
    assert op10_toxicity.fitting(rows, 20) == ([r for r, _ in rows], [m for _, m in rows])


# -- pipeline


def test_pipeline_stage_by_stage(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = docs
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, SF)
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        old, new = ([tuple(r) for r in df.collect()] for df in (before, out))
        if k < 4:
            assert out.columns == docs.columns and set(map(repr, new)) <= set(map(repr, old))
        if k == 0:
            model = op10_toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
            assert len(new) == op10_toxicity.scored(before, model).where("predicted = 0").count()
        if k == 1:
            fps = np.array([fingerprint(r[1]) for r in old], np.uint64)
            root = linked(fps)
            assert {r[0] for r in new} == {min(old[i][0] for i in np.flatnonzero(root == g)) for g in set(root.tolist())} and len(new) == len(set(root.tolist()))
        if k == 2:
            items = [(str(r["item_id"]), r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
            flags = contamination([r[1] for r in old], items)
            assert sorted(r[0] for r in new) == sorted(r[0] for r, f in zip(old, flags) if not f[4])
        if k == 3:
            taken = {r["doc_id"]: r["_copies"] for r in op1_mixing.mix(before).collect()}
            assert collections.Counter(r[0] for r in new) == collections.Counter({d: n for d, n in taken.items() if n})
        if k == 4:
            assert len(new) == len(old)
        before = out
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(new)


def test_pipeline_with_hard_rows(docs, spark, tmp_path):
    """Nulls in every column, odd and repeated rows, rows without ids, an extra column, clashing names; and an empty table."""
    hard = docs.withColumnRenamed("words", "_copies").withColumn("_key", op1_mixing.F.lit("k")).withColumn("row", op1_mixing.F.lit(1))
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/full/{name}.parquet")
        spark.read.parquet(f"{SF}/{name}.parquet").write.parquet(f"{tmp_path}/none/{name}.parquet")
    hard.write.parquet(f"{tmp_path}/full/documents.parquet")
    hard.limit(0).write.parquet(f"{tmp_path}/none/documents.parquet")
    before = spark.read.parquet(f"{tmp_path}/full/documents.parquet")
    counts = [before.count()]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, before, f"{tmp_path}/full")
        out.write.parquet(f"{tmp_path}/{k}")
        out = spark.read.parquet(f"{tmp_path}/{k}")
        counts.append(out.count())
        if k < 4:
            assert out.columns == hard.columns
            assert set(map(repr, out.collect())) <= set(map(repr, before.collect()))
        before = out
    assert counts[1] >= counts[2] >= counts[3] > 0 and counts[4] == counts[5] > 0
    assert corpus_pipeline.run(spark, f"{tmp_path}/full").count() == counts[5]
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0


def test_a_run_leaves_only_its_last_files(spark, tmp_path):
    import os

    shared = spark.conf.get("spark.checkpoint.dir").removeprefix("file://")
    before = set(os.listdir(shared))
    corpus_pipeline.run(spark, SF).count()
    left = {x.rsplit("-", 1)[0] for x in set(os.listdir(shared)) - before}
    assert left and not left & {"stage1", "stage2", "stage3", "texts", "simhash-rows", "benchmark", "mix-sizes"}
