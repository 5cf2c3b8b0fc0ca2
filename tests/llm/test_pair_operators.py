"""Sharding, Jaccard join, SentencePiece, substring dedup, packing."""

from __future__ import annotations

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from latticework.llm import components, jaccard, packing, pieces, sharding, substrings, suffixes, tokens
from latticework.llm.common import buffers

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_shards(documents, texts):
    got = sharding.shuffle_into_shards(documents).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    slots = defaultdict(list)
    for r in got:
        slots[r["shard"]].append(r["slot"])
        assert r["size"] == len(texts[r["doc_id"]].encode()) + 1 and r["text_crc32"] == zlib.crc32(texts[r["doc_id"]].encode())
    assert set(slots) == set(range(8)) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = {(r["doc_id"], r["shard"], r["slot"]) for r in sharding.shuffle_into_shards(documents.repartition(7)).collect()}
    assert again == {(r["doc_id"], r["shard"], r["slot"]) for r in got}  # seed and content decide
    order = [r["doc_id"] for r in sorted(got, key=lambda r: (r["shard"], r["slot"]))]
    assert abs(np.corrcoef(order, range(len(order)))[0, 1]) < 0.3


def test_shards_odd(odd, none, monkeypatch):
    got = sharding.shuffle_into_shards(odd, 3).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter((r["doc_id"], r["text"]) for r in odd.collect())
    assert [r["size"] for r in got if r["text"] is None] == [1, 1]
    assert sharding.shuffle_into_shards(none).count() == 0
    want = sorted(map(str, got))
    monkeypatch.setattr(sharding, "RUN", 2)
    monkeypatch.setattr(sharding, "BROADCAST_ROWS", 0)
    assert sorted(map(str, sharding.shuffle_into_shards(odd.repartition(5), 3).collect())) == want


@pytest.mark.parametrize("n", [9_999, 10_000, 10_001])
def test_shards_very_many_alike(spark, monkeypatch, n):
    """Copies of one row are dealt like other rows: over all buckets and shards, however the table is split."""
    monkeypatch.setattr(sharding, "COPIES", 1000)
    rows = spark.range(n).selectExpr("5L doc_id", "'the same' text").unionByName(spark.range(20).selectExpr("id doc_id", "'another' text"))
    got = sharding.shuffle_into_shards(rows.repartition(6), 8, bucket_bytes=1 << 13).groupBy("shard", "doc_id", "text").count().collect()
    assert sum(r["count"] for r in got) == n + 20
    assert all(abs(r["count"] - n / 8) < n / 40 for r in got if r["text"] == "the same")
    again = sharding.shuffle_into_shards(rows.coalesce(1), 8, bucket_bytes=1 << 13).groupBy("shard", "doc_id", "text").count().collect()
    assert sorted(got) == sorted(again)


def sets_and_links(rows):
    sets = {}
    for i, t in rows:
        w = WORD.findall(t or "")
        sets[i] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
    posting = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            posting[g].append(i)
    parent, links = {i: i for i in sets}, Counter()

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, n in Counter(j for g in s for j in posting[g]).items():
            if i != j and 5 * n >= 4 * (len(s) + len(sets[j]) - n):
                links[i] += 1
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (find(i), links[i]) for i in sets}


def test_jaccard(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text").collect()]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == sets_and_links(rows)


def test_jaccard_in_blocks(spark, monkeypatch):
    """A large group of near copies is verified in several blocks."""
    monkeypatch.setattr(jaccard, "BLOCK_SETS", 7)
    rng = np.random.default_rng(1)
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(40):
        words = list(base)
        for k in rng.integers(0, 200, 4):
            words[k] = f"x{i}_{k}"
        rows.append((i, " ".join(words)))
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == sets_and_links(rows)


def test_jaccard_odd(odd, none):
    got = [(r["doc_id"], r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(odd).collect()]
    assert Counter(i for i, _, _ in got) == Counter(r["doc_id"] for r in odd.collect())
    by_id = {i: (c, n) for i, c, n in got}
    assert by_id[0] == by_id[1] == by_id[2] == (0, 4)  # three rows with id 0, one copy, one near copy
    assert by_id[3] == (3, 0) and by_id[8] == (8, 0) and by_id[None] == (None, 0)
    kept = jaccard.keep_one(odd)
    assert kept.columns == odd.columns
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({i: 1 for i in range(14) if i not in (1, 2)} | {None: 2})
    assert jaccard.jaccard_join(none).count() == 0 and jaccard.keep_one(none).count() == 0


def test_two_texts_under_one_id(spark):
    """Each is a set of its own: neither loses its links, and of each class one row stays."""
    rng = np.random.default_rng(2)
    a, b = (" ".join("".join(rng.choice(list("abcdef"), 5)) for _ in range(60)) for _ in range(2))
    rows = [(1, a, "x"), (1, b, "y"), (2, a + " more", "z"), (3, b + " other", "v"), (3, b + " other", "u"), (4, None, "w")]
    df = spark.createDataFrame(rows, "doc_id long, text string, again string")
    got = sorted((r["doc_id"], r["n_links"], r["class_id"]) for r in jaccard.jaccard_join(df).collect())
    assert got == [(1, 1, 1), (1, 2, 1), (2, 1, 1), (3, 2, 1), (3, 2, 1), (4, 0, 4)]
    kept = {(r["doc_id"], r["text"], r["again"]) for r in jaccard.keep_one(df).collect()}
    assert kept == {(1, a, "x"), (1, b, "y"), (4, None, "w")}
    only = spark.createDataFrame(rows[3:5] + rows[5:], df.schema)
    assert {(r["doc_id"], r["again"]) for r in jaccard.keep_one(only).collect()} == {(3, "u"), (4, "w")}


@pytest.mark.parametrize("few", [True, False])
def test_overlaps(few):
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 60 if not few else 5000, rng.integers(1, 80))).astype(np.uint64) for _ in range(30)]
    left, right = np.arange(0, 20), np.arange(10, 30)
    got = jaccard.overlaps(sets, left, right)
    for a, i in enumerate(left):
        for b, j in enumerate(right):
            assert i == j or got[a, b] == len(np.intersect1d(sets[i], sets[j]))


def test_components(spark):
    edges = [(i, i + 1) for i in range(0, 40)] + [(100, 200), (200, 100), (7, 7), (300, 100), (55, 54)]
    got = {r["node"]: r["component"] for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 200: 100, 300: 100, 54: 54, 55: 54}


def test_recall_decides_the_prefix():
    k = jaccard.prefix_length(0.8, jaccard.TREES, jaccard.LONGEST_PREFIX, jaccard.RECALL)
    assert 1 - (1 - 0.8**k) ** jaccard.TREES >= jaccard.RECALL > 1 - (1 - 0.8 ** (k + 1)) ** jaccard.TREES


def test_prefixes_shorten_until_the_recall(spark, monkeypatch):
    """Copies that are very near all meet by the longest prefixes; links of the least similarity need shorter ones."""
    used, nodes = [], jaccard.nodes
    monkeypatch.setattr(jaccard, "nodes", lambda s, trees, longest, prefix: used.append(prefix) or nodes(s, trees, longest, prefix))
    base = [[f"w{k}_{i}" for i in range(200)] for k in range(30)]
    near = [(2 * k + j, " ".join(b[: 200 - j])) for k, b in enumerate(base) for j in (0, 1)]
    far = [(2 * k + j, " ".join(b[: 200 - 38 * j])) for k, b in enumerate(base) for j in (0, 1)]
    for rows, shortened in ((near, False), (far, True)):
        used.clear()
        got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
        assert got == sets_and_links(rows) and used[0] == 8 and used == sorted(set(used), reverse=True) and (used[-1] < 7) == shortened


def test_tries_by_hand(spark):
    """Two signatures lie below one node at a depth if and only if the tree's first so many minima agree."""
    rng = np.random.default_rng(3)
    signs = rng.integers(0, 2, (40, 6)).astype(np.uint16)
    df = spark.createDataFrame([(i, x.tobytes()) for i, x in enumerate(signs)], "i int, s binary")
    for depth in (1, 2, 3):
        got = {r["i"]: r["n"] for r in df.select("i", jaccard.nodes(df["s"], 2, 3, depth).alias("n")).collect()}
        for a in range(40):
            for b in range(40):
                assert [x == y for x, y in zip(got[a], got[b])] == [bool((signs[a, 3 * t : 3 * t + depth] == signs[b, 3 * t : 3 * t + depth]).all()) for t in range(2)]


def test_pieces(spark, documents, odd, none):
    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for df in (documents, odd):
        for text, r in ((x["text"] or "", x) for x in df.select("doc_id", "text").join(pieces.coded(df), "doc_id").collect()):
            if df is documents:
                assert np.frombuffer(r["ids"], "<u4").tolist() == model.encode(text)
                assert r["decoded"] == text and r["exact"]
    for text in ["a", " a", "  a b", "a  ", "", "é漢字\t\n", "Hello▁x", "▁", "é", "<s> </s> <0x41>", " ", "   ", "a" * 300, "\x00 x\x00", "▁▁ a ▁"]:
        p = pieces.pieces_of("piece_bpe_32k")
        (ids,) = p.encode([text])
        assert ids.tolist() == model.encode(text) and p.decode(ids) == model.decode(model.encode(text))
    coded = pieces.coded(odd)
    assert coded.count() == odd.count() and coded.where("not exact").count() == 0
    assert pieces.coded(none).count() == 0
    assert {r["doc_id"]: r["text"] for r in pieces.decoded(pieces.coded(documents)).collect()} == {r["doc_id"]: r["text"] for r in documents.collect()}


def test_long_words(monkeypatch):
    """Ids of words of any length are the library's, in time that grows with the length."""
    import random
    import time

    import public_tokenizers
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    p, rng = pieces.Pieces("piece_bpe_32k"), random.Random(1)
    for n in (pieces.LONG - 1, pieces.LONG, pieces.LONG + 1, 5000):
        for letters in ("ab", "etaoinshrdlu", "aé漢x"):
            word = "".join(rng.choice(letters) for _ in range(n))
            text = f"the {word} and {word[:50]} ends"
            assert p.encode([text])[0].tolist() == model.encode(text)
    times = []
    for n in (20_000, 80_000):
        word = "".join(rng.choice("etaoinshrdlu0123456789") for _ in range(n))
        began = time.perf_counter()
        assert p.encode([word])[0].tolist() == model.encode(word)
        times.append(time.perf_counter() - began)
    assert times[1] < 10 * times[0]


def cut_by_hand(rows, window=50):
    first, out = {}, {}
    for i, t in sorted(rows, key=lambda r: r[0]):
        data = (t or "").encode()
        gone = bytearray(len(data))
        for k in range(len(data) - window + 1):
            w = data[k : k + window]
            if first.setdefault(w, i) < i:
                gone[k : k + window] = b"\1" * window
        kept = bytes(b for b, g in zip(data, gone) if not g)
        out[i] = len(data), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()
    return out


def result(df):
    return {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], hashlib.sha256(bytes(r["kept"])).hexdigest()) for r in df.collect()}


def test_substrings(documents, texts):
    assert result(substrings.dedup(documents)) == cut_by_hand(texts.items())


def test_substrings_small_parts(spark, monkeypatch):
    """Several suffix arrays in a task are merged, and a hot anchor's contexts meet in pairs of blocks."""
    monkeypatch.setattr(substrings, "ARRAY_BYTES", 300)
    monkeypatch.setattr(substrings, "TOGETHER", 3)
    rng = np.random.default_rng(8)
    passage = "".join(rng.choice(list("abcdefg "), 120))
    rows = [(i, "".join(rng.choice(list("klmnop "), 60)) + passage[i % 7 : 110 + i % 5] + "".join(rng.choice(list("klmnop "), 40))) for i in range(40)]
    rows += [(50, "a" * 200), (51, "a" * 120), (52, "ab" * 90), (53, "ab" * 60), (54, "é" * 40), (55, "xé" + "é" * 40)]
    assert result(substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string"))) == cut_by_hand(rows)


def test_substrings_odd(spark, odd, none, odd_rows):
    rows = {r[0]: r[1] for r in odd_rows if r[0] is not None}
    out = substrings.dedup(odd)
    assert out.count() == odd.count()
    assert result(out.where("doc_id is not null")) == cut_by_hand(rows.items())
    assert sorted(r["n_removed"] for r in out.where("doc_id is null").collect()) == [0, 0]
    assert substrings.dedup(none).count() == 0
    less = substrings.without_repeats(odd)
    assert less.columns == odd.columns and less.count() == odd.count()
    # Two texts under one id: each is judged for itself, against smaller ids only.
    rows = [(1, "b" * 80), (1, "c" * 80), (2, "b" * 80), (2, "b" * 80), (2, "d" * 60 + "c" * 55), (3, "c" * 80), (3, "d" * 59)]
    got = substrings.dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert Counter((r["doc_id"], r["n_bytes"], r["n_removed"]) for r in got) == Counter([(1, 80, 0), (1, 80, 0), (2, 80, 80), (2, 80, 80), (2, 115, 55), (3, 80, 80), (3, 59, 59)])


def test_suffix_array():
    rng = np.random.default_rng(1)
    for trial in range(60):
        data = rng.integers(97, 97 + rng.integers(1, 4), int(rng.integers(1, 200))).astype(np.uint8)
        raw = data.tobytes()
        order, _, levels = suffixes.suffix_array(data)
        assert order.tolist() == sorted(range(len(raw)), key=lambda i: raw[i:])
        shared = suffixes.common_prefixes(data, order, levels, 50)
        for k in range(1, len(raw)):
            a, b = raw[order[k] :], raw[order[k - 1] :]
            n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert shared[k] == min(n, 50)


def test_a_table_of_windows_holds_no_number_for_each_of_their_bytes():
    """Memory by byte of text: windows are taken as bytes, and of texts that repeat themselves no ranks deeper than a window are kept."""
    data = np.random.default_rng(5).integers(97, 123, 100_000).astype(np.uint8)
    for text in (data, np.tile(data[:10_000], 10)):
        tracemalloc.start()
        table = suffixes.WindowTable(text, np.array([0, len(text)]), np.array([1]), 50)
        most = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert most < 260 * len(text)
        raw = text.tobytes()
        assert table.strings.tolist() == sorted({raw[i : i + 50] for i in range(len(raw) - 49)})


def whole(rows, texts):
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ids = {i: [*t.encode(x or "", add_special_tokens=False).ids, 1] for i, x in texts.items()}
    by_doc, by_sequence = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_sequence[r["sequence_id"]].append(r)
        assert r["doc_tokens"] == len(ids[r["doc_id"]]) and r["length"] > 0
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        parts.sort(key=lambda r: r["start"])
        assert [x for r in parts for x in np.frombuffer(r["ids"], "<u4").tolist()] == ids[i]
    for parts in by_sequence.values():
        parts.sort(key=lambda r: r["offset"])
        size = 0
        for r in parts:
            assert r["offset"] == size
            size += r["length"]
        assert size <= 2048 and size & (size - 1) == 0


def test_packing(documents, texts):
    whole(packing.packed(documents).collect(), texts)


def test_packing_odd(spark, odd, none, odd_rows):
    rows = packing.packed(odd).where("doc_id is not null and doc_id <> 0").collect()
    texts = {r[0]: r[1] for r in odd_rows if r[0]}
    assert sum(r["length"] for r in rows) == sum({r["doc_id"]: r["doc_tokens"] for r in rows}.values())
    assert {r["doc_id"] for r in rows} == set(texts)
    assert packing.packed(none).count() == 0
    special = {1: "x<|endoftext|>y", 2: " a\n b  c", 3: "it's 'll"}
    whole(packing.packed(spark.createDataFrame(list(special.items()), "doc_id long, text string")).collect(), special)


def shard(rng, n=90):
    """Documents of Zipf-distributed ids, their idf and mean size."""
    docs = [np.append(rng.zipf(1.3, int(rng.integers(1, 300))) % 5000 + 2, 1).astype(np.uint16) for _ in range(n)]
    df = np.bincount(np.concatenate([np.unique(d) for d in docs]), minlength=packing.TERMS)
    return docs, packing.inverse(df, n), float(np.mean([len(d) for d in docs]))


def bm25_by_hand(docs, idf, mean, seed):
    wanted = set(docs[seed].tolist())
    return [sum(packing.weights(c, len(d), idf[t], mean) for t, c in Counter(d.tolist()).items() if t in wanted) for d in docs]


def test_scores_are_bm25_over_all_terms():
    docs, idf, mean = shard(np.random.default_rng(6))
    index = packing.BM25(docs, idf, mean)
    for seed in (0, 17, 89):
        assert np.allclose(index.scores(seed), bm25_by_hand(docs, idf, mean, seed))


def test_dropped_documents_change_no_other_score():
    docs, idf, mean = shard(np.random.default_rng(11))
    index, gone = packing.BM25(docs, idf, mean), np.zeros(90, bool)
    postings = sum(len(np.unique(d)) for d in docs)
    for some in (range(0, 90, 3), range(1, 90, 3)):
        gone[list(some)] = True
        index.drop(gone)
        assert index.rows.size <= packing.COMMON * postings and len(index.doc) < postings / 2
        for seed in (0, 17, 89):
            assert np.allclose(index.scores(seed), np.where(gone, -1, bm25_by_hand(docs, idf, mean, seed)))


def test_windows_take_the_nearest_unused():
    docs, idf, mean = shard(np.random.default_rng(7))
    packer = packing.Packer(256, idf, mean)
    pieces = [p for w in packer.pack(list(range(90)), docs) for p in w]
    assert packer.number == sum(map(len, docs)) // 256
    seen, seed, number = set(), None, -1
    for doc, start, _, _, window, offset in pieces:
        if window != number:
            number, seed = window, doc
        elif doc != seed or start == 0:
            scores = {i: s for i, s in enumerate(bm25_by_hand(docs, idf, mean, seed)) if i not in seen}
            assert scores[doc] >= max(scores.values()) - 1e-9 or doc == min(scores)  # nothing left: the next window's seed begins
        seen.add(doc)
    left = packer.finish()
    assert sum(len(p[2]) for p in pieces + left) == sum(map(len, docs))


def test_pivots_by_hand():
    docs, idf, mean = shard(np.random.default_rng(8))
    pivots = packing.Pivots(docs[:10], idf, mean)
    assert sorted(map(tuple, (np.flatnonzero(c) for c in pivots.table.T))) == sorted(tuple(np.unique(d)) for d in docs[:10])
    for doc, key in zip(docs, pivots.keys(docs, most=700)):
        tf = np.bincount(doc, minlength=packing.TERMS)
        near = pivots.table.T @ packing.weights(tf, len(doc), idf, mean)
        digits = [int(key) // packing.PIVOTS**k % packing.PIVOTS for k in range(packing.NEAREST)][::-1]
        assert np.allclose(near[digits], np.sort(near)[::-1][: packing.NEAREST], rtol=1e-4)


def test_neighbours_of_the_whole_table_meet(spark):
    """Topics of few documents each, dealt over many shards: windows are of one topic, copies lie side by side."""
    rng = np.random.default_rng(5)
    vocabulary = [["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 6)) for _ in range(25)] for _ in range(40)]
    rows = [(i, " ".join(rng.choice(vocabulary[i % 40], 60))) for i in range(1200)]
    out = packing.packed(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), shard_ids=4 << 10).collect()
    windows = defaultdict(Counter)
    for r in out:
        windows[r["sequence_id"]][r["doc_id"] % 40] += r["length"]
    alike = sum(c.most_common(1)[0][1] for c in windows.values()) / sum(r["length"] for r in out)
    assert alike > 0.6


def test_packing_very_many_alike(spark):
    """A third of all rows are copies, many are empty: shards stay bounded, nothing is lost."""
    rows = [(i, "one and the same text " * 20) for i in range(400)] + [(i, None) for i in range(400, 800)] + [(i, f"text {i} " * (i % 50)) for i in range(800, 1200)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    whole(packing.packed(df, shard_ids=2000, shard_rows=50).collect(), dict(rows))


def test_buffers_of_a_slice():
    import pyarrow as pa

    data, at = buffers(pa.array(["ab", None, "é", ""]).slice(1))
    assert bytes(data) == "é".encode() and at.tolist() == [0, 0, 2, 2]
    assert tokens.byte_bpe().encode("").tolist() == []


def test_ids_come_as_an_array(monkeypatch):
    """No list of Python numbers in between, which took a third of the tokenizer's time."""
    from tokenizers import Tokenizer

    import public_tokenizers

    bpe = tokens.ByteBPE()
    monkeypatch.setattr(bpe.ranked, "encode_ordinary", None)
    exact = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for text in ("", " ", "a", "<|endoftext", "endoftext|> <|x|>", "\x00￿\U0010ffff", "é é ​", "line\r\n\n  two\t", "don't 12345 " * 300):
        got = bpe.encode(text)
        assert got.dtype == np.uint16 and got.tolist() == exact.encode(text, add_special_tokens=False).ids
    assert bpe.encode("a<|endoftext|>b").tolist() == exact.encode("a<|endoftext|>b", add_special_tokens=False).ids
