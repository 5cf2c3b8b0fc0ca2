"""Spelling variants, the additive quality model, the filter audit."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations, permutations

import numpy as np
import pytest
from pyspark.sql import functions as F

from latticework.llm import additive, audit, queries, spelling
from tests.llm.conftest import SF

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def words_of(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in RUN.findall(text or ""):
            word = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{word}".encode())
            at = h % len(word)
            out[word[:at] + word[at + 1 :] if h % 97 == 0 else word] += 1
    return {w: n for w, n in out.items() if len(w) >= 5 and n >= 3}


def grouped(words):
    """Variants by comparing all pairs."""
    near = defaultdict(list)
    for a, b in combinations(words, 2):
        if one_edit(a, b):
            near[a].append(b)
            near[b].append(a)
    form = {}
    for w, n in words.items():
        best = min(near[w], key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 2 * n else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return {(w, form[w], root(w), n, len(near[w]), words[form[w]] if form[w] else None) for w, n in words.items()}


def dense_words(rng, n):
    """Words over few letters, so that many are one edit apart; runs of one letter, letters beyond ASCII."""
    out = {"".join(rng.choice("abé") for _ in range(rng.randint(5, 8))) for _ in range(n)} | {"aaaaa", "aaaaaa", "aaaaaaa", "abcdefghijklmnop", "abcdefghijklmnopq", "bcdefghijklmnop"}
    return {w: rng.randint(3, 40) for w in sorted(out)}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_variants_equal_all_pairs(spark, seed):
    words = dense_words(random.Random(seed), 250)
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == grouped(words) and got.count() == len(words)


def test_a_cell_holds_each_pair_once(spark):
    """Every near pair meets in some cell; the index finds it in exactly one."""
    words = dense_words(random.Random(5), 120)
    cells = defaultdict(list)
    for r in spelling.cells(spark.createDataFrame(list(words.items()), "word string, n long")).collect():
        cells[r.shorter, r.chunk, r.kept].append(r)
    found = Counter()
    for (_, chunk, _), rows in cells.items():
        for a, b in spelling.near_in_cell([(r.extra, r.middle) for r in rows], chunk):
            found[frozenset((rows[a].word, rows[b].word))] += 1
    assert found == Counter(frozenset(p) for p in combinations(words, 2) if one_edit(*p))


def test_short_words_and_single_letters(spark):
    words = {"a": 3, "b": 9, "ab": 4, "abc": 30, "é": 1}
    got = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"))
    assert {tuple(r) for r in got.select("word", "form", "root", "n", "n_near", "form_n").collect()} == grouped(words)


def test_spelling_query(spark, texts):
    got = {tuple(r) for r in queries.op11_spelling(spark, SF).collect()}
    assert got == grouped(words_of(texts.items())) and len(got) > 1000


def test_vocabulary_odd(odd, none, odd_rows):
    assert {r.word: r.n for r in spelling.vocabulary(odd).collect()} == words_of((r[0], r[1]) for r in odd_rows)
    assert spelling.spelling_variants(none).count() == 0


def test_long_texts_are_cut_between_words(monkeypatch):
    text = "some words and a-very" + "long" * 30 + " run Ünd more"
    whole = spelling.counted(7, text, 97)
    monkeypatch.setattr(spelling, "SLICE", 5)
    assert spelling.counted(7, text, 97) == whole and max(map(len, whole)) == 124


def by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    if not words:
        return dict.fromkeys(["words", "distinct_words", "commonest_word", "short_words", "long_words", "capitals", "upper", "mark", "lines"], 0.0)
    inside = len("".join(words).encode())
    return {
        "words": np.log1p(len(words)),
        "distinct_words": len(set(words)) / len(words),
        "commonest_word": max(Counter(words).values()) / len(words),
        "short_words": sum(len(w) <= 2 for w in words) / len(words),
        "long_words": sum(len(w) >= 15 for w in words) / len(words),
        "capitals": sum("A" <= w[0] <= "Z" for w in words) / len(words),
        "upper": len(re.findall("[A-Z]", text)) / inside,
        "mark": len(re.findall("[#*$%&]", text)) / inside,
        "lines": np.log1p(text.count("\n") + 1),
    }


def test_features(odd, odd_rows):
    got = sorted((tuple(round(r[k], 4) for k in by_hand("")) for r in additive.with_features(odd).collect()))
    assert got == sorted(tuple(round(float(np.float32(v)), 4) for v in by_hand(r[1]).values()) for r in odd_rows)


def test_quality_model_held_out(spark, documents):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    got = queries.op12_quality_model(spark, "/root/testdata/sf0.01").toPandas()
    assert list(got.columns) == ["doc_id", "held_out", "score", "predicted"] and len(got) == 1000
    assert ((got.score >= 0.7) == (got.predicted == 1)).all() and got.score.between(0, 1).all()
    known = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").toPandas()
    both = got[got.held_out].merge(known, on="doc_id")
    assert (both.predicted == both.quality).mean() >= 0.95 and len(both) > 50
    assert labels.count() > 0


def test_quality_model_odd(spark, odd, none, odd_rows):
    labels = spark.createDataFrame([(0, 1, 0), (0, 0, 0), (4, None, 0), (None, 1, 0), (11, 0, 0), (6, 0, 1)], "doc_id long, quality int, toxic int")
    got = additive.classified(odd, labels).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in odd_rows) and all(0 <= r["score"] <= 1 for r in got)
    assert additive.classified(none, labels).count() == 0
    assert {r["score"] for r in additive.classified(odd, labels.limit(0)).collect()} == {0.5}


def test_additions_are_the_score():
    """A score is the logistic function of one table entry for each feature and pair."""
    rng = np.random.default_rng(3)
    x = rng.random((800, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)  # no feature tells alone, a pair does
    m = additive.fit(x, y)
    for row, s in zip(x[:20], m.score(x[:20])):
        total = m.base + sum(t[np.searchsorted(b, v)] for b, t, v in zip(m.bounds, m.tables, row))
        total += sum(t[np.searchsorted(m.coarse[i], row[i]), np.searchsorted(m.coarse[j], row[j])] for i, j, t in m.pairs)
        assert abs(1 / (1 + np.exp(-total)) - s) < 1e-12
    fresh = rng.random((800, 4))
    assert (((fresh[:, 0] > 0.5) ^ (fresh[:, 1] > 0.5)) == (m.score(fresh) > 0.5)).mean() > 0.9
    assert (0, 1) in {(i, j) for i, j, _ in m.pairs}


def audited(docs, labels):
    """Every order, one document after the other."""
    good, toxic = {r[0] for r in labels if r[1] == 1}, {r[0] for r in labels if r[2] == 1}
    least = {}
    for doc_id, text, _ in docs:
        if doc_id is not None:
            least[text or ""] = min(doc_id, least.get(text or "", doc_id))
    failed = []
    for doc_id, text, part in docs:
        text = text or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", text)
        fails = {"A": len(words) < 50, "B": 100 * len(set(words)) < 65 * len(words), "C": 100 * len(re.findall("[A-Z]", text)) > 5 * len(text), "D": bool(re.search(r"[#$%&*|]", text)), "E": doc_id is not None and doc_id > least[text]}
        failed.append((part or "", fails, doc_id in good, doc_id in toxic))
    out = {}
    for order in map("".join, permutations("ABCDE")):
        for part in {f[0] for f in failed}:
            left, seen = [f for f in failed if f[0] == part], [f for f in failed if f[0] == part]
            for step, c in enumerate(order, 1):
                gone = [f for f in left if f[1][c]]
                left = [f for f in left if not f[1][c]]
                alone = sum(f[1][c] and sum(f[1].values()) == 1 for f in seen)
                out[part, order, step] = [len(left), len(gone), sum(f[1][c] for f in seen) - len(gone), alone, sum(f[2] for f in gone), sum(f[3] for f in gone)]
    for part, c in {(p, o[s - 1]) for p, o, s in out}:
        steps = [v for (p, o, s), v in out.items() if p == part and o[s - 1] == c]
        total = sum(v[1] for v in steps)
        for v in steps:
            v.append(total)
    return {(*k, *v) for k, v in out.items()}


def test_audit_odd(spark, odd, none, odd_rows):
    labels = [(0, 1, 0), (0, 0, 1), (3, 0, 1), (4, None, None), (None, 1, 1), (12, 1, 1)]
    table = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    mixed = odd.withColumn("source", F.when(F.col("doc_id") % 3 > 0, F.lit("s")))
    rows = [(r[0], r[1], "s" if r[0] is not None and r[0] % 3 > 0 else None) for r in odd_rows]
    known = [(i, max(v[1] or 0 for v in labels if v[0] == i), max(v[2] or 0 for v in labels if v[0] == i)) for i in {v[0] for v in labels} - {None}]
    got = audit.filter_audit(mixed, table).collect()
    assert {tuple(r) for r in got} == audited(rows, known) and len(got) == 2 * 600
    assert audit.filter_audit(none, table).count() == 0
    assert audit.filter_audit(mixed, table.limit(0)).agg(F.sum("good_lost")).first()[0] == 0
