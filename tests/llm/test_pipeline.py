"""Each stage of the pipeline, on what the one before it kept, against brute force; odd rows and none."""

from __future__ import annotations

import corpus_pipeline
import numpy as np
from latticework.llm import langid, quality
from latticework.llm.common import buffers
from tests.llm.conftest import SF
from tests.llm.test_pair_operators import cut_by_hand, sets_and_links, whole
from tests.llm.test_text_operators import counted


def rows_of(df):
    return {r["doc_id"]: r for r in df.collect()}


def test_stages(spark, documents):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_rules", "near_duplicates", "suffix_dedup", "packing"]
    stage = dict(corpus_pipeline.STAGES)
    known = stage["language_id"](spark, documents, SF)
    assert known.columns == documents.columns
    labelled = langid.teaching(documents)
    net = langid.learn(labelled)
    least = langid.least_score(labelled, net)
    told = {r["doc_id"] for r in langid.identify(documents, net).collect() if r["lang_pred"] != "und" and r["score"] >= least}
    kept = rows_of(known)
    assert kept.keys() == told and len(told) > 0.9 * documents.count()

    good = rows_of(stage["quality_rules"](spark, known, SF))
    for i, r in kept.items():
        n_words, _, _, _, n_repeat = counted(r["text"])
        if n_words < 20 or 100 * n_repeat > 30 * n_words:
            assert i not in good
        else:
            data, at = buffers(__import__("pyarrow").array([r["text"]]))
            assert (i in good) == bool(quality.verdict(quality.measure(data, at))[1][0])

    apart = stage["near_duplicates"](spark, spark.createDataFrame(list(good.values()), documents.schema), SF)
    classes = sets_and_links([(i, r["text"]) for i, r in good.items()])
    one = rows_of(apart)
    assert one.keys() == {c for c, _ in classes.values()} and all(one[i] == good[i] for i in one)

    cut = rows_of(stage["suffix_dedup"](spark, apart, SF))
    wanted = cut_by_hand([(i, r["text"]) for i, r in one.items()])
    for i, r in cut.items():
        n, removed, _, _ = wanted[i]
        assert n - removed - 8 <= len(r["text"].encode()) <= n - removed and r["n_chars"] == len(r["text"])  # letters cut in two go whole
    assert cut.keys() == one.keys()

    pieces = stage["packing"](spark, spark.createDataFrame(list(cut.values()), documents.schema), SF).collect()
    whole(pieces, {i: r["text"] for i, r in cut.items()})


def test_whole_pipeline(spark):
    out = corpus_pipeline.run(spark, SF).collect()
    ids = {r["doc_id"] for r in out}
    assert ids and sum(r["length"] for r in out) == sum({r["doc_id"]: r["doc_tokens"] for r in out}.values())


def test_odd_rows_and_none(spark, odd, none):
    for df in (odd, none):
        docs = df
        for _, stage in corpus_pipeline.STAGES[:-1]:
            docs = stage(spark, docs, SF)
            assert docs.columns == df.columns
            docs = spark.createDataFrame(docs.collect(), df.schema)
        assert corpus_pipeline.STAGES[-1][1](spark, docs, SF).count() >= docs.count() >= 0


def test_doubtful_languages_are_learnt(spark):
    """Labels that contradict the text make low scores untrue: up to there the filter rejects."""
    rows = [(i, ("abc def ghi " if i % 2 else "xyz uvw rst ") * 8, "a" if i % 2 else "b") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    net = langid.learn(df)
    assert langid.least_score(df, net) == 0.0
    score = np.array([r["score"] for r in langid.identify(df, net).collect()])
    wrong = spark.createDataFrame([(i, t, "b" if v == "a" else "a") for i, t, v in rows], df.schema)
    assert abs(langid.least_score(wrong, net) - score.max()) < 0.01
    assert langid.least_score(df.limit(0), net) == 0.0


def test_the_threshold_is_judged_on_all_rows(spark):
    """Every labelled text is looked at, however many there are."""
    rows = [(i, "abc def ghi " * 8, "a") for i in range(30_000)] + [(40_000 + i, "xyz uvw rst " * 8, "b") for i in range(30)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    judged = spark.sparkContext.accumulator(0)

    class Counted(langid.ByteNet):
        def probabilities(self, windows):
            judged.add(len(windows))
            return super().probabilities(windows)

    net = langid.learn(df)
    counted_net = Counted(**{k: v for k, v in net.__dict__.items() if not k.startswith("_")})
    langid.least_score(df, counted_net)
    assert judged.value == len(rows)
