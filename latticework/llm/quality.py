"""Quality rules on repetition: rolling hashes of word n-grams and lines in numpy."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from latticework.llm.common import BYTE_VALUE, U64, SpanHash, buffers, map_batches, mix, per_text, rounds

#: Lengths of the n-grams of words, and the greatest share of a text's word characters that repeats of each may cover.
NGRAMS = {5: 0.5, 8: 0.4, 13: 0.4}
#: Greatest share of characters in lines equal to an earlier one.
MAX_LINE_SHARE = 0.30
#: Greatest number of symbols for each word.
MAX_SYMBOLS = 0.30
#: Window of the base rule, its least number of words, its greatest share of repeated words in per cent.
BASE_WINDOW, BASE_WORDS, BASE_PERCENT = 8, 20, 30

SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True
SYMBOL = np.zeros(256, np.int64)
SYMBOL[list(b"[#*$%&|<>]"[1:-1])] = 1
HEAD = (np.arange(256) & 0xC0) != 0x80  # bytes that begin a code point

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
COLUMNS = [*COUNTS, "dup_line_chars", *(f"dup_{n}gram_chars" for n in NGRAMS)]


def spans(inside: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of True that don't cross the bounds of texts."""
    n = len(inside)
    bound = np.zeros(n + 1, bool)
    bound[at] = True
    before = np.concatenate([[False], inside[:-1]])
    after = np.concatenate([inside[1:], [False]])
    starts = np.flatnonzero(inside & (~before | bound[:-1]))
    ends = np.flatnonzero(inside & (~after | bound[1:])) + 1
    return starts, ends


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each hash: it occurs twice or more; it occurred before."""
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    later, any_ = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:][same]] = True
    any_[order[1:][same]] = True
    any_[order[:-1][same]] = True
    return any_, later


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts of each text; at: where each begins, and the end."""
    n_texts, zero = len(at) - 1, np.zeros(len(at) - 1, np.int64)
    if not len(data):
        return {k: zero for k in COLUMNS}
    heads = np.concatenate([[0], np.cumsum(HEAD[data])])
    hashed = SpanHash(BYTE_VALUE[data])
    starts, ends = spans(~SPACE[data], at)
    owner = np.searchsorted(at, starts, "right") - 1
    chars = heads[ends] - heads[starts]
    first = np.searchsorted(starts, at)  # of each text, among the words
    out = {"n_words": np.diff(first), "word_chars": per_text(np.cumsum(chars), first), "n_symbols": per_text(np.cumsum(SYMBOL[data]), at)}
    words = hashed.of(starts, ends)
    salt = mix(np.arange(1, n_texts + 1, dtype=U64))
    grams = SpanHash(words)
    for n in sorted({*NGRAMS, BASE_WINDOW}):
        begin = np.arange(max(0, len(words) - n + 1))
        begin = begin[owner[begin] == owner[begin + n - 1]]
        again = begin[repeats(grams.of(begin, begin + n) ^ salt[owner[begin]])[0]]
        edge = np.zeros(len(words) + 1, np.int64)
        edge[again] += 1
        edge[again + n] -= 1
        covered = np.cumsum(edge[:-1]) > 0
        if n == BASE_WINDOW:
            out["n_repeat_words"] = per_text(np.cumsum(covered), first)
        if n in NGRAMS:
            out[f"dup_{n}gram_chars"] = per_text(np.cumsum(covered * chars), first)
    begin, end = spans(data != 10, at)  # empty lines have no word
    has = np.searchsorted(starts, end) > np.searchsorted(starts, begin)
    begin, end = begin[has], end[has]
    line_first = np.searchsorted(begin, at)
    later = repeats(hashed.of(begin, end) ^ salt[np.searchsorted(at, begin, "right") - 1])[1]
    out["n_dup_lines"] = per_text(np.cumsum(later), line_first)
    out["dup_line_chars"] = per_text(np.cumsum(later * (heads[end] - heads[begin])), line_first)
    return {k: out[k].astype(np.int64) for k in COLUMNS}


def verdict(m: dict[str, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which texts fail the base rule, and which are kept."""
    failed = (m["n_words"] < BASE_WORDS) | (100 * m["n_repeat_words"] > BASE_PERCENT * m["n_words"])
    bad = failed | (m["n_symbols"] > MAX_SYMBOLS * m["n_words"]) | (m["dup_line_chars"] > MAX_LINE_SHARE * m["word_chars"])
    for n, most in NGRAMS.items():
        bad = bad | (m[f"dup_{n}gram_chars"] > most * m["word_chars"])
    return failed, ~bad


def judged(column: pa.Array) -> dict[str, np.ndarray]:
    data, at = buffers(column)
    parts = [measure(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in rounds(at)]
    m = {k: np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, np.int64) for k in COLUMNS}
    failed, kept = verdict(m)
    return m | {"base_failed": failed, "kept": kept}


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Repetition counts and a verdict for each row of `docs`; nothing else of a row is carried.

    A null or empty text has no words: all counts 0, it fails the base rule. Repeated rows are judged
    each on its own, the same way; null ids are kept. A text of any length is one round of numpy of its own, as long as
    it is. A share exactly at its bound is kept. An empty table gives an empty table; other columns' names don't matter.
    """

    def run(batches):
        for b in batches:
            r = judged(b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(r[k]) for k in [*COLUMNS, "base_failed", "kept"])], ["doc_id", *COLUMNS, "base_failed", "kept"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"{k} long" for k in COLUMNS) + ", base_failed boolean, kept boolean")


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns, whose text the rules keep; null texts go."""
    where = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(judged(b.column(where))["kept"]))

    return map_batches(docs, run, docs.schema)
