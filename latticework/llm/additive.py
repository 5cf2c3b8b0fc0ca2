"""Quality classifier: a generalised additive model with pairs, whose tables are learnt by cyclic boosting of shallow trees."""

from __future__ import annotations

from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import BYTE_VALUE, U64, SpanHash, buffers, held_out, map_batches, mix, per_text, rounds, stored
from latticework.llm.quality import HEAD, SPACE, measure, spans

#: Labelled rows that the model learns from, about, whatever the table's size.
MAX_ROWS = 20_000
#: Bins of one feature, and of each feature of a pair; pairs; leaves of a tree of one feature.
BINS, PAIR_BINS, PAIRS, LEAVES = 32, 8, 8, 3
#: Step of the boosting, its most rounds, rounds without gain that end it, weight of a leaf's prior.
RATE, ROUNDS, PATIENCE, PRIOR = 0.1, 400, 30, 2.0
#: Score from which a text is called good.
THRESHOLD = 0.7


def byte_class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, np.int64)
    out[list(chars)] = 1
    return out


#: Bytes that are counted, per byte of the text that isn't white space.
CLASSES = {
    "upper": byte_class(bytes(range(65, 91))),
    "lower": byte_class(bytes(range(97, 123))),
    "digit": byte_class(b"0123456789"),
    "beyond_ascii": byte_class(bytes(range(128, 256))),
    "stop": byte_class(b".,;:?"),
    "shout": byte_class(b"!"),
    "bracket": byte_class(b"()[]{}<>"),
    "rule": byte_class(b"|_=+~-"),
    "mark": byte_class(b"#*$%&"),
    "address": byte_class(b"@/\\"),
    "control": byte_class(bytes(range(9)) + bytes(range(14, 32)) + b"\x7f"),
}
FEATURES = [
    "words", "word_chars", "long_words", "short_words", "distinct_words", "commonest_word", "odd_ends", "capitals", "lines", "line_words", "dup_lines",
    "dup_line_chars", "repeat_words", "dup_5gram_chars", "dup_13gram_chars", *CLASSES,
]


def features(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A row of FEATURES for each text; at: where each begins, and the end. A text without a word has zeros."""
    n_texts = len(at) - 1
    if not len(data):
        return np.zeros((n_texts, len(FEATURES)))
    m = measure(data, at)
    starts, ends = spans(~SPACE[data], at)
    first = np.searchsorted(starts, at)
    words, inside = np.maximum(np.diff(first), 1), np.maximum(per_text(np.cumsum(~SPACE[data]), at), 1)
    chars, heads = np.maximum(m["word_chars"], 1), np.concatenate([[0], np.cumsum(HEAD[data])])
    size = heads[ends] - heads[starts]
    owner = np.searchsorted(at, starts, "right") - 1
    hashes = SpanHash(BYTE_VALUE[data]).of(starts, ends) ^ mix(np.arange(1, n_texts + 1, dtype=U64))[owner]
    order = np.lexsort((hashes, owner))
    new = np.ones(len(order), bool)
    new[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (owner[order[1:]] != owner[order[:-1]])
    run = np.flatnonzero(new)
    times = np.diff(np.concatenate([run, [len(order)]]))
    commonest = np.zeros(n_texts, np.int64)
    np.maximum.at(commonest, owner[order[run]], times)
    last, head = data[np.maximum(ends - 1, 0)], data[starts]
    plain = (CLASSES["upper"] + CLASSES["lower"] + CLASSES["digit"] + CLASSES["beyond_ascii"] + CLASSES["stop"]).astype(bool)
    lines = per_text(np.cumsum(data == 10), at) + 1
    share = lambda flags: per_text(np.cumsum(flags), first) / words
    out = {
        "words": np.log1p(m["n_words"]), "word_chars": m["word_chars"] / words, "long_words": share(size >= 15), "short_words": share(size <= 2),
        "distinct_words": np.bincount(owner[order[run]], minlength=n_texts) / words, "commonest_word": commonest / words, "odd_ends": share(~plain[last]),
        "capitals": share(CLASSES["upper"][head]), "lines": np.log1p(lines), "line_words": np.log1p(m["n_words"] / lines), "dup_lines": m["n_dup_lines"] / lines,
        "dup_line_chars": m["dup_line_chars"] / chars, "repeat_words": m["n_repeat_words"] / words, "dup_5gram_chars": m["dup_5gram_chars"] / chars,
        "dup_13gram_chars": m["dup_13gram_chars"] / chars,
    } | {k: per_text(np.cumsum(c[data]), at) / inside for k, c in CLASSES.items()}
    return np.stack([out[k] for k in FEATURES], 1).astype(np.float64) * (m["n_words"] > 0)[:, None]


def with_features(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the features of each row's whole text (null: empty); texts are read in rounds, a longer one on its own."""

    def run(batches):
        for b in batches:
            data, at = buffers(b.column(1))
            parts = [features(data[at[i] : at[j]], at[i : j + 1] - at[i]) for i, j in rounds(at)]
            x = np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c.astype(np.float32)) for c in x.T)], ["doc_id", *FEATURES])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, run, "doc_id long, " + ", ".join(f"{k} float" for k in FEATURES))


def edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Upper bounds of bins of about equal numbers of values; a value that many rows have is a bin of its own."""
    return np.unique(np.quantile(values, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) if len(values) else np.zeros(0)


def leaf_bounds(g: np.ndarray, h: np.ndarray, leaves: int) -> list[int]:
    """Where a tree cuts a row of bins with gradients g and weights h: each time the cut of the greatest gain."""
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:]):
            if b - a < 2:
                continue
            left_g, left_h = np.cumsum(g[a : b - 1]), np.cumsum(h[a : b - 1])
            all_g, all_h = g[a:b].sum(), h[a:b].sum()
            gain = left_g**2 / (left_h + PRIOR) + (all_g - left_g) ** 2 / (all_h - left_h + PRIOR) - all_g**2 / (all_h + PRIOR)
            i = int(np.argmax(gain))
            if gain[i] > best[0]:
                best = (gain[i], a + i + 1)
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    return cuts


def tree_step(g: np.ndarray, h: np.ndarray, leaves: int) -> np.ndarray:
    """What a tree adds to each bin."""
    cuts = leaf_bounds(g, h, leaves)
    values = [g[a:b].sum() / (h[a:b].sum() + PRIOR) for a, b in zip(cuts, cuts[1:])]
    return RATE * np.repeat(values, np.diff(cuts))


def quadrants(g: np.ndarray, h: np.ndarray) -> tuple[float, np.ndarray]:
    """The cross of two cuts through a table of bins that gains most, one in each feature: its gain, and what the tree adds to each bin."""
    total = lambda t: np.stack([a := t.cumsum(0).cumsum(1), a[:, -1:] - a, a[-1:, :] - a, a[-1, -1] - a[:, -1:] - a[-1:, :] + a])
    gs, hs = total(g), total(h)
    gain = (gs**2 / (hs + PRIOR)).sum(0) - g.sum() ** 2 / (h.sum() + PRIOR)
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    value = RATE * gs[:, i, j] / (hs[:, i, j] + PRIOR)
    low, left = np.arange(len(g))[:, None] <= i, np.arange(g.shape[1])[None, :] <= j
    return float(gain[i, j]), np.where(low, np.where(left, value[0], value[1]), np.where(left, value[2], value[3]))


@dataclass
class Model:
    """Additions by bin of each feature and of pairs of features; the score is the logistic function of their sum."""

    bounds: list[np.ndarray] = field(default_factory=list)
    coarse: list[np.ndarray] = field(default_factory=list)
    base: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    pairs: list[tuple[int, int, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of a good text for each row of features."""
        total = np.full(len(x), self.base)
        for values, bounds, table in zip(x.T, self.bounds, self.tables):
            total += table[np.searchsorted(bounds, values)]
        for i, j, table in self.pairs:
            total += table[np.searchsorted(self.coarse[i], x[:, i]), np.searchsorted(self.coarse[j], x[:, j])]
        return 1 / (1 + np.exp(-total))


def boosted(slots: list[np.ndarray], sizes: list[int], y: np.ndarray, start: np.ndarray, test: np.ndarray, tree) -> list[np.ndarray]:
    """Tables (of `sizes`) whose values at a row's `slots` add up, beside `start`, to its log odds: rounds over all tables, one
    small step of a tree each, until rows set aside (`test`) gain nothing for PATIENCE rounds; the tables of the best round.
    """
    tables = [np.zeros(n) for n in sizes]
    best, kept, since, total, learn = np.inf, [t.copy() for t in tables], 0, start.copy(), ~test
    for _ in range(ROUNDS):
        for k, (slot, n) in enumerate(zip(slots, sizes)):
            p = 1 / (1 + np.exp(-total))
            g = np.bincount(slot[learn], (y - p)[learn], n)
            h = np.bincount(slot[learn], (p * (1 - p))[learn], n)
            add = tree(k, g, h)
            tables[k] += add
            total += add[slot]
        loss = np.logaddexp(0, np.where(y == 1, -total, total))[test if test.any() else learn].mean()
        if loss < best - 1e-6:
            best, kept, since = loss, [t.copy() for t in tables], 0
        else:
            since += 1
            if since >= PATIENCE:
                break
    return kept


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """The model of labelled rows: first tables by feature, then, for the pairs that would gain most, tables of what these leave.
    Without a row the score is 0.5 everywhere; with one label only it is close to that label.
    """
    if not len(y):
        return Model()
    m = Model([edges(c, BINS) for c in x.T], [edges(c, PAIR_BINS) for c in x.T], float(np.log((y.sum() + 0.5) / (len(y) - y.sum() + 0.5))))
    test = np.arange(len(y)) % 6 == 5
    slots = [np.searchsorted(b, c) for b, c in zip(m.bounds, x.T)]
    m.tables = boosted(slots, [len(b) + 1 for b in m.bounds], y, np.full(len(y), m.base), test, lambda k, g, h: tree_step(g, h, LEAVES))
    p = m.score(x)
    cells = [np.searchsorted(b, c) for b, c in zip(m.coarse, x.T)]
    shape = [len(b) + 1 for b in m.coarse]
    gains = []
    for i, j in combinations(range(len(shape)), 2):
        slot, n = cells[i] * shape[j] + cells[j], shape[i] * shape[j]
        g, h = np.bincount(slot[~test], (y - p)[~test], n), np.bincount(slot[~test], (p * (1 - p))[~test], n)
        gains.append((quadrants(g.reshape(shape[i], -1), h.reshape(shape[i], -1))[0], i, j))
    chosen = [(i, j) for _, i, j in sorted(gains, key=lambda v: (-v[0], v[1:]))[:PAIRS]]

    def cross(k, g, h):
        i = chosen[k][0]
        return quadrants(g.reshape(shape[i], -1), h.reshape(shape[i], -1))[1].ravel()

    both = boosted([cells[i] * shape[j] + cells[j] for i, j in chosen], [shape[i] * shape[j] for i, j in chosen], y, np.log(p / (1 - p)), test, cross)
    m.pairs = [(i, j, t.reshape(shape[i], shape[j])) for (i, j), t in zip(chosen, both)]
    return m


def learn(rows: DataFrame, labels: DataFrame) -> Model:
    """The model of about MAX_ROWS labelled rows, drawn by a hash of their ids; features and labels only come to the driver.

    Rows held out teach nothing. An id that has several rows of features teaches once, by an arbitrary one; one that `labels` calls good in any row is good.
    Null ids and null labels are left out.
    """
    known = labels.where(labels["doc_id"].isNotNull() & labels["quality"].isNotNull()).groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max("quality").alias("quality"))
    both = rows.where(~held_out()).dropDuplicates(["doc_id"]).join(known, "doc_id")
    n = both.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id"), F.lit("quality")), 2)
    chosen = both.where(draw < int(min(1.0, MAX_ROWS / max(1, n)) * (1 << 62))) if n > MAX_ROWS else both
    sample = chosen.toPandas().sort_values("doc_id")
    return fit(sample[FEATURES].to_numpy(np.float64), (sample["quality"].to_numpy() == 1).astype(np.float64))


def scored(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, score, predicted of rows of features."""

    def run(batches):
        for b in batches:
            x = np.stack([b.column(i + 1).to_numpy(zero_copy_only=False) for i in range(len(FEATURES))], 1).astype(np.float64)
            s = model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= THRESHOLD).astype(np.int32))], ["doc_id", "score", "predicted"])

    return map_batches(rows, run, "doc_id long, score double, predicted int")


def classified(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score (0 to 1, higher: good), predicted (1 if score >= THRESHOLD) of every row of `docs`, learnt from `labels` (doc_id, quality).

    A null text counts as empty; such texts and those without a word have a score too, the model's for features of 0. Repeated rows are scored
    alike, null ids are kept, an empty table gives an empty one. A text of any length is read whole. Texts are read once: features, a hundred bytes a row,
    are written to the shared folder, learnt from and scored.
    """
    rows = stored(with_features(docs, id_col, text_col), "features")
    return scored(rows, learn(rows, labels))
