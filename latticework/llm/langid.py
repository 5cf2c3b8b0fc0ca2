"""Language identification by a convolutional network over bytes, trained in numpy."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import buffers, held_out, map_batches, rounds

WINDOW = 256  # bytes
WIDTHS = (2, 3, 4)  # of the filters, in bytes
FILTERS = 8  # of each width
#: Bound of the labelled sample: so many windows of text of each language.
SAMPLE_PER_LANG = 1500
EPOCHS, BATCH, RATE = 12, 128, 0.01
LEAST_STEPS = 600  # of training, where the sample is small
MOST_PIECES = 8  # windows of one text, where few texts are labelled
DRAWS = 1 << 62
#: Scores up to which fewer labelled texts than this share are told right are too low for the filter; judged on all labelled
#: rows, by steps of a thousandth.
RIGHT = 0.5
#: Capital ASCII letters read as small ones.
FOLD = np.arange(256)
FOLD[65:91] += 32


@dataclass
class ByteNet:
    """Filters of several widths over one-hot bytes, the maximum of each over a window, then softmax."""

    langs: list[str]
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, 256, FILTERS)
    bias: np.ndarray = None
    out: np.ndarray = None
    out_bias: np.ndarray = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if not k.startswith("_")}

    def tables(self):
        """The sums of a filter's first two bytes, and of its last two, by pairs of bytes: fewer look-ups for each position."""
        if not hasattr(self, "_tables"):
            f = {w: x[:, FOLD].astype(np.float32) for w, x in self.filters.items()}
            pair = lambda a, b: (a[:, None] + b[None]).reshape(1 << 16, -1)
            self._tables = np.ascontiguousarray(np.hstack([pair(f[w][0], f[w][1]) for w in WIDTHS])), np.ascontiguousarray(f[3][2]), np.ascontiguousarray(pair(f[4][2], f[4][3]))
        return self._tables

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        first, third, last = self.tables()
        found = []
        for at in range(0, len(windows), 128):
            x = windows[at : at + 128]
            code = (x[:, :-1].astype(np.int32) << 8) | x[:, 1:]
            n, most = len(x), WINDOW - 3  # positions at which all filters fit
            y = first.take(code[:, :most].ravel(), axis=0).reshape(n, most, -1)
            y[:, :, FILTERS : 2 * FILTERS] += third.take(x[:, 2 : most + 2].ravel(), axis=0).reshape(n, most, -1)
            y[:, :, 2 * FILTERS :] += last.take(code[:, 2 : most + 2].ravel(), axis=0).reshape(n, most, -1)
            found.append(self.head(y.max(axis=1)))
        return np.concatenate(found)

    def head(self, pooled: np.ndarray) -> np.ndarray:
        z = np.maximum(pooled + self.bias, 0) @ self.out + self.out_bias
        z = np.exp(z - z.max(axis=1, keepdims=True))
        return z / z.sum(axis=1, keepdims=True)


def cut(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows of all texts, filled up with spaces; the text and the bytes of each."""
    size = np.diff(at)
    count = -(-size // WINDOW)
    owner = np.repeat(np.arange(len(size)), count)
    first = np.cumsum(count) - count
    x = np.full(int(count.sum()) * WINDOW, 0x20, np.uint8)
    for i in np.flatnonzero(count):
        x[first[i] * WINDOW : first[i] * WINDOW + size[i]] = data[at[i] : at[i + 1]]
    return x.reshape(-1, WINDOW), owner, np.minimum(WINDOW, size[owner] - (np.arange(len(owner)) - first[owner]) * WINDOW)


def train(texts: list[str], langs: list[str], seed: int = 5) -> ByteNet:
    """Fit the network by Adam on windows of the texts, whole and cut short."""
    names = sorted(set(langs))
    rng = np.random.Generator(np.random.PCG64(seed))
    net = ByteNet(names)
    net.filters = {w: rng.normal(0, 0.3, (w, 256, FILTERS)) for w in WIDTHS}
    h = FILTERS * len(WIDTHS)
    net.bias, net.out, net.out_bias = np.zeros(h), rng.normal(0, 0.3, (h, len(names))), np.zeros(len(names))
    if not texts:
        return net
    x = np.full((len(texts), WINDOW), 0x20, np.uint8)
    for i, t in enumerate(texts):
        b = t.encode()[:WINDOW]
        x[i, : len(b)] = np.frombuffer(b, np.uint8)
    x, y = FOLD[x].astype(np.uint8), np.array([names.index(v) for v in langs])
    params = [net.filters[w] for w in WIDTHS] + [net.bias, net.out, net.out_bias]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in params]
    step = 0
    for _ in range(max(EPOCHS, -(-LEAST_STEPS * BATCH // len(x)))):
        order = rng.permutation(len(x))
        for at in range(0, len(x), BATCH):
            take = order[at : at + BATCH]
            b, n = x[take].copy(), len(take)
            short = rng.random(n) < 0.3  # as the last window of a text, or a short one
            b[np.arange(WINDOW) >= np.where(short, rng.integers(12, WINDOW, n), WINDOW)[:, None]] = 0x20
            pooled, where = [], []
            for w in WIDTHS:
                v = sum(net.filters[w][k][b[:, k : WINDOW - w + 1 + k]] for k in range(w))
                where.append(v.argmax(axis=1))
                pooled.append(np.take_along_axis(v, where[-1][:, None], 1)[:, 0])
            pre = np.hstack(pooled) + net.bias
            act = np.maximum(pre, 0)
            z = act @ net.out + net.out_bias
            p = np.exp(z - z.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            p[np.arange(n), y[take]] -= 1
            p /= n
            d = (p @ net.out.T) * (pre > 0)
            grads = []
            for j, w in enumerate(WIDTHS):
                g, own = np.zeros_like(net.filters[w]), d[:, j * FILTERS : (j + 1) * FILTERS]
                for k in range(w):
                    np.add.at(g[k], (b[np.arange(n)[:, None], where[j] + k], np.arange(FILTERS)[None]), own)
                grads.append(g)
            grads += [d.sum(axis=0), act.T @ p + 1e-4 * net.out, p.sum(axis=0)]
            step += 1
            for q, g, (m, v) in zip(params, grads, moments):
                m += 0.1 * (g - m)
                v += 0.001 * (g * g - v)
                q -= RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return net


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG, seed: int = 5) -> ByteNet:
    """Train on about `per_lang` windows of each language of `labelled`, from a hashed place in each text drawn.

    Rows with a null text or lang teach nothing, windows alike count once. Without any, the network knows no language.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    counts = {r[0]: r[1] for r in rows.groupBy(lang_col).count().collect()}  # a row for each language
    if not counts:
        return ByteNet([])
    draw = F.pmod(F.xxhash64(F.lit(seed), id_col, F.octet_length(text_col)), F.lit(DRAWS))
    share = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, int(DRAWS * min(1.0, per_lang / n)))))
    text = F.col(text_col)
    pieces = F.create_map(*(F.lit(x) for k, n in counts.items() for x in (k, max(1, min(MOST_PIECES, per_lang // n)))))
    start = 1 + F.pmod(F.xxhash64(F.lit(seed + 1), id_col, "piece"), F.greatest(F.lit(1), F.length(text) - WINDOW)).cast("int")
    rows = rows.where(draw < share[F.col(lang_col)]).select(id_col, text_col, lang_col, F.explode(F.sequence(F.lit(1), pieces[F.col(lang_col)])).alias("piece"))
    drawn = rows.select(F.substring(text, start, F.lit(WINDOW)).alias("text"), F.col(lang_col).alias("lang")).distinct().collect()
    drawn = sorted((r["lang"], r["text"]) for r in drawn)
    return train([t for _, t in drawn], [v for v, _ in drawn], seed)


def predicted(net: ByteNet, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Index of the language of each text, -1 for none, and its score."""
    n = len(column)
    best, score = np.full(n, -1), np.zeros(n)
    if not net.langs or not n:
        return best, score
    letter = pc.fill_null(pc.match_substring_regex(column, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    data, at = buffers(column)
    for i, j in rounds(at):
        windows, owner, size = cut(data[at[i] : at[j]], at[i : j + 1] - at[i])
        if not len(windows):
            continue
        p = net.probabilities(windows) * size[:, None]
        total = np.vstack([np.bincount(owner, p[:, k], j - i) for k in range(len(net.langs))]).T
        total /= np.maximum(1, np.bincount(owner, size, j - i))[:, None]
        best[i:j], score[i:j] = total.argmax(axis=1), np.clip(total.max(axis=1), 0, 1)
    return np.where(letter, best, -1), np.where(letter, score, 0.0)


def identify(docs: DataFrame, net: ByteNet, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score of every row, from all windows of its whole text.

    `und` with score 0 where the text is null or has no letter, or the network knows no language. Of languages with equal
    scores the first by name is told. Null ids and repeated rows are kept, an empty table gives an empty table; other
    columns, whatever their names, aren't carried.
    """

    def run(batches):
        names = np.array([*net.langs, "und"], object)
        for b in batches:
            best, score = predicted(net, b.column(1))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(names[best], pa.string()), pa.array(score)], ["doc_id", "lang_pred", "score"])

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, lang_pred string, score double")


def least_score(labelled: DataFrame, net: ByteNet, text_col: str = "text", lang_col: str = "lang", right: float = RIGHT) -> float:
    """The score from which the network is to be believed: up to there fewer than `right` of the labelled texts are told right.

    Judged on every row of `labelled` with a text and a language; 0 without any, or where all are told right.
    """
    if not net.langs:
        return 0.0
    known = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))

    def judge(batches):
        names = np.array([*net.langs, "und"], object)
        for b in batches:
            best, score = predicted(net, b.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((score * 1000).astype(np.int32)), pa.array((names[best] == np.array(b.column(1).to_pylist(), object)).astype(np.int32))], ["step", "hit"])

    found = sorted(map_batches(known, judge, "step int, hit int").groupBy("step").agg(F.count("*").alias("n"), F.sum("hit").alias("hits")).collect())  # a row for each thousandth
    least, seen, hits = 0.0, 0, 0
    for r in found:
        seen, hits = seen + r["n"], hits + r["hits"]
        if hits < right * seen:
            least = (r["step"] + 1) / 1000
    return least


def keep_known(docs: DataFrame, net: ByteNet, text_col: str = "text", min_score: float = 0.0) -> DataFrame:
    """The rows of `docs`, all columns, in a language that the network recognises with at least that score.

    Null texts and those without a letter go; each of repeated rows is judged alike; an empty table gives an empty table.
    """
    where = docs.columns.index(text_col)

    def run(batches):
        for b in batches:
            best, score = predicted(net, b.column(where))
            yield b.filter(pa.array((best >= 0) & (score >= min_score)))

    return map_batches(docs, run, docs.schema)


def teaching(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    return docs.where(~held_out(id_col))
