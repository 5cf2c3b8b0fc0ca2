"""Toxicity by the nearest labelled examples: exact TF-IDF cosine from a block-max inverted index."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import held_out, map_batches, partitions, stored
from latticework.llm.jaccard import sets_of, signatures

#: Bound of the labelled sample: about so many examples of each label.
SAMPLE_PER_LABEL = 2500
#: A term's weight grows with its chi-squared between the labels: from nothing at the bound of chance (5 of 100 terms that
#: tell nothing are above it), by this power, towards all of it well beyond the other value. Every term of some weight is in the index.
CHANCE_CHI2, HALF_CHI2, POWER = 3.841, 25.0, 4
#: Words' beginnings of these lengths are terms too, where so many examples and so great a chi-squared tell the labels apart.
PREFIXES, MIN_EXAMPLES, MIN_CHI2 = range(4, 10), 5, 25.0
#: Weight of a term that every text has: texts without a telling term are near each other, not near what chance gives them.
EVERYWHERE, BACKGROUND = "", 0.3
#: Of examples alike in this many trees' minimum hashes only one weighs terms: copies tell nothing new.
COPY_TREES, COPY_PREFIX = 4, 2
NEAREST = 12  # distinct examples that vote
BLOCK = 32  # examples in a block of the index
FIRST_BLOCKS = 4  # blocks that set the least cosine
FREQUENT = 8  # terms that one in so many examples has are rows of weights, so that a posting of theirs costs about as little
DIRECT = 2.0  # a query with fewer postings than so many times those blocks' is looked up without them, with the same result
SOFT = 0.05  # added to a distance before it divides a vote
PRIOR_VOTES = 0.5
THRESHOLD = 0.3
DRAWS = 1 << 62
WORD = re.compile(r"\w+")


def words_of(text: str | None) -> Counter:
    return Counter(WORD.findall(text.lower())) if text else Counter()


def beginnings(word: str) -> list[str]:
    return [word[:k] + "*" for k in PREFIXES if k < len(word)]


class Known(dict):
    """The numbers of each word's terms in the vocabulary; words are remembered as they come."""

    def __init__(self, vocabulary: dict[str, int], most: int = 300_000) -> None:
        self.vocabulary, self.most = vocabulary, most
        self.heads = {t[: PREFIXES[0]] for t in vocabulary if t.endswith("*")}

    def __missing__(self, word: str) -> tuple[int, ...]:
        if len(self) >= self.most:
            self.clear()
        terms = (word, *beginnings(word)) if word[: PREFIXES[0]] in self.heads else (word,)
        found = self[word] = tuple(self.vocabulary[t] for t in terms if t in self.vocabulary)
        return found

    def counted(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The text's terms, ascending, and how often each is there; a text without a word has none."""
        found: dict[int, int] = {}
        for w, n in words_of(text).items():
            for t in self[w]:
                found[t] = found.get(t, 0) + n
        if found:
            found[self.vocabulary[EVERYWHERE]] = 1
        at = np.fromiter(found.keys(), np.int32, len(found))
        order = np.argsort(at)
        return at[order], np.fromiter(found.values(), np.int32, len(found))[order]


def ranges(start: np.ndarray, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All places of the runs numbered `which`, and how many each has."""
    size = start[which + 1] - start[which]
    return np.arange(int(size.sum())) + np.repeat(start[which] - (np.cumsum(size) - size), size), size


@dataclass
class Examples:
    """Distinct vectors of the examples, with the votes for either label and the ids of some that have each."""

    terms: dict[str, int] = field(default_factory=dict)
    weight: np.ndarray = field(default_factory=lambda: np.zeros(0))  # of each term: idf, times what it tells about labels
    votes: np.ndarray = field(default_factory=lambda: np.zeros((0, 2)))
    ids: list[list[int]] = field(default_factory=list)
    prior: float = 0.0
    curve: tuple[np.ndarray, np.ndarray] = (np.array([0.0, 1.0]), np.array([0.0, 1.0]))  # from a share of votes to a probability

    def vector(self, at: np.ndarray, tf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Terms of some weight, and their values in the vector of length 1."""
        v = (1 + np.log(tf)) * self.weight[at]
        on = v > 0
        at, v = at[on], v[on]
        return at, v / np.sqrt((v * v).sum()) if len(v) else v

    def build(self, vectors: list[tuple[np.ndarray, np.ndarray]], votes: np.ndarray, ids: list[list[int]]) -> Examples:
        """The index: by term, blocks of examples and the greatest weight in each; by term and by block, the weights."""
        order = sorted(range(len(vectors)), key=lambda i: (-vectors[i][0][vectors[i][1].argsort()[::-1][:3]]).tolist() if len(vectors[i][0]) else [])
        self.votes, self.ids, self.n = votes[order], [ids[i] for i in order], len(order)
        size = np.array([len(vectors[i][0]) for i in order], np.int64)
        example = np.repeat(np.arange(self.n, dtype=np.int32), size)
        term, weight = (np.concatenate([vectors[i][k] for i in order]) if self.n else np.zeros(0) for k in (0, 1))
        n_terms, self.n_blocks = len(self.weight), -(-self.n // BLOCK)
        self.block_term, self.block_example, self.block_weight = term.astype(np.int32), example, weight
        self.block_start = np.searchsorted(example, np.minimum(np.arange(self.n_blocks + 1) * BLOCK, self.n))
        by_term = np.lexsort((example, term))
        term, self.example, self.by_term = term[by_term], example[by_term], weight[by_term]
        self.start = np.searchsorted(term, np.arange(n_terms + 1))
        run = np.flatnonzero(np.concatenate([[True], (term[1:] != term[:-1]) | (self.example[1:] // BLOCK != self.example[:-1] // BLOCK)])) if len(term) else np.zeros(0, np.int64)
        self.most = np.maximum.reduceat(self.by_term, run) if len(run) else np.zeros(0)
        self.most_block, self.most_start = self.example[run] // BLOCK, np.searchsorted(term[run], np.arange(n_terms + 1))
        self.tables = None
        return self

    def full(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """What a worker unfolds of the index when it first needs it: the greatest weight by term and block; the weights of terms that
        at least one in FREQUENT examples has, a row for each; the number of each term's row, or -1. Bounded as the sample is.
        """
        if self.tables is None:
            n_terms, size = len(self.weight), np.diff(self.start)
            most = np.zeros((n_terms, self.n_blocks), np.float32)
            most[np.repeat(np.arange(n_terms), np.diff(self.most_start)), self.most_block] = np.nextafter(self.most.astype(np.float32), np.float32(np.inf))
            frequent = np.flatnonzero(size * FREQUENT >= max(1, self.n))
            number = np.full(n_terms, -1)
            number[frequent] = np.arange(len(frequent))
            rows = np.zeros((len(frequent), self.n))
            places, sizes = ranges(self.start, frequent)
            rows[np.repeat(np.arange(len(frequent)), sizes), self.example[places]] = self.by_term[places]
            self.tables = most, rows, number
        return self.tables

    def nearest(self, at: np.ndarray, q: np.ndarray, k: int = NEAREST, without: int = -1) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and cosines of the k examples of greatest cosine above 0, exactly: the blocks of greatest bounds set a
        least cosine, then all blocks whose bound reaches it are looked through, or all postings where those are fewer.
        """
        if not len(at) or not self.n:
            return np.zeros(0, np.int64), np.zeros(0)

        most, rows, number = self.full()
        row = number[at]
        rare = row < 0

        def all_postings() -> tuple[np.ndarray, np.ndarray]:
            places, size = ranges(self.start, at[rare])
            return top(np.bincount(self.example[places], np.repeat(q[rare], size) * self.by_term[places], self.n) + q[~rare] @ rows[row[~rare]])

        def top(dot: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if without >= 0:
                dot[without] = 0
            if self.n > 4 * k:
                found = np.flatnonzero(dot >= max(np.partition(dot, -k)[-k] - 1e-9, 1e-300))
            else:
                found = np.flatnonzero(dot > 0)
            found = found[np.lexsort((found, -np.round(dot[found], 12)))][:k]
            return found, dot[found]

        n_postings = int((self.start[at + 1] - self.start[at])[rare].sum()) + (len(at) - int(rare.sum())) * self.n // FREQUENT
        if n_postings < DIRECT * FIRST_BLOCKS * len(self.block_term) / self.n_blocks:
            return all_postings()
        bound = q @ most[at] * (1 + 1e-6)
        dense = np.zeros(len(self.weight))
        dense[at] = q

        def best(blocks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            p, _ = ranges(self.block_start, blocks)
            return top(np.bincount(self.block_example[p], dense[self.block_term[p]] * self.block_weight[p], self.n))

        first = np.argpartition(-bound, min(FIRST_BLOCKS, self.n_blocks) - 1)[:FIRST_BLOCKS]
        found, cosine = best(first)
        least = cosine[-1] - 1e-9 if len(found) == k else 0.0
        blocks = np.flatnonzero((bound >= least) & (bound > 0))
        if not len(np.setdiff1d(blocks, first, assume_unique=True)):
            return found, cosine
        if (self.block_start[blocks + 1] - self.block_start[blocks]).sum() < n_postings:
            return best(blocks)
        return all_postings()

    def share(self, at: np.ndarray, tf: np.ndarray, without: int = -1) -> tuple[float, list[int], list[float]]:
        """Share of distance-weighted votes for label 1; ids and similarities of the nearest examples."""
        found, cosine = self.nearest(*self.vector(at, tf), without=without)
        votes = np.array([PRIOR_VOTES * (1 - self.prior), PRIOR_VOTES * self.prior])
        votes += (self.votes[found] * (SOFT / (1 - np.minimum(cosine, 1.0) + SOFT))[:, None]).sum(axis=0)
        total = float(votes.sum())
        return (float(votes[1]) / total if total else 0.0), [self.ids[i][0] for i in found[:3]], [round(float(s), 6) for s in cosine[:3]]

    def calibrate(self, shares: np.ndarray, labels: np.ndarray, weight: np.ndarray) -> None:
        """The monotone curve of least squares from shares of votes to labels (pooling adjacent violators)."""
        if not len(shares):
            return
        order = np.argsort(shares, kind="stable")
        blocks: list[list[float]] = []  # weighted label, weighted share, weight
        for x, y, w in zip(shares[order], labels[order], weight[order]):
            blocks.append([w * y, w * x, w])
            while len(blocks) > 1 and blocks[-2][0] * blocks[-1][2] >= blocks[-1][0] * blocks[-2][2]:
                last = blocks.pop()
                blocks[-1] = [a + b for a, b in zip(blocks[-1], last)]
        y, x, w = (np.array(c) for c in zip(*blocks))
        self.curve = x / w, y / w

    def score(self, at: np.ndarray, tf: np.ndarray) -> tuple[float, list[int], list[float]]:
        share, ids, cosines = self.share(at, tf)
        return float(np.interp(share, *self.curve)), ids, cosines


def apart(sample: DataFrame) -> DataFrame:
    """Of near copies among some thousands of texts, one."""

    def run(batches):
        for b in batches:
            for i, j, shingles, first in sets_of(b.column(0)):
                keys = signatures(shingles, first, COPY_TREES, COPY_PREFIX).view(np.int64)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), b.column(1).slice(i, j - i), *(pa.array(np.ascontiguousarray(keys[:, k])) for k in range(COPY_TREES))], ["text", "label", *(f"k{k}" for k in range(COPY_TREES))])

    rows = map_batches(sample.select("text", "label"), run, "text string, label int, " + ", ".join(f"k{k} long" for k in range(COPY_TREES)))
    for k in range(COPY_TREES):
        rows = rows.groupBy(f"k{k}").agg(F.min_by(F.struct("*"), F.struct("text", "label")).alias("r")).select("r.*")
    return rows.select("text", "label")


def told(sample: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """The vocabulary: every word of the sample that tells more than chance, and beginnings of words that tell much; what each tells."""

    def terms(batches):
        seen, toxic = Counter(), Counter()
        for b in batches:
            for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                words = words_of(x)
                own = words.keys() | {t for w in words for t in beginnings(w)}
                seen.update(own)
                if y:
                    toxic.update(own)
        names = list(seen)
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([seen[t] for t in names], pa.int64()), pa.array([toxic[t] for t in names], pa.int64())], ["word", "n", "a"])

    sizes = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    n1, n0 = sizes.get(1, 0), sizes.get(0, 0)
    n = float(max(1, n1 + n0))
    a, b = F.col("a").cast("double"), (F.col("n") - F.col("a")).cast("double")
    chi2 = n * F.pow(a * (n0 - b) - b * (n1 - a), F.lit(2.0)) / F.greatest(F.lit(1.0), n1 * float(n0) * (a + b) * F.greatest(F.lit(1.0), n - a - b))
    table = stored(map_batches(sample, terms, "word string, n long, a long").groupBy("word").agg(F.sum("a").alias("a"), F.sum("n").alias("n")).withColumn("chi2", chi2), "toxicity-words")
    words = table.where(~F.col("word").endswith("*") & (F.col("chi2") > CHANCE_CHI2)).select("word", "chi2")
    # Of beginnings that begin alike and were seen equally often, the longest says all.
    prefixes = table.where(F.col("word").endswith("*") & (F.col("n") >= MIN_EXAMPLES) & (F.col("chi2") >= MIN_CHI2))
    prefixes = prefixes.groupBy("a", "n", F.substring("word", 1, PREFIXES[0]).alias("head")).agg(F.max(F.struct(F.length("word"), "word", "chi2")).alias("w")).select("w.word", "w.chi2")
    found = sorted((r["word"], r["chi2"]) for r in words.unionByName(prefixes).collect())  # of the bounded sample
    found.insert(0, (EVERYWHERE, 0.0))
    beyond = np.array([x for _, x in found], float) - CHANCE_CHI2
    return {w: i for i, (w, _) in enumerate(found)}, (np.maximum(0, beyond) / (np.abs(beyond) + HALF_CHI2)) ** POWER


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", per_label: int = SAMPLE_PER_LABEL, seed: int = 3) -> Examples:
    """Examples from about `per_label` rows of each label that aren't held out.

    How often a term occurs in documents is counted over all of them. Rows without an id or a label teach nothing; of
    several labels for an id the greatest counts, and rows alike count once; without any example every score is 0.
    The curve that makes probabilities of votes is fitted on the examples, each scored without itself.
    """
    labels = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    labels = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~held_out())
    labels = labels.groupBy("doc_id").agg(F.max("label").alias("label"))  # one for each id, however often it is there
    counts = {r[0]: r[1] for r in labels.groupBy("label").count().collect()}
    share = {y: int(DRAWS * min(1.0, per_label / max(1, counts.get(y, 0)))) for y in (0, 1)}
    draw = F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(DRAWS))
    drawn = labels.where(draw < F.when(F.col("label") == 1, F.lit(share[1])).otherwise(F.lit(share[0])))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    sample = stored(rows.join(F.broadcast(drawn), "doc_id").distinct(), "toxicity-sample")  # some thousands of rows
    vocabulary, value = told(stored(apart(sample), "toxicity-apart"))

    def totals(batches):
        known, n, n_docs = Known(vocabulary), np.zeros(len(vocabulary), np.int64), 0
        for b in batches:
            for x in b.column(0).to_pylist():
                at = [t for w in set(WORD.findall(x.lower())) for t in known[w]] if x else []
                n[np.unique(np.array(at, np.int64))] += 1
            n_docs += len(b)
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(at, -1)), pa.array(np.append(n[at], n_docs))], ["t", "n"])

    df = {r["t"]: r["n"] for r in map_batches(rows.select("text"), totals, "t long, n long").groupBy("t").agg(F.sum("n").alias("n")).collect()}  # one row a term
    n_docs = df.pop(-1, 0)
    seen = np.zeros(len(vocabulary))
    seen[list(df)] = list(df.values())
    weight = np.maximum(0.0, np.log((n_docs + 1) / (seen + 0.5))) * value
    weight[vocabulary[EVERYWHERE]] = BACKGROUND
    examples = Examples(vocabulary, weight)

    def counted(batches):
        known = Known(vocabulary)
        for b in batches:
            found = [known.counted(x) for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *(pa.array([x[k].tobytes() for x in found], pa.binary()) for k in (0, 1))], ["doc_id", "label", "at", "tf"])

    found = map_batches(sample.select("doc_id", "label", "text"), counted, "doc_id long, label int, at binary, tf binary").collect()  # the bounded sample
    held = Counter(r["label"] for r in found)
    scale = sum(held.values()) / max(1, sum(counts.values()))
    weight = np.array([counts.get(y, 0) / held[y] * scale if held[y] else 0.0 for y in (0, 1)])
    groups: dict[tuple[bytes, bytes], tuple[np.ndarray, list[int]]] = {}
    for r in sorted(found, key=lambda r: (r["doc_id"], r["at"], r["tf"])):
        votes, ids = groups.setdefault((bytes(r["at"]), bytes(r["tf"])), (np.zeros(2), []))
        votes[r["label"]] += weight[r["label"]]
        ids.append(r["doc_id"])
    keys = list(groups)
    vectors = [examples.vector(np.frombuffer(a, np.int32), np.frombuffer(t, np.int32)) for a, t in keys]
    votes = np.array([v for v, _ in groups.values()]) if groups else np.zeros((0, 2))
    examples.prior = counts.get(1, 0) / max(1, sum(counts.values()))
    examples.build(vectors, votes, [ids for _, ids in groups.values()])
    number = {i: n for n, ids in enumerate(examples.ids) for i in ids}

    def alone(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            shares = [examples.share(np.frombuffer(a, np.int32), np.frombuffer(t, np.int32), number[i])[0] for i, a, t in zip(ids, b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(shares, pa.float64())], ["doc_id", "label", "share"])

    if found:
        rows = map_batches(sample.select("doc_id", "label", "text"), counted, "doc_id long, label int, at binary, tf binary")
        shares = sorted((r["share"], r["label"], r["doc_id"]) for r in map_batches(rows.repartition(partitions(docs)), alone, "doc_id long, label int, share double").collect())
        label = np.array([y for _, y, _ in shares])
        examples.calibrate(np.array([s for s, _, _ in shares]), label.astype(float), weight[label])
    examples.ids = [ids[:3] for ids in examples.ids]
    return examples


def score(docs: DataFrame, examples: Examples, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, score, predicted, evidence (ids of the nearest examples) and their similarities, for every row.

    A text that shares no term with an example, as a null or empty one, has no evidence: its score is that of the labels' shares.
    """

    def run(batches):
        known, seen = Known(examples.terms), {}
        for b in batches:
            out = []
            for x in b.column(1).to_pylist():
                if x not in seen:  # copies in a row are scored once
                    if len(seen) > 10_000:
                        seen.clear()
                    seen[x] = examples.score(*known.counted(x))
                out.append(seen[x])
            seen.clear()
            s = np.array([x[0] for x in out], float)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array((s >= threshold).astype(np.int32)), pa.array([x[1] for x in out], pa.list_(pa.int64())), pa.array([x[2] for x in out], pa.list_(pa.float64()))], ["doc_id", "score", "predicted", "evidence", "similarity"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return map_batches(rows, run, "doc_id long, score double, predicted int, evidence array<long>, similarity array<double>")


def toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Scores of all rows of `docs`; null ids and repeated rows are kept, of equal texts the scores are equal, texts of any length
    are read whole, an empty table gives an empty table. Of examples of equal cosine those that come first in the index vote.
    """
    columns = {k: v for k, v in options.items() if k in ("id_col", "text_col")}
    return score(docs, learn(docs, labels, **options), threshold, **columns)
