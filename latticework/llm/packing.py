"""Packing by lexical retrieval: documents are ordered by the pivots they are nearest to, cut into shards, and in each
shard a BM25 index returns the nearest unused documents for a seed, which fill its window.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import U64, map_batches, mix, partitions, stored
from latticework.llm.tokens import byte_bpe

SEQUENCE = 2048
END = 1  # the id after each document
#: Ids and documents of a shard: what one index holds at a time.
SHARD_IDS, SHARD_ROWS = 1 << 20, 8192
#: Bytes of ids in a task, and rows; a task packs one shard after another.
TASK_BYTES, TASK_ROWS = 16 << 20, 200_000
K1, B = 1.2, 0.75
#: An id that one in so many documents of a shard has gets a row over all of them: at most so many numbers for a posting.
COMMON = 4
#: An index drops used documents when only this share of those it holds is unused.
DROP_AT = 0.8
TERMS = 65536
#: Bound of the pivots: so many documents, drawn by hash; each document's nearest of them, in order, are its key.
PIVOTS, NEAREST = 64, 8
#: Ids of the pivots that are scored: whole texts, but texts of at most so many ids are drawn.
PIVOT_IDS = 8192
#: Rows whose places set the bounds of the tasks, about so many for each task.
SAMPLE_PER_TASK = 200


def inverse(df: np.ndarray, n: int) -> np.ndarray:
    return np.log1p((n - df + 0.5) / (df + 0.5))


def weights(tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of terms in documents of that size."""
    return idf * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / max(1.0, mean)))


def counted(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, term and count of every term of every document, by document and term."""
    kind = np.uint32 if len(docs) <= 1 << 16 else np.int64  # half the bytes to sort, where they hold both numbers
    key = np.repeat(np.arange(len(docs), dtype=kind) << kind(16), [len(d) for d in docs]) | np.concatenate(docs)
    key.sort()
    head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    found = key[head].astype(np.int64)
    return found >> 16, found & 0xFFFF, np.diff(np.append(head, len(key)))


class BM25:
    """Weights of a shard's documents by token id, from idf and mean size of the whole table: a row over all documents for
    each id that one in COMMON of them has, postings for the others.
    """

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.n, self.number = len(docs), np.arange(len(docs))  # number: of the documents in rows and postings
        doc, term, tf = counted(docs)
        weight = weights(tf, np.array([len(d) for d in docs])[doc], idf[term], mean)
        self.of, self.of_start = term, np.searchsorted(doc, np.arange(self.n + 1))
        common = np.flatnonzero(np.bincount(term, minlength=TERMS) * COMMON >= max(1, self.n))
        self.row = np.full(TERMS, -1)
        self.row[common] = np.arange(len(common))
        self.rows, row = np.zeros((len(common), self.n)), self.row[term]
        self.rows[row[row >= 0], doc[row >= 0]] = weight[row >= 0]
        self.read = np.empty_like(self.rows)
        doc, term, weight = doc[row < 0], term[row < 0], weight[row < 0]
        by_term = np.argsort(term.astype(np.uint16), kind="stable")  # by their digits, as they have 16 bits
        self.doc, self.weight = doc[by_term], weight[by_term]
        self.start = np.searchsorted(term[by_term], np.arange(TERMS + 1))

    def scores(self, seed: int) -> np.ndarray:
        """Of every document, by all terms of the seed; -1 of those that were dropped."""
        terms = self.of[self.of_start[seed] : self.of_start[seed + 1]]
        row = self.row[terms]
        common, terms = row[row >= 0], terms[row < 0]
        found = np.add.reduce(np.take(self.rows, common, 0, self.read[: len(common)], "clip"), 0)
        first, size = self.start[terms], self.start[terms + 1] - self.start[terms]
        at = np.arange(int(size.sum())) + np.repeat(first - (np.cumsum(size) - size), size)
        found += np.bincount(self.doc[at], self.weight[at], len(found))
        out = np.full(self.n, -1.0)
        out[self.number] = found
        return out

    def drop(self, gone: np.ndarray) -> None:
        """Documents that nobody asks for any more go; the scores of the others stay what they are."""
        left = ~gone[self.number]
        self.number, self.rows = self.number[left], np.ascontiguousarray(self.rows[:, left])
        self.read = np.empty_like(self.rows)
        kept = left[self.doc]
        self.start = np.concatenate([[0], np.cumsum(kept)])[self.start]
        self.doc, self.weight = (np.cumsum(left) - 1)[self.doc[kept]], self.weight[kept]


class Pivots:
    """Documents of a bounded sample, in an order in which each is followed by the nearest that is left."""

    def __init__(self, docs: list[np.ndarray], idf: np.ndarray, mean: float) -> None:
        self.idf, self.mean = idf, mean
        if docs:
            near = np.array([BM25(docs, idf, mean).scores(i) for i in range(len(docs))])
            order, free = [0], np.ones(len(docs), bool)
            free[0] = False
            while free.any():
                order.append(int(np.where(free, near[order[-1]], -1.0).argmax()))
                free[order[-1]] = False
            docs = [docs[i] for i in order]
        self.table = np.zeros((TERMS, len(docs)), np.float32)
        for i, d in enumerate(docs):
            self.table[np.unique(d), i] = 1

    def keys(self, docs: list[np.ndarray], most: int = 1 << 12) -> np.ndarray:
        """For each document the numbers of its nearest pivots, nearest first, by BM25 over all its terms, as one number."""
        n = self.table.shape[1]
        out = np.zeros(len(docs), np.int64)
        if n < 2:
            return out
        doc, term, tf = counted(docs)
        weight = weights(tf, np.array([len(d) for d in docs])[doc], self.idf[term], self.mean).astype(np.float32)
        start = np.searchsorted(doc, np.arange(len(docs) + 1))
        first = 0
        while first < len(docs):  # some documents at a time, a long one alone
            last = max(first + 1, int(np.searchsorted(start, start[first] + most, "right")) - 1)
            a, b = start[first], start[last]
            scores = np.add.reduceat(self.table[term[a:b]] * weight[a:b, None], start[first:last] - a, axis=0)
            nearest = np.argsort(-scores, axis=1, kind="stable")[:, :NEAREST]
            for k in range(nearest.shape[1]):
                out[first:last] = out[first:last] * PIVOTS + nearest[:, k]
            first = last
        return out


class Packer:
    """Fills windows of `sequence` ids from one shard after another; finish() cuts the last ids into powers of two."""

    def __init__(self, sequence: int, idf: np.ndarray, mean: float) -> None:
        self.sequence, self.idf, self.mean = sequence, idf, mean
        self.number, self.used = 0, 0
        self.window: list[tuple] = []  # pieces of the open one: name, start, ids, length of the document, sequence, offset

    def put(self, name, ids: np.ndarray, start: int) -> int:
        """A piece of a document into the open window; how many ids went."""
        length = min(len(ids) - start, self.sequence - self.used)
        self.window.append((name, start, ids[start : start + length], len(ids), self.number, self.used))
        self.used += length
        return length

    def closed(self) -> list[tuple]:
        out, self.window = self.window, []
        self.number, self.used = self.number + 1, 0
        return out

    def pack(self, names: list, docs: list[np.ndarray]) -> Iterator[list[tuple]]:
        """The windows filled by a shard's documents. A window's seed is what is left of the document that the last one
        ended in, or the first unused document; then come the nearest unused ones to it.
        """
        index, n = BM25(docs, self.idf, self.mean), len(docs)
        free = np.ones(n, bool)
        following, left = 0, n
        while True:
            while following < n and not free[following]:
                following += 1
            if following == n:
                return
            seed, start, left = following, 0, left - 1
            free[seed] = False
            while seed is not None:
                doc, scores = seed, None
                while True:
                    start += self.put(names[doc], docs[doc], start)
                    if self.used == self.sequence:
                        yield self.closed()
                        seed = doc if start < len(docs[doc]) else None
                        break
                    if scores is None:
                        if left < DROP_AT * len(index.number):
                            index.drop(~free)
                        scores = index.scores(seed)
                        scores[~free] = -1
                    doc = int(scores.argmax())
                    if scores[doc] < 0:
                        seed = None  # no document of the shard is left
                        break
                    free[doc], scores[doc], start, left = False, -1, 0, left - 1

    def finish(self) -> list[tuple]:
        """What no window was full of, in sequences whose lengths are powers of two."""
        left, out, offset = self.used, [], 0
        room = 1 << (left.bit_length() - 1) if left else 0
        for name, start, ids, size, _, _ in self.window:
            while len(ids):
                take = min(len(ids), room - offset)
                out.append((name, start, ids[:take], size, self.number, offset))
                left, start, ids, offset = left - take, start + take, ids[take:], offset + take
                if offset == room:
                    self.number, offset = self.number + 1, 0
                    room = 1 << (left.bit_length() - 1) if left else 0
        self.window, self.used = [], 0
        return out


def statistics(coded: DataFrame) -> tuple[np.ndarray, float, int, int]:
    """idf of all terms, the mean size, the number of ids and of rows, over the whole table."""

    def count(batches):
        df, rows, size = np.zeros(TERMS, np.int64), 0, 0
        for b in batches:
            docs = [np.frombuffer(x, np.uint16) for x in b.column(0).to_pylist()]
            if docs:
                df += np.bincount(counted(docs)[1], minlength=TERMS)
            rows, size = rows + len(docs), size + sum(map(len, docs))
        term = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(term, [-1, -2])), pa.array(np.append(df[term], [rows, size]))], ["term", "n"])

    found = map_batches(coded.select("codes"), count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    found = {r["term"]: r["n"] for r in found.collect()}  # one row an id of the vocabulary
    rows, size = found.pop(-1, 0), found.pop(-2, 0)
    df = np.zeros(TERMS, np.int64)
    df[list(found)] = list(found.values())
    idf = inverse(df, rows)
    idf[END] = 0
    return idf, size / max(1, rows), size, rows


def packed(docs: DataFrame, sequence: int = SEQUENCE, tokenizer: str = "byte_bpe_50k", id_col: str = "doc_id", text_col: str = "text", pivots: int = PIVOTS, shard_ids: int = SHARD_IDS, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Pieces of all documents: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset.

    Null and empty texts are documents of the end id only. Null ids and repeated rows are kept, each row packed as a
    document of its own; a text of any length is cut into as many windows as it needs. Ties of scores go to the
    document that comes first in its shard. An empty table gives an empty table. Other columns are not carried.

    At most `pivots` documents, drawn by hash, tell where a document belongs: its nearest pivots by BM25 over all its
    terms, nearest first, are its key. Ranges of keys are tasks, so that documents with like words meet wherever they
    were, and a key that very many rows share is spread by their hash and place. A task cuts its range into shards of bounded size.
    """
    rows = docs.select(F.monotonically_increasing_id().alias("row"), docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))

    def code(batches):
        bpe, end = byte_bpe(tokenizer), np.array([END], np.uint16)
        for b in batches:
            found = [np.concatenate([bpe.encode(x), end]).tobytes() for x in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(found, pa.binary())], ["row", "doc_id", "codes"])

    coded = stored(map_batches(rows, code, "row long, doc_id long, codes binary"), "packing")
    idf, mean, size, n_rows = statistics(coded)
    short = coded.where(F.octet_length("codes") <= 2 * PIVOT_IDS).groupBy(F.xxhash64(F.lit(5), "codes").alias("draw")).agg(F.min("row").alias("row"))
    drawn = [r["row"] for r in short.orderBy("draw").limit(min(pivots, PIVOTS)).collect()]  # bounded in number, and each in size
    drawn = sorted((r["row"], r["codes"]) for r in coded.where(F.col("row").isin(drawn)).select("row", "codes").collect())
    found = Pivots([np.frombuffer(x, np.uint16) for _, x in drawn], idf, mean)
    n_tasks = max(partitions(docs), -(-2 * size // TASK_BYTES), -(-n_rows // TASK_ROWS))

    def places(batch):
        """A number by which rows are ordered: the key, then some bits of the ids' hash, so that copies lie side by side."""
        return (found.keys([np.frombuffer(x, np.uint16) for x in batch.column(1).to_pylist()]) << 14) | (batch.column(2).to_numpy() & 0x3FFF)

    def sample(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([pa.array(places(b))], ["place"])

    keyed = coded.select("row", "codes", F.xxhash64("codes").alias("hash"), "doc_id")
    if n_tasks > 1:
        # Rows are drawn half alike, half by their size, so that tasks are near equal in both.
        share = n_tasks * SAMPLE_PER_TASK / max(1, n_rows) / 2 * (1 + F.octet_length("codes") / (2 * max(1.0, mean)))
        some = keyed.where(F.pmod(F.xxhash64(F.lit(9), "row"), F.lit(1 << 40)) < share * (1 << 40))
        places_seen = map_batches(some, sample, "place long")
        bounds = np.array(places_seen.stat.approxQuantile("place", [i / n_tasks for i in range(1, n_tasks)], 1 / (4 * n_tasks)), float)  # one for each task
    else:
        bounds = np.zeros(0)

    def place(batches):
        for b in batches:
            at = places(b)
            low, high = (np.searchsorted(bounds, at.astype(float), side) for side in ("left", "right"))
            spread = mix(b.column(0).to_numpy().astype(U64)) % (high - low + 1).astype(U64)  # a place that several tasks share
            yield pa.RecordBatch.from_arrays([pa.array((low + spread.astype(np.int64)).astype(np.int32)), pa.array(at), b.column(0), b.column(3), b.column(1)], ["task", "place", "row", "doc_id", "codes"])

    placed = map_batches(keyed, place, "task int, place long, row long, doc_id long, codes binary")
    ranged = placed.repartitionById(n_tasks, "task").sortWithinPartitions("place", "row")

    def run(batches):
        from pyspark import TaskContext

        task, packer = TaskContext.get().partitionId(), Packer(sequence, idf, mean)
        names, held, size = [], [], 0

        def batch(pieces):
            doc, start, ids, tokens, number, offset = zip(*pieces)
            columns = [pa.array(doc, pa.int64()), pa.array(start, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(tokens, pa.int64()), pa.array([(task << 40) + x for x in number], pa.int64()), pa.array(offset, pa.int64())]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

        def shard():
            out = []
            for window in packer.pack(names, held):
                out += window
                if len(out) > 2000:
                    yield batch(out)
                    out = []
            if out:
                yield batch(out)

        for b in batches:
            for doc_id, x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.frombuffer(x, np.uint16)
                if held and (size + len(ids) > shard_ids or len(held) == shard_rows):
                    yield from shard()
                    names, held, size = [], [], 0
                names.append(doc_id)
                held.append(ids)
                size += len(ids)
        if held:
            yield from shard()
        last = packer.finish()
        if last:
            yield batch(last)

    return map_batches(ranged.select("doc_id", "codes"), run, "doc_id long, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
