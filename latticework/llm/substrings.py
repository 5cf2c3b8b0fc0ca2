"""Exact substring dedup: strings of 50 bytes that an earlier document has too are cut out."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.llm.anchors import GRAM, anchors
from latticework.llm.common import BYTE_VALUE, U64, SpanHash, buffers, map_batches, mix, partitions, rounds, stored
from latticework.llm.suffixes import WindowTable, merge

WINDOW = 50
#: Bytes of text whose anchors a bucket holds on average.
BUCKET_BYTES = 16 << 20
#: Bytes of text whose anchors a task holds at a time before they are dealt out.
SLICE_BYTES = 8 << 20
#: Bytes of contexts in one suffix array, and in one task.
ARRAY_BYTES, TASK_BYTES = 1 << 20, 2 << 20
#: Contexts of one anchor that go to one task together; of more, blocks of so many meet in pairs.
TOGETHER = 8192
#: So many texts are named in a broadcast at most (some 100 bytes each in memory); more are joined by shuffle.
BROADCAST_IDS = 200_000
#: What tells texts apart: the document's id, by which they are judged, and a hash of the text.
NAMED = ["doc_id", "tag"]

RUN = np.dtype([("first", "<u4"), ("count", "u1")])
ASK = np.dtype([("key", "<i8"), ("first", "<u4"), ("count", "u1"), ("block", "<u4"), ("blocks", "<u4")])
FIELDS = [("key", "<u8"), ("context", "<u4"), ("left", "<u2"), ("right", "<u2"), ("row", "<u2"), ("first", "<u4"), ("count", "u1")]


def by_value(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct values and where each begins in the sorted array `values`, with the end."""
    new = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]])) if len(values) else np.zeros(0, np.int64)
    return values[new], np.append(new, len(values))


def runs_by_doc(doc: np.ndarray, tag: np.ndarray, table: np.ndarray) -> list[tuple[int, int, bytes]]:
    """The part of `table` of each text, by document and tag."""
    order = np.lexsort((tag, doc))
    doc, tag, table = doc[order], tag[order], table[order]
    new = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])) if len(doc) else np.zeros(0, np.int64)
    return [(int(doc[a]), int(tag[a]), table[a:b].tobytes()) for a, b in zip(new, np.append(new[1:], len(doc)))]


def records(column: pa.Array, window: int) -> dict[str, np.ndarray]:
    """The anchors of a batch: hashes of anchor, context and its sides, number of the text, first window, windows."""
    data, at = buffers(column)
    parts: list[list[np.ndarray]] = []
    half = (window - GRAM + 1) // 2
    for i, j in rounds(at):
        d, own = data[at[i] : at[j]], at[i : j + 1] - at[i]
        key, place, first, count, row = anchors(d, own, window)
        if not len(key):
            continue
        spans = SpanHash(BYTE_VALUE[d])
        end = first + count - 1 + window
        context = spans.of(first, end)
        left, right = place - half >= first, place + GRAM + half <= end
        side = lambda ok, a: np.where(ok, (spans.of(np.where(ok, a, 0), np.where(ok, a + half, 0)) >> U64(48)) | U64(1), U64(0))  # noqa: B023, E731
        parts.append([key, context, side(left, place - half), side(right, place + GRAM), row + i, first - own[row], count])
    names = [n for n, _ in FIELDS]
    if not parts:
        return {n: np.zeros(0, t) for n, t in FIELDS}
    return dict(zip(names, (np.concatenate(x) for x in zip(*parts))))


def slices(batch: pa.RecordBatch):
    """Parts of a batch of (id, tag, text) of SLICE_BYTES of text or one longer text, and of few enough rows for their 16-bit numbers."""
    _, at = buffers(batch.column(2))
    for i, j in rounds(at, SLICE_BYTES):
        for k in range(i, j, 60_000):
            yield batch.slice(k, min(j - k, 60_000))


def scatter(rows: DataFrame, window: int, n_buckets: int) -> DataFrame:
    """Anchors by bucket of their hash, packed; runs of windows that an earlier text of the same batch has are found here."""

    def run(batches):
        for whole in batches:
            for b in slices(whole):
                ids, tags = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
                r = records(b.column(2), window)
                same = mix(r["key"].astype(U64) ^ mix(r["context"].astype(U64) + U64(5)))
                order = np.lexsort((ids[r["row"].astype(np.int64)], same))
                r = {k: v[order] for k, v in r.items()}
                doc, tag = (x[r["row"].astype(np.int64)] for x in (ids, tags))
                _, begin = by_value(same[order])
                least = np.repeat(doc[begin[:-1]], np.diff(begin))
                out: list[tuple[int, int | None, int | None, bytes]] = []
                later = doc > least
                runs = np.empty(int(later.sum()), RUN)
                runs["first"], runs["count"] = r["first"][later], r["count"][later]
                out += [(i % n_buckets, i, t, x) for i, t, x in runs_by_doc(doc[later], tag[later], runs)]
                r = {k: v[~later] for k, v in r.items()}
                bucket = (r["key"] % U64(n_buckets)).astype(np.int64)
                order = np.lexsort((r["first"], r["row"], bucket))
                r = {n: r[n][order].astype(t) for n, t in FIELDS}
                numbers, begin = by_value(bucket[order])
                for k, i, j in zip(numbers, begin[:-1], begin[1:]):
                    rows_, number = np.unique(r["row"][i:j], return_inverse=True)
                    head = np.array([j - i, len(rows_)], "<u4").tobytes() + ids[rows_].astype("<i8").tobytes() + tags[rows_].astype("<i8").tobytes()
                    out.append((int(k), None, None, head + b"".join((number.astype("<u2") if n == "row" else r[n][i:j]).tobytes() for n, _ in FIELDS)))
                yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in out], pa.int32()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2)), pa.array([x[3] for x in out], pa.binary())], ["bucket", "doc_id", "tag", "packed"])

    return map_batches(rows, run, "bucket int, doc_id long, tag long, packed binary")


def unpacked(blobs: list[bytes]) -> dict[str, np.ndarray]:
    parts: dict[str, list] = {n: [] for n, _ in FIELDS} | {"doc": [], "tag": []}
    for x in blobs:
        n, n_docs = np.frombuffer(x, "<u4", 2)
        ids, tags = np.frombuffer(x, "<i8", 2 * n_docs, 8).reshape(2, -1)
        at = 8 + 16 * int(n_docs)
        for name, kind in FIELDS:
            parts[name].append(np.frombuffer(x, kind, n, at))
            at += int(n) * np.dtype(kind).itemsize
        parts["doc"].append(ids[parts["row"][-1]])
        parts["tag"].append(tags[parts["row"][-1]])
    del parts["row"]
    return {k: np.concatenate(v) for k, v in parts.items()}


def judge(r: dict[str, np.ndarray]) -> tuple[list[tuple[int, int, bytes]], list[tuple[int, int, bytes]]]:
    """Of the anchors of a bucket, by text: runs whose whole context an earlier document has, and what must be compared byte by byte."""
    whole = mix(r["context"].astype(U64) | (r["left"].astype(U64) << U64(32)) | (r["right"].astype(U64) << U64(48)))
    order = np.lexsort((r["doc"], whole, r["key"]))
    r, whole = {k: v[order] for k, v in r.items()}, whole[order]
    key, doc = r["key"], r["doc"]
    new_key = np.concatenate([[True], key[1:] != key[:-1]])
    new = new_key | np.concatenate([[True], whole[1:] != whole[:-1]])
    context, of_key = np.cumsum(new) - 1, np.cumsum(new_key) - 1
    least = doc[np.flatnonzero(new)][context]
    covered = doc > least
    first = doc == least  # those that hold their context first are compared with other contexts of the anchor
    many = np.bincount(of_key[new])[of_key] > 1
    asked = np.flatnonzero(first & many)
    # A common window reaches half its rest to one side of the anchor, so that side agrees with another document's.
    wanted = np.zeros(len(key), bool)
    for side in ("left", "right"):
        at = asked[r[side][asked] > 0]
        at = at[np.lexsort((doc[at], r[side][at], of_key[at]))]
        bound = np.concatenate([[True], (of_key[at[1:]] != of_key[at[:-1]]) | (r[side][at[1:]] != r[side][at[:-1]])]) if len(at) else np.zeros(0, bool)
        begin = np.flatnonzero(bound)
        if len(begin):
            end = np.append(begin[1:], len(at)) - 1
            several = doc[at[end]] > doc[at[begin]]
            wanted[at[np.repeat(several, np.diff(np.append(begin, len(at))))]] = True
    runs = np.empty(int(covered.sum()), RUN)
    runs["first"], runs["count"] = r["first"][covered], r["count"][covered]
    at = np.flatnonzero(wanted)
    asks = np.empty(len(at), ASK)
    asks["key"], asks["first"], asks["count"] = key[at].view(np.int64), r["first"][at], r["count"][at]
    _, begin = by_value(key[at])
    size = np.diff(begin)
    asks["block"] = (np.arange(len(at)) - np.repeat(begin[:-1], size)) // TOGETHER
    asks["blocks"] = np.repeat(-(-size // TOGETHER), size)
    tag = r["tag"]
    return runs_by_doc(doc[covered], tag[covered], runs), runs_by_doc(doc[at], tag[at], asks)


def match(scattered: DataFrame, n_buckets: int) -> DataFrame:
    rows = scattered.repartitionById(n_buckets, F.col("bucket"))

    def run(batches):
        blobs: list[bytes] = []
        none = pa.nulls
        for b in batches:
            own = b.column(1).is_valid()
            yield pa.RecordBatch.from_arrays([*(b.column(k).filter(own) for k in (1, 2, 3)), none(own.true_count, pa.binary())], [*NAMED, "runs", "asks"])
            blobs += b.column(3).filter(b.column(1).is_null()).to_pylist()
        if blobs:
            for found, at in zip(judge(unpacked(blobs)), (1, 2)):
                for i in range(0, len(found), 50_000):
                    part = found[i : i + 50_000]
                    packed, empty = pa.array([x[2] for x in part], pa.binary()), none(len(part), pa.binary())
                    yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in part], pa.int64()) for k in (0, 1)), *((packed, empty) if at == 1 else (empty, packed))], [*NAMED, "runs", "asks"])

    return map_batches(rows, run, "doc_id long, tag long, runs binary, asks binary")


def contexts(asked: DataFrame, window: int) -> DataFrame:
    """The bytes around each anchor asked for, for each pair of blocks it takes part in; asked: doc_id, tag, text, asks."""

    def run(batches):
        for b in batches:
            out: list[tuple] = []
            for doc, tag, text, asks in zip(*(b.column(k).to_pylist() for k in range(4))):
                data = text.encode()
                for x in asks:
                    for key, first, count, block, blocks in np.frombuffer(x, ASK).tolist():
                        piece = data[first : first + count - 1 + window]
                        for other in range(blocks):
                            out.append((key * 31 + min(block, other) * 1009 + max(block, other), doc, tag, first, piece))
                if len(out) > 50_000:
                    yield batch(out)
                    out = []
            yield batch(out)

    def batch(out):
        return pa.RecordBatch.from_arrays([pa.array([(x[0] + (1 << 63)) % (1 << 64) - (1 << 63) for x in out], pa.int64()), *(pa.array([x[k] for x in out], pa.int64()) for k in (1, 2, 3)), pa.array([x[4] for x in out], pa.binary())], ["unit", "doc_id", "tag", "first", "bytes"])

    return map_batches(asked, run, "unit long, doc_id long, tag long, first long, bytes binary")


def compare(shards: DataFrame, window: int) -> DataFrame:
    """Runs of windows that an earlier document's context in the shard has too, by suffix arrays of its parts."""

    def run(batches):
        doc, tag, first, pieces = [], [], [], []
        for b in batches:
            for k, held in enumerate((doc, tag, first, pieces)):
                held += b.column(k + 1).to_pylist()
        if not pieces:
            return
        doc, tag, first = (np.array(x, np.int64) for x in (doc, tag, first))
        size = np.array([len(x) for x in pieces])
        ends = np.cumsum(size)
        part = ends // ARRAY_BYTES
        tables, bounds = [], np.append(by_value(part)[1][:-1], len(pieces))
        for i, j in zip(bounds[:-1], bounds[1:]):
            data, at = np.frombuffer(b"".join(pieces[i:j]), np.uint8), np.concatenate([[0], np.cumsum(size[i:j])])
            tables.append(WindowTable(data, at, doc[i:j], window))
        merge(tables)
        for (i, j), t in zip(zip(bounds[:-1], bounds[1:]), tables):
            at = np.concatenate([[0], np.cumsum(size[i:j])])
            hit = np.flatnonzero(t.least[t.kind] < t.owner)
            piece = np.searchsorted(at, t.place[hit], "right") - 1
            runs = np.empty(len(hit), RUN)
            runs["first"], runs["count"] = first[i:j][piece] + t.place[hit] - at[piece], 1
            found = runs_by_doc(doc[i:j][piece], tag[i:j][piece], runs)
            yield pa.RecordBatch.from_arrays([*(pa.array([x[k] for x in found], pa.int64()) for k in (0, 1)), pa.array([x[2] for x in found], pa.binary())], [*NAMED, "runs"])

    return map_batches(shards, run, "doc_id long, tag long, runs binary")


def cut(found: DataFrame, window: int, whole_letters: bool) -> DataFrame:
    """found: doc_id, text, runs, rest -> doc_id, n_bytes, n_removed, n_spans, kept, rest. With whole_letters, kept has no part of a letter."""

    def run(batches):
        for b in batches:
            out = []
            for text, runs in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                data = np.frombuffer(text.encode(), np.uint8)
                edge = np.zeros(len(data) + 1, np.int32)
                r = np.frombuffer(b"".join(runs), RUN)
                np.add.at(edge, r["first"].astype(np.int64), 1)
                np.add.at(edge, r["first"].astype(np.int64) + r["count"] - 1 + window, -1)
                gone = np.cumsum(edge[:-1]) > 0
                counts = len(data), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum())
                if whole_letters:
                    letter = np.cumsum((data & 0xC0) != 0x80) - 1
                    broken = np.zeros(len(data), bool)
                    broken[letter[gone]] = True
                    gone = broken[letter]
                out.append((*counts, data[~gone].tobytes()))
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array([x[i] for x in out], pa.int64()) for i in range(3)), pa.array([x[3] for x in out], pa.binary()), b.column(3)], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept", "rest"])

    numbers = [T.StructField(k, T.LongType()) for k in ("doc_id", "n_bytes", "n_removed", "n_spans")]
    return map_batches(found, run, T.StructType([*numbers, T.StructField("kept", T.BinaryType()), found.schema["rest"]]))


def picked(docs: DataFrame, names: DataFrame, how: str = "left_semi") -> DataFrame:
    """The rows of `docs` whose text is, or isn't, among the distinct `names`."""
    names = names if names.count() > BROADCAST_IDS else F.broadcast(names)
    return docs.join(names, NAMED, how)


def dedup(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", whole_letters: bool = False) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept (the remaining UTF-8 bytes) of each row of `docs`, and its other columns as `rest`.

    A byte goes if a string of `window` bytes covers it that also starts in a document with a smaller id; strings are
    judged on the whole input. Null texts count as empty. Rows without an id lose nothing and remove nothing.
    Rows alike in id and text get the same result; different texts under one id are judged each for itself, and
    remove nothing of each other. An empty table gives an empty table.

    Equal windows have equal anchors, so documents meet by anchor: whole contexts alike need no more; others' bytes
    are brought together by anchor and compared by suffix arrays of bounded size, merged by binary search.
    """
    rest = F.struct(*(docs[c] for c in docs.columns if c != text_col))
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"), rest.alias("rest")).withColumn("tag", F.xxhash64("text"))
    two = F.xxhash64(F.lit(1), "text", F.octet_length("text"))
    hashes = stored(rows.where("doc_id is not null").select("doc_id", "tag", two.alias("two"), F.octet_length("text").cast("long").alias("n")), "dedup-hashes")
    total = hashes.agg(F.sum("n")).first()[0] or 0
    least = hashes.groupBy("tag", "two").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most")
    copies = stored(hashes.join(least, ["tag", "two"]).where("doc_id > least").select(*NAMED).distinct(), "dedup-copies")
    mark = F.broadcast(copies) if copies.count() <= BROADCAST_IDS else copies
    rows = rows.join(mark.withColumn("copy", F.lit(True)), NAMED, "left").withColumn("copy", F.coalesce("copy", F.lit(False)))
    own = rows.where("not copy and doc_id is not null").select(*NAMED, "text", "rest")

    n_buckets = max(partitions(docs), -(-total // BUCKET_BYTES), 1)
    found = stored(match(scatter(own.select(*NAMED, "text"), window, n_buckets), n_buckets), "dedup-matches")
    asks = found.where("asks is not null").groupBy(*NAMED).agg(F.collect_list("asks").alias("asks"))
    asks = stored(asks, "dedup-asks")
    weight = asks.agg(F.sum(F.expr("aggregate(asks, 0L, (a, x) -> a + octet_length(x))")).alias("n")).first()["n"] or 0
    n_shards = max(partitions(docs), -(-(weight // ASK.itemsize * (window + 32)) // TASK_BYTES), 1)
    pieces = contexts(picked(own, asks.select(*NAMED)).join(asks, NAMED).select(*NAMED, "text", "asks"), window)
    pieces = pieces.repartitionById(n_shards, F.pmod(F.xxhash64("unit"), F.lit(n_shards)).cast("int"))
    runs = found.where("runs is not null").select(*NAMED, "runs").unionByName(compare(pieces, window))
    runs = stored(runs.groupBy(*NAMED).agg(F.collect_list("runs").alias("runs")), "dedup-runs")

    names = runs.select(*NAMED)
    touched = cut(picked(own, names).join(runs, NAMED).select("doc_id", "text", "runs", "rest"), window, whole_letters)
    whole = picked(rows.select(*NAMED, "text", "copy", "rest"), names, "left_anti")
    size = F.octet_length("text").cast("long")
    gone = F.col("copy") & (size >= window)
    none = F.lit(0).cast("long")
    whole = whole.select("doc_id", size.alias("n_bytes"), F.when(gone, size).otherwise(none).alias("n_removed"), F.when(gone, F.lit(1).cast("long")).otherwise(none).alias("n_spans"), F.when(gone, F.lit(b"")).otherwise(F.col("text").cast("binary")).alias("kept"), "rest")
    return touched.unionByName(whole)


def without_repeats(docs: DataFrame, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows of `docs` with their columns, the text without what an earlier document has. A letter cut in two goes
    whole. A column n_chars is counted anew; null texts become empty.
    """
    out = dedup(docs, window, id_col, text_col, whole_letters=True)
    both = out.select(F.col("kept").cast("string").alias("text"), "rest")
    text = F.col("text")
    columns = [(text if c == text_col else F.length(text).cast(docs.schema[c].dataType) if c == "n_chars" else F.col("rest")[c]).alias(c) for c in docs.columns]
    return both.select(*columns)
