"""Lempel-Ziv phrase fingerprints: the set of phrases that a greedy parse adds, by its smallest hashes."""

from __future__ import annotations

import base64
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import U64, map_batches, mix, partitions

#: Smallest hashes kept of a text's phrases.
KEPT = 128


def parse(data: bytes, phrases: set[bytes], start: int = 0, end: int | None = None) -> int:
    """Add the phrases of data[start:] to `phrases`: each the shortest that isn't there yet. Where the unfinished phrase begins."""
    end = start + 1 if end is None else end
    add = phrases.add
    for end in range(end, len(data) + 1):
        phrase = data[start:end]
        if phrase not in phrases:
            add(phrase)
            start = end
    return start


def signature(phrases: set[bytes], kept: int = KEPT) -> np.ndarray:
    """The smallest 32-bit hashes of the phrases, sorted."""
    if not phrases:
        return np.zeros(0, np.uint32)
    h = np.fromiter(map(crc32, phrases), np.uint64, len(phrases))
    h = (mix(h + U64(0x51ED270B)) >> U64(32)).astype(np.uint32)
    if len(h) > 2 * kept:
        h = np.partition(h, 2 * kept)[: 2 * kept]
    return np.unique(h)[:kept]


def likeness(a: np.ndarray, b: np.ndarray, kept: int = KEPT) -> float:
    """Estimated Jaccard similarity of two phrase sets from their smallest hashes; two empty ones are alike."""
    if not len(a) or not len(b):
        return float(len(a) == len(b))
    both = np.union1d(a, b)[:kept]
    return float(np.isin(both, np.intersect1d(a, b, assume_unique=True), assume_unique=True).mean())


def text_of(signature: np.ndarray) -> str:
    return base64.b64encode(signature.astype("<u4").tobytes()).decode()


def fingerprint_of(text: str | None) -> str:
    phrases: set[bytes] = set()
    data = (text or "").encode()
    rest = data[parse(data, phrases) :]
    if rest:
        phrases.add(rest)
    return text_of(signature(phrases))


def compared(text: str, head: str) -> tuple[str, np.ndarray, np.ndarray]:
    """The text with its last third replaced by as much of `head`; fingerprints of the text and of that."""
    third = len(text) // 3
    common = text[: len(text) - third]
    edited = common + head[:third]
    shared: set[bytes] = set()
    data, other = text.encode(), edited.encode()
    cut = len(common.encode())
    start = parse(data[:cut], shared)  # the same phrases begin both
    found = []
    for x in (data, other):
        phrases = shared.copy()
        rest = x[parse(x, phrases, start, cut + 1) :]
        if rest:
            phrases.add(rest)
        found.append(signature(phrases))
    return edited, *found


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and fingerprint of each text; null counts as empty, whose fingerprint is empty."""

    def run(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([fingerprint_of(x) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "fingerprint"])

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")), run, "doc_id long, fingerprint string")


def edited_and_next(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Fingerprint of each text and of an edited text, and their likeness, as measures of the method.

    The edited text has the last third of its code points replaced by the first as many of the next document's,
    by descending id; after the last comes the first. near_next compares with that next document. Null texts count as
    empty; null ids come last, by a hash of their text, so that they don't all meet in one range; rows with one id are ordered
    by hash and text. One row alone is its own next. Texts of any length are read whole; repeated rows each have a result. An
    empty table gives none. Other columns aren't carried, whatever their names.

    Neighbours meet by ranges of ids; where a range ends, the first text of the following range comes along.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), F.coalesce(docs[text_col].cast("string"), F.lit("")).alias("text"))
    order = F.coalesce(F.col("doc_id"), F.lit(-(1 << 63)) + F.shiftrightunsigned(F.xxhash64("text"), 20))
    rows = rows.withColumn("at", order)
    n = partitions(docs)
    # Bounds of the ranges: one number for each partition.
    bounds = sorted({int(x) for x in rows.stat.approxQuantile("at", [i / n for i in range(1, n)], 1 / (4 * n))}) if n > 1 else []
    part = F.lit(0)
    if bounds:
        part = F.expr(f"aggregate(array({','.join(f'{b}L' for b in bounds)}), 0, (a, b) -> a + int(at > b))")
    rows = rows.withColumn("part", part.cast("int"))
    n_parts = len(bounds) + 1
    # The highest row of each range is what follows the lowest of the range above it.
    tops = rows.groupBy("part").agg(F.max(F.struct("at", F.xxhash64("text").alias("h"))).alias("top")).collect()  # a row for each range
    tops = sorted((r["part"], r["top"]["at"], r["top"]["h"]) for r in tops)
    fields = "doc_id long, n_chars long, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    if not tops:
        return spark.createDataFrame([], fields)
    above = {p: tops[(i + 1) % len(tops)][0] for i, (p, _, _) in enumerate(tops)}
    lent = spark.createDataFrame([(p, at, h, above[p]) for p, at, h in tops], "part int, at long, h long, part_above int")
    # For each range one row: rows alike in id and hash are alike, so any of them does.
    extra = rows.withColumn("h", F.xxhash64("text")).join(F.broadcast(lent), ["part", "at", "h"]).groupBy("part_above", "at", "h").agg(F.first("text").alias("text"))
    extra = extra.select(F.lit(None).cast("long").alias("doc_id"), "text", "at", F.col("part_above").alias("part"), F.lit(1).alias("lent"), "h")
    own = rows.select("doc_id", "text", "at", "part", F.lit(0).alias("lent"), F.xxhash64("text").alias("h"))
    dealt = own.unionByName(extra).repartitionById(n_parts, F.col("part")).sortWithinPartitions("part", "lent", F.desc("at"), F.desc("h"), "text")

    return _stream(dealt, fields)


def _stream(dealt: DataFrame, fields: str) -> DataFrame:
    names = [f.strip().split()[0] for f in fields.split(",")]
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]

    def run(batches):
        waiting = None  # id, code points, edited text, two fingerprints: all but near_next
        above = None  # id and text of the row before, which the row at hand follows

        def closed(next_signature):
            doc_id, n_chars, edited, own, other = waiting
            return doc_id, n_chars, edited, text_of(own), text_of(other), likeness(own, other), likeness(own, next_signature)

        for b in batches:
            out = []
            for doc_id, text, lent in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(4).to_pylist()):
                if above is not None:
                    edited, own, other = compared(above[1], text)
                    if waiting:
                        out.append(closed(own))
                    waiting = (above[0], len(above[1]), edited, own, other)
                above = (doc_id, text)
                if lent:  # the end of a range
                    phrases: set[bytes] = set()
                    data = text.encode()
                    rest = data[parse(data, phrases) :]
                    if rest:
                        phrases.add(rest)
                    out.append(closed(signature(phrases)))
                    waiting = above = None
            columns = list(zip(*out)) if out else [()] * len(names)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], names)

    return map_batches(dealt, run, fields)
