"""Global shuffle into shards in two passes: scatter to buckets by seeded hash, then Fisher-Yates in each bucket."""

from __future__ import annotations

from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from latticework.llm.common import partitions, stored, work_dir

#: Bytes of text that a bucket holds on average; a task holds one bucket at a time.
BUCKET_BYTES = 16 << 20
#: Copies of a row that one task writes out at a time.
COPIES = 1 << 16
#: Buckets whose rows are counted up together; rows that a broadcast of repeated rows or of bucket offsets may have (at most 100 bytes each).
RUN, BROADCAST_ROWS = 4096, 100_000


def text_size(text: Column) -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1


def text_crc32(text: Column) -> Column:
    return F.crc32(F.coalesce(text, F.lit("")).cast("binary"))


def fisher_yates(n: int, seed: list[int]) -> np.ndarray:
    order = np.arange(n)
    draws = np.random.Generator(np.random.PCG64(seed)).random(n)
    for i in range(n - 1, 0, -1):
        j = int(draws[i] * (i + 1))
        order[i], order[j] = order[j], order[i]
    return order


def apart(rows: DataFrame) -> tuple[DataFrame, int]:
    """The rows (doc_id, text and more that they decide), each with a number `copy` among its like, and their bytes.

    Rows alike are one and the same, so those that repeat are kept once and written out again by their number: in
    no task do more than COPIES of them come from one row.
    """
    keys = ["doc_id", "size", "one", "two"]
    rows = rows.withColumns({"one": F.xxhash64("text"), "two": F.xxhash64(F.lit(1), "text")})
    alike = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    again = stored(alike.where("n > 1"), "shuffle-repeated")
    n_again = again.count()
    total = alike.agg(F.sum(F.col("size") * F.col("n"))).first()[0] or 0
    if not n_again:
        return rows.withColumn("copy", F.lit(0).cast("long")).drop("one", "two"), total
    again = F.broadcast(again) if n_again <= BROADCAST_ROWS else again
    on = [rows[k].eqNullSafe(again[k]) for k in keys]
    single = rows.join(again, on, "left_anti").withColumn("copy", F.lit(0).cast("long"))
    kept = rows.join(again.select(*(F.col(k).alias(f"again_{k}") for k in keys), "n"), [rows[k].eqNullSafe(F.col(f"again_{k}")) for k in keys])
    kept = kept.groupBy(*keys, "text_crc32").agg(F.first("text").alias("text"), F.first("n").alias("n"))
    kept = kept.withColumn("first", F.explode(F.expr(f"sequence(0L, n - 1, {COPIES}L)"))).repartition(partitions(rows), *keys, "first")
    kept = kept.withColumn("copy", F.explode(F.expr(f"sequence(first, least(n, first + {COPIES}L) - 1)")))
    return single.select("doc_id", "text", "size", "text_crc32", "copy").unionByName(kept.select("doc_id", "text", "size", "text_crc32", "copy")), total


def shuffle_into_shards(docs: DataFrame, n_shards: int = 8, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Shuffle all rows uniformly, in an order that seed and content decide, and deal the order into
    `n_shards` shards whose row counts differ by one at most. Returns doc_id, text, size, text_crc32, shard, slot;
    slots are gapless from 0 in each shard.

    Null texts are kept and count one byte; so are null ids. Repeated rows are kept, each drawn for itself and with a slot
    of its own; how the table is split or ordered changes nothing. An empty table gives an empty table. Other columns are not carried.
    """
    spark = docs.sparkSession
    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    rows = rows.withColumns({"size": text_size(F.col("text")), "text_crc32": text_crc32(F.col("text"))})
    rows, total = apart(rows)
    n_buckets = max(partitions(docs), -(-total // bucket_bytes), 1)
    rows = rows.withColumn("draw", F.xxhash64(F.lit(seed), "doc_id", "text_crc32", "size", "copy")).drop("copy")
    rows = rows.withColumn("bucket", F.pmod(F.xxhash64("draw"), F.lit(n_buckets)).cast("int"))

    def deal(keys: tuple[pa.Scalar, ...], bucket: pa.Table) -> pa.Table:
        bucket = bucket.sort_by([("draw", "ascending"), ("doc_id", "ascending")])
        bucket = bucket.take(pa.array(fisher_yates(len(bucket), [seed, keys[0].as_py()])))
        return bucket.drop_columns(["draw"]).append_column("place", pa.array(np.arange(len(bucket))))

    fields = "doc_id long, text string, size long, text_crc32 long, bucket int, place long"
    dealt = rows.groupBy("bucket").applyInArrow(deal, fields)
    path = work_dir(spark, "shuffled")
    dealt.write.parquet(path)
    dealt = spark.read.schema(fields).parquet(path)

    # Where each bucket begins: counted up within runs of buckets, and over the runs.
    counts = stored(dealt.groupBy("bucket").agg(F.count("*").alias("n")).withColumn("run", F.expr(f"bucket div {RUN}")), "shuffle-counts")
    runs = sorted(counts.groupBy("run").agg(F.sum("n").alias("n")).collect())  # one row for 64 GB of text
    before = list(accumulate([r["n"] for r in runs], initial=0))
    n_rows = before[-1]
    starts = F.broadcast(spark.createDataFrame([(r["run"], b) for r, b in zip(runs, before)], "run long, start long"))
    inside = F.sum("n").over(W.partitionBy("run").orderBy("bucket")) - F.col("n")
    offsets = counts.withColumn("inside", inside).join(starts, "run").select("bucket", (F.col("start") + F.col("inside")).alias("before"))
    offsets = F.broadcast(offsets) if n_buckets <= BROADCAST_ROWS else offsets
    at = F.col("before") + F.col("place")
    shard = F.expr(f"((before + place) * {n_shards}L) div {max(n_rows, 1)}L").cast("int")
    out = dealt.join(offsets, "bucket").withColumn("shard", shard)
    return out.withColumn("slot", at - F.expr(f"(shard * {n_rows}L + {n_shards - 1}L) div {n_shards}L")).drop("bucket", "place", "before")


def write_shards(docs: DataFrame, path: str, **options) -> None:
    """Write the shuffled rows as Parquet, a folder for each shard."""
    shuffle_into_shards(docs, **options).write.partitionBy("shard").parquet(path)
