"""What a captured command output is, and short summaries of it, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: What tells the formats apart.
SEARCH_LINE = r"^[^:\n]+:\d+:"
SEARCH_SHARE = 0.6


def nonempty_lines(text: Column) -> Column:
    return F.filter(F.split(text, "\n"), lambda x: F.trim(x) != "")


def detect_format(text: Column) -> Column:
    """diff, json, pytest, search or text, by the first sign found in that order."""
    lines = nonempty_lines(text)
    hits = F.size(F.filter(lines, lambda x: F.regexp_like(x, F.lit(SEARCH_LINE))))
    body = F.trim(text)
    is_json = (body.startswith("{") | body.startswith("[")) & F.try_parse_json(body).isNotNull()
    is_diff = F.regexp_like(text, F.lit(r"(?m)^diff --git |^@@ -\d+"))
    is_pytest = F.regexp_like(text, F.lit(r"(?m)^=+ .*(?:passed|failed|error).* =+$|^=+ test session starts =+$"))
    return F.when(is_diff, "diff").when(is_json, "json").when(is_pytest, "pytest").when((F.size(lines) > 0) & (hits >= SEARCH_SHARE * F.size(lines)), "search").otherwise("text")


def clip_line(line: Column, width: int = 120) -> Column:
    return F.when(F.length(line) > width, F.concat(F.substring(line, 1, width - 1), F.lit("…"))).otherwise(line)


def excerpt(text: Column, head: int, tail: int) -> Column:
    """The first and last lines, and how many were left out between."""
    lines = F.split(text, "\n")
    n = F.size(lines)
    cut = F.concat(F.slice(lines, 1, head), F.array(F.concat(F.lit("… "), (n - head - tail).cast("string"), F.lit(" lines …"))), F.slice(lines, -tail, tail))
    return F.array_join(F.when(n > head + tail, cut).otherwise(lines), "\n")


def pytest_tally(text: Column, outcome: str) -> Column:
    """The number before the outcome's name in the last summary line. Anchored, so that a text without one is gone through once."""
    return F.coalesce(F.nullif(F.regexp_extract(text, rf"(?s)\A.*\b(\d+) {outcome}", 1), F.lit("")).cast("long"), F.lit(0).cast("long"))


def search_tally(captures: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """For each capture and path, the number of lines `path:line:` in a search's output."""
    lines = captures.select(id_col, F.explode(nonempty_lines(F.col(text_col))).alias("line"))
    path = F.regexp_extract("line", r"^([^:\n]+):\d+:", 1)
    return lines.withColumn("path", path).where("path <> ''").groupBy(id_col, "path").agg(F.count("*").alias("matches"))


def diff_totals(captures: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """Files, hunks, added and removed lines of each diff."""
    lines = captures.select(id_col, F.explode(F.split(F.col(text_col), "\n")).alias("line"))
    count = lambda c, name: F.sum(F.when(c, 1).otherwise(0)).cast("long").alias(name)
    line = F.col("line")
    return lines.groupBy(id_col).agg(
        count(line.startswith("diff --git "), "files"),
        count(line.startswith("@@ "), "hunks"),
        count(line.startswith("+") & ~line.startswith("+++"), "added"),
        count(line.startswith("-") & ~line.startswith("---"), "removed"),
    )


def blobs(captures: DataFrame, text_col: str, order_col: str) -> DataFrame:
    """A content-addressed store: for each distinct content its digest, size, first holder and number of holders."""
    digest = F.sha2(F.col(text_col).cast("binary"), 256)
    return captures.select(digest.alias("digest"), F.octet_length(text_col).cast("long").alias("bytes"), F.col(order_col)).groupBy("digest").agg(F.max("bytes").alias("bytes"), F.min(order_col).alias("first"), F.count("*").alias("holders"))


def json_shape(text: Column) -> Column:
    """The schema of a JSON text, NULL for any other text."""
    parsed = F.try_parse_json(text)
    return F.when(parsed.isNotNull(), F.schema_of_variant(parsed))


#: Places whose amounts are added up together.
RUN = 1000


def running(df: DataFrame, place: Column, amount: str) -> DataFrame:
    """The rows with `total`, the sum of the amounts up to their own by ascending place (whole numbers, one row for each).

    Within runs of places, then over the runs: a task sees the places of one run, and one row for each run before it.
    """
    rows = df.withColumn("_place", place.cast("long")).withColumn("_run", F.floor(F.col("_place") / RUN))
    runs = rows.groupBy("_run").agg(F.sum(amount).alias("_sum"))
    runs = runs.select("_run", (F.sum("_sum").over(W.orderBy("_run")) - F.col("_sum")).alias("_before"))
    inside = F.sum(amount).over(W.partitionBy("_run").orderBy("_place"))
    return rows.withColumn("_inside", inside).join(runs, "_run").withColumn("total", F.col("_before") + F.col("_inside")).drop("_place", "_run", "_inside", "_before")


def evicted(blobs: DataFrame, stored_at: str, bytes_: str, now: Column, ttl_days: int, most_bytes: int) -> DataFrame:
    """What goes from a store: what is older than the time to live, then whole days, oldest first, beyond the size limit."""
    day = F.to_date(stored_at)
    old = F.col(stored_at) < now - F.make_dt_interval(F.lit(ttl_days))
    days = blobs.where(~old).groupBy(day.alias("_day")).agg(F.sum(bytes_).alias("_b"))
    kept = running(days, -F.unix_date("_day"), "_b").where(F.col("total") <= most_bytes).select("_day")
    return blobs.withColumn("_day", F.when(~old, day)).join(kept, "_day", "left_anti").drop("_day")
