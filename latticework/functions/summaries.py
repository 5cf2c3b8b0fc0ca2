"""Summaries of captured output that fit into a number of bytes: sections of diffs, ranked matches, and levels of detail from fine to coarse."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from latticework.functions.captures import clip_line, detect_format, json_shape, nonempty_lines, pytest_tally

#: Items of a list, lines of an excerpt and characters of a line that are shown at most, bytes of a summary, the number of times
#: that the limits are halved, and the least length to which a line is cut.
MAX_ITEMS, MAX_LINES, MAX_LINE_CHARS, MAX_BYTES = 8, 30, 400, 4096
ROUNDS, LEAST_CHARS = 6, 80
TALLIES = ("passed", "failed", "skipped")


#: The path of a file in a diff. As in Java's patterns a dot is none of the line terminators, and one may stand at the end.
DOT, END = r"[^\n\r\x85\u2028\u2029]", r"(?=[\r\x85\u2028\u2029]?\Z)"
GIT, PLUS = re.compile(rf"diff --git a/{DOT}+? b/({DOT}+){END}"), re.compile(rf"\+\+\+ (?:b/)?({DOT}+?)(?:\t{DOT}*)?{END}")


def sections_of(text: str) -> list[list]:
    """section, path, added, removed, hunks, first_line, last_line of each file in one diff."""
    out, now, event, n = [], None, "hunk", 0
    for n, line in enumerate(text.split("\n"), 1):
        plus, hunk = line.startswith("+++ "), line.startswith("@@")
        git = GIT.match(line) if line.startswith("diff") else None
        if git or (plus and event == "hunk"):
            if now:
                now[6] = n - 1
            now = [len(out) + 1, None, 0, 0, 0, n, n]
            out.append(now)
        event = "git" if git else "plus" if plus else "hunk" if hunk else event
        if not now:
            continue
        if plus:
            path = PLUS.match(line)
            now[1] = path[1] if path else "?"
        elif git:
            now[1] = git[1]
        elif line.startswith("+"):
            now[2] += 1
        elif line.startswith("-") and not line.startswith("---"):
            now[3] += 1
        elif hunk:
            now[4] += 1
    if now:
        now[6] = n
    return out


def diff_sections(captures: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, section (from 1), path, added, removed, hunks, first_line, last_line of each file in each diff.

    A file begins at `diff --git`, or at a line of +++ where a hunk, or nothing, came before it: the running count of such lines
    numbers the sections. Other lines of +++ name the path anew. What stands before the first file counts for none. Null ids and texts have no section.
    A text is read in its own row, so that a task holds one batch of texts and no lines to sort; rows of equal ids have sections of their own.
    """
    rows = captures.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("_id"), F.regexp_replace(text_col, "\n$", "").alias("_text")).where("_text is not null")
    whole, short = (pa.int64(), T.LongType()), (pa.int32(), T.IntegerType())
    fields = {"section": whole, "path": (pa.string(), T.StringType()), "added": whole, "removed": whole, "hunks": whole, "first_line": short, "last_line": short}

    def run(batches):
        for b in batches:
            found = [(i, *s) for i, text in enumerate(b.column(1).to_pylist()) for s in sections_of(text)]
            if found:
                at, *columns = zip(*found)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at)), *(pa.array(c, t) for c, (t, _) in zip(columns, fields.values()))], ["_id", *fields])

    schema = T.StructType([rows.schema["_id"], *(T.StructField(name, t) for name, (_, t) in fields.items())])
    return rows.mapInArrow(run, schema).withColumnRenamed("_id", id_col)


def ranked_matches(captures: DataFrame, text_col: str, id_col: str) -> DataFrame:
    """id, matches: the paths of a search's output with their numbers of lines, most first, then by path."""
    lines = captures.where(F.col(id_col).isNotNull()).select(id_col, F.explode(nonempty_lines(F.col(text_col))).alias("line"))
    path = F.regexp_extract("line", r"^([^:\n]+):\d+:", 1)
    tally = lines.withColumn("path", path).where("path <> ''").groupBy(id_col, "path").agg(F.count("*").alias("n"))
    ranked = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("_less"), "path")))
    return tally.groupBy(id_col).agg(F.transform(ranked, lambda x: F.struct(x["path"].alias("path"), (-x["_less"]).alias("matches"))).alias("matches"))


def fitting(candidates: list[Column], most_bytes: int) -> Column:
    """The first of the texts, from fine to coarse, that has at most so many bytes; the last if none has."""
    out = candidates[-1]
    for c in reversed(candidates[:-1]):
        out = F.when(F.octet_length(c) <= most_bytes, c).otherwise(out)
    return out


def levels(items: int, lines: int, chars: int) -> list[tuple[int, int, int]]:
    """The limits, and those that halving them gives, each at least one (a line at least LEAST_CHARS)."""
    out = [(items, lines, chars)]
    while len(out) <= ROUNDS:
        i, n, c = out[-1]
        smaller = (max(1, i // 2), max(1, n // 2), max(LEAST_CHARS, c // 2))
        if smaller == out[-1]:
            break
        out.append(smaller)
    return out


def summaries(captures: DataFrame, text_col: str, id_col: str, items: int = MAX_ITEMS, lines: int = MAX_LINES, chars: int = MAX_LINE_CHARS, most_bytes: int = MAX_BYTES) -> DataFrame:
    """id, format, summary (JSON of at most `most_bytes`) of each capture; one row for each id, which must be distinct.

    Every summary has its format and number of lines. A diff has its totals and its first files; a search its number of paths and those with most
    matches; a run of tests its tallies; JSON its shape; a text its first and last lines. Lists and lines are cut at ever smaller limits until the bytes
    suffice, and left out at last. What claims a format but has nothing of it is a text. A null text is an empty one.
    """
    rows = captures.select(F.col(id_col).alias("_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    files = diff_sections(rows, "text", "_id")
    one = F.struct("section", "path", "added", "removed", "hunks", "first_line", "last_line")
    files = files.groupBy("_id").agg(F.array_sort(F.collect_list(one)).alias("files"))
    # What the texts tell is found before the joins, once; behind them only short columns are looked at.
    all_ = F.split(F.regexp_replace("text", "\n$", ""), "\n")
    n = F.size(all_)
    told = rows.select(
        "_id",
        detect_format(F.col("text")).alias("claimed"),
        json_shape(F.col("text")).alias("shape"),
        *(pytest_tally(F.col("text"), k).alias(k) for k in TALLIES),
        F.when(F.col("text") == "", 0).otherwise(n).alias("lines"),
        F.transform(F.slice(all_, 1, lines), lambda x: clip_line(x, chars)).alias("head"),
        F.transform(F.slice(all_, F.greatest(F.lit(lines), n - lines) + 1, lines), lambda x: clip_line(x, chars)).alias("tail"),
    )
    rows = told.join(files, "_id", "left").join(ranked_matches(rows, "text", "_id"), "_id", "left")
    claimed = F.col("claimed")
    empty = F.when(claimed == "diff", F.col("files").isNull()).when(claimed == "search", F.col("matches").isNull()).when(claimed == "pytest", sum(F.col(k) for k in TALLIES) == 0)
    rows = rows.withColumn("format", F.when(empty, "text").otherwise(claimed))
    total = lambda f: F.aggregate("files", F.lit(0).cast("long"), lambda a, x: a + x[f])
    shown = lambda a, n: F.slice(F.col(a), 1, n)

    def text(limit: tuple[int, int, int] | None) -> Column:
        n_items, n_lines, n_chars = limit or (0, 0, 0)
        head = F.transform(shown("head", n_lines), lambda x: clip_line(x, n_chars))
        tail = F.transform(F.slice("tail", F.greatest(F.size("tail") - n_lines, F.lit(0)) + 1, max(1, n_lines)), lambda x: clip_line(x, n_chars))
        common = [F.col("format"), F.col("lines")]
        diff = [F.size("files").alias("files"), total("added").alias("added"), total("removed").alias("removed"), total("hunks").alias("hunks")]
        search = [F.size("matches").alias("paths")]
        tests = [F.col(k) for k in TALLIES]
        if limit:
            diff.append(F.transform(shown("files", n_items), lambda x: F.struct(x["path"].alias("path"), x["added"].alias("added"), x["removed"].alias("removed"), x["first_line"].alias("first_line"), x["last_line"].alias("last_line"))).alias("shown"))
            search.append(shown("matches", n_items).alias("shown"))
        plain = [head.alias("head"), tail.alias("tail")] if limit else []
        json_ = [F.when(F.octet_length("shape") <= most_bytes // 2, F.col("shape")).alias("shape")]
        as_json = lambda more: F.to_json(F.struct(*common, *more))
        return F.when(F.col("format") == "diff", as_json(diff)).when(F.col("format") == "search", as_json(search)).when(F.col("format") == "pytest", as_json(tests)).when(F.col("format") == "json", as_json(json_)).otherwise(as_json(plain))

    best = fitting([*(text(limit) for limit in levels(items, lines, chars)), text(None)], most_bytes)
    return rows.select(F.col("_id").alias(id_col), "format", best.alias("summary"))
