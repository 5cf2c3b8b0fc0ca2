"""Spelling variants: words one edit apart, found by a positional q-gram index that is split by the part of a word left as it is."""

from __future__ import annotations

import re
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator
from heapq import merge
from itertools import groupby
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import map_batches, stored

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}
#: Least code points of a word, and its least number of occurrences in the table.
MIN_CHARS, MIN_COUNT = 5, 3
#: Length of the grams; one edit changes at most this many of them.
Q = 2
#: Code points of a text that are searched for words at a time.
SLICE = 1 << 20
#: Words that are held at a time for matching, beyond those of one cell of the index.
HELD = 20_000


def slices(text: str) -> Iterator[str]:
    """Pieces of about SLICE code points that cut no run of letters; a longer run stays whole."""
    start = 0
    while start < len(text):
        end = min(len(text), start + SLICE)
        while end < len(text) and LETTERS.match(text[end]):
            end += 1
        yield text[start:end]
        start = end


def counted(doc_id: int | None, text: str | None, every: int | None) -> Counter:
    """How often a text has each word. If `every` divides the hash of a word in its document, one letter is left out, so
    that a document has the same variant of a word throughout; a null id counts as an empty one.
    """
    out, salt = Counter(), zlib.crc32(f"{'' if doc_id is None else doc_id}:".encode())
    for piece in slices(text or ""):
        for word, n in Counter(LETTERS.findall(piece.translate(LOWER))).items():
            h = zlib.crc32(word.encode(), salt)
            if every and h % every == 0:
                at = h % len(word)
                word = word[:at] + word[at + 1 :]
            out[word] += n
    return out


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = 97) -> DataFrame:
    """word, n: words of at least MIN_CHARS code points that `docs` has at least MIN_COUNT times, with their number.

    Words are maximal runs of letters of whole texts, A to Z in lower case. With `every`, one in so many pairs of word and document is
    misspelt. Null and empty texts have no words, repeated rows count again, an empty table has no words.
    Every batch of texts counts its own words first, so that a frequent word is a few rows a batch in the shuffle.
    """

    def run(batches):
        for b in batches:
            n = Counter()
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1)):
                for word, times in counted(doc_id, text.as_py(), every).items():
                    if len(word) >= MIN_CHARS:
                        n[word] += times
            yield pa.RecordBatch.from_arrays([pa.array(n.keys(), pa.string()), pa.array(n.values(), pa.int64())], ["word", "n"])

    rows = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return map_batches(rows, run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= MIN_COUNT)


def cells(words: DataFrame) -> DataFrame:
    """Where each word (word, n) stands in the index: shorter, chunk, kept, extra, middle, word, n.

    In a pair of words one edit apart, the shorter one of m code points falls into m // 2 chunks of two or three. The edit
    is in one chunk, and all that stands before and after it is the same in both. So a word has one row for each chunk that may hold
    the edit, once as the shorter one (extra 0) and once as one that has a code point more (extra 1), and near words meet in a cell
    (shorter, chunk, kept): their grams at these positions are alike, and only the grams of the middle are left to count.
    A cell has no more words than two, three or four letters can spell.
    """
    size = F.length("word")
    rows = words.where(F.length("word") > 0).select("word", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("extra"))
    rows = rows.withColumn("shorter", size - F.col("extra")).where("shorter > 0")
    rows = rows.withColumn("chunks", F.greatest(F.lit(1), F.floor(F.col("shorter") / 2).cast("int")))
    rows = rows.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    start = F.floor(F.col("shorter") * F.col("chunk") / F.col("chunks")).cast("int")
    end = F.floor(F.col("shorter") * (F.col("chunk") + 1) / F.col("chunks")).cast("int") + F.col("extra")
    rows = rows.withColumn("start", start).withColumn("end", end)
    kept = F.concat(F.substr("word", F.lit(1), F.col("start")), F.lit(" "), F.substr("word", F.col("end") + 1))
    return rows.select("shorter", "chunk", kept.alias("kept"), "extra", F.substr("word", F.col("start") + 1, F.col("end") - F.col("start")).alias("middle"), "word", "n")


def grams(middle: str) -> list[tuple[int, str]]:
    """Positional grams of what stands between the kept parts, with a sign for either side."""
    padded = f"<{middle}>"
    return [(i, padded[i : i + Q]) for i in range(len(padded) - Q + 1)]


def one_edit(a: str, b: str) -> bool:
    """a and b, which isn't shorter than a, differ by exactly one replaced or inserted code point."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def near_in_cell(middles: list[tuple[int, str]], chunk: int) -> Iterator[tuple[int, int]]:
    """Pairs of rows (extra, middle) of a cell that are one edit apart, the shorter one first; each pair of words once in all cells.

    Postings are lists of row numbers by gram, position and extra. For each row those of its own grams are merged by a heap: at the same position for
    rows as long, at the same or the next one for longer ones. A row that comes up as often as one edit must leave
    of the longer one's grams, at least len(middle) + 1 - Q, is looked at in full.
    """
    postings = defaultdict(list)
    for row, (extra, middle) in enumerate(middles):
        for at, gram in grams(middle):
            postings[extra, at, gram].append(row)
    for row, (extra, middle) in enumerate(middles):
        if extra:
            continue  # longer words are found, and don't look for others
        own = grams(middle)
        for longer in (0, 1):
            lists = [found for at, gram in own for shift in range(longer + 1) if (found := postings.get((longer, at + shift, gram)))]
            least = len(middle) + longer + 1 - Q
            if least <= 0:  # words of one letter share no gram
                lists.append([i for i, (e, _) in enumerate(middles) if e == longer])
            for other, times in groupby(merge(*lists)):
                if not longer and other <= row:
                    continue
                if sum(1 for _ in times) >= least and one_edit(middle, middles[other][1]):
                    if longer and chunk and middles[other][1][1:] == middle:
                        continue  # the letter may as well stand in the chunk before, where the pair is found
                    yield row, other


class Best:
    """Of some words: how many near ones each has, and the nearest of largest count (ties: smallest)."""

    def __init__(self) -> None:
        self.rows: dict[str, list] = {}

    def word(self, word: str, n: int | None) -> list:
        row = self.rows.setdefault(word, [None, 0, None, None])
        if n is not None:
            row[0] = n
        return row

    def pair(self, word: str, near: str, n: int) -> None:
        row = self.word(word, None)
        row[1] += 1
        if row[3] is None or (-n, near) < (-row[3], row[2]):
            row[2], row[3] = near, n

    def batch(self) -> pa.RecordBatch:
        columns = list(zip(*self.rows.values())) or [[], [], [], []]
        out = [pa.array(self.rows.keys(), pa.string()), *(pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.int64())))]
        self.rows = {}
        return pa.RecordBatch.from_arrays(out, ["word", "n", "n_near", "near", "near_n"])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, n_near, near, near_n of distinct `words` (word, n): the number of near words, and the one of largest n (ties: the smallest in code-point order).

    Cells are dealt by hash and sorted within their task, so that a task goes through its cells one after the other; it holds a cell
    and about HELD words of results. What it finds about a word is added up before the shuffle by word. Words without a near one have
    n_near 0 and null; null and empty words are left out.
    """

    def run(batches):
        best = Best()
        rows = (row for b in batches for row in zip(*(b.column(i).to_pylist() for i in range(b.num_columns))))
        for (_, chunk, _), cell in groupby(rows, itemgetter(0, 1, 2)):
            cell = list(cell)
            for _, _, _, extra, _, word, n in cell:
                if not chunk and not extra:
                    best.word(word, n)  # each word once
            if len(cell) > 1:
                for a, b in near_in_cell([(row[3], row[4]) for row in cell], chunk):
                    best.pair(cell[a][5], cell[b][5], cell[b][6])
                    best.pair(cell[b][5], cell[a][5], cell[a][6])
            if len(best.rows) > HELD:
                yield best.batch()
        yield best.batch()

    dealt = cells(words).repartition("shorter", "chunk", "kept").sortWithinPartitions("shorter", "chunk", "kept")
    found = map_batches(dealt, run, "word string, n long, n_near long, near string, near_n long")
    first = F.min(F.when(F.col("near").isNotNull(), F.struct((-F.col("near_n")).alias("less"), "near")))
    out = found.groupBy("word").agg(F.max("n").alias("n"), F.sum("n_near").alias("n_near"), first.alias("first"))
    return out.select("word", "n", "n_near", F.col("first.near").alias("near"), (-F.col("first.less")).alias("near_n"))


def roots(forms: DataFrame) -> DataFrame:
    """word, root of `forms` (word, form, no circles): the end of the chain of forms. Each round doubles the length of the steps, so
    that their number grows with the logarithm of the longest chain, which is itself at most the logarithm of the largest count.
    """
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("ahead"))
        ahead = stored(now.join(ahead, "root", "left").select("word", F.coalesce("ahead", "root").alias("root"), F.col("ahead").isNotNull().alias("moved")), "roots")
        if ahead.where("moved").isEmpty():
            return now
        now = ahead.select("word", "root")


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """word, form, root, n, n_near, form_n of distinct `words` (word, n): a word's form is its near word of largest n, if that is at least `times` its own."""
    near = near_words(words)
    common = F.col("near_n") >= times * F.col("n")
    rows = stored(near.select("word", F.when(common, F.col("near")).alias("form"), "n", "n_near", F.when(common, F.col("near_n")).alias("form_n")), "variants")
    ends = roots(rows.where("form IS NOT NULL").select("word", "form"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", every: int | None = 97) -> DataFrame:
    """The variants of the words of `docs`, see `vocabulary` for rows and texts and `variants` for the result."""
    return variants(vocabulary(docs, id_col, text_col, every))
