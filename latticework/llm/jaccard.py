"""Jaccard join on word n-grams: a MinHash LSH forest finds candidates, counting whole sets verifies them."""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from latticework.llm.common import BYTE_VALUE, U64, SpanHash, buffers, map_batches, mix, partitions, rounds, stored
from latticework.llm.components import components
from latticework.llm.quality import SPACE, spans

WORDS = 5
SIMILARITY = Fraction(4, 5)
#: The forest: trees, the longest prefix of each signature, and the share of links that it must find.
TREES, LONGEST_PREFIX, RECALL = 32, 8, 0.99999
#: Candidates are verified in blocks of so many sets, and of so many bytes of shingles.
BLOCK_SETS, BLOCK_BYTES = 1024, 8 << 20
#: So many documents are named in a broadcast at most (some 100 bytes each in memory); more are joined by shuffle.
BROADCAST_IDS = 200_000
#: What tells texts apart: the document's id and two hashes of the text.
NAMED = ["doc_id", "t1", "t2"]
#: Texts of one round: their numbers go into the upper 16 bits of a shingle.
ROUND_TEXTS = 50_000


def prefix_length(similarity: float, trees: int, longest: int, recall: float) -> int:
    """The longest prefix at which pairs of that similarity still meet in some tree with probability `recall`."""
    for k in range(longest, 0, -1):
        if meeting(similarity, trees, k) >= recall:
            return k
    raise ValueError(f"{trees} trees can't reach a recall of {recall}")


def shingle_sets(data: np.ndarray, at: np.ndarray, words: int = WORDS) -> tuple[np.ndarray, np.ndarray]:
    """48-bit shingles of each text, sorted and distinct, and where each text's begin. A text of fewer words has one shingle, one without words none."""
    n_texts = len(at) - 1
    if not len(data):
        return np.zeros(0, U64), np.zeros(n_texts + 1, np.int64)
    starts, ends = spans(~SPACE[data], at)
    first = np.searchsorted(starts, at)
    grams = SpanHash(SpanHash(BYTE_VALUE[data]).of(starts, ends))
    owner = np.searchsorted(at, starts, "right") - 1
    begin = np.arange(len(starts))
    last = first[owner + 1]
    keep = (begin + words <= last) | (begin == first[owner])
    begin, owner = begin[keep], owner[keep]
    h = grams.of(begin, np.minimum(begin + words, last[keep]))
    v = np.unique((owner.astype(U64) << U64(48)) | (h >> U64(16)))
    return v & U64((1 << 48) - 1), np.searchsorted(v >> U64(48), np.arange(n_texts + 1))


def meeting(similarity: float, trees: int, prefix: int) -> float:
    """The probability that a pair of that similarity shares a prefix of that length in some tree."""
    return 1 - (1 - similarity**prefix) ** trees


def sets_of(column: pa.Array, words: int = WORDS) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    data, at = buffers(column)
    for i, j in rounds(at):
        for k in range(i, j, ROUND_TEXTS):
            last = min(j, k + ROUND_TEXTS)
            yield k, last, *shingle_sets(data[at[k] : at[last]], at[k : last + 1] - at[k], words)


def signatures(shingles: np.ndarray, first: np.ndarray, trees: int, prefix: int) -> np.ndarray:
    """A key for each text and tree: the first `prefix` minimum hashes of its signature in that tree."""
    has = np.flatnonzero(np.diff(first))
    keys = np.zeros((len(first) - 1, trees), U64)
    if not len(has):
        return keys
    rng = np.random.Generator(np.random.PCG64(77))
    mixed = mix(shingles)
    for tree in range(trees):
        key = np.full(len(has), mix(np.array([tree + 1], U64))[0], U64)
        for _ in range(prefix):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            low = np.minimum.reduceat(mixed * (a * U64(2) + U64(1)) + b, first[:-1][has])
            key = mix(key + low)
        keys[has, tree] = key
    return keys


def minima(shingles: np.ndarray, first: np.ndarray, trees: int, longest: int) -> np.ndarray:
    """The signature of each text: by tree, 16 bits of each of its `longest` minimum hashes. Zeros for a text without shingles."""
    out = np.zeros((len(first) - 1, trees * longest), np.uint16)
    has = np.flatnonzero(np.diff(first))
    if len(has):
        rng, mixed = np.random.Generator(np.random.PCG64(77)), mix(shingles)
        for k in range(trees * longest):
            a, b = rng.integers(1, 1 << 63, 2, dtype=np.uint64)
            low = np.minimum.reduceat(mixed * (a * U64(2) + U64(1)) + b, first[:-1][has])
            out[has, k] = (mix(low) >> U64(48)).astype(np.uint16)
    return out


def nodes(signature: Column, trees: int, longest: int, prefix: int) -> Column:
    """The node at that depth of each tree's trie that a signature lies below."""
    part = lambda t: F.substr(signature, t * (2 * longest) + 1, F.lit(2 * prefix))
    return F.transform(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: F.xxhash64(t, part(t)))


def named(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The texts that have an id, with what tells them apart."""
    rows = docs.where(docs[id_col].isNotNull()).select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text"))
    return rows.withColumns({"t1": F.xxhash64("text"), "t2": F.xxhash64(F.lit(1), "text")})


def sketched(docs: DataFrame, words: int, trees: int, longest: int, id_col: str, text_col: str) -> DataFrame:
    """A number of each row, its name, the identity of its set (128 bits), the set's size and signature; rows without an id or a word are left out."""

    def run(batches):
        for b in batches:
            own = [b.column(k).to_numpy(zero_copy_only=False) for k in (1, 2, 3, 4)]
            for i, j, shingles, first in sets_of(b.column(0), words):
                size = np.diff(first)
                sums = [np.concatenate([[U64(0)], np.cumsum(mix(shingles + U64(k)))]) for k in (11, 23)]
                one, two = (s[first[1:]] - s[first[:-1]] for s in sums)
                keep = size > 0
                signed = minima(shingles, first, trees, longest)[keep]
                names = [pa.array(x[i:j][keep]) for x in own]
                yield pa.RecordBatch.from_arrays([*names, pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), pa.array(size[keep].astype(np.int64)), pa.array([x.tobytes() for x in signed], pa.binary())], ["row", *NAMED, "s1", "s2", "n", "signature"])

    rows = named(docs, id_col, text_col).select("text", F.monotonically_increasing_id().alias("row"), *NAMED)
    return map_batches(rows, run, "row long, doc_id long, t1 long, t2 long, s1 long, s2 long, n long, signature binary")


def overlaps(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of the sets numbered `left` with the others numbered `right`; a set with itself isn't counted whole."""
    flat = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    _, column, count = np.unique(flat, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    number = np.cumsum(count > 1) - 1
    column, owner = number[column[shared]], owner[shared]
    n_columns = int((count > 1).sum())
    out = np.zeros((len(left), len(right)), np.float32)
    row_of = [np.full(len(sets), -1), np.full(len(sets), -1)]
    row_of[0][left], row_of[1][right] = np.arange(len(left)), np.arange(len(right))
    squares = float((count[count > 1].astype(float) ** 2).sum())
    if squares * 20 < float(len(left)) * len(right) * n_columns:  # few share each: add up pairs of occurrences
        order = np.argsort(column, kind="stable")
        column, owner = column[order], owner[order]
        begin = np.searchsorted(column, np.arange(n_columns + 1))
        a = owner[row_of[0][owner] >= 0], column[row_of[0][owner] >= 0]
        by_row = np.argsort(a[0], kind="stable")
        rows, columns = a[0][by_row], a[1][by_row]
        bounds = np.searchsorted(rows, np.arange(len(sets) + 1))
        for i in left:
            c = columns[bounds[i] : bounds[i + 1]]
            if len(c):
                size = begin[c + 1] - begin[c]
                take = np.repeat(begin[c] - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
                out[row_of[0][i]] = np.bincount(owner[take], minlength=len(sets))[right]
        return out
    for c in range(0, n_columns, 4096):
        here = (column >= c) & (column < c + 4096)
        parts = []
        for rows in row_of:
            r = rows[owner[here]]
            m = np.zeros((int(rows.max()) + 1, 4096), np.float32)
            m[r[r >= 0], column[here][r >= 0] - c] = 1
            parts.append(m)
        out += parts[0] @ parts[1].T
    return out


def linked(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, similarity: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are at least that similar, and the similarity of all in per cent; a set isn't linked with itself."""
    size = np.array([len(s) for s in sets], np.int64)
    both = np.rint(overlaps(sets, left, right)).astype(np.int64)
    union = size[left][:, None] + size[right][None] - both
    return (both * similarity.denominator >= union * similarity.numerator) & (left[:, None] != right[None]), 100 * both // np.maximum(1, union)


def verify(unit: dict[str, list], similarity: Fraction) -> list[tuple[int | None, int | None, int]]:
    """Links in one block of a group of candidates, or between two: (set, None, documents linked with it), edges that join
    what is linked, and (None, per cent, links of that similarity).
    """
    _, keep = np.unique(np.array(unit["rep"]), return_index=True)
    reps = np.array(unit["rep"])[keep]
    copies, block = np.array(unit["copies"])[keep], np.array(unit["block"])[keep]
    sets = [np.frombuffer(unit["shingles"][i], np.uint64) for i in keep]
    if len(sets) < 2:
        return []
    low, high = unit["low"][0], unit["high"][0]
    left, right = np.flatnonzero(block == low), np.flatnonzero(block == high)
    if not len(left) or not len(right):
        return []
    links, cent = linked(sets, left, right, similarity)
    count = np.zeros(len(reps), np.int64)
    count[left] += links @ copies[right]
    if low != high:
        count[right] += links.T @ copies[left]
    out: list[tuple[int | None, int | None, int]] = [(int(reps[i]), None, int(count[i])) for i in np.flatnonzero(count)]
    out += [(None, int(c), int(n)) for c, n in zip(*np.unique(cent[links if low != high else np.triu(links)], return_counts=True))]
    free = count > 0
    for i in np.flatnonzero(free):
        if not free[i]:
            continue
        group = front = np.zeros(len(reps), bool)
        front[i] = True
        group = front.copy()
        while front.any():
            reached = np.zeros(len(reps), bool)
            reached[right] |= links[front[left]].any(axis=0)
            reached[left] |= links[:, front[right]].any(axis=1)
            front = reached & ~group
            group |= front
        free &= ~group
        out += [(int(reps[i]), int(reps[j]), 0) for j in np.flatnonzero(group) if j != i]
    return out


def verified(texts: DataFrame, groups: DataFrame, similarity: Fraction, n_words: int, n_tasks: int) -> DataFrame:
    """What verify() tells of whole groups of candidates: component, rep, other, links, many (the group has several blocks)."""
    groups = stored(groups, "jaccard-chosen")
    chosen = texts.join(F.broadcast(groups) if groups.count() <= BROADCAST_IDS else groups, NAMED)

    def shingle(batches):
        for b in batches:
            found = [s[f[k] : f[k + 1]].tobytes() for i, j, s, f in sets_of(b.column(1), n_words) for k in range(j - i)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), b.column(3), b.column(4), pa.array(found, pa.binary())], ["rep", "component", "copies", "blocks", "shingles"])

    whole = map_batches(chosen.select("rep", "text", "component", "copies", "blocks"), shingle, "rep long, component long, copies long, blocks int, shingles binary")
    whole = whole.withColumn("block", F.pmod(F.xxhash64("rep"), F.col("blocks")).cast("int"))
    whole = whole.withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    units = whole.select("component", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "rep", "copies", "block", "blocks", "shingles")
    units = units.repartition(n_tasks, "component", "low", "high").sortWithinPartitions("component", "low", "high")
    names = ["component", "low", "high", "rep", "copies", "block", "blocks", "shingles"]

    def check(batches):
        held: dict[str, list] = {k: [] for k in names}
        key = None

        def done():
            found = verify(held, similarity) if len(held["rep"]) > 1 else []
            many = held["blocks"][0] > 1
            return pa.RecordBatch.from_arrays([pa.array([held["component"][0]] * len(found), pa.int64()), *(pa.array([x[k] for x in found], pa.int64()) for k in range(3)), pa.array([many] * len(found), pa.bool_())], ["component", "rep", "other", "links", "many"])

        for b in batches:
            columns = [b.column(i).to_pylist() for i in range(len(names))]
            for row in zip(*columns):
                if row[:3] != key:
                    if key is not None:
                        yield done()
                    key, held = row[:3], {k: [] for k in names}
                for k, v in zip(names, row):
                    held[k].append(v)
        if key is not None:
            yield done()

    return map_batches(units, check, "component long, rep long, other long, links long, many boolean")


def classified(docs: DataFrame, similarity: Fraction = SIMILARITY, words: int = WORDS, trees: int = TREES, longest_prefix: int = LONGEST_PREFIX, recall: float = RECALL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Of each row with an id and a word its name, the number of its class, and what jaccard_join tells of it."""
    sketch = stored(sketched(docs, words, trees, longest_prefix, id_col, text_col), "jaccard-sketch")
    # A set goes by the number of its first row: two texts of one document are two sets.
    members = sketch.groupBy("s1", "s2").agg(F.min("row").alias("rep"), F.min("doc_id").alias("least"), F.count("*").alias("copies"), F.max("n").alias("n"), F.min_by(F.struct(*NAMED), "row").alias("named"))
    members = stored(members, "jaccard-sets")
    distinct = sketch.join(members.select("s1", "s2", F.col("rep").alias("row")), ["s1", "s2", "row"], "left_semi")
    forest = stored(distinct.select(F.col("row").alias("rep"), "signature"), "jaccard-forest")
    texts, found, before = named(docs, id_col, text_col), None, None
    # From the longest prefixes on, until what they found tells that the share of links is reached; no shorter than
    # pairs of the least similarity need. How short the next ones must be, the links found so far tell.
    prefix, shortest = longest_prefix, prefix_length(float(similarity), trees, longest_prefix, recall)
    while True:
        keyed = forest.select("rep", F.explode(nodes(F.col("signature"), trees, longest_prefix, prefix)).alias("key"))
        met = keyed.groupBy("key").agg(F.min("rep").alias("hub"), F.max("rep").alias("other")).where("hub < other").select("key", "hub")
        met = stored(met, "jaccard-met")  # a plain table: then Spark splits nodes that very many sets share
        edges = keyed.join(met, "key").where("rep <> hub").select(F.col("hub").alias("a"), F.col("rep").alias("b")).distinct()
        groups = components(edges, "jaccard-candidates")
        groups = stored(groups.join(members.select(F.col("rep").alias("node"), "copies", "n", "named.*"), "node"), "jaccard-groups")
        size = groups.groupBy("component").agg(F.count("*").alias("sets"), F.sum("n").alias("shingles"))
        size = stored(size.select("component", "sets", F.greatest(F.ceil(F.col("sets") / BLOCK_SETS), F.ceil(F.col("shingles") * 8 / BLOCK_BYTES)).cast("int").alias("blocks")), "jaccard-sizes")
        # Groups only grow, and go by their least set: one of the same size is the same.
        new = size if before is None else size.join(before.select("component", "sets"), ["component", "sets"], "left_anti")
        links = verified(texts, groups.join(new, "component").select(F.col("node").alias("rep"), "component", "copies", "blocks", *NAMED), similarity, words, partitions(docs))
        if before is not None:
            links = links.unionByName(found.join(size.join(before.select("component", "sets"), ["component", "sets"], "left_semi").select("component"), "component", "left_semi").select(links.columns))
        found, before = stored(links, "jaccard-links"), size
        cents = found.where("rep is null").groupBy("other").agg(F.sum("links").alias("n")).collect()  # a row for each per cent
        likely = [(max(r["other"] / 100, float(similarity)), r["n"]) for r in cents]
        there = [(c, n / meeting(c, trees, prefix)) for c, n in likely]
        reached = lambda k: sum(n * meeting(c, trees, k) for c, n in there) >= recall * sum(n for _, n in there)  # noqa: B023, E731
        if prefix <= shortest or there and reached(prefix):
            break
        prefix = next((k for k in range(prefix - 1, shortest, -1) if there and reached(k)), shortest)
    found = found.where("rep is not null")
    links = found.where("other is null").groupBy("rep").agg(F.sum("links").alias("links"))
    classes = found.where("other is not null and not many").select(F.col("other").alias("rep"), F.col("rep").alias("class"))
    joined = found.where("other is not null and many").select(F.col("rep").alias("a"), F.col("other").alias("b"))
    if not joined.isEmpty():
        classes = classes.unionByName(components(joined, "jaccard-classes").select(F.col("node").alias("rep"), F.col("component").alias("class")))
    whole = classes.unionByName(classes.select(F.col("class").alias("rep"), "class").distinct()).distinct()
    least = whole.join(members.select("rep", "least"), "rep").groupBy("class").agg(F.min("least").alias("class_id"))
    whole = stored(whole.join(least, "class"), "jaccard-members")
    known = members.join(links, "rep", "left").join(whole, "rep", "left")
    known = known.select("s1", "s2", F.col("least").alias("copy_id"), "copies", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("class", "rep").alias("class"), F.coalesce("class_id", "least").alias("class_id"), "n")
    out = sketch.select(*NAMED, "s1", "s2").join(known, ["s1", "s2"])
    return out.select(*NAMED, "class", "class_id", "copy_id", (F.col("copies") - 1 + F.col("links")).alias("n_links"), F.col("n").alias("n_shingles"))


def jaccard_join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row for each row of `docs`: doc_id, class_id (the least doc_id of its connected group), copy_id (the least
    doc_id of those with the same set of n-grams), n_links (other rows at least that similar), n_shingles.

    Texts of fewer than `words` words have one n-gram, all their words. Rows without a word or an id are linked with
    nothing and are their own class. Repeated rows count as copies of each other; two texts under one id are two sets.
    An empty table gives an empty table. Other columns aren't carried, whatever their names.

    Copies are one set. Each tree is a trie of signatures, whose nodes at some depth are the prefixes of that length. Sets
    below one node meet, each with the first of them; groups of candidates so joined are verified whole, in blocks
    where they are large, by counting common n-grams. Prefixes are shortened, and groups that grew verified again, until the
    similarities of the links found tell that the share of links in `recall` is reached. Nothing is capped.
    """
    out = classified(docs, id_col=id_col, text_col=text_col, **options).select("doc_id", "class_id", "copy_id", "n_links", "n_shingles")
    wordless = ~F.coalesce(docs[text_col].cast("string"), F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    own, none = docs[id_col].cast("long"), F.lit(0).cast("long")
    alone = docs.where(docs[id_col].isNull() | wordless).select(own.alias("doc_id"), own.alias("class_id"), own.alias("copy_id"), none.alias("n_links"), none.alias("n_shingles"))
    return out.unionByName(alone)


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs`, all columns, but one of each class of near copies: the one of least id, then of least hash.

    Two texts under one id are judged each on its own. Of rows alike in id and text the one stays whose columns, as JSON,
    come first. Rows without an id or a word all stay, and rows of equal columns are one.
    """
    rows = stored(classified(docs, id_col=id_col, text_col=text_col, **options).select("class", *NAMED), "jaccard-rows")
    first = rows.groupBy("class").agg(F.min(F.struct(*NAMED)).alias("first"), F.count("*").alias("n")).where("n > 1")
    gone = rows.join(first.select("class", "first"), "class").where(F.struct(*NAMED) != F.col("first")).select(*NAMED).distinct()
    again = rows.join(first.select("class", "first"), "class").where(F.struct(*NAMED) == F.col("first")).groupBy(*NAMED).agg(F.count("*").alias("n")).where("n > 1").select(*NAMED)

    def those(which: DataFrame, name: str) -> tuple[DataFrame, int]:
        which = stored(which, name).toDF(*(f"{name}_{i}" for i in range(3)))
        n = which.count()
        return (F.broadcast(which) if n <= BROADCAST_IDS else which), n

    def same(df: DataFrame, which: DataFrame):
        text = df[text_col].cast("string")
        met = [df[id_col].cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)]
        return [a == which[c] for a, c in zip(met, which.columns)]

    gone, _ = those(gone, "jaccard-gone")
    again, n_again = those(again, "jaccard-again")
    kept = docs.join(gone, same(docs, gone), "left_anti")
    if n_again:
        once = kept.join(again, same(kept, again), "left_semi")
        text = once[text_col].cast("string")
        once = once.groupBy(once[id_col].cast("long"), F.xxhash64(text), F.xxhash64(F.lit(1), text)).agg(F.min_by(F.struct(*docs.columns), F.to_json(F.struct(*docs.columns))).alias("r")).select("r.*")
        kept = kept.join(again, same(kept, again), "left_anti").unionByName(once)
    return kept
