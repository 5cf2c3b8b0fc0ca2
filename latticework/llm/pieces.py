"""SentencePiece encoding and decoding: a suffix array over a batch's words gives every occurrence of every piece."""

from __future__ import annotations

import re
from bisect import bisect_left
from heapq import heapify, heappop, heappush

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from latticework.llm.anchors import eights
from latticework.llm.common import map_batches
from latticework.llm.suffixes import suffix_array

MARK = "▁"  # stands for a space
WORDS = re.compile(f"{MARK}+[^{MARK}]*")
#: Bytes of text that are indexed together.
BATCH_BYTES = 6 << 20
#: Distinct words whose ids a worker remembers from earlier batches.
REMEMBERED = 400_000
END = 0xFF  # no byte of UTF-8: ends each word in the index
#: Words of more letters are joined by a heap each, shorter ones all together, an edge of each at a time: the ids are the same.
LONG = 400
NONE = 1 << 62


class Pieces:
    """A public SentencePiece BPE model with byte fallback, whose pieces have marks only in front."""

    def __init__(self, name: str = "piece_bpe_32k") -> None:
        import public_tokenizers
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(f"{name}.model"))
        n = model.get_piece_size()
        normal = [i for i in range(n) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.byte_id = {int(model.id_to_piece(i)[3:5], 16): i for i in range(n) if model.is_byte(i)}
        self.id = np.array(normal, np.int64)
        text = [model.id_to_piece(i) for i in normal]
        if any(MARK in t.lstrip(MARK) for t in text):
            raise ValueError("a piece has a mark behind its first letter, so words aren't independent")
        order = np.unique([-model.get_score(i) for i in normal], return_inverse=True)[1]
        self.priority = np.zeros(n, np.int64)
        self.priority[self.id] = order
        data = [t.encode() for t in text]
        self.size = np.array([len(x) for x in data], np.int64)
        self.longest = int(self.size.max())
        self.low, self.high = (np.array([int.from_bytes((x[:8] + fill * 8)[:8], "big") for x in data], np.uint64) for fill in (b"\x00", b"\xff"))
        self.bytes = np.zeros((len(data), self.longest), np.uint8)
        for i, x in enumerate(data):
            self.bytes[i, : len(x)] = np.frombuffer(x, np.uint8)
        self.plain: list[bytes] = [b""] * n
        for i, t in zip(normal, text):
            self.plain[i] = t.replace(MARK, " ").encode()
        for b, i in self.byte_id.items():
            self.plain[i] = bytes([b])
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def occurrences(self, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges, sorted by position: where a piece begins and how long it is, as one number, and its id."""
        order, _, _ = suffix_array(data)
        head = eights(data).byteswap()[order]
        low, high = np.searchsorted(head, self.low, "left"), np.searchsorted(head, self.high, "right")
        for d in range(8, self.longest):  # longer pieces: narrow their ranges byte by byte
            p = np.flatnonzero((self.size > d) & (low < high))
            if not len(p):
                break
            for bound, ends in ((self.bytes[p, d], low), (self.bytes[p, d].astype(np.int64) + 1, high)):
                a, b = low[p].copy(), high[p].copy()
                while (a < b).any():
                    mid = (a + b) >> 1
                    at = order[np.minimum(mid, len(order) - 1)] + d
                    below = np.where(at < len(data), data[np.minimum(at, len(data) - 1)], 0) < bound
                    a, b = np.where((a < b) & below, mid + 1, a), np.where((a < b) & ~below, mid, b)
                if ends is low:
                    first = a
                else:
                    low[p], high[p] = first, a
        count = np.maximum(0, high - low)
        piece = np.repeat(np.arange(len(count)), count)
        at = order[np.arange(len(piece)) - np.repeat(np.cumsum(count) - count, count) + low[piece]]
        edges = np.sort(((at * 64 + self.size[piece]) << 20) | piece)
        return edges >> 20, self.id[edges & ((1 << 20) - 1)]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word, as bytes: its letters, joined along the edge of best priority, leftmost first, until none is left."""
        encoded = [w.encode() for w in words]
        data = np.frombuffer(b"".join(x + b"\xff" for x in encoded), np.uint8)
        key, piece = self.occurrences(data)
        starts = np.flatnonzero((data & 0xC0) != 0x80)  # letters and ends of words
        word = np.cumsum(data == END)[starts] - (data[starts] == END)
        n = len(starts)
        ends = np.append(starts[1:], len(data))
        letter = data[starts] != END
        following = np.arange(1, n + 1)  # the next symbol; an end of word stops it
        alive = letter.copy()
        end = ends.copy()  # where each symbol ends
        none = np.int64(NONE)

        def rank(i: np.ndarray) -> np.ndarray:
            """Priority of joining symbols i with those after them."""
            j = following[i]
            ok = letter[np.minimum(j, n - 1)] & (j < n)
            size = end[np.minimum(j, n - 1)] - starts[i]
            wanted = starts[i] * 64 + size
            at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
            hit = ok & (size < 64) & (key[at] == wanted) if len(key) else np.zeros(len(i), bool)
            return np.where(hit, (self.priority[piece[at]] if len(key) else 0) * (1 << 34) + i, none)

        best = np.full(n, none)
        at = np.flatnonzero(letter)
        best[at] = rank(at)
        before = np.arange(-1, n - 1)
        letters = np.bincount(word[at], minlength=len(words))
        for w in np.flatnonzero(letters > LONG):
            first = int(at[np.searchsorted(word[at], w)])
            self.join_long(slice(first, first + int(letters[w])), starts, key, piece, best, end, following, alive)
        at = at[letters[word[at]] <= LONG]
        busy = at[np.isin(word[at], np.unique(word[at][best[at] < none]))]
        while len(busy):
            bound = np.flatnonzero(np.concatenate([[True], word[busy[1:]] != word[busy[:-1]]]))
            least = np.minimum.reduceat(best[busy], bound)
            chosen = least[least < none] & ((1 << 34) - 1)
            gone = following[chosen]
            end[chosen] = end[gone]
            following[chosen] = following[gone]
            alive[gone] = False
            after = following[chosen]
            before[after[after < n]] = chosen[after < n]
            best[gone] = none
            best[chosen] = rank(chosen)
            left = before[chosen]
            left = left[(left >= 0) & letter[np.maximum(left, 0)] & (word[np.maximum(left, 0)] == word[chosen])]
            best[left] = rank(left)
            going = np.repeat(least < none, np.diff(np.append(bound, len(busy))))
            busy = busy[going]
            busy = busy[alive[busy]]
        symbol = np.flatnonzero(alive)
        wanted = starts[symbol] * 64 + end[symbol] - starts[symbol]
        at = np.minimum(np.searchsorted(key, wanted), max(0, len(key) - 1))
        known = key[at] == wanted if len(key) else np.zeros(len(symbol), bool)
        count = np.where(known, 1, end[symbol] - starts[symbol])
        ids = np.zeros(int(count.sum()), np.uint32)
        place = np.cumsum(count) - count
        ids[place[known]] = piece[at[known]] if len(key) else 0
        for s, p in zip(symbol[~known], place[~known]):  # letters that no piece has: their bytes
            raw = data[starts[s] : end[s]]
            ids[p : p + len(raw)] = [self.byte_id[int(b)] for b in raw]
        bounds = [0, *(4 * np.cumsum(np.bincount(word[symbol], count, len(words)).astype(np.int64))).tolist()]
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(bounds[:-1], bounds[1:])]

    def join_long(self, own: slice, starts, key, piece, best, end, following, alive) -> None:
        """Join the letters of one word, the edge of best priority first, leftmost first; a heap finds it."""
        n, first = own.stop - own.start, own.start
        begin, stop, least = starts[own].tolist(), end[own].tolist(), best[own].tolist()
        after, before, there = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        low, high = (int(np.searchsorted(key, x)) for x in (begin[0] * 64, stop[-1] * 64))
        keys, pieces_, n_keys = key[low:high], piece[low:high], high - low
        heap = [x for x in least if x < NONE]
        heapify(heap)

        def rank(i: int) -> int:
            j = after[i]
            if j < n:
                size = stop[j] - begin[i]
                if size < 64:
                    wanted = begin[i] * 64 + size
                    at = bisect_left(keys, wanted)
                    if at < n_keys and keys[at] == wanted:
                        return int(self.priority[pieces_[at]]) * (1 << 34) + first + i
            return NONE

        while heap:
            x = heappop(heap)
            i = (x & ((1 << 34) - 1)) - first
            if least[i] != x:
                continue  # one of the two has been joined since
            gone = after[i]
            stop[i], after[i], there[gone], least[gone] = stop[gone], after[gone], False, NONE
            if after[i] < n:
                before[after[i]] = i
            for k in (i, before[i]):
                if k >= 0:
                    least[k] = rank(k)
                    if least[k] < NONE:
                        heappush(heap, least[k])
        end[own], alive[own] = stop, there
        following[own] = [first + k for k in after]
        best[own] = NONE  # nothing is left to join

    def words_of(self, text: str) -> list[str]:
        """The words, each without the mark before it."""
        if not text:
            return []
        if "  " in text or text[0] == " " or text[-1] == " " or MARK in text:
            return [w[1:] for w in WORDS.findall(MARK + text.replace(" ", MARK))]
        return text.split(" ")

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text, as the model's own library gives them."""
        words = [self.words_of(t) for t in texts]
        new = set().union(*words) - self.known.keys()
        if len(self.known) + len(new) > REMEMBERED:
            self.older, self.known = self.known, {}
            new = set().union(*words)
        for w in new & self.older.keys():
            self.known[w] = self.older[w]
        new = list(new - self.known.keys())
        if new:
            self.known.update(zip(new, self.encode_words([MARK + w for w in new])))
        get = self.known.__getitem__
        return [np.frombuffer(b"".join(map(get, ws)), np.uint32) for ws in words]

    def decode(self, ids: np.ndarray) -> str:
        data = b"".join(map(self.plain.__getitem__, ids.tolist()))
        return (data[1:] if data[:1] == b" " else data).decode(errors="replace")


_loaded: dict[str, Pieces] = {}


def pieces_of(name: str) -> Pieces:
    """One for each worker."""
    if name not in _loaded:
        _loaded[name] = Pieces(name)
    return _loaded[name]


def batches_of(texts: list[str], limit: int = BATCH_BYTES):
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= limit:
            yield first, i + 1
            first, size = i + 1, 0
    if first < len(texts):
        yield first, len(texts)


def coded(docs: DataFrame, model: str = "piece_bpe_32k", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (little-endian unsigned 32-bit) of each text, decoded (the text of those ids), exact (it is the text).

    Null texts count as empty, which has no ids. The model writes spaces for marks (U+2581); apart from those every
    text comes back. Null ids and repeated rows are kept; an empty table gives an empty table.
    """

    def run(batches):
        p = pieces_of(model)
        for b in batches:
            texts = [x or "" for x in b.column(1).to_pylist()]
            for i, j in batches_of(texts):
                ids = p.encode(texts[i:j])
                back = [p.decode(x) for x in ids]
                exact = [x == y.replace(MARK, " ") for x, y in zip(back, texts[i:j])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array([x.astype("<u4").tobytes() for x in ids], pa.binary()), pa.array(back, pa.string()), pa.array(exact)], ["doc_id", "ids", "decoded", "exact"])

    return map_batches(docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].cast("string").alias("text")), run, "doc_id long, ids binary, decoded string, exact boolean")


def decoded(coded_docs: DataFrame, model: str = "piece_bpe_32k") -> DataFrame:
    """doc_id and text of rows of doc_id and ids; null ids give an empty text."""

    def run(batches):
        p = pieces_of(model)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([p.decode(np.frombuffer(x or b"", "<u4")) for x in b.column(1).to_pylist()], pa.string())], ["doc_id", "text"])

    return coded_docs.select("doc_id", F.col("ids")).mapInArrow(run, "doc_id long, text string")
