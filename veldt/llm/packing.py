"""Best-fit packing: token pieces into sequences of a fixed length, best-fit decreasing.

Best fit depends only on how many pieces there are of each length, so the driver packs
the histogram (at most `capacity` counts, whatever the corpus): lengths in decreasing
order, a segment tree over remaining capacities finds the tightest class of open bins in
O(log capacity), and a run of equal pieces fills a run of equal bins in one step. The
result is that of one best-fit-decreasing pass over all pieces. Each piece then finds
its run by (length, rank); ranks come from salted windows, so a length that a third of
the pieces share is no hot key.

Bound of the run table: a step ends a length or a run of equal bins; bins of equal
history stay together, so there are at most 2 * capacity histories, each of at most
as many steps as a bin has pieces. It doesn't grow with the corpus and is checked.
"""

from __future__ import annotations

import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from veldt.llm._bytes import KEEP_CASE, NOT_SPACE, run_hashes, text_chunks, words
from veldt.llm._store import materialize, small_batches, unused

CAPACITY = 4096
END_ID = 1
SALTS = 64
CACHE_WORDS = 2_000_000
CACHE_BYTES = 64 << 20
COMPARED = 1 << 17
MAX_RUNS = 4_000_000
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


class TightestOpen:
    """Segment tree over remaining capacities 0..n: whether a class has open bins; finds the smallest class >= s."""

    def __init__(self, n: int):
        self.width = 1 << (n + 1 - 1).bit_length() if n else 1
        while self.width < n + 1:
            self.width *= 2
        self.tree = bytearray(2 * self.width)

    def set(self, k: int, is_open: bool) -> None:
        k += self.width
        self.tree[k] = is_open
        while k > 1:
            k //= 2
            self.tree[k] = self.tree[2 * k] or self.tree[2 * k + 1]

    def find(self, least: int) -> int:
        """The smallest open class that is at least `least`, or -1."""
        k = least + self.width
        if self.tree[k]:
            return least
        while k > 1:
            if not k & 1 and self.tree[k + 1]:
                k += 1
                while k < self.width:
                    k = 2 * k if self.tree[2 * k] else 2 * k + 1
                return k - self.width
            k //= 2
        return -1


def pack_histogram(counts: dict[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Best-fit decreasing over counts of lengths; rows (length, first rank, pieces, first bin, offset).

    The pieces of a row have consecutive ranks among their length and go to consecutive bins,
    all at one offset.
    """
    tree = TightestOpen(capacity)
    classes: dict[int, list[list[int]]] = {}  # remaining -> runs of bins [first bin, bins]
    runs: list[tuple[int, int, int, int, int]] = []
    bins = 0
    for length in sorted((x for x in counts if x > 0), reverse=True):
        if length > capacity:
            raise ValueError("a piece is longer than a sequence")
        left, rank = counts[length], 0
        while left:
            room = tree.find(length)
            if room < 0:  # the new bins become one run; each takes as many of this length as fit
                each = capacity // length
                n, rest = divmod(left, each)
                for bins_now, per_bin in ((n, each), (1 if rest else 0, rest)):
                    if not bins_now:
                        continue
                    for k in range(per_bin):
                        runs.append((length, rank, bins_now, bins, k * length))
                        rank += bins_now
                    _open(tree, classes, capacity - per_bin * length, bins, bins_now)
                    bins += bins_now
                left = 0
                continue
            run = classes[room][-1]
            take = min(left, run[1])
            runs.append((length, rank, take, run[0], capacity - room))
            rank, left = rank + take, left - take
            first = run[0]
            if take == run[1]:
                classes[room].pop()
                if not classes[room]:
                    tree.set(room, False)
            else:
                run[0], run[1] = run[0] + take, run[1] - take
            _open(tree, classes, room - length, first, take)
    if len(runs) > MAX_RUNS:
        raise RuntimeError("the run table is larger than its bound")
    return np.array(runs, np.int64).reshape(-1, 5)


def _open(tree: TightestOpen, classes: dict, room: int, first: int, n: int) -> None:
    if room > 0:
        classes.setdefault(room, []).append([first, n])
        tree.set(room, True)


class WordTokens:
    """Ids of texts, a whole chunk of texts at a time.

    The tokenizer's white space never joins two tokens, so texts are split at ASCII white
    space and each distinct word is encoded once. A full stop or comma between an ASCII
    letter or digit and white space is a token of its own, so it's split off first. Words are
    told apart by case-keeping hashes and then compared byte by byte, so a clash of hashes
    can't change ids. Words stay known for the later tasks of a Python worker, at most
    cache_words of them and CACHE_BYTES of their bytes: a full cache is emptied, results stay
    the same.
    """

    _loaded: dict[str, WordTokens] = {}

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.cache_words = cache_words
        self._clear()

    def _clear(self) -> None:
        self.hashes, self.places = np.zeros(0, np.uint64), np.zeros(0, np.int64)  # known words: sorted hashes, and their places
        self.held, self.held_at = np.zeros(0, np.uint8), np.zeros(1, np.int64)  # bytes by place
        self.ids, self.ids_at = np.zeros(0, np.uint32), np.zeros(1, np.int64)  # ids by place

    def _learn(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> None:
        """Encode words whose (sorted) hashes aren't known."""
        if len(self.hashes) > self.cache_words or len(self.held) > CACHE_BYTES:
            raise _CacheFull
        found, raw = [], data.tobytes()
        listed = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist())]
        for k in range(0, len(listed), 20_000):
            found += [e.ids for e in self.tokenizer.encode_batch_fast(listed[k : k + 20_000], add_special_tokens=False)]
        places = np.arange(len(starts)) + len(self.held_at) - 1
        at = np.searchsorted(self.hashes, hashes)
        self.hashes, self.places = np.insert(self.hashes, at, hashes), np.insert(self.places, at, places)
        self.held = np.concatenate([self.held, data[spread(starts, ends - starts)]])
        self.held_at = np.concatenate([self.held_at, self.held_at[-1] + np.cumsum(ends - starts)])
        self.ids = np.concatenate([self.ids, np.fromiter((x for e in found for x in e), np.uint32)])
        self.ids_at = np.concatenate([self.ids_at, self.ids_at[-1] + np.cumsum([len(e) for e in found], dtype=np.int64)])

    def encode(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts of a chunk, each with end_id after it, and the place of each text's first."""
        starts, ends, index = split_words(data, offsets)
        hashes = run_hashes(data, starts, ends, KEEP_CASE)
        unique, first, word = np.unique(hashes, return_index=True, return_inverse=True)
        if not self._equal(data, starts, ends, data, starts[first], ends[first], word):
            return self._encode_each(data, offsets, end_id)
        for fresh_start in (False, True):
            at = np.searchsorted(self.hashes, unique)
            new = np.ones(len(unique), bool)
            inside = at < len(self.hashes)
            new[inside] = self.hashes[at[inside]] != unique[inside]
            try:
                if new.any():
                    self._learn(data, starts[first[new]], ends[first[new]], unique[new])
                break
            except _CacheFull:
                self._clear()
        place = self.places[np.searchsorted(self.hashes, unique)]
        if not self._equal(data, starts[first], ends[first], self.held, self.held_at[:-1], self.held_at[1:], place):
            return self._encode_each(data, offsets, end_id)
        of = place[word]
        n = np.diff(self.ids_at)[of]
        ids = self.ids[spread(self.ids_at[of], n)]
        total = np.concatenate([[0], np.cumsum(n)])[index]
        if end_id is not None:
            ids = np.insert(ids, total[1:], np.uint32(end_id))
            total = total + np.arange(len(total))
        return ids, total

    @staticmethod
    def _equal(a: np.ndarray, a_start: np.ndarray, a_end: np.ndarray, b: np.ndarray, b_start: np.ndarray, b_end: np.ndarray, of: np.ndarray) -> bool:
        """Whether each run of a has the bytes of run `of` of b."""
        n = a_end - a_start
        if (n != (b_end - b_start)[of]).any():
            return False
        edges = np.searchsorted(np.cumsum(n), np.arange(0, int(n.sum()) + COMPARED, COMPARED)).tolist() if len(n) else []
        return all((a[spread(a_start[p:q], n[p:q])] == b[spread(b_start[of[p:q]], n[p:q])]).all() for p, q in zip([0, *edges], [*edges, len(n)]) if p < q)

    def _encode_each(self, data: np.ndarray, offsets: np.ndarray, end_id: int | None) -> tuple[np.ndarray, np.ndarray]:
        """Texts that hold a clash of hashes: as the tokenizer encodes them, whole."""
        raw = data.tobytes()
        found = [self.tokenizer.encode(raw[a:b].decode(), add_special_tokens=False).ids + ([] if end_id is None else [end_id]) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
        return np.array([x for e in found for x in e], np.uint32), np.concatenate([[0], np.cumsum([len(e) for e in found], dtype=np.int64)])


class _CacheFull(Exception):
    pass


def spread(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The places start, start + 1, ... of each run, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)


_WORD_BYTE = np.zeros(256, bool)
_WORD_BYTE[0x30:0x3A] = _WORD_BYTE[0x41:0x5B] = _WORD_BYTE[0x61:0x7B] = True
_STOP_BYTE = np.zeros(256, bool)
_STOP_BYTE[list(b".,")] = True


def split_words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words between white space; a full stop or comma after an ASCII letter or digit and before white space is a word of its own."""
    starts, ends, index = words(data, offsets, NOT_SPACE)
    last = np.zeros(len(starts), bool)
    last[index[1:][np.diff(index) > 0] - 1] = True  # the last word of a text may have no white space after it
    inner = ~last | ((ends < len(data)) & ~NOT_SPACE[data[np.minimum(ends, len(data) - 1)]] & (ends < np.repeat(offsets[1:], np.diff(index))))
    split = np.flatnonzero(inner & (ends - starts > 1) & _STOP_BYTE[data[ends - 1]] & _WORD_BYTE[data[ends - 2]])
    stops = ends[split] - 1
    ends[split] = stops
    return np.insert(starts, split + 1, stops), np.insert(ends, split + 1, stops + 1), index + np.searchsorted(split, index)


def _pieces(tokenizer_path: str, capacity: int, end_id: int):
    def run(batches):
        tokens = WordTokens.of(tokenizer_path)
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                ids, at = tokens.encode(data, offsets, end_id)
                view = memoryview(ids.astype("<u4").view(np.uint8))
                n = -(-np.diff(at) // capacity)
                owner, piece = np.repeat(np.arange(len(n)), n), spread(np.zeros(len(n), np.int64), n)
                start = piece * capacity
                length = np.minimum(np.diff(at)[owner] - start, capacity)
                low = (at[:-1][owner] + start) * 4
                crc = [zlib.crc32(view[a:b]) for a, b in zip(low.tolist(), (low + length * 4).tolist())]
                doc = batch.column(0).slice(row, len(n)).take(pa.array(owner))
                yield pa.RecordBatch.from_arrays([doc, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def token_pieces(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """Each document's ids (null and empty texts: none) and the end id, cut into pieces of at most `capacity`.

    Whole texts are encoded, however long. Rows that repeat, and those without an id, give
    pieces of their own; an empty table gives none. Other columns are dropped.
    """
    small_batches(docs.sparkSession)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text")).mapInArrow(_pieces(tokenizer_path, capacity, end_id), _PIECES)


def pack(pieces: DataFrame, capacity: int = CAPACITY, length_column: str = "length", salts: int = SALTS) -> DataFrame:
    """The pieces with sequence_id and offset: best-fit decreasing over all of them.

    Pieces of equal length are ranked within (length, salt) by all their columns, so
    reruns after a lost executor give the same places; rows alike in every column are
    interchangeable. Lengths are 1 to capacity. An empty input packs into nothing. Columns
    called sequence_id or offset are replaced; all others are kept, nulls in them too.
    """
    spark = pieces.sparkSession
    small_batches(spark)
    pieces = pieces.drop("sequence_id", "offset")
    names = pieces.columns
    pieces = materialize(pieces, "pieces")
    salt, of_length, of_salt, before, rank = unused(names, "_salt", "_length", "_of_salt", "_before", "_rank")
    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*names), F.lit(salts)).cast("int"))
    by_salt = salted.groupBy(F.col(length_column).alias(of_length), F.col(salt).alias(of_salt)).agg(F.count("*").alias("n"))
    earlier = Window.partitionBy(of_length).orderBy(of_salt).rowsBetween(Window.unboundedPreceding, -1)
    by_salt = materialize(by_salt.withColumn(before, F.coalesce(F.sum("n").over(earlier), F.lit(0))), "lengths")
    counts = {r["l"]: r["n"] for r in by_salt.groupBy(F.col(of_length).alias("l")).agg(F.sum("n").alias("n")).collect()}  # at most `capacity` rows
    runs = pack_histogram(counts, capacity)
    runs = runs[np.lexsort((runs[:, 1], runs[:, 0]))]
    held = spark.sparkContext.broadcast(runs)
    order = Window.partitionBy(length_column, salt).orderBy(*names)
    ranked = salted.withColumn(rank, F.row_number().over(order) - 1)
    same = (F.col(length_column) == F.col(of_length)) & (F.col(salt) == F.col(of_salt))
    ranked = ranked.join(by_salt.drop("n"), same).select(*names, (F.col(rank) + F.col(before)).alias(rank))
    at = names.index(length_column)

    def place(batches):
        table = held.value
        keys = table[:, 0] << 44 | table[:, 1]
        for batch in batches:
            length = batch.column(at).to_numpy()
            rank = batch.column(len(names)).to_numpy()
            k = np.searchsorted(keys, (length << 44) | rank, "right") - 1
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(table[k, 3] + rank - table[k, 1]), pa.array(table[k, 4])], names=[*names, "sequence_id", "offset"])

    from pyspark.sql import types as T

    return ranked.mapInArrow(place, T.StructType([*pieces.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())]))
