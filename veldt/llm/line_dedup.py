"""Line dedup: repeated lines of a corpus stay only in the smallest document that holds them.

Lines are hashed where they lie (128 bits), keys are counted by a partial and a final
aggregate of (hash, document), and each document's drop list goes back to it by
document id. Texts are shuffled once; lines travel as hashes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm._bytes import NOT_SPACE, lines, run_hashes, text_chunks, words
from veldt.llm._store import materialize, small_batches, unused

MIN_CHARS = 10
MIN_DOCUMENTS = 2


def line_keys(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """Starts, ends, index of texts, both hashes of the stripped lower-case line, and its code points."""
    starts, ends, index = lines(data, offsets)
    # a key begins with the line's first word and ends with its last: words never span lines
    first, last, _ = words(data, offsets, NOT_SPACE)
    low, high = np.searchsorted(first, starts), np.searchsorted(last, ends, "right")
    full = high > low
    key_start, key_end = starts.copy(), starts.copy()
    key_start[full], key_end[full] = first[low[full]], last[high[full] - 1]
    del first, last, low, high
    return starts, ends, index, run_hashes(data, key_start, key_end, 0), run_hashes(data, key_start, key_end, 1), code_points(data, key_start, key_end)


def code_points(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Code points of runs that don't overlap."""
    if not len(starts):
        return np.zeros(0, np.int64)
    begins = np.append((data & 0xC0) != 0x80, False).view(np.uint8)
    n = np.add.reduceat(begins, np.column_stack([starts, ends]).ravel(), dtype=np.int64)[::2]
    return np.where(ends > starts, n, 0)


def _emit_keys(min_chars: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for row, data, offsets in text_chunks(batch.column(1)):
                _, _, index, one, two, points = line_keys(data, offsets)
                keep = np.flatnonzero(points >= min_chars)
                owner = np.repeat(ids[row : row + len(offsets) - 1], np.diff(index))[keep]
                yield pa.RecordBatch.from_arrays([pa.array(one[keep].view(np.int64)), pa.array(two[keep].view(np.int64)), pa.array(owner.astype(np.int64))], names=["one", "two", "doc_id"])

    return run


def listed(one: np.ndarray, two: np.ndarray, drops_one: np.ndarray, drops_two: np.ndarray) -> np.ndarray:
    """Whether each (one, two) is among the drops."""
    order = np.argsort(drops_one, kind="stable")
    drops_one, drops_two = drops_one[order], drops_two[order]
    at, past = np.searchsorted(drops_one, one, "left"), np.searchsorted(drops_one, one, "right")
    out = np.zeros(len(one), bool)
    while (left := np.flatnonzero(at < past)).size:  # a second round only where first hashes clash
        out[left] |= drops_two[at[left]] == two[left]
        at[left] += 1
    return out


def without_lines(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, index: np.ndarray, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of the texts' kept lines, joined by newlines."""
    before = np.zeros(len(keep) + 1, np.int64)
    np.cumsum(keep, out=before[1:])
    text = np.repeat(np.arange(len(index) - 1), np.diff(index))
    joins = keep & (before[:-1] > before[index[text]])  # a newline stays before each kept line but a text's first
    inner = np.ones(len(keep), bool)
    inner[index[:-1]] = False
    stays = np.empty(len(data), bool)
    breaks = data == 10
    stays[breaks] = joins[inner]
    stays[~breaks] = np.repeat(keep, ends - starts)
    lengths = np.bincount(text, np.where(keep, ends - starts, 0) + joins, len(index) - 1).astype(np.int64)
    return data[stays], np.concatenate([[0], np.cumsum(lengths)])


def _drop_lines(min_chars: int, names: list[str], text_at: int, drops_at: int):
    def run(batches):
        for batch in batches:
            texts, drops = batch.column(text_at), batch.column(drops_at)
            for row, data, offsets in text_chunks(texts):
                n = len(offsets) - 1
                gone = drops.slice(row, n)
                pairs, bounds = gone.flatten(), np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(gone), 0).to_numpy(zero_copy_only=False))])
                text = texts.slice(row, n).fill_null("")
                if len(pairs):
                    starts, ends, index, one, two, points = line_keys(data, offsets)
                    counts, keep = np.diff(index), np.ones(len(starts), bool)
                    drops_one, drops_two = (pairs.field(k).to_numpy(zero_copy_only=False).view(np.uint64) for k in (0, 1))
                    for k in np.flatnonzero(np.diff(bounds)).tolist():
                        own, of = slice(index[k], index[k + 1]), slice(bounds[k], bounds[k + 1])
                        keep[own] = (points[own] < min_chars) | ~listed(one[own], two[own], drops_one[of], drops_two[of])
                    dropped = np.add.reduceat(~keep, index[:-1], dtype=np.int64)
                    left, at = without_lines(data, starts, ends, index, keep)
                    text = pa.Array.from_buffers(pa.large_string(), n, [None, pa.py_buffer(at), pa.py_buffer(left)]).cast(texts.type)
                else:
                    breaks = np.flatnonzero(data == 10)
                    counts, dropped = np.diff(np.searchsorted(breaks, offsets)) + 1, np.zeros(n, np.int64)
                rest = [text if i == text_at else batch.column(i).slice(row, n) for i in range(len(names))]
                yield pa.RecordBatch.from_arrays([*rest, pa.array(counts, pa.int64()), pa.array(dropped, pa.int64())], names=[*names, "n_lines", "n_dropped"])

    return run


def dedup_lines(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", min_chars: int = MIN_CHARS, min_documents: int = MIN_DOCUMENTS) -> DataFrame:
    """The documents with repeated lines dropped, and n_lines (before) and n_dropped beside them.

    A line's key is the line without white space at its ends, A-Z lower-cased. A key of at
    least min_chars code points that min_documents or more documents hold stays only in the
    smallest id. A null or empty text is one empty line and comes back empty. Rows without
    an id hold no key and keep all lines. Rows that repeat an id are one document: a key
    they alone hold isn't dropped. Columns called n_lines or n_dropped are replaced.
    """
    small_batches(docs.sparkSession)
    docs = docs.drop("n_lines", "n_dropped")
    ids = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    keys = ids.where("doc_id is not null").mapInArrow(_emit_keys(min_chars), "one long, two long, doc_id long")
    held = keys.groupBy("one", "two").agg(F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id"))
    if min_documents > 2:
        held = keys.distinct().groupBy("one", "two").agg(F.min("doc_id").alias("first_id"), F.count("*").alias("n")).where(F.col("n") >= min_documents)
    else:
        held = held.where("first_id < last_id")
    # read back, both sides of the join have their own exchange: a key that most documents hold is split
    held = materialize(held.select("one", "two", "first_id"), "line_keys")
    names = docs.columns
    drop_id, drop_list = unused(names, "_drop_id", "_drops")
    drops = keys.join(held, ["one", "two"]).where("doc_id > first_id").groupBy("doc_id").agg(F.collect_set(F.struct("one", "two")).alias(drop_list)).withColumnRenamed("doc_id", drop_id)
    # the drop lists are hashed and the texts stream by: no sort of texts
    joined = docs.join(drops.hint("shuffle_hash"), F.col(id_column).cast("long") == F.col(drop_id), "left").select(*[docs[c] for c in names], drop_list)
    schema = T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])
    return joined.mapInArrow(_drop_lines(min_chars, names, names.index(text_column), len(names)), schema)
