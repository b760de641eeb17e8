"""Benchmark decontamination: a broadcast hash set of benchmark word windows, scanned over all texts.

The benchmark's distinct windows are a table (length, hash, item, words). Up to
BLOCK_WINDOWS of them are one broadcast block of sorted arrays, and marking is one map over
the documents: no shuffle. A larger benchmark is dealt to blocks of that many rows by a hash
of window and item, so copies of one window are dealt too; a broadcast Bloom filter of all
windows, of bounded size, then picks the documents that may have a hit, and only those pass
all blocks. A hit of a hash is verified on the window's words before it counts.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veldt.llm._bytes import ALNUM, LOWER, mix, run_hashes, text_chunks, window_hashes, words
from veldt.llm._store import materialize, shielded, small_batches, unused

WIDTH = 10
#: Windows of one broadcast block: about 100 bytes each, so 50 MB.
BLOCK_WINDOWS = 500_000
#: Bits of the Bloom filter over all windows, at most: 32 MB.
BLOOM_BITS = 28
BLOOM_PROBES = 4
_QUICK_BITS = 22
_SLICE = 50_000
_SPANS = T.ArrayType(T.StructType([T.StructField("first", T.LongType()), T.StructField("last", T.LongType())]))
_SPANS_ARROW = pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))


def _windows(width: int):
    """(n, hash, item, words) of each item's windows, a slice of an item at a time."""

    def run(batches):
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(1)):
                raw = data.tobytes().translate(LOWER)
                starts, ends, index = words(data, offsets, ALNUM)
                hashed = run_hashes(data, starts, ends)
                for k in range(len(offsets) - 1):
                    low, high = int(index[k]), int(index[k + 1])
                    n = min(width, high - low)
                    for at in range(low, high - n + 1 if n else low, _SLICE):
                        last = min(at + _SLICE, high - n + 1)
                        parts = [raw[a:b] for a, b in zip(starts[at : last + n - 1].tolist(), ends[at : last + n - 1].tolist())]
                        held = [b" ".join(parts[p : p + n]) for p in range(last - at)]
                        hashes = window_hashes(hashed[at : last + n - 1], n).view(np.int64)
                        item = pa.nulls(last - at, pa.string()) if not batch.column(0)[row + k].is_valid else pa.array([batch.column(0)[row + k].as_py()] * (last - at))
                        yield pa.RecordBatch.from_arrays([pa.array([n] * (last - at), pa.int32()), pa.array(hashes), item, pa.array(held, pa.binary())], names=["n", "hash", "item", "words"])

    return run


def benchmark_windows(benchmark: DataFrame, item_id: str, item_text: str, width: int) -> DataFrame:
    items = benchmark.select(F.col(item_id).cast("string").alias("id"), F.col(item_text).alias("text"))
    return materialize(items.mapInArrow(_windows(width), "n int, hash long, item string, words binary").distinct(), "windows")


@dataclass
class Windows:
    """The distinct windows of one length: sorted hashes, the words' bytes, and the items that hold each, as codes."""

    hashes: np.ndarray
    words: bytes
    words_at: np.ndarray
    items: np.ndarray
    items_at: np.ndarray
    quick: np.ndarray

    @staticmethod
    def of(table: pa.Table, codes: np.ndarray) -> Windows:
        hashes, held = table["hash"].to_numpy().view(np.uint64), table["words"].to_pylist()
        order = sorted(range(len(held)), key=lambda k: (hashes[k], held[k]))
        first = [k for k, (a, b) in enumerate(zip([None, *order], order)) if a is None or held[a] != held[b]]
        distinct = [held[order[k]] for k in first]
        unique = hashes[[order[k] for k in first]]
        quick = np.zeros(1 << _QUICK_BITS, bool)
        quick[(unique >> np.uint64(64 - _QUICK_BITS)).astype(np.int64)] = True
        return Windows(unique, b"".join(distinct), np.cumsum([0, *map(len, distinct)]), codes[order], np.array([*first, len(order)]), quick)

    def hits(self, data_words, hashed: np.ndarray, owner: np.ndarray, n: int) -> tuple[list[int], list[int]]:
        """Places of words where one of the windows begins, and which window it is; data_words(k, n) gives the words' bytes."""
        w = window_hashes(hashed, n)
        at = np.flatnonzero(self.quick[(w >> np.uint64(64 - _QUICK_BITS)).astype(np.int64)])
        at = at[owner[at] == owner[at + n - 1]]
        low, high = np.searchsorted(self.hashes, w[at], "left"), np.searchsorted(self.hashes, w[at], "right")
        places, found = [], []
        for k, a, b in zip(at.tolist(), low.tolist(), high.tolist()):
            there = data_words(k, n) if a < b else None
            for g in range(a, b):  # more than one only where hashes clash
                if self.words[self.words_at[g] : self.words_at[g + 1]] == there:
                    places.append(k)
                    found.append(g)
        return places, found


@dataclass
class Block:
    """Windows by length, and the ids of the items."""

    lengths: dict[int, Windows]
    ids: list

    @staticmethod
    def of(table: pa.Table) -> Block:
        ids = table["item"].combine_chunks().dictionary_encode(null_encoding="encode") if len(table) else None
        codes = ids.indices.to_numpy() if ids is not None else np.zeros(0, np.int32)
        return Block({n: Windows.of(table.filter(here), codes[here.to_numpy()]) for n in sorted(set(table["n"].to_pylist())) for here in [pc.equal(table["n"], n)]}, ids.dictionary.to_pylist() if ids is not None else [])


def _chunk_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray):
    raw: list[bytes] = []

    def of(k: int, n: int) -> bytes:
        if not raw:
            raw.append(data.tobytes().translate(LOWER))
        return b" ".join([raw[0][a:b] for a, b in zip(starts[k : k + n].tolist(), ends[k : k + n].tolist())])

    return of


def _scan(block, names: list[str], text_at: int, state_at: int):
    """Adds the block's hits to n_words, spans (of word places) and items."""

    def run(batches):
        held: Block = block.value
        for batch in batches:
            counts, spans, items = [], [], []
            for row, data, offsets in text_chunks(batch.column(text_at)):
                starts, ends, index = words(data, offsets, ALNUM)
                hashed = run_hashes(data, starts, ends)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(index))
                hit: dict[int, list[tuple[int, int]]] = {}
                ids: dict[int, set] = {}
                words_of = _chunk_words(data, starts, ends)
                for n, windows in held.lengths.items():
                    for k, g in zip(*windows.hits(words_of, hashed, owner, n)):
                        doc = int(owner[k])
                        hit.setdefault(doc, []).append((k - int(index[doc]), k - int(index[doc]) + n))
                        ids.setdefault(doc, set()).update(windows.items[windows.items_at[g] : windows.items_at[g + 1]].tolist())
                counts += np.diff(index).tolist()
                spans += [hit.get(k, []) for k in range(len(offsets) - 1)]
                items += [[held.ids[x] for x in ids.get(k, ())] for k in range(len(offsets) - 1)]
            if state_at >= 0:
                spans = [a + [(x["first"], x["last"]) for x in b] for a, b in zip(spans, batch.column(state_at + 1).to_pylist())]
                items = [a + b for a, b in zip(items, batch.column(state_at + 2).to_pylist())]
            spans = [[{"first": a, "last": b} for a, b in merged(x)] for x in spans]
            items = [sorted(set(x), key=lambda v: (v is not None, str(v))) for x in items]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(len(names))), pa.array(counts, pa.int64()), pa.array(spans, _SPANS_ARROW), pa.array(items, pa.list_(pa.string()))], names=[*names, "n_words", "hit_spans", "hit_items"])

    return run


def merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The union of half-open spans, in order."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _places(hashes: np.ndarray, bits: int):
    one, two = mix(hashes), mix(hashes + np.uint64(1)) | np.uint64(1)
    for k in range(BLOOM_PROBES):
        yield ((one + two * np.uint64(k)) & np.uint64(bits - 1)).astype(np.int64)


def bloom(hashes, total: int) -> np.ndarray:
    """A Bloom filter (a byte per 8 bits) over batches of hashes, 16 bits a window up to BLOOM_BITS."""
    bits = 1 << min(BLOOM_BITS, max(16, (16 * total).bit_length()))
    out = np.zeros(bits >> 3, np.uint8)
    for part in hashes:
        for place in _places(part, bits):
            np.bitwise_or.at(out, place >> 3, np.left_shift(np.uint8(1), (place & 7).astype(np.uint8)))
    return out


def _suspects(filters, lengths: list[int], names: list[str], text_at: int, name: str):
    """The documents with n_words and whether one of their windows may be in the filter."""

    def run(batches):
        held = filters.value
        for batch in batches:
            counts, maybe = [np.zeros(0, np.int64)], [np.zeros(0, bool)]
            for _, data, offsets in text_chunks(batch.column(text_at)):
                starts, ends, index = words(data, offsets, ALNUM)
                hashed = run_hashes(data, starts, ends)
                owner = np.repeat(np.arange(len(offsets) - 1), np.diff(index))
                found = np.zeros(len(offsets) - 1, bool)
                for n in lengths:
                    w = window_hashes(hashed, n)
                    at = np.flatnonzero(owner[: len(w)] == owner[n - 1 : n - 1 + len(w)])
                    there = np.ones(len(at), bool)
                    for place in _places(w[at], len(held) * 8):
                        there &= (held[place >> 3] >> (place & 7).astype(np.uint8)) & 1 == 1
                    found[owner[at[there]]] = True
                counts.append(np.diff(index))
                maybe.append(found)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(counts)), pa.array(np.concatenate(maybe))], names=[*names, "n_words", name])

    return run


def mark_contamination(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_id: str = "item_id", item_text: str = "text", width: int = WIDTH, block_windows: int = BLOCK_WINDOWS) -> DataFrame:
    """The documents with n_words, hit_spans (half-open, in words, united) and hit_items (ids as text, sorted, distinct).

    An item of fewer than width words, but not none, is one window; items without words,
    and null texts, hit nothing. Null item ids appear as null; items that repeat an id count
    once. An empty benchmark or an empty document has no hit. Texts of any length are scanned
    whole; rows that repeat are marked alike. Columns of those three names are replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("n_words", "hit_spans", "hit_items")
    names = docs.columns
    text_at = names.index(text_column)
    state = [T.StructField("n_words", T.LongType()), T.StructField("hit_spans", _SPANS), T.StructField("hit_items", T.ArrayType(T.StringType()))]
    schema = T.StructType([*docs.schema.fields, *state])
    windows = benchmark_windows(benchmark, item_id, item_text, width)
    sizes = {r["n"]: r["c"] for r in windows.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most `width` rows
    blocks = max(1, -(-sum(sizes.values()) // block_windows))
    # a block has about block_windows rows, its bound
    parts = [windows.where(F.pmod(F.xxhash64("hash", "item", "words"), F.lit(blocks)) == k) for k in range(blocks)]
    if blocks == 1:
        return docs.mapInArrow(_scan(spark.sparkContext.broadcast(Block.of(windows.toArrow())), names, text_at, -1), schema)
    held = spark.sparkContext.broadcast(bloom((p.select("hash").toArrow()["hash"].to_numpy().view(np.uint64) for p in parts), sum(sizes.values())))
    (suspect,) = unused(names, "_suspect")
    marked = materialize(docs.mapInArrow(_suspects(held, sorted(sizes), names, text_at, suspect), T.StructType([*docs.schema.fields, state[0], T.StructField(suspect, T.BooleanType())])), "suspects")
    clean = marked.where(~F.col(suspect)).select(*names, "n_words", F.array().cast(_SPANS).alias("hit_spans"), F.array().cast("array<string>").alias("hit_items"))
    out = marked.where(F.col(suspect)).select(*names)
    for k, part in enumerate(parts):
        block = spark.sparkContext.broadcast(Block.of(part.toArrow()))
        out = out.mapInArrow(_scan(block, names, text_at, len(names) if k else -1), schema)
        if k < blocks - 1:
            out = materialize(out, f"hits_{k}")
    return clean.unionByName(out)


def _without_spans(text, spans):
    raw = text.encode()
    data = np.frombuffer(raw, np.uint8)
    starts, ends, _ = words(data, np.array([0, len(data)]), ALNUM)
    out, at = [], 0
    for s in spans:
        out.append(raw[at : int(starts[s["first"]])])
        at = int(ends[s["last"] - 1])
    return (b"".join(out) + raw[at:]).decode()


def decontaminate(docs: DataFrame, benchmark: DataFrame, remove: str = "documents", text_column: str = "text", **how) -> DataFrame:
    """Drop the documents with a hit, or with remove="spans" cut the hit words (and what lies between them) out of their texts.

    Documents without a hit, null and empty texts too, stay as they are; columns called
    n_words, hit_spans or hit_items are kept.
    """
    docs, restored = shielded(docs, "n_words", "hit_spans", "hit_items")
    names = docs.columns
    marked = mark_contamination(docs, benchmark, text_column, **how)
    if remove == "documents":
        return restored(marked.where(F.size("hit_spans") == 0))
    if remove != "spans":
        raise ValueError("remove is 'documents' or 'spans'")
    at = names.index(text_column)

    def cut(batches):
        for batch in batches:
            texts = [t if not s else _without_spans(t, s) for t, s in zip(batch.column(at).to_pylist(), batch.column(len(names)).to_pylist())]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else batch.column(i) for i in range(len(names))], names=names)

    return restored(marked.select(*names, "hit_spans").mapInArrow(cut, docs.schema))
