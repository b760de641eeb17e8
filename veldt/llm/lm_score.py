"""Language-model scoring: a bigram model in a log-frequency Bloom filter, over exact unigram counts.

Texts become blocks of token numbers with a vocabulary of 64-bit hashes, most frequent
first, written once; numbers are kept as compressed byte planes. Counts are gathered by hash segment: each block sends its slice of (hash, count)
to the segment's owner, which adds up and answers, so no vocabulary is ever held whole.

Bigram counts c are quantised to levels 1 + floor(log2 c). A bigram of level q is put into
the filter under (bigram, 1) ... (bigram, q); a reader probes levels upward until one is
missing, and never past the largest level of the slice. Bigrams go by hash segment as well:
each segment fills its own slice of the filter, probes it for the bigrams of every block and
sends their levels back, so the filter is never held whole. A slice has BITS_PER_ENTRY bits
for each of its entries, so the rate of false hits is the same, about
(1 - exp(-PROBES / BITS_PER_ENTRY)) ** PROBES = 0.1 %, at any size.

Messages: blocks of BLOCK_TOKENS tokens and segments of SEGMENT_TOKENS tokens. Up to
MIN_SEGMENTS * SEGMENT_TOKENS tokens the number of segments is fixed and messages grow with
the blocks; beyond, a block sends to each segment that has one of its keys, so there are
never more messages than keys.

p(w | h) = (2 ** (level - 1) + MU * p(w)) / (c(h) + MU), with the add-one unigram p(w) as
base; a quantised count is never above the true one, so the sum over w stays within 1.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm._bytes import NOT_SPACE, mix, run_hashes, text_chunks, words
from veldt.llm._store import fresh_path, materialize, small_batches

BLOCK_TOKENS = 1_000_000
SEGMENT_TOKENS = 4_000_000
MIN_SEGMENTS = 64
BITS_PER_ENTRY = 16
MIN_BITS = 1 << 10
PROBES = 6
MU = 200.0
END = np.uint64(0x454E44454E44454F)
BEGIN = np.uint64(0x424547494E424547)
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BLOCK = "block long, doc_ids array<long>, train array<boolean>, lengths array<int>, n_tokens long, train_tokens long, vocabulary binary, tokens binary"


def squeezed(numbers: np.ndarray) -> bytes:
    """32-bit numbers as compressed byte planes."""
    return zlib.compress(np.ascontiguousarray(numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T).tobytes(), 1)


def unsqueezed(data: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(data), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4").ravel()


def _blocks(batches):
    held: list[np.ndarray] = []
    ids: list = []
    train: list = []
    lengths: list[int] = []
    total, count = 0, 0
    base = TaskContext.get().partitionId() << 32

    def flush():
        nonlocal held, ids, train, lengths, total, count
        vocabulary, tokens, often = np.unique(np.concatenate(held), return_inverse=True, return_counts=True)
        order = np.argsort(-often, kind="stable")
        rank = np.empty(len(order), np.uint32)
        rank[order] = np.arange(len(order), dtype=np.uint32)
        n = sum(x for x, t in zip(lengths, train) if t)
        row = [[base + count], [ids], [train], [lengths], [total], [n], [vocabulary[order].tobytes()], [squeezed(rank[tokens])]]
        types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.bool_()), pa.list_(pa.int32()), pa.int64(), pa.int64(), pa.binary(), pa.binary())
        out = pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types)], names=[x.split()[0] for x in _BLOCK.split(", ")])
        held, ids, train, lengths, total, count = [], [], [], [], 0, count + 1
        return out

    for batch in batches:
        for row, data, offsets in text_chunks(batch.column(1)):
            starts, ends, index = words(data, offsets, NOT_SPACE)
            n = np.diff(index)
            hashes = np.insert(run_hashes(data, starts, ends), index[1:], END)
            held.append(hashes)
            ids += batch.column(0).slice(row, len(n)).to_pylist()
            train += batch.column(2).slice(row, len(n)).to_pylist()
            lengths += (n + 1).tolist()
            total += len(hashes)
            if total >= BLOCK_TOKENS:
                yield flush()
    if held:
        yield flush()


def token_blocks(docs: DataFrame, train: Column, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Blocks of tokens: words between white space, A-Z lower-cased, and one end per text (null: just the end)."""
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"), train.alias("train"))
    path = fresh_path(spark, "token_blocks")
    rows.mapInArrow(_blocks, _BLOCK).write.option("compression", "zstd").parquet(path)
    return spark.read.schema(_BLOCK).parquet(path)


def _arrays(row) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return np.frombuffer(row["vocabulary"], np.uint64), unsqueezed(row["tokens"]), np.asarray(row["lengths"])


def bigram_hashes(token_hashes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """A hash of (token before, token) for each token; the first of a text follows BEGIN."""
    before = np.empty_like(token_hashes)
    before[1:] = token_hashes[:-1]
    before[np.cumsum(lengths)[:-1]] = BEGIN
    if len(before):
        before[0] = BEGIN
    return mix(before * _ODD + token_hashes)


def packed(sorted_keys: np.ndarray) -> bytes:
    """Sorted keys as byte planes of their differences: high planes are nearly zero and shrink in the shuffle."""
    return np.ascontiguousarray(np.diff(sorted_keys, prepend=np.uint64(0)).view(np.uint8).reshape(-1, 8).T).tobytes()


def unpacked(data: bytes) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(8, -1).T).view(np.uint64).ravel(), dtype=np.uint64)


def _slices(sorted_keys: np.ndarray, segments: int) -> np.ndarray:
    """Bounds of each segment's keys: a segment is a range of hashes."""
    step = (1 << 64) // segments
    return np.searchsorted(sorted_keys, np.array([k * step for k in range(segments)] + [(1 << 64) - 1], np.uint64), "left") if segments > 1 else np.array([0, len(sorted_keys)])


def _send(segments: int, bigrams: bool):
    """Each block's (key, training count) by segment: unigrams of its whole vocabulary, or its distinct bigrams (48-bit keys)."""

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, lengths = _arrays(row)
                learnt = np.repeat(np.array(row["train"], bool), lengths)
                if bigrams:
                    keys, at = np.unique(bigram_hashes(vocabulary[tokens], lengths), return_inverse=True)
                    counts = np.bincount(at[learnt], minlength=len(keys))
                else:
                    order = np.argsort(vocabulary)
                    keys, counts = vocabulary[order], np.bincount(tokens[learnt], minlength=len(vocabulary))[order]
                bounds = _slices(keys, segments)
                bounds[-1] = len(keys)
                sent, held, amounts = [], [], []
                for s in range(segments):
                    a, b = bounds[s], bounds[s + 1]
                    if a == b:
                        continue
                    sent.append(s)
                    part = keys[a:b]
                    held.append(packed(part >> np.uint64(16) if bigrams else part))
                    amounts.append(counts[a:b].astype(np.uint32).tobytes())
                n = len(sent)
                yield pa.RecordBatch.from_arrays([pa.array(sent, pa.int32()), pa.array([row["block"]] * n, pa.int64()), pa.array(held, pa.binary()), pa.array(amounts, pa.binary())], names=["segment", "block", "keys", "counts"])

    return run


_SENT = "segment int, block long, keys binary, counts binary"


def _answer(table: pa.Table) -> pa.Table:
    """A segment's totals, sent back to each block in the order of its keys."""
    keys = [unpacked(x.as_py()) for x in table["keys"]]
    counts = [np.frombuffer(x.as_py(), np.uint32) for x in table["counts"]]
    unique, at = np.unique(np.concatenate(keys), return_inverse=True)
    total = np.bincount(at, np.concatenate(counts), len(unique)).astype(np.int64)
    ends = np.cumsum([len(k) for k in keys])
    width = "<u4" if total.max(initial=0) < 1 << 32 else "<u8"
    answers = [x.tobytes() for x in np.split(total.astype(width)[at], ends[:-1])]
    n = len(keys)
    known, tokens = int((total > 0).sum()), int(total.sum())
    return pa.table({"segment": table["segment"], "block": table["block"], "counts": pa.array(answers, pa.binary()), "width": pa.array([int(width[-1])] * n, pa.int32()), "known": pa.array([known] + [0] * (n - 1), pa.int64()), "tokens": pa.array([tokens] + [0] * (n - 1), pa.int64())})


def levels_of(counts: np.ndarray) -> np.ndarray:
    """1 + floor(log2 count), 0 for 0."""
    return np.frexp(counts.astype(np.float64))[1]


class BigramFilter:
    """A slice of the log-frequency Bloom filter: (key, 1) ... (key, level) are its entries."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray):
        levels = levels_of(counts)
        self.top = int(levels.max(initial=0))
        self.size = max(MIN_BITS, -(-BITS_PER_ENTRY * int(levels.sum()) // 8) * 8)
        bits = np.zeros(self.size, bool)
        for level in range(1, self.top + 1):
            one, two = self._hashes(keys[levels >= level], level)
            for k in range(PROBES):
                bits[self._place(one, two, k)] = True
        self.bits, self.fill = np.packbits(bits), float(bits.mean())

    @staticmethod
    def _hashes(keys: np.ndarray, level: int) -> tuple[np.ndarray, np.ndarray]:
        one = mix(keys * _ODD + np.uint64(level))
        return one, mix(one + _ODD) | np.uint64(1)

    def _place(self, one: np.ndarray, two: np.ndarray, k: int) -> np.ndarray:
        return ((one + two * np.uint64(k)) % np.uint64(self.size)).astype(np.int64)

    def levels(self, keys: np.ndarray) -> np.ndarray:
        """Repeated membership probes: the highest level, up to the largest in the slice, that all levels below hold too."""
        out = np.zeros(len(keys), np.uint8)
        at = np.arange(len(keys))
        for level in range(1, self.top + 1):
            one, two = self._hashes(keys[at], level)
            for k in range(PROBES):
                place = self._place(one, two, k)
                found = (self.bits[place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1 == 1
                at, one, two = at[found], one[found], two[found]
            if not len(at):
                break
            out[at] = level
        return out


def _probe(table: pa.Table) -> pa.Table:
    """A segment's slice is filled and probed: the level of each block's bigrams, in the order of its keys."""
    held = np.concatenate([unpacked(x.as_py()) for x in table["keys"]])
    counts = np.frombuffer(b"".join(x.as_py() for x in table["counts"]), np.uint32)
    learnt = counts > 0
    keys, at = np.unique(held[learnt], return_inverse=True)
    bigrams = BigramFilter(keys, np.bincount(at, counts[learnt], len(keys)))
    del held, counts, learnt, keys, at
    levels = [bigrams.levels(unpacked(x.as_py())).tobytes() for x in table["keys"]]
    return pa.table({"segment": table["segment"], "block": table["block"], "counts": pa.array(levels, pa.binary()), "width": pa.array([1] * len(levels), pa.int32())})


@dataclass
class Model:
    """tokens and known: training tokens and distinct ones; texts: training texts. The counts stay with the segments."""

    tokens: int
    known: int
    texts: int
    mu: float = MU


def segments_for(tokens: int) -> int:
    return max(MIN_SEGMENTS, 1 << max(0, -(-tokens // SEGMENT_TOKENS) - 1).bit_length())


def train(blocks: DataFrame, mu: float = MU) -> tuple[Model, DataFrame]:
    """The model of the blocks' training texts, and each block's unigram counts and (width 1) bigram levels by segment."""
    spark = blocks.sparkSession
    learnt = F.aggregate("train", F.lit(0).cast("long"), lambda n, t: n + F.coalesce(t, F.lit(False)).cast("long"))
    facts = blocks.agg(F.sum("n_tokens").alias("tokens"), F.sum(learnt).alias("texts")).first()
    segments = segments_for(facts["tokens"] or 0)
    rows = blocks.select("block", "train", "lengths", "vocabulary", "tokens")
    answers = materialize(rows.mapInArrow(_send(segments, False), _SENT).groupBy("segment").applyInArrow(_answer, "segment int, block long, counts binary, width int, known long, tokens long"), "answers")
    sums = answers.agg(F.sum("known").alias("known"), F.sum("tokens").alias("tokens")).first()
    sent = rows.mapInArrow(_send(segments, True), _SENT)
    levels = materialize(sent.groupBy("segment").applyInArrow(_probe, "segment int, block long, counts binary, width int"), "levels")
    model = Model(sums["tokens"] or 0, sums["known"] or 0, facts["texts"] or 0, mu)
    return model, answers.select("segment", "block", "counts", "width").unionByName(levels)


_SCORES = "doc_id long, train boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(model: Model):
    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                vocabulary, tokens, lengths = _arrays(row)
                answers = sorted(row["answers"], key=lambda x: x["segment"])
                counts = np.empty(len(vocabulary), np.int64)
                counts[np.argsort(vocabulary)] = np.concatenate([np.frombuffer(x["counts"], f"<u{x['width']}") for x in answers if x["width"] > 1])
                found = np.concatenate([np.frombuffer(x["counts"], np.uint8) for x in answers if x["width"] == 1])
                p = (counts + 1.0) / (model.tokens + model.known + 1)
                first = np.concatenate([[0], np.cumsum(lengths)[:-1]])
                base = np.add.reduceat(np.log10(p)[tokens], first)
                known = np.add.reduceat((counts > 0)[tokens].astype(np.int64), first)
                context = np.empty(len(tokens))
                context[1:] = counts[tokens[:-1]]
                context[first] = model.texts
                levels = found[np.unique(bigram_hashes(vocabulary[tokens], lengths), return_inverse=True)[1]]
                seen = np.minimum(np.where(levels > 0, np.exp2(levels - 1.0), 0.0), context)  # a false hit can't pass the context's count
                score = np.add.reduceat(np.log10((seen + model.mu * p[tokens]) / (context + model.mu)), first)
                n = len(lengths)
                columns = (row["doc_ids"], row["train"], lengths.astype(np.int64), known, np.full(n, model.tokens, np.int64), base, score)
                types = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[x.split()[0] for x in _SCORES.split(", ")])

    return run


def score_texts(docs: DataFrame, train_on: Column, id_column: str = "doc_id", text_column: str = "text", mu: float = MU) -> DataFrame:
    """Per text: doc_id, train, n_tokens, n_known, train_tokens, base_score (add-one unigrams), score (bigrams over them).

    Null and empty texts are one end token. Without training texts all counts are zero. Rows
    are kept as they are, repeated ones and those without an id too; other columns go.
    """
    blocks = token_blocks(docs, train_on, id_column, text_column)
    model, answers = train(blocks, mu)
    by_block = answers.groupBy("block").agg(F.collect_list(F.struct("segment", "counts", "width")).alias("answers"))  # of a block's vocabulary and bigrams, whose number BLOCK_TOKENS bounds
    return blocks.join(by_block, "block").select("doc_ids", "train", "lengths", "vocabulary", "tokens", "answers").mapInArrow(_score(model), _SCORES)
