"""MinHash near-dedup with b-bit signatures, confirmed on full shingle sets.

1. Each text: distinct 5-word shingles (64-bit hashes), HASHES minima, of which BITS low
   bits each are packed into a signature and ROWS full ones at a time make a band key.
2. Texts with equal sets become one class; only its smallest id goes on.
3. Classes that share a band key are candidates. Within a bucket the similarity is
   estimated from equal signature digits, corrected for chance collisions, and a
   spanning forest of the pairs at or above FLOOR goes out, never all pairs. A bucket of
   more than BUCKET classes never meets in one task: it becomes a star around its smallest
   id by a join, a superset of its pairs, so no link is lost.
4. The forests' components are candidate clusters. A broadcast Bloom filter of their ids (at
   most 16 MB) picks their texts where they lie, and only full sets are shuffled. Sets meet
   once per cluster; a breadth-first search over an inverted index finds the exact links.
   Clusters beyond FIRST documents or CHUNK_BYTES are dealt to parts; each part is compared
   within itself and with LEADERS documents of its cluster, so a cluster of copies of one
   text is done at a cost in proportion to its size. Where such a cluster isn't one group
   yet, it is cut by prefixes: in any fixed order of shingles, two linked sets share one of
   the first n - ceil(0.75 n) + 1 of their n. Rare shingles come first in the order, so
   documents that share a template but aren't links fall apart; stars by (cluster, shingle)
   and their components are the new clusters, no pairs are made. In these, documents outside
   the largest group meet all others, in pairs of chunks.
5. Components of the exact links give the smallest id of each group.

Band misses: a pair at similarity 0.75 shares no band with probability
(1 - 0.75**ROWS)**BANDS = 5e-6; FLOOR lies five standard deviations below 0.75.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veldt.llm._bytes import NOT_SPACE, mix, run_hashes, text_chunks, window_hashes, words
from veldt.llm._store import materialize, release, small_batches, unused

WIDTH = 5
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 4
FLOOR = 0.55
BUCKET = 4096
FIRST = 2048
CHUNK = 2048
LEADERS = 16
#: The order of shingles is learnt from so many documents (any order is exact), as counts in hash buckets.
ORDER_DOCUMENTS = 4000
ORDER_BITS = 18
CHUNK_BYTES = 24 << 20
FILTER_BITS = 27
_MULTIPLY = mix(np.arange(1, HASHES + 1, dtype=np.uint64)) | np.uint64(1)
_ADD = mix(np.arange(1, HASHES + 1, dtype=np.uint64) + np.uint64(1 << 40))


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All texts' distinct shingles, sorted within each text, and the index of each text's first."""
    starts, ends, index = words(data, offsets, NOT_SPACE)
    hashed = run_hashes(data, starts, ends)
    n = np.diff(index)
    owner = np.repeat(np.arange(len(n)), n)
    w = window_hashes(hashed, width)
    whole = owner[: len(w)] == owner[width - 1 :] if len(w) else np.zeros(0, bool)
    parts, owners = [w[whole]], [owner[: len(w)][whole]]
    for short in range(1, width):  # texts of fewer words are one shingle
        at = index[:-1][n == short]
        if len(at):
            parts.append(window_hashes(hashed, short)[at])
            owners.append(owner[at])
    values, owner = np.concatenate(parts), np.concatenate(owners)
    order = np.lexsort((values, owner))
    values, owner = values[order], owner[order]
    if len(values):
        first = np.ones(len(values), bool)
        first[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
        values, owner = values[first], owner[first]
    return values, np.searchsorted(owner, np.arange(len(n) + 1))


def minima(values: np.ndarray, index: np.ndarray) -> np.ndarray:
    """HASHES minima of each text (a row each); texts without shingles have the largest value."""
    n = np.diff(index)
    out = np.full((len(n), HASHES), np.iinfo(np.uint64).max, np.uint64)
    full = np.flatnonzero(n)
    if len(full):
        at = index[:-1][full]
        for k in range(HASHES):
            out[full, k] = np.minimum.reduceat(values * _MULTIPLY[k] + _ADD[k], at)
    return out


def pack_digits(low: np.ndarray) -> np.ndarray:
    """Low BITS of mixed minima, packed into 64-bit words, a row each."""
    digits = mix(low) & np.uint64((1 << BITS) - 1)
    per = 64 // BITS
    shifts = np.arange(per, dtype=np.uint64) * np.uint64(BITS)
    return np.bitwise_or.reduce(digits.reshape(len(low), -1, per) << shifts, axis=2)


def estimate(one: np.ndarray, many: np.ndarray) -> np.ndarray:
    """Similarity from equal digits, less the chance 2**-BITS that different minima agree."""
    x = one ^ many
    for s in (1, 2):
        x = x | (x >> np.uint64(s))
    differ = np.bitwise_count(x & np.uint64(0x1111111111111111)).sum(axis=-1)
    chance = 2.0**-BITS
    return (1 - differ / HASHES - chance) / (1 - chance)


_SKETCH = "doc_id long, n_shingles long, one long, two long, digits binary, bands array<long>"


def _sketch(batches):
    base = np.arange(BANDS, dtype=np.uint64)
    for batch in batches:
        ids = batch.column(0)
        for row, data, offsets in text_chunks(batch.column(1)):
            values, index = shingle_sets(data, offsets)
            low = minima(values, index)
            keys = low.reshape(len(low), BANDS, ROWS)
            band = np.broadcast_to(base, keys.shape[:2]).copy()
            for k in range(ROWS):
                band = mix(band * np.uint64(0x9E3779B97F4A7C15) + keys[:, :, k])
            digits = pack_digits(low)
            n = np.diff(index)
            sums = []
            for salt in (1, 2):  # a set's identity: two sums of mixed shingles
                s = np.zeros(len(values) + 1, np.uint64)
                np.cumsum(mix(values + np.uint64(salt)), out=s[1:])
                sums.append((s[index[1:]] - s[index[:-1]]).view(np.int64))
            flat = pa.array(band.reshape(-1).view(np.int64))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, len(low) + 1, dtype=np.int32) * BANDS), flat)
            yield pa.RecordBatch.from_arrays([ids.slice(row, len(low)).cast(pa.int64()), pa.array(n.astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.array([d.tobytes() for d in digits], pa.binary()), lists], names=["doc_id", "n_shingles", "one", "two", "digits", "bands"])


def runs(batches, keys: int):
    """Row groups (as batches) with equal values in the first `keys` columns, of input sorted by them."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not len(batch):
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        change = np.zeros(len(batch), bool)
        for c in cols:
            change[1:] |= c[1:] != c[:-1]
        edges = [0, *np.flatnonzero(change).tolist(), len(batch)]
        for a, b in zip(edges, edges[1:]):
            if a == b:
                continue
            key = tuple(c[a] for c in cols)
            if held and key != last:
                yield last, pa.Table.from_batches(held).combine_chunks()
                held = []
            last = key
            held.append(batch.slice(a, b - a))
    if held:
        yield last, pa.Table.from_batches(held).combine_chunks()


def _out_pairs(pairs: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([min(p) for p in pairs], pa.int64()), pa.array([max(p) for p in pairs], pa.int64())], names=["a", "b"])


def bucket_forest(ids: np.ndarray, digits: np.ndarray, floor: float = FLOOR) -> list[tuple[int, int]]:
    """A spanning forest of the bucket's pairs whose estimate reaches the floor."""
    out, left = [], np.arange(len(ids))
    while len(left) > 1:
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            u = queue.pop()
            near = estimate(digits[u], digits[left]) >= floor
            out += [(int(ids[u]), int(ids[v])) for v in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return [p for p in out if p[0] != p[1]]


def _forests(batches):
    pairs: list[tuple[int, int]] = []
    for _, part in runs(batches, 1):
        ids = part.column(1).to_numpy()
        digits = np.frombuffer(b"".join(part.column(2).to_pylist()), np.uint64).reshape(len(ids), -1)
        if len(ids) == 2:
            if ids[0] != ids[1] and estimate(digits[0], digits[1]) >= FLOOR:
                pairs.append((int(ids[0]), int(ids[1])))
        else:
            pairs += bucket_forest(ids, digits)
        if len(pairs) > 50_000:
            yield _out_pairs(pairs)
            pairs = []
    yield _out_pairs(pairs)


def exact_links(ids: list[int], sets: list[np.ndarray], percent: int = 75) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with 100 * intersection >= percent * union."""
    if len(ids) == 2:
        both = len(np.intersect1d(sets[0], sets[1], assume_unique=True))
        return [(ids[0], ids[1])] if both and 100 * both >= percent * (len(sets[0]) + len(sets[1]) - both) else []
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    _, code, df = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = df[code] > 1
    order = np.argsort(code[shared], kind="stable")
    posting = owner[shared][order]
    first = np.zeros(len(df) + 1, np.int64)
    np.cumsum(np.where(df > 1, df, 0), out=first[1:])
    start = np.zeros(len(sets) + 1, np.int64)
    np.cumsum(sizes, out=start[1:])
    out, unseen = [], np.ones(len(sets), bool)
    for root in range(len(sets)):
        if not unseen[root]:
            continue
        unseen[root] = False
        queue = [root]
        while queue:
            u = queue.pop()
            own = code[start[u] : start[u + 1]]
            own = own[df[own] > 1]
            counts = np.zeros(len(sets), np.int64)
            for k in range(0, len(own), 2000):  # bounds the gathered postings
                part = own[k : k + 2000]
                n = df[part]
                at = np.repeat(first[part] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())
                counts += np.bincount(posting[at], minlength=len(sets))
            linked = np.flatnonzero(unseen & (counts > 0) & (100 * counts >= percent * (sizes[u] + sizes - counts)))
            unseen[linked] = False
            out += [(ids[u], ids[v]) for v in linked.tolist()]
            queue += linked.tolist()
    return [p for p in out if p[0] != p[1]]


def _cluster_links(percent: int):
    def run(batches):
        pairs: list[tuple[int, int]] = []
        for _, part in runs(batches, 2):
            ids = part.column(2).to_pylist()
            if len(ids) > 1:
                sets = [np.frombuffer(x, np.uint64) for x in part.column(3).to_pylist()]
                pairs += exact_links(ids, sets, percent)
            if len(pairs) > 50_000:
                yield _out_pairs(pairs)
                pairs = []
        yield _out_pairs(pairs)

    return run


def id_filter(ids: DataFrame, n: int) -> np.ndarray:
    """A one-probe Bloom filter of about n ids (column place64): FILTER_BITS bits at most, so its size has a bound.

    It only spares work: what it lets through wrongly is dropped by a join.
    """
    bits = 1 << min(FILTER_BITS, max(16, (16 * n).bit_length()))
    at = F.col("place64").bitwiseAND(F.lit(bits - 1))
    words = ids.select(F.shiftright(at, 6).alias("word"), F.expr("shiftleft(1L, cast(%d & place64 as int))" % 63).alias("bit"))
    words = words.groupBy("word").agg(F.bit_or("bit").alias("bits")).toArrow()  # at most bits / 64 rows
    out = np.zeros(bits // 64, np.int64)
    out[words["word"].to_numpy()] = words["bits"].to_numpy()
    return out.view(np.uint64)


def _sets(members):
    """(doc_id, held): the full sets of the texts whose ids are in the filter."""

    def run(batches):
        bits = members.value
        top = np.int64(len(bits) * 64 - 1)
        for batch in batches:
            at = batch.column(1).to_numpy(zero_copy_only=False) & top
            there = (bits[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1) == 1
            if not there.any():
                continue
            batch = batch.filter(pa.array(there))
            for row, data, offsets in text_chunks(batch.column(2)):
                values, index = shingle_sets(data, offsets)
                held = pa.Array.from_buffers(pa.large_binary(), len(index) - 1, [None, pa.py_buffer(index.astype(np.int64) * 8), pa.py_buffer(values)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(row, len(index) - 1), held.cast(pa.binary())], names=["doc_id", "held"])

    return run


def cluster_sets(members: DataFrame, n: int, rows: DataFrame) -> DataFrame:
    """(doc_id, held): full sets of (nearly only) the members' texts, made where the texts lie: no text is shuffled."""
    spark = rows.sparkSession
    place = F.xxhash64("doc_id").alias("place64")
    held = spark.sparkContext.broadcast(id_filter(members.select("doc_id").distinct().select(place), n))
    known = rows.where("doc_id is not null").select("doc_id", place, "text")
    return materialize(known.mapInArrow(_sets(held), "doc_id long, held binary"), "sets")


def _shingle_counts(batches):
    """(bucket, n): how often shingles fall into each hash bucket, partial counts."""
    total = np.zeros(1 << ORDER_BITS, np.int64)
    for batch in batches:
        for held in batch.column(0).to_pylist():
            total += np.bincount((np.frombuffer(held, np.uint64) >> np.uint64(64 - ORDER_BITS)).astype(np.int64), minlength=len(total))
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])


def _prefixes(order, percent: int):
    """(cluster, shingle, doc_id): the rarest n - ceil(percent n / 100) + 1 shingles of each set."""

    def run(batches):
        counts = order.value
        for batch in batches:
            tokens, owners = [], []
            for k, held in enumerate(batch.column(2).to_pylist()):
                values = np.frombuffer(held, np.uint64)
                n = len(values) + (-percent * len(values)) // 100 + 1
                tokens.append(values[np.lexsort((values, counts[(values >> np.uint64(64 - ORDER_BITS)).astype(np.int64)]))[:n]])
                owners.append(np.full(len(tokens[-1]), k))
            if tokens:
                at = pa.array(np.concatenate(owners))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), pa.array(np.concatenate(tokens).view(np.int64)), batch.column(1).take(at)], names=["cluster", "shingle", "doc_id"])

    return run


def cut_clusters(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """(doc_id, cluster): large clusters cut into parts no link crosses; documents that are alone then are missing."""
    spark = large.sparkSession
    chosen = large.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(ORDER_DOCUMENTS)
    counted = sets.join(F.broadcast(chosen), "doc_id", "left_semi").select("held").mapInArrow(_shingle_counts, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(1 << ORDER_BITS, np.int64)
    counts[counted["bucket"].to_numpy()] = counted["n"].to_numpy()
    order = spark.sparkContext.broadcast(counts)
    rows = large.select("cluster", "doc_id").join(sets, "doc_id").select("cluster", "doc_id", "held").mapInArrow(_prefixes(order, percent), "cluster long, shingle long, doc_id long")
    rows = materialize(rows, "prefixes")
    first = rows.groupBy("cluster", "shingle").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y")).where("x < y").select("cluster", "shingle", "x")
    # read back, so that a shingle which most documents hold is split in the join
    first = materialize(first, "prefix_firsts")
    stars = rows.join(first, ["cluster", "shingle"]).where("doc_id != x").select(F.col("x").alias("a"), F.col("doc_id").alias("b"))
    out = materialize(components(stars).select(F.col("node").alias("doc_id"), F.col("component").alias("cluster")), "cut_clusters", compact=True)
    release(rows, first)
    return out


def _are_stars(edges: DataFrame) -> bool:
    """Whether each node of (u, v) is either below one other or above others: then the upper ones are the components."""
    ends = edges.select(F.col("u").alias("n"), F.lit(1).alias("below"), F.lit(0).alias("above")).unionByName(edges.select(F.col("v").alias("n"), F.lit(0).alias("below"), F.lit(1).alias("above")))
    return ends.groupBy("n").agg(F.sum("below").alias("below"), F.max("above").alias("above")).where("below > 1 or (below > 0 and above > 0)").isEmpty()


def components(edges: DataFrame) -> DataFrame:
    """(node, component): the smallest node reachable, for every node of the edges (a, b).

    Alternating stars (Kiveris and others, "Connected components in MapReduce and beyond",
    2014): every node first sends its larger neighbours, then its smaller ones, to the
    smallest node it sees, until only stars are left. There are never more edges than at first,
    a star of any size takes one round, and rounds grow with the logarithm of a chain's
    length. A node's minimum comes from an aggregate that is written and joined back, so a
    hub is split in the join. Rounds are tables in the shared folder.
    """
    stars = F.struct(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
    left = materialize(edges.where("a != b").select(stars.alias("e")).select("e.*").distinct(), "edges")
    k, most = 0, 2 * left.count()
    while not _are_stars(left):
        both = left.unionByName(left.select(F.col("v").alias("u"), F.col("u").alias("v")))
        lowest = materialize(both.groupBy("u").agg(F.least("u", F.min("v")).alias("w")), f"lowest_{k}", most=most)
        large = both.where("v > u").join(lowest, "u").select(F.col("v").alias("u"), F.col("w").alias("v")).distinct()
        large = materialize(large, f"large_{k}", most=most)
        lower = large.groupBy("u").agg(F.min("v").alias("w"))  # after the first step a node has few neighbours: minima only
        small = large.join(lower, "u").where("v != w").select(F.col("v").alias("u"), F.col("w").alias("v"))
        old = left
        left = materialize(small.unionByName(lower.select("u", F.col("w").alias("v"))).distinct(), f"edges_{k}", most=most)
        release(old, lowest, large)
        k += 1
    return left.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(left.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def _pieces(n: str, shingles: str, most: int) -> Column:
    return F.greatest(F.ceil(F.col(n) / most), F.ceil(F.col(shingles) * 8 / CHUNK_BYTES)).cast("int")


def _first_parts(members: DataFrame) -> DataFrame:
    """(cluster, parts, doc_id): a document's own piece of its cluster, and every piece for a cluster's leaders."""
    salt = F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(LEADERS))
    leaders = members.where("pieces > 1").groupBy("cluster", salt).agg(F.min("doc_id").alias("doc_id")).select("doc_id", F.lit(True).alias("leads"))
    own = F.array(F.pmod(F.xxhash64("doc_id"), F.col("pieces")).cast("long"))
    every = F.sequence(F.lit(0).cast("long"), F.col("pieces").cast("long") - 1)
    return members.join(leaders, "doc_id", "left").select("cluster", F.when(F.col("leads"), every).otherwise(own).alias("parts"), "doc_id")


def _rooted(clusters: DataFrame, joined: DataFrame) -> DataFrame:
    """(cluster, doc_id, root): the group that each document of (cluster, doc_id) is in so far."""
    return clusters.select("cluster", "doc_id").join(joined, F.col("doc_id") == F.col("node"), "left").select("cluster", "doc_id", F.coalesce("component", "doc_id").alias("root"))


def _second_parts(rooted: DataFrame, sizes: DataFrame) -> DataFrame:
    """(cluster, parts, doc_id) in which every document outside its cluster's largest group meets all documents of the cluster; clusters of one group are done."""
    rows = rooted.join(sizes, "doc_id")
    groups = rows.groupBy("cluster", "root").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s"))
    of_main = F.max_by(F.struct("root", "n", "s"), F.struct("n", "root"))
    main = groups.groupBy("cluster").agg(of_main.alias("main"), F.sum("n").alias("n"), F.sum("s").alias("s")).where("n > main.n")
    main = main.select("cluster", F.col("main.root").alias("main"), _pieces("n", "s", CHUNK).cast("long").alias("chunks"), F.expr("n - main.n").alias("n"), F.expr("s - main.s").alias("s"))
    main = main.select("cluster", "main", F.greatest("chunks", F.lit(1).cast("long")).alias("chunks"), F.greatest(_pieces("n", "s", CHUNK), F.lit(1)).cast("long").alias("rest"))
    rows = rows.join(main, "cluster")
    chunks, zero = F.col("chunks"), F.lit(0).cast("long")
    place = F.pmod(F.xxhash64("doc_id"), chunks)
    among = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.col("rest"))
    against = F.transform(F.sequence(zero, F.col("rest") - 1), lambda a: a * chunks + place)
    all_chunks = F.transform(F.sequence(zero, chunks - 1), lambda b: among * chunks + b)
    return rows.select("cluster", F.when(F.col("root") == F.col("main"), against).otherwise(F.array_union(against, all_chunks)).alias("parts"), "doc_id")


def _exact(members: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Exact links (a, b) within every part of (cluster, parts, doc_id): a spanning forest of each part's links."""
    spread = members.join(sets, "doc_id").select("cluster", F.explode("parts").alias("part"), "doc_id", "held")
    return spread.repartition("cluster", "part").sortWithinPartitions("cluster", "part").mapInArrow(_cluster_links(percent), "a long, b long")


def near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Texts without words (null and empty ones too) have no shingles and no links. Rows that
    repeat an id are one document. Rows without an id come back with a null component and
    are kept. Other columns are dropped. percent may be 75 or more with these bands.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    sketches = materialize(rows.mapInArrow(_sketch, _SKETCH), "sketches")
    used = sketches.where("n_shingles > 0 and doc_id is not null")
    sets = ["one", "two", "n_shingles"]
    classes = materialize(used.groupBy(*sets).agg(F.min("doc_id").alias("first_id")), "classes", compact=True)
    same = used.select("doc_id", *sets).join(classes, sets).where("doc_id != first_id").select(F.col("doc_id").alias("a"), F.col("first_id").alias("b"))
    reps = used.join(classes.withColumnRenamed("first_id", "doc_id"), ["doc_id", *sets], "left_semi").dropDuplicates(["doc_id", "one", "two"])
    reps = materialize(reps.select("doc_id", "n_shingles", "digits", "bands"), "representatives")
    banded = reps.select("doc_id", F.explode("bands").alias("key"))
    buckets = banded.groupBy("key").agg(F.min("doc_id").alias("x"), F.max("doc_id").alias("y"), F.count("*").alias("n")).where("x < y")
    buckets = materialize(buckets.select("key", "x", (F.col("n") > BUCKET).alias("large")), "buckets", compact=True)
    # digits travel only with the few (key, id) that share their key
    candidates = banded.join(buckets.where("not large").select("key"), "key").join(reps.select("doc_id", "digits"), "doc_id").select("key", "doc_id", "digits")
    near = candidates.repartition("key").sortWithinPartitions("key").mapInArrow(_forests, "a long, b long")
    large_buckets = materialize(buckets.where("large").select("key", "x"), "large_buckets", compact=True)
    stars = banded.join(large_buckets, "key").where("doc_id != x")
    near = near.unionByName(stars.select(F.col("x").alias("a"), F.col("doc_id").alias("b")))
    clusters = materialize(components(near), "clusters", compact=True)
    n = clusters.count()
    sizes = reps.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles"))
    members = clusters.select(F.col("component").alias("cluster"), F.col("node").alias("doc_id"))
    total = members.join(sizes, "doc_id").groupBy("cluster").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("s")).select("cluster", _pieces("n", "s", FIRST).alias("pieces"))
    members = materialize(members.join(materialize(total, "cluster_sizes", most=n), "cluster").select("cluster", "doc_id", "pieces"), "members", most=n)
    sets_held = cluster_sets(members, n, rows)
    links = materialize(_exact(_first_parts(members), sets_held, percent), "links")
    # an exact copy hangs on its class's first id: those groups are stars already
    joined = materialize(components(links), "components", most=n)
    if not members.where("pieces > 1").isEmpty():
        rooted = _rooted(members.where("pieces > 1"), joined)
        several = rooted.groupBy("cluster").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x < y").select("cluster")
        unsettled = materialize(rooted.join(several, "cluster", "left_semi"), "unsettled", most=n)
        if not unsettled.isEmpty():
            cut = cut_clusters(unsettled, sets_held, percent)
            left = materialize(_second_parts(_rooted(cut, joined), sizes), "parts_left", most=n)
            more = _exact(left, sets_held, percent)
            joined = materialize(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more)), "components_left", most=n)
    release(buckets, large_buckets, clusters, members, sets_held)
    firsts = same.select(F.col("a").alias("doc_id"), F.col("b").alias("first_id")).distinct()
    repeated = used.groupBy("doc_id").agg(F.min("one").alias("x"), F.max("one").alias("y")).where("x < y").limit(1)
    if not repeated.isEmpty():  # an id with several texts: its copies may join groups, so all links go through the components
        joined = materialize(components(joined.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(same)), "components_all")
        firsts = firsts.where(F.lit(False))
    firsts = materialize(firsts, "copies", compact=True)
    out = sketches.select("doc_id", "n_shingles").join(firsts, "doc_id", "left").withColumn("_at", F.coalesce("first_id", "doc_id"))
    out = out.join(joined, F.col("_at") == F.col("node"), "left")
    component = F.coalesce("component", "_at")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"))


def drop_near_duplicates(docs: DataFrame, percent: int = 75, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without those that have a smaller id in their group; rows without an id stay."""
    (name,) = unused(docs.columns, "_gone")
    gone = materialize(near_duplicates(docs, percent, id_column, text_column).where("not kept").select(F.col("doc_id").alias(name)).distinct(), "near_duplicates")
    return docs.join(gone, docs[id_column].cast("long") == F.col(name), "left_anti")
