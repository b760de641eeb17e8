"""Toxicity by a weighted finite-state pattern grammar over clauses.

A lexicon turns words into symbols with weights: insult words (learnt weights), words of
violence, announcements ("will"), targets, negations and verbs of reported speech. Five
weighted transducers (insult, threat, negation, reported speech, target) are composed into
one; it rewrites each insult or threat of a clause into what it is in its context, and each
arc has a factor for the word's weight: a second insult counts more, an announced threat is
one, what is negated or reported counts little, what is aimed at a target (before it or
after it) counts more. A text's score comes from the weights of its matched clauses, through
a logistic layer.

Targets, negations, reporting verbs and words of threats are fixed short lists. Insults are
learnt from labels: whole words, and word beginnings (arcs "abc...") of PREFIXES code
points, that mark toxic texts by a likelihood-ratio test. Learning reads at most MAX_TOXIC
and MAX_CLEAN labelled texts, those with the smallest hashes of their ids, so the arcs it
finds are bounded too; scoring reads whole texts.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from veldt.llm._bytes import ALNUM, mix, run_hashes, text_chunks, words
from veldt.llm._store import materialize, small_batches

MAX_TOXIC = 6_000
MAX_CLEAN = 12_000
MIN_TEST = 20.0
MIN_WEIGHT = 3.0
PREFIXES = (4, 5, 6)

#: Function words of the grammar, in English, German, French and Spanish.
TARGETS = "you your yours he she they them him her this that these those du dich dir ihr euch er sie dieser diese tu toi te vous il elle ils elles ce cette tú te ti usted ustedes él ella ellos ese esa".split()
NEGATIONS = "not no never nor neither without cannot don didn isn aren wasn won nicht kein keine nie niemals pas jamais sans nunca jamás sin tampoco".split()
REPORTS = "said says say told tells wrote writes claimed claims called reported quoted allegedly sagte sagt schrieb behauptete nannte dit disait affirme écrit dijo dice escribió afirmó".split()
THREATS = "kill hurt destroy stab shoot punch strangle umbringen töten verprügeln tuer frapper détruire matar golpear destruir".split()
ANNOUNCED = "will gonna going shall werde wirst vais allons voy vamos".split()
THREAT_WEIGHT = 4.0


@dataclass
class Transducer:
    """A deterministic weighted transducer: (state, symbol) -> (state, output, factor).

    A symbol without an arc passes through with factor 1 and the state stays.
    """

    start: int
    arcs: dict[tuple[int, str], tuple[int, str, float]]
    states: int

    def step(self, state: int, symbol: str) -> tuple[int, str, float]:
        return self.arcs.get((state, symbol), (state, symbol, 1.0))

    def compose(self, after: Transducer, alphabet: str) -> Transducer:
        """The transducer that feeds this one's output to `after`; factors multiply."""
        arcs = {}
        for a in range(self.states):
            for b in range(after.states):
                for symbol in alphabet:
                    a2, mid, one = self.step(a, symbol)
                    b2, out, two = after.step(b, mid)
                    arcs[a * after.states + b, symbol] = (a2 * after.states + b2, out, one * two)
        return Transducer(self.start * after.states + after.start, arcs, self.states * after.states)

    def weigh(self, symbols: list[str]) -> list[tuple[str, float]]:
        """Outputs and factors."""
        state, out = self.start, []
        for s in symbols:
            state, o, factor = self.step(state, s)
            out.append((o, factor))
        return out

    def run(self, symbols: list[str]) -> list[str]:
        return [o for o, _ in self.weigh(symbols)]


def _scope(opener: str, length: int, rewrite: dict[str, tuple[str, float]], symbols: str, outside: dict[str, float] | None = None) -> Transducer:
    """Within `length` places after `opener`, symbols are rewritten with factors; `outside` has factors elsewhere."""
    arcs = {}
    for state in range(length + 1):
        for s in symbols:
            out, factor = rewrite.get(s, (s, 1.0)) if state else (s, (outside or {}).get(s, 1.0))
            arcs[state, s] = (length if s == opener else max(state - 1, 0), out, factor)
    return Transducer(0, arcs, length + 1)


def _aimed(before: int, after: int, symbols: str) -> Transducer:
    """Insults and threats within `before` places after a target are aimed; a target within `after` places after one that isn't becomes `a`.

    A target has a weight of its own, which counts only as `a`.
    """
    arcs = {}
    for target in range(before + 1):
        for waiting in range(after + 1):
            state = target * (after + 1) + waiting
            faded = max(target - 1, 0) * (after + 1)
            for s in symbols:
                if s == "T":
                    arcs[state, s] = (before * (after + 1), "a" if waiting else "T", AIMED if waiting else 0.0)
                elif s in "IHh":
                    arcs[state, s] = (faded, "i" if s == "I" else "h", AIMED) if target else (faded + after, s, 1.0)
                else:
                    arcs[state, s] = (faded + max(waiting - 1, 0), s, 1.0)
    return Transducer(0, arcs, (before + 1) * (after + 1))


#: Factors of the arcs.
AGAIN, ANNOUNCES, UNANNOUNCED, DENIED, AIMED = 1.25, 1.5, 0.75, 0.25, 1.5
#: Input: I insult, H word of violence, W announcement, T target, N negation, R report, O other.
#: Output adds: h a threat (announced or aimed), n negated, r reported, i an insult aimed at a
#: target before it, a a target after an insult or a threat.
ALPHABET = "IHWTNRO"
INSULT = _scope("I", 2, {"I": ("I", AGAIN)}, ALPHABET)
THREAT = _scope("W", 4, {"H": ("h", ANNOUNCES)}, ALPHABET, {"H": UNANNOUNCED})
NEGATION = _scope("N", 3, {s: ("n", DENIED) for s in "IHh"}, ALPHABET + "h")
REPORTED = _scope("R", 8, {s: ("r", DENIED) for s in "IHh"}, ALPHABET + "hn")
TARGETED = _aimed(4, 3, ALPHABET + "hnr")
GRAMMAR = INSULT.compose(THREAT, ALPHABET).compose(NEGATION, ALPHABET).compose(REPORTED, ALPHABET).compose(TARGETED, ALPHABET)
#: No transducer remembers more places than REACH; an insult's target is at most AFTER places behind it.
REACH, AFTER = 8, 3
#: The feature that each output's weight goes to.
OUTPUTS = {"I": 0, "i": 1, "a": 1, "n": 2, "r": 3, "H": 4, "h": 4}
N_FEATURES = 7


@dataclass
class Model:
    """Insult arcs by hash with weights, and the logistic layer."""

    arcs: dict[int, float] = field(default_factory=dict)
    layer: list[float] = field(default_factory=lambda: [0.0] * N_FEATURES + [-1.0986])


def _prefix_mark(hashes: np.ndarray, length: int) -> np.ndarray:
    return mix(hashes ^ np.uint64(length << 56 | 0xA5))


def word_features(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> list[np.ndarray]:
    """Hashes of whole words, then of their beginnings (of PREFIXES code points) where a word is longer (else 0)."""
    out = [run_hashes(data, starts, ends)]
    points = np.flatnonzero((data & 0xC0) != 0x80)
    at, last = np.searchsorted(points, starts), len(points)
    for n in PREFIXES:
        cut = np.where(at + n < last, points[np.minimum(at + n, last - 1)] if last else 0, len(data))
        out.append(np.where(cut < ends, _prefix_mark(run_hashes(data, starts, np.minimum(cut, ends)), n), np.uint64(0)))
    return out


def _fixed_symbols() -> dict[int, str]:
    out: dict[int, str] = {}
    for symbol, listed in (("T", TARGETS), ("N", NEGATIONS), ("R", REPORTS), ("W", ANNOUNCED), ("H", THREATS)):
        for w in listed:
            data = np.frombuffer(w.encode(), np.uint8)
            out[int(run_hashes(data, np.array([0]), np.array([len(data)]))[0])] = symbol
    return out


class Scorer:
    """Clause features of texts under a model."""

    def __init__(self, model: Model):
        self.fixed = _fixed_symbols()
        self.arcs = model.arcs | {h: THREAT_WEIGHT for h, s in self.fixed.items() if s == "H"}
        self.table = np.array(sorted(self.arcs), np.uint64)
        self.quick = np.zeros(1 << 20, bool)
        self.quick[(self.table >> np.uint64(44)).astype(np.int64)] = True
        self.delimiter = np.zeros(256, bool)
        self.delimiter[list(b".,;:!?\n")] = True

    def features(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A row per text: log sums of direct, aimed, negated, reported and threatening weight, the heaviest clause, and whether any matched."""
        out = np.zeros((len(offsets) - 1, N_FEATURES))
        starts, ends, index = words(data, offsets, ALNUM)
        if not len(starts) or not len(self.table):
            return out
        kinds = word_features(data, starts, ends)
        weight: dict[int, float] = {}
        for hashes in kinds:
            at = np.flatnonzero(self.quick[(hashes >> np.uint64(44)).astype(np.int64)])
            at = at[self.table[np.minimum(np.searchsorted(self.table, hashes[at]), len(self.table) - 1)] == hashes[at]]
            for k, h in zip(at.tolist(), hashes[at].tolist()):
                weight[k] = max(weight.get(k, 0.0), self.arcs[h])
        if not weight:
            return out
        breaks = np.flatnonzero(self.delimiter[data])
        # a clause is a run of words without a delimiter or a text's end between them
        clause = np.searchsorted(breaks, starts) + np.searchsorted(offsets, starts, "right")
        hit = np.array(sorted(weight))
        low, high = np.searchsorted(clause, clause[hit], "left"), np.searchsorted(clause, clause[hit], "right")
        text = np.searchsorted(index, hit, "right") - 1
        places, low, high, text = hit.tolist(), low.tolist(), high.tolist(), text.tolist()
        p, total, at_clause = 0, 0.0, -1
        while p < len(places):
            k, a, b, t = places[p], low[p], high[p], text[p]
            if a != at_clause:
                total, at_clause = 0.0, a
            # what the grammar does at a hit depends on REACH places before it; hits close by share a window
            first, last, p = max(a, k - REACH), k, p + 1
            while p < len(places) and places[p] < b and places[p] - last <= REACH + AFTER:
                last, p = places[p], p + 1
            done = min(b, last + AFTER + 1)
            symbols = ["H" if self.fixed.get(h) == "H" else "I" if j in weight else self.fixed.get(h, "O") for j, h in enumerate(kinds[0][first:done].tolist(), first)]
            for j, (s, factor) in enumerate(GRAMMAR.weigh(symbols), first):
                amount = factor * weight.get(j, 1.0 if s == "a" else 0.0)
                if amount:
                    out[t, OUTPUTS[s]] += amount
                    total += amount
            out[t, 5] = max(out[t, 5], total)
        out[:, :6] = np.log1p(out[:, :6])
        out[:, 6] = out[:, 5] > 0
        return out


#: Features held before their counts go out; Spark adds up the partial counts.
COUNT_BUFFER = 1_000_000


def _count_features(batches):
    """(feature, toxic texts, clean texts), partial counts."""
    held: tuple[list, list] = ([], [])
    size = 0

    def counted():
        for toxic, parts in enumerate(held):
            if parts:
                keys, n = np.unique(np.concatenate(parts), return_counts=True)
                zero = np.zeros(len(n), np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(keys.view(np.int64)), pa.array(n if toxic else zero), pa.array(zero if toxic else n)], names=["feature", "toxic", "clean"])
                parts.clear()

    for batch in batches:
        toxic = batch.column(1).to_numpy(zero_copy_only=False)
        for row, data, offsets in text_chunks(batch.column(0)):
            starts, ends, index = words(data, offsets, ALNUM)
            kinds = word_features(data, starts, ends)
            for k in range(len(offsets) - 1):
                own = np.unique(np.concatenate([x[index[k] : index[k + 1]] for x in kinds]))
                own = own[own != 0]
                held[int(toxic[row + k])].append(own)
                size += len(own)
            if size > COUNT_BUFFER:
                yield from counted()
                size = 0
    yield from counted()


def _features_only(model: Model):
    def run(batches):
        scorer = Scorer(model)
        for batch in batches:
            for row, data, offsets in text_chunks(batch.column(0)):
                x = scorer.features(data, offsets)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(row, len(x)).cast(pa.int64()), pa.array(x.tolist(), pa.list_(pa.float64()))], names=["toxic", "x"])

    return run


def fit_layer(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2) -> list[float]:
    """Logistic regression by Newton steps; the last weight is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    w[-1] = np.log((y.sum() + 0.5) / (len(y) - y.sum() + 1.5))
    penalty = np.diag([ridge * max(1, len(y)) ** 0.5] * (x.shape[1] - 1) + [0.0])
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        h = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + penalty + 1e-9 * np.eye(len(w))
        step = np.linalg.solve(h, x.T @ (y - p) - penalty @ w)
        w = w + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return w.tolist()


def fit(docs: DataFrame, labels: DataFrame, text_column: str = "text", id_column: str = "doc_id", label_column: str = "toxic", max_toxic: int = MAX_TOXIC, max_clean: int = MAX_CLEAN) -> Model:
    """Learn a model from the texts of labelled ids (null labels and ids don't count).

    The sample is chosen among the labels, so its ids are few enough to broadcast and no text
    is shuffled to find it. The kinds are capped apart, so the intercept is corrected by the
    shares of each that were chosen: scores don't depend on the caps' ratio. Without labels of both kinds the model has fixed arcs only and a
    low prior.
    """
    small_batches(docs.sparkSession)
    rows = labels.where(F.col(label_column).isNotNull() & F.col(id_column).isNotNull()).select(F.col(id_column).alias("_id"), (F.col(label_column) > 0).cast("int").alias("toxic"))
    rows = rows.groupBy("_id").agg(F.max("toxic").alias("toxic")).withColumn("_h", F.xxhash64("_id"))
    chosen = rows.where("toxic = 1").orderBy("_h", "_id").limit(max_toxic).unionByName(rows.where("toxic = 0").orderBy("_h", "_id").limit(max_clean))
    texts = docs.select(F.col(id_column).alias("doc_id"), F.coalesce(F.col(text_column), F.lit("")).alias("text"))
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("_id")).select("text", "toxic")
    sample = materialize(sample.repartition(16), "labelled")
    labelled = {r["toxic"]: r["n"] for r in rows.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    n = {r["toxic"]: r["n"] for r in sample.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    toxic, clean = n.get(1, 0), n.get(0, 0)
    model = Model()
    if not toxic or not clean:
        return model
    share = toxic / (toxic + clean)
    counts = sample.mapInArrow(_count_features, "feature long, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("a"), F.sum("clean").alias("b"))
    a, b = F.col("a"), F.col("b")
    test = 2 * (a * F.log((a + 1e-9) / ((a + b) * share)) + b * F.log((b + 1e-9) / ((a + b) * (1 - share))))
    weight = F.log((a + 0.5) / (toxic + 1)) - F.log((b + 0.5) / (clean + 1))
    arcs = counts.select("feature", test.alias("test"), weight.alias("weight")).where(F.col("test") >= MIN_TEST).where(F.col("weight") >= MIN_WEIGHT)
    model.arcs = {r["feature"] & (1 << 64) - 1: r["weight"] for r in arcs.collect()}  # of the bounded sample's features, those that mark toxic texts
    got = sample.mapInArrow(_features_only(model), "toxic long, x array<double>").collect()  # at most max_toxic + max_clean short rows
    model.layer = fit_layer(np.array([r["x"] for r in got]), np.array([r["toxic"] for r in got], float))
    model.layer[-1] += float(np.log(max(1.0, labelled[1] / max_toxic)) - np.log(max(1.0, labelled[0] / max_clean)))
    return model


def score(docs: DataFrame, model: Model, text_column: str = "text") -> DataFrame:
    """The documents with score, 0 to 1; a column called score is replaced.

    Empty and null texts, and texts without a match, have the prior's score. Equal texts have
    equal scores; rows that repeat, and those without an id, are kept and scored alike.
    """
    spark = docs.sparkSession
    small_batches(spark)
    docs = docs.drop("score")
    names = docs.columns
    at = names.index(text_column)
    held = spark.sparkContext.broadcast(model)  # of a bounded sample

    def run(batches):
        model = held.value
        scorer, layer = Scorer(model), np.array(model.layer)
        for batch in batches:
            out = [np.zeros(0)]
            for _, data, offsets in text_chunks(batch.column(at)):
                x = scorer.features(data, offsets) @ layer[:-1] + layer[-1]
                out.append(1 / (1 + np.exp(-np.clip(x, -30, 30))))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.concatenate(out))], names=[*names, "score"])

    from pyspark.sql import types as T

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField("score", T.DoubleType())]))
