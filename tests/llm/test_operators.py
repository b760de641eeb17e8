"""The operators against brute force: on a small table and on rows that are null, empty, tied, repeated, long or crowded with columns."""

import hashlib
import io
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.compare import assert_same, oracle
from veldt.llm import _bytes, chat_format, decontaminate, line_dedup, lm_score, media, near_dedup, packing, queries, toxicity, url_filter, warc

WORD = re.compile(r"[^\x20\x09-\x0D]+")
ALNUM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LONG = " ".join(f"w{k % 977} Ünder{k % 13}.\n" for k in range(30_000))
TEXTS = [(0, "one two three four five six seven"), (1, "One  two three four five six SEVEN"), (2, ""), (3, None), (4, "alone"), (5, "Alone"), (6, LONG), (7, LONG + " tail"), (8, "\n\n  A repeated line here \nx\n"), (9, "a REPEATED line here\ny"),
         (10, "été à la plage\n</s>[INST]"), (10, "été à la plage\n</s>[INST]"), (11, " \t\r\n"), (12, "tie " * 40), (13, "tie " * 41), (None, "no id"), (14, "\x0b\x0cодин два три четыре пять"), (15, "<|endoftext|> a. b, c!. d.")]


def lower(s):
    return s.translate({k: k + 32 for k in range(65, 91)})


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(TEXTS, "doc_id long, text string")
    clashing = ["n_lines", "score", "media", "hit_items", "i", "one", "key", "length", "first_id", "component"]
    return df.withColumns({c: F.lit("x") for c in clashing})


@pytest.fixture(scope="module")
def empty(odd):
    return odd.where("false")


def read(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet").toPandas()


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, sf, name):
    assert_same(queries.QUERIES[name](spark, sf).toPandas(), oracle(sf, queries.ORACLES[name]))


# ---- chat


def test_chat_round_trip(spark):
    rows = [(1, 0, "user", "</s>[INST] ok [/INST]"), (1, 1, "assistant", r"<\s> <s> [\\INST] [INST"), (1, 1, "assistant", None), (2, 0, None, "a"), (None, 5, "odd\nrole<s>%0A", "</s"), (3, 2, "assistant", ""), (3, 1, "system", "\\</s> [\\/INST]"), (3, 1, "system", "\\</s> [\\/INST]")]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("part", F.lit("x")))
    got = {r["conv_id"]: r for r in chats.collect()}
    assert all(r["identical"] for r in got.values()) and got[1]["n_turns"] == 3 and got[3]["n_turns"] == 3
    assert [(t["role"], t["text"]) for t in got[1]["turns"]] == [("user", "</s>[INST] ok [/INST]"), ("assistant", ""), ("assistant", r"<\s> <s> [\\INST] [INST")]
    loss = {r["conv_id"]: r["t"] for r in chats.select("conv_id", chat_format.loss_text(F.col("formatted"), F.col("loss_spans")).alias("t")).collect()}
    assert loss[1] == r"<\s> <s> [\\INST] [INST" and loss[3] == "" and loss[2] == ""
    assert chat_format.format_chats(chats.select("conv_id", F.lit(0).alias("turn"), F.lit("").alias("role"), F.lit("").alias("text")).where("false")).count() == 0


def test_chat_long_texts(spark):
    """Texts of a megabyte, full of control strings, in a conversation of many turns; columns named like the operator's own."""
    text = "</s>[INST] ok [/INST] " * 50_000
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", text if k < 2 else f"turn {k}") for k in range(400)]
    chats = chat_format.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"place": F.lit(0), "end": F.lit(0), "held": F.lit("x")}))
    (row,) = chats.withColumn("loss", F.length(chat_format.loss_text(F.col("formatted"), F.col("loss_spans")))).select("identical", "n_turns", "n_escaped", "loss").collect()
    assert tuple(row) == (True, 400, 2, len(text) + sum(len(f"turn {k}") for k in range(3, 400, 2)))


# ---- packing


def best_fit(sizes, capacity):
    bins = []
    for s in sorted(sizes, reverse=True):
        room = min((r for r in bins if r >= s), default=None)
        if room is not None:
            bins.remove(room)
        bins.append((room if room is not None else capacity) - s)
    return len(bins)


def check_packing(rows, texts, capacity=4096):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(queries.tokenizer_path())
    by, at = defaultdict(list), defaultdict(list)
    for r in rows:
        by[r["doc_id"]].append(r)
        at[r["sequence_id"]].append(r)
    assert Counter(d for d, _ in texts).keys() == by.keys()
    for d, text in texts:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [1], "<u4")
        for start in range(0, len(ids), capacity):
            part = ids[start : start + capacity]
            assert any((r["piece"], r["start"], r["length"], r["ids_crc32"]) == (start // capacity, start, len(part), zlib.crc32(part.tobytes())) for r in by[d])
    for held in at.values():
        end = 0
        for r in sorted(held, key=lambda r: r["offset"]):
            assert r["offset"] == end
            end += r["length"]
        assert end <= capacity
    assert len(at) == best_fit([r["length"] for r in rows], capacity)


def test_packing(spark, sf, odd, empty):
    check_packing(queries.op2_best_fit_packing(spark, sf).collect(), list(read(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False, name=None)))
    path = queries.tokenizer_path()
    check_packing(packing.pack(packing.token_pieces(odd, path)).collect(), TEXTS)
    assert packing.pack(packing.token_pieces(empty, path)).count() == 0
    again = packing.pack(packing.pack(packing.token_pieces(odd, path)))  # places of an earlier packing are replaced
    assert again.columns.count("sequence_id") == again.columns.count("offset") == 1


def test_word_tokens_survive_clashing_hashes_and_a_full_cache(monkeypatch):
    from tokenizers import Tokenizer

    path = queries.tokenizer_path()
    tokenizer = Tokenizer.from_file(path)
    texts = ["Ab ab AB. a.b, c! d, e.", "", " x,\ty.\n", "one.", "no", "Über, straße. 12,5 3, 4", "tail.", ".", "a\x1fb \x85 c\u00a0d"]
    import pyarrow as pa

    def encoded(tokens):
        for row, data, offsets in packing.text_chunks(pa.array(texts)):
            ids, at = tokens.encode(data, offsets, 1)
            return [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])]

    want = [[*tokenizer.encode(t, add_special_tokens=False).ids, 1] for t in texts]
    assert encoded(packing.WordTokens(path)) == want
    tokens = packing.WordTokens(path, cache_words=0)
    assert encoded(tokens) == want and encoded(tokens) == want
    monkeypatch.setattr(packing, "run_hashes", lambda data, starts, ends, kind: (ends - starts).astype(np.uint64))
    assert encoded(packing.WordTokens(path)) == want


def test_pack_histogram():
    rng = np.random.default_rng(3)
    for capacity in (1, 7, 64):
        for n in (0, 1, 300):
            sizes = rng.integers(1, capacity + 1, n).tolist()
            runs = packing.pack_histogram(dict(Counter(sizes)), capacity)
            assert len({b + k for _, _, n, b, _ in runs.tolist() for k in range(n)}) == best_fit(sizes, capacity)


# ---- WARC


def test_warc(spark, tmp_path):
    body = "é" * 80
    pages = [(5, "http://a/", body), (3, "http://b/\r\nX", body), (3, "http://b/", body), (9, None, body), (1, "u", None), (2, "u", ""), (7, "u", "x" * 99), (8, "u", "x" * 99), (None, "u", body), (10, "u", "WARC/1.1\r\n\r\n" * 30)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("payload", F.lit(1))
    path = str(tmp_path / "warc")
    warc.write_archives(df, path)
    got = warc.read_archives(spark, path)
    rows = got.collect()
    assert len(rows) == len(pages)
    kinds = Counter((r["record_type"], warc_id(r["refers_to"])) for r in rows)
    assert kinds == {("revisit", 3): 2, ("response", None): 8}
    for r in rows:
        if r["record_type"] == "response":
            assert hashlib.sha256(r["payload"]).hexdigest() == r["payload_digest"] and len(r["payload"]) == r["payload_bytes"]
    revisits = got.where("record_type = 'revisit'").collect()
    assert len(revisits) == 2 and all(r["payload_bytes"] == 160 for r in revisits)
    plan = got.where("record_type = 'revisit'")._jdf.queryExecution().optimizedPlan().toString()
    assert "Filter" not in plan  # the reader has taken the predicate
    reader = warc.WarcReader({"path": path})
    assert [f for f in reader.pushFilters([warc.EqualTo(("record_type",), "revisit")])] == [] and reader.tests == [("record_type", "in", ("revisit",))]
    bare = warc.read_archives(spark, path, payload=False)
    assert bare.where("payload is not null").count() == 0
    assert sorted(r["payload_bytes"] for r in bare.collect()) == sorted(r["payload_bytes"] for r in rows)
    plain = b"".join(warc.record("response", f"<urn:{k}>", None, "d", b"abc", 3, None) for k in range(3))
    (tmp_path / "p.warc").write_bytes(plain)
    import gzip

    (tmp_path / "g.warc.gz").write_bytes(b"".join(gzip.compress(warc.record("response", f"<urn:{k}>", None, "d", b"abc" * 9000, 27000, None)) for k in range(3)))
    assert warc.read_archives(spark, str(tmp_path / "p.warc")).count() == 3
    kept = warc.read_archives(spark, str(tmp_path / "g.warc.gz")).where("record_id = '<urn:1>'").collect()
    assert len(kept) == 1 and len(kept[0]["payload"]) == 27000
    assert warc.archive_pages(df.where("false")).count() == 0


def warc_id(urn):
    return int(urn.rsplit(":", 1)[1][:-1]) if urn else None


def test_warc_skips_unwanted_payloads():
    class Reads:
        def __init__(self, data):
            self.data, self.at, self.total = data, 0, 0

        def read(self, n):
            out = self.data[self.at : self.at + n]
            self.at, self.total = self.at + len(out), self.total + len(out)
            return out

        def tell(self):
            return self.at

        def seek(self, at):
            self.at = at

    big = np.random.default_rng(1).bytes(3_000_000)
    file = Reads(warc.member(warc.record("response", "a", None, "d", big, len(big), None)) + warc.member(warc.record("revisit", "b", None, "d", b"", 5, "a")))
    got = list(warc.read_records(file, lambda h: h["warc-type"] == "revisit"))
    assert len(got) == 1 and file.total < 300_000
    file.at = file.total = 0
    got = list(warc.read_records(file, lambda h: True, payloads=False))
    assert [(h["warc-type"], p) for h, p in got] == [("response", None), ("revisit", None)] and file.total < 300_000


def test_warc_inflates_headers_only(monkeypatch):
    inflated = []
    real = zlib.decompressobj

    class Counting:
        def __init__(self, bits):
            self.inner = real(bits)

        def decompress(self, data, most=0):
            out = self.inner.decompress(data, most)
            inflated.append(len(out))
            return out

        def __getattr__(self, name):
            return getattr(self.inner, name)

    monkeypatch.setattr(warc.zlib, "decompressobj", Counting)
    page = b"<p>" + b"a" * 5_000_000
    data = warc.member(warc.record("response", "a", "http://u/", "d", page, len(page), None)) * 2
    for payloads, most in ((False, 4_000), (True, 11_000_000)):
        inflated.clear()
        got = list(warc.read_records(io.BytesIO(data), lambda h: True, payloads))
        assert [p for _, p in got] == [page if payloads else None] * 2 and sum(inflated) < most
    inflated.clear()
    assert list(warc.read_records(io.BytesIO(data), lambda h: False)) == [] and sum(inflated) < 4_000
    import gzip

    plain = gzip.compress(warc.record("response", "a", None, "d", page, len(page), None)) * 2  # without lengths the ends must be found
    assert [p for _, p in warc.read_records(io.BytesIO(plain), lambda h: True, False)] == [None] * 2


# ---- toxicity


def test_transducers():
    run, weigh = toxicity.GRAMMAR.run, toxicity.GRAMMAR.weigh
    assert run(list("OIO")) == list("OIO") and run(list("TOI")) == list("TOi") and run(list("NI"))[1] == "n" and run(list("NOOOI"))[4] == "I" and run(list("ROI"))[2] == "r" and run(list("RTNI"))[3] == "n" and run(list("TH")) == list("Th")
    assert run(list("WOH")) == list("WOh") and run(list("IOT")) == list("IOa") and run(list("IOOOT")) == list("IOOOT") and run(list("NWH"))[2] == "n"
    factor = lambda text: [f for _, f in weigh(list(text))]
    assert factor("I") == [1] and factor("II")[1] == toxicity.AGAIN and factor("TI")[1] == toxicity.AIMED and factor("H") == [toxicity.UNANNOUNCED] and factor("WH")[1] == toxicity.ANNOUNCES
    assert factor("NI")[1] == toxicity.DENIED and factor("TI")[0] == 0 and factor("IT") == [1, toxicity.AIMED]
    # the composition is what the five do one after another
    parts = (toxicity.INSULT, toxicity.THREAT, toxicity.NEGATION, toxicity.REPORTED, toxicity.TARGETED)
    draw = np.random.default_rng(0)
    for _ in range(200):
        symbols = [toxicity.ALPHABET[k] for k in draw.integers(0, len(toxicity.ALPHABET), 30)]
        weights = np.ones(30)
        out = symbols
        for part in parts:
            step = part.weigh(out)
            out, weights = [o for o, _ in step], weights * [f for _, f in step]
        assert [o for o, _ in weigh(symbols)] == out and np.allclose([f for _, f in weigh(symbols)], weights)


def plain_score(model, text):
    """Scores a text clause by clause, the whole clause through the grammar, without any of the vectorised steps."""
    known = {}

    def h(w, n=None):
        if (w, n) not in known:
            known[w, n] = hashed(w, n)
        return known[w, n]

    hashed = lambda w, n=None: (lambda x: int(toxicity._prefix_mark(x, n)[0]) if n else int(x[0]))(toxicity.run_hashes(np.frombuffer(w.encode(), np.uint8), np.array([0]), np.array([len(w.encode())])))
    fixed = {h(w): s for s, listed in (("T", toxicity.TARGETS), ("N", toxicity.NEGATIONS), ("R", toxicity.REPORTS), ("W", toxicity.ANNOUNCED), ("H", toxicity.THREATS)) for w in listed}
    arcs = model.arcs | {k: toxicity.THREAT_WEIGHT for k, s in fixed.items() if s == "H"}
    x = np.zeros(toxicity.N_FEATURES)
    for clause in re.split(r"[.,;:!?\n]", text or ""):
        symbols, weights = [], []
        for w in ALNUM.findall(lower(clause)):
            found = [arcs[k] for k in [h(w), *(h(w[:n], n) for n in toxicity.PREFIXES if len(w) > n)] if k in arcs]
            weights.append(max(found, default=None))
            symbols.append("H" if fixed.get(h(w)) == "H" else "I" if found else fixed.get(h(w), "O"))
        total = 0.0
        for (s, f), w in zip(toxicity.GRAMMAR.weigh(symbols), weights):
            amount = f * (w if w is not None else 1.0 if s == "a" else 0.0) if any(v is not None for v in weights) else 0.0
            if amount:
                x[toxicity.OUTPUTS[s]] += amount
                total += amount
        x[5] = max(x[5], total)
    x[:6] = np.log1p(x[:6])
    x[6] = x[5] > 0
    layer = np.array(model.layer)
    return 1 / (1 + math.exp(-float(np.clip(x @ layer[:-1] + layer[-1], -30, 30))))


def test_toxicity_query(spark, sf):
    """The query against the plain scorer, and against the held-out labels."""
    docs = read(spark, sf, "documents")
    model = queries.toxicity_model(spark, sf, spark.read.parquet(f"{sf}/documents.parquet"))
    rows = {r["doc_id"]: r for r in queries.op4_toxicity(spark, sf).collect()}
    assert len(rows) == len(docs)
    for d, text in docs[["doc_id", "text"]].itertuples(index=False, name=None):
        r, want = rows[d], plain_score(model, text)
        assert r["score"] == pytest.approx(want, abs=1e-9) and r["predicted"] == int(want >= 0.5) and r["held_out"] == (zlib.crc32(str(d).encode()) % 5 == 0)


def test_toxicity_quality(spark):
    """On the held-out labels of the largest table: most toxic documents are caught, hardly a clean one is flagged."""
    sf = "/root/testdata/sf0.1"
    rows = queries.op4_toxicity(spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet").select("doc_id", "toxic"), "doc_id").collect()
    toxic, clean = ([r for r in rows if r["toxic"] == k] for k in (1, 0))
    assert len(toxic) > 50 and sum(r["predicted"] for r in toxic) / len(toxic) >= 0.9
    assert sum(r["predicted"] for r in clean) / len(clean) <= 0.01
    auc = np.mean([[a["score"] > b["score"] or 0.5 * (a["score"] == b["score"]) for b in clean] for a in toxic])
    assert auc >= 0.95


def test_toxicity_long_clause_and_code_points():
    model = toxicity.Model({int(toxicity._prefix_mark(toxicity.run_hashes(np.frombuffer("schö".encode(), np.uint8), np.array([0]), np.array([5])), 4)[0]): 3.0}, [1.0] * toxicity.N_FEATURES + [-3.0])
    for text in ("schöner", "schön", "schö", "scho", "you " + "word " * 50_000 + "schönes you " + "word " * 50_000 + "not a schönes", "", "\ud7ff" * 7):
        data = np.frombuffer(text.encode(), np.uint8)
        x = toxicity.Scorer(model).features(data, np.array([0, len(data)]))[0]
        layer = np.array(model.layer)
        assert 1 / (1 + math.exp(-(x @ layer[:-1] + layer[-1]))) == pytest.approx(plain_score(model, text), abs=1e-9)


def test_toxicity(spark, sf, odd, empty):
    labels = spark.createDataFrame([(k, int(k % 3 == 0)) for k in range(90)] + [(None, 1), (5000, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame([(k, ("you are a zorgon, friend. " if k % 3 == 0 else "you are a fine friend. ") + f"word{k} and more") for k in range(120)], "doc_id long, text string")
    model = toxicity.fit(docs, labels)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    assert all((got[k] >= 0.5) == (k % 3 == 0) for k in range(90, 120))
    rows = toxicity.score(odd, model).collect()
    assert len(rows) == len(TEXTS) and all(0 <= r["score"] < 0.5 for r in rows)
    assert toxicity.score(empty, model).count() == 0 == len(toxicity.fit(docs, labels.where("false")).arcs)
    assert all(r["score"] < 0.5 for r in toxicity.score(docs, toxicity.fit(docs, labels.where("toxic = 0"))).collect())


def test_toxicity_caps_keep_the_share(spark):
    docs = spark.range(660).select(F.col("id").alias("doc_id"), F.lit("nothing to see").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 11 == 0).cast("int").alias("toxic"))
    for caps in ({}, {"max_toxic": 40, "max_clean": 80}, {"max_clean": 80}):
        row = toxicity.score(docs, toxicity.fit(docs, labels, **caps)).first()
        assert row["score"] == pytest.approx(60 / 660, rel=1e-3)


# ---- near duplicates


def brute_components(texts):
    sets, at, par = {}, defaultdict(set), {}
    for n, (d, text) in enumerate(texts):
        w = WORD.findall(lower(text or ""))
        sets[n] = frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset()
        par[d] = d
        for g in sets[n]:
            at[g].add(n)

    def find(x):
        while par[x] != x:
            x = par[x]
        return x

    for n, s in sets.items():
        common = Counter(m for g in s for m in at[g])
        for m, c in common.items():
            if 100 * c >= 75 * (len(s) + len(sets[m]) - c):
                a, b = find(texts[n][0]), find(texts[m][0])
                par[max(a, b)] = min(a, b)
    return [(d, len(sets[n]), find(d)) for n, (d, _) in enumerate(texts)]


def test_near_duplicates(spark, sf, odd, empty):
    docs = list(read(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op5_near_dedup(spark, sf).collect())
    assert got == sorted(brute_components(docs))
    known = [t for t in TEXTS if t[0] is not None]
    rows = near_dedup.near_duplicates(odd).collect()
    assert sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows if r["doc_id"] is not None) == sorted(brute_components(known))
    assert [r["kept"] for r in rows if r["doc_id"] is None] == [True]
    assert near_dedup.near_duplicates(empty).count() == 0 == near_dedup.drop_near_duplicates(empty).count()


def test_no_link_is_lost_at_a_larger_size(spark):
    """All rows of sf0.01 against brute force."""
    sf = "/root/testdata/sf0.01"
    docs = list(read(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in queries.op5_near_dedup(spark, sf).collect())
    assert got == sorted(brute_components(docs))


@pytest.mark.parametrize("bucket, first, chunk, leaders", [(near_dedup.BUCKET, 7, 7, 1), (3, 4, 9, 2), (near_dedup.BUCKET, 5, 100, 16)])
def test_chained_copies_beyond_a_chunk_and_a_bucket(spark, monkeypatch, bucket, first, chunk, leaders):
    rng = np.random.default_rng(5)
    base = [f"t{k}" for k in range(80)]
    docs = []
    for k in range(60):
        docs.append((1000 - k, " ".join(base)))
        base = list(base)
        base[int(rng.integers(80))] = f"n{k}"
    for name, value in (("BUCKET", bucket), ("FIRST", first), ("CHUNK", chunk), ("LEADERS", leaders)):
        monkeypatch.setattr(near_dedup, name, value)
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(docs))


def test_documents_of_one_template_fall_apart(spark, monkeypatch):
    """Half of each text is a template: candidates all, links none but the few near copies; prefixes cut the cluster before any sets meet."""
    rng = np.random.default_rng(9)
    template = [f"t{k}" for k in range(72)]
    docs = [(k, " ".join(template + [f"u{k}x{j}" for j in range(25)])) for k in range(120)]
    docs += [(500 + k, docs[k][1].replace(f"u{k}x{int(rng.integers(20))}", "changed")) for k in range(0, 120, 10)]
    for name, value in (("FIRST", 10), ("CHUNK", 10)):
        monkeypatch.setattr(near_dedup, name, value)
    left = []
    second = near_dedup._second_parts
    monkeypatch.setattr(near_dedup, "_second_parts", lambda rooted, sizes: left.append(rooted.groupBy("cluster").count().agg(F.max("count")).first()[0]) or second(rooted, sizes))
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string")).collect())
    assert got == sorted(brute_components(docs)) and len({c for _, _, c in got}) == 120
    assert left == [2]  # the template's cluster has fallen apart into pairs of copies


def test_prefixes_lose_no_link():
    rng = np.random.default_rng(3)
    counts = rng.integers(0, 50, 1 << near_dedup.ORDER_BITS)

    class Held:
        value = counts

    import pyarrow as pa

    for _ in range(300):
        n = int(rng.integers(1, 40))
        a = np.unique(rng.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.unique(np.concatenate([a[rng.random(len(a)) < 0.9], rng.integers(0, 1 << 62, rng.integers(0, 4)).astype(np.uint64)]))
        both = len(np.intersect1d(a, b))
        batch = pa.RecordBatch.from_arrays([pa.array([0, 0]), pa.array([1, 2]), pa.array([a.tobytes(), b.tobytes()], pa.binary())], names=["c", "d", "h"])
        (out,) = near_dedup._prefixes(Held, 75)([batch])
        rows = list(zip(out["doc_id"].to_pylist(), out["shingle"].to_pylist()))
        if both and 100 * both >= 75 * (len(a) + len(b) - both):
            assert {t for d, t in rows if d == 1} & {t for d, t in rows if d == 2}


def test_components(spark):
    rng = np.random.default_rng(8)
    edges = [(k, k + 1) for k in range(1, 200)] + [(500, 501), (501, 502), (700, 700)]  # a chain, a short one, a loop
    edges += [(1000 + int(k), 1000) for k in rng.permutation(300) + 1] + [(3000, 2000 + k) for k in range(300)]  # hubs: the smallest, and the largest node
    shuffled = rng.permutation(64) + 5000
    edges += [(int(shuffled[k]), int(shuffled[k // 2])) for k in range(1, 64)]  # a tree with its numbers mixed up
    edges += [(int(a), int(b)) for a, b in rng.integers(6000, 6100, (60, 2))]  # a random graph
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    got = [(r["node"], r["component"]) for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in {x for e in edges if e[0] != e[1] for x in e})
    assert near_dedup.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---- url filter


def test_url_filter(spark):
    link = '<a href="https://good.net/x">'
    pages = [(1, "https://a.org/x", link), (2, "http://EXAMPLE.org/es/1?q", ""), (3, "https://x.com/de/", '<a href="//good.net/">'), (4, "no scheme", None), (5, None, None), (6, "https://good.net", ""), (7, "https://bad.net/#f", "<a href='http://x.com/y'>"), (8, "http://org", None), (1, "https://a.org/x", link)]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"trust": F.lit(1), "score": F.lit(2)})
    got = {r["page_id"]: r for r in url_filter.judge_urls(df).collect()}
    assert (got[2]["host"], got[2]["path"], got[2]["rule"], got[2]["verdict"]) == ("example.org", "/es/1", "example.org/es/", "block")
    assert (got[1]["rule"], got[3]["rule"], got[8]["rule"]) == ("org/", "com/de/", None)
    assert got[6]["verdict"] == "allow" and got[7]["verdict"] == "block" and got[4]["host"] == "" == got[5]["path"] and got[5]["verdict"] == "allow"
    assert url_filter.judge_urls(df.where("false")).count() == 0


def test_url_filter_reaches_all_hosts(spark):
    """A chain of 14 hosts to a blocked one, and a cycle with a trusted host, against PageRank in NumPy."""
    links = {f"h{k}.net": [f"h{k - 1}.net"] for k in range(1, 14)} | {"h0.net": ["x.com"], "a.org": ["c0.net"], "c0.net": ["c1.net", "x.com"], "c1.net": ["c2.net"], "c2.net": ["c0.net", "h3.net"]}
    pages = [(k, f"http://{h}/", "".join(f'<a href="http://{t}/">' for t in to)) for k, (h, to) in enumerate(links.items())] + [(99, "http://x.com/de/", "")]
    got = {r["host"]: r for r in url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    hosts = sorted(got)
    share = np.array([[float(t in links.get(h, [])) for t in hosts] for h in hosts])
    for kind, seed, a in (("trust", "a.org", share), ("distrust", "x.com", share.T)):
        a = a / np.maximum(a.sum(1, keepdims=True), 1)
        want = np.linalg.solve(np.eye(len(hosts)) - url_filter.DAMPING * a.T, (1 - url_filter.DAMPING) * np.array([h == seed for h in hosts]))
        assert [got[h][kind] for h in hosts] == pytest.approx(want, rel=1e-5, abs=0)
    assert all(got[f"h{k}.net"]["verdict"] == "block" for k in range(4, 14))


def test_url_filter_long_and_repeated(spark):
    """A page of several MB of links, and the same page again: each is judged, links count by page."""
    html = "<a href='http://x.com/y'>" * 100_000
    pages = [(1, "http://far.net/" + "p" * 100_000, html), (1, "http://far.net/", html), (2, "http://x.com/de/", "")]
    got = url_filter.judge_urls(spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("h"), "verdict": F.lit(None).cast("string")})).collect()
    assert sorted((r["page_id"], r["host"], r["verdict"]) for r in got) == [(1, "far.net", "block"), (1, "far.net", "block"), (2, "x.com", "block")]


# ---- media


def test_ogg_every_size():
    """Granule positions are exact for every multiple of the unit up to 1 MB: the sizes whose seconds aren't exact too."""
    data = bytes(1 << 20)
    for n in [*range(64, 1 << 20, 64 * 97), 64_064, 128_128, 500_480]:
        stored = media.mux(data[:n], "bytes=1")
        samples, _, facts = media.decode(stored)
        assert len(samples) == n and facts["seconds"] == n / 8000
        assert media.demux(stored)[zlib.crc32(data[:n])].marks[-1][0] == n


def test_media_query(spark, sf):
    docs = dict(read(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    rows = queries.op7_ogg_media(spark, sf).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(docs)
    for r in rows:
        b = (docs[r["doc_id"]] or "").encode()
        q = b + b"\0" * (max(64, -(-len(b) // 64) * 64) - len(b))
        stored = media.mux(q, f"bytes={len(b)}")
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(q), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-64:]))
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        x = [v - 128 for v in q]
        crossings = sum((a >= 0) != (c >= 0) for a, c in zip(x, x[1:]))
        assert f"rms={math.sqrt(sum(v * v for v in x) / len(x)):.6f};crossings={crossings}" in r["feature"] and f"seconds={len(q) / 8000:.6f};" in r["feature"]


def test_ogg():
    for n in (0, 1, 254, 255, 256, 4080, 60_000, 200_000):
        data = media.padded(np.random.default_rng(n).bytes(n))
        stored = media.mux(data, f"bytes={n}")
        samples, note, facts = media.decode(stored)
        assert samples == data and note == f"bytes={n}" and facts["seconds"] == len(data) / 8000
        broken = bytearray(stored)
        broken[len(stored) // 2] ^= 1
        with pytest.raises(ValueError):
            media.decode(bytes(broken))
        with pytest.raises(ValueError):
            media.decode(stored[:-1])
    long = media.Muxer(7)
    pages = long.pages([b"a" * 70_000, b"", b"b" * 510], [1, 2, 3], True, True)
    streams = media.demux(b"".join(pages))
    assert [len(p) for p in streams[7].packets] == [70_000, 0, 510] and len(pages) > 1


def test_media_columns(spark, odd, empty):
    rows = media.read_media(media.encode_media(odd)).collect()
    for r, (d, text) in zip(rows, TEXTS):
        b = (text or "").encode()
        q = media.padded(b)
        assert (r["doc_id"], r["n_bytes"], r["payload_sha256"], r["tail_crc32"]) == (d, len(b), hashlib.sha256(q).hexdigest(), zlib.crc32(q[-64:]))
    assert media.read_media(media.encode_media(empty)).count() == 0


# ---- language model


def check_scores(rows, texts, held_out):
    counts, tokens = Counter(), 0
    for d, text in texts:
        if not held_out(d):
            w = [*WORD.findall(lower(text or "")), None]
            counts.update(w)
            tokens += len(w)
    assert len(rows) == len(texts)
    want = sorted((str(d), len(w), sum(counts[x] > 0 for x in w), round(sum(math.log10((counts[x] + 1) / (tokens + len(counts) + 1)) for x in w), 4)) for d, text in texts for w in [[*WORD.findall(lower(text or "")), None]])
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["n_known"], round(r["base_score"], 4)) for r in rows) == want
    assert all(r["train_tokens"] == tokens and r["score"] <= 0 for r in rows)


def test_lm(spark, sf, odd, empty):
    docs = list(read(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    rows = queries.op8_lm_score(spark, sf).collect()
    check_scores(rows, docs, lambda d: zlib.crc32(str(d).encode()) % 7 == 2)
    held = [r for r in rows if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    check_scores(lm_score.score_texts(odd, F.lit(True)).collect(), TEXTS, lambda d: False)
    assert lm_score.score_texts(empty, F.lit(True)).count() == 0
    assert lm_score.score_texts(odd, F.lit(False)).where("n_known > 0").count() == 0


def brute_bigrams(texts, learn, quantised, mu=lm_score.MU):
    """Scores of a bigram model with exact counts, quantised downwards to powers of two or not."""
    tokens = [(d, [*WORD.findall(lower(t or "")), None]) for d, t in texts]
    one, two, begins = Counter(), Counter(), 0
    for d, w in tokens:
        if learn(d):
            one.update(w)
            two.update(zip(["<begin>", *w], w))
            begins += 1
    total, known = sum(one.values()), len(one)
    out = []
    for d, w in tokens:
        score = 0.0
        for h, x in zip(["<begin>", *w], w):
            c, context = two[h, x], begins if h == "<begin>" else one[h]
            if quantised and c:
                c = 2 ** (c.bit_length() - 1)
            p = (one[x] + 1) / (total + known + 1)
            score += math.log10((c + mu * p) / (context + mu))
        out.append((d, len(w), score))
    return out


def test_lm_scores_are_the_bigram_model(spark, sf):
    """The query's score is that of the quantised bigram model but for false hits of the filter, which are rare and can only raise it."""
    docs = list(read(spark, sf, "documents")[["doc_id", "text"]].itertuples(index=False, name=None))
    got = {r["doc_id"]: r["score"] for r in queries.op8_lm_score(spark, sf).collect()}
    learn = lambda d: zlib.crc32(str(d).encode()) % 7 != 2
    off = [(got[d] - want) / n for d, n, want in brute_bigrams(docs, learn, True)]
    assert min(off) > -1e-9 and np.mean(off) < 2e-3 and max(off) < 0.05
    exact = [(want - got[d]) / n for d, n, want in brute_bigrams(docs, learn, False)]
    assert np.mean(exact) < 0.1  # what the quantisation costs


def test_bigram_filter():
    rng = np.random.default_rng(2)
    keys = np.unique(rng.integers(0, 1 << 48, 50_000).astype(np.uint64))
    counts = np.floor(1 / rng.random(len(keys)) ** 1.2).astype(np.int64)
    held = lm_score.BigramFilter(keys, counts)
    found = held.levels(keys)
    assert (found >= lm_score.levels_of(counts)).all() and (found == lm_score.levels_of(counts)).mean() > 0.995
    absent = np.setdiff1d(rng.integers(0, 1 << 48, 200_000).astype(np.uint64), keys)
    assert (held.levels(absent) > 0).mean() < 0.003 and 0.2 < held.fill < 0.4
    held.bits[:] = 255  # a full filter: probing ends at the largest level
    assert (held.levels(absent) == held.top).all()
    assert lm_score.BigramFilter(keys[:0], counts[:0]).levels(keys).max() == 0


def test_lm_exchange_grows_with_the_blocks(spark, sf, monkeypatch):
    """Scores don't depend on how texts are dealt to blocks and segments; the number of segments is fixed for all but large corpora, and bounded by their tokens."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").repartition(16, "doc_id")

    def scores():
        return {r["doc_id"]: (r["base_score"], r["n_known"], r["score"]) for r in lm_score.score_texts(docs, F.col("doc_id") % 3 != 0).collect()}

    whole = scores()
    monkeypatch.setattr(lm_score, "BLOCK_TOKENS", 2_000)
    monkeypatch.setattr(lm_score, "MIN_SEGMENTS", 4)
    parts = scores()
    assert all(whole[d][:2] == pytest.approx(parts[d][:2]) and abs(whole[d][2] - parts[d][2]) < 0.05 * abs(whole[d][2]) for d in whole)
    monkeypatch.undo()
    assert lm_score.segments_for(0) == lm_score.segments_for(lm_score.MIN_SEGMENTS * lm_score.SEGMENT_TOKENS) == lm_score.MIN_SEGMENTS
    assert lm_score.segments_for(1 << 40) * lm_score.SEGMENT_TOKENS >= 1 << 40


# ---- lines


def test_lines(spark, odd, empty):
    def key(line):
        return lower(line.strip(" \t\n\x0b\x0c\r"))

    held = defaultdict(set)
    for d, text in TEXTS:
        if d is not None:
            for line in (text or "").split("\n"):
                held[key(line)].add(d)
    want = []
    for d, text in TEXTS:
        lines = (text or "").split("\n")
        kept = [x for x in lines if d is None or len(key(x)) < 10 or len(held[key(x)]) < 2 or min(held[key(x)]) == d]
        want.append((str(d), len(lines), len(lines) - len(kept), "\n".join(kept)))
    got = line_dedup.dedup_lines(odd)
    assert sorted((str(r["doc_id"]), r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == sorted(want)
    assert line_dedup.dedup_lines(empty).count() == 0
    assert line_dedup.dedup_lines(odd, min_documents=3).where("n_dropped > 0").count() == 0


# ---- benchmark


def test_decontamination(spark, odd, empty):
    bench = [(1, "w5 Ünder5. w6 Ünder6"), (2, "one-two three"), (3, None), (4, "..."), (1, "alone"), (None, "plage INST")]
    items = spark.createDataFrame(bench, "item_id long, text string")
    windows = defaultdict(set)
    for d, text in bench:
        w = ALNUM.findall(lower(text or ""))
        n = min(10, len(w))
        for k in range(len(w) - n + 1 if n else 0):
            windows[tuple(w[k : k + n])].add(d)
    for block in (1 << 20, 2):  # one broadcast block, and several behind the Bloom filter
        got = {(r["doc_id"], r["text"]): r for r in decontaminate.mark_contamination(odd, items, block_windows=block).collect()}
        for d, text in TEXTS:
            w, hit, ids = ALNUM.findall(lower(text or "")), set(), set()
            for n in {len(k) for k in windows}:
                for k in range(len(w) - n + 1):
                    found = windows.get(tuple(w[k : k + n]))
                    if found:
                        hit.update(range(k, k + n))
                        ids |= found
            r = got[d, text]
            assert r["n_words"] == len(w) and sum(s["last"] - s["first"] for s in r["hit_spans"]) == len(hit) and set(r["hit_items"]) == {str(x) if x is not None else None for x in ids}
    cut = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(odd, items, remove="spans").collect()}
    assert cut[4] == "" and cut[0] == " four five six seven" and cut[12] == TEXTS[13][1]
    assert decontaminate.decontaminate(empty, items).count() == 0
    assert decontaminate.decontaminate(odd, items.where("false")).count() == len(TEXTS)
    many = spark.createDataFrame([(k, "one two three four") for k in range(30)] * 2, "item_id long, text string")
    for block in (1 << 20, 7):  # a window that many items share is dealt to several blocks
        (row,) = decontaminate.mark_contamination(odd.where("doc_id = 0"), many, block_windows=block).collect()
        assert row["hit_items"] == sorted(map(str, range(30))) and [(s["first"], s["last"]) for s in row["hit_spans"]] == [(0, 4)]


# ---- bytes


def test_hashes_of_long_runs_dont_depend_on_segments(monkeypatch):
    rng = np.random.default_rng(4)
    data = rng.integers(0, 256, 700_000).astype(np.uint8)
    starts = np.sort(rng.integers(0, 690_000, 500))
    ends = np.minimum(starts + np.where(rng.random(500) < 0.05, 600_000, rng.integers(0, 50, 500)), len(data))
    whole = _bytes.run_hashes(data, starts, ends)
    for k in (0, 17, 499):  # a run's hash is its bytes' alone
        assert _bytes.run_hashes(data[starts[k] : ends[k]].copy(), np.array([0]), np.array([ends[k] - starts[k]]))[0] == whole[k]
    assert len(set(whole.tolist())) == len({data[a:b].tobytes().translate(_bytes.LOWER) for a, b in zip(starts, ends)})


def test_kept_lines():
    rng = np.random.default_rng(6)
    texts = ["\n".join("".join(rng.choice(list("ab é"), rng.integers(0, 4))) for _ in range(rng.integers(1, 9))) for _ in range(300)]
    import pyarrow as pa

    for _, data, offsets in _bytes.text_chunks(pa.array(texts), 200):
        starts, ends, index, one, two, points = line_dedup.line_keys(data, offsets)
        raw = data.tobytes()
        assert points.tolist() == [len(raw[a:b].decode().strip(" ")) for a, b in zip(starts, ends)]
        keep = rng.random(len(starts)) < 0.5
        left, at = line_dedup.without_lines(data, starts, ends, index, keep)
        got = [left[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        assert got == [b"\n".join(raw[starts[k] : ends[k]] for k in range(index[t], index[t + 1]) if keep[k]) for t in range(len(offsets) - 1)]
    one, two = np.array([5, 5, 7, 9], np.uint64), np.array([1, 2, 3, 4], np.uint64)
    assert line_dedup.listed(one, two, np.array([9, 5, 5, 5], np.uint64), np.array([5, 9, 2, 8], np.uint64)).tolist() == [False, True, False, False]


# ---- pipeline


@pytest.fixture
def shop(spark, tmp_path):
    """A folder with all tables the pipeline reads, its documents odd ones: null, empty, long, repeated, without an id, with clashing columns."""
    toxic = "you are a zorgon, friend. "
    rows = [(1000 + k, (toxic if k % 3 == 0 else "a fine day it is, friend. ") + f"word{k} and more of {k * 7} here") for k in range(90)]
    rows += [(2000, "the quick onyx goblin jumps over the lazy dwarf while nobody looks at all"), (2001, "nothing of note")]
    rows += [(d, t) for d, t in TEXTS]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"lang": F.lit(None).cast("string"), "source": F.lit("s"), "n_chars": F.length("text").cast("long"), "score": F.lit("x"), "n_lines": F.lit("x"), "hit_spans": F.lit("x"), "hit_items": F.lit(1), "cluster": F.lit("x"), "_drops": F.lit("x"), "_gone": F.lit(1), "_suspect": F.lit(True), "_salt": F.lit(1), "_aside_score": F.lit("y")})
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1000 + k, 0, int(k % 3 == 0)) for k in range(80)] + [(None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "over the lazy dwarf while nobody looks at all"), (2, None), (None, "...")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    return str(tmp_path)


def held(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_pipeline_stages_against_brute_force(spark, shop):
    import corpus_pipeline

    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{shop}/documents.parquet")
    model = queries.toxicity_model(spark, shop, docs)
    one = stages["toxicity"](spark, docs, shop).persist()
    assert one.columns == docs.columns and held(one) == sorted([(d, t) for d, t in held(docs) if plain_score(model, t) < 0.5], key=str)
    assert 20 < docs.count() - one.count() <= 30  # the toxic thirty, and none of the odd ones
    two = stages["line_dedup"](spark, one, shop).persist()
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    at = defaultdict(set)
    for d, t in held(one):
        for line in (t or "").split("\n"):
            at[key(line)].add(d)
    kept = lambda d, t: "\n".join(x for x in (t or "").split("\n") if d is None or len(key(x)) < 10 or len(at[key(x)] - {None}) < 2 or min(at[key(x)] - {None}) == d)
    assert two.columns == docs.columns and held(two) == sorted([(d, kept(d, t)) for d, t in held(one)], key=str)
    assert two.where("n_chars != length(text)").count() == 0 == two.where("n_lines != 'x'").count()
    three = stages["near_dedup"](spark, two, shop).persist()
    rows = held(two)
    with_id = [r for r in rows if r[0] is not None]
    groups = {d: c for d, _, c in brute_components(with_id)}
    assert three.columns == docs.columns and held(three) == sorted([r for r in rows if r[0] is None or groups[r[0]] == r[0]], key=str)
    four = stages["decontaminate"](spark, three, shop).persist()
    assert four.columns == docs.columns and {d for d, _ in held(three)} - {d for d, _ in held(four)} == {2000}
    five = stages["pack"](spark, four, shop)
    check_packing(five.collect(), held(four))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs.where("false"), shop).count() == 0, name
    assert stages["pack"](spark, docs.where("false"), shop).count() == 0


def test_pipeline(spark, sf):
    import corpus_pipeline

    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = docs.columns
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf).persist()
        assert docs.columns == names and docs.count() > 100, name
    packed = corpus_pipeline.run(spark, sf)
    assert {r["doc_id"] for r in packed.select("doc_id").collect()} == {r["doc_id"] for r in docs.select("doc_id").collect()}
