"""Queries of the training-data operators, with production parameters, over whole tables; and SQL where it can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import chat_format, decontaminate, line_dedup, lm_score, media, near_dedup, packing, toxicity, url_filter, warc
from veldt.llm._store import crc_bucket, table

WORD_TOKENIZER = "word_bpe_49k.json"


def tokenizer_path(name: str = WORD_TOKENIZER) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and a planted one, as a digest of what is read back from its formatted text."""
    planted = spark.sql(r"""SELECT CAST(-1 AS BIGINT) AS conv_id, CAST(turn AS BIGINT) AS turn, role, '</s>[INST] ok [/INST]' AS text FROM VALUES (0, 'user'), (1, 'assistant') AS t(turn, role)""")
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    chats = chat_format.format_chats(turns)
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = chat_format.loss_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id", "n_turns", F.sha2(said, 256).alias("turns_sha256"), F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"), "identical",
    )


OP1_SQL = r"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
), said AS (
  SELECT *, regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS escaped FROM rows
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length(escaped) + length(role) + 8 + CASE WHEN role = 'assistant' THEN 0 ELSE 15 END) AS BIGINT) AS formatted_chars,
  true AS identical
FROM said GROUP BY conv_id
"""


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token pieces with their places in sequences of 4096 tokens."""
    return packing.pack(packing.token_pieces(table(spark, sf_dir, "documents"), tokenizer_path()))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a record read back from archives."""
    read = warc.archive_pages(table(spark, sf_dir, "pages"))
    kind = F.col("record_type")
    page = lambda c: F.when(F.col(c).isNotNull(), F.try_to_number(warc.urn_page(F.col(c)), F.lit("S9999999999999999999")).cast("long"))
    return read.select(
        page("record_id").alias("page_id"), F.when(kind == "response", F.octet_length("payload").cast("long")).otherwise(F.col("payload_bytes")).alias("payload_bytes"),
        warc.checked_digest(F.col("payload_digest"), F.col("payload"), kind).alias("payload_digest"), kind.alias("record_type"), page("refers_to").alias("refers_to"),
    )


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha256(html) AS payload_digest FROM p),
f AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first_id < page_id THEN first_id END AS refers_to
FROM f
"""


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's score, learnt from the labelled rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity_model(spark, sf_dir, docs)
    return toxicity.score(docs, model).select("doc_id", (crc_bucket(F.col("doc_id"), 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def toxicity_model(spark: SparkSession, sf_dir: str, docs: DataFrame) -> toxicity.Model:
    """Learnt from the labelled rows whose crc32(doc_id) mod 5 isn't 0."""
    labels = table(spark, sf_dir, "labels").where(crc_bucket(F.col("doc_id"), 5) != 0).select("doc_id", "toxic")
    return toxicity.fit(docs.select("doc_id", "text"), labels)


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its set's size and the smallest id it is linked with."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's url, judged by the rules and else by the link graph."""
    return url_filter.judge_urls(table(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "host", "path", "rule", "verdict")


def op7_ogg_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's text as an Ogg file, read back."""
    return media.read_media(media.encode_media(table(spark, sf_dir, "documents").select("doc_id", "text")))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's base score and bigram score, learnt from the rows that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = lm_score.score_texts(docs, crc_bucket(F.col("doc_id"), 7) != 2)
    return scored.select("doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without its repeated lines, as a digest."""
    kept = line_dedup.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


OP9_SQL = """
WITH l AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS place FROM documents
), k AS (
  SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l
), h AS (
  SELECT key, min(doc_id) AS first_id FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), m AS (
  SELECT k.*, (h.key IS NOT NULL AND k.doc_id <> h.first_id) AS gone FROM k LEFT JOIN h USING (key)
)
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with its benchmark hits, as counts and a digest of the items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark_contamination(docs, table(spark, sf_dir, "benchmark"))
    covered = F.aggregate("hit_spans", F.lit(0).cast("long"), lambda n, s: n + s["last"] - s["first"])
    return marked.select(
        "doc_id", "n_words", covered.alias("n_hit"), F.size("hit_items").cast("long").alias("n_items"), F.sha2(F.array_join("hit_items", ","), 256).alias("items_sha256"), (covered > 0).alias("contaminated")
    )


OP5_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, hash(array_to_string(list_slice(w, p, p + 4), ' ')) AS g, array_to_string(list_slice(w, p, p + 4), ' ') AS t
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2
), links AS (
  SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (
  SELECT doc_id AS node, doc_id AS low FROM documents
  UNION SELECT links.b, reach.low FROM reach JOIN links ON links.a = reach.node WHERE reach.low < links.b
)
SELECT doc_id, coalesce(n, 0) AS n_shingles, m AS component_id, m = doc_id AS kept
FROM documents JOIN (SELECT node, min(low) AS m FROM reach GROUP BY node) ON node = doc_id LEFT JOIN n USING (doc_id)
"""


OP6_SQL = r"""
WITH RECURSIVE p AS (
  SELECT page_id, url, html, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages
), rules AS (
  SELECT * FROM (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')) t(verdict, rule_host, rule_path)
), judged AS (
  SELECT p.page_id, p.host, p.path, arg_max(rule_host || rule_path, length(rule_host || rule_path)) AS rule, arg_max(verdict, length(rule_host || rule_path)) AS ruled
  FROM p LEFT JOIN rules ON (p.host = rule_host OR ends_with(p.host, '.' || rule_host)) AND starts_with(p.path, rule_path) GROUP BY ALL
), masses AS (
  SELECT 'trust' AS kind, host, count(*) FILTER (ruled = 'allow') / greatest(sum(count(*) FILTER (ruled = 'allow')) OVER (), 1) AS mass FROM judged WHERE host <> '' GROUP BY host
  UNION ALL SELECT 'distrust', host, count(*) FILTER (ruled = 'block') / greatest(sum(count(*) FILTER (ruled = 'block')) OVER (), 1) FROM judged WHERE host <> '' GROUP BY host
), found AS (
  SELECT host AS source, unnest(regexp_extract_all(coalesce(html, ''), '(?i)href\s*=\s*["'']?\s*((?:[a-z][a-z0-9+.-]*:)?//[^"''\s>]+)', 1)) AS link FROM p
), links AS (
  SELECT source, target, count(*) AS weight FROM (
    SELECT source, translate(regexp_extract(CASE WHEN starts_with(link, '//') THEN 'http:' || link ELSE link END, '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS target FROM found
  ) WHERE source <> '' AND target <> '' AND source <> target GROUP BY ALL
), edges AS (
  SELECT 'trust' AS kind, source, target, weight / sum(weight) OVER (PARTITION BY source) AS share FROM links
  UNION ALL SELECT 'distrust', target, source, weight / sum(weight) OVER (PARTITION BY target) FROM links
), walks AS (
  SELECT 0 AS step, kind, host, 0.15 * mass AS score FROM masses WHERE mass > 0
  UNION ALL
  SELECT step + 1, kind, host, score FROM (
    SELECT any_value(walks.step) AS step, walks.kind AS kind, edges.target AS host, sum(0.85 * walks.score * edges.share) AS score
    FROM walks JOIN edges ON edges.kind = walks.kind AND edges.source = walks.host GROUP BY walks.kind, edges.target
  ) WHERE step < 200
), scores AS (SELECT host, coalesce(sum(score) FILTER (kind = 'trust'), 0) AS trust, coalesce(sum(score) FILTER (kind = 'distrust'), 0) AS distrust FROM walks GROUP BY host)
SELECT page_id, judged.host AS host, path, rule, coalesce(ruled, CASE WHEN coalesce(distrust, 0) > coalesce(trust, 0) THEN 'block' ELSE 'allow' END) AS verdict
FROM judged LEFT JOIN scores ON scores.host = judged.host
"""


OP10_SQL = r"""
WITH item_words AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), item_windows AS (
  SELECT DISTINCT item, n, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
  FROM (SELECT item, w, least(len(w), 10) AS n, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM item_words WHERE len(w) > 0)
), lengths AS (SELECT DISTINCT n FROM item_windows),
doc_words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), hits AS (
  SELECT doc_id, n, p, item FROM (
    SELECT doc_id, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS win
    FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM doc_words, lengths WHERE len(w) >= n)
  ) JOIN item_windows USING (n, win)
), places AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + n)) AS q FROM hits) GROUP BY doc_id
), items AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS listed FROM (SELECT DISTINCT doc_id, item FROM hits) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(listed, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM doc_words LEFT JOIN places USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def media_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op7 that SQL can say too."""
    return op7_ogg_media(spark, sf_dir).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256")


MEDIA_SQL = r"""
WITH p AS (SELECT doc_id, encode(coalesce(text, '')) AS raw FROM documents),
q AS (SELECT *, CAST(octet_length(raw) AS BIGINT) AS n, greatest(64, CAST(ceil(octet_length(raw) / 64.0) AS BIGINT) * 64) AS full_size FROM p)
SELECT doc_id, n AS n_bytes, full_size AS payload_bytes, sha256(raw || CAST(repeat('\x00', full_size - n) AS BLOB)) AS payload_sha256 FROM q
"""


def lm_base_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The columns of op8 that SQL can say too, but for which rows are held out (DuckDB has no crc32): learnt from all rows."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return lm_score.score_texts(docs, F.lit(True)).select("doc_id", "n_tokens", "n_known", "train_tokens", F.round("base_score", 4).alias("base_score"))


LM_SQL = r"""
WITH w AS (
  SELECT doc_id, list_append(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+'), NULL) AS w FROM documents
), t AS (SELECT doc_id, unnest(w) AS token FROM w
), c AS (SELECT token, count(*) AS c FROM t GROUP BY token
), n AS (SELECT sum(c) AS n, count(*) AS v FROM c)
SELECT doc_id, count(*) AS n_tokens, count(*) AS n_known, CAST(any_value(n.n) AS BIGINT) AS train_tokens, round(sum(log10((c.c + 1) / (n.n + 1 * (n.v + 1)))), 4) AS base_score
FROM t JOIN c ON t.token IS NOT DISTINCT FROM c.token, n GROUP BY doc_id
"""


QUERIES = {f.__name__: f for f in (op1_chat_format, op2_best_fit_packing, op3_warc, op4_toxicity, op5_near_dedup, op6_url_filter, op7_ogg_media, op8_lm_score, op9_line_dedup, op10_decontaminate, media_payloads, lm_base_scores)}
ORACLES = {"op1_chat_format": OP1_SQL, "op3_warc": OP3_SQL, "op5_near_dedup": OP5_SQL, "op6_url_filter": OP6_SQL, "op9_line_dedup": OP9_SQL, "op10_decontaminate": OP10_SQL, "media_payloads": MEDIA_SQL, "lm_base_scores": LM_SQL}
