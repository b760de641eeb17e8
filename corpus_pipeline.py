"""A corpus pipeline: toxicity, line dedup, near dedup, benchmark decontamination, best-fit packing.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
Extra columns, whatever their names, are kept by all stages but the last. An empty table
gives an empty one. Texts of any length are read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veldt.llm import decontaminate, line_dedup, near_dedup, packing, queries, toxicity
from veldt.llm._store import materialize, shielded, table


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a toxicity score of 0.5 or more go.

    Null and empty texts have the prior's score, which is below 0.5, and stay; rows that
    repeat, and ties at one score, are judged alike; rows without an id are scored but never
    learnt from.
    """
    model = queries.toxicity_model(spark, sf_dir, docs)
    docs, restored = shielded(docs, "score")
    return restored(toxicity.score(docs, model).where("score < 0.5"))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in the first (the smallest id); n_chars follows the text.

    A null text is one empty line and becomes empty; empty texts stay. Rows that repeat an id
    are one document; rows without an id keep all lines. No document goes, though one whose
    lines all stand elsewhere becomes empty.
    """
    docs, restored = shielded(docs, "n_lines", "n_dropped")
    return restored(line_dedup.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays, that with the smallest id.

    Null and empty texts, and those without words, are near nothing and stay. Rows that repeat
    an id are one document and stay or go together; rows without an id stay.
    """
    return near_dedup.drop_near_duplicates(docs).select(*docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go.

    Null and empty texts hold none and stay; rows that repeat are judged alike, those without
    an id too. Benchmark items without words, or null, hit nothing.
    """
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of what is left, packed into sequences of 4096 tokens.

    A null or empty text is one piece, its end id. Rows that repeat give pieces of their own,
    those without an id pieces with a null doc_id. Other columns are dropped.
    """
    return packing.pack(packing.token_pieces(docs, queries.tokenizer_path()))


STAGES = [("toxicity", drop_toxic), ("line_dedup", drop_repeated_lines), ("near_dedup", drop_near_duplicates), ("decontaminate", drop_contaminated), ("pack", pack_sequences)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written as Parquet and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
