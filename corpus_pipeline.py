"""A training corpus from raw documents: five stages, each an operator of tallywood.llm.

Each stage takes (spark, docs, sf_dir) and works on all that the one before kept; its result is written
as Parquet and read again as the docs of the next. All but the last return the columns of documents.

Every stage takes whole texts of any length. A null or empty text goes in the first stage, since it has no
letter; an empty table gives an empty one; repeated rows are treated alike until near_dedup, where one of
them stays; ties there go to the smallest doc_id. A null doc_id is a document of its own. Columns besides
those of documents pass through all stages but the last, whatever their names, unless they are called
lang_pred, score, other, n_lines or n_deleted, which the operators replace.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallywood.llm import bpe, decontaminate, lang_id, line_dedup, simhash
from tallywood.llm.common import staged

#: A document goes if the network gives this share of it or more to none of the languages, however many there are.
MOST_OTHER = 0.9


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that have no letter, and those that the network gives to none of the learned languages."""
    found = lang_id.identify(docs, lang_id.fit(docs))
    return found.filter((F.col("lang_pred") != "und") & (F.col("other") < MOST_OTHER)).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later runs of lines of 50 words or more are deleted; documents go that have no word left."""
    found = line_dedup.line_dedup(docs, min_words=50)
    left = (F.col("n_deleted") == 0) | F.col("text").rlike(r"[^\x20\x09-\x0D]")
    return found.filter(left).withColumn("n_chars", F.length("text").cast("long")).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a five-word Jaccard similarity of 0.8 or more that with the smallest doc_id stays.

    Rows that share that doc_id are one document: the one whose text has the smallest hash stays.
    """
    return simhash.firsts(docs, simhash.similar_components(docs)).select(*docs.columns)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents go that hold a test item."""
    return decontaminate.decontaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of every text, and whether they decode to its bytes."""
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    back = bpe.bpe_round_trip(docs.select("doc_id", "lang", "source", "text"), path, public_tokenizers.PATTERN)
    same = F.col("decoded") == F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    return back.select("doc_id", "lang", "source", F.size("token_ids").cast("long").alias("n_tokens"), "token_ids", same.alias("round_trip"))


STAGES = [("language_id", language_id), ("line_dedup", dedup_lines), ("near_dedup", near_dedup), ("decontamination", decontamination), ("bpe", tokens)]

#: The network of the first stage can't be expressed in SQL; tests/llm/test_pipeline.py has a brute-force version of the rest.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = staged(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
