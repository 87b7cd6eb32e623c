"""A corpus pipeline of five stages: language ID, exact dedup, SimHash near-dedup, source mixing, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of
``documents``. ``run`` writes each stage's result as Parquet to the shared folder and reads it again.
Rows travel in a struct, so further columns may have any names; empty tables give empty results.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimloom.llm import exact_dedup, language_id, mixing, packing, simhash
from claimloom.llm.common import materialise

#: A document goes if it has no letters, or if less than this share of its letters is in its main language.
LEAST_SCORE = 0.4

ORACLE_SQL = None  # tokenizers and XXH64 are out of SQL's reach; tests hold run() against brute force


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language; the others get the predicted one where ``lang`` is null.

    Null and empty texts, and texts without letters, go; very long texts are read whole; repeated rows and
    rows with null ids are judged one by one; a tie between languages is the earlier one's.
    """
    model = language_id.fit(docs.filter(~language_id.held_out()))
    found = language_id.predict(docs, model, keep=docs.columns)
    kept = found.filter((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE))
    return kept.select(*(F.coalesce(F.col("row.lang"), F.col("lang_pred")).alias("lang") if c == "lang" else F.col("row").getField(c).alias(c) for c in docs.columns))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts one row of the smallest id stays.

    Null counts as empty, a null id as the smallest; of repeated rows just one stays; very long texts are hashed whole.
    """
    return exact_dedup.exact_groups(docs, keep=docs.columns).filter("kept").select("row.*")


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by a 5-word shingle Jaccard of 0.8 or more, one of the smallest id stays.

    Null texts and texts without words are one group; very long texts are compared whole; of repeated rows, and
    of ties in the id, just one stays; a null id stays only where the group has no other.
    """
    return simhash.similar_groups(docs, words=5, percent=80, keep=docs.columns).filter("kept").select("row.*")


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as many times as the mix takes it.

    Null and empty texts have no words but count as rows of their source, so some stay; null sources are one
    source; repeated rows are taken one by one, and of rows equal in id and size a hash of the row decides.
    """
    copies = mixing.mix(docs, keep=docs.columns).filter("copies > 0")
    return copies.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int")))).select("row.*")


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mix as sequences of 1024 tokens; null and empty texts are one end token; repeated rows are pieces of their own."""
    return packing.pack_documents(docs)


STAGES = [
    ("language_id", identify_languages),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_sources),
    ("packing", pack_sequences),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return docs
