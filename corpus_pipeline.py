"""A training corpus from ``documents``: five stages, each a DataFrame to a DataFrame.

Every stage is written as Parquet and read again as the next one's documents, so a
lost executor costs at most the stage at hand. Stages before the last return the
columns of documents. Python workers get batches of bounded bytes in all stages: the
setting stays in the session, since whoever writes a stage's result runs its plan.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marts.llm import decontaminate, exact_dedup, jaccard_join, language_id, packing
from marts.llm.queries import vocabulary
from marts.llm.workers import bound_batches
from marts.session import new_folder


#: Score under which a text resembles none of the languages.
LEAST_SCORE = 0.2


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a language is known; those without a letter or like no profile go."""
    bound_batches(spark)
    profiles = language_id.language_profiles(docs)
    found = language_id.identify(docs, profiles)
    known = (F.col("lang_pred") != language_id.UNKNOWN) & (F.col("score") >= LEAST_SCORE)
    return found.where(known).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the document with the greatest id."""
    return exact_dedup.drop_copies(spark, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of connected near copies, the document with the least id."""
    bound_batches(spark)
    return jaccard_join.drop_near_copies(spark, docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that contain no benchmark item."""
    bound_batches(spark)
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.mark_leaks(docs, items).where(F.size("leaks") == 0).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of 2048 ids, neighbours on the curve together."""
    bound_batches(spark)
    return packing.pack(spark, docs, vocabulary())


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("jaccard_join", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: Language identification and packing cannot be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        folder = new_folder(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
