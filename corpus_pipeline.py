"""A corpus from raw documents to token files.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and
its result, written as Parquet, is the next one's ``docs``.  All but the last
return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import decontaminate, jaccard_join, language_crf, mixing, token_files
from quarry.llm.registry import END_ID, vocabulary
from quarry.session import materialize, read_table

#: A document whose words' labels are less certain on average is rejected.
MIN_SCORE = 0.5


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter or with uncertain word labels go; a document
    in several languages stays when its words are clear."""
    model = language_crf.train(docs)
    out = language_crf.predict(docs, model, keep=docs.columns)
    return out.where((F.col("lang_pred") != language_crf.UNKNOWN) & (F.col("sure") >= MIN_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate group stays."""
    return jaccard_join.one_of_each(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark passage go."""
    out = decontaminate.scan(docs, read_table(spark, sf_dir, "benchmark"), keep=docs.columns)
    return out.where("n_hit = 0").select("row.*")


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources to their target weights; a document appears once per repetition."""
    rows = mixing.sized(docs, docs.columns)
    out = mixing.mix(rows, mixing.targets(rows))
    return out.where("copies > 0").select(F.explode(F.array_repeat("row", F.col("copies"))).alias("row")).select("row.*")


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token files, read back: per document its place, length and checksum."""
    return token_files.read_digests(token_files.write_files(docs, vocabulary(), END_ID))


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("source_mix", source_mix),
    ("token_output", token_output),
]

#: The learned and coded stages cannot be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return docs
