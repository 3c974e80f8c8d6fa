"""Preparation of a training corpus: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and gives the rows it keeps with the columns of ``documents``; the
last gives token ids in place of texts. Nulls, repeated rows and empty tables are handled as
the operators' docstrings say.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from salescope.llm.common import unused
from salescope.llm.contamination import contamination
from salescope.llm.jaccard import similar_groups
from salescope.llm.lines import dedup_lines
from salescope.llm.pieces import encode_texts
from salescope.llm.queries import MODEL, training_labels
from salescope.llm.toxicity import fit_toxicity, score_toxicity
from salescope.session import scratch_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity classifier does not reject."""
    model = fit_toxicity(docs, training_labels(spark, sf_dir))
    return score_toxicity(docs, model).where("predicted = 0").select(COLUMNS)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, their texts without lines that many documents share; ``n_chars`` follows the text."""
    return dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def keep_one_of_similar(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of similar documents the one with the smallest doc_id.

    Documents are similar from 80 per cent of their five-word shingles on, not by op6's own measure. Every row is a
    document of its own, also where an id is repeated: it goes only if it resembles one that stays. Rows are named by a
    64-bit hash of doc_id and text; of rows equal in both one stays. Texts without words and rows with a null
    doc_id are in no group and stay.
    """
    row, group, least = unused(docs, "row", "id_", "least")
    named = docs.where("doc_id IS NOT NULL").withColumn(row, F.xxhash64("doc_id", F.coalesce("text", F.lit(""))))
    groups = similar_groups(named.select(F.col(row).alias("doc_id"), "text"), shingle=5, share=80)
    placed = groups.select(F.col("doc_id").alias(row), F.col("component_id").alias(group)).distinct()
    stays = named.select("doc_id", row).join(placed, row).groupBy(group).agg(F.min(F.struct("doc_id", row)).alias(least))
    chosen = named.join(stays.select(F.col(f"{least}.{row}").alias(row)), row, "left_semi").dropDuplicates([row])
    return chosen.select(COLUMNS).unionByName(docs.where("doc_id IS NULL").select(COLUMNS))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in benchmark windows."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return contamination(docs, benchmark).where("NOT contaminated").select(COLUMNS)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document in place of its text, with the digests of ids and decoded text."""
    return encode_texts(docs.select(COLUMNS), MODEL)


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("n-gram Jaccard join", keep_one_of_similar),
    ("benchmark decontamination", drop_contaminated),
    ("SentencePiece encoding and decoding", tokenize),
]

# The classifier and the token ids are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each keeps is written to the shared folder for the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for number, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES) - 1:
            path = scratch_path(spark, f"stage-{number}")
            docs.write.parquet(path)
            docs = spark.read.parquet(path)
    return docs
