"""A training-data pipeline over ``documents``, one operator per stage.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which is
written as Parquet and read again as the next stage's ``docs``.  All stages but
the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from qcorpus.llm.ngram_jaccard import drop_linked
from qcorpus.llm.quality_rules import drop_rejected
from qcorpus.llm.queries import TOKENIZER
from qcorpus.llm.scratch import keep_batches_small, stored
from qcorpus.llm.sentence_spans import remove_repeated_passages
from qcorpus.llm.sentencepiece_codec import encode_texts
from qcorpus.llm.source_mixing import mix_sources
from qcorpus.session import table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return drop_rejected(docs).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of the n-gram Jaccard join."""
    return drop_linked(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without repeated passages; documents with nothing left go."""
    keep_batches_small(spark)
    cleaned = remove_repeated_passages(docs).where("n_removed = 0 or n_removed < n_sentences")
    return _measured(cleaned, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per pass of the mix over a document, with the words it takes."""
    rows = mix_sources(docs).withColumn("part", F.explode("parts"))
    some = F.array_join(F.slice(F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0)),
                                F.col("part.first").cast("int") + 1, F.col("part.words").cast("int")), " ")
    whole = (F.col("part.first") == 0) & (F.col("part.words") == F.col("size"))
    return _measured(rows.withColumn("text", F.when(whole, F.col("text")).otherwise(some)), docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their token ids."""
    keep_batches_small(spark)
    return encode_texts(docs, TOKENIZER)


def _measured(changed: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, n_chars counted anew."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [("quality_rules", quality), ("ngram_jaccard", near_duplicates), ("sentence_spans", repeated_passages),
          ("source_mixing", mix), ("sentencepiece", encode)]

#: SQL cannot express the n-gram join's and the encoder's stages; tests compare with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stored(docs, name)
    return docs
