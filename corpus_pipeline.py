"""A training corpus from the table of documents, in five stages.

Each stage takes what its predecessor kept. All but the last return the
columns of documents; the last returns token ids.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidegrid.llm import bpe, langid, mixing, near_copies, quality
from tidegrid.llm.common import cut, drop, so_far, table

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that is known; those the model rejects go."""
    return langid.identify(docs, langid.fit(docs)).where("not rejected").select(*docs.columns)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep."""
    return quality.judge(docs).where("kept").select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles of Jaccard similarity 0.8 or more."""
    return near_copies.one_of_each(docs, words=5, least=0.8)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the sources' target weights take them; a source's last one may be cut."""
    mixed = mixing.mixed_documents(docs)
    return mixed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else mixed


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Ids of each document, decoded again as proof."""
    coded = bpe.encode_decode(docs.select("doc_id", "source", "text"), VOCABULARY, public_tokenizers.PATTERN)
    return coded.select("doc_id", "source", F.size("ids").cast("long").alias("n_tokens"), "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [("language ID", language), ("quality rules", rules), ("SimHash near-dedup", near_duplicates), ("source mixing", mixture), ("byte-level BPE", tokens)]

#: Language ID, hashes and BPE are beyond SQL; tests hold the stages against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each stage's rows written and read again."""
    docs = table(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        begin = so_far()
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs, "stage")
            drop(spark, max(0, begin - (i > 0)), 1)  # what the stage wrote and read
    return docs
