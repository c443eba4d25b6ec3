"""From raw documents to packed token ids: five stages, each written as Parquet and read again.

quality: documents that the classifier rejects go (labels that are held out elsewhere aren't used here either).
near_duplicates: one row of each group of near copies stays, the one of least id.
decontaminate: documents that hold a window of the benchmark go.
mix: each source is repeated or cut to its target by blocks of words; a row is a stretch of a document's words that the mix deals to one
shard, in each epoch, a whole document where all of its blocks go to one. doc_id stays that of the source document.
tokens: what is left, in packed rows of token ids.

All stages but the last return the columns of documents, extra columns included, and work on every row
and every whole text of what they get. Empty tables pass through all stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from cairn.llm.common import materialize, read
from cairn.llm.decontaminate import decontaminate
from cairn.llm.mixing import mix_documents
from cairn.llm.ngram_join import keep_one_of_each
from cairn.llm.packing import pack_tokens
from cairn.llm.quality import reject_low_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return reject_low_quality(docs, read(spark, sf_dir, "labels", "doc_id", "quality"), training_docs=read(spark, sf_dir, "documents", "doc_id", "text"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_one_of_each(docs)


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate(docs, read(spark, sf_dir, "benchmark", "item_id", "text"))


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mix_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_tokens(docs)


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontaminate", decontaminated), ("mix", mix), ("tokens", tokens)]
#: A fitted model and a tokenizer are no SQL; the stages are tested against brute force instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; every stage's result is a written table."""
    docs = read(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
