"""A corpus pipeline over the table documents: toxicity, SimHash near-dedup, PII, source mixing,
best-fit packing. Every stage works on all rows that its predecessor kept; all but the last
return the columns of documents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from bibspark.llm import jaccard, mixing, packing, pii, simhash, toxicity
from bibspark.llm.common import materialize


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity grammar, fitted on the labelled ones, does not reject."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.accept(docs, model)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component, that of the smallest doc_id. Linked are texts whose SimHash
    fingerprints differ in at most 2 bits, and those of 5-word Jaccard similarity 0.8 or more, few of
    which are within 2 bits."""
    return simhash.keep_first(docs, jaccard.with_fingerprints(docs))


def replace_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with surrogates for personal data."""
    return pii.replace_texts(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    return mixing.mix_documents(docs)


def pack_bins(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents and their bins."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("pii", replace_pii),
    ("source_mixing", mix_sources),
    ("best_fit_packing", pack_bins),
]

#: The learned, keyed and sequential stages have no SQL form; see tests/llm/test_pipeline.py.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; each result is written to the shared folder and read back by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
