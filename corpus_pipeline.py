"""A training corpus from raw documents: five stages, each written as Parquet and read again.

1. documents that the toxicity model rejects go,
2. one document of each SimHash group stays,
3. documents contaminated by the benchmark go,
4. sources are mixed to their target weights (a document taken twice is two rows),
5. the mix is encoded into token files, and their digests are the result.

Any column may be null: a null text is empty (not toxic by its words, of
fingerprint zero, of no benchmark words, of size 0, one end id), a null source is
a source, and rows without an id are rows like others.  Of wordless documents
one stays, as their fingerprints are equal; of equal rows one stays.  Further
columns pass the first four stages, whatever their names.  An empty table gives
an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from somaflow.llm import op1_mixing, op2_tokens, op3_decontamination, op4_simhash, op10_toxicity
from somaflow.llm.shared import new_folder, remove, scratch


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return op10_toxicity.clean_documents(docs, op10_toxicity.fit(docs, labels))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op4_simhash.deduplicated(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op3_decontamination.clean_documents(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op1_mixing.mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return op2_tokens.encode_documents(docs)


STAGES = [
    ("toxicity", toxicity),
    ("simhash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing", mixing),
    ("token output", tokens),
]

#: A trained classifier and 64-bit XXH64 fingerprints have no DuckDB form; the tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table.

    A stage's table, and what it wrote on the way, are deleted when the next
    one's has been written; those of the last are left for the caller.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for k, (_, stage) in enumerate(STAGES[:-1]):
        path = new_folder(spark, f"stage{k + 1}")
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        remove(spark, before)
        docs, before = spark.read.parquet(path), [path]
    return STAGES[-1][1](spark, docs, sf_dir)
