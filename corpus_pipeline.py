"""A training corpus from ``documents``: filter, dedup, decontaminate, mix, store as token ids.

Each stage works on all rows its predecessor kept and returns the columns of
``documents``; the last writes a token store and returns its documents. Other columns
are dropped by each stage, whatever their names; very long texts are read whole; a stage
gives no rows for an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from eigenloom.llm import decontam, mixing, simhash, token_store, toxicity
from eigenloom.llm.queries import table, tokenizer_path
from eigenloom.session import delete_at_exit, materialise, new_table_path, release

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score 0.7 or more go; null, empty and unlabelled ones are scored like any, repeated rows alike."""
    return toxicity.drop_toxic(docs.select(COLUMNS), table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each SimHash component stays, that of the smallest id (null ids last, ties by content, of rows alike one); null, empty and wordless texts are one component."""
    return simhash.drop_near_duplicates(docs.select(COLUMNS))


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go; null and empty texts hold none, repeated rows and ids are judged by their texts; without a benchmark all stay."""
    return decontam.drop_contaminated(docs.select(COLUMNS), table(spark, sf_dir, "benchmark"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are mixed by weight: a row for each copy that the mix takes; a null source is one, null and wordless texts stay once, repeated rows each count, ties of the key go by id and size."""
    return mixing.mixed_documents(docs.select(COLUMNS))


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The corpus as a token store, read back: a row a document of the mix, in ascending id; a null or empty text is its end mark alone, null and repeated ids keep a row each."""
    store = new_table_path(spark, "token-store")
    token_store.write_store(docs.select(COLUMNS), store, tokenizer_path())
    delete_at_exit(spark, store)
    return token_store.read_documents(spark, store)


STAGES = [
    ("toxicity", toxicity_stage),
    ("near_dedup", near_dedup_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_store", token_stage),
]
#: Tokenizers and models are beyond SQL; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        before, docs = docs, materialise(stage(spark, docs, sf_dir), f"pipeline-{name}")
        release(before)  # does nothing to the documents themselves
    result = STAGES[-1][1](spark, docs, sf_dir)  # has written its store
    release(docs)
    return result
