"""Operator 4: token counts behind a digest cache.

The cache is a Parquet table (tokenizer, content, n_bytes, n_tokens) in shared
storage: SHA-256 of the tokenizer file, SHA-256 of the normalised content (a
null text is an empty one; nothing else may change, or counts would), and the
counts. A call joins documents to it by both digests, encodes every distinct
missing content once, appends those, and reads all counts from the cache.

The cache is asked with digests alone. Texts move only if it lacks them: up to
``MISS_ROWS`` missing contents are broadcast to the documents; beyond that the texts
are joined by shuffling. Copies are folded into one content before they are shuffled
by digest, so a text that a third of all rows have is moved once a task and encoded
once. Appending is a Spark write: a lost executor's part is written again, and a
failed job leaves nothing behind. Writers at one time may append a content twice;
reading folds it.

Defined results
    null text: 0 bytes, 0 tokens; null or repeated ``doc_id`` and repeated rows:
    a row each; very long texts are encoded whole; other columns are not read; empty
    table: no rows, nothing appended.
"""

from __future__ import annotations

from typing import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eigenloom.llm.encoder import encoder, file_digest
from eigenloom.llm.text import body
from eigenloom.session import materialise, path_exists, text_batches

CACHE_SCHEMA = "tokenizer string, content binary, n_bytes long, n_tokens long"
OVER = 512
#: Missing contents (32 bytes each) up to which they are broadcast.
MISS_ROWS = 1_000_000


def content_digest(text):
    """SHA-256 of the normalised content, as 32 bytes."""
    return F.unhex(F.sha2(body(text), 256))


def cached_counts(spark, cache: str, version: str) -> DataFrame:
    """(content, n_bytes, n_tokens) that the cache has for a tokenizer version."""
    if not path_exists(spark, cache):
        return spark.createDataFrame([], "content binary, n_bytes long, n_tokens long")
    kept = spark.read.schema(CACHE_SCHEMA).parquet(cache).filter(F.col("tokenizer") == version)
    return kept.groupBy("content").agg(F.min("n_bytes").alias("n_bytes"), F.min("n_tokens").alias("n_tokens"))


def _counter(path: str):
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = encoder(path).encode
        for batch in batches:
            texts = batch["text"].tolist()
            yield pd.DataFrame({"content": batch["content"], "n_bytes": [len(t.encode()) for t in texts], "n_tokens": [len(ids) for ids in encode(texts)]})

    return count


def fill_cache(docs: DataFrame, cache: str, tokenizer: str, *, text_col: str = "text", miss_rows: int = MISS_ROWS) -> None:
    """Encode what the cache lacks of ``docs``' contents and append it."""
    spark, version = docs.sparkSession, file_digest(tokenizer)
    text_batches(spark)
    texts = docs.select(content_digest(text_col).alias("content"), body(text_col).alias("text"))
    if path_exists(spark, cache):
        missing = texts.select("content").distinct().join(cached_counts(spark, cache, version), "content", "left_anti")
        missing = materialise(missing, "token-misses")
        n = missing.count()
        if n == 0:
            return
        texts = texts.join(F.broadcast(missing) if n <= miss_rows else missing, "content", "left_semi")
    misses = texts.groupBy("content").agg(F.first("text").alias("text"))
    counted = misses.mapInPandas(_counter(tokenizer), "content binary, n_bytes long, n_tokens long")
    counted.select(F.lit(version).alias("tokenizer"), "content", "n_bytes", "n_tokens").write.mode("append").partitionBy("tokenizer").parquet(cache)


def token_counts(docs: DataFrame, cache: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", over: int = OVER) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every document, through the cache at ``cache``."""
    fill_cache(docs, cache, tokenizer, text_col=text_col)
    known = cached_counts(docs.sparkSession, cache, file_digest(tokenizer))
    rows = docs.select(F.col(f"`{id_col}`").alias("doc_id"), content_digest(text_col).alias("content"))
    return rows.join(known, "content").select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > over).alias("over_limit"))
