"""Operator 8: SimHash near-dedup by a byte-position inverted index.

A fingerprint is 64 bits, eight positional bytes. Two that differ in at most two
bits share at least six of the eight, whichever they are. The index lists
fingerprints under every choice of five positions with their bytes (56 lists each).
A pair that shares six bytes meets in at least six lists, one that shares five in
one only: the lists in which a pair meets are tallied, pairs below the guaranteed
minimum of six are dropped, and the others verified by their differing bits. Lists
of single bytes would hold a 256th of all fingerprints each, and their pairs would
grow with the square of the input; a list of five bytes has one of 2^40 values, so
it stays short at any size.

A list longer than ``PAIR_LIST`` is never paired: its members differ within three
bytes only, so each is entered under itself and its 24 one-bit neighbours there;
members that share such an entry are at most two bits apart, an entry has at most 25
of them, and each is linked to the entry's smallest. Two fingerprints within two bits
always share an entry, so though links are left out, no connection is. A pair within
two bits either meets in such a list, or all lists in which it meets are paired and
its tally is whole.

Work is done on distinct fingerprints; copies are counted, never paired.

Defined results
    null or wordless text: fingerprint zero, linked like any other; fewer words
    than a shingle: the whole sequence is hashed; null ``doc_id``: the row is
    kept, and ids of a component are compared without it (all null: null);
    repeated rows: each keeps its row; very long texts are read whole; the keeper of
    a component is decided by id, then content hash; other columns, whatever their
    names, are kept by ``drop_near_duplicates`` and not read; empty table: no rows.
"""

from __future__ import annotations

from itertools import combinations
from math import comb
from typing import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from eigenloom.llm.components import connected_components
from eigenloom.llm.text import body
from eigenloom.session import free_name, join_checked, materialise, text_batches

SHINGLE_WORDS = 3
HASH_SEED = 42
MAX_BITS = 2
#: Positions that a pair within MAX_BITS differing bits surely shares.
MIN_SHARED_BYTES = 8 - MAX_BITS
#: Positions by which fingerprints are listed, and lists in which such a pair surely meets.
LIST_BYTES = 5
MIN_LISTS = comb(MIN_SHARED_BYTES, LIST_BYTES)
#: Lists up to this length are paired, longer ones go by one-bit neighbours.
PAIR_LIST = 32
#: Shingles whose bits are counted at once; bounds memory on long texts.
BLOCK = 1 << 15
_LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def fingerprint(text: str | None, shingle: int = SHINGLE_WORDS) -> int:
    """The SimHash of one text as a signed 64-bit integer."""
    parts = (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()  # bytes.split: ASCII white space
    if not parts:
        return 0
    joined = b" ".join(parts)
    digest = xxhash.xxh64_intdigest
    if len(parts) < shingle:
        return int(np.uint64(digest(joined, HASH_SEED)).view(np.int64))
    lengths = np.fromiter(map(len, parts), np.int64, len(parts))
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: len(parts) - shingle + 1].tolist()
    ends = ends[shingle - 1 :].tolist()
    ones = np.zeros(64, np.int64)
    for at in range(0, len(starts), BLOCK):
        block = [digest(joined[i:j], HASH_SEED) for i, j in zip(starts[at : at + BLOCK], ends[at : at + BLOCK], strict=True)]
        bits = np.unpackbits(np.array(block, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        ones += bits.sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(starts), bitorder="little").view("<i8")[0])


@F.pandas_udf(LongType())
def simhash(texts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Fingerprints of a column of texts."""
    for batch in texts:
        yield pd.Series([fingerprint(t) for t in batch], dtype="int64")


def _choices() -> list[tuple[int, ...]]:
    return list(combinations(range(8), LIST_BYTES))


def _mask(positions: tuple[int, ...]) -> int:
    value = sum(0xFF << 8 * p for p in positions)
    return value - (1 << 64) if value >> 63 else value


def postings(fps: DataFrame) -> DataFrame:
    """(choice, bytes, fp): every distinct fingerprint under each choice of positional bytes."""
    lists = F.array(*[F.struct(F.lit(k).alias("choice"), F.col("fp").bitwiseAND(F.lit(_mask(c))).alias("bytes")) for k, c in enumerate(_choices())])
    return fps.select("fp", F.explode(lists).alias("entry")).select("entry.choice", "entry.bytes", "fp")


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b), a < b, between the distinct fingerprints ``fps`` (fp).

    All links of pairs that meet in short lists only; of long lists enough verified
    links to keep every linked pair connected.
    """
    listed = postings(fps)
    sizes = materialise(listed.groupBy("choice", "bytes").agg(F.count("*").alias("n")).filter("n > 1"), "simhash-lists")
    short = listed.join(sizes.filter(F.col("n") <= PAIR_LIST), ["choice", "bytes"])
    grouped = short.groupBy("choice", "bytes").agg(F.sort_array(F.collect_list("fp")).alias("fps"))
    pairs = grouped.select("fps", F.posexplode("fps").alias("at", "a")).select("a", F.explode(F.slice("fps", F.col("at") + 2, F.size("fps"))).alias("b"))
    found = pairs.groupBy("a", "b").agg(F.count("*").alias("lists")).filter(F.col("lists") >= MIN_LISTS).select("a", "b")
    long = listed.join(sizes.filter(F.col("n") > PAIR_LIST), ["choice", "bytes"]).select("choice", "bytes", "fp")
    free = [[8 * p + bit for p in range(8) if p not in c for bit in range(8)] for c in _choices()]
    flips = F.array(*[F.array(F.lit(0).cast("long"), *[F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in bits]) for bits in free])
    entered = long.withColumn("flip", F.explode(F.element_at(flips, F.col("choice") + 1))).select("choice", F.col("fp").bitwiseXOR(F.col("flip")).alias("entry"), "fp")
    stars = entered.groupBy("choice", "entry").agg(F.sort_array(F.collect_list("fp")).alias("fps")).filter(F.size("fps") > 1)
    spokes = stars.select(F.element_at("fps", 1).alias("a"), F.explode(F.slice("fps", F.lit(2), F.size("fps"))).alias("b"))
    verified = found.unionByName(spokes).filter(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= MAX_BITS)
    return verified.distinct()


def fingerprint_components(fps: DataFrame) -> DataFrame:
    """(fp, root): the smallest fingerprint that each of the distinct ``fps`` is connected to."""
    labels = connected_components(links(fps))
    return fps.join(labels, fps["fp"] == labels["node"], "left").select("fp", F.coalesce("label", "fp").alias("root"))


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, text_hash, fp, component_id, keeper_id, keeper_hash).

    ``component_id`` is the smallest ``doc_id`` reachable over links of at most
    two bits; the keeper is the row that stands for the component: of its
    smallest id, that with the smallest content hash.
    """
    text_batches(docs.sparkSession)
    rows = materialise(
        docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(body(text_col)).alias("text_hash"), simhash(F.col(text_col)).alias("fp")),
        "simhash-rows",
    )
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_hash"))
    distinct = materialise(rows.groupBy("fp").agg(first.alias("first")), "simhash-distinct")
    roots = fingerprint_components(distinct.select("fp")).join(distinct, "fp")
    roots = materialise(roots, "simhash-roots")
    heads = materialise(roots.groupBy("root").agg(F.min("first").alias("head")), "simhash-heads")
    members = materialise(
        roots.join(heads, "root").select("fp", F.col("head.doc_id").alias("component_id"), F.col("head.text_hash").alias("keeper_hash")),
        "simhash-members",
    )
    return rows.join(members, "fp").select("doc_id", "text_hash", "fp", "component_id", F.col("component_id").alias("keeper_id"), "keeper_hash")


def drop_near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with one document of each component left.

    Rows are found again by id and content hash; of rows alike in both one stays.
    Texts are shuffled only if more rows go than may be broadcast.
    """
    judged = near_duplicates(docs, id_col=id_col, text_col=text_col)
    keeps = F.col("doc_id").eqNullSafe(F.col("keeper_id")) & (F.col("text_hash") == F.col("keeper_hash"))
    rows = materialise(judged.groupBy("doc_id", "text_hash").agg(F.max(keeps).alias("keeps"), F.count("*").alias("n")), "simhash-judged")
    own_id, own_hash = free_name(docs, "own_id"), free_name(docs, "own_hash")
    hashed = docs.withColumns({own_id: F.col(f"`{id_col}`"), own_hash: F.xxhash64(body(text_col))})
    gone = rows.filter("NOT keeps")
    left = join_checked(hashed, gone, hashed[own_id].eqNullSafe(gone["doc_id"]) & (hashed[own_hash] == gone["text_hash"]), "left_anti")
    if not rows.filter("keeps AND n > 1").isEmpty():  # rows alike in id and text
        left = left.dropDuplicates([own_id, own_hash])
    return left.drop(own_id, own_hash)
