"""Operator 5: a token store with Elias-Fano document boundaries.

The store is a Parquet table, so it can be in any storage that Spark reaches
and inherits Spark's commit protocol. A row is a chunk: the ids of consecutive
documents as one little-endian array (two bytes an id if the vocabulary allows,
else four), the documents' end offsets and their ids as Elias-Fano sequences,
and where the chunk begins within its part. Documents are ranged by ``doc_id``;
part numbers, then chunk numbers, give their ascending order. A chunk holds
whole documents up to about ``CHUNK_IDS`` ids; a longer document is a chunk of
its own.

An Elias-Fano sequence of n numbers below u takes about 2 + log2(u / n) bits a
number: the low bits packed, the high bits as gaps in a bit vector. Positions of
every 64th one bit are kept, so ``select`` reads one number near one sample; no
64-bit offset table exists. A part's first offset is the sum of the parts before
it, one small number for each write task.

Defined results
    null text: no ids but the end id; null ``doc_id``: documents of their own
    chunks before all others, in the order of their content's hash; a repeated
    ``doc_id``: each row is a document, neighbours in that same order; a very long
    text is a chunk of its own, which must fit a binary value (2 GB, a thousand million
    ids of two bytes); empty table: an empty store. Other columns are not stored.
"""

from __future__ import annotations

import struct
import zlib
from dataclasses import dataclass
from typing import Iterator

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from eigenloom.llm.encoder import encoder
from eigenloom.llm.text import body
from eigenloom.session import join_checked, planned_partitions, text_batches

END_ID = 2
CHUNK_IDS = 1 << 18
SAMPLE = 64
STORE_SCHEMA = "part int, chunk int, part_start long, n_docs long, n_ids long, has_ids boolean, first_doc long, width int, ids binary, ends binary, doc_ids binary"
_HEAD = struct.Struct("<4sQQB")


@dataclass(frozen=True)
class EliasFano:
    """A non-decreasing sequence of whole numbers below ``universe``, near its least size."""

    n: int
    universe: int
    low_bits: int
    low: np.ndarray
    high: np.ndarray
    samples: np.ndarray

    @classmethod
    def encode(cls, values: np.ndarray, universe: int) -> EliasFano:
        values = np.asarray(values, np.uint64)
        n = len(values)
        low_bits = max(0, (universe // n).bit_length() - 1) if n else universe.bit_length()
        upper = (values >> np.uint64(low_bits)).astype(np.int64)
        ones = upper + np.arange(n)
        high = np.zeros((universe >> low_bits) + n + 1, np.uint8)
        high[ones] = 1
        shifts = np.arange(low_bits, dtype=np.uint64)
        low = ((values[:, None] >> shifts) & np.uint64(1)).astype(np.uint8).ravel()
        return cls(n, universe, low_bits, np.packbits(low, bitorder="little"), np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def __len__(self) -> int:
        return self.n

    def _low(self, i: int) -> int:
        at = i * self.low_bits
        some = int.from_bytes(self.low[at >> 3 : (at + self.low_bits + 7) >> 3].tobytes(), "little")
        return (some >> (at & 7)) & ((1 << self.low_bits) - 1)

    def select(self, i: int) -> int:
        """The i-th number, read from the sample before it."""
        if not 0 <= i < self.n:
            raise IndexError(i)
        at, left = int(self.samples[i // SAMPLE]), i % SAMPLE
        byte = at >> 3
        word = int(self.high[byte]) >> (at & 7) << (at & 7)
        while (ones := word.bit_count()) <= left:
            left -= ones
            byte += 1
            word = int(self.high[byte])
        for _ in range(left):
            word &= word - 1
        position = 8 * byte + (word & -word).bit_length() - 1
        return ((position - i) << self.low_bits) | self._low(i)

    def values(self) -> np.ndarray:
        """All numbers at once."""
        ones = np.flatnonzero(np.unpackbits(self.high, bitorder="little"))[: self.n].astype(np.uint64)
        upper = ones - np.arange(self.n, dtype=np.uint64)
        bits = np.unpackbits(self.low, bitorder="little")[: self.n * self.low_bits].reshape(self.n, self.low_bits).astype(np.uint64)
        low = (bits << np.arange(self.low_bits, dtype=np.uint64)).sum(axis=1, dtype=np.uint64)
        return (upper << np.uint64(self.low_bits)) | low

    def to_bytes(self) -> bytes:
        head = _HEAD.pack(b"EF01", self.n, self.universe, self.low_bits)
        return head + struct.pack("<QQ", len(self.low), len(self.high)) + self.low.tobytes() + self.high.tobytes() + self.samples.tobytes()

    @classmethod
    def from_bytes(cls, data: bytes) -> EliasFano:
        magic, n, universe, low_bits = _HEAD.unpack_from(data)
        if magic != b"EF01":
            raise ValueError("not an Elias-Fano sequence")
        n_low, n_high = struct.unpack_from("<QQ", data, _HEAD.size)
        raw, at = np.frombuffer(data, np.uint8), _HEAD.size + 16
        return cls(n, universe, low_bits, raw[at : at + n_low], raw[at + n_low : at + n_low + n_high], np.frombuffer(data, "<u4", offset=at + n_low + n_high))


def pack_chunk(part: int, chunk: int, part_start: int, doc_ids: list[int | None], ids: list[np.ndarray], width: int) -> dict:
    """A row of the store."""
    flat = np.concatenate(ids)
    ends = np.cumsum([len(x) for x in ids])
    has_ids = doc_ids[0] is not None
    first = int(doc_ids[0]) if has_ids else 0
    gaps = np.array([int(d) - first for d in doc_ids] if has_ids else [], np.uint64)
    return {
        "part": part, "chunk": chunk, "part_start": part_start, "n_docs": len(ids), "n_ids": len(flat), "has_ids": has_ids, "first_doc": first, "width": width,
        "ids": flat.astype(f"<u{width}").tobytes(),
        "ends": EliasFano.encode(ends, len(flat) + 1).to_bytes(),
        "doc_ids": EliasFano.encode(gaps, int(gaps[-1]) + 1 if has_ids else 1).to_bytes(),
    }


def unpack_chunk(row) -> tuple[list[int | None], np.ndarray, np.ndarray]:
    """Document ids, end offsets within the chunk, and ids of a row of the store."""
    ends = EliasFano.from_bytes(row["ends"]).values().astype(np.int64)
    gaps = EliasFano.from_bytes(row["doc_ids"]).values()
    docs = [row["first_doc"] + int(g) for g in gaps] if row["has_ids"] else [None] * row["n_docs"]
    return docs, ends, np.frombuffer(row["ids"], f"<u{row['width']}")


def _writer(path: str, end_id: int, chunk_ids: int):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        own_encoder = encoder(path)
        width = 2 if max(own_encoder.tokenizer.get_vocab_size(), end_id + 1) <= 1 << 16 else 4
        part, chunk, start, size = TaskContext.get().partitionId(), 0, 0, 0
        docs: list[int | None] = []
        ids: list[np.ndarray] = []
        for batch in batches:
            encoded = own_encoder.encode(batch["text"].tolist())
            for known, doc, own in zip(batch["known"], batch["doc_id"], encoded, strict=True):
                doc = int(doc) if known else None
                own = np.append(own, end_id)
                if docs and (size + len(own) > chunk_ids or (docs[0] is None) != (doc is None)):
                    yield pd.DataFrame([pack_chunk(part, chunk, start, docs, ids, width)])
                    chunk, start, size, docs, ids = chunk + 1, start + size, 0, [], []
                docs.append(doc)
                ids.append(own)
                size += len(own)
        if docs:
            yield pd.DataFrame([pack_chunk(part, chunk, start, docs, ids, width)])

    return write


def write_store(docs: DataFrame, path: str, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID, chunk_ids: int = CHUNK_IDS) -> None:
    """Encode ``docs`` in ascending ``doc_id`` order into a new store at ``path``.

    Equal ids are ranged on by a hash of their content, so no id is too large for a task.
    """
    text_batches(docs.sparkSession)
    texts = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), body(text_col).alias("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.xxhash64("text")]
    ranged = texts.repartitionByRange(planned_partitions(texts), *order).sortWithinPartitions(*order)
    rows = ranged.select("text", F.col("doc_id").isNotNull().alias("known"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"))
    rows.mapInPandas(_writer(tokenizer, end_id, chunk_ids), STORE_SCHEMA).write.parquet(path)


def open_store(spark, path: str) -> DataFrame:
    """The chunks of a store with ``start``, the number of all ids before each.

    Parts are as many as write tasks, so their sums are small; chunks bring
    their offset within the part.
    """
    chunks = spark.read.schema(STORE_SCHEMA).parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = chunks.groupBy("part").agg(F.sum("n_ids").alias("part_ids")).select("part", F.coalesce(F.sum("part_ids").over(before), F.lit(0)).alias("base"))
    return join_checked(chunks, parts, "part").withColumn("start", F.col("base") + F.col("part_start"))


_DOCUMENT = StructType([StructField(c, LongType()) for c in ("doc_id", "rel", "n_tokens", "ids_crc32")])


@F.udf(ArrayType(_DOCUMENT))
def _documents(has_ids, first_doc, n_docs, width, ids, ends, doc_ids):
    """The documents of one chunk: a call serves thousands of documents."""
    row = {"has_ids": has_ids, "first_doc": first_doc, "n_docs": n_docs, "width": width, "ids": bytes(ids), "ends": bytes(ends), "doc_ids": bytes(doc_ids)}
    docs, stops, flat = unpack_chunk(row)
    wide = flat.astype("<u4")
    out, at = [], 0
    for doc, stop in zip(docs, stops.tolist(), strict=True):
        out.append((doc, at, stop - at, zlib.crc32(wide[at:stop].tobytes())))
        at = stop
    return out


def read_documents(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from the store's files."""
    columns = ["has_ids", "first_doc", "n_docs", "width", "ids", "ends", "doc_ids"]
    each = open_store(spark, path).select("start", F.explode(_documents(*columns)).alias("d"))
    return each.select("d.doc_id", (F.col("start") + F.col("d.rel")).alias("start"), "d.n_tokens", "d.ids_crc32")


@F.pandas_udf(LongType())
def _last_doc(doc_ids: pd.Series) -> pd.Series:
    """How far a chunk's last document id is from its first."""
    found = (EliasFano.from_bytes(data) for data in doc_ids)
    return pd.Series([gaps.select(len(gaps) - 1) for gaps in found], dtype="int64")


def _first_at_least(sequence: EliasFano, value: int) -> int:
    """Place of the first number of a sequence that is not below ``value``, by ``select`` alone."""
    low, high = 0, len(sequence)
    while low < high:
        middle = (low + high) // 2
        if sequence.select(middle) < value:
            low = middle + 1
        else:
            high = middle
    return low


_PLACE = StructType(_DOCUMENT.fields[:3])


@F.pandas_udf(ArrayType(_PLACE))
def _places(first_doc: pd.Series, ends: pd.Series, doc_ids: pd.Series, wanted: pd.Series) -> pd.Series:
    """Where the wanted documents of a chunk are among its ids; offsets are read by ``select``."""
    out = []
    for first, stops, gaps, docs in zip(first_doc.tolist(), map(EliasFano.from_bytes, ends), map(EliasFano.from_bytes, doc_ids), wanted, strict=True):
        own = []
        for doc in docs.tolist():
            place = _first_at_least(gaps, doc - first)
            while place < len(gaps) and gaps.select(place) == doc - first:
                start, stop = (stops.select(place - 1) if place else 0), stops.select(place)
                own.append({"doc_id": doc, "rel": start, "n_tokens": stop - start})
                place += 1
        out.append(own)
    return pd.Series(out, dtype=object)


@F.pandas_udf(LongType())
def _ids_crc32(ids: pd.Series, width: pd.Series) -> pd.Series:
    """CRC-32 of a document's ids as four bytes each."""
    return pd.Series([zlib.crc32(np.frombuffer(own, f"<u{w}").astype("<u4").tobytes()) for own, w in zip(ids, width, strict=True)], dtype="int64")


#: Wanted ids that are looked up in a chunk at once; bounds the arrays of a hot chunk.
LOOKUP_IDS = 4096


def lookup(spark, path: str, wanted: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of the documents of a store whose ids are in ``wanted`` (doc_id).

    Chunks are ranges of ids, so a wanted id is joined to the few chunks whose range
    has it: ids and ranges meet by the blocks of ids that they touch. Places are found
    from offsets alone, and a chunk's ids are cut before Python sees them: a worker
    never holds a whole chunk.
    """
    chunks = open_store(spark, path).filter("has_ids")
    ends = chunks.select("part", "chunk", "first_doc", _last_doc("doc_ids").alias("reach")).withColumn("last_doc", F.col("first_doc") + F.col("reach"))
    spread = ends.agg(F.max("reach").alias("r"), F.count("*").alias("n")).first()
    block = max(1, int(spread["r"] or 0) // 8 + 1)
    own = wanted.filter("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    own = own.withColumn("block", F.floor(F.col("doc_id") / block).cast("long"))
    ranges = ends.withColumn("block", F.explode(F.sequence(F.floor(F.col("first_doc") / block).cast("long"), F.floor(F.col("last_doc") / block).cast("long"))))
    met = own.join(ranges, "block").filter("doc_id BETWEEN first_doc AND last_doc")
    lists = met.groupBy("part", "chunk", F.floor(F.col("doc_id") / LOOKUP_IDS).alias("set")).agg(F.sort_array(F.collect_list("doc_id")).alias("wanted"))
    placed = lists.join(chunks.select("part", "chunk", "start", "first_doc", "width", "ends", "doc_ids"), ["part", "chunk"])
    placed = placed.select("part", "chunk", "start", "width", _places("first_doc", "ends", "doc_ids", "wanted").alias("places"))
    ids = spark.read.schema(STORE_SCHEMA).parquet(path).select("part", "chunk", "ids")
    cut = F.transform("places", lambda p: p.withField("ids", F.substring("ids", (F.col("width") * p["rel"] + 1).cast("int"), (F.col("width") * p["n_tokens"]).cast("int"))))
    found = placed.join(ids, ["part", "chunk"]).select("start", "width", F.explode(cut).alias("d"))
    return found.select("d.doc_id", (F.col("start") + F.col("d.rel")).alias("start"), "d.n_tokens", _ids_crc32("d.ids", "width").alias("ids_crc32"))
