"""Operator 12: remove repeated passages with suffix arrays.

A byte goes if a string of ``LENGTH`` bytes covers it that also starts earlier: in a
document of smaller id, or earlier in the same one. Strings never cross documents and
are judged on the input.

No machine could hold a suffix array of all texts, so suffixes are dealt out by
content. In every window of ``LENGTH`` bytes the run of ``GRAM`` bytes with the least
hash (of equal ones the leftmost) is its core. Equal windows have equal cores at equal
places, and windows that share a core make one piece of text. Pieces are dealt by the
hash of their core, so equal windows always meet.

1. Pieces are listed by numbers only: place, core hash, hash of the whole piece.
   Cores that occur once are done with.
2. Alike pieces are counted and stand for one another: all windows of a later copy
   repeat those of the first. What is left are cores with several different pieces.
3. Their texts are fetched, and a suffix array of each core's pieces is built by
   linear grouping (``suffixes``). Neighbours in it that share ``LENGTH`` bytes are
   equal windows; all but the first go.

A core with more than ``MOST_PIECES`` different pieces, such as a common line between
all sorts of neighbours, is split: windows that reach far enough to its left go by the
core and half of what is missing to the left, the others by the core and the rest to
the right; halves that are alike again stand for one another. Each split halves what
is missing, so after seven at most a core is a whole window and its pieces are alike.
So a task's suffix arrays are bounded whatever the input holds, and nothing is left out.

Defined results
    null text: empty; texts shorter than ``LENGTH`` keep everything; null ``doc_id``:
    after all others, among themselves (as other rows of one id) by content hash;
    rows alike in id and text: the first is judged as one row, the others repeat it
    wholly; very long texts are read whole, a million bytes at a time; other columns
    are not read; empty table: no rows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType, IntegerType, LongType, StructField, StructType

from eigenloom.llm.suffixes import suffix_arrays
from eigenloom.llm.text import body
from eigenloom.session import join_checked, materialise, planned_partitions, release, shuffles_dropped, text_batches

#: Bytes of a string that may not repeat.
LENGTH = 100
#: Bytes of a core.
GRAM = 32
#: Different pieces of a core that one suffix array may hold.
MOST_PIECES = 128
#: Symbols whose suffix arrays are built side by side; bounds a task's memory.
SYMBOLS = 1 << 21
#: Bytes of pieces (as stored) that a task's suffix arrays are built of.
PIECE_BYTES = 16 << 20
#: Window starts that are hashed at once.
BLOCK = 1 << 20
_PLACE = np.uint64((1 << 21) - 1)
_BASE = 0x9E3779B97F4A7C15
_KEY = ["doc_id", "text_hash"]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class _Hasher:
    """Hashes of any substrings of a block: sums of random numbers by byte, times powers, modulo 2^64."""

    def __init__(self, most: int = BLOCK + 256) -> None:
        self.byte = np.frombuffer(hashlib.shake_128(b"bytes").digest(2048), "<u8")
        self.power = np.cumprod(np.full(most, _BASE, np.uint64))
        self.inverse = np.cumprod(np.full(most, pow(_BASE, -1, 1 << 64), np.uint64))

    def sums(self, data: np.ndarray) -> np.ndarray:
        out = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(self.byte[data] * self.power[: len(data)], out=out[1:])
        return out

    def grams(self, sums: np.ndarray, size: int) -> np.ndarray:
        return _mixed((sums[size:] - sums[:-size]) * self.inverse[: len(sums) - size])

    def spans(self, sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return _mixed((sums[end] - sums[start]) * self.inverse[start] + (end - start).astype(np.uint64))


def _least(keys: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` neighbours."""
    step = 1
    while 2 * step <= width:
        keys = np.minimum(keys[:-step], keys[step:])
        step *= 2
    rest = width - step
    return np.minimum(keys[:-rest], keys[rest:]) if rest else keys


def _buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of texts or bytes without nulls."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_binary())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] else np.zeros(0, np.uint8)
    return data[offsets[0] : offsets[-1]], offsets - offsets[0]


def _windows(offsets: np.ndarray) -> np.ndarray:
    """Whether a whole window starts at a byte."""
    edge = np.zeros(offsets[-1] + 1, np.int8)
    late = np.maximum(offsets[:-1], offsets[1:] - LENGTH + 1)
    np.add.at(edge, late, 1)
    np.add.at(edge, offsets[1:], -1)
    return np.cumsum(edge, dtype=np.int8)[:-1] == 0


def _find_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, start, n_windows, core, h, whole) of every piece."""
    hasher = _Hasher()
    for batch in batches:
        data, offsets = _buffers(batch.column("text"))
        fits = _windows(offsets)
        for at in range(0, max(0, len(data) - LENGTH + 1), BLOCK):
            block = data[at : at + BLOCK + LENGTH - 1]
            sums = hasher.sums(block)
            grams = hasher.grams(sums, GRAM)
            keys = (grams & ~_PLACE) | np.arange(len(grams), dtype=np.uint64)
            cores = (_least(keys, LENGTH - GRAM + 1) & _PLACE).astype(np.int64)
            starts = np.flatnonzero(fits[at : at + len(cores)])
            if not len(starts):
                continue
            new = np.flatnonzero((np.diff(starts, prepend=-2) != 1) | (np.diff(cores[starts], prepend=-1) != 0))
            count = np.diff(new, append=len(starts))
            start = starts[new]
            core = cores[start]
            doc = np.searchsorted(offsets, at + start, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [
                    *(batch.column(c).take(pa.array(doc)) for c in _KEY),
                    pa.array(at + start - offsets[doc]),
                    pa.array(count.astype(np.int32)),
                    pa.array((core - start).astype(np.int32)),
                    pa.array(grams[core].view(np.int64)),
                    pa.array(hasher.spans(sums, start, start + count + LENGTH - 1).view(np.int64)),
                ],
                names=[*_KEY, "start", "n_windows", "core", "h", "whole"],
            )


def _cut_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, doc_id, text_hash, start, core_from, core_to, piece): the texts of listed pieces."""
    for batch in batches:
        wanted = batch.column("pieces")
        owner = pc.list_parent_indices(wanted)
        flat = pc.list_flatten(wanted)
        h, start, count, core = (flat.field(k) for k in range(4))
        data, offsets = _buffers(batch.column("text"))
        at = offsets[owner.to_numpy()] + start.to_numpy()
        size = count.to_numpy() + LENGTH - 1
        raw = data.tobytes()
        texts = [raw[i : i + n] for i, n in zip(at.tolist(), size.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays(
            [h, *(batch.column(c).take(owner) for c in _KEY), start, core, pa.array(core.to_numpy() + np.int32(GRAM)), pa.array(texts, pa.binary())],
            names=["key", *_KEY, "start", "core_from", "core_to", "piece"],
        )


def _split(text: bytes, low: int, high: int) -> Iterator[tuple[int, int, int, int]]:
    """(first window, last window, low, high) of the two halves of a piece; low and high are the grown core."""
    last = len(text) - LENGTH
    missing = LENGTH - (high - low)
    left = (missing + 1) // 2
    if low >= left:
        yield 0, min(last, low - left), low - left, high
    if last > low - left:
        yield max(0, low - left + 1), last, low, high + missing - left + 1


def _split_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pieces of crowded cores under two longer cores."""
    for batch in batches:
        rows: list[tuple] = []
        lists = (batch.column(c).to_pylist() for c in ("key", "start", "core_from", "core_to", "piece"))
        for k, (key, start, low, high, text) in enumerate(zip(*lists, strict=True)):
            for first, last, a, b in _split(text, low, high):
                side = xxhash.xxh64_intdigest(text[a:b], seed=(key + (a < low)) % (1 << 64))
                rows.append((k, side - (1 << 64) if side >> 63 else side, start + first, a - first, b - first, text[first : last + LENGTH]))
        owner, key, start, low, high, text = zip(*rows, strict=True) if rows else [()] * 6
        owner = pa.array(owner, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [pa.array(key, pa.int64()), *(batch.column(c).take(owner) for c in _KEY), pa.array(start, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(text, pa.binary())],
            names=["key", *_KEY, "start", "core_from", "core_to", "piece"],
        )


def _document_ranks(rows: pa.Table) -> np.ndarray:
    """Places of the rows' documents in the order of documents: equal for one document."""
    order = pc.sort_indices(rows, sort_keys=[(c, "ascending") for c in _KEY], null_placement="at_end").to_numpy()
    ids = rows.column("doc_id").combine_chunks().dictionary_encode().indices.fill_null(-1).to_numpy()[order]
    hashes = rows.column("text_hash").to_numpy()[order]
    new = (np.diff(ids, prepend=-2) != 0) | (np.diff(hashes, prepend=0) != 0)
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def _repeated(rows: pa.Table) -> pa.RecordBatch:
    """(doc_id, text_hash, start, stop): windows of the pieces that an earlier piece of their key has too."""
    data, offsets = _buffers(rows.column("piece"))
    key = rows.column("key").to_numpy()
    n = len(key)
    size = np.diff(offsets) + 1  # a mark after each piece
    begin = np.cumsum(size) - size
    raw = np.zeros(int(size.sum()) + 8, np.uint8)
    inside = np.ones(len(raw), bool)
    inside[begin + size - 1] = False
    inside[-8:] = False
    raw[inside] = data
    symbols = raw[:-8].astype(np.int64) + 2
    symbols[begin + size - 1] = 1
    head = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    last = np.append(head[1:], n) - 1
    symbols[begin[last] + size[last] - 1] = 0
    order = suffix_arrays(symbols, begin[head], begin[last] + size[last] - begin[head])
    piece = np.repeat(np.arange(n), size)
    window = np.arange(len(symbols)) <= (begin + size - 1 - LENGTH)[piece]
    eight = np.ndarray((len(raw) - 7,), "<u8", raw, strides=(1,))
    problem = np.repeat(np.cumsum(np.append(True, key[1:] != key[:-1])), size)
    same = np.flatnonzero(window[order[:-1]] & window[order[1:]] & (problem[order[:-1]] == problem[order[1:]]))
    for k in [*range(0, LENGTH - 7, 8), LENGTH - 8]:
        same = same[eight[order[same] + k] == eight[order[same + 1] + k]]
    joined = np.zeros(len(order), bool)
    joined[same + 1] = True
    run = np.flatnonzero(~joined)
    start = rows.column("start").to_numpy()
    rank = (_document_ranks(rows)[piece] << 40) + start[piece] + np.arange(len(symbols)) - begin[piece]
    ranked = rank[order]
    first = np.repeat(np.minimum.reduceat(ranked, run), np.diff(run, append=len(order)))
    lost = np.zeros(len(symbols) + 2, np.int8)
    lost[order[ranked > first] + 1] = 1
    step = np.diff(lost)
    low, high = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    owner = piece[low] if len(low) else np.zeros(0, np.int64)
    shift = start[owner] - begin[owner]
    return pa.RecordBatch.from_arrays(
        [*(rows.column(c).combine_chunks().take(pa.array(owner)) for c in _KEY), pa.array(low + shift), pa.array(high + shift + LENGTH - 1)],
        names=[*_KEY, "start", "stop"],
    )


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Repeated windows of pieces that come sorted by key."""
    held: list[pa.Table] = []
    symbols = 0
    for batch in batches:
        table = pa.Table.from_batches([batch])
        held.append(table)
        symbols += len(_buffers(table.column("piece"))[0]) + len(table)
        if symbols >= SYMBOLS:
            whole = pa.concat_tables(held)
            key = whole.column("key").to_numpy()
            earlier = np.flatnonzero(key != key[-1])
            cut = int(earlier[-1]) + 1 if len(earlier) else 0
            if cut:
                yield _repeated(whole.slice(0, cut).combine_chunks())
            rest = whole.slice(cut).combine_chunks()
            held, symbols = [rest], len(_buffers(rest.column("piece"))[0])
    if held and sum(map(len, held)):
        yield _repeated(pa.concat_tables(held).combine_chunks())


def _place() -> Column:
    """Of a window: what orders it among all."""
    return F.struct(F.col("doc_id").isNull().alias("no_id"), *_KEY, "start")


def _keyed(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    same = left[names[0]].eqNullSafe(right[names[0]])
    for c in names[1:]:
        same = same & left[c].eqNullSafe(right[c])
    return same


def repeated_windows(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, text_hash, start, stop): byte ranges that strings cover which start earlier as well.

    ``text_hash`` tells rows of one id apart. Ranges may overlap and repeat.
    """
    text_batches(docs.sparkSession)
    rows = _rows(docs, id_col, text_col)
    key = [StructField(c, rows.schema[c].dataType) for c in _KEY]
    listed = StructType([*key, StructField("start", LongType()), StructField("n_windows", IntegerType()), StructField("core", IntegerType()), StructField("h", LongType()), StructField("whole", LongType())])
    cut = StructType([StructField("key", LongType()), *key, StructField("start", LongType()), StructField("core_from", IntegerType()), StructField("core_to", IntegerType()), StructField("piece", BinaryType())])
    spans = StructType([*key, StructField("start", LongType()), StructField("stop", LongType())])

    with shuffles_dropped(docs.sparkSession):
        pieces = materialise(rows.mapInArrow(_find_pieces, listed), "repeats-pieces")
        often = materialise(pieces.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeats-often")
        shared = materialise(pieces.join(often, "h"), "repeats-shared")
        release(pieces)
        release(often)

        # alike pieces: all windows of a copy repeat the first one's
        first = shared.groupBy("h", "whole").agg(F.count("*").alias("n"), F.min(_place()).alias("place"), F.first("n_windows").alias("n_windows"), F.first("core").alias("core"))
        first = materialise(first, "repeats-first")
        copied = first.filter("n > 1").select("h", "whole", "place")
        copies = shared.join(copied, ["h", "whole"]).filter(_place() != F.col("place"))
        copies = [materialise(copies.select(*_KEY, "start", (F.col("start") + F.col("n_windows") + (LENGTH - 1)).alias("stop")), "repeats-copies")]
        release(shared)

        # cores of several different pieces
        several = materialise(first.groupBy("h").agg(F.count("*").alias("n")).filter("n > 1").select("h"), "repeats-several")
        wanted = first.join(several, "h").select("place.*", F.struct("h", F.col("place.start").alias("start"), "n_windows", "core").alias("piece"))
        wanted = materialise(wanted.groupBy(*_KEY).agg(F.collect_list("piece").alias("pieces")), "repeats-wanted")
        release(first)
        release(several)
        texts = rows.join(wanted, _keyed(rows, wanted, _KEY)).select(rows["doc_id"], rows["text_hash"], "text", "pieces")
        level = materialise(texts.mapInArrow(_cut_pieces, cut).dropDuplicates(["key", *_KEY, "start"]), "repeats-texts")  # of rows alike once
        release(wanted)
        ready, used, parts = [], [level], planned_partitions(level, PIECE_BYTES)
        while True:
            counts = materialise(level.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1"), "repeats-counts")
            used.append(counts)
            ready.append(level.join(counts.filter(F.col("n") <= MOST_PIECES).select("key"), "key").select(*cut.names))
            crowded = counts.filter(F.col("n") > MOST_PIECES).select("key")
            if crowded.isEmpty():
                break
            halves = materialise(level.join(crowded, "key").select(*cut.names).mapInArrow(_split_pieces, cut), "repeats-halves")
            level = halves.groupBy("key", "core_from", "core_to", "piece").agg(F.count("*").alias("n"), F.min(_place()).alias("place"))
            level = materialise(level.select("key", "place.*", "core_from", "core_to", "piece", "n", "place"), "repeats-texts")
            copied = level.filter("n > 1").select("key", "piece", "place")
            later = halves.join(copied, ["key", "piece"]).filter(_place() != F.col("place"))
            copies.append(materialise(later.select(*_KEY, "start", (F.col("start") + F.octet_length("piece")).alias("stop")), "repeats-copies"))
            release(halves)
            used.append(level)
        pieces = reduce(DataFrame.unionByName, ready).repartition(parts, "key").sortWithinPartitions("key")
        found = materialise(reduce(DataFrame.unionByName, copies, pieces.mapInArrow(_solve, spans)), "repeats-spans")
        for table in used + copies:
            release(table)
    return found


def _rows(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = body(text_col)
    return docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _remove(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, text_hash, n, n_bytes, spans, kept) of texts with the windows to remove."""
    for batch in batches:
        data, offsets = _buffers(batch.column("text"))
        raw = data.tobytes()
        found, kept = [], []
        for k, windows in enumerate(batch.column("windows").to_pylist()):
            text = raw[offsets[k] : offsets[k + 1]]
            spans: list[list[int]] = []
            for w in sorted((w["start"], w["stop"]) for w in windows or ()):
                if spans and w[0] <= spans[-1][1]:
                    spans[-1][1] = max(spans[-1][1], w[1])
                else:
                    spans.append([*w])
            ends = [0, *(x for s in spans for x in s), len(text)]
            found.append([{"start": a, "stop": b} for a, b in spans])
            kept.append(b"".join(text[a:b] for a, b in zip(ends[::2], ends[1::2], strict=True)) if spans else text)
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in [*_KEY, "n"]), pa.array(np.diff(offsets)), pa.array(found, pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())]))), pa.array(kept, pa.binary())],
            names=[*_KEY, "n", "n_bytes", "spans", "kept"],
        )


def drop_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row a document: (doc_id, text_hash, n_bytes, spans, kept).

    ``spans`` are the maximal removed byte ranges, ``kept`` the bytes left (a span may
    end within a character).
    """
    windows = repeated_windows(docs, id_col=id_col, text_col=text_col)
    rows = _rows(docs, id_col, text_col)
    with shuffles_dropped(docs.sparkSession):
        spans = materialise(windows.groupBy(*_KEY).agg(F.collect_set(F.struct("start", "stop")).alias("windows")), "repeats-by-text")
        alike = materialise(rows.groupBy(*_KEY).agg(F.count("*").alias("n")).filter("n > 1"), "repeats-alike")
    release(windows)
    if alike.isEmpty():
        counted = rows.withColumn("n", F.lit(1).cast("long"))
    else:
        rest = join_checked(rows, alike.drop("n"), _keyed(rows, alike, _KEY), "left_anti").withColumn("n", F.lit(1).cast("long"))
        twins = join_checked(rows, alike.drop("n"), _keyed(rows, alike, _KEY), "left_semi")
        counted = rest.unionByName(twins.groupBy(*_KEY).agg(F.first("text").alias("text"), F.count("*").alias("n")))
    joined = counted.join(spans, _keyed(counted, spans, _KEY), "left")
    joined = joined.select(counted["doc_id"], counted["text_hash"], counted["n"], counted["text"], spans["windows"])
    schema = StructType([*(StructField(c, rows.schema[c].dataType) for c in _KEY), StructField("n", LongType()), StructField("n_bytes", LongType())])
    ddl = f"{schema.simpleString()[7:-1]},spans:array<struct<start:bigint,stop:bigint>>,kept:binary"
    judged = joined.mapInArrow(_remove, ddl)
    # of rows alike in id and text all but the first go whole
    copy = F.explode(F.sequence(F.lit(1).cast("long"), F.col("n")))
    gone = (F.col("copy") > 1) & (F.col("n_bytes") >= LENGTH)
    whole = F.array(F.struct(F.lit(0).cast("long").alias("start"), F.col("n_bytes").alias("stop")))
    return judged.withColumn("copy", copy).select(
        *_KEY, "n_bytes", F.when(gone, whole).otherwise(F.col("spans")).alias("spans"), F.when(gone, F.lit(b"")).otherwise(F.col("kept")).alias("kept")
    )
