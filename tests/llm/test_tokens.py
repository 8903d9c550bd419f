import random
import re
import zlib

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from eigenloom.llm import encoder, token_counts, token_store
from eigenloom.session import new_table_path

from .fixtures import no_documents, odd_documents, odd_rows, prose

PATH = public_tokenizers.path("byte_bpe_50k.json")


LIBRARY = Tokenizer.from_file(PATH)


def plain(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_encoder_agrees_with_the_library():
    rng = random.Random(1)
    signs = list("aZ é'sßtÿœ ,.!-_<>|0123½²ª \n\t\r\u2014\u00a0\u3000日\U0001f600'") + ["'s", "'ll", "  ", "<|endoftext|>", " the", "n't"]
    texts = ["".join(rng.choice(signs) for _ in range(rng.randint(0, 60))) for _ in range(1500)]
    texts += [prose(k, 50).replace(" ", "\n", 3) for k in range(50)] + ["", " ", "\n\n a", "x" * 5000, "'s's 's"]
    library = Tokenizer.from_file(PATH)
    own = encoder.Encoder(PATH)
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert [x.tolist() for x in own.encode(texts)] == want
    assert own.by_piece


def test_other_tokenizers_go_to_the_library_whole():
    path = public_tokenizers.path("word_bpe_49k.json")
    own = encoder.Encoder(path)
    texts = ["The Cat sat.", "", prose(3, 40)]
    library = Tokenizer.from_file(path)
    assert not own.by_piece
    assert [x.tolist() for x in own.encode(texts)] == [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=300), st.integers(1, 1 << 41))
def test_elias_fano(values, more):
    values = np.array(sorted(values), np.uint64)
    universe = int(values[-1]) + more if len(values) else more
    packed = token_store.EliasFano.from_bytes(token_store.EliasFano.encode(values, universe).to_bytes())
    assert packed.values().tolist() == values.tolist()
    assert [packed.select(i) for i in range(len(packed))] == values.tolist()


def test_elias_fano_is_small():
    values = np.cumsum(np.random.default_rng(0).integers(1, 1000, 100_000))
    size = len(token_store.EliasFano.encode(values, int(values[-1]) + 1).to_bytes())
    assert size * 8 / len(values) < 2 + np.log2(500) + 1.5


def expected(rows):
    out, at = [], 0
    for doc, text in rows:
        ids = np.array([*plain(text), 2], "<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_store_round_trip(spark):
    rows = [(k * 7 - 300, prose(k, k % 90)) for k in range(300)] + [(1 << 50, None), (-(1 << 40), "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    for chunk_ids in (50, 1 << 18):
        path = new_table_path(spark, "test-store")
        token_store.write_store(docs, path, PATH, chunk_ids=chunk_ids)
        got = sorted(tuple(r) for r in token_store.read_documents(spark, path).collect())
        assert got == expected(sorted(rows, key=lambda r: r[0]))


def test_store_of_odd_rows(spark):
    path = new_table_path(spark, "test-store")
    token_store.write_store(odd_documents(spark), path, PATH)
    got = sorted(token_store.read_documents(spark, path).collect(), key=lambda r: r.start)
    texts = {(r[0], len(plain(r[1])) + 1) for r in odd_rows()}
    assert len(got) == len(odd_rows()) and {(r.doc_id, r.n_tokens) for r in got} == texts
    assert [r.start for r in got] == np.cumsum([0, *[r.n_tokens for r in got[:-1]]]).tolist()
    assert [r.doc_id for r in got] == [None, None, *sorted(r[0] for r in odd_rows() if r[0] is not None)]
    path = new_table_path(spark, "test-store")
    token_store.write_store(no_documents(spark), path, PATH)
    assert token_store.read_documents(spark, path).collect() == []


def test_counts_and_cache(spark):
    cache = new_table_path(spark, "test-cache")
    docs = odd_documents(spark)
    want = sorted(((r[0] is None, r[0] or 0, len((r[1] or "").encode()), len(plain(r[1]))) for r in odd_rows()), key=str)
    for _ in range(2):
        got = token_counts.token_counts(docs, cache, PATH).collect()
        assert sorted(((r.doc_id is None, r.doc_id or 0, r.n_bytes, r.n_tokens) for r in got), key=str) == want
        assert all(r.over_limit == (r.n_tokens > 512) for r in got)
        assert spark.read.parquet(cache).count() == len({r[1] or "" for r in odd_rows()})  # each distinct text once
    more = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(77, "new text")], "doc_id long, text string"))
    token_counts.token_counts(more, cache, PATH).collect()
    assert spark.read.parquet(cache).count() == len({r[1] or "" for r in odd_rows()}) + 1
    other = public_tokenizers.path("word_bpe_49k.json")
    token_counts.token_counts(docs, cache, other).collect()
    assert spark.read.parquet(cache).select("tokenizer").distinct().count() == 2
    assert token_counts.token_counts(no_documents(spark), new_table_path(spark, "test-cache"), PATH).collect() == []


def test_lookups_equal_whole_reads(spark):
    docs = spark.createDataFrame([(3 * k - 20, prose(k, 5 + k % 60)) for k in range(300)] + [(7, "twice"), (7, "again"), (None, "no id"), (10**12, "far")], "doc_id long, text string")
    path = new_table_path(spark, "store")
    token_store.write_store(docs, path, PATH, chunk_ids=200)
    every = {tuple(r) for r in token_store.read_documents(spark, path).collect()}
    wanted = [-20, -19, 7, 8, 100, 877, 10**12, 10**12 + 1, None, *range(301, 600)]
    got = token_store.lookup(spark, path, spark.createDataFrame([(w,) for w in wanted + wanted], "doc_id long")).collect()
    assert sorted(map(tuple, got)) == sorted(r for r in every if r[0] is not None and r[0] in wanted)
    token_store.write_store(no_documents(spark), path + "-empty", PATH)
    assert token_store.lookup(spark, path + "-empty", spark.createDataFrame([(1,)], "doc_id long")).collect() == []


def test_lookups_hand_python_no_whole_chunk(spark):
    docs = spark.createDataFrame([(k, prose(k, 40)) for k in range(90)], "doc_id long, text string")
    path = new_table_path(spark, "store")
    token_store.write_store(docs, path, PATH, chunk_ids=200)
    found = token_store.lookup(spark, path, docs.select("doc_id").filter("doc_id % 7 = 0"))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    calls = re.findall(r"EvalPython \[(\w+)\(([^)]*)\)", plan)
    assert calls and not [c for c in calls if re.search(r"\bids#", c[1])]
    assert sorted(r.doc_id for r in found.collect()) == list(range(0, 90, 7))


def test_cache_is_asked_before_texts_move(spark):
    docs = odd_documents(spark)
    half = docs.filter("doc_id < 6")
    for miss_rows in (token_counts.MISS_ROWS, 0):
        cache = new_table_path(spark, "cache")
        token_counts.fill_cache(half, cache, PATH)
        first = spark.read.parquet(cache).count()
        token_counts.fill_cache(docs, cache, PATH, miss_rows=miss_rows)
        kept = spark.read.parquet(cache)
        assert first < kept.count() == kept.select("content").distinct().count() == docs.selectExpr("coalesce(text, '')").distinct().count()
        files = set(kept.inputFiles())
        counts = {(r.doc_id, r.n_bytes, r.n_tokens) for r in token_counts.token_counts(docs, cache, PATH).collect()}
        assert set(spark.read.parquet(cache).inputFiles()) == files  # nothing was missing
        kept.write.mode("append").partitionBy("tokenizer").parquet(cache)  # as a second writer would
        again = token_counts.token_counts(docs, cache, PATH).collect()
        assert len(again) == docs.count() and {(r.doc_id, r.n_bytes, r.n_tokens) for r in again} == counts
