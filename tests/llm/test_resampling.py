import hashlib
import math
import random
import re
import zlib

from pyspark.sql import functions as F

from eigenloom.llm import resampling

from .fixtures import no_documents, odd_documents, odd_rows, prose


def slow_features(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)
    return words, words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def slow_resample(rows, target):
    bucket = lambda f: zlib.crc32(f.encode()) % 10_000
    s, t = [0] * 10_000, [0] * 10_000
    for counts, texts in ((s, [r[1] for r in rows]), (t, target)):
        for text in texts:
            for f in slow_features(text)[1]:
                counts[bucket(f)] += 1
    all_s, all_t = sum(s), sum(t)
    gain = [math.floor(1000 * math.log((t[b] + 1) * (all_s + 10_000) / ((s[b] + 1) * (all_t + 10_000)))) for b in range(10_000)]
    out = []
    for i, text in rows:
        words, features = slow_features(text)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words) >= 20])
    fit = sorted((r for r in out if r[5]), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    for k, r in enumerate(fit[: 25 * len(fit) // 100]):
        r[4] = k + 1
    return sorted((tuple(r[:5]) for r in out), key=str)


def result(docs, target):
    return sorted(((r.doc_id, r.n_features, r.weight, r.score, r["rank"]) for r in resampling.resample(docs, target).collect()), key=str)


def test_against_a_loop(spark):
    rng = random.Random(4)
    rows = [(k, prose(k, rng.randint(0, 80))) for k in range(300)] + [(k, prose(k, 40)) for k in range(300, 340)] * 2
    rows += [(400, "ÄRGER Straße-naïve x9 über " * 10), (401, "A.b,C;d\x00e\x7ff" * 9), (402, "ok" * 30_000)]
    rng.shuffle(rows)
    target = [prose(k, 30) for k in range(5, 15)] + [None, ""]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    assert result(docs, spark.createDataFrame([(t,) for t in target], "text string")) == slow_resample(rows, target)


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()] + [(r[0], r[1]) for r in odd_rows()] * 3
    docs = odd_documents(spark)
    for _ in range(2):
        docs = docs.unionByName(docs)
    nothing = no_documents(spark)
    assert result(docs, nothing) == slow_resample(rows, [])
    assert result(nothing, docs) == []


def test_ranks_over_many_ranges(spark):
    rows = spark.range(5000).withColumn("score", F.col("id") % 7).repartition(4)
    got = resampling.ranked(rows, F.col("score").desc(), F.col("id")).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 5001))
    assert [(-r.score, r.id) for r in got] == sorted((-r.score, r.id) for r in got)
