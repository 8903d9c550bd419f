import random

import xxhash

from eigenloom.llm import simhash

from .fixtures import no_documents, odd_documents, odd_rows, prose


def slow_fingerprint(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w.decode() for w in lowered.encode().split()]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def slow_components(fps):
    fps = sorted(set(fps))
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[i + 1 :]:
            if ((a ^ b) & (1 << 64) - 1).bit_count() <= 2:
                a0, b0 = sorted((find(a), find(b)))
                root[b0] = a0
    return {f: find(f) for f in fps}


def signed(value):
    return value - (1 << 64) if value >> 63 else value


def test_fingerprints(spark):
    texts = [r[1] for r in odd_rows()] + ["A b C", "a B c", "x y", prose(9, 700), prose(4, 70_000)]
    for t in texts[:-1]:
        assert simhash.fingerprint(t) & (1 << 64) - 1 == slow_fingerprint(t)
    assert simhash.fingerprint(texts[-1]) & (1 << 64) - 1 == slow_fingerprint(texts[-1])


def test_components_of_scattered_and_crowded_fingerprints(spark):
    rng = random.Random(3)
    fps = [rng.getrandbits(64) for _ in range(150)]
    for f in fps[:40]:  # chains of one and two bits, and neighbours at three
        for n in (1, 2, 3):
            g = f
            for b in rng.sample(range(64), n):
                g ^= 1 << b
            fps.append(g)
    centre = rng.getrandbits(64)  # many within two bytes: lists too long to be paired
    fps += [centre ^ rng.getrandbits(16) << 24 for _ in range(400)] + [centre ^ rng.getrandbits(8) << 56 for _ in range(60)]
    weak = rng.sample(range(64), 14)
    fps += [centre ^ sum(1 << b for b in rng.sample(weak, rng.randint(0, 6))) for _ in range(500)]
    fps = [signed(f) for f in set(fps)]
    got = {r.fp: r.root for r in simhash.fingerprint_components(spark.createDataFrame([(f,) for f in fps], "fp long")).collect()}
    assert got == slow_components(fps)


def test_documents(spark):
    rows = [(k, prose(k, 200)) for k in range(60)]
    rows += [(100 + k, rows[k][1]) for k in range(20)] + [(200 + k, rows[k][1].replace(" the ", " a ", 1)) for k in range(20)]
    rows += [(300 + k, rows[59][1]) for k in range(200)] + [(None, rows[3][1]), (None, "lonely"), (7, rows[7][1])]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    fps = [signed(slow_fingerprint(t)) for _, t in rows]
    roots = slow_components(fps)
    best = {}
    for (doc, _), f in zip(rows, fps, strict=True):
        if doc is not None:
            best[roots[f]] = min(best.get(roots[f], doc), doc)
    want = sorted(((d is None, d or 0, f, best.get(roots[f])) for (d, _), f in zip(rows, fps, strict=True)), key=str)
    assert sorted(((r.doc_id is None, r.doc_id or 0, r.fp, r.component_id) for r in got), key=str) == want
    left = simhash.drop_near_duplicates(docs).collect()
    assert len(left) == len(set(roots.values()))
    assert sorted(r.doc_id for r in left if r.doc_id is not None) == sorted(set(best.values()))


def test_odd_rows(spark):
    docs = odd_documents(spark)
    got = simhash.near_duplicates(docs).collect()
    assert len(got) == docs.count()
    assert {r.component_id for r in got if r.fp == 0} == {2}  # null, empty and blank texts
    left = simhash.drop_near_duplicates(docs)
    assert left.columns == docs.columns and sum(r.doc_id == 1 for r in left.collect()) == 1
    assert simhash.near_duplicates(no_documents(spark)).collect() == []
    assert simhash.drop_near_duplicates(no_documents(spark)).collect() == []


def test_the_tally_rejects(spark):
    base = 0x0123456789ABCDEF
    three = base ^ (1 << 3 | 1 << 20 | 1 << 40)  # meets in one list of five bytes
    six = base ^ 0xFF  # meets in many, differs in eight bits
    two = base ^ (1 << 3 | 1 << 60)
    fps = spark.createDataFrame([(signed(f),) for f in (base, three, six, two)], "fp long")
    met = simhash.postings(fps).groupBy("choice", "bytes").count().filter("count > 1")
    assert met.count() > simhash.MIN_LISTS
    assert {tuple(sorted(r)) for r in simhash.links(fps).collect()} == {tuple(sorted((signed(base), signed(two))))}
