import hashlib
import random

import numpy as np
import pyarrow as pa

from eigenloom.llm import repeats
from eigenloom.llm.suffixes import suffix_arrays

from .fixtures import no_documents, odd_documents, odd_rows, prose


def slow_repeats(rows):
    """Removed flags by row of (doc_id, text): every string looked up in a dictionary."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0, k))
    seen, out = set(), {}
    for k in order:
        text = (rows[k][1] or "").encode()
        gone = bytearray(len(text))
        for i in range(len(text) - 99):
            if text[i : i + 100] in seen:
                gone[i : i + 100] = b"\1" * 100
            seen.add(text[i : i + 100])
        out[k] = gone
    return out


def summary(rows):
    found = []
    for k, gone in slow_repeats(rows).items():
        text = (rows[k][1] or "").encode()
        kept = bytes(c for c, g in zip(text, gone, strict=True) if not g)
        spans = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        found.append((rows[k][0], len(text), sum(gone), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(found, key=str)


def result(docs):
    got = repeats.drop_repeats(docs).collect()
    return sorted(((r.doc_id, r.n_bytes, sum(s.stop - s.start for s in r.spans), len(r.spans), hashlib.sha256(r.kept).hexdigest()) for r in got), key=str)


def test_suffix_arrays_against_sorting():
    rng = random.Random(1)
    for _ in range(150):
        texts = []
        for _ in range(rng.randint(1, 6)):
            letters = rng.choice([1, 2, 3, 26])
            text = [rng.randint(2, 1 + letters) if rng.random() > 0.05 else 1 for _ in range(rng.randint(0, 60))]
            texts.append((text[: len(text) // 4] * 5 if rng.random() < 0.3 else text) + [0])
        sizes = np.array([len(t) for t in texts])
        starts = np.cumsum(sizes) - sizes
        got = suffix_arrays(np.array(sum(texts, []), np.int64), starts, sizes)
        for text, at in zip(texts, starts, strict=True):
            assert got[at : at + len(text)].tolist() == [at + i for i in sorted(range(len(text)), key=lambda i: text[i:])]
    assert len(suffix_arrays(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64))) == 0


def rows_with_repeats(seed, n=60):
    rng = random.Random(seed)
    shared = [prose(100 + k, rng.randint(12, 60)) for k in range(6)]
    line = "all rights are reserved by whoever wrote this line of text"
    rows = []
    for k in range(n):
        parts = [prose(1000 * seed + 7 * k + j, rng.randint(0, 50)) for j in range(3)]
        for j in range(2):
            if rng.random() < 0.6:
                cut = rng.choice(shared)
                i = rng.randint(0, len(cut) // 2)
                parts.insert(j + 1, cut[i : i + rng.randint(60, 300)])
        parts.insert(rng.randint(0, len(parts)), line)
        rows.append((k, "".join(parts) if k % 2 else "\n".join(parts)))
    rows += [(100 + k, rows[k][1]) for k in range(5)] + [(200, rows[7][1] * 3), (201, "ab" * 400), (202, "a" * 1000), (203, "a" * 99), (204, "ü" * 80 + "日本語" * 60), (205, "日本語" * 90)]
    rng.shuffle(rows)
    return rows


def test_documents_against_a_dictionary(spark):
    for seed in (1, 2):
        rows = rows_with_repeats(seed)
        assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == summary(rows)


def test_crowded_cores_are_split_whole(spark, monkeypatch):
    passage = prose(5, 40)
    rows = rows_with_repeats(3, 40) + [(300 + k, prose(50 + k, 30) + passage + prose(90 + k, 30)) for k in range(60)]
    monkeypatch.setattr(repeats, "MOST_PIECES", 4)
    assert result(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)) == summary(rows)


def test_pieces_of_long_texts(monkeypatch):
    monkeypatch.setattr(repeats, "BLOCK", 1000)  # texts over several blocks
    texts = [prose(k, 900) for k in range(4)] + ["", "short", prose(2, 900) + prose(8, 300) + prose(0, 900)]
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text_hash": list(range(7)), "text": texts})
    seen, cores = set(), {}
    for out in repeats._find_pieces(iter([batch])):
        for r in out.to_pylist():
            for i in range(r["n_windows"]):
                place = (r["doc_id"], r["start"] + i)
                assert place not in seen and r["start"] + i + 100 <= len(texts[r["doc_id"]])
                seen.add(place)
                window = texts[r["doc_id"]][r["start"] + i :][:100]
                assert cores.setdefault(window, (r["h"], r["core"] - i)) == (r["h"], r["core"] - i)
    assert len(seen) == sum(max(0, len(t) - 99) for t in texts)


def test_halves_cover_all_windows():
    rng = random.Random(2)
    for _ in range(300):
        last = rng.randint(0, 68)
        size = rng.randint(32, 99)
        low = rng.randint(last, min(100, last + 100 - size)) if last + size <= 100 + last else last
        low = min(low, 100 - size) if last == 0 else max(last, min(low, 100 - size))
        if low < last or low + size > 100:
            continue
        seen = []
        for first, stop, a, b in repeats._split(b"x" * (last + 100), low, low + size):
            seen += range(first, stop + 1)
            assert stop <= a and b <= first + 100 and b - a > size
        assert seen == list(range(last + 1))


def test_odd_rows(spark):
    rows = [(r[0], r[1]) for r in odd_rows()]
    assert result(odd_documents(spark)) == summary(rows)
    assert result(no_documents(spark)) == []
    twins = [(None, prose(4, 80))] * 4 + [(1, "short")] * 3 + [(2, None)]
    assert result(spark.createDataFrame(twins, "doc_id long, text string")) == summary(twins)
