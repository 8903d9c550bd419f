import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from eigenloom.llm import toxicity

from .fixtures import no_documents, odd_documents, prose

BAD = ["zugmorf", "krelbix", "zugmorfer", "krelbixen", "zugmorfly"]


def corpus(n=600, bad=BAD):
    rows, labels = [], []
    for k in range(n):
        words = prose(k, 40 + k % 50).split()
        toxic = k % 4 == 0
        if toxic:
            for j in range(3 + k % 3):
                words[(7 * j + k) % len(words)] = bad[(j + k) % len(bad)]
        rows.append((k, " ".join(words)))
        labels.append((k, int(toxic)))
    return rows, labels


def held_out(k):
    return zlib.crc32(str(k).encode()) % 3 == 1


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(2), spark.createDataFrame(labels, "doc_id long, toxic int")


@pytest.mark.parametrize("bad", [BAD, ["ублюдок", "мразь", "тварина"], ["1d10t", "sc*m", "l0s3r!"], ["笨蛋東西", "白痴傢伙"]], ids=["latin", "cyrillic", "digits", "han"])
def test_held_out_rows_are_told_apart(spark, bad):
    rows, labels = corpus(bad=bad)
    docs, marks = frames(spark, rows, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    assert len(got) == len(rows)
    for k, r in got.items():
        assert r.held_out == held_out(k)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
    held = [(r.predicted, dict(labels)[k]) for k, r in got.items() if r.held_out]
    assert np.mean([p == y for p, y in held]) > 0.97


def test_held_out_labels_are_not_learned_from(spark):
    rows, labels = corpus(300)
    docs, marks = frames(spark, rows, labels)
    got = {r.doc_id: r for r in toxicity.score(docs, marks).collect()}
    flipped = spark.createDataFrame([(k, 1 - y if held_out(k) else y) for k, y in labels], "doc_id long, toxic int")
    again = {r.doc_id: r.score for r in toxicity.score(docs, flipped).collect()}
    assert all(abs(again[k] - r.score) < 1e-9 for k, r in got.items())
    clean = toxicity.drop_toxic(docs, marks)
    assert clean.columns == docs.columns
    assert {r.doc_id for r in clean.collect()} == {k for k, r in got.items() if not r.predicted}


def grams(word, n=toxicity.ORDER):
    line = b"\0" * (n - 1) + word.encode() + b" "
    return [line[i : i + n] for i in range(len(line) - n + 1)]


class Naive:
    """Kneser-Ney over dictionaries of byte strings, as in the operator's description."""

    def __init__(self, texts, toxic, plain):
        n = toxicity.ORDER
        count = lambda some: Counter(g for t in some for w in set(t.lower().split()) for g in grams(w))
        self.toxic, self.plain = count(toxic), count(plain)
        every = count(texts)
        self.levels = {n: every}
        occurrences, longer = every, n
        for size in toxicity.BACKOFF:
            raw, before = Counter(), defaultdict(set)
            for g in self.levels[longer]:
                raw[g[-size:]] += occurrences[g]
                before[g[-size:]].add(g[:-size])
            occurrences, longer = raw, size
            self.levels[size] = {g: raw[g] if g[0] == 0 else len(before[g]) for g in raw}

    @staticmethod
    def discount(table):
        ones, twos = sum(v == 1 for v in table.values()), sum(v == 2 for v in table.values())
        return min(0.95, max(0.1, ones / (ones + 2 * twos))) if ones else 0.5

    def mixed(self, table, g, below):
        own = {h: v for h, v in table.items() if h[:-1] == g[:-1]}
        total = sum(own.values())
        if not total:
            return below
        d = self.discount(table)
        return (max(own.get(g, 0) - d, 0) + d * len(own) * below) / total

    def shared(self, g):
        level = self.levels[len(g)]
        if len(g) == 1:
            return (level[g] + 0.5) / (sum(level.values()) + 128)
        return self.mixed(level, g, self.shared(g[-max(s for s in toxicity.BACKOFF if s < len(g)) :]))

    def statistic(self, g):
        own = [(t[g], sum(v for h, v in t.items() if h[:-1] == g[:-1])) for t in (self.toxic, self.plain)]
        both = sum(n for n, _ in own) / max(sum(total for _, total in own), 1)
        return 2 * sum(n * math.log(n / (total * both)) for n, total in own if n)

    def ratio(self, g):
        if self.statistic(g) < toxicity.LEAST_STATISTIC:
            return 0.0
        below = self.shared(g[-toxicity.BACKOFF[0] :])
        told = math.log(self.mixed(self.toxic, g, below)) - math.log(self.mixed(self.plain, g, below))
        return told if abs(told) >= toxicity.LEAST_RATIO else 0.0

    def measure(self, text):
        ratios = [self.ratio(g) for w in text.lower().split() for g in grams(w)]
        return len(ratios), sum(ratios) / max(len(ratios), toxicity.LEAST_SYMBOLS)


@pytest.mark.parametrize("model_rows", [toxicity.MODEL_ROWS, 0])
def test_scores_against_a_naive_model(spark, model_rows):
    rows, labels = corpus(60)
    rows = [(k, " ".join(t.split()[:25]).replace("the", "été" if k % 3 else "the")) for k, t in rows] + [(900, "Krelbix a unseenword"), (901, "")]
    docs, marks = frames(spark, rows, labels)
    known = [(t, y) for (k, t), (_, y) in zip(rows, labels, strict=False) if not held_out(k)]
    naive = Naive([t for _, t in rows], [t for t, y in known if y], [t for t, y in known if not y])
    model = toxicity.fit(docs, marks, model_rows=model_rows)
    got = {r.doc_id: r for r in toxicity.score(docs, marks, model_rows=model_rows).collect()}
    assert len(got) == len(rows) and sum(r.log_ratio > 0 for r in got.values()) > 5
    for k, t in rows:
        n, evidence = naive.measure(t)
        r = got[k]
        assert r.n_symbols == n
        assert abs(r.log_ratio - evidence) < 1e-5
        z = model.weights[0] + model.weights[1] * evidence
        assert abs(r.score - 1 / (1 + math.exp(-min(30, max(-30, z))))) < 1e-4


def test_counts_against_brute_force(spark, monkeypatch):
    rows, _ = corpus(30)
    want = Counter(int.from_bytes(g, "big", signed=True) for _, t in rows for w in set(t.split()) for g in grams(w))
    texts = spark.createDataFrame([(t, 0) for _, t in rows], "text string, counted_as int").repartition(4)
    assert {r.key: r.n_all for r in toxicity.expression_counts(texts).collect()} == want


def test_a_task_that_holds_few_words_counts_the_same(monkeypatch):
    import pandas as pd

    rows, _ = corpus(30)
    batches = [pd.DataFrame({"text": [t], "counted_as": [k % 3]}) for k, t in rows]
    whole = pd.concat(toxicity._count_partition(iter(batches))).set_index("key").sort_index()
    monkeypatch.setattr(toxicity, "HELD_WORDS", 20)
    parts = list(toxicity._count_partition(iter(batches)))
    assert len(parts) > 3
    assert pd.concat(parts).groupby("key").sum().equals(whole)


def test_shared_backoff_is_a_distribution(spark):
    rows, _ = corpus(50)
    texts = spark.createDataFrame([(t, 0) for _, t in rows], "text string, counted_as int")
    shared = toxicity.shared_backoff(toxicity.expression_counts(texts)).collect()
    sums = defaultdict(float)
    for r in shared:
        sums[r.key >> 8] += r.shared
    # what no expression of a context has is left for bytes never seen at all
    assert all(0 < s < 1 + 1e-9 for s in sums.values())


def test_words():
    assert toxicity.words_of(None) == [] == toxicity.words_of(" \0 ")
    assert toxicity.words_of("A b\0C　d") == ["a", "b", "c", "d"]


def test_odd_rows_and_missing_classes(spark):
    docs = odd_documents(spark)
    marks = spark.createDataFrame([(1, 1), (1, 0), (7, 0), (8, 0), (None, 1), (5, None), (9, 1)], "doc_id long, toxic int")
    assert len(toxicity.score(docs, marks).collect()) == docs.count()
    assert len(toxicity.score(docs, marks, model_rows=0).collect()) == docs.count()
    none = spark.createDataFrame([], "doc_id long, toxic int")
    assert {r.score for r in toxicity.score(docs, none).collect()} == {0.0}
    assert toxicity.drop_toxic(docs, none).count() == docs.count()
    assert toxicity.score(no_documents(spark), marks).collect() == []
