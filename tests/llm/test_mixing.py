import math
from collections import defaultdict

from eigenloom.llm import mixing

from .fixtures import no_documents, odd_documents, prose


def level(sizes: dict, weights: dict, cap: int) -> dict:
    """Water filling, one capped source at a time."""
    total, capped = sum(sizes.values()), set()
    while True:
        rest = total - sum(cap * sizes[s] for s in capped)
        open_weight = sum(weights[s] for s in sizes if s not in capped)
        share = {s: rest * weights[s] / open_weight for s in sizes if s not in capped} if open_weight else {}
        over = {s for s in share if share[s] > cap * sizes[s]}
        if not over:
            return {s: float(cap * sizes[s]) if s in capped else share[s] for s in sizes}
        capped |= over


def by_hand(rows):
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += len((text or "").encode().split())
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    return sizes, level(dict(sizes), {s: (1, 2, 3)[k % 3] for k, s in enumerate(order)}, 3)


def check(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = mixing.mix(docs).collect()
    sizes, targets = by_hand(rows)
    assert len(got) == len(rows)
    taken = defaultdict(int)
    for r in got:
        assert r.source_size == sizes[r.source]
        assert math.isclose(r.target, targets[r.source], rel_tol=1e-9, abs_tol=1e-9)
        assert r.taken == r.epochs * r.size + r.partial <= 3 * r.size
        taken[r.source] += r.taken
    for s in sizes:
        assert abs(taken[s] - targets[s]) <= 0.5 + 1e-9
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs.repartition(3)).collect()))


def test_targets_and_cuts_against_water_filling(spark):
    rows = [(k, prose(k, 5 + k % 40), f"s{k % 3}") for k in range(200)] + [(900 + k, prose(k, 3), f"t{k}") for k in range(12)]
    check(spark, rows + [(1000, prose(5, 900), None), (None, "a b", "s1"), (None, None, "s2")])


def test_a_source_with_most_rows(spark):
    check(spark, [(k, prose(k, 1 + k % 9), "hot" if k % 10 else f"c{k % 4}") for k in range(1500)])


def test_weights_of_ones_own(spark):
    docs = spark.createDataFrame([(k, prose(k, 10), "ab"[k % 2]) for k in range(40)], "doc_id long, text string, source string")
    weights = spark.createDataFrame([("a", 3.0)], "source string, weight double")
    got = mixing.mix(docs, weights).collect()
    assert {r.source for r in got} == {"a"} and sum(r.taken for r in got) == 200


def test_odd_rows_and_copies(spark):
    docs = odd_documents(spark)
    assert len(mixing.mix(docs).collect()) == docs.count()
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    plan = mixing.mix(docs).collect()
    copies = sum(1 if r.size == 0 else r.epochs + (r.partial > 0) for r in plan)
    rows = mixed.collect()
    assert len(rows) == copies
    assert sum(len((r.text or "").encode().split()) for r in rows) == sum(r.taken for r in plan)


def test_no_rows_and_no_words(spark):
    assert mixing.mix(no_documents(spark)).collect() == []
    blank = spark.createDataFrame([(1, None, "a"), (2, " ", None)], "doc_id long, text string, source string")
    assert {(r.doc_id, r.target, r.taken) for r in mixing.mix(blank).collect()} == {(1, 0.0, 0), (2, 0.0, 0)}


def test_columns_of_any_name(spark):
    docs = spark.createDataFrame([(k, prose(k, 9), "ab"[k % 2], k, "x") for k in range(20)], "`doc.id` long, `the text` string, `a.source` string, `a.b` long, payload string")
    mixed = mixing.mixed_documents(docs, id_col="doc.id", text_col="the text", source_col="a.source")
    assert mixed.columns == docs.columns
    assert {r["a.b"] for r in mixed.collect()} <= set(range(20))
