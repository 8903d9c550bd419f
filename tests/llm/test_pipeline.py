import numpy as np

import corpus_pipeline

from .fixtures import no_documents, odd_documents, prose
from .test_toxicity import corpus


def test_stages_on_planted_documents(spark, tmp_path):
    rows, labels = corpus(400)
    rng = np.random.default_rng(0)
    item = " ".join(f"q{n}" for n in rng.integers(0, 500, 30))
    copies = [(1000 + k, rows[1][1]) for k in range(5)]
    leaked = [(2000, rows[5][1] + " " + item), (2001, rows[6][1] + " " + item.upper())]
    docs = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in rows + copies + leaked]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, frame, str(tmp_path))
        if name != "token_store":
            assert out.columns == corpus_pipeline.COLUMNS
        out.write.parquet(f"{tmp_path}/{name}")
        frame = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in frame.select("doc_id").collect()}
    toxic = {k for k, y in labels if y}
    assert len(kept["toxicity"] & toxic) <= 0.1 * len(toxic)
    assert len({k for k, y in labels if not y} - kept["toxicity"]) <= 0.02 * len(labels)
    assert not {c[0] for c in copies} & kept["near_dedup"] and 1 in kept["near_dedup"]
    assert {2000, 2001} <= kept["near_dedup"] and not {2000, 2001} & kept["decontamination"]
    assert kept["decontamination"] == kept["near_dedup"] - {2000, 2001}
    mixed = spark.read.parquet(f"{tmp_path}/mixing")
    stored = spark.read.parquet(f"{tmp_path}/token_store")
    assert stored.count() == mixed.count()
    starts = [tuple(r) for r in stored.select("start", "n_tokens").orderBy("start").collect()]
    assert all(a[0] + a[1] == b[0] for a, b in zip(starts, starts[1:], strict=False))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == stored.count()


def test_stages_on_odd_and_no_documents(spark, tmp_path):
    spark.createDataFrame([(1, 1), (7, 0), (8, 0), (9, 1), (None, None)], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, prose(7, 20)), (None, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (odd_documents(spark), no_documents(spark)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, str(tmp_path))
            if name != "token_store":
                assert out.columns == corpus_pipeline.COLUMNS
            out.collect()
