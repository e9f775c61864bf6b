"""The stages on planted documents, each judged on its own input."""

from __future__ import annotations

import os

import numpy as np
import pytest

import corpus_pipeline

WORDS = [a + b + c for a in ("ka", "lo", "mi", "nu", "re") for b in ("ta", "se", "vi", "do", "pu") for c in ("n", "r", "s", "l")]


def text(seed: int, n: int) -> str:
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    base, passage = text(1, 200), text(77, 40)
    near = base.split()
    near[100] = "other"
    rows = [(i, text(i + 10, 100 + i)) for i in range(20)] + [(30, base), (31, base), (32, " ".join(near)), (40, text(40, 60) + " " + passage), (50, "short"), (51, None), (52, "again and again " * 60)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    path = str(tmp_path_factory.mktemp("data"))
    docs.write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    gone, columns = {}, docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = {r.doc_id: r.text for r in docs.collect()}
        out = str(tmp_path / str(k))
        stage(spark, docs, folder).write.parquet(out)
        docs = spark.read.parquet(out)
        after = {r.doc_id: r.text for r in docs.collect()}
        gone[name] = set(before) - set(after)
        assert all(before[i] == t for i, t in after.items())
        assert k == len(corpus_pipeline.STAGES) - 1 or docs.columns == columns
    assert gone == {"quality_rules": {50, 51, 52}, "jaccard_join": {31, 32}, "decontaminate": {40}, "piece_lattice": set()}
    assert docs.filter("n_pieces <> size(ids)").count() == 0
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, folder).collect()) == sorted(after)


def test_empty_documents(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    path = str(tmp_path / "none")
    docs.limit(0).write.parquet(f"{path}/documents.parquet")
    spark.read.parquet(f"{folder}/benchmark.parquet").write.parquet(f"{path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, path).count() == 0


def test_queries_are_registered():
    import __spark_entry__ as entry

    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 14))
    assert set(entry.oracle_sql()) <= set(names)
    assert os.path.exists(os.path.join(os.path.dirname(entry.__file__), "corpus_pipeline.py"))
