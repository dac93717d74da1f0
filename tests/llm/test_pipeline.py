"""The pipeline's stages against what each should keep, and the queries with SQL against the oracle."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.fixtures import corpus, frame
from tests.llm.test_operators import brute_passages, brute_repetition, groups
from tests.oracle import connect, differences
from tidewell.llm import queries


def test_pipeline(spark, tmp_path):
    rows = corpus(n=80)
    frame(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    stages = dict(corpus_pipeline.STAGES)
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        kept[name] = {r.doc_id: r.text for r in docs.collect()}
    by_rules = {}
    for r in rows:
        n, _, _, _, repeated, longest = brute_repetition(r[1]) if not (r[1] or "").startswith("na na") else (3000, 0, 0, 0, 3000, 2999)
        if n >= 20 and 100 * repeated <= 30 * n and longest <= 100:
            by_rules[r[0]] = r
    assert set(kept["quality_rules"]) == set(by_rules)
    assert kept["language"] == kept["quality_rules"]
    left = [by_rules[i] for i in sorted(kept["language"])]
    firsts = {c for _, c in groups(left, 5).values()}
    assert set(kept["near_dedup"]) == firsts
    left = [r for r in left if r[0] in firsts]
    sizes = brute_passages(left, 100)
    for doc, text, *_ in left:
        assert len(text.encode()) - sizes[doc][1] - 6 <= len(kept["passage_dedup"][doc].encode()) <= len(text.encode()) - sizes[doc][1]
    packed = stages["packing"](spark, docs, str(tmp_path)).collect()
    assert {r.doc_id for r in packed} == firsts
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in packed)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, name):
    directory = "/root/testdata/sf0.001"
    assert differences(connect(directory), queries.ORACLES[name], queries.QUERIES[name](spark, directory).select(*columns(name, directory))) == ""


def columns(name, directory):
    return [d[0] for d in connect(directory).execute(f"DESCRIBE {queries.ORACLES[name]}").fetchall()]


def test_every_operator_is_registered():
    import __spark_entry__

    names = __spark_entry__.queries()
    assert [sum(n.startswith(f"op{i}_") for n in names) for i in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert np.array([callable(f) for f in names.values()]).all()
