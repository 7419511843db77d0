"""The pipeline, stage by stage, against what each stage promises."""

from __future__ import annotations

import numpy as np
import pytest

import corpus_pipeline
from siltwork.llm import queries, simhash
from siltwork.llm.common import saved


@pytest.fixture(scope="module")
def stages(spark, data_dir):
    frames = [spark.read.parquet(f"{data_dir}/documents.parquet")]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(saved(stage(spark, frames[-1], data_dir), "test-stage"))
    return frames


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.collect()]


def test_order_and_columns(stages):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "quality_classifier", "simhash_near_dedup", "mixing", "sentencepiece"]
    for f in stages[:-1]:
        assert f.columns == stages[0].columns and f.schema == stages[0].schema


def test_filters_only_take_away(stages):
    for before, after in zip(stages[:3], stages[1:4]):
        assert set(texts(after)) <= set(texts(before)) and 0 < after.count()


def test_good_documents_stay(stages, spark, data_dir):
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{data_dir}/labels.parquet").collect()}
    kept = {k for k, _ in texts(stages[2])}
    good = [k for k, _ in texts(stages[1]) if labels.get(k) == 1]
    assert sum(k in kept for k in good) >= 0.97 * len(good)


def test_one_of_each_group_stays(stages):
    values = {}
    for k, t in texts(stages[2]):
        values.setdefault(simhash.fingerprint(t), set()).add(k)
    kept = {k for k, _ in texts(stages[3])}
    left = [simhash.fingerprint(t) for _, t in texts(stages[3])]
    assert len(left) == len(set(left)) and all((a ^ b).bit_count() > 4 for n, a in enumerate(left) for b in left[:n])
    assert all(len(ids & kept) <= 1 for ids in values.values())


def test_tokens_are_the_library_s(stages):
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=queries.tokenizer_file("piece_bpe_32k.model"))
    by_id = dict(texts(stages[4]))
    rows = stages[5].collect()
    assert len(rows) == stages[4].count()
    for r in rows[:40]:
        assert r.ids == library.encode(by_id[r.doc_id], add_bos=True, add_eos=True)


def test_run(spark, data_dir, stages):
    out = corpus_pipeline.run(spark, data_dir).collect()
    key = lambda rows: sorted((r.doc_id, r.ids_sha256) for r in rows)
    assert key(out) == key(stages[5].collect()) and np.all([r.n_tokens >= 2 for r in out])


def test_stages_on_odd_rows_and_an_empty_table(spark, data_dir):
    """Nulls in any column, empty and long texts, repeats, null ids and extra columns with clashing names."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, id string, salt string, copies string, label string"
    odd = [
        (1, None, "en", "a"), (2, "", None, None), (3, "word " * 30000, "en", "a"), (4, "the same text twice over and over", "fr", "b"), (4, "the same text twice over and over", "fr", "b"),
        (None, "no id here at all", "en", None), (6, " \t\n", "de", ""), (4, "another text under the same id", "xx", "b"),
    ]
    docs = spark.createDataFrame([(*r, None, "x", "x", "x", "x") for r in odd], schema)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, data_dir)
        assert out.count() <= 3 * len(odd), name
        if name != "sentencepiece":
            assert out.columns == docs.columns and out.schema == docs.schema
        assert stage(spark, docs.limit(0), data_dir).count() == 0, name
    kept = corpus_pipeline.near_dedup(spark, docs, data_dir).collect()
    assert sorted((r.doc_id or 0, (r.text or "")[:7]) for r in kept) == [(0, "no id h"), (1, ""), (3, "word wo"), (4, "another"), (4, "the sam")]
