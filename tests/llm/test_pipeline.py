"""The pipeline's stages on awkward documents and on the sample."""

from __future__ import annotations

import corpus_pipeline
from cairnfield.llm.common import cut
from tests.conftest import SF_SMALL
from tests.llm import fixtures


def test_stages_on_awkward_documents(spark):
    docs = fixtures.awkward(spark).select("doc_id", "text", "lang", "source", "n_chars")
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = cut(stage(spark, docs, SF_SMALL), name)
        if k < 4:
            assert docs.columns == before.columns, name
            assert docs.subtract(before).count() == 0, name
    assert docs.count() > 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL).collect()
    assert len({(r.shard, r.slot) for r in out}) == len(out) > 100
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_dedup", "decontamination", "mix_sources", "sharding"]
