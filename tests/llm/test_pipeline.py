"""The pipeline's stages one after the other, each against what it must keep."""

import corpus_pipeline
from loomstone.llm import decontam, langid
from loomstone.llm.common import materialize

from .test_corpus_operators import jaccard_groups


def test_stages(spark, sf_dir, docs):
    now, columns = docs, docs.columns
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        out = materialize(stage(spark, now, sf_dir), "test")
        seen[name] = (now, out)
        if name != "bpe":
            assert out.columns == columns and out.schema == docs.schema
            now = out
    before, after = seen["language_id"]
    has_letter = {r.doc_id for r in before.collect() if any(map(str.isalpha, r.text or ""))}
    assert ids(after) == has_letter
    before, after = seen["line_dedup"]
    assert ids(before) == ids(after) and all(r.n_chars == len(r.text) for r in after.collect())
    before, after = seen["near_dedup"]
    rows = sorted(before.collect(), key=lambda r: r.doc_id)
    first = {}
    for r, group in zip(rows, jaccard_groups([r.text for r in rows]), strict=True):
        first.setdefault(group, r.doc_id)
    assert len(first) < len(rows) and ids(after) == set(first.values())
    before, after = seen["decontamination"]
    hit = {r.doc_id for r in decontam.contamination(before, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).filter("n_hit > 0").collect()}
    assert hit and ids(after) == ids(before) - hit
    before, after = seen["bpe"]
    assert ids(before) == ids(after)
    assert langid.NO_LANGUAGE == "und"


def test_run(spark, sf_dir):
    out = corpus_pipeline.run(spark, sf_dir)
    assert out.count() > 0 and {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"} <= set(out.columns)
