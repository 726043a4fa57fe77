"""The pipeline's stages, each on what its predecessor kept."""

import sys
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

import corpus_pipeline  # noqa: E402


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").cache()
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        kept[name] = (docs, out)
        docs = out
        if name != "packing":
            assert out.columns == columns, name
    assert list(kept) == ["quality rules", "line dedup", "near-dedup", "mixing", "packing"]
    before, after = kept["quality rules"]
    verdict = brute.quality([(r["doc_id"], r["source"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, v in verdict.items() if v[-1]}
    before, after = kept["near-dedup"]
    components = brute.components([(r["doc_id"], r["text"]) for r in before.collect()])
    assert {r["doc_id"] for r in after.collect()} == {i for i, (_, c) in components.items() if i == c}
    before, after = kept["mixing"]
    size = lambda df: sum(len(brute.words(r["text"])) for r in df.collect())
    assert size(after) <= corpus_pipeline.MIX_SHARE * size(before) + 1e-6
    assert max(Counter(r["doc_id"] for r in after.collect()).values()) == 1
    packed = kept["packing"][1].collect()
    assert {r["doc_id"] for r in packed} == {r["doc_id"] for r in after.collect()} and all(r["offset"] + r["length"] <= 2048 for r in packed)


def test_run(spark, sf_dir):
    assert corpus_pipeline.run(spark, sf_dir).count() > 0
