"""The pipeline's stages: each takes all that the one before kept, and its decisions take effect."""

import os

import corpus_pipeline as p
from test_near_copies import brute_pairs, groups

from lodestone.llm import decontaminate, quality_rules, secrets
from lodestone.llm.common import saved, shared_dir


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    kept = [docs.persist()]
    for k, (_, stage) in enumerate(p.STAGES):
        kept.append(stage(spark, kept[-1], sf_dir).persist())
        assert kept[-1].columns == columns or k == len(p.STAGES) - 1
    ids = [{r.doc_id for r in d.select("doc_id").collect()} for d in kept]
    assert ids[1] == {r.doc_id for r in quality_rules.quality_measures(kept[0]).collect() if r.kept}
    # Near copies are those of the brief's five words and similarity of 0.8, found here by comparing all pairs.
    rows = [(r.doc_id, r.text) for r in kept[1].collect()]
    component = groups(ids[1], brute_pairs(rows))
    assert len(set(component.values())) < len(rows) and ids[2] == set(component.values())
    leaks = {r.doc_id for r in decontaminate.contained_items(kept[2], spark.read.parquet(f"{sf_dir}/benchmark.parquet")).collect()}
    assert leaks and ids[3] == ids[2] - leaks
    assert ids[4] == ids[5] == ids[3]
    assert all(not secrets.base_spans(r.text) and r.n_chars == len(r.text) for r in kept[4].collect())
    assert all(r.round_trip for r in kept[5].collect())


def test_run(spark, sf_dir):
    a, b = p.run(spark, sf_dir), p.run(spark, sf_dir)
    left = [n for n in os.listdir(shared_dir(spark).removeprefix("file:")) if n.startswith(("pipeline-", "near-"))]
    assert len([n for n in left if n.startswith("pipeline-sentencepiece")]) >= 2 and not [n for n in left if n.startswith("pipeline-") and "sentencepiece" not in n]
    assert sorted(map(repr, a.collect())) == sorted(map(repr, b.collect())) and a.count() > 0


def test_awkward_rows(spark, sf_dir, awkward, no_documents):
    """Nulls, repeats, ties and columns of the operators' own names go through all stages; so does a table without rows."""
    for rows in (awkward, no_documents):
        kept = rows
        for name, stage in p.STAGES[:-1]:
            kept = saved(stage(spark, kept, sf_dir), f"awkward-{name}")
            assert kept.columns == awkward.columns
        out = p.STAGES[-1][1](spark, kept, sf_dir)
        assert out.count() == kept.count()
        ids = {r.doc_id for r in kept.collect()}
        assert ids <= {5, 7, 8, None} and (7 in ids or rows is no_documents)
