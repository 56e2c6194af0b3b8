"""The corpus pipeline: each stage on its predecessor's rows, against plain versions."""

import corpus_pipeline
from skillgrid.llm import factorisation
from skillgrid.llm.common import materialize, read
from tests.conftest import SF
from tests.llm.test_lines_rules import plain_lines
from tests.llm.test_simhash import plain_fp, plain_groups


def test_stages(spark):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "simhash", "decontamination", "mixing"]
    stages = dict(corpus_pipeline.STAGES)
    docs = read(spark, SF, "documents")
    step = lambda name, df: materialize(spark, stages[name](spark, df, SF), "test_stage")

    q = step("quality", docs)
    assert q.schema == docs.schema
    model = factorisation.train(docs, read(spark, SF, "labels"))
    rows = docs.collect()
    keep = []
    for r in rows:
        at, x = factorisation.features(r.text, r.n_chars)
        if model.scores(at, x, [0])[0] >= 0.3:
            keep.append(r)
    assert sorted(q.collect()) == sorted(keep) and len(keep) < len(rows)

    lines = step("line_dedup", q)
    assert lines.schema == docs.schema
    want = {r.doc_id: w[2] for r, w in zip(keep, plain_lines([r.text for r in keep], 10))}
    got = lines.collect()
    assert {r.doc_id: r.text for r in got} == want and all(r.n_chars == len(r.text) for r in got)

    near = step("simhash", lines)
    got = sorted(got, key=lambda r: r.doc_id)
    groups = plain_groups([plain_fp(r.text) for r in got], 4)
    first = sorted(got[i].doc_id for i in set(groups))
    assert sorted(r.doc_id for r in near.collect()) == first and near.columns == docs.columns

    clean = step("decontamination", near)
    bench = [r.text for r in read(spark, SF, "benchmark").collect()]
    before, after = near.collect(), {r.doc_id for r in clean.collect()}
    for r in before:
        if any(b in r.text for b in bench):
            assert r.doc_id not in after
    assert len(before) - len(after) <= 2 + sum(any(b.lower() in r.text.lower() for b in bench) for r in before)
    assert clean.columns == docs.columns

    mixed = step("mixing", clean)
    assert set(docs.columns) < set(mixed.columns)
    out = mixed.collect()
    assert {r.doc_id for r in out} == {d for d in after} - {r.doc_id for r in clean.collect() if r.doc_id not in {o.doc_id for o in out}}
    assert all(r.copies >= 1 and r.rate > 0 for r in out)


def test_empty_corpus(spark):
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(spark, stage(spark, docs, SF), f"test_{name}")
    assert docs.count() == 0
