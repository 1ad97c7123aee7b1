from collections import Counter, defaultdict

import corpus_pipeline as c

from quantloom.llm import pii, quality
from quantloom.llm.shared import stash

from .test_decontaminate import brute as windows_of
from .test_jaccard import brute as groups_of
from .test_tokens import check_packing

FOLDER = "/root/testdata/sf0.001"


def test_stages_against_plain_versions(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    items = [tuple(r) for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    columns = docs.columns
    model = quality.fit(docs, spark.read.parquet(f"{FOLDER}/labels.parquet"))
    margins = quality.Margins(model)
    before = {r.doc_id: r for r in docs.collect()}

    step = stash(c.STAGES[0][1](spark, docs, FOLDER))
    assert step.columns == columns
    after = {r.doc_id: r for r in step.collect()}
    assert after == {i: r for i, r in before.items() if margins.scores([r.text or ""])[0] >= 0.3}

    before, step = after, stash(c.STAGES[1][1](spark, step, FOLDER))
    after = {r.doc_id: r for r in step.collect()}
    keep = {i for i, _, k in groups_of([(i, r.text) for i, r in before.items()]) if i == k}
    assert step.columns == columns and after == {i: before[i] for i in keep}

    before, step = after, stash(c.STAGES[2][1](spark, step, FOLDER))
    after = {r.doc_id: r for r in step.collect()}
    assert step.columns == columns
    for i, r in before.items():
        n, hit, _ = windows_of(r.text, items)
        assert (i in after) == (hit <= n / 2)
        if i in after:
            assert (after[i].text == r.text) == (hit == 0)
            assert windows_of(after[i].text, [])[0] == n - hit and after[i].n_chars == len(after[i].text)

    before, step = after, stash(c.STAGES[3][1](spark, step, FOLDER))
    after = {r.doc_id: r for r in step.collect()}
    assert step.columns == columns and after.keys() == before.keys()
    for i, r in before.items():
        spans = pii.base_spans(r.text)
        assert (after[i].text == r.text) if not spans else not pii.base_spans(after[i].text)

    last = c.STAGES[4][1](spark, step, FOLDER)
    check_packing(last.collect(), list(after.values()), 2048)
    assert Counter(map(tuple, c.run(spark, FOLDER).drop("sequence_id", "offset").collect())) == Counter(map(tuple, last.drop("sequence_id", "offset").collect()))


def test_odd_and_empty_documents(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        for name, stage in c.STAGES:
            out = stash(stage(spark, docs, FOLDER))
            assert name == "best_fit_packing" or out.columns == docs.columns
            docs = docs if name == "best_fit_packing" else out
        sequences = defaultdict(int)
        for r in out.collect():
            sequences[r.sequence_id] += r.length
        assert all(n <= 2048 for n in sequences.values())


def test_columns_with_an_operators_names(spark, odd_docs):
    docs = odd_docs.withColumns({n: odd_docs["source"] for n in ("score", "_score", "row", "component_id", "spans", "predicted")})
    for name, stage in c.STAGES[:4]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns and out.count() > 0, name
