"""The pipeline against the same decisions taken plainly."""

import corpus_pipeline
from chunkloom.llm import decontamination, near_dedup, quality
from chunkloom.llm.common import documents, table

DATA = "/root/testdata/sf0.001"


def test_run(spark):
    docs = documents(spark, DATA)
    texts = {r.doc_id: r.text for r in docs.collect()}
    labels = table(spark, DATA, "labels").where(~quality.held_out())
    left = {r.doc_id for r in quality.score(docs, quality.train(docs, labels)).where("score >= 0.3").collect()}
    newest = {}
    for i in sorted(left):
        newest[texts[i].encode().lower()] = i
    left = set(newest.values())
    sets = {i: near_dedup.shingle_set(near_dedup.words_of(texts[i]), 5) for i in left}
    root = {i: i for i in left}
    for i in sorted(left):
        for j in sorted(left):
            both = len(sets[i] & sets[j])
            if i < j and both and 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                a, b = root[i], root[j]
                root = {k: min(a, b) if v in (a, b) else v for k, v in root.items()}
    left = {i for i in left if root[i] == i}
    index = decontamination.Index([(r.item_id, r.text) for r in table(spark, DATA, "benchmark").collect()])
    left = {i for i in left if not index.matches([texts[i]])}
    assert {r.doc_id for r in corpus_pipeline.run(spark, DATA).collect()} == left
