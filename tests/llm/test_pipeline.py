import re

import corpus_pipeline
from strandline.llm import quality_rules
from tests.llm.test_near_dedup import plain

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_stages_against_plain_models(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, seen = docs.columns, [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, seen[-1], sf).write.parquet(f"{tmp_path}/{k}")
        seen.append(spark.read.parquet(f"{tmp_path}/{k}"))
    start, ruled, single, stripped, mixed, packed = seen
    assert all(x.columns == columns for x in seen[:-1])
    good = {r.doc_id for r in quality_rules.apply_policy(quality_rules.ledger(start), quality_rules.STRICT).where("kept").collect()}
    assert {r.doc_id for r in ruled.collect()} == good
    texts = [(r.doc_id, r.text) for r in ruled.collect()]
    assert {r.doc_id for r in single.collect()} == set(plain(texts, 5).values())
    before, after = ({r.doc_id: r.text for r in x.collect()} for x in (single, stripped))
    assert before.keys() == after.keys() and all(len(after[i]) <= len(before[i]) for i in before)
    windows = {}
    for text in after.values():
        data = text.encode()
        assert "�" not in text and len(data) <= len(text.encode())
    for text in before.values():
        data = text.encode()
        for i in range(len(data) - 199):
            windows[data[i:i + 200]] = windows.get(data[i:i + 200], 0) + 1
    untouched = {i for i, t in before.items() if not any(windows[t.encode()[j:j + 200]] > 1 for j in range(len(t.encode()) - 199))}
    assert {i for i in before if before[i] == after[i]} == untouched
    size = {r.doc_id: len(WORD.findall(r.text)) for r in stripped.collect()}
    taken = {}
    for r in mixed.collect():
        taken[r.doc_id] = taken.get(r.doc_id, 0) + len(WORD.findall(r.text))
    assert all(taken[i] <= 3 * size[i] for i in taken) and abs(sum(taken.values()) - sum(size.values())) < 25
    assert packed.count() == mixed.count()


def test_empty_corpus_passes_through(spark, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, "")
        assert docs.count() == 0
