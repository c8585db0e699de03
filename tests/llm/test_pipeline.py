"""The pipeline against its stages done plainly, on the smallest tables."""

import corpus_pipeline
from leafgrade.llm import decontamination, secret_scan, toxicity
from leafgrade.llm.common import table
from leafgrade.llm.decontamination import contaminated
from leafgrade.llm.toxicity import score_toxicity
from tests.llm.test_duplicates import plain_components
from tests.llm.test_mixing import targets

SF = "/root/testdata/sf0.001"


def test_pipeline_equals_plain_stages(spark):
    docs = table(spark, SF, "documents")
    left = {r.doc_id: r for r in docs.collect()}
    toxic = {r.doc_id for r in score_toxicity(docs, table(spark, SF, "labels")).where("predicted = 1").collect()}
    left = {i: r for i, r in left.items() if i not in toxic}
    part = plain_components([(i, r.text) for i, r in left.items()], 5)
    left = {i: r for i, r in left.items() if part[i][1] == i}
    leaks = {r.doc_id for r in contaminated(docs, table(spark, SF, "benchmark")).collect()}
    left = {i: r for i, r in left.items() if i not in leaks}
    size, source_size = {}, {}
    for i, r in left.items():
        text = r.text
        for _, a, b in sorted((s for part in secret_scan.scan(text, 8.0) for s in part), key=lambda s: -s[1]):
            text = text[:a] + "[secret]" + text[b:]
        size[i] = len(text.split())
        source_size[r.source] = source_size.get(r.source, 0) + size[i]
    want = targets(source_size)
    got = {r.doc_id: r for r in corpus_pipeline.run(spark, SF).collect()}
    assert set(got) <= set(left) and all(r.size == size[i] and 0 < r.taken <= 3 * size[i] for i, r in got.items())
    for s, goal in want.items():
        assert abs(sum(r.taken for r in got.values() if r.source == s) - goal) <= 64


def test_stages_keep_the_columns(spark):
    docs = table(spark, SF, "documents").limit(40)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, SF).columns == docs.columns
        assert stage(spark, docs.limit(0), SF).count() == 0


def test_rows_of_one_id_go_for_their_own_text(spark, docs_frame):
    item = " ".join(f"leak{i}" for i in range(40))
    docs = docs_frame([(i, None if i == 3 else f"nice {'filth' if i % 2 else 'calm'} {i}") for i in range(60)] + [(None, "calm a"), (None, "filth"), (70, "calm b"), (70, "filth"), (None, item), (70, item)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, toxic int")
    clean = toxicity.drop_toxic(docs, labels)
    assert sorted(r.text for r in clean.where("doc_id IS NULL OR doc_id = 70").collect()) == ["calm a", "calm b", item, item]
    benchmark = spark.createDataFrame([(1, item)], "item_id long, text string")
    left = decontamination.drop_contaminated(docs, benchmark)
    assert sorted(r.text for r in left.where("doc_id IS NULL OR doc_id = 70").collect()) == ["calm a", "calm b", "filth", "filth"]
    assert left.where("text IS NULL").count() == 1 and clean.columns == left.columns == docs.columns
