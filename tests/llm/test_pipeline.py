"""The corpus pipeline, each stage on its own input, and the stages' handling of odd rows."""

import corpus_pipeline as P
from postmill.llm import quality
from postmill.llm.common import read
from postmill.llm.queries import tokenizer
from tests_support import components_of, packed_whole, source_targets, stripped_base


def test_stages(spark, sf):
    docs = read(spark, sf, "documents")
    kept = [docs]
    for _, stage in P.STAGES:
        out = stage(spark, kept[-1], sf)
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    good, single, clean, mixed, packed = kept[1:]
    assert all(d.columns == list(P.DOCUMENTS) for d in (good, single, clean, mixed))
    # quality: exactly what the model accepts, and nearly all that is labelled good
    model = quality.learn(docs, read(spark, sf, "labels"))
    accepted = {r["doc_id"] for r in quality.score(docs, model).where("predicted = 1").collect()}
    assert {r["doc_id"] for r in good.collect()} == accepted
    labels = {r["doc_id"]: r["quality"] for r in read(spark, sf, "labels").collect()}
    assert sum(i in accepted for i, y in labels.items() if y) >= 0.97 * sum(labels.values())
    assert sum(i in accepted for i, y in labels.items() if not y) <= 0.1 * sum(not y for y in labels.values())
    # near duplicates: one of each component
    texts = {r["doc_id"]: r["text"] for r in good.collect()}
    parts = components_of(texts, 5)
    left = [r["doc_id"] for r in single.collect()]
    assert sorted(left) == sorted({parts[i] for i in texts})
    # secrets: no base secret is left, and texts without one are as they were
    before = {r["doc_id"]: r["text"] for r in single.collect()}
    for r in clean.collect():
        assert stripped_base(before[r["doc_id"]]) is None or r["text"] != before[r["doc_id"]]
        assert stripped_base(r["text"]) is None and (stripped_base(before[r["doc_id"]]) or r["text"] == before[r["doc_id"]])
    # mixing: words per source come near the targets
    for taken, target, longest in source_targets(clean.collect(), mixed.collect()):
        assert abs(taken - target) <= longest / 2 + 1
    # packing: each row's ids once
    packed_whole(packed.collect(), mixed.collect(), tokenizer())


def test_run_is_the_stages_in_order(spark, sf):
    assert [n for n, _ in P.STAGES] == ["quality", "near_duplicates", "secrets", "mixing", "packing"]
    rows = P.run(spark, sf)
    assert rows.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and rows.count() > 0


def test_stages_take_odd_rows(spark, sf, odd_docs, no_docs):
    for name, stage in P.STAGES[1:]:
        assert stage(spark, odd_docs, sf).count() > 0, name
        assert stage(spark, no_docs, sf).count() == 0, name
    assert P.good_quality(spark, no_docs, sf).count() == 0
    assert P.good_quality(spark, odd_docs, sf).columns == list(P.DOCUMENTS)


def test_ordinary_text_is_not_masked(spark):
    text = "Read https://example.org/docs/api3/install/kernel/python3/linux first. Then call getUserAccountBalanceById3() twice, with id 123e4567-e89b-12d3-a456-426614174000."
    docs = spark.createDataFrame([(1, text, "en", "a", len(text)), (2, text + " token = hunter2hunter2", "en", "a", 1)], "doc_id bigint, text string, lang string, source string, n_chars bigint")
    rows = {r["doc_id"]: r for r in P.without_secrets(spark, docs, "").collect()}
    assert rows[1]["text"] == text and rows[1]["n_chars"] == len(text) and rows[2]["text"] == text + " [SECRET]"
