"""Every stage of the pipeline against the operator's own report on the stage's input."""

import corpus_pipeline as pipeline
from moneytrail.llm.common import table, written
from moneytrail.llm.line_runs import line_dedup
from moneytrail.llm.mixing import mix
from moneytrail.llm.near_shingles import similar_documents
from moneytrail.llm.quality import quality_report


def test_stages(spark, tiny):
    docs = table(spark, tiny, "documents")
    columns, ids = docs.columns, lambda df: sorted(r[0] for r in df.select("doc_id").collect())
    good = written(pipeline.quality(spark, docs, tiny), "quality")
    assert good.columns == columns
    assert ids(good) == sorted(r.id for r in quality_report(docs).where("kept").collect())
    cleaned = written(pipeline.lines(spark, good, tiny), "lines")
    assert cleaned.columns == columns
    assert {(r.doc_id, r.text) for r in cleaned.collect()} == {(r.doc_id, r.text) for r in line_dedup(good).collect()}
    one = written(pipeline.near(spark, cleaned, tiny), "near")
    assert one.columns == columns
    assert ids(one) == sorted({r.component for r in similar_documents(cleaned).collect()})
    mixed = written(pipeline.mixed(spark, one, tiny), "mixed")
    assert mixed.columns == columns and ids(mixed) == ids(one)
    slots = {r.doc_id: (r.mixed.slot, r.mixed.place) for r in mix(one).collect()}
    order = [slots[r[0]] for r in pipeline.mixed(spark, one, tiny).select("doc_id").collect()]
    assert order == sorted(order)
    rows = pipeline.packed(spark, mixed, tiny).collect()
    assert {r.doc_id for r in rows} == set(ids(mixed)) and max(r.start + r.length for r in rows if r.bin is not None) <= pipeline.CAPACITY


def test_odd_rows_and_an_empty_table(spark):
    rows = [(1, "a b c " * 9, "en", "s", 1), (1, "a b c " * 9, "en", "s", 1), (None, None, None, None, None), (2, "", None, None, 0),
            (3, "one two three four five six seven eight nine ten eleven", "en", None, 5)]
    for data in (rows, []):
        docs = spark.createDataFrame(data, "doc_id long, text string, lang string, source string, n_chars long")
        for name, stage in pipeline.STAGES:
            docs = written(stage(spark, docs, ""), name.replace(" ", "-"))
        assert docs.count() <= len(data)
