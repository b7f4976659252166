import corpus_pipeline
from weftline.llm import contamination, pii, quality, simhash
from weftline.session import stage

SF = "/root/testdata/sf0.001"


def test_stages_by_their_plain_meaning(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "near duplicates", "decontamination", "personal data", "best-fit packing"]
    at = docs
    for (name, function), expected in zip(corpus_pipeline.STAGES[:4], (
        lambda d: {r.doc_id for r in quality.judge(d).collect() if r.kept},
        lambda d: {r.component_id for r in simhash.components(d).collect()},
        lambda d: {r.doc_id for r in d.collect()} - {r.doc_id for r in contamination.leaks(d, spark.read.parquet(f"{SF}/benchmark.parquet")).collect()},
        lambda d: {r.doc_id for r in d.collect()},
    )):
        want = expected(at)
        out = stage(function(spark, at, SF), "test")
        assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString(), name
        assert sorted(r.doc_id for r in out.collect()) == sorted(want), name
        at = out
    assert 0 < at.count() < docs.count()
    assert all(len(r.base) == 0 for r in pii.spans(at).collect())
    pieces = corpus_pipeline.best_fit_packing(spark, at, SF).collect()
    assert {r.doc_id for r in pieces} == {r.doc_id for r in at.collect()}


def test_one_row_of_a_component_stays(spark):
    t = "one two three four five six"
    rows = [(3, t, "a"), (2, t, "b"), (2, t, "c"), (None, t, "d"), (5, "quite another text here now", "e"), (None, "alone without a key at all", "f")]
    out = simhash.keep(spark.createDataFrame(rows, "doc_id bigint, text string, component_id string")).collect()
    assert sorted(str(r.doc_id) for r in out) == ["2", "5", "None"]
    assert simhash.keep(spark.createDataFrame(rows, "doc_id bigint, text string, x string").limit(0)).count() == 0
