import corpus_pipeline as cp
from refloom.llm.common import DOC_COLUMNS


def test_stages_take_effect(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    extra = docs.selectExpr("*", "1 as k", "'x' as root", "2 as start")
    sizes = [docs.count()]
    now = extra
    for name, step in cp.STAGES[:-1]:
        now = step(spark, now, sf_dir)
        assert tuple(now.columns) == DOC_COLUMNS, name
        now = now.cache()
        sizes.append(now.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] == sizes[4]
    last = cp.STAGES[-1][1](spark, now, sf_dir)
    assert sorted(map(str, last.collect())) == sorted(map(str, cp.run(spark, sf_dir).collect()))


def test_stages_on_odd_rows(spark, sf_dir):
    rows = [(None, None, None, None, None), (1, "", "en", None, 0), (1, "", "en", None, 0), (2, "w " * 3000, "en", "s", 6000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for _, step in cp.STAGES:
        step(spark, docs, sf_dir).collect()
        assert step(spark, docs.limit(0), sf_dir).collect() == []
