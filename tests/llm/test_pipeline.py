"""The pipeline on the smallest test table: each stage does its work on what the one before kept."""

import corpus_pipeline
from tracewright.llm import decontaminate, near_duplicates


def test_stages_on_the_test_table(spark, tmp_path):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        kept.append(docs.count())
        if name != "mixing":
            assert docs.columns == columns
        if name == "near_duplicates":
            assert near_duplicates.near_duplicates(docs).where("n_links > 0").count() == 0
        if name == "decontamination":
            assert decontaminate.decontaminate(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).where("n_hit > 0").count() == 0
        if name == "pii":
            assert docs.where("text rlike '@mail[0-9]+[.]example'").count() == 0 and docs.where("n_chars <> length(text)").count() == 0
    assert kept == sorted(kept, reverse=True) and kept[1] < kept[0] and kept[2] < kept[1] and kept[4] == kept[3] == kept[5]
    assert corpus_pipeline.run(spark, sf).count() == kept[-1]
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    first = {r.doc_id for r in spark.read.parquet(f"{tmp_path}/quality").collect()}
    assert sum((i in first) == bool(q) for i, q in labels.items()) >= 0.97 * len(labels)


def test_stages_take_odd_rows(spark):
    sf = "/root/testdata/sf0.001"
    known = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(1, None, None, None, None), (None, "mail me: a@b.co now please", "en", "s", 1), (3, "", "en", None, 0), (4, "word " * 60_000, "en", "s", 1), (4, "word " * 60_000, "en", "s", 1), (5, "The same clean text of this and that.", None, "s", 7), (5, "The same clean text of this and that.", None, "s", 7)]
    odd = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    more = known.unionByName(odd)
    for extra in ("h", "row", "k", "n", "d", "spans", "size", "score"):
        more = more.withColumn(extra, more["doc_id"].cast("string"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, more, sf)
        assert out.columns == more.columns and stage(spark, more.limit(0), sf).count() == 0
        assert out.count() <= more.count()
    assert corpus_pipeline.mixing_stage(spark, more, sf).count() == more.count()
    kept = [r.doc_id for r in corpus_pipeline.near_duplicate_stage(spark, odd, sf).collect()]
    assert sorted(kept, key=str) == [1, 3, 4, 5, None]
