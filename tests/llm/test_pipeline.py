"""The stages one after the other: columns, decisions, and what stays."""

import corpus_pipeline
from plumbline.llm import decontamination, minhash
from plumbline.llm.common import table


def test_stages(spark, sf, tmp_path):
    docs = table(spark, sf, "documents")
    n, columns = docs.count(), docs.columns
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, sf)
        assert out.columns == columns, name
        out.write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        assert 0 < docs.count() <= n
        n = docs.count()
    assert minhash.near_duplicates(docs).where("NOT kept").count() == 0
    assert decontamination.matches(docs, table(spark, sf, "benchmark")).count() == 0
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == n


def test_run_gives_the_same_rows(spark, sf):
    once, twice = (sorted(map(tuple, corpus_pipeline.run(spark, sf).collect())) for _ in range(2))
    assert once == twice and once


def test_stages_with_odd_rows(spark, sf):
    """Nulls, an empty text, repeated rows, a very long text, no rows; columns with names of ours, with dots, and of other types."""
    text = table(spark, sf, "documents").where("doc_id = 4").first().text
    rows = [(1, None), (2, ""), (None, "no id"), (None, None), (5, text), (5, text), (6, "word " * 50_000), (7, text + " and a few more words")]
    docs = spark.createDataFrame([(i, t, 1.5, 2, "a", "g") for i, t in rows], ["doc_id", "text", "_score", "kept", "a.b", "gone_id"])
    docs = docs.withColumn("doc_id", docs.doc_id.cast("long"))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes, name
        got = out.toPandas()
        assert set(got.doc_id.dropna()) <= {1, 2, 5, 6, 7} and (got.doc_id == 5).sum() in (0, 2), name
        assert got.empty or (set(got["_score"]), set(got["a.b"])) == ({1.5}, {"a"}), name
        assert stage(spark, docs.limit(0), sf).count() == 0, name
    kept = corpus_pipeline.distinct(spark, docs, sf).toPandas()
    assert sorted(kept.doc_id.fillna(-1)) == [-1, -1, 1, 2, 5, 5, 6]
    assert corpus_pipeline.packed(spark, docs, sf).selectExpr("sum(CASE WHEN start = 0 THEN 1 ELSE 0 END)").first()[0] == len(rows)
    assert corpus_pipeline.packed(spark, docs.limit(0), sf).count() == 0
