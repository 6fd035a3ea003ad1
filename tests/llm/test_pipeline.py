"""The pipeline's stages, each against its operator's brute-force rule, on the smallest tables and odd rows."""

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.test_operators import KEY, SCHEMA, brute_components

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    raw = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars")
    first = raw.orderBy("doc_id").first()
    item = spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").first()["text"]
    odd = [(5000, None, "en", "s", None), (5001, "?!", None, "s", 2), (5002, "and the " + item + " of the", "en", "s", 1), (5003, f"the words of a text and {KEY} in it", None, "s", 1),
           (first["doc_id"], first["text"], "en", "s", 1), (5004, first["text"] + " more", "en", "s", 1), (None, "the words of one with no id", "en", "s", 1)]
    docs = raw.unionByName(spark.createDataFrame(odd, SCHEMA))
    stages = dict(corpus_pipeline.STAGES)
    assert list(stages) == ["language", "near_duplicates", "decontamination", "secrets", "packing"]
    one = stages["language"](spark, docs, SF).cache()
    gone = {r["doc_id"] for r in docs.collect()} - {r["doc_id"] for r in one.collect()}
    assert {5000, 5001} <= gone and len(gone) <= 3 and one.where("lang is null").count() == 0
    two = stages["near_duplicates"](spark, one, SF).cache()
    groups = brute_components([(r["doc_id"], r["text"]) for r in one.collect()])
    assert sorted(r["doc_id"] for r in two.where("doc_id is not null").collect()) == sorted({d for d, _, c in groups if d == c and d is not None})
    assert two.where("doc_id is null").count() == 1
    three = stages["decontamination"](spark, two, SF).cache()
    lost = {r["doc_id"] for r in two.collect()} - {r["doc_id"] for r in three.collect()}
    items = [r["text"] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    holding = {r["doc_id"] for r in two.collect() if any(i in r["text"] for i in items)}
    assert 5002 in lost and holding <= lost and len(lost) <= len(holding) + 2
    four = stages["secrets"](spark, three, SF).cache()
    assert four.count() == three.count() and four.columns == docs.columns
    assert KEY not in four.where("doc_id = 5003").first()["text"]
    untouched = three.join(four.withColumnRenamed("text", "t2"), "doc_id").where(F.col("text") == F.col("t2")).count()
    assert untouched > 0.9 * three.count()
    assert four.where("t2 is not null" if "t2" in four.columns else "true").where(F.col("text").contains("[SECRET]") & (F.col("n_chars") != F.length("text"))).count() == 0
    five = stages["packing"](spark, four, SF)
    assert {r["doc_id"] for r in five.select("doc_id").distinct().collect()} == {r["doc_id"] for r in four.collect()}
    empty = docs.where("false")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SF).count() == 0


def test_run(spark):
    out = corpus_pipeline.run(spark, SF)
    assert out.groupBy("sequence_id").agg(F.sum("length").alias("n")).where("n > 1024").count() == 0
