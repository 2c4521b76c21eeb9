import importlib

from pyspark.sql import functions as F

corpus_pipeline = importlib.import_module("corpus_pipeline")
DATA = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    columns, n = docs.columns, docs.count()
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert 0 < docs.count() <= n
        n = docs.count()
        if name == "exact_dedup":
            want = before.groupBy(F.coalesce("text", F.lit("")).alias("t")).agg(F.max("doc_id").alias("doc_id")).select("doc_id")
            assert {r[0] for r in docs.select("doc_id").collect()} == {r[0] for r in want.collect()}
        if name != "bpe":
            assert docs.columns == columns
    assert docs.columns == ["doc_id", "source", "lang", "n_tokens", "ids", "decoded_sha256"]
    assert before.join(docs, "doc_id").where("sha2(coalesce(text, ''), 256) <> decoded_sha256").count() == 0


def test_toxic_documents_go(spark):
    """The toxicity stage drops most of the labelled toxic documents and keeps the clean ones."""
    data = "/root/testdata/sf0.01"
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    left = corpus_pipeline.STAGES[0][1](spark, docs, data).select("doc_id", F.lit(1).alias("left"))
    seen = docs.join(labels, "doc_id").join(left, "doc_id", "left").groupBy("toxic").agg(F.avg(F.coalesce("left", F.lit(0))).alias("kept"))
    kept = {r["toxic"]: r["kept"] for r in seen.collect()}
    assert kept[1] < 0.4 and kept[0] > 0.98


def test_empty_and_odd_columns(spark, tmp_path):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").withColumn("kept", F.lit("x")).limit(0)
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, DATA).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.count() == 0


def test_entry_has_all():
    entry = importlib.import_module("__spark_entry__")
    names = entry.queries()
    assert "pipeline" in names and all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11))
