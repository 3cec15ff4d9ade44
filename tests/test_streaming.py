from graphonic.plans.transcribe import transcribe
from graphonic.streaming import adapter


def test_stream_equals_batch(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(20)
    docs.write.parquet(str(tmp_path / "in"))
    query = adapter.transcribed(adapter.documents(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("heard").outputMode("append").start()
    query.processAllAvailable()
    query.stop()
    key = lambda rows: sorted((r.doc_id, r.ipa) for r in rows)
    assert key(spark.sql("select * from heard").collect()) == key(transcribe(spark.read.parquet(str(tmp_path / "in"))).collect())


def test_unknown_language_and_null_text(spark):
    rows = {r.doc_id: r for r in transcribe(spark.createDataFrame([(1, "xx", "ab"), (2, "en", None), (3, None, "a")], "doc_id long, lang string, text string")).collect()}
    assert rows[1].coverage == 0 and rows[2].ipa == "" and rows[2].coverage == 1 and rows[3].ipa == "a"
