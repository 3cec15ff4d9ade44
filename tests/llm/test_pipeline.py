import corpus_pipeline
from graphonic.llm import decontaminate, simhash, toxicity

from .test_decontaminate import brute
from .test_simhash import groups


def test_stages_in_order(spark, sf):
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "packing"]
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    score = {r.doc_id: r.score for r in toxicity.scored(documents, toxicity.learned(documents, labels)).collect()}
    now = [(r.doc_id, r.text) for r in documents.collect() if score[r.doc_id] < 0.5]
    group = groups(sorted(now))
    now = [(i, t) for i, t in now if group[i] == i]
    bench = [(str(r.item_id), r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    want = {x[0] for x in brute(now, bench) if not x[5]}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf).select("doc_id").distinct().collect()} == want


def test_stages_keep_the_columns(spark, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, documents, sf).columns == documents.columns
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, documents.where("false"), sf).count() == 0
    assert simhash.THRESHOLD == 2 and decontaminate.WINDOW == 10


def test_rows_are_dropped_one_by_one(spark):
    """Rows that share a doc_id, or have none, stay or go by their own text."""
    one, two, leak = (" ".join(f"{x}{k}" for k in range(60)) for x in ("a", "b", "leak"))
    rows = [(1, one, "first"), (2, two, "kept"), (3, two, "copy"), (3, "quite another text", "kept too"), (1, one, "repeated"), (None, one, "copy without id"), (None, "nothing else like this", "kept three")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    got = [r.note for r in corpus_pipeline.near_dedup(spark, docs, "").collect()]
    assert len(got) == 4 and set(got) - {"first", "repeated"} == {"kept", "kept too", "kept three"}
    bench = spark.createDataFrame([("i", leak)], "item_id string, text string")
    rows = [(1, one, "kept"), (1, f"x {leak} y", "leak"), (None, leak, "leak without id"), (None, two, "kept without id"), (2, leak, "leak again"), (2, None, "null")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, note string").repartition(3)
    for bound in (10**9, 0):
        got = decontaminate.clean(docs, bench, text_bytes=bound).collect()
        assert sorted(r.note for r in got) == ["kept", "kept without id", "null"]
