"""Texts are divided into lines once, whatever number of passes reads the lines' hashes."""

from planwright.llm.line_dedup import line_drops


def test_texts_are_divided_once(spark):
    docs = spark.createDataFrame([(1, "a long enough line\nx"), (2, "A long enough line \ny")], "doc_id bigint, text string")
    drops = line_drops(docs)
    assert "posexplode" not in drops._jdf.queryExecution().executedPlan().toString()
    assert [(r["doc_id"], r["dropped"]) for r in drops.collect()] == [(2, [0])]
