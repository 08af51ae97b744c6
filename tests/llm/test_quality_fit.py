"""What the quality classifier is fitted on."""

from terselake.llm import quality


def test_all_chunks_of_a_text_are_fitted(spark, monkeypatch):
    sizes = {k: 300 + 40_000 * (k % 7 == 0) for k in range(1, 40)}
    docs = spark.createDataFrame([(k, "é" * (n // 2)) for k, n in sizes.items()] + [(40, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(1, 41)], "doc_id long, quality int")
    monkeypatch.setattr(quality, "fit", lambda examples, params: examples)
    whole = quality.train(docs, labels)
    assert {len(c) for c, _ in whole} == {1, quality.chunk_count(40_300)} and len(whole) > 20
    few = quality.train(docs, labels, quality.ConvParams(sample_bytes=45_000))
    assert 0 < len(few) < len(whole) and {len(c) for c, _ in few} == {1, quality.chunk_count(40_300)}  # a text that has no room is passed over
    short = quality.train(docs, labels, quality.ConvParams(sample_bytes=30_000))  # no room for any long text
    assert {len(c) for c, _ in short} == {1} and len(short) == sum(len(c) == 1 for c, _ in whole)
