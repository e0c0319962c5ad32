"""However many languages there are, each is learned."""

from larkspur.llm import language_crf


def test_every_language_is_learned(spark):
    """More languages than any bound on the sample has documents; the rarer ones are there too."""
    rows = [(1000 * k + i, f"l{k:03}", f"wort{k} satz{k} ende{k}") for k in range(230) for i in range(1 if k >= 200 else 3)]
    docs = spark.createDataFrame(rows, "doc_id long, lang string, text string")
    usable = {r[1] for r in docs.where(~language_crf.sampling.held_out(docs["doc_id"])).collect()}
    model = language_crf.train(docs, language_crf.Settings(sample_documents=60, epochs=1, buckets=256))
    assert len(usable) > 200 and set(model.languages) == usable
