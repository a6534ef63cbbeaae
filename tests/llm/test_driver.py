"""What the driver gathers from samples."""

from brandlens.llm import language_id, toxicity


def test_fits_happen_in_a_task(spark, monkeypatch):
    texts = [("en", "the house by the river"), ("de", "das Haus an dem Fluss und der Wald")]
    docs = spark.createDataFrame([(i, f"{texts[i % 2][1]} {i} " + "vile filth " * (i % 3 == 0), texts[i % 2][0]) for i in range(300)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(300)], "doc_id long, toxic int")
    gathered = []
    frame = type(docs)
    plain = frame.toArrow
    monkeypatch.setattr(frame, "toArrow", lambda self: gathered.extend(self.columns) or plain(self))
    model, language = toxicity.train_toxicity_model(docs, labels), language_id.train_language_model(docs)
    assert not {"features", "bits"} & set(gathered)
    assert {r.doc_id % 3 == 0 for r in toxicity.score_toxicity(docs, model).where("toxic_score >= 0.5").collect()} == {True}
    assert {(r.doc_id % 2, r.lang_pred) for r in language_id.predict_language(docs, language).collect()} == {(0, "en"), (1, "de")}
    assert language.weights.shape == (language_id.WIDTH + 1, 2) and language.usual.shape == (1 << 14, 2)
    assert toxicity.train_toxicity_model(docs, labels.limit(0)).index.size == 0
    assert language_id.train_language_model(docs.limit(0)) is None
    assert language_id.train_language_model(docs.where("doc_id % 1 = 1")) is None
