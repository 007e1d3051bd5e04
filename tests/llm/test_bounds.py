"""What comes to the driver for a fit is bounded."""

from __future__ import annotations

from quillmark.llm import langid, quality


def test_texts_of_the_quality_fit_are_bounded_in_bytes(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(quality, "fit", lambda texts, labels: seen.append((texts, labels.tolist())))
    docs = spark.createDataFrame([(i, f"text {i} " * 20) for i in range(40)] + [(99, "long " * 1000), (98, None)], "doc_id bigint, text string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(40)] + [(99, 1, 0), (98, 1, 0), (None, 1, 0)], "doc_id bigint, quality int, toxic int")
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "TRAIN_TEXT", 1000)
    quality.train(docs, labels)
    monkeypatch.setattr(quality, "TRAIN_BYTES", 1500)
    quality.train(docs, labels)
    (all_, _), (short, kinds), (few, some) = seen
    assert len(all_) == 41 and len(short) == 40 and set(short) < set(all_)
    assert few == short[: len(few)] and some == kinds[: len(few)] and 1000 < sum(map(len, few)) <= 1500


def test_of_too_many_languages_the_frequent_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "MAX_LANGS", 2)
    rows = [(i, "the thing of it", lang) for i, lang in enumerate(["en"] * 9 + ["de"] * 7 + ["xx"] * 3 + ["yy"])]
    assert langid.train(spark.createDataFrame(rows, "doc_id bigint, text string, lang string")).langs == ["de", "en"]
