"""Operator 5: near neighbours among licenses, and very long texts."""

from lexmill.llm import licenses


def labels(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.labels for r in licenses.scan(df).orderBy("doc_id").collect()]


def test_the_best_cover_of_a_span_wins(spark):
    by = "This work is licensed under a Creative Commons Attribution{} 4.0 International License."
    agpl = next(t for label, t in licenses.TEMPLATES if label == "agpl")
    gpl = next(t for label, t in licenses.TEMPLATES if label == "gpl" and "redistribute" in t)
    texts = [by.format(""), by.format("-ShareAlike"), by.format("-NoDerivatives"), by.format("-NonCommercial-ShareAlike"), agpl, gpl, by.format("") + " pad" * 40 + " " + by.format("-ShareAlike")]
    # The base label of a phrase stays beside: the affero notice holds "general public license".
    assert labels(spark, texts) == ["cc-by", "cc-by-sa", "cc-by-nd", "cc-by-nc-sa", "agpl,gpl", "gpl", "cc-by,cc-by-sa"]


def test_very_long_text_with_many_copies(spark):
    mit = licenses.TEMPLATES[2][1]
    text = " ".join(f"word{i} other{i} {mit if i % 500 == 0 else ''}" for i in range(60_000))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = licenses.scan(df).first()
    assert got.labels == "mit" and got.score == 1.0 and len(got.matches) == 120 and got.n_words == 120_000 + 120 * len(licenses.license_words(mit.encode()))
