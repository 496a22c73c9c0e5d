"""Language ID over more labels than 64."""

from lexmill.llm import langid


def test_every_label_is_learned(spark):
    names = [f"l{k:02d}" for k in range(70)]
    text = {v: f"{chr(97 + k % 26) * 3}{chr(97 + k // 26) * 2}{chr(97 + k * 7 % 26) * 4} " * 6 for k, v in enumerate(names)}
    rows = [(k * 10 + i, text[v], v) for k, v in enumerate(names) for i in range(4 if k < 64 else 3)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), learn=langid.F.lit(True))
    assert model.levels[""] == names
    assert model.predict(langid.features([text[v].encode() for v in names]))[0] == names


def test_repeats_neither_fill_nor_empty_the_sample(spark):
    say = {"en": "the house and the river {} that they wrote", "fr": "la maison et la riviere {} que nous avons", "": "zzq xxk {} qqz kkx zqx"}
    rows = [(7, say["en"].format(i), "en") for i in range(300)] + [(i, say["en"].format(1), "en") for i in range(100, 130)]
    rows += [(1, say["fr"].format(0), "fr")] * 400 + [(2, say[""].format(2), "")] * 3 + [(None, "x", "de"), (9, None, "de"), (9, "y", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    drawn, langs = langid._draw(docs, "lang", 50, langid.F.lit(True))
    n = {r.lang: r["count"] for r in drawn.groupBy("lang").count().collect()}
    assert langs == ["", "en", "fr"] and n["fr"] == n[""] == 1 and 25 <= n["en"] <= 80
    model = langid.train(docs, sample=50, learn=langid.F.lit(True))
    assert model.predict(langid.features([say[v].format("so").encode() for v in ("fr", "en", "")]))[0] == ["fr", "en", ""]
    one = langid.train(docs.where("lang = 'fr'"), learn=langid.F.lit(True))
    assert one.predict(langid.features([b"any"]))[0] == ["fr"]
    assert langid.train(docs.where("false")) is None
