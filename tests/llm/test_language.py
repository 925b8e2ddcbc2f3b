"""Language identification: separable languages, rejection, odd rows, clashing columns."""

from pyspark.sql import functions as F

from faultline.llm import language

WORDS = {
    "aa": ["the", "with", "house", "river", "thing", "other"],
    "bb": ["der", "schule", "zwischen", "straße", "nicht", "auch"],
    "cc": ["el", "niño", "camino", "señora", "aquí", "pero"],
}


def corpus(spark):
    rows = [
        (i, " ".join(WORDS[lang][(i * 7 + j * (i % 5 + 1)) % 6] for j in range(12)), lang, "s")
        for i, lang in ((i, list(WORDS)[i % 3]) for i in range(300))
    ]
    odd = [(1000, None, "aa", "s"), (1001, "", "bb", "s"), (1002, "12 34 !?", None, "s"), (1003, "the river " * 20_000, None, "s"), (0, rows[0][1], "aa", "s")]
    return spark.createDataFrame(rows + odd, "doc_id long, text string, lang string, source string")


def test_held_out_accuracy_and_odd_rows(spark, tmp_path):
    corpus(spark).write.parquet(f"{tmp_path}/documents.parquet")
    out = language.op8_language_id(spark, str(tmp_path)).collect()
    assert len(out) == 305
    by_id = {r["doc_id"]: r for r in out}
    held = [r for r in out if r["held_out"] and r["doc_id"] < 1000]
    assert held and all(r["lang_pred"] == list(WORDS)[r["doc_id"] % 3] for r in held)
    assert all(0 <= r["score"] <= 1 for r in out)
    for i in (1000, 1001, 1002):
        assert (by_id[i]["lang_pred"], by_id[i]["score"], by_id[i]["rejected"]) == ("und", 0.0, True)
    assert by_id[1003]["lang_pred"] == "aa"
    assert len({(r["lang_pred"], r["score"]) for r in out if r["doc_id"] == 0}) == 1


def test_far_texts_are_rejected_and_others_stay(spark):
    docs = corpus(spark)
    model = language.fit(docs.select("text", "lang"))
    far = spark.createDataFrame([("漢字仮名" * 30,), ("the house with other thing",)], "text string")
    assert [r["rejected"] for r in language.predict(far, model).collect()] == [True, False]


def test_number_signs_are_no_letters(spark):
    model = language.fit(corpus(spark).select("text", "lang"))
    signs = spark.createDataFrame([("½ ²",), ("①",), ("Ⅻ",), ("１２",), ("ª",), ("ʰ x",)], "text string")
    got = {r["text"]: r["lang_pred"] for r in language.predict(signs, model).collect()}
    assert all(got[t] == "und" for t in ("½ ²", "①", "Ⅻ", "１２")) and all(got[t] != "und" for t in ("ª", "ʰ x"))


def test_no_labelled_rows_and_empty_tables(spark):
    docs = corpus(spark)
    model = language.fit(docs.where("false").select("text", "lang"))
    assert model is None
    assert {r["lang_pred"] for r in language.predict(docs, model).collect()} == {"und"}
    some = language.fit(docs.select("text", "lang"))
    assert language.predict(docs.where("false"), some).count() == 0


def test_clashing_columns_are_replaced(spark):
    docs = corpus(spark).limit(5).withColumn("score", F.lit("x")).withColumn("rejected", F.lit(1))
    out = language.predict(docs, language.fit(corpus(spark).select("text", "lang")))
    assert out.columns == ["doc_id", "text", "lang", "source", "lang_pred", "score", "rejected"]
    assert out.count() == 5
