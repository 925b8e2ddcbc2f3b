"""The sample of language identification: distinct texts, exactly bounded, no language empty."""

from pyspark.sql import functions as F

from faultline.llm import language


def texts(spark, lang, copies, distinct):
    word = F.concat(F.lit(lang), F.conv((F.col("id") % distinct).cast("string"), 10, 36))
    return spark.range(copies).select(F.concat_ws(" ", word, F.lit("abc"), word).alias("text"), F.lit(lang).alias("lang"))


def test_languages_of_few_distinct_texts_and_a_hot_text(spark):
    rows = texts(spark, "aa", 10_000, 10)
    for i in range(8):
        rows = rows.unionByName(texts(spark, f"b{i}", 4000, 1))
    rows = rows.unionByName(texts(spark, "cc", 3000, 3000)).unionByName(spark.createDataFrame([("12 34", "dd")] * 900 + [("word", "dd")], "text string, lang string"))
    sample = language.sample_rows(rows).collect()
    counts = {}
    for r in sample:
        counts[r["lang"]] = counts.get(r["lang"], 0) + 1
    assert counts == {"aa": 10, **{f"b{i}": 1 for i in range(8)}, "cc": 500, "dd": 1}
    drawn = {r["draw"] for r in sample if r["lang"] == "cc"}
    every = sorted(r[0] for r in rows.where("lang = 'cc'").select(F.xxhash64("text")).collect())
    assert drawn == set(every[:500])


def test_every_language_is_learned(spark):
    rows = texts(spark, "aa", 5000, 5000)
    for i in range(12):
        rows = rows.unionByName(texts(spark, f"b{i}", 4000, 1))
    assert len(language.fit(rows).languages) == 13
