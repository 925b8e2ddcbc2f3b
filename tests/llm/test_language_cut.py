"""The cut of language identification on texts with real-sized vocabularies; the unlearned and noise must fall."""

import random

import pytest
from pyspark.sql import functions as F

from faultline.llm import language


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang").cache()


@pytest.mark.parametrize("unlearned", ["de", "en", "es", "fr"])
def test_texts_of_an_unlearned_language_are_rejected(spark, docs, unlearned):
    model = language.fit(docs.where(language.training_fold(spark)).where(F.col("lang") != unlearned).select("text", "lang"))
    out = language.predict(docs.withColumnRenamed("lang", "true"), model).where("lang_pred <> 'und'")
    shares = {r["new"]: r["share"] for r in out.groupBy((F.col("true") == unlearned).alias("new")).agg(
        F.avg(F.col("rejected").cast("int")).alias("share")
    ).collect()}
    assert shares[True] >= 0.95 and shares[False] <= 0.03


def test_noise_is_rejected_and_known_languages_stay(spark, docs):
    rng = random.Random(1)
    latin, cyrillic = "abcdefghijklmnopqrstuvwxyz", "абвгдежзиклмнопрстуфхцчшщыьэюя"
    noise = [
        (" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(2, 9))) for _ in range(60)),)
        for letters in (latin, cyrillic, latin.upper() + latin + "0123456789+/") for _ in range(50)
    ]
    model = language.fit(docs.where(language.training_fold(spark)).select("text", "lang"))
    assert language.predict(spark.createDataFrame(noise, "text string"), model).where("not rejected").count() == 0
    held = language.predict(docs.where(~language.training_fold(spark)).drop("lang"), model).where("lang_pred <> 'und'")
    assert held.where("rejected").count() <= 0.03 * held.count()
