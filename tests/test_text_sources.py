import csv
import json
import random

import pytest
from pyspark.sql import functions as F

from faultline import constants as K
from faultline.sources import delimited, model_store

HEADER = "Status da Ação;Responsável pela Execução;Término planejado"
FIELDS = ("status", "responsavel", "prazo")


def plans(spark, path):
    rows = delimited.read_mapped(spark, path, K.ACTION_PLANS, sep=";").collect()
    return sorted(tuple(r[c] for c in FIELDS) for r in rows)


@pytest.fixture
def small_blocks(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "400")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


def test_quoted_breaks_over_many_blocks_and_encodings(spark, tmp_path, small_blocks):
    rng, want = random.Random(4), []
    for number, encoding in enumerate(("utf-8", "latin-1", "utf-8")):
        with open(tmp_path / f"{number}.csv", "w", encoding=encoding, newline="") as f:
            if number == 0:
                f.write(HEADER + "\n")
            out = csv.writer(f, delimiter=";", lineterminator="\n")
            for i in range(120):
                row = (f"ação {number}-{i}", rng.choice(["José", 'um "dois" três', "a;b", "linha\noutra\n\nfim", "\nx"]), f"{i}")
                out.writerow(row)
                want.append(row)
    lines = delimited.decoded_lines(spark, str(tmp_path))
    assert lines.select("file", "start").distinct().count() > 10
    assert plans(spark, str(tmp_path)) == sorted(want)


def test_blank_lines_and_an_open_quote(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + "\n\na;b;1\n   \n", encoding="utf-8")
    (tmp_path / "b.csv").write_text('c;d;2\ne;"open;3\nrest;f;4\n', encoding="utf-8")
    (tmp_path / "c.csv").write_text("g;h;5\n", encoding="utf-8")
    got = plans(spark, str(tmp_path))
    assert ("a", "b", "1") in got and ("c", "d", "2") in got and ("g", "h", "5") in got
    assert len(got) == 4 and [r for r in got if r[0] == "e"][0][1].startswith("open")


def test_no_shuffle_without_breaks(spark, tmp_path):
    (tmp_path / "a.csv").write_text(HEADER + '\n"a";"b ""q""";1\n', encoding="utf-8")
    df = delimited.read_mapped(spark, str(tmp_path), K.ACTION_PLANS, sep=";")
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
    assert plans(spark, str(tmp_path)) == [("a", 'b "q"', "1")]


def test_metadata_documents(spark, tmp_path):
    document = {
        "version": "v1", "timestamp": "2024-05-01T10:00:00.123456", "features": ["a", "b"], "n_features": 2, "more": {"x": 1},
        "models_by_horizon": {
            "7": {"model_name": "RF", "best_threshold": 0.4, "metrics_val": {"f1": 0.5}, "metrics_test": {}},
            "30": {"metrics_val": None}, "all": {"model_name": "RF"},
        },
    }
    (tmp_path / "one.json").write_text(json.dumps(document, indent=2), encoding="utf-8")
    (tmp_path / "two.json").write_text("{no json", encoding="utf-8")
    rows = model_store.read_metadata_json(spark, str(tmp_path), whole_files=True).orderBy("horizon").collect()
    assert [(r["horizon"], r["model_name"], r["threshold"], r["metrics_val"], r["metrics_test"]) for r in rows] == [
        (7, "RF", 0.4, {"f1": 0.5}, {}), (30, "Unknown", 0.5, {}, {})
    ]
    assert str(rows[0]["created_at"]) == "2024-05-01 10:00:00.123456" and rows[0]["features"] == ["a", "b"]
    model_store.write_metadata_json(model_store.read_metadata_json(spark, str(tmp_path), whole_files=True), str(tmp_path / "out"))
    again = model_store.read_metadata_json(spark, str(tmp_path / "out"))
    assert again.orderBy("horizon").collect() == rows
    value = json.loads(spark.read.text(str(tmp_path / "out")).first()["value"])
    assert value["n_features"] == 2 and set(value["models_by_horizon"]) == {"7", "30"}
    assert spark.read.text(str(tmp_path / "out")).where(F.col("value") == "").count() == 0
