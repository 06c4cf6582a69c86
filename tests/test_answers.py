import json

import pytest
from pyspark.sql import functions as F

from tallyloom.functions import answers

GOOD = {"systemStatus": "Good", "summary": "Fine", "criticalIssues": [], "warnings": ["w"], "recommendations": ["r"], "metrics": {"a": 1}}


def decoded(spark, *texts):
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, response string")
    return answers.decode(rows).orderBy("i").collect()


def test_fields_of_a_good_answer(spark):
    row = decoded(spark, f"Here it is:\n```json\n{json.dumps(GOOD)}\n``` bye }}")[0]
    assert (row.reject, row.system_status, row.summary, row.warnings, row.recommendations, row.critical_issues) == (None, "Good", "Fine", ["w"], ["r"], [])
    assert json.loads(row.metrics) == {"a": 1}


@pytest.mark.parametrize(
    ("change", "reason"),
    [
        ({"systemStatus": ""}, "no status"), ({"systemStatus": "Great"}, "invalid status"), ({"summary": ""}, "no summary"),
        ({"systemStatus": None}, "no status"), ({"summary": 5}, "JSON does not parse"), ({"metrics": [1]}, "JSON does not parse"),
        ({"pad": "x" * (1024 * 1024)}, "JSON too large"),
    ],
)
def test_rejects(spark, change, reason):
    assert decoded(spark, json.dumps(GOOD | change))[0].reject == reason


def test_texts_without_json(spark):
    assert [r.reject for r in decoded(spark, None, "", "none", "{ open", "{not json}")] == ["no JSON object"] * 4 + ["JSON does not parse"]


def test_escapes_are_repaired(spark):
    row = decoded(spark, r'{"systemStatus": "Bad", "summary": "50\% \(x\) \n A \\."}')[0]
    assert (row.reject, row.summary) == (None, "50% (x) \n A \\.")


def test_lists_of_other_shapes(spark):
    cases = [
        '["a", "", 5, null, true, {"message": "m"}, {"description": "", "title": "t"}, {"other": "x"}, ["n"]]', '"lone"', '{"issue": "i"}', "7", "null", None, "[]", "broken",
    ]
    frame = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, raw string")
    got = [r.s for r in frame.select("i", answers.string_list(F.col("raw")).alias("s")).orderBy("i").collect()]
    assert got == [["a", "m", "t"], ["lone"], ["i"], [], [], [], [], []]
