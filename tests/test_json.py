"""JSON found in answers, against a decoder that tries every bracket; values of any type made safe for JSON."""

import datetime as dt
import decimal
import json
import random

from pyspark.sql import functions as F

from lodestrata.functions import json_safe, lenient


def first_dict(text):
    for i, c in enumerate(text):
        if c == "{":
            try:
                return json.JSONDecoder().raw_decode(text[i:])[0]
            except json.JSONDecodeError:
                continue
    return None


def run(spark, column, answers):
    df = spark.createDataFrame([(i, a) for i, a in enumerate(answers)], "i int, a string")
    return [r[0] for r in df.select("i", column(F.col("a")).alias("x")).orderBy("i").select("x").collect()]


PIECES = ['{"a": 1}', '{"b": {"c": [1, "}"]}}', "{", "}", "[", "]", '"', "text ", '{"q": "say \\"{\\" \\\\"}', "{oops}", '{"u": "é😀"}', "\n", '{"cut": "', "😀 ", "\\"]


def test_first_objects_are_those_of_a_decoder(spark):
    r = random.Random(2)
    answers = ["".join(r.choice(PIECES) for _ in range(r.randrange(7))) for _ in range(400)] + ["", None, "no json", "{" * 30 + '{"x": 1}']
    got = run(spark, lenient.first_object, answers)
    for a, x in zip(answers, got):
        assert (json.loads(x) if x else None) == first_dict(a or ""), a


def test_flags_and_tags_of_answers(spark):
    answers = [
        '{"hate_speech": true, "category": " Racism ", "confidence": "HIGH", "reason": " r "}', 'Sure!\n```json\n{"hate_speech": 1, "confidence": "certain"}\n```', "[1, 2]", "nothing", None, '{"hate_speech": false, "category": null, "reason": ""}',
        '<think>{"hate_speech": true}</think>{"hate_speech": 0}', '{"hate_speech": "false", "category": ""}', '{"hate_speech": [], "category": []} {"hate_speech": true}', '{"hate_speech": {"x": 1}}', "7",
    ]
    got = [tuple(x) for x in run(spark, lenient.flag_of, answers)]
    bad = (False, "none", "low", "Invalid model response format")
    assert got == [
        (True, "racism", "high", "r"), (True, "none", "low", ""), bad, (False, "none", "low", ""), (False, "none", "low", ""), (False, "none", "low", ""), (False, "none", "low", ""), (True, "none", "low", ""),
        (False, "none", "low", ""), (True, "none", "low", ""), bad,
    ]
    answers = ['{"description": " A cat ", "tags": ["cat", " two words ", "one two three four", "", null, 5]}', 'Here: {"description": "x", "tags": "cat"} bye', "no", '{"tags": ["a"]}', '["a"]', '{"description": "brace } in text", "tags": []}']
    assert [tuple(x) for x in run(spark, lenient.tags_of, answers)] == [("A cat", ["cat", "two words", "None", "5"]), ("x", []), ("", []), ("", ["a"]), ("", []), ("brace } in text", [])]


def test_arrays_are_mended_where_they_were_cut(spark):
    whole = '[{"bbox": [1, 2], "text": "a } ] b"}, {"text": "c", "n": {"m": 1}}, {"text": "last"}]'
    got = run(spark, lenient.array_of, [whole[:n] for n in range(len(whole) + 1)])
    for n, x in enumerate(got):
        want = None
        for k in range(n + 1):  # the longest right list among what arrived
            try:
                want = json.loads(whole[:k] + "]") if whole[:k].endswith("}") else want
            except json.JSONDecodeError:
                continue
        assert (json.loads(x) if x else None) == want, (n, x)
    answers = [f"```json\n{whole}\n```", f"Here it is: {whole} I hope", "no array", None, "[]", "[1, 2", '[{"a": 1}, oops, {"b": 2']
    assert run(spark, lenient.array_of, answers) == [whole, whole, "", "", "[]", "", '[{"a": 1}]']
    assert run(spark, lenient.unfenced, ["```json\n{}\n```", "```\nx\n``` y", " {} ", "``` open"]) == ["\n{}\n", "\nx\n", "{}", "``` open"]


def test_any_value_is_made_safe_for_json(spark):
    row = (
        float("nan"), float("inf"), 1.5, dt.date(2024, 2, 29), dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2, 3, 4, 5, 60), decimal.Decimal("1.20"), b"a\xffb", True, 7, "x", None,
        [{"k": (float("-inf"), [dt.date(2020, 1, 1), None])}, None], {3: [float("nan"), 2.0]}, (None, decimal.Decimal("0.05")), dt.timedelta(days=1, seconds=2),
    )
    schema = "a double, b float, c double, d date, e timestamp, f timestamp_ntz, g decimal(5,2), h binary, i boolean, j long, k string, l string, m array<map<string, struct<x: double, y: array<date>>>>, n map<int, array<double>>, o struct<`p q`: date, r: decimal(4,2)>, s interval day to second"
    df = spark.createDataFrame([row], schema)
    got = json.loads(json_safe.as_json(df).first()[0])
    assert got["a"] is None and got["b"] is None and got["c"] == 1.5 and got["d"] == "2024-02-29"
    assert got["f"] == "2024-01-02T03:04:05.000060" and got["e"].startswith("2024-01-02T0") and got["e"].endswith("+00:00") and "." not in got["e"]
    assert (got["g"], got["h"], got["i"], got["j"], got["k"], got["l"]) == ("1.20", "a�b", True, 7, "x", None)
    assert got["m"] == [{"k": {"x": None, "y": ["2020-01-01", None]}}, None] and got["n"] == {"3": [None, 2.0]} and got["o"] == {"p q": None, "r": "0.05"}
    once = json_safe.safe_columns(df)
    assert json_safe.safe_columns(once).collect() == once.collect() and once.columns == df.columns
    assert json_safe.safe_columns(df.limit(0)).count() == 0
