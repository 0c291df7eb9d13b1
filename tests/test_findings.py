"""Responses to alerts, requests, and the scoring round with a repair."""

import json

import pandas as pd
from pyspark.sql import functions as F

from emberlog.operators import findings, requests
from emberlog.plans.analyze import chunk_requests, score_requests


def answers(spark, texts):
    rows = [("f", i, t, "syslog", [f"line {n}" for n in range(12)]) for i, t in enumerate(texts)]
    schema = "source_file string, chunk_index bigint, response string, log_format string, first_lines array<string>"
    return spark.createDataFrame(rows, schema).withColumns({
        "timestamp_first": F.timestamp_seconds(F.lit(0)), "timestamp_last": F.timestamp_seconds(F.lit(9))})


def alerts(spark, text):
    return findings.alerts_from_responses(answers(spark, [text])).orderBy("title").collect()


def body(items, summary=""):
    return json.dumps({"alerts": items, "chunk_summary": summary})


def test_fields(spark):
    item = {"severity": "high", "title": "t" * 100, "description": "d", "recommendation": "r", "iocs": ["1.1.1.1", 7],
            "affected_lines": [str(i) for i in range(15)],
            "remediation": {"action": "block_ip", "command": "c", "reversible": False, "undo_command": "u"}}
    for text in (body([item]), "Sure:\n```json\n" + body([item]) + "\n```", body([item]) + "\n} trailing {"):
        (a,) = alerts(spark, text)
        assert (a.severity, a.title, a.description, a.recommendation) == ("HIGH", "t" * 80, "d", "r")
        assert a.iocs == ["1.1.1.1", "7"] and a.affected_lines == [str(i) for i in range(10)]
        assert tuple(a.remediation) == ("block_ip", "c", False, "u")
        assert a.timestamp_last is not None and a.log_format == "syslog" and len(a.id) == 36


def test_defaults_and_odd_types(spark):
    rows = alerts(spark, body([
        {}, {"title": "a", "severity": 5, "iocs": "lone", "affected_lines": None, "remediation": "x"},
        {"title": "b", "severity": "NOPE", "remediation": {"command": ""}},
        {"title": "c", "remediation": {"command": "go"}}]))
    default, a, b, c = rows
    assert default.title == "Unknown threat" and default.iocs == [] and default.description == ""
    assert [r.severity for r in rows] == ["INFO"] * 4
    assert a.iocs == ["lone"] and a.affected_lines == [] and a.remediation is None and b.remediation is None
    assert tuple(c.remediation) == ("none", "go", True, "")


def test_errors(spark):
    for text in ("no json", "", "[1, 2]", '{"alerts": [', "null"):
        (a,) = alerts(spark, text)
        assert a.title == "Analysis error" and a.severity == "INFO" and a.timestamp_first is None
        assert a.description.endswith(text[:300]) and len(a.affected_lines) == 10
    assert alerts(spark, body([])) == [] and alerts(spark, "{}") == [] and alerts(spark, '{"alerts": null}') == []


def test_needs_repair(spark):
    cases = {body(["text"]): True, body(["text", {"title": "x"}]): False, body([]): False, body([1]): False, "none": False,
             '{"alerts":"text"}': True, '{"chunk_summary":"s"}': False}
    rows = findings.read_responses(answers(spark, list(cases))).collect()
    assert {r.response: r.needs_repair for r in rows} == cases
    assert findings.read_responses(answers(spark, [body(["a"], "busy")])).first().chunk_summary == "busy"


def test_messages(spark):
    df = spark.range(1).select(
        requests.messages("s", F.lit("t"), F.array(F.lit("a"), F.lit("b")), F.lit("c")).alias("full"),
        requests.messages("s", F.lit("t"), F.array().cast("array<string>"), F.lit("")).alias("bare"),
    ).withColumn("again", requests.repair_messages(F.col("bare"), F.lit("bad"), "fix")).first()
    assert [m.role for m in df.full] == ["system", "system", "system", "user"]
    assert df.full[1].content.endswith("\n\na\n\n---\n\nb") and df.full[2].content.endswith("\nc")
    assert [m.role for m in df.bare] == ["system", "user"] and df.bare[1].content.endswith("\n\nt")
    assert [(m.role, m.content) for m in df.again][2:] == [("assistant", "bad"), ("user", "fix")]


def test_scoring_round(spark):
    rows = [("f", i, f"word{i} " + "x" * 4000, "syslog") for i in range(4)]
    parsed = spark.createDataFrame(rows, "source_file string, line_no bigint, raw string, format string")
    intel = spark.createDataFrame([("i1", "first intel", [1.0, 0.0]), ("i2", "second intel", [0.0, 1.0])],
                                  "id string, text string, embedding array<float>")
    vectors = spark.createDataFrame([("f", i, [float(i), 1.5]) for i in range(4)],
                                    "source_file string, chunk_index bigint, embedding array<float>")
    prior = spark.createDataFrame([("f", 0, "[chunk 0] HIGH: earlier")], "source_file string, chunk_index bigint, line string")
    reqs = chunk_requests(parsed, "rules", intel, vectors, prior, top_n=1)
    by_chunk = {r.chunk_index: r.messages for r in reqs.collect()}
    assert [len(by_chunk[i]) for i in range(4)] == [3, 4, 4, 4]
    assert "second intel" in by_chunk[0][1].content and "first intel" in by_chunk[3][1].content
    assert by_chunk[2][2].content.endswith("[chunk 0] HIGH: earlier")

    @F.pandas_udf("string")
    def model(messages: pd.Series) -> pd.Series:
        def answer(m):
            last = m[-1]["content"]
            if last == "fix it":
                return '{"alerts":[{"title":"repaired","severity":"LOW"}]}' if "word1" in m[-3]["content"] else None
            if "word0" in last:
                return '{"alerts":[{"title":"zero","severity":"HIGH"}]}'
            return "oops" if "word3" in last else '{"alerts":["text"]}'

        return messages.map(answer)

    got = {(r.chunk_index, r.title) for r in score_requests(reqs, model, "fix it").collect()}
    assert got == {(0, "zero"), (1, "repaired"), (3, "Analysis error")}


def test_answers_out_of_shape(spark):
    rows = [(0, "{'alerts': [{'title': 'x'}]}"), (1, '{"alerts": [{"title": "a"}], "alerts": [{"title": "b"}]}'),
            (2, '{"alerts": [{"title": "a", "title": "c"}]}'), (3, None), (4, '{"alerts": ""}'), (5, '{"alerts": "text"}')]
    answers = spark.createDataFrame(rows, "chunk_index bigint, response string").withColumns({
        "source_file": F.lit("f"), "log_format": F.lit("syslog"), "first_lines": F.array(F.lit("l")),
        "timestamp_first": F.lit(None).cast("timestamp"), "timestamp_last": F.lit(None).cast("timestamp")})
    got = {r.chunk_index: (r.title, r.description) for r in findings.alerts_from_responses(answers).collect()}
    assert got[0][0] == got[3][0] == findings.ERROR_TITLE and got[0][1].startswith(findings.ERROR_TEXT) and got[3][1] == findings.NO_ANSWER
    assert got[1][0] == "b" and got[2][0] == "c" and set(got) == {0, 1, 2, 3}
    again = {r.chunk_index for r in findings.read_responses(answers).filter("needs_repair").collect()}
    assert again == {5}
