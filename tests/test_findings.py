"""Findings, selection, scores, diffs and reports: pinned edge cases."""

import json

import pytest
from pyspark.sql import functions as F

from sparkwarden.engine import Engine, lines_around
from sparkwarden.operators import findings as FI
from sparkwarden.operators import select as SE
from sparkwarden.operators import summary as SU
from sparkwarden.sources import dims, documents

COLUMNS = "file string, code string, name string, severity string, confidence string, cwe string, message string, source string, line int, column int, end_column int, status string"


def finding(code="701", severity="high", confidence="medium", file="a.lua", line=1, column=1, name="n", message="m", source="", status=None):
    return (file, code, name, severity, confidence, "CWE-0", message, source, line, column, column, status)


def table(spark, *rows):
    return spark.createDataFrame(list(rows), COLUMNS)


@pytest.mark.parametrize(
    "rows,value,label,gaps",
    [
        ([], 100, "good", 0), ([finding(severity="critical")], 85, "needs work", 0), ([finding(confidence="low")], 97, "good", 0),
        ([finding(severity="critical", status="fixed"), finding("901", "low", status="fixed")], 100, "good", 0),
        ([finding(severity="critical", confidence="certain")] * 5, 0, "critical", 0), ([finding("901", "low")], 99, "incomplete", 1), ([finding(severity="odd", confidence="")], 100, "good", 0),
    ],
)
def test_scores(spark, rows, value, label, gaps):
    r = SU.score(table(spark, *rows)).first()
    assert (r["value"], r["label"], r["coverage_gaps"]) == (value, label, gaps)
    assert set(dims.CATEGORIES) <= set(r.asDict())


def test_distinct_ignores_severity_and_keeps_sources(spark):
    rows = [finding(), finding(severity="low"), finding(name="other"), finding(source="s"), finding(line=2)]
    assert FI.distinct(table(spark, *rows)).count() == 3


def test_cover_needs_the_same_place(spark):
    got = SE.cover(table(spark, finding("701"), finding("709"), finding("702", line=2), finding("703", column=2), finding("750")))
    assert sorted(r["code"] for r in got.collect()) == ["702", "703", "709", "750"]


def test_ladder_order_and_gaps(spark):
    f = table(spark, finding("701"), finding("709", "critical", "high"), finding("901", "low", "medium"), finding("801", "medium", "medium"), finding("747", "high", "low", name="pw"))
    codes = lambda **o: sorted(r["code"] for r in SE.ladder(f, **o).collect())
    assert codes(ignore=["7%d%d"]) == ["801", "901"]
    assert codes(ignore=["7%d%d"], enable=["747:p*"]) == ["747", "801", "901"]
    assert codes(ignore=["7%d%d"], enable=["747"], only=["709"]) == ["801", "901"]
    assert codes(categories=["exec"], severity="critical") == ["709", "801", "901"]
    assert codes(confidence="high") == ["709"]
    assert codes(ignore=[":p*"]) == ["701", "709", "801", "901"]
    with pytest.raises(ValueError):
        SE.ladder(f, only=["[7"])


def test_allow_list_counts_first_entry(spark):
    f = table(spark, finding(file="x/a.lua"), finding(file="a.lua", line=2), finding(file="ba.lua"))
    entries = spark.createDataFrame([(0, "701", "a.lua"), (1, "701", "x/a.lua"), (2, "709", "a.lua")], "entry_no int, code string, file string")
    kept, counts = SE.allow_list(f, entries)
    assert [r["file"] for r in kept.collect()] == ["ba.lua"] and {r["entry_no"]: r["n"] for r in counts.collect()} == {0: 2, 1: 0, 2: 0}


def test_depth_is_clamped(spark):
    steps = [1, 1, -1, -1, -1, 1, -1, -1, 1]
    rows = [("f", i, d) for i, d in enumerate(steps)]
    want, depth = [], 0
    for d in steps:
        depth = max(0, depth + d)
        want.append(depth)
    got = SE.clamped_depth(spark.createDataFrame(rows, "g string, i int, delta int"), ["g"], ["i"]).orderBy("i").collect()
    assert [r["depth"] for r in got] == want


def test_directives(spark):
    d = spark.createDataFrame([("a.lua", 2, "push", "^$", True), ("a.lua", 3, "ignore", "^701$", False), ("a.lua", 6, "pop", "^$", False), ("a.lua", 8, "ignore", "^7.*$", False), ("a.lua", 8, "enable", "^750$", False)], "file string, line int, action string, pattern string, push boolean")
    f = table(spark, *[finding(line=n) for n in (1, 4, 7, 9)], finding("750", line=9), finding("012", line=9), finding(file="b.lua", line=9))
    got = sorted((r["file"], r["code"], r["line"]) for r in SE.apply_directives(f, d).collect())
    assert got == [("a.lua", "012", 9), ("a.lua", "701", 1), ("a.lua", "701", 7), ("a.lua", "750", 9), ("b.lua", "701", 9)]


def test_baseline_states_and_exit_codes(spark):
    mk = lambda *rows: table(spark, *rows).withColumn("fingerprint", FI.fingerprint(table(spark, *rows)))
    known = mk(finding(name="old"), finding(name="gone"), finding(name="gone", line=9), finding("901", "low", name="gap"))
    now = mk(finding(name="old", line=5), finding(name="fresh"), finding("901", "low", name="gap"))
    out = SU.baseline_diff(now, known)
    assert sorted((r["name"], r["baseline_state"]) for r in out.collect()) == [("fresh", "new"), ("gap", "new"), ("gone", "fixed"), ("old", "unchanged")]
    assert SU.exit_code_baseline(out, "low").first()[0] == 3 and SU.exit_code_baseline(out, "critical").first()[0] == 1
    assert SU.exit_code_baseline(out.where("code = '701'"), "critical").first()[0] == 0


def test_reports(spark, tmp_path):
    f = table(spark, finding(name="<x>", message="a < b"), finding("709", "critical", "high", line=3))
    f = f.withColumn("fingerprint", FI.fingerprint(f))
    e = Engine(spark)
    whole = lambda form, df: json.loads("".join(r["json"] for r in e.render(df, form).collect()))
    doc = whole("json", f)
    assert [r["json"] for r in e.render(f.where("false"), "json").collect()][-1] == "]}" and whole("json", f.where("false"))["findings"] == []
    assert doc["schema"] == "report/1" and [x["id"] for x in doc["findings"]] == ["709", "701"] and doc["score"]["value"] == 69
    log = whole("sarif", f)
    traced = f.withColumn("trace", F.when(F.col("code") == "709", F.array(F.struct(F.lit("source").alias("kind"), F.lit(1).alias("line"), F.lit("http").alias("name"), F.lit("b.lua").alias("file"))))).withColumn("baseline_state", F.lit("fixed"))
    flows = [r.get("codeFlows") for r in whole("sarif", traced)["runs"][0]["results"]]
    assert sum(x is not None for x in flows) == 1 and {r["baselineState"] for r in whole("sarif", traced)["runs"][0]["results"]} == {"absent"}
    (flow,) = [x for x in flows if x]
    assert flow[0]["threadFlows"][0]["locations"][0]["location"]["physicalLocation"]["artifactLocation"]["uri"] == "b.lua"
    assert log["version"] == "2.1.0" and {r["level"] for r in log["runs"][0]["results"]} == {"error"}
    assert "a &lt; b" in " ".join(r["html"] for r in e.render(f, "html").collect())
    assert [r["line_text"] for r in e.render(f, "plain").collect()][0] == "a.lua:1:1: high 701 a < b"
    path = tmp_path / "base.json"
    path.write_text(json.dumps(doc))
    base = documents.baseline(spark, str(path))
    assert e.compare(f, base).where("baseline_state <> 'unchanged'").count() == 0
    path.write_text(json.dumps(doc | {"schema": "other"}))
    with pytest.raises(documents.DocumentError):
        documents.baseline(spark, str(path))
    with pytest.raises(ValueError):
        e.render(f, "pdf")


@pytest.mark.parametrize("text", ["{", "[]", '{"x": 1}', '{"severity": {"999": "low"}}', '{"allow": [{"code": "701"}]}', '{"fail_on": "never"}', '{"std": ["cobol"]}'])
def test_bad_configurations(text):
    with pytest.raises(documents.DocumentError):
        documents.config(text)


def test_configuration_and_rules(spark):
    e = Engine(spark, config='{"disable": ["747"], "severity": {"701": "low"}, "allow": [{"code": "709", "file": "a.lua", "reason": "known"}]}')
    f = table(spark, finding(), finding("747"), finding("709", "critical", "high"))
    got = e.select(f).collect()
    assert [(r["code"], r["severity"]) for r in got] == [("701", "low")]
    for bad in ({"sinkz": []}, {"sinks": [{"pattern": "x", "code": "1"}]}, {"sources": [{"pattern": ""}]}):
        with pytest.raises(dims.RegistryError):
            Engine(spark, rules=bad)
    with pytest.raises(ValueError):
        e.select(f, colour="red")


def test_group_places_and_frames(spark):
    rows = [finding(file=f"f{i}.lua", line=i + 1) for i in range(5)] + [finding("709", "critical", "high")]
    got = SU.group_places(table(spark, *rows)).collect()
    assert {(r["code"], r["hidden"]) for r in got} == {("701", 2), ("709", 0)} and len(got) == 4
    art = spark.createDataFrame([("a.lua", "one\ntwo\nthree\nfour")], "path string, body string")
    frame = lines_around(table(spark, finding(line=2)), art).orderBy("at").collect()
    assert [r["text"] for r in frame] == ["one", "two", "three", "four"]


def test_streaming_state(spark, tmp_path):
    from sparkwarden.streaming.scan import scan_stream

    schema = "doc_id long, text string, source string"
    src, state, cp = str(tmp_path / "in"), str(tmp_path / "state"), str(tmp_path / "cp")
    for n, text in enumerate(["License here", "License here", 'token = "abcdef123456abcdef123456"']):
        spark.createDataFrame([(min(n, 1), text, "s")], schema).coalesce(1).write.mode("append").parquet(src)
        scan_stream(spark.readStream.schema(schema).parquet(src), state, cp).awaitTermination()
    last = sorted((tmp_path / "state").glob("v*"))[-1]
    got = {(r["code"], r["file"]): (r["first_batch"], r["last_batch"]) for r in spark.read.parquet(str(last)).collect()}
    assert got[("750", "s/0.txt")] == (0, 0) and ("747", "s/1.txt") in got and len(got) == 3
