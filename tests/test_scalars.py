"""Scalar functions against plain Python."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from sparkwarden.functions import scalars as S


def one(spark, column, **values):
    df = spark.createDataFrame([tuple(values.values())], ", ".join(f"{k} {'int' if isinstance(v, int) else 'string'}" for k, v in values.items())) if values else spark.range(1)
    return df.select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("text", ["", "a", "aaaa", "abcd", "hello world", "ééa"])
def test_entropy(spark, text):
    n = len(text)
    want = -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0
    assert abs(one(spark, S.entropy(F.col("t")), t=text) - want) < 1e-9


@pytest.mark.parametrize("text", ["", "a", "709:os.execute:a.lua", "é日本", "x" * 300])
def test_fnv(spark, text):
    h = 0xCBF29CE484222325
    for b in text.encode():
        h = (h ^ b) * 0x100000001B3 % 2**64
    assert one(spark, S.fnv1a64(F.col("t")), t=text) == f"{h:016x}"


def test_fnv_known_value(spark):
    assert one(spark, S.fnv1a64(F.lit("709:os.execute:a.lua"))) == "57eb08893fc4ebff"


@pytest.mark.parametrize("pattern,text,hit", [("*", "", True), ("http.formvalue.*", "http.formvalue", False), ("a?c", "abc", True), ("a?c", "ac", False), ("*.b", "x.y.b", True), ("a.b", "axb", False), ("a*b*c", "a\nb--c", True)])
def test_globs(spark, pattern, text, hit):
    assert one(spark, F.col("t").rlike(S.glob_regex(pattern)), t=text) is hit


@pytest.mark.parametrize("text,b64,hexa", [("QUJDREVGR0hJSktM", True, False), ("QUJDREVGR0hJSkt", False, False), ("0123456789abcdef", True, True), ("0123456789abcde", False, False)])
def test_blob_words(spark, text, b64, hexa):
    assert one(spark, S.is_base64ish(F.col("t")), t=text) is b64 and one(spark, S.is_hex_blob(F.col("t")), t=text) is hexa


def test_places(spark):
    text = "ab\ncd\n\nlast"
    for p in range(1, len(text) + 1):
        before = text[: p - 1]
        assert one(spark, S.line_of(F.col("t"), F.col("p")), t=text, p=p) == before.count("\n") + 1
        assert one(spark, S.column_of(F.col("t"), F.col("p")), t=text, p=p) == len(before.split("\n")[-1]) + 1


def test_sanitize(spark):
    assert one(spark, S.sanitize(F.col("t")), t="a\tb\n\x1b\x7f‮​é") == "a\\tb\\x0A\\x1B\\x7F\\u{202E}\\u{200B}é"
    assert one(spark, S.sanitize(F.col("t")), t="") == ""


@pytest.mark.parametrize("code,family", [("701", "exec"), ("725", "firmware"), ("750", "payload"), ("802", "artifact"), ("012", "meta"), ("904", "meta"), ("300", None)])
def test_categories(spark, code, family):
    assert one(spark, S.category(F.col("c")), c=code) == family


@pytest.mark.parametrize("conf,steps,want", [("certain", 1, "high"), ("high", 2, "low"), ("low", 1, ""), ("medium", 0, "medium")])
def test_confidence_steps(spark, conf, steps, want):
    assert one(spark, S.confidence_down(F.col("c"), steps), c=conf) == want


def test_messages(spark):
    t = "value set ({name}){note}"
    assert one(spark, S.render_message(F.lit(t), name=F.lit("x"), note=F.lit(None).cast("string"))) == "value set (x){note}"
    assert one(spark, S.meaning(F.lit(t))) == "value set"


@pytest.mark.parametrize("pattern,code,hit", [("70%d", "701", True), ("70[12]", "702", True), ("70[12]", "703", False), ("7.*", "750", True), ("7-1", "771", True), ("%D", "7", False)])
def test_code_patterns(spark, pattern, code, hit):
    assert one(spark, F.col("c").rlike(S.code_pattern_regex(pattern)), c=code) is hit


def test_unreadable_patterns():
    assert S.code_pattern_regex("x" * 65) is None and S.code_pattern_regex(".*.*.*.*") is None and S.code_pattern_regex("[7") is None and S.code_pattern_regex("%") is None


@pytest.mark.parametrize("path,want", [("a/./b/../c", "a/c"), ("/a/../../b", "/b"), ("../x", "x"), ("a//b/", "a/b"), ("", "")])
def test_normal_paths(spark, path, want):
    assert one(spark, S.normalise_path(F.col("p")), p=path) == want


def test_modules(spark):
    assert one(spark, S.module_candidates(F.col("p")), p="/usr/lib/lua/a/b.lua") == ["usr.lib.lua.a.b", "lib.lua.a.b", "lua.a.b", "a.b", "b"]
    assert one(spark, S.module_candidates(F.col("p")), p="") == []


@pytest.mark.parametrize("path,test", [("src/a.lua", False), ("tests/a.lua", True), ("a/spec/b/c.lua", True), ("lib/test_x.lua", True), ("lib/x_spec.lua", True), ("/tmp/t/contest.lua", True), ("contest.lua", False), ("/tmp/x/latest.lua", False)])
def test_roles(spark, path, test):
    assert one(spark, S.is_test_path(F.col("p")), p=path) is test


@pytest.mark.parametrize("cmd,targets", [("echo a > /etc/rc.local; x >> /tmp/y", ["/etc/rc.local", "/tmp/y"]), ("a >; b > /x", []), ("a>b", []), ("", [])])
def test_redirects(spark, cmd, targets):
    assert one(spark, S.redirect_targets(F.col("c")), c=cmd) == targets
