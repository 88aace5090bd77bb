import pytest
from pyspark.sql import functions as F

from codewarden.functions import text
from codewarden.functions.jsregex import glob, js, path_glob


def value(spark, column, **cells):
    schema = ", ".join(f"{k} {'string' if v is None or isinstance(v, str) else 'double'}" for k, v in cells.items())
    return spark.createDataFrame([tuple(cells.values())], schema).select(column).first()[0]


def test_dollar_is_the_end_and_spaces_are_unicode(spark):
    assert value(spark, F.col("s").rlike(js(r"a$")), s="a\n") is False
    assert value(spark, text.trim(F.col("s")), s="\n  x ﻿") == "x"
    assert value(spark, F.col("s").rlike(js(r"\bssn\b")), s="éssn") is True
    assert value(spark, F.col("s").rlike(js(r"[^]x")), s="\nx") is True


@pytest.mark.parametrize("pattern,name,good", [
    ("redact*", "redactPhi", True), ("a.b", "axb", False), ("*Log", "Logger", False)])
def test_anchored_glob(spark, pattern, name, good):
    assert value(spark, F.col("s").rlike(glob(pattern)), s=name) is good


@pytest.mark.parametrize("pattern,path,good", [
    ("*.md", "a.md", True), ("*.md", "d/a.md", False), ("**/*.md", "d/e/a.md", True), ("docs/**", "docs/a/b", True),
    ("*.{js,ts}", "x.ts", True), ("*.js", ".x.js", False), ("src/?.ts", "src/a.ts", True)])
def test_path_glob(spark, pattern, path, good):
    assert value(spark, F.col("s").rlike(path_glob(pattern)), s=path) is good


def test_lengths_count_utf16_units(spark):
    assert value(spark, text.units(F.col("s")), s="a😀é") == 4
    assert value(spark, text.tokens(F.col("s")), s="abcde") == 2


@pytest.mark.parametrize("location,lenient,inline,sarif", [
    ("a.ts:42", 42, 42, 42), ("a.ts:3-15", 3, 3, 1), ("a.ts", None, None, 1), ("a.ts:x", None, None, 1), ("a.ts:0", 0, None, 0)])
def test_three_line_parsers(spark, location, lenient, inline, sarif):
    assert value(spark, text.line_lenient(F.col("s")), s=location) == lenient
    assert value(spark, text.inline_line(F.col("s")), s=location) == inline
    assert value(spark, text.sarif_line(F.col("s")), s=location) == sarif


def test_fingerprint_ignores_line_and_keeps_case(spark):
    fp = lambda loc: value(spark, text.fingerprint(F.col("l"), F.lit("Cat "), F.lit(" Sum")), l=loc)
    assert fp("A.ts:1") == fp("A.ts:99") != fp("a.ts:1")


def test_entropy_paths_hosts_scores(spark):
    assert value(spark, text.entropy(F.col("s")), s="aabb") == pytest.approx(1.0)
    assert value(spark, text.entropy(F.col("s")), s="") == 0.0
    assert value(spark, text.normalize_path(F.col("s")), s="a/./b/../c") == "a/c"
    assert value(spark, text.hostname(F.col("s")), s="API.Example.com:443/x") == "api.example.com"
    assert value(spark, text.hostname(F.col("s")), s="http://[bad host/") is None
    for raw, want in ((59.5, 60), (-3.0, 0), (250.0, 100)):
        assert value(spark, text.clamp_score(F.col("x")), x=raw) == want


def test_trim_takes_every_kind_of_blank_at_the_edges_only(spark):
    texts = [None, "", " ", "\n ", "a", " a", "a　", "﻿a b\t\n", "a \n b", "😀 ", " 😀"]
    got = [r.t for r in spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string").orderBy("i").select(text.trim(F.col("x")).alias("t")).collect()]
    assert got == [None, "", "", "", "a", "a", "a", "a b", "a \n b", "😀", "😀"]
