from pyspark.sql import functions as F

from terselake.functions import text as X
from terselake.functions import tokens
from terselake.streaming import kernel

SAMPLES = ["", "one two three", '{"id":1,"name":"alpha"}', '{ "id" : 1 , "name" : "alpha" }', "runtime/debug.Stack() pipeline.go:42 internal/compress.Run(...)", "a b\x0bc \x1c d", "snake_case é_éé x_y", " \n\t "]


def column(spark, values, make):
    df = spark.createDataFrame([(k, v) for k, v in enumerate(values)], "k int, v string")
    return [r.x for r in df.select("k", make(F.col("v")).alias("x")).orderBy("k").collect()]


def test_token_estimates(spark):
    got = column(spark, SAMPLES, tokens.estimate)
    assert got[:5] == [0, 4, 6, 17, 8]
    assert got == [kernel.estimate(s) for s in SAMPLES]


def test_words_and_trim(spark):
    assert column(spark, ["a b\x0bc \x1c d"], X.words) == [["a", "b", "c", "\x1c", "d"]]
    assert column(spark, ["　 x  "], X.trim_u) == ["x"]


def test_hash_ignores_outer_white_space(spark):
    a, b = column(spark, ["x y", "\n x y  "], X.content_hash)
    assert a == b and len(a) == 32


def test_numbers(spark):
    df = spark.createDataFrame([(999,), (1234567,), (2048,), (3 << 20,), (1280,)], "n long")
    rows = df.select(X.format_num(F.col("n")).alias("a"), X.human_bytes(F.col("n")).alias("b"), X.human_tokens(F.col("n")).alias("c")).collect()
    assert [r.a for r in rows] == ["999", "1234,567", "2,048", "3145,728", "1,280"]
    assert [r.b for r in rows] == ["999B", "1.2MB", "2.0KB", "3.0MB", "1.2KB"]
    assert [r.c for r in rows] == ["999", "1234k", "2k", "3145k", "1k"]


def test_indent_and_roots(spark):
    assert column(spark, ["\t x", "x", "  x"], X.indent) == [3, 0, 2]
    assert column(spark, ["", "│ x", " x", "x", "── y"], X.is_root_line) == [True, False, False, True, False]


def test_error_gate_looks_at_200_bytes(spark):
    words = ("error:", "PANIC:")
    got = column(spark, ["Error: x", "é" * 97 + "error:", "é" * 96 + "xx error:", "panic: y", "fine"], lambda c: X.is_error_text(c, words))
    assert got == [True, True, False, True, False]


def test_binary_and_huge_lines(spark):
    got = column(spark, ["a\0b", "x" * 20_001, "x " * 15_000, "ok"], X.is_binary_or_huge)
    assert got == [True, True, False, False]
