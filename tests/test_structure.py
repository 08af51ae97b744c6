import pytest

from terselake.functions import parsed
from terselake.operators.structure import with_shape


def collapse(spark, content, args=None, budget=2000):
    df = spark.createDataFrame([(content, args or {})], "content string, tool_input map<string,string>")
    r = with_shape(df, budget=budget).head()
    return r.shape, r.collapsed


LINES = "\n".join
CASES = {
    "json_array": ('[{"a":1}, {"b": 2} ,3,4,5]', '{"a":1},\n{"b": 2},\n…and 3 more items', "[1,2,3]"),
    "json_object": ("{" + ",".join(f'"k{i}": {i}' for i in range(9)) + "}", "k0: 0\nk1: 1\nk2: 2\nk3: 3\nk4: 4\n…and 4 more keys", '{"a":1}'),
    "json_lines": (LINES(['{"a":1}'] * 3 + ["null"]), '{"a":1}\n{"a":1}\n…and 2 more JSON records', LINES(['{"a":1}'] * 3)),
    "csv": (LINES(["a,b,c"] + ['1,"x,y",3'] * 4), "a,b,c\n1,x,y,3\n1,x,y,3\n…and 2 more rows", LINES(["a,b,c"] + ["1,2,3"] * 3)),
    "unified_diff": (LINES(["diff --git a b", "--- a", "+++ b", "@@ -1 +1 @@"] + ["+x"] * 9 + ["-y"] * 9), LINES(["diff --git a b", "--- a", "+++ b", "@@ -1 +1 @@"] + ["+x"] * 3 + ["-y"] * 3 + ["… 9 additions, 9 deletions"]), LINES(["@@"] + ["+x"] * 9)),
    "diagnostics": (LINES([f"a.py:{i}: bad" for i in range(9)]), LINES([f"a.py:{i}: bad" for i in range(5)] + ["…and 4 more diagnostics"]), LINES(["a.py:1: bad"] * 7)),
    "coverage": (LINES(["Coverage"] + [f"f{i}  {i}.0%" for i in range(8)] + ["TOTAL 50%"]), "f0  0.0%\nf1  1.0%\nf2  2.0%\nf3  3.0%\nf4  4.0%\nTOTAL 50%", LINES(["f 1.0%"] * 9)),
    "package_log": (LINES(["npm warn x"] * 11 + ["added 3"]), LINES(["[package-log: npm | 0 error(s), 11 warning(s), 1 install/build line(s), 0 removal(s), 0 vulnerability line(s)]"] + ["npm warn x"] * 8 + ["…and 4 more package log lines"]), LINES(["npm warn x"] * 11)),
    "markup": ("<a>" + "<B/>" * 12 + "</a>", "[markup: 13 tags]\na: 1\nb: 12", "<a>" + "<b/>" * 9 + "</a>"),
    "stack_trace": (LINES(["head", "panic: x"] + [f"\tf.go:{i}" for i in range(7)] + ["tail"]), LINES(["head", "panic: x", "\tf.go:0", "    … (3 frames omitted)", "\tf.go:4", "\tf.go:5", "\tf.go:6", "tail"]), LINES([f"\tf.go:{i}" for i in range(7)])),
    "file_tree": (LINES(["src"] + [f"  f{i}" for i in range(15)] + ["end"]), LINES(["src", "  f0", "  f1", "  f2", "  … (12 more items)", "end"]), LINES(["src", "  a", "  b"])),
    "test_output": (LINES(["ok pkg"] * 6 + ["--- FAIL: x"]), "[6 passed, 1 failures shown below]\n--- FAIL: x", LINES(["ok pkg"] * 4)),
    "log_stream": (LINES([f"2024-01-01 00:00:{i:02d} ping" for i in range(12)] + ["other"]), "2024-01-01 00:00:00 ping  [×12]\nother", LINES(["ping"] * 12)),
    "tabular": (LINES(["NAME  STATUS  AGE  IP"] + ["a  up  1d  x"] * 4), LINES(["NAME  STATUS"] + ["a  up"] * 4), LINES(["NAME  STATUS"] * 5)),
    "yaml": (LINES([f"k{i}: v" for i in range(12)]), LINES([f"k{i}: v" for i in range(5)] + ["…and 7 more YAML lines"]), LINES([f"k{i}: v" for i in range(11)])),
    "toml": (LINES(["[a]", "x = 1", "y = 2", "z = 3", "[b]", "x = 1", "y = 2", "z = 3", "w = 4", "v = 5"]), "[a]\n[b]\n… 2 sections, 8 keys", LINES(["[a]"] + ["x = 1"] * 9)),
}


@pytest.mark.parametrize("shape", CASES)
def test_shape(spark, shape):
    text, out, boundary = CASES[shape]
    args = {"q": "status name"} if shape == "tabular" else {}
    assert collapse(spark, text, args) == (shape, out)
    assert collapse(spark, boundary, args)[0] != shape


def test_all_passing_tests_and_plain_text(spark):
    assert collapse(spark, LINES(["PASS"] * 6)) == ("test_output", "[6 tests passed, 0 failures]")
    assert collapse(spark, "hello") == (None, None)
    assert collapse(spark, "") == (None, None)


def test_table_is_clipped_to_the_budget(spark):
    text = LINES(["NAME  STATUS  AGE  IP"] + [f"a{i}  up  1d  x" for i in range(30)])
    assert collapse(spark, text, {"q": "name status"}, 20)[1] == LINES(["NAME  STATUS", "a0  up", "a1  up", "a2  up", "  … (25 rows omitted)", "a28  up", "a29  up"])


def test_table_keeps_columns_by_containment_both_ways(spark):
    text = LINES(["ID  NAMESPACE  AGE  IP"] + ["1  n  2d  x"] * 4)
    assert collapse(spark, text, {"q": "space ages"})[1].startswith("ID  NAMESPACE  AGE\n")


@pytest.mark.parametrize("bad", ['[1,2,3,4] x', "[1,2,3,4", "[1,,2,3,4]", "[NaN,1,2,3]", '[1,2,3,"a\n"]'])
def test_json_is_strict(bad):
    assert parsed.collapse_array(bad) is None


def test_repeated_keys_count_once():
    assert parsed.object_members('{"a": 1, "a": [2] }') == {"a": "[2]"}


@pytest.mark.parametrize("bad", ['a,b,c\n1,2', 'a,"b,c', 'a,b"c,d', 'a,"b"c,d'])
def test_csv_is_strict(bad):
    with pytest.raises(ValueError):
        parsed.csv_records(bad)


def test_csv_quotes():
    assert parsed.csv_records('a,"b ""q"" x",c\r\n\n1,"2\n3",') == [["a", 'b "q" x', "c"], ["1", "2\n3", ""]]
