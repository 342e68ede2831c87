from pyspark.sql import functions as F

from tessera.functions.text import match_line, render_line, substitute


def _m(spark, pairs):
    df = spark.createDataFrame(pairs, "line string, pattern string")
    return [r[0] for r in df.select(match_line(F.col("line"), F.col("pattern"))).collect()]


def test_match_line_rules(spark):
    got = _m(spark, [
        ("1 F 100", "1 F 100"),          # equal
        ("1 F 100", "[0-9]+ [FOP] \\d+"),  # java regex full match per token
        ("1 F 100", "1 F"),              # token counts differ
        ("1 F 100", "( F 100"),          # invalid regex -> false, job survives
        ("(", "("),                      # equal even if invalid as regex
        ("   ", ""),                     # both empty
        ("a\tb", "a b"),                 # any whitespace separates tokens
        ("ab", "a"),                     # regex must match the whole token
        ("aXb", "a.b"),
    ])
    assert got == [True, True, False, False, True, True, True, False, True]


def test_render_drops_null_and_blank_cells(spark):
    df = spark.createDataFrame([(1, None, "  ", " x ", 2.5)], "a int, b string, c string, d string, e double")
    line = df.select(render_line(["a", "b", "c", "d", "e"]).alias("l")).first()[0]
    assert line == "1  x  2.5"


def test_java_only_patterns(spark):
    got = _m(spark, [("b", "[a-z&&[^c]]+"), ("c", "[a-z&&[^c]]+"), ("12", "[0-9]++"), ("a.b", "\\Qa.b"), ("axb", "\\Qa.b"),
                     ("a.bx", "\\Qa.b\\Ex"), ("é", "\\w"), ("a|b", "a|b"), ("ab", "a|ab"), ("a)(b", "a)(b"), ("x", "a)(b"),
                     ("a\\", "a\\"), ("ab", "a\\")])
    assert got == [True, False, True, True, False, True, False, True, True, True, False, True, False]


def test_substitute_is_one_pass(spark):
    df = spark.createDataFrame([("${a} ${b}${c} $x",), ("none",), ("",), ("${a}",)], "s string")
    v = F.create_map(F.lit("a"), F.lit("${b}"), F.lit("b"), F.lit("X"))
    assert [r[0] for r in df.select(substitute(F.col("s"), v)).collect()] == ["${b} X${c} $x", "none", "", "${b}"]
