"""Gates at the edge of each rule."""

from tuples import rows
from pyspark.sql import functions as F

from marginalia.functions import gates as G
from marginalia.operators.columns import COMMIT_FIELDS, with_fields
from marginalia.operators.filters import gate_or_all, gate_report


def flags(spark, values, gate):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string")
    return [r[0] for r in rows(df.select("i", gate.alias("ok")).orderBy("i"), "ok")]


def sentence(n, start="A", end="."):
    return start + "x" * (n - len(start) - len(end)) + end


def test_good_summary(spark):
    values = [
        sentence(29), sentence(30), sentence(30, "a"), sentence(30, "É"), sentence(30, end="?"), sentence(30, end="!"),
        sentence(30, end=";"), sentence(40, "Seeds "), sentence(40, "Reference "), sentence(40, "Use "), None, "",
        sentence(40) + "\n", "A" + "\n" * 28 + ".", "A" + "\U0001f600" * 28 + ".",
    ]
    expected = [False, True, False, True, True, True, False, False, False, True, False, False, False, True, True]
    assert flags(spark, values, G.is_good_summary("s")) == expected


def test_good_commit(spark):
    weak = ("Testing ", "Template ", "WIP ", "Merge branch ", "Merge pull request ", "Update README ", "Bump version ", "Released ")
    values = [sentence(19), sentence(20), *[sentence(40, w) for w in weak], sentence(40, "Merge both "), None]
    assert flags(spark, values, G.is_good_commit("s")) == [False, True, *[False] * len(weak), True, False]


def test_lengths_in_lines(spark):
    def text(n):
        return "\n" * (n - 1)

    values = [text(2), text(3), text(350), text(351), "", None, "a\nb\n"]
    assert flags(spark, values, G.good_code_length("s")) == [False, True, True, False, False, False, True]
    df = spark.createDataFrame([("a", ""), ("a\nb", None), ("", ""), (text(349), "x"), (text(350), "x")], "b string, a string").coalesce(1)
    assert [r[0] for r in rows(df.select(G.good_change_length("b", "a")))] == [False, True, False, True, False]


def test_words(spark):
    values = ["abcdefghi", "abcdefghij", " abcdefghi ", "1bcdefghijk", "", None, "éàüöîabcdef", "a" + "\n" * 9 + "b"]
    expected = [False, True, False, False, False, False, True, True]
    assert flags(spark, values, G.good_doc("s")) == expected
    assert flags(spark, values, G.good_commit("s")) == expected


def test_row_gates(spark):
    data = [
        (0, "0123456789", "0123456789", None, None, None, None, None),
        (1, "012345678 ", "0123456789", None, None, None, None, None),
        (2, None, None, "", "before text", "after text here", None, "A message"),
        (3, None, None, None, "before text", "after text here", "Long enough subject", "LONG ENOUGH SUBJECT"),
        (4, None, None, None, None, "after text here", "Long enough subject", None),
        (5, "", "Documented here", None, None, None, None, None),
    ]
    schema = "i int, code string, docstring string, old_code string, old_contents string, new_contents string, subject string, message string"
    df = with_fields(spark.createDataFrame(data, schema), COMMIT_FIELDS)
    got = rows(
        df.select("i", G.good_code_row(), G.good_commit_row(), G.has_min_fields(), G.good_example_raw(), G.good_example_relaxed()).orderBy("i")
    )
    assert got == [
        (0, True, False, False, False, True),
        (1, False, False, False, False, True),
        (2, False, False, False, False, True),
        (3, False, True, True, True, True),
        (4, False, False, False, False, True),
        (5, False, False, False, True, True),
    ]


def test_gate_or_all_keeps_an_emptied_split(spark):
    df = spark.createDataFrame([(1, "train"), (2, "train"), (3, "test"), (4, "test"), (5, "validation")], "ord long, split string")
    kept = gate_or_all(df, F.col("ord").isin(1, 5))
    assert sorted(rows(kept)) == [(1, "train"), (3, "test"), (4, "test"), (5, "validation")]
    assert "Exchange hashpartitioning" not in kept._jdf.queryExecution().executedPlan().toString()
    report = gate_report(df, {"odd": F.col("ord") % 2 == 1})
    assert sorted(rows(report)) == [("test", 2, 1), ("train", 2, 1), ("validation", 1, 1)]
