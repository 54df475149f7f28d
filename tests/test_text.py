"""Text functions at the edges of each rule, against Python's own string methods where they define the rule."""

import hashlib
import re

from tuples import rows
from pyspark.sql import functions as F

from marginalia.constants import LINE_BREAK, SPACE_CLASS, UNICODE_SPACES
from marginalia.functions import text as T


def evaluate(spark, values, *columns):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, s string").repartition(3)
    return rows(df.select("i", *[c.alias(f"c{n}") for n, c in enumerate(columns)]).orderBy("i").drop("i"))


def test_space_list_is_python_white_space():
    assert sorted(UNICODE_SPACES) == [c for c in map(chr, range(1, 0x30000)) if c.isspace()]


def test_strip_and_collapse_follow_python(spark):
    values = ["", " a ", " x y　", "\x1ca\x1fb\x85", "a\t\n\r b", " line ", "​zero", "no"]
    got = evaluate(spark, values, T.ustrip("s"), T.collapse_ws("s"))
    assert got == [(v.strip(), re.sub(r"\s+", " ", v).strip()) for v in values]


def test_summary(spark):
    expected = {
        "One.\n  Two.\n\nThree.": "One. Two.",
        "\nlate": None,
        "Text.\n:param x: y": "Text.",
        ":param x: y": None,
        "a\r\nb\r\rc": "a b",
        "": None,
        None: None,
        "end\n": "end",
        "a b\u0085c\x0bd\x0ce\x1cf": "a b c d e f",
        "   indented  ": "indented",
        "x\n \t \ny": "x",
        " :x": None,
        "a\n\x1f\nb": "a",
    }
    assert [r[0] for r in evaluate(spark, list(expected), T.summary("s"))] == list(expected.values())
    assert evaluate(spark, ["\n\n  A b.\nC\n\nD"], T.summary("s", skip_leading_blank=True)) == [("A b. C",)]


def test_commit_target(spark):
    pairs = [
        ("Fix bug", ""), ("", "Only message"), ("Same", "SAME "), ("Add x", "More\n\tdetail"), ("", ""), (None, None),
        ("  Sub ject ", "Body"), (None, "m"),
    ]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, subject string, message string")
    got = rows(
        df.select(
            "i",
            T.commit_target("subject", "message").alias("a"),
            T.commit_target("subject", "message", " ", collapse=False, empty_as_null=False).alias("b"),
        ).orderBy("i"),
        "a", "b",
    )
    assert got == [
        ("Fix bug", "Fix bug"), ("Only message", "Only message"), ("Same", "Same"), ("Add x More detail", "Add x More\n\tdetail"),
        (None, ""), (None, ""), ("Sub ject Body", "Sub ject Body"), ("m", "m"),
    ]


def test_target_chain_and_blank_explicit_target(spark):
    data = [("doc ", "t", "s", "m"), ("", " t ", "s", "m"), (None, None, "s", "m"), ("  ", "t", "s", "m"), (None, "", "", "")]
    df = spark.createDataFrame(data, "d string, t string, s string, m string").coalesce(1)
    after = [r[0] for r in rows(df.select(T.target_or_fallback("d", "t", "s", "m")))]
    first = [r[0] for r in rows(df.select(T.target_or_fallback("d", "t", "s", "m", strip_first=True)))]
    assert after == ["doc", "t", "s m", "", ""]
    assert first == ["doc", "t", "s m", "s m", ""]


def test_hashes_names_lines_previews(spark):
    long = "x" * 401
    expected = {
        " code\n": ("c13367945d5d4c91047b3b50234aa7ab", 2, "_code_", " code\n"),
        "": ("d41d8cd98f00b204e9800998ecf8427e", 1, "", ""),
        None: ("d41d8cd98f00b204e9800998ecf8427e", None, None, None),
        "a\nb\n": (None, 3, "a_b_", "a\nb\n"),
        long: (None, 1, long, "x" * 400 + "..."),
        "C++": (None, 1, "c++", "C++"),
        "Objective C": (None, 1, "objective_c", "Objective C"),
        "java/script": (None, 1, "java_script", "java/script"),
        "__": (None, 1, "__", "__"),
    }
    got = evaluate(
        spark, list(expected), T.content_hash("s"), T.line_count("s"), T.safe_name("s"), T.preview_text("s", 400, ellipsis=True)
    )
    for (h, *others), (want, *rest) in zip(got, expected.values()):
        assert others == rest and (want is None or h == want)
    df = spark.createDataFrame([(" a ", None)], "b string, a string")
    assert rows(df.select(T.change_hash("b", "a"))) == [(hashlib.md5(b"a\n<SEP>\n").hexdigest(),)]


def test_picks_language_and_formats(spark):
    df = spark.createDataFrame([("", " ", "Go"), (None, "x", None), ("a", None, "")], "a string, b string, lang string").coalesce(1)
    assert rows(df.select(T.first_nonempty("a", "b"), T.language_norm("lang"))) == [(" ", "go"), ("x", "code"), ("a", "code")]
    number = spark.range(1).select(F.lit(1.23456).alias("x"), F.lit(0.0002).alias("lr"))
    assert rows(number.select(T.fixed("x", 4), T.fixed("x", 2), T.scientific("lr"))) == [("1.2346", "1.23", "2.0e-04")]


def test_patterns_compile_as_python_regexes():
    assert re.fullmatch(SPACE_CLASS, " ") and re.fullmatch(LINE_BREAK, "\r\n")


def test_character_tests_follow_python_over_all_planes_in_use(spark):
    points = spark.range(1, 0x30000).where("id not between 55296 and 57343").select(F.expr("decode(unhex(lpad(hex(id), 8, '0')), 'UTF-32')").alias("c"))
    got = points.select("c", T.starts_upper("c").alias("upper"), T.starts_alpha("c").alias("alpha"), T.lower("c").alias("lower")).collect()
    assert len(got) == 0x2FFFF - 2048
    assert not [hex(ord(r["c"])) for r in got if r["upper"] != r["c"].isupper()]
    assert not [hex(ord(r["c"])) for r in got if r["alpha"] != r["c"].isalpha()]
    assert not [hex(ord(r["c"])) for r in got if r["lower"] != r["c"].lower()]
