"""Null group keys, unusual order values and large limits."""

import random

import pytest
from tuples import rows
from pyspark.sql import functions as F

from marginalia.operators import chat as C
from marginalia.operators import ordering as O
from marginalia.operators import sampling as SA
from marginalia.operators.bounds import few_values
from marginalia.sources import corpora as S

rnd = random.Random(7)
ORDERS = sorted(rnd.randrange(-(1 << 62), -1) for _ in range(60)) + list(range(40))


@pytest.fixture(scope="module")
def table(spark):
    data = [(o, "a" if i % 2 else None, i % 11) for i, o in enumerate(ORDERS)]
    return spark.createDataFrame(data, "ord long, language string, v int").repartition(5)


def test_positions_and_running_values_keep_null_groups_and_any_ids(table):
    got = rows(O.with_position(table, "ord", ["language"]), "language", "ord", "pos")
    for group in ("a", None):
        mine = sorted((o, p) for g, o, p in got if g == group)
        assert [p for _, p in mine] == list(range(1, 51))
    best = {r["ord"]: r["m"] for r in O.with_running_max(table, ["language"], "ord", {"m": F.col("v")}, inclusive=True).collect()}
    for group in (0, 1):
        most = -1
        for o, v in sorted((o, i % 11) for i, o in enumerate(ORDERS) if i % 2 == group):
            most = max(most, v)
            assert best[o] == most
    shuffled = rows(O.with_shuffle_position(table, "ord", ["language"]), "language", "shuffle_pos")
    assert sorted(p for g, p in shuffled if g is None) == list(range(1, 51))


@pytest.mark.parametrize("threshold", ["10000", "5"])
@pytest.mark.parametrize("groups", [None, 2])
def test_a_sample_is_the_same_by_rows_and_by_cuts(spark, table, threshold, groups):
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", threshold)
    try:
        got = rows(SA.sample_k(table, 20, by=["language"], groups=groups), "language", "ord")
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")
    whole = rows(SA.sample_k(table, 20, by=["language"]), "language", "ord")
    assert len(got) == 40 and sorted(got, key=repr) == sorted(whole, key=repr)


@pytest.mark.parametrize("groups", [None, 2])
def test_a_null_stratum_is_split_like_any_other(table, groups):
    got = rows(SA.stratified_split(table, "language", groups=groups), "language", "split")
    assert [sum(g is None and s == name for g, s in got) for name in ("train", "validation", "test")] == [35, 5, 10]
    assert few_values(table, "language") == [(None,), ("a",)]


def test_limits_beyond_the_threshold(table):
    assert O.first_k(table, ["language"], ["ord"], 20_000, "ord").count() == 100
    assert SA.parts_of(300, ["a", "b", "c"]) == {"a": 100, "b": 100, "c": 100}
    assert SA.parts_of(10, ["a", "b", "c"]) == {"a": 4, "b": 3, "c": 3} and SA.parts_of(7, ["a", "b"]) == {"a": 3, "b": 3}
    assert sum(SA.parts_of(150, [str(i) for i in range(101)]).values()) == 150


def test_rank_over_the_whole_table(table):
    ranked = rows(O.with_rank(table, [F.desc("v"), F.asc("ord")]), "rank", "v", "ord")
    want = sorted(((i % 11, o) for i, o in enumerate(ORDERS)), key=lambda x: (-x[0], x[1]))
    assert [r[1:] for r in sorted(ranked)] == want and sorted(r[0] for r in ranked) == list(range(1, 101))


def test_row_numbers_are_unique_over_splits(spark, tmp_path):
    paths = {}
    for split in ("train", "validation", "test"):
        paths[split] = str(tmp_path / split)
        spark.range(20).withColumnRenamed("id", "x").repartition(3).write.parquet(paths[split])
    raw = S.read_splits(spark, paths, order="ord")
    assert len({r["ord"] for r in raw.collect()}) == 60
    drawn = SA.sample_quota(raw, {"train": 3, "validation": 2})
    assert sorted(r["split"] for r in drawn.collect()) == ["train"] * 3 + ["validation"] * 2


def test_two_languages_in_one_folder(spark, tmp_path):
    data = [(0, "F#", "train"), (1, "F*", "train"), (2, "f#", "train")]
    S.write_by_language(spark.createDataFrame(data, "ord long, language string, split string"), str(tmp_path / "c"))
    assert sorted(r["ord"] for r in S.read_corpus(spark, str(tmp_path / "c"), "F#").collect()) == [0, 2]


def test_chat_text_is_kept_by_split(spark):
    data = [(0, "train", "made", None, None), (1, "test", None, "def f(): return 1", "Returns the number one.")]
    df = spark.createDataFrame(data, "ord long, split string, text string, code string, docstring string").withColumn("language", F.lit("python"))
    got = {r["ord"]: r["text"] for r in C.ensure_chat(df, F.lit(True), "final_mixed").collect()}
    assert got[0] == "made" and "Returns the number one." in got[1]
