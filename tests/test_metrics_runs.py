"""Losses, metrics, logs and the choice of a best run."""

import math
import random

import pytest
from tuples import rows
from pyspark.sql import functions as F

from marginalia.operators import metrics as E
from marginalia.operators import runs as L
from marginalia.operators import stats as A
from marginalia.plans.evaluation import row_losses

KEYS = ["row_id"]


def labels_table(spark, data):
    return spark.createDataFrame(data, "row_id long, labels array<int>")


def test_losses_by_rows_and_by_positions(spark):
    train = labels_table(spark, [(1, [-100, 3, 3, 4]), (2, [-100, 4])])
    evaluated = labels_table(spark, [(7, [-100, 3, 4, 9]), (8, [-100, -100]), (9, [5]), (10, [2, 3])])
    size, alpha = 10, 0.5
    p = {3: (2 + alpha) / (4 + alpha * size), 4: (2 + alpha) / (4 + alpha * size), 9: alpha / (4 + alpha * size)}
    expected = {7: -sum(math.log(p[x]) for x in (3, 4, 9)) / (3 + 1e-9), 8: 0.0, 9: 0.0, 10: -math.log(p[3]) / (1 + 1e-9)}
    long = E.row_loss(E.unigram_losses(train, evaluated, size, alpha, KEYS), ["model", *KEYS])
    arrays = row_losses(train, evaluated, size, alpha, KEYS)
    for df in (long, arrays):
        got = {(r["model"], r["row_id"]): r["row_loss"] for r in df.collect()}
        assert len(got) == 8
        for k, v in expected.items():
            assert abs(got["unigram", k] - v) < 1e-9
        assert abs(got["uniform", 7] - math.log(size)) < 1e-6 and got["uniform", 8] == 0.0
    outside = labels_table(spark, [(1, [2, 10])])
    for scored in (row_losses(train, outside, size, alpha, KEYS), E.unigram_losses(train, outside, size, alpha, KEYS)):
        with pytest.raises(Exception, match="label 10 is not an id"):
            scored.collect()
    swept = {(r["alpha"]): r["avg_ce"] for r in L.sweep(train, evaluated.withColumn("split", F.lit("test")), size, [0.5, 2.0], keys=("split", "row_id")).collect()}
    assert abs(swept[0.5] - sum(expected.values()) / 4) < 1e-9 and len(swept) == 2


def test_set_metrics(spark):
    df = spark.createDataFrame(
        [("m", "a", "test", 19.999, 1), ("m", "b", "test", 20.0, 3), ("m", "c", "validation", 1.0, 2), ("m", "c", "validation", 0.0, 0)],
        "model string, language string, split string, row_loss double, tokens long",
    )
    got = {r["language"]: r for r in E.ce_ppl(df, ["language"]).collect()}
    assert got["a"]["perplexity"] == math.exp(19.999) and got["b"]["perplexity"] == math.inf
    assert got["c"]["avg_ce"] == 0.5 and got["c"]["count"] == 2
    empty = E.ce_ppl(df.where("false")).collect()[0]
    assert (empty["count"], empty["avg_ce"], empty["perplexity"]) == (0, 0.0, 1.0)
    tokens = E.ce_ppl(df.where("language = 'c'"), weight="token").collect()[0]
    assert abs(tokens["avg_ce"] - 1.0) < 1e-6
    whole = E.ce_ppl(df).collect()[0]["avg_ce"]
    assert abs(whole - sum(r["avg_ce"] * r["count"] for r in got.values()) / 4) < 1e-12
    assert [r["language"] for r in E.ce_by_language(df).collect()] == ["c", "a", "b"]
    only_validation = E.model_summary(df.where("split = 'validation'")).collect()[0]
    assert only_validation["test_ce"] is None and only_validation["test_ppl"] is None and only_validation["val_ce"] == 0.5
    base = spark.createDataFrame([("x", 2.0)], "dataset string, avg_ce double")
    tuned = spark.createDataFrame([("x", 0.5)], "dataset string, avg_ce double")
    assert rows(E.compare_runs(base, tuned)) == [("x", 2.0, 0.5, -1.5)]


def test_log_curves_fill_steps(spark):
    log = [
        (0, None, 1.0, None, None), (1, 5, None, 0.5, 1.0), (2, 3, 2.0, None, None), (3, None, 3.0, 0.25, 2.0), (70000, None, 4.0, None, None),
        (140000, 9, None, None, 3.0),
    ]
    df = spark.createDataFrame([(1, *r) for r in log], "run int, idx long, step int, loss double, eval_loss double, epoch double").repartition(3)
    curves = sorted(rows(L.log_curves(df, ["loss", "eval_loss"]), "metric", "idx", "step", "value"))
    assert curves == [
        ("eval_loss", 1, 5, 0.5), ("eval_loss", 3, 5, 0.25),
        ("loss", 0, 0, 1.0), ("loss", 2, 3, 2.0), ("loss", 3, 5, 3.0), ("loss", 70000, 5, 4.0),
    ]
    assert sorted(rows(L.epoch_marks(df))) == [(1, 5)]
    assert [r["idx"] for r in L.last_logged(df, 2).collect()] == [3, 70000]
    assert sorted(rows(L.log_metric(df, "eval_loss")), key=repr) == sorted([(1, 5, 0.5), (1, None, 0.25)], key=repr)
    assert L.overlay({"a": df, "b": df}).count() == 12


def test_best_and_ranks(spark):
    df = spark.createDataFrame(
        [("b", "ok", 1.0, None), ("a", "ok", 1.0, 3.0), ("c", "failed", None, None), ("d", "ok", 2.0, 2.0)],
        "key string, status string, val_ce double, test_ce double",
    )
    assert rows(L.best(L.ok_runs(df)), "key") == [("a",)]
    assert rows(L.select_winner(df), "key") == [("d",)]
    assert rows(L.select_winner(df.withColumn("test_ce", F.lit(None).cast("double")))) == []
    assert rows(L.best(df.where("status = 'failed'"))) == []
    assert rows(L.ranked(df), "key", "row") == [("d", 1), ("a", 2), ("b", 3), ("c", 4)]
    assert L.grid(spark, lr=[1.0, 2.0], epochs=[1, 2, 3], sched=["cosine"]).count() == 6
    table = L.results_to_rows(spark, {"m": {"val_ce": 1.0}, "n": {"val_ce": 2.0, "test_ce": 3.0}})
    assert rows(table, "model", "val_ce", "test_ce") == [("m", 1.0, None), ("n", 2.0, 3.0)]
    text = E.format_metrics(table, ce=["val_ce"], ppl=["test_ce"])
    assert rows(text, "val_ce", "test_ce")[1] == ("2.0000", "3.00")


def test_counts(spark):
    df = spark.createDataFrame([("Go", "train"), ("go", "test"), (None, "test"), ("ada", "train"), ("Go", "test")], "language string, split string")
    assert rows(A.language_counts(df)) == [("Go", 2), ("ada", 1), ("go", 1)]
    assert rows(A.language_top(df.dropna(), 1)) == [("Go", 2)]
    assert [r["language"] for r in A.language_distribution(df.dropna()).collect()] == ["Go", "go", "ada", "Go"]
    assert sorted(rows(A.corpus_matrix(df.dropna(), totals=True)), key=repr) == sorted(
        [("Go", 1, 0, 1), ("go", 0, 0, 1), ("ada", 1, 0, 0), (None, 2, 0, 2)], key=repr
    )


def test_sums_are_equal_to_the_last_bit_for_any_partitioning(spark):
    rng = random.Random(6)
    data = [(i, rng.choice(["a", "b"]), rng.choice([rng.expovariate(0.3), 1e-7 * rng.random(), 12.0 + rng.random()]), rng.randint(1, 9)) for i in range(20_000)]
    table = spark.createDataFrame([(g, "test", x, t, i) for i, g, x, t in data], "model string, split string, row_loss double, tokens long, row_id long")
    results = set()
    for n in (1, 7, 64):
        some = table.repartition(n, F.rand(n)) if n > 1 else table.coalesce(1)
        plain = E.ce_ppl(some, ["model"]).collect() + E.ce_ppl(some, ["model"], weight="token").collect()
        results.add(tuple(sorted((r["model"], r["avg_ce"].hex(), r["perplexity"].hex()) for r in plain)))
        results.add(tuple(sorted((r["model"], r["test_ce"].hex()) for r in E.model_summary(some).collect())) + ("summary",))
    assert len(results) == 2
    for r in E.ce_ppl(table, ["model"]).collect():
        exact = math.fsum(x for _, g, x, _ in data if g == r["model"]) / r["count"]
        assert abs(r["avg_ce"] - exact) < 1e-15 * max(1.0, exact) * 4


def test_sums_of_odd_values(spark):
    inf, nan = math.inf, math.nan
    cases = {"none": [None], "empty": [], "inf": [1.0, inf], "both": [inf, -inf], "nan": [nan, 1.0], "negative": [-0.1, -2.5, 0.1], "some": [None, 0.25, 0.5]}
    df = spark.createDataFrame([(k, v) for k, vs in cases.items() for v in vs], "k string, v double")
    got = {r["k"]: r["s"] for r in df.groupBy("k").agg(E.exact_sum(F.col("v")).alias("s")).collect()}
    assert got["none"] is None and got["inf"] == inf and math.isnan(got["both"]) and math.isnan(got["nan"])
    assert abs(got["negative"] + 2.5) < 1e-15 and got["some"] == 0.75
    assert df.where("k = 'empty'").agg(E.exact_sum(F.col("v")).alias("s")).first()["s"] is None
