"""Fits on repeated ids: what reaches the driver follows the documented sample, whatever the rows."""

import tracemalloc

import numpy as np
import pyarrow as pa
from helpers import documents, prose
from pyspark.sql import functions as F

from marginalia.llm import op1_secrets, op2_language, op9_packing, op10_quality
from marginalia.llm.queries import vocabulary_file


def repeated(spark, texts, times=5_000):
    """``texts`` under ids from 1 on, and ``times`` rows of id 0 with texts of their own."""
    docs = documents(spark, ["", *texts]).where("doc_id > 0")
    many = spark.range(times, numPartitions=8).select(F.lit(0).cast("long").alias("doc_id"), F.format_string("token=abcdef%d and some words", "id").alias("text"))
    return docs.unionByName(many.select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("long").alias("n_chars")))


def test_secret_windows_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op1_secrets.Field, "fit", lambda self, features, tags, *a, **k: seen.append(tags.shape[0]))
    monkeypatch.setattr(op1_secrets, "varied", lambda f, t, i: f)
    docs = repeated(spark, ["password=abcdef12 " * 5_000, *[prose(i, 50) for i in range(30)]])
    op1_secrets.fit(docs, sample=10)
    assert 0 < seen[0] <= 2 * 20 * 2 * op1_secrets.TEXT_WINDOWS
    pieces = docs.select("text").mapInArrow(op1_secrets.training_windows, "f array<int>, t array<int>").count()
    assert pieces <= 5_031 * 2 + 2 * op1_secrets.TEXT_WINDOWS


def test_languages_learn_one_text_of_an_id(spark):
    texts = [prose(i, 40) for i in range(20)]
    models = [op2_language.fit(op2_language.learnable(repeated(spark, texts, n).repartition(n % 7 + 1)), train_texts=50) for n in (5_000, 5_000)]
    assert np.array_equal(models[0].known, models[1].known)
    one = op2_language.fit(repeated(spark, texts, 5_000), train_texts=50)
    alone = op2_language.fit(documents(spark, ["", *texts]).where("doc_id > 0"), train_texts=50)
    assert len(alone.known) < len(one.known) < len(alone.known) + 100


def test_quality_features_are_bounded(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(op10_quality, "QualityModel", lambda p, u, *a: seen.append((len(p), len(u))))
    docs = repeated(spark, [prose(i, 30) for i in range(40)])
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)] + [(0, 1)] * 50, "doc_id long, quality int")
    op10_quality.fit(docs, labels, sample=10)
    assert seen == [(10, 10)] or (seen[0][0] <= 10 and seen[0][1] <= 10)


def test_secret_windows_meet_in_spark(spark, monkeypatch):
    """Of the windows of all sampled texts, the driver gets those it trains on; they are the ones of the whole order."""
    docs = documents(spark, [f"password=abcdef{i} " * 400 for i in range(400)]).cache()
    assert docs.count() == 400
    made = docs.select("text").mapInArrow(op1_secrets.training_windows, "f array<int>, t array<int>").collect()
    order = sorted((not any(t), int(np.dot(np.array(f) % 1009, np.arange(len(f)) % 997) % 10007), np.array(f, np.int32).tobytes(), t) for f, t in made)
    seen = []
    monkeypatch.setattr(op1_secrets.Field, "fit", lambda self, features, tags, *a, **k: seen.append((features[:100].copy(), tags[:100].copy())))
    monkeypatch.setattr(op1_secrets, "SAMPLE_WINDOWS", 100)
    op1_secrets.fit(docs, sample=400)
    features, tags = seen.pop()
    for f, t, (_, _, wanted, wanted_tags) in zip(features, tags, order, strict=False):
        assert t[: len(wanted_tags)].tolist() == wanted_tags and (t[len(wanted_tags) :] == -1).all()
        assert f[: len(wanted_tags)].astype(np.int32).tobytes() == wanted
    tracemalloc.start()
    try:
        op1_secrets.fit(docs, sample=400)
        assert tracemalloc.get_traced_memory()[1] < 4 << 20  # all 8,000 windows are 18 MB and more
    finally:
        tracemalloc.stop()
        docs.unpersist()


def test_field_is_fitted_in_little_memory(monkeypatch):
    rng, n = np.random.default_rng(5), 2 * op1_secrets.SAMPLE_WINDOWS
    sizes = rng.integers(1, op1_secrets.WINDOW + 1, n)
    features = rng.integers(0, op1_secrets.BUCKETS, (n, op1_secrets.WINDOW, op1_secrets.Tokens.GROUPS)).astype(np.int16)
    tags = np.where(np.arange(op1_secrets.WINDOW) < sizes[:, None], rng.integers(0, 3, (n, op1_secrets.WINDOW)), -1).astype(np.int8)
    monkeypatch.setattr(op1_secrets, "STEPS", 2)
    tracemalloc.start()
    try:
        op1_secrets.Field().fit(features, tags)
        assert tracemalloc.get_traced_memory()[1] < 30 << 20  # 110 MB and more with all windows in a step
    finally:
        tracemalloc.stop()


def test_field_does_not_depend_on_the_windows_of_a_step(monkeypatch):
    rng, n = np.random.default_rng(6), 90
    features = rng.integers(0, op1_secrets.BUCKETS, (n, 12, op1_secrets.Tokens.GROUPS))
    tags = np.where(np.arange(12) < rng.integers(0, 13, n)[:, None], rng.integers(0, 3, (n, 12)), -1)
    monkeypatch.setattr(op1_secrets, "STEPS", 5)
    fields = []
    for together in (1, 7, 90, 1000):
        monkeypatch.setattr(op1_secrets, "TOGETHER", together)
        fields.append(op1_secrets.Field())
        fields[-1].fit(features, tags)
    for field in fields[1:]:
        assert all(np.array_equal(getattr(field, k), getattr(fields[0], k)) for k in ("weights", "moves", "ends"))


def test_packing_slice_takes_little_memory():
    units, kinds = op9_packing.Units(vocabulary_file("word_bpe_49k.json")), op9_packing.character_classes()
    column = pa.array([" ".join(prose(i, 60) for i in range(1_500))])
    op9_packing.token_ids(column, units, kinds)
    tracemalloc.start()
    try:
        op9_packing.token_ids(column, units, kinds)
        assert tracemalloc.get_traced_memory()[1] < 84 * len(column[0].as_py())  # 95 bytes a character with all arrays held
    finally:
        tracemalloc.stop()
