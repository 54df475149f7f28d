"""Reading, writing, checking and streaming."""

import pytest
from tuples import rows
from pyspark.sql import functions as F

from marginalia.operators.sets import concat, distinct_values, sorted_values
from marginalia.plans.code_corpus import clean_code
from marginalia.sources import corpora as S
from marginalia.streaming.ingest import clean_available, clean_into, watch_folder


@pytest.fixture(scope="module")
def corpus(spark):
    return spark.range(60).select(
        F.col("id").alias("ord"),
        F.element_at(F.array(F.lit("C++"), F.lit("Objective C"), F.lit("go")), (F.col("id") % 3 + 1).cast("int")).alias("language"),
        F.when(F.col("id") % 5 == 0, "test").otherwise("train").alias("split"),
        F.lit("text").alias("text"),
    )


def test_language_folders_are_pruned(spark, corpus, tmp_path):
    path = str(tmp_path / "by_language")
    S.write_by_language(corpus, path)
    back = S.read_corpus(spark, path, "Objective C")
    assert sorted(rows(back, "ord")) == [(i,) for i in range(60) if i % 3 == 1]
    scan = back.where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(lang_dir" in scan
    whole = S.read_corpus(spark, path)
    assert whole.count() == 60
    listed = S.list_partitions(spark, path)
    assert sorted(rows(listed)) == sorted((d, s) for d in ("c++", "objective_c", "go") for s in ("train", "test"))
    plan = listed._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in plan and "FileScan binaryFile [lang_dir" in plan and "ReadSchema: struct<>" in plan
    S.assert_partitions(spark, path, [("go", "train")])
    with pytest.raises(FileNotFoundError):
        S.assert_partitions(spark, path, [("go", "validation")])


def test_write_and_verify(spark, corpus, tmp_path):
    path = str(tmp_path / "corpus")
    S.write_corpus(corpus, path)
    assert all(r["same"] for r in S.verify_written(corpus, path).collect())
    wrong = S.verify_written(corpus.where("ord <> 3").unionByName(corpus.withColumn("split", F.lit("extra")).limit(1)), path)
    assert {r["split"]: r["same"] for r in wrong.collect()} == {"train": False, "test": True, "extra": False}


def test_write_counts_its_rows(spark, corpus, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(batches):
        for b in batches:
            calls.add(b.num_rows)
            yield b

    path = str(tmp_path / "counted")
    some = corpus.withColumn("split", F.expr("case when ord < 3 then 'extra' when ord < 5 then null else split end"))
    counts = S.write_counted(some.mapInArrow(counted, some.schema), path)
    assert calls.value == 60 and counts == {"train": 44, "validation": 0, "test": 11, "(other)": 5}
    checked = S.verify_counts(spark, path, counts)
    assert {r["split"]: (r["expected"], r["found"], r["same"]) for r in checked.collect()} == {s: (n, n, True) for s, n in counts.items() if n}
    assert "ReadSchema: struct<>" in checked._jdf.queryExecution().executedPlan().toString()  # row counts come from the footers
    wrong = S.verify_counts(spark, path, {**counts, "train": 1, "test": 0}).collect()
    assert {r["split"]: r["same"] for r in wrong} == {"train": False, "test": False, "(other)": True}


def test_splits_tags_and_order(spark, corpus, tmp_path):
    one, two = str(tmp_path / "one"), str(tmp_path / "two")
    corpus.where("ord < 30").select("ord", "text").repartition(3).write.parquet(one)
    corpus.where("ord >= 30").select("ord", F.lit("x").alias("extra")).write.json(two)
    splits = S.read_splits(spark, {"train": one, "test": one})
    assert sorted(rows(splits.groupBy("split").count())) == [("test", 30), ("train", 30)]
    assert "Union" not in splits.where("split = 'test'")._jdf.queryExecution().optimizedPlan().toString()
    tagged = S.read_tagged(spark, {"go": one}).unionByName(S.read_tagged(spark, {"php": two}, fmt="json", schema="ord long, extra string"), allowMissingColumns=True)
    assert tagged.columns == ["ord", "text", "language", "extra"] and tagged.count() == 60
    numbered = S.with_order(spark.read.parquet(one).withColumnRenamed("ord", "was"))
    first, again = ({r["was"]: r["ord"] for r in df.collect()} for df in (numbered, numbered.repartition(2)))
    assert first == again and len(set(first.values())) == 30


def test_missing_splits(corpus):
    assert rows(S.split_or_empty(corpus, "validation")) == []
    assert {r["split"] for r in S.split_or_nth(corpus, "validation", 1).collect()} == {"test"}
    assert {r["split"] for r in S.split_or_nth(corpus, "test", 0).collect()} == {"test"}
    assert S.profile(corpus)[0] == ("ord", "bigint")
    assert rows(S.preview(corpus, 2, 3), "ord", "text") == [(0, "tex"), (1, "tex")]


def test_sets(spark):
    a = spark.createDataFrame([("x", 1), ("", 2)], "l string, n int")
    b = spark.createDataFrame([(3, "x"), (4, " "), (5, None)], "n int, l string")
    assert concat(a, b).count() == 5
    assert sorted(rows(distinct_values([a, b], "l")), key=repr) == sorted([("x",), ("",), (" ",), (None,)], key=repr)
    assert rows(sorted_values(concat(a, b), "l")) == [("x",)]


def test_cleaning_a_stream_gives_the_batch_result(spark, tmp_path):
    docs = ["Return the number of the items given.", "too short.", "Return the number of all the items.\n\n:param x: y", None]
    raw = spark.range(40).select(
        F.col("id").alias("ord"),
        F.lit("train").alias("split"),
        F.lit("a\nb\nc").alias("func_code_string"),
        F.get(F.array(*[F.lit(d) for d in docs]), (F.col("id") % 4).cast("int")).alias("func_documentation_string"),
    )
    source, target = str(tmp_path / "raw"), str(tmp_path / "clean")
    raw.repartition(4).write.parquet(source)
    stream = watch_folder(spark, source, raw.schema, files_per_batch=2)
    clean_into(stream, clean_code, target, str(tmp_path / "state")).trigger(availableNow=True).start().awaitTermination()
    expected = sorted(rows(clean_code(raw), "ord", "docstring"))
    assert len(expected) == 20 and sorted(rows(spark.read.parquet(target), "ord", "docstring")) == expected


def test_a_stopped_stream_goes_on(spark, tmp_path):
    raw = spark.range(90).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 3 == 0, "test").otherwise("train").alias("split"),
        F.lit("a\nb\nc").alias("func_code_string"),
        F.when(F.col("id") % 2 == 0, "Return the number of the items given.").otherwise("too short.").alias("func_documentation_string"),
    )
    source, target, state = (str(tmp_path / n) for n in ("raw", "clean", "state"))
    raw.where("ord < 40").repartition(4).write.parquet(source)
    stream = watch_folder(spark, source, raw.schema, files_per_batch=1)
    running = clean_into(stream, clean_code, target, state).trigger(availableNow=True).start()
    while not running.recentProgress and running.isActive:
        running.awaitTermination(0.05)
    running.stop()  # half-way
    raw.where("ord >= 40").repartition(3).write.mode("append").parquet(source)
    for _ in range(2):  # the second run finds nothing new
        clean_available(spark, source, clean_code, target, state, raw.schema, files_per_batch=2)
    expected = sorted(rows(clean_code(raw), "ord", "split", "docstring"))
    assert len(expected) == 45 and sorted(rows(spark.read.parquet(target), "ord", "split", "docstring")) == expected
