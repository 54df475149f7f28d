"""Order, dedup and sampling against brute force, on skewed tables and for several partitionings."""

import hashlib

import pytest
from pyspark.sql import functions as F

from marginalia.operators import dedup as D
from marginalia.operators import ordering as O
from marginalia.operators import sampling as SA
from marginalia.operators.bounds import attach, few_values

N = 3000


def key(ord_, seed=42):
    return hashlib.md5(f"{seed}:{ord_}".encode()).hexdigest()


@pytest.fixture(scope="module")
def skewed(spark):
    """Half of the rows in one language; a third of all rows share one text."""
    return spark.range(N).select(
        F.col("id").alias("ord"),
        F.when(F.col("id") % 2 == 0, "hot").otherwise(F.concat(F.lit("l"), (F.col("id") % 5).cast("string"))).alias("language"),
        F.when(F.col("id") % 10 < 7, "train").when(F.col("id") % 10 < 8, "validation").otherwise("test").alias("split"),
        F.when(F.col("id") % 3 == 0, F.lit("a\nb\nc")).otherwise(F.concat_ws("\n", F.lit("x"), F.lit("y"), (F.col("id") % 700).cast("string"))).alias("code"),
    ).cache()


def local(df):
    return [r.asDict() for r in df.collect()]


def groups(data, *by):
    out = {}
    for r in data:
        out.setdefault(tuple(r[b] for b in by), []).append(r)
    return out


def partitionings(df):
    return [df.repartition(1), df.repartition(7)]


def test_positions_over_many_buckets_and_blocks(spark):
    ords = sorted({(i * 7919) % 500 + (i % 3) * 65536 * 2 + (i % 5) * (1 << 33) + (i % 2) * (1 << 41) for i in range(900)})
    df = spark.createDataFrame([(o, "hot" if o % 3 else "cold") for o in ords], "ord long, g string").repartition(5)
    got = {r["ord"]: r["pos"] for r in local(O.with_position(df, "ord", ["g"]))}
    for name in ("hot", "cold"):
        mine = [o for o in ords if ("hot" if o % 3 else "cold") == name]
        assert [got[o] for o in mine] == list(range(1, len(mine) + 1))
    overall = {r["ord"]: r["pos"] for r in local(O.with_position(df, "ord"))}
    assert [overall[o] for o in ords] == list(range(1, len(ords) + 1))


def test_running_max(spark):
    data = [(i * 40_000, (i * 37) % 101 if i % 4 else None) for i in range(300)]
    df = spark.createDataFrame(data, "idx long, v int").withColumn("run", F.lit(1)).repartition(4)
    got = {r["idx"]: r["m"] for r in local(O.with_running_max(df, ["run"], "idx", {"m": F.col("v")}))}
    so_far = None
    for idx, v in data:
        assert got[idx] == so_far
        so_far = v if so_far is None else so_far if v is None else max(so_far, v)


def test_dedup_keeps_the_smallest_order(spark, skewed):
    first = {}
    for r in sorted(local(skewed), key=lambda r: r["ord"]):
        first.setdefault((r["language"], r["split"], r["code"]), r["ord"])
    for df in partitionings(skewed):
        assert sorted(r["ord"] for r in local(D.dedup_first(df, F.md5("code")))) == sorted(first.values())
        assert sorted(r["ord"] for r in local(D.first_keys(df, F.md5("code")))) == sorted(first.values())


def expected_sample(data, k, *by):
    return sorted(
        r["ord"] for g in groups(data, *by).values() for r in sorted(g, key=lambda r: (key(r["ord"]), r["ord"]))[:k]
    )


def test_sample_small_large_and_without_groups(spark, skewed):
    data = local(skewed)
    for df in partitionings(skewed):
        for bound in (6, None):
            got = SA.sample_k(df, 50, by=["language"], groups=bound)
            assert sorted(r["ord"] for r in local(got)) == expected_sample(data, 50, "language")
    assert sorted(r["ord"] for r in local(SA.sample_k(skewed, 77))) == expected_sample(data, 77)
    assert len(local(SA.sample_k(skewed, 5000))) == N
    spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "40")  # 500 is now a large quota
    try:
        for bound in (6, None):
            got = SA.sample_k(skewed, 500, by=["language"], groups=bound)
            assert sorted(r["ord"] for r in local(got)) == expected_sample(data, 500, "language")
        assert sorted(r["ord"] for r in local(SA.sample_k(skewed, 77))) == expected_sample(data, 77)
        large = SA.sample_quota(skewed, {"train": 100, "test": 60})
        assert {k: len(v) for k, v in groups(local(large), "split").items()} == {("train",): 100, ("test",): 60}
    finally:
        spark.conf.set("spark.sql.optimizer.windowGroupLimitThreshold", "10000")


def test_compact_quota_above_at_and_below_the_group(spark, skewed):
    quotas = {"train": 100, "validation": 10, "test": 100000 // 1000}
    firsts = {}
    for r in sorted(local(skewed), key=lambda r: r["ord"]):
        firsts.setdefault((r["language"], r["split"], r["code"]), r)
    expected = sorted(
        r["ord"] for (lang, split), g in groups(firsts.values(), "language", "split").items()
        for r in sorted(g, key=lambda r: key(r["ord"]))[: quotas[split]]
    )
    for languages in (6, None):
        got = D.compact(skewed, "code", quotas, languages)
        assert sorted(r["ord"] for r in local(got)) == expected


def test_compact_does_not_shuffle_text_under_a_bound(skewed, spark, tmp_path):
    skewed.write.parquet(str(tmp_path / "c"))
    plan = D.compact(spark.read.parquet(str(tmp_path / "c")), "code", languages=6)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan and "WindowGroupLimit" in plan and "SortMergeJoin" not in plan


def test_stratified_split_is_exact(spark, skewed):
    data = local(skewed)
    expected = {}
    for g in groups(data, "language").values():
        n = len(g)
        for i, r in enumerate(sorted(g, key=lambda r: key(r["ord"]))):
            expected[r["ord"]] = "train" if i < 7 * n // 10 else "validation" if i < 8 * n // 10 else "test"
    for df in partitionings(skewed.drop("split")):
        for bound in (6, None):
            assert {r["ord"]: r["split"] for r in local(SA.stratified_split(df, groups=bound))} == expected


def test_stratum_of_one_row(spark):
    df = spark.createDataFrame([(1, "a"), (2, "b"), (3, "b")], "ord long, language string")
    got = {r["ord"]: r["split"] for r in local(SA.stratified_split(df, groups=2))}
    assert got[1] == "test" and sorted([got[2], got[3]]) == ["test", "train"]


def test_shuffle_position_is_a_permutation_in_hash_order(skewed):
    for df in partitionings(skewed):
        got = sorted((r["shuffle_pos"], r["ord"]) for r in local(SA.shuffle_positions(df)))
        assert got == list(zip(range(1, N + 1), sorted(range(N), key=key)))
    assert [r["ord"] for r in local(SA.shuffle_rows(skewed))] == sorted(range(N), key=key)


def test_mix_takes_what_is_there(spark, skewed):
    rows_ = skewed.select("ord", "split", F.col("code").alias("text"))
    few = rows_.where("ord < 50")
    mixed = SA.mix({"code": rows_, "commit": few}, {"train": 100, "validation": 10, "test": 20})
    count = {k: len(v) for k, v in groups(local(mixed), "source", "split").items()}
    assert count[("code", "train")] == 50 and count[("commit", "train")] == 35 and count[("commit", "validation")] == 5
    for g in groups(local(mixed), "split").values():
        assert sorted(r["shuffle_pos"] for r in g) == list(range(1, len(g) + 1))
    weighted = SA.mix({"code": rows_, "commit": few}, {"train": 40}, {"code": 75, "commit": 25})
    assert {k: len(v) for k, v in groups(local(weighted), "source").items()} == {("code",): 30, ("commit",): 10}
    empty = SA.mix({"code": rows_, "commit": few.where("false")}, {"train": 40})
    assert len(local(empty)) == 20


def test_side_tables(spark, skewed):
    assert few_values(skewed, "language", at_most=3) is None
    assert few_values(skewed, "split") == [("test",), ("train",), ("validation",)]
    side = skewed.groupBy("language").agg(F.count(F.lit(1)).alias("n"))
    for bound in (6, None):
        assert sum(r["n"] > 0 for r in local(attach(skewed, side, ["language"], "ord", bound))) == N


def test_heads_and_tiny_slices(skewed):
    assert [r["ord"] for r in local(SA.head_rows(skewed.repartition(5), 4))] == [0, 1, 2, 3]
    tiny = groups(local(SA.tiny_slice(skewed, F.col("ord") > 10, {"train": 16, "validation": 8})), "split")
    assert {k: len(v) for k, v in tiny.items()} == {("train",): 16, ("validation",): 8}
