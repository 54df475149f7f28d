"""Training logs, sweeps and the choice of a best run."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .metrics import ROW_KEYS, exact_avg, fit_unigram, perplexity, score_rows
from .ordering import first_k, with_running_max

METRICS = ("loss", "eval_loss", "learning_rate")
EPOCH_EVIDENCE = ("train_runtime", "train_loss", "eval_loss")


def with_steps(df: DataFrame, run: str = "run", idx: str = "idx") -> DataFrame:
    """Give a log row without a step the largest step so far (0 at the start of a run)."""
    carried = with_running_max(df, [run], idx, {"_so_far": F.col("step")})
    return carried.withColumn("step", F.coalesce("step", F.greatest(F.col("_so_far"), F.lit(0)))).drop("_so_far")


def log_curves(df: DataFrame, metrics: Sequence[str] = METRICS, run: str = "run", idx: str = "idx") -> DataFrame:
    """Long-form curves ``run, idx, metric, step, value``, one row where a metric is present."""
    points = F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("value")) for m in metrics])
    return (
        with_steps(df.select(run, idx, "step", *metrics), run, idx)
        .select(run, idx, "step", F.explode(points).alias("_p"))
        .select(run, idx, "_p.metric", "step", "_p.value")
        .where(F.col("value").isNotNull())
    )


def log_metric(df: DataFrame, name: str, run: str = "run") -> DataFrame:
    """Rows that have the metric, with their own step."""
    return df.where(F.col(name).isNotNull()).select(run, "step", F.col(name).cast("double").alias("value"))


def epoch_marks(df: DataFrame, run: str = "run", idx: str = "idx") -> DataFrame:
    """Steps at which an epoch ended: the epoch is logged together with an end-of-run or evaluation value."""
    evidence = [c for c in EPOCH_EVIDENCE if c in df.columns]
    ended = F.col("epoch").isNotNull() & F.coalesce(*[F.col(c) for c in evidence]).isNotNull()
    stepped = with_steps(df.select(run, idx, "step", "epoch", *evidence), run, idx)
    return stepped.where(ended).select(run, "step").distinct()


def last_logged(df: DataFrame, n: int = 10, run: str = "run", idx: str = "idx", digits: int = 6) -> DataFrame:
    """Last ``n`` rows of each run that have a loss, numbers rounded, in log order."""
    last = first_k(df.where(F.col("loss").isNotNull()), [run], [F.desc(idx)], n, idx).drop("rank_in_group")
    numbers = [f.name for f in df.schema if f.dataType.typeName() in ("double", "float")]
    return last.withColumns({c: F.round(c, digits) for c in numbers}).orderBy(run, idx)


def overlay(runs: Mapping[str, DataFrame]) -> DataFrame:
    """Curves of several runs in one long table, keyed by run name."""
    result = None
    for name, df in runs.items():
        named = df.withColumn("curve", F.lit(name))
        result = named if result is None else result.unionByName(named)
    return result


def with_grid(df: DataFrame, **axes: Sequence) -> DataFrame:
    """Every row once per combination of the values of the axes (literal lists, so no join is needed)."""
    for name, values in axes.items():
        df = df.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return df


def grid(spark: SparkSession, **axes: Sequence) -> DataFrame:
    """Sweep grid: one row per combination. An axis with one value is a fixed setting."""
    return with_grid(spark.range(1), **axes).drop("id")


def sweep(train: DataFrame, evaluated: DataFrame, vocab_size: int, alphas: Sequence[float], by: Sequence[str] = ("split",), keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """``alpha, count, avg_ce, perplexity`` per group for all values of the sweep, in one pass.

    ``keys`` name a row and hold ``by``. Each row is scored for all values at once; only the few result rows are multiplied by
    the grid.
    """
    scored = score_rows(evaluated, fit_unigram(train, vocab_size), alphas, keys)
    means = scored.groupBy(*by).agg(
        F.count(F.lit(1)).alias("count"), *[exact_avg(F.get("losses", F.lit(i))).alias(f"_a{i}") for i in range(len(alphas))]
    )
    rows = F.array(*[F.struct(F.lit(float(a)).alias("alpha"), F.col(f"_a{i}").alias("avg_ce")) for i, a in enumerate(alphas)])
    return (
        means.select(*by, "count", F.explode(rows).alias("_r"))
        .select(*by, "_r.alpha", "count", "_r.avg_ce")
        .withColumn("perplexity", perplexity(F.col("avg_ce")))
    )


def ok_runs(df: DataFrame) -> DataFrame:
    return df.where(F.col("status") == "ok")


def best(df: DataFrame, metric: str = "val_ce", by: Sequence[str] = (), key: str = "key") -> DataFrame:
    """The row with the lowest metric of each group; ties go to the smaller key."""
    row = F.min_by(F.struct(*[F.col(c) for c in df.columns if c not in by]), F.struct(metric, key))
    picked = df.where(F.col(metric).isNotNull()).groupBy(*by).agg(row.alias("_best")).where("_best IS NOT NULL")
    return picked.select(*by, "_best.*")


def ranked(df: DataFrame, metric: str = "test_ce", key: str = "key", by: Sequence[str] = ()) -> DataFrame:
    """A summary table with the row number of its order by metric (nulls last, ties by key)."""
    order = W.partitionBy(*by).orderBy(F.asc_nulls_last(metric), key)
    return df.withColumn("row", F.row_number().over(order)).orderBy(*by, "row")


def top_then_sort(df: DataFrame, n: int = 15, count: str = "count", metric: str = "perplexity", key: str = "language") -> DataFrame:
    """The ``n`` largest groups, shown in the order of the metric."""
    return df.orderBy(F.desc(count), key).limit(n).orderBy(metric, key)


def select_winner(df: DataFrame, key: str = "key") -> DataFrame:
    """The run with the lowest test cross-entropy; no row if no run was tested."""
    return best(df, "test_ce", key=key)


def results_to_rows(spark: SparkSession, results: Mapping[str, Mapping[str, float]], key: str = "model") -> DataFrame:
    """A dict of metric dicts as a table with one row per key; absent metrics are null."""
    names = list(dict.fromkeys(m for metrics in results.values() for m in metrics))
    schema = ", ".join([f"`{key}` string", *[f"`{m}` double" for m in names]])
    return spark.createDataFrame([(k, *[metrics.get(m) for m in names]) for k, metrics in results.items()], schema)


def metrics_to_rows(df: DataFrame, names: Sequence[str], key: str = "key") -> DataFrame:
    """Long metrics ``key, metric, value`` as one row per key, one column per name."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col("metric") == n, F.col("value"))).alias(n) for n in names])
