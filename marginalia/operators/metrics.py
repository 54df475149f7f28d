"""Losses and evaluation metrics.

A model's forward pass is not part of this library; its result enters as a token-loss table. The add-alpha unigram
model below fills that place, so that the whole evaluation can run on any corpus.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..constants import BROADCAST_ROW_BOUND, IGNORE_LABEL, LOSS_EPSILON, PERPLEXITY_LIMIT
from ..functions.text import fixed, scientific

ROW_KEYS = ("dataset", "language", "split", "row_id")


def valid_label(label: Column) -> Column:
    return label.isNotNull() & (label != IGNORE_LABEL)


# A double is cut into bins of these bits behind the binary point; each bin is a whole number, and their sums are exact.
BINS = (16, 39, 62)


def exact_sum(value: Column, only: Column | None = None) -> Column:
    """Sum of doubles that does not depend on the order or the partitioning of the rows, not even in its last bit.

    Each value is taken apart into three whole numbers (parts down to 2^-16, 2^-39 and 2^-62; what is finer is dropped), whose
    sums are exact for up to 2^40 rows of values below 2^22 (a sum beyond a long is an error, never a wrong result). Values
    that are not finite make the sum so too. Nulls and rows without ``only`` are left out; without any value the sum is null.
    """
    value = value if only is None else F.when(only, value)
    finite = F.when(~F.isnan(value) & (F.abs(value) < float("inf")), value)
    parts, rest, before = [], finite, 0
    for bits in BINS:
        scaled = rest * F.lit(float(1 << (bits - before)))
        whole = F.floor(scaled)
        parts.append(F.sum(whole) / F.lit(float(1 << bits)))
        rest, before = scaled - whole, bits
    other = F.sum(F.when(finite.isNull(), value))  # null, NaN or infinite
    total = parts[0] + (parts[1] + parts[2])
    return F.when(other.isNull(), total).otherwise(other)


def exact_avg(value: Column, only: Column | None = None) -> Column:
    """Mean of the values that are not null, from their exact sum."""
    value = value if only is None else F.when(only, value)
    return exact_sum(value) / F.nullif(F.count(value), F.lit(0))


@dataclass(frozen=True)
class UnigramFit:
    """``label, n`` of the scored train labels, their total, and the number of ids there are."""

    counts: DataFrame
    total: int
    vocab_size: int
    bound: int = BROADCAST_ROW_BOUND

    def loss(self, n: Column, alpha: float) -> Column:
        """-ln p of a label that train has ``n`` times, with add-alpha smoothing."""
        return -F.log((F.coalesce(n, F.lit(0)) + F.lit(float(alpha))) / F.lit(self.total + float(alpha) * self.vocab_size))

    def checked(self, label: Column) -> Column:
        """The label; an id that the vocabulary does not have is an error."""
        outside = (label < 0) | (label >= self.vocab_size)
        return F.when(outside, F.raise_error(F.format_string(f"label %d is not an id below {self.vocab_size}", label)).cast("int")).otherwise(label)

    def joined(self, tokens: DataFrame, losses: Mapping[str, float]) -> DataFrame:
        """``tokens`` (one row per ``label``) with one column of losses per entry of ``losses``, name and alpha; null without a label.

        Labels below the broadcast bound are no more rows than that: they meet the tokens where those are, so the tokens of a
        row stay together. Only larger ones, rare if ids follow the count, are shuffled.
        """
        counts = self.counts.select(F.col("label").alias("_label"), *[self.loss(F.col("n"), a).alias(c) for c, a in losses.items()])
        absent = {c: F.when(F.col("label").isNotNull(), F.coalesce(c, self.loss(F.lit(0), a))) for c, a in losses.items()}
        same = F.col("label") == F.col("_label")
        met = lambda some, side: some.join(side, same, "left").drop("_label").withColumns(absent)
        head = F.broadcast(counts.where(F.col("_label") < self.bound))
        if self.vocab_size <= self.bound:
            return met(tokens, head)
        low = F.col("label").isNull() | (F.col("label") < self.bound)
        return met(tokens.where(low), head).unionByName(met(tokens.where(~low), counts.where(F.col("_label") >= self.bound)))


def fit_unigram(train: DataFrame, vocab_size: int) -> UnigramFit:
    """Count the scored labels of ``train`` (a table of any number of ids); only the total comes to the driver."""
    labels = train.select(F.explode("labels").alias("label")).where(valid_label(F.col("label")))
    counts = labels.groupBy("label").agg(F.count(F.lit(1)).alias("n"))
    return UnigramFit(counts, int(counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n), vocab_size)


def shift_labels(df: DataFrame) -> DataFrame:
    """Align labels with losses: the loss at position p is for label p + 1, so the first label is dropped."""
    return df.withColumn("labels", F.slice("labels", F.lit(2), F.size("labels")))


def unigram_losses(
    train: DataFrame, evaluated: DataFrame, vocab_size: int, alpha: float = 1.0, keys: Sequence[str] = ROW_KEYS
) -> DataFrame:
    """Token-loss table of the unigram model and of the uniform one, which knows nothing (``ln vocab_size``).

    One row per model, row and position, masked positions included: a row without any scored label must still count.
    """
    fit = fit_unigram(train, vocab_size)
    tokens = shift_labels(evaluated).select(*keys, F.posexplode_outer("labels").alias("pos", "_all"))
    scored = valid_label(F.col("_all"))
    by_model = F.array(
        F.struct(F.lit("unigram").alias("model"), F.col("_fitted").alias("loss")),
        F.struct(F.lit("uniform").alias("model"), F.lit(math.log(vocab_size)).alias("loss")),
    )
    return (
        fit.joined(tokens.withColumn("label", F.when(scored, fit.checked(F.col("_all")))), {"_fitted": alpha})
        .withColumn("_m", F.explode(by_model))
        .select(*keys, "pos", F.col("_all").alias("label"), "_m.model", F.when(scored, F.col("_m.loss")).otherwise(0.0).alias("loss"))
    )


def row_loss(losses: DataFrame, keys: Sequence[str] = ("model", *ROW_KEYS)) -> DataFrame:
    """Mean loss of each row over its scored positions; 0 if there are none.

    The positions of a row lie together, so the map-side part leaves one record per row for the shuffle.
    """
    scored = valid_label(F.col("label"))
    return losses.groupBy(*keys).agg(
        (F.coalesce(exact_sum(F.col("loss"), scored), F.lit(0.0)) / (F.count_if(scored) + F.lit(LOSS_EPSILON))).alias("row_loss"),
        F.count_if(scored).alias("tokens"),
    )


def scored_labels() -> Column:
    """The labels of a row that count: shifted by one, without the masked ones."""
    return F.filter(F.slice("labels", F.lit(2), F.size("labels")), lambda x: x != IGNORE_LABEL)


def score_rows(evaluated: DataFrame, fit: UnigramFit, alphas: Sequence[float], keys: Sequence[str] = ROW_KEYS) -> DataFrame:
    """The same row means from the label arrays: ``losses`` has one value per alpha, one row per row of ``evaluated``.

    ``keys`` name a row. Its labels meet the losses of all alphas where they are, and one record per row is shuffled; a row without
    any scored label stays with losses of 0.
    """
    rows = evaluated.select(*keys, F.explode_outer(scored_labels()).alias("label"))
    names = {f"_loss{i}": a for i, a in enumerate(alphas)}
    met = fit.joined(rows.withColumn("label", fit.checked(F.col("label"))), names)
    sums = [F.coalesce(exact_sum(F.col(c)), F.lit(0.0)) for c in names]
    tokens = F.count("label")
    return met.groupBy(*keys).agg(F.array(*[x / (tokens + F.lit(LOSS_EPSILON)) for x in sums]).alias("losses"), tokens.cast("int").alias("tokens"))


def uniform_row_loss(vocab_size: int, tokens: Column) -> Column:
    """Every scored label costs ln V; a row without one costs 0."""
    return tokens * F.lit(math.log(vocab_size)) / (tokens + F.lit(LOSS_EPSILON))


def perplexity(ce: Column) -> Column:
    return F.when(ce < PERPLEXITY_LIMIT, F.exp(ce)).otherwise(F.lit(float("inf")))


def ce_ppl(rows: DataFrame, by: Sequence[str] = (), weight: str = "row") -> DataFrame:
    """``count, avg_ce, perplexity`` per group, the same to the last bit however the rows are partitioned.

    Each row weighs the same, or each token with ``weight="token"``.
    """
    if weight == "token":
        ce = exact_sum(F.col("row_loss") * (F.col("tokens") + F.lit(LOSS_EPSILON))) / F.nullif(F.sum("tokens"), F.lit(0))
    else:
        ce = exact_avg(F.col("row_loss"))
    return (
        rows.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("count"), F.coalesce(ce, F.lit(0.0)).alias("avg_ce"))
        .withColumn("perplexity", perplexity(F.col("avg_ce")))
    )


def ce_by_language(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """All languages in one pass, largest first, then by cross-entropy. Rows without a language are left out."""
    return ce_ppl(rows.where(F.trim("language") != ""), [*by, "language"]).orderBy(F.desc("count"), "avg_ce")


def ce_by_dataset(rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    return ce_ppl(rows, [*by, "dataset"])


def model_summary(rows: DataFrame, by: Sequence[str] = ("model",)) -> DataFrame:
    """Validation and test side by side, best test result first. A split without rows gives null."""
    val = exact_avg(F.col("row_loss"), F.col("split") == "validation")
    test = exact_avg(F.col("row_loss"), F.col("split") == "test")
    summary = rows.groupBy(*by).agg(val.alias("val_ce"), test.alias("test_ce"))
    return summary.select(
        *by,
        "val_ce",
        F.when(F.col("val_ce").isNotNull(), perplexity(F.col("val_ce"))).alias("val_ppl"),
        "test_ce",
        F.when(F.col("test_ce").isNotNull(), perplexity(F.col("test_ce"))).alias("test_ppl"),
    ).orderBy(F.asc_nulls_last("test_ce"), *by)


def compare_runs(base: DataFrame, tuned: DataFrame, on: Sequence[str] = ("dataset",)) -> DataFrame:
    """Cross-entropy before and after, per dataset, and the difference."""
    return (
        base.select(*on, F.col("avg_ce").alias("base_ce"))
        .join(tuned.select(*on, F.col("avg_ce").alias("tuned_ce")), list(on))
        .withColumn("difference", F.col("tuned_ce") - F.col("base_ce"))
    )


def format_metrics(df: DataFrame, ce: Sequence[str] = (), ppl: Sequence[str] = (), rate: Sequence[str] = ()) -> DataFrame:
    """Metrics as report text: 4 decimals for cross-entropy, 2 for perplexity, ``1.0e-04`` style for rates."""
    return df.withColumns(
        {**{c: fixed(c, 4) for c in ce}, **{c: fixed(c, 2) for c in ppl}, **{c: scientific(c) for c in rate}}
    )
