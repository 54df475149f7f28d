"""Quality classifier by positive-unlabelled learning.

A small network over text statistics is trained with the non-negative unbiased risk: trusted positives stand for the
positive class, unlabelled web text for the mixture, and the negative part of the risk - the mixture's minus the prior's
share of the positives' - is not allowed below zero. The class prior is estimated from positives and unlabelled texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField

from .shared import Shipped, append, distinct_sorted, joined, lowered, named, remainder, run_hashes, slices, word_bounds

SAMPLE = 20_000
HIDDEN = 24
PRIOR_STEPS = 150
CONFIDENCE = 0.1
STEPS = 600
RATE = 0.01
THRESHOLD = 0.3
MARKS = b".,;:!?'\"*&%$#|@/\\<>()[]{}=+-_~^`"


def per_text(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (one per byte) over each text."""
    return np.add.reduceat(values, starts[:-1], dtype=np.float64)


def features(column: pa.Array) -> np.ndarray:
    """A row of bounded statistics per text; all zeros for a null or empty text but for the constant parts."""
    data, starts = joined(column)
    low, size = lowered(data), np.diff(starts).astype(np.float64)
    n = np.maximum(size - 1, 1)
    upper, letter, digit = (data >= 65) & (data <= 90), (low >= 97) & (low <= 122), (data >= 48) & (data <= 57)
    line = data == 10
    cols = [per_text(x, starts) / n for x in (letter, upper, digit, data > 127, data == 32)]
    cols += [per_text(data == m, starts) / n for m in MARKS]
    begin, end = word_bounds(data)
    words_at = np.searchsorted(begin, starts)
    count = np.diff(words_at)
    hashes, w = run_hashes(low, begin, end), np.maximum(count, 1).astype(np.float64)
    owner = np.repeat(np.arange(len(count)), count)

    def over_words(values: np.ndarray) -> np.ndarray:
        return np.bincount(owner, values, len(count)) / w

    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    lengths = (end - begin).astype(np.float64)
    last = low[end - 1] if len(end) else np.empty(0, np.uint8)
    plain_end = ((last >= 97) & (last <= 122)) | (last > 127)
    _, distinct = distinct_sorted(hashes, count)
    pairs, pair_count = pair_hashes(hashes, count)
    _, distinct_pairs = distinct_sorted(pairs, pair_count)
    lines = per_text(line, starts)
    mean = over_words(lengths)
    cols += [
        over_words(same.astype(np.float64)),
        distinct / w,
        distinct_pairs / np.maximum(pair_count, 1),
        mean / 20,
        np.sqrt(np.maximum(over_words(lengths**2) - mean**2, 0)) / 20,
        over_words(plain_end.astype(np.float64)),
        over_words((lengths == 1).astype(np.float64)),
        np.log1p(count) / 10,
        np.log1p(size) / 12,
        lines / w,
        np.log1p(w / np.maximum(lines, 1)) / 8,
    ]
    out = np.stack(cols, 1)
    out[size <= 1] = 0
    return out


def pair_hashes(words: np.ndarray, per: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of neighbouring word pairs within each text, and how many each text has."""
    if not len(words):
        return np.empty(0, np.uint64), np.zeros(len(per), np.int64)
    inner = np.ones(len(words), bool)
    inner[(np.cumsum(per) - 1)[per > 0]] = False
    both = words * np.uint64(3) + np.append(words[1:], np.uint64(0)) * np.uint64(0x9E3779B97F4A7C15)
    return both[inner], np.maximum(per - 1, 0)


def softplus(x: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, x)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


class QualityModel:
    """One hidden layer; fitted by minimising the non-negative unbiased risk with the logistic loss.

    Without a prior the unlabelled texts are taken for the other class, half against half, which gives the odds that a text
    is one of the trusted rather than one of the unlabelled.
    """

    def __init__(self, positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, seed: int = 10, steps: int = STEPS):
        everything = np.concatenate([positive, unlabelled])
        self.mean, self.scale = everything.mean(0), everything.std(0) + 1e-6
        self.prior, rng, d = prior, np.random.default_rng(seed), everything.shape[1]
        start = 0.0 if prior is None else np.log(prior / (1 - prior))
        self.w = [rng.normal(0, d**-0.5, (d, HIDDEN)), np.zeros(HIDDEN), rng.normal(0, HIDDEN**-0.5, HIDDEN), np.array(start)]
        self.fit(self.scaled(positive), self.scaled(unlabelled), steps)

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.scale, -6, 6)

    def logits(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        hidden = np.tanh(x @ self.w[0] + self.w[1])
        return hidden @ self.w[2] + self.w[3], hidden

    def gradient(self, x: np.ndarray, hidden: np.ndarray, slope: np.ndarray) -> list[np.ndarray]:
        back = slope[:, None] * self.w[2] * (1 - hidden**2)
        return [x.T @ back, back.sum(0), hidden.T @ slope, slope.sum()]

    def risk(self, p: np.ndarray, u: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """What a step lowers, and its gradient.

        The unbiased risk is prior * E_p[loss(f)] + (E_u[loss(-f)] - prior * E_p[loss(-f)]). The second part estimates the risk
        on the other class, which cannot be negative: where it is, the model has overfitted, and the step raises that part.
        """
        (fp, hp), (fu, hu) = self.logits(p), self.logits(u)
        sp, su = sigmoid(fp) / len(p), sigmoid(fu) / len(u)
        if self.prior is None:
            value, slope_p, slope_u = (softplus(-fp).mean() + softplus(fu).mean()) / 2, (sp - 1 / len(p)) / 2, su / 2
        else:
            negative = softplus(fu).mean() - self.prior * softplus(fp).mean()
            if negative >= 0:
                value, slope_p, slope_u = self.prior * softplus(-fp).mean() + negative, self.prior * (sp - 1 / len(p)) - self.prior * sp, su
            else:
                value, slope_p, slope_u = -negative, self.prior * sp, -su
        return float(value), [a + b for a, b in zip(self.gradient(p, hp, slope_p), self.gradient(u, hu, slope_u))]

    def fit(self, p: np.ndarray, u: np.ndarray, steps: int) -> None:
        m, v = [np.zeros_like(w) for w in self.w], [np.zeros_like(w) for w in self.w]
        for step in range(1, steps + 1):
            for i, (g, w) in enumerate(zip(self.risk(p, u)[1], self.w)):
                g = g + 1e-4 * w
                m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g**2
                self.w[i] = w - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.logits(self.scaled(x))[0])


def estimated_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The share of positives among the unlabelled, from those two samples alone (no known negatives).

    Among the texts that a classifier of positives against unlabelled ranks above some place, there are at least prior times
    as large a share of the unlabelled as of the positives, and no more where no other texts rank. So the prior is the smallest
    ratio of the two shares on texts that the classifier has not seen; the place is chosen where its upper confidence bound is
    smallest, so that a few texts at the top do not decide. Both halves of the samples take either part once.
    """
    found = []
    for turn in (0, 1):
        (pa, pb), (ua, ub) = ((x[turn::2], x[1 - turn :: 2]) for x in (positive, unlabelled))
        if not len(pa) or not len(pb) or not len(ua) or not len(ub):
            return 0.5
        model = QualityModel(pa, ua, None, steps=PRIOR_STEPS)
        p, u = np.sort(model.score(pb)), np.sort(model.score(ub))
        places = np.unique(p)
        above_p = 1 - np.searchsorted(p, places) / len(p)
        above_u = 1 - np.searchsorted(u, places) / len(u)
        slack_p, slack_u = (np.sqrt(np.log(4 / CONFIDENCE) / (2 * n)) for n in (len(p), len(u)))
        able = above_p > 2 * slack_p
        if not able.any():
            found.append(1.0)
            continue
        best = np.argmin((above_u[able] + slack_u) / (above_p[able] - slack_p))
        found.append(float(above_u[able][best] / above_p[able][best]))
    return float(np.mean(found))


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, doc_id: str = "doc_id", text: str = "text", quality: str = "quality") -> QualityModel | None:
    """Learn from at most ``sample`` positives and as many unlabelled texts (those with the lowest id hash).

    ``labels`` gives (doc_id, quality); rows with a null in either are ignored, and so are repeated ones. A document with
    both labels counts as not trusted. Labels other than 1 are used for that alone: the prior is estimated from the positives
    and the unlabelled texts (``estimated_prior``), kept within 0.05 and 0.95. None if there are no positives or no texts.
    """
    known = named(labels, doc_id=doc_id, quality=quality).where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    rows = named(docs, doc_id=doc_id, text=text).where("doc_id is not null")
    lot = (F.xxhash64("doc_id"), "doc_id")
    trusted = known.where("quality = 1").select("doc_id").orderBy(*lot).limit(sample)
    web = rows.select("doc_id").distinct().orderBy(*lot).limit(sample)
    found = {}
    for name, keys in (("positive", trusted), ("unlabelled", web)):
        texts = rows.join(F.broadcast(keys), "doc_id", "left_semi").select("doc_id", "text")
        kind = rows.schema["doc_id"].dataType.simpleString()
        stated = texts.mapInArrow(feature_rows, f"doc_id {kind}, f array<double>")
        got = stated.groupBy("doc_id").agg(F.min("f").alias("f")).select("f").toPandas()["f"]  # one row of an id that repeats
        found[name] = np.array(got.tolist(), float)
    if not len(found["positive"]) or not len(found["unlabelled"]):
        return None
    order = {k: x[np.lexsort(x.T)] for k, x in found.items()}  # sums do not depend on the order of tasks
    # halves are drawn by a fixed shuffle, as sorted rows are alike in pairs
    mixed = {k: x[np.random.default_rng(len(x)).permutation(len(x))] for k, x in order.items()}
    prior = estimated_prior(mixed["positive"], mixed["unlabelled"])
    return QualityModel(order["positive"], order["unlabelled"], float(np.clip(prior, 0.05, 0.95)))


def feature_rows(batches):
    for batch in batches:
        for part in slices(batch, "text"):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(list(features(part.column(1))), pa.list_(pa.float64()))], ["doc_id", "f"])


def with_quality(docs: DataFrame, model: QualityModel | None, text: str = "text", threshold: float = THRESHOLD, names: tuple[str, str] = ("score", "predicted")) -> DataFrame:
    """``docs`` with the probability of good quality and whether it reaches the threshold (1 or 0).

    Null and empty texts get the score of empty statistics. Without a model every score is 0.5.
    """
    shipped = Shipped(docs.sparkSession, model)

    def make():
        def work(column: pa.Array):
            score = shipped.value.score(features(column)) if shipped.value else np.full(len(column), 0.5)
            return score, (score >= threshold).astype(np.int32)

        return work

    return append(docs, text, [StructField(names[0], DoubleType()), StructField(names[1], IntegerType())], make, 2 << 20)


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Rows outside the held-out fifth."""
    return docs.where(remainder(F.col(f"`{doc_id}`"), 5) != 0)
