"""Language identification by prediction by partial matching with frozen statistics.

Each language has a context tree over bytes: how often each byte followed each context of 0 to ``order`` bytes. A byte
costs what an arithmetic coder would spend on it: the longest known context predicts it, or escapes to the next shorter
one (escape method C: as many escape counts as the context has distinct followers), where the bytes that the longer
context knew are excluded; below the empty context, the remaining bytes are equally likely. Statistics are frozen after
training, so the cost of a byte depends on the ``order`` bytes before it alone and is a table look-up.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField

from ..operators.ordering import first_k
from .shared import Shipped, append, give_back, joined, lowered, named, one_text_each, remainder, slices, tidy

ORDER = 4
TRAIN_TEXTS = 1500
UNDETERMINED = "und"
PAD = 10


def grams(data: np.ndarray, starts: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """For each byte of each text, (its ``order`` predecessors, the byte) as one integer; and the bytes per text.

    What lies before a text counts as line feeds. ``data`` has one separator after each text, which is not coded.
    """
    lengths = np.diff(starts) - 1
    wide, codes = data.astype(np.uint64), np.zeros(len(data), np.uint64)
    for k in range(order + 1):
        codes[k:] |= wide[: max(0, len(wide) - k)] << np.uint64(8 * k)
    for j in range(order):
        at = starts[:-1][lengths > j] + j
        fixed = np.zeros(len(at), np.uint64)
        for k in range(order + 1):
            fixed |= (wide[at - k] if k <= j else np.uint64(PAD)) << np.uint64(8 * k)
        codes[at] = fixed
    coded = np.ones(len(data), bool)
    coded[starts[1:] - 1] = False
    return codes[coded], lengths


class ContextTree:
    """Follower counts of one language for all contexts of up to ``order`` bytes; ``bits`` gives exact code lengths."""

    def __init__(self, codes: np.ndarray, counts: np.ndarray, order: int):
        self.order, self.levels = order, []
        for k in range(order + 1):
            followers, at = np.unique(codes & low_bits(8 * (k + 1)), return_inverse=True)
            n = np.bincount(at, counts, len(followers)).astype(np.float64)
            contexts, of = np.unique(followers >> np.uint64(8), return_inverse=True)
            total, distinct = np.bincount(of, n, len(contexts)), np.bincount(of, minlength=len(contexts)).astype(np.float64)
            if k:  # what the next shorter context counts for the followers known here
                below = self.levels[-1]
                shorter = below["n"][np.searchsorted(below["followers"], followers & low_bits(8 * k))]
                excluded = np.bincount(of, shorter, len(contexts))
            else:
                excluded = np.zeros(len(contexts))
            self.levels.append({"followers": followers, "n": n, "contexts": contexts, "total": total, "distinct": distinct, "excluded": excluded})

    def forget_longest(self) -> None:
        """Drop the followers of the longest contexts: grams that any language has seen are looked up in one table."""
        self.levels[-1] |= {"followers": np.empty(0, np.uint64), "n": np.empty(0)}

    def bits(self, codes: np.ndarray) -> np.ndarray:
        """Code length of each gram's last byte after the bytes before it."""
        cost, open_ = np.zeros(len(codes)), np.arange(len(codes))
        gone, known = np.zeros(len(codes)), np.zeros(len(codes))  # counts and symbols excluded by the longer context
        for k in range(self.order, -1, -1):
            level, code = self.levels[k], codes[open_]
            context, seen = find(level["contexts"], (code & low_bits(8 * (k + 1))) >> np.uint64(8))
            follower, hit = find(level["followers"], code & low_bits(8 * (k + 1)))
            distinct = np.where(seen, level["distinct"][context], 0) if len(level["contexts"]) else np.zeros(len(code))
            total = np.where(seen, level["total"][context], 0) if len(level["contexts"]) else np.zeros(len(code))
            room = (total - gone[open_]) + (distinct - known[open_])
            can = seen & (room > 0)
            share = np.where(hit, level["n"][follower] if len(level["n"]) else 0, distinct - known[open_])
            cost[open_[can]] -= np.log2(share[can] / room[can])
            if k:
                gone[open_] = np.where(seen, level["excluded"][context] if len(level["contexts"]) else 0, 0)
            known[open_] = np.where(seen, distinct, 0)
            open_ = open_[~hit]
        cost[open_] += np.log2(256 - known[open_])
        return cost


def low_bits(n: int) -> np.uint64:
    return np.uint64((1 << n) - 1)


def find(ordered: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Position of each wanted value in the sorted array (any position if it is not there), and whether it is there."""
    if not len(ordered):
        return np.zeros(len(wanted), np.int64), np.zeros(len(wanted), bool)
    at = np.minimum(np.searchsorted(ordered, wanted), len(ordered) - 1)
    return at, ordered[at] == wanted


class HashIndex:
    """Positions of distinct 64-bit keys by open addressing, for whole arrays at a time."""

    def __init__(self, keys: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(4 * len(keys)).bit_length()))
        self.slots = np.full(1 << (64 - int(self.shift)), -1, np.int32)
        self.keys, self.mask = keys, np.int64(len(self.slots) - 1)
        at, left = self.home(keys), np.arange(len(keys))
        while len(left):
            free = left[self.slots[at[left]] < 0]
            self.slots[at[free]] = free  # of several for one slot, one stays
            left = left[self.slots[at[left]] != left]
            at[left] = (at[left] + 1) & self.mask

    def home(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """Position of each wanted key, or -1."""
        if not len(self.keys):
            return np.full(len(wanted), -1, np.int32)
        at = self.home(wanted)
        out = self.slots[at]
        off = np.flatnonzero((out >= 0) & (self.keys[out] != wanted))
        while len(off):
            at[off] = (at[off] + 1) & self.mask
            got = self.slots[at[off]]
            out[off] = got
            off = off[(got >= 0) & (self.keys[got] != wanted[off])]
        return out


class LanguageModel:
    """Context trees of the learned languages, and the code lengths of every gram seen in training."""

    def __init__(self, languages: list[str], counted: dict[str, tuple[np.ndarray, np.ndarray]], order: int = ORDER):
        self.languages, self.order = sorted(languages), order
        self.trees = [ContextTree(*counted[x], order) for x in self.languages]
        self.known = np.unique(np.concatenate([counted[x][0] for x in self.languages])) if languages else np.empty(0, np.uint64)
        self.bits = self.of(self.known).astype(np.float32)
        for tree in self.trees:
            tree.forget_longest()

    def of(self, codes: np.ndarray) -> np.ndarray:
        return np.stack([tree.bits(codes) for tree in self.trees], 1) if self.trees else np.zeros((len(codes), 0))

    def lengths(self, column: pa.Array, index: HashIndex) -> np.ndarray:
        """Code length in bits of each text under each language."""
        data, starts = joined(column)
        codes, sizes = grams(lowered(data), starts, self.order)
        out, full = np.zeros((len(sizes), len(self.languages))), sizes > 0
        if not len(codes) or not self.languages:
            return out
        at = index.find(codes)
        new, row = np.unique(codes[at < 0], return_inverse=True)
        at[at < 0] = len(self.known) + row
        bits, first = np.concatenate([self.bits, self.of(new).astype(np.float32)]), (np.cumsum(sizes) - sizes)[full]
        for i in range(len(self.languages)):
            out[full, i] = np.add.reduceat(np.ascontiguousarray(bits[:, i])[at], first, dtype=np.float64)
        return out


def has_letter(column: pa.Array) -> np.ndarray:
    data, starts = joined(column)
    lower = data | 32
    found = np.add.reduceat((lower >= 97) & (lower <= 122), starts[:-1]) > 0
    for i in np.flatnonzero(~found & (np.maximum.reduceat(data, starts[:-1]) > 127)).tolist():
        found[i] = any(c.isalpha() for c in column[i].as_py())
    return found


def fit(docs: DataFrame, order: int = ORDER, train_texts: int = TRAIN_TEXTS, doc_id: str = "doc_id", text: str = "text", lang: str = "lang") -> LanguageModel:
    """Statistics of the whole texts of at most ``train_texts`` documents per language (those with the lowest id hash).

    Rows without text, language or id teach nothing, and an id that repeats teaches one text of a language. Grams are counted by Spark; the driver gets the counts, whose number
    is bounded by the sampled texts.
    """
    rows = named(docs, doc_id=doc_id, text=text, lang=lang).where("doc_id is not null and lang is not null and text is not null")
    lot = [F.xxhash64("doc_id"), "doc_id"]
    chosen = first_k(rows.select("doc_id", "lang").distinct(), ["lang"], lot, train_texts, "doc_id").select("doc_id", "lang")
    sample = one_text_each(rows, chosen, "doc_id", "lang").select("lang", "text")

    def count(batches):
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                names = part.column(0).to_pylist()
                for name in sorted(set(names)):
                    at = pa.array([i for i, x in enumerate(names) if x == name])
                    data, starts = joined(part.column(1).take(at))
                    codes, n = np.unique(grams(lowered(data), starts, order)[0], return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(codes), pa.string()), pa.array(codes.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    found = sample.mapInArrow(tidy(count), "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toArrow()
    names = found["lang"].combine_chunks().dictionary_encode()
    which, gram, n = names.indices.to_numpy(), found["gram"].to_numpy().view(np.uint64), found["n"].to_numpy()
    counted = {name: (gram[which == i], n[which == i]) for i, name in enumerate(names.dictionary.to_pylist())}
    del found, names, which, gram, n
    model = LanguageModel(list(counted), counted, order)
    del counted
    give_back()
    return model


def with_language(docs: DataFrame, model: LanguageModel, text: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the language of the shortest code (ties: first in name order) and its share of the likelihoods.

    A null text, a text without a letter (no character of a Unicode letter category) and every text when no language was
    learned give ``und`` and 0. The score is 2^-length of the best over the sum of all: 1 / (number of languages) at a tie.
    """
    shipped = Shipped(docs.sparkSession, model)

    def make():
        model = shipped.value
        index = HashIndex(model.known)

        def work(column: pa.Array):
            bits = model.lengths(column, index)
            if not model.languages:
                return [UNDETERMINED] * len(column), np.zeros(len(column))
            sure, best = has_letter(column), bits.argmin(1)
            score = 1 / np.exp2(np.minimum(bits.min(1, keepdims=True) - bits, 0)).sum(1)
            label = np.where(sure, np.array(model.languages, object)[best], UNDETERMINED)
            return label.tolist(), np.where(sure, score, 0.0)

        return work

    return append(docs, text, [StructField(names[0], StringType()), StructField(names[1], DoubleType())], make, 1 << 19)


def keep_identified(docs: DataFrame, model: LanguageModel, least: float = 0.5, text: str = "text") -> DataFrame:
    """The rows whose language is determined with a score of ``least`` or more; columns as they were."""
    label, score = "_lang_pred", "_lang_score"
    while {label, score} & {c.lower() for c in docs.columns}:
        label, score = label + "_", score + "_"
    seen = with_language(docs, model, text, (label, score))
    return seen.where((F.col(label) != UNDETERMINED) & (F.col(score) >= least)).drop(label, score)


def learnable(docs: DataFrame, doc_id: str = "doc_id") -> DataFrame:
    """Documents outside the held-out quarter."""
    return docs.where(remainder(F.col(f"`{doc_id}`"), 4) != 2)
