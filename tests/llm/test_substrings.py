"""Removal of repeated passages against a table of all windows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, prose
from pyspark.sql import functions as F

from marginalia.llm.op12_substrings import SuffixAutomaton, anchored_runs, range_hashes, remove_repeats

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def brute(rows, window):
    """``(id, words, removed, digest)`` of all rows of (id, text)."""
    last = 1 << 63
    first = {}
    split = [(last if i is None else i, i, WORD.findall(t or "")) for i, t in rows]
    for key, _, words in split:
        for at in range(len(words) - window + 1):
            w = tuple(words[at : at + window])
            first[w] = min(first.get(w, (key, at)), (key, at))
    out = Counter()
    for key, i, words in split:
        gone = [False] * len(words)
        for at in range(len(words) - window + 1):
            if first[tuple(words[at : at + window])] < (key, at):
                gone[at : at + window] = [True] * window
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out[(i, len(words), sum(gone), hashlib.sha256(kept.encode()).hexdigest(), kept)] += 1
    return out


def test_automaton_knows_all_substrings():
    rng = random.Random(1)
    for _ in range(150):
        sequences = [[rng.randint(0, 2) for _ in range(rng.randint(1, 30))] for _ in range(rng.randint(1, 6))]
        ranks, at = [], 0
        for s in sequences:
            ranks.append(list(range(at, at + len(s))))
            at += len(s)
        rng.shuffle(ranks[0]) if len(sequences) == 1 else None  # ranks need not follow the order of insertion
        automaton = SuffixAutomaton(sequences, ranks)
        for most in (1, 3, 5):
            low = {}
            for s, r in zip(sequences, ranks):
                for i in range(most, len(s) + 1):
                    key = tuple(s[i - most : i])
                    low[key] = min(low.get(key, 1 << 62), r[i - 1])
            probe = [rng.randint(0, 2) for _ in range(40)]
            for s in (*sequences, probe):
                want = [low.get(tuple(s[i + 1 - most : i + 1]), -1) if i + 1 >= most else -1 for i in range(len(s))]
                assert automaton.earliest(s, most) == want


def test_equal_windows_choose_one_anchor():
    rng = np.random.default_rng(2)
    words = rng.integers(0, 40, 3000).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    words[1000:1100] = words[100:200]
    words[2000:2300] = words[7]  # one word over and over
    per = np.array([900, 0, 5, 1095, 1000])
    text, start, n, anchor, content = anchored_runs(words, per, 20)
    first = np.cumsum(per) - per
    seen, covered = {}, set()
    for t, s, k, a in zip(text.tolist(), start.tolist(), n.tolist(), anchor.tolist()):
        for at in range(s, s + k):
            covered.add((t, at))
            assert at + 20 <= per[t]
            key = words[first[t] + at : first[t] + at + 20].tobytes()
            assert seen.setdefault(key, a) == a
    assert len(covered) == n.sum() == sum(max(0, p - 19) for p in per.tolist())
    at = first[text] + start
    for i in range(len(at)):
        whole = words[at[i] : at[i] + n[i] + 19].copy()
        assert range_hashes(whole, np.array([0]), np.array([len(whole)]))[0] == content[i]


def passages(seed, n):
    """Documents of few words in common, with passages and phrases that many of them share."""
    rng = random.Random(seed)
    shared = [[f"p{j}x{i % (9 + j)}" for i in range(rng.choice([6, 19, 20, 21, 50, 80]))] for j in range(12)]
    out = []
    for i in range(n):
        words = []
        for _ in range(rng.randint(0, 6)):
            words += rng.choice(shared) if rng.random() < 0.6 else [f"w{rng.randint(0, 300)}" for _ in range(rng.randint(1, 40))]
        out.append(rng.choice([" ", "\n", " \t"]).join(words))
    return out


@pytest.mark.parametrize("most_classes,shard_words", [(200, 100_000), (3, 500)])
def test_removal_against_all_windows(spark, most_classes, shard_words):
    texts = ODD + passages(3, 500) + [prose(1, 300)] * 60 + [prose(1, 300) + " " + prose(i, 30) for i in range(40)]
    texts += [" ".join(["a b"] * 40), " ".join(["a"] * 19), " ".join(["a"] * 20), " ".join(["a"] * 21), "É " * 30, "é " * 30, prose(1, 300).upper()]
    rng = random.Random(5)
    ids = [None if rng.random() < 0.05 else rng.randint(0, 400) if rng.random() < 0.3 else 1000 + rng.randint(0, 10**12) for _ in texts]
    rows = list(zip(ids, texts)) + [(7, texts[20]), (7, texts[20])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(1) for c in ("d", "t", "h", "spans")}).repartition(5)
    got = remove_repeats(docs, keep_text=True, most_classes=most_classes, shard_words=shard_words)
    assert Counter(tuple(r) for r in got.collect()) == brute(rows, 20)


def test_other_windows_and_empty_tables(spark):
    docs = documents(spark, passages(4, 60))
    for window in (1, 3, 7):
        rows = [(r.doc_id, r.text) for r in docs.collect()]
        assert Counter(tuple(r) for r in remove_repeats(docs, window, keep_text=True).collect()) == brute(rows, window)
    empty = remove_repeats(docs.where("false"))
    assert empty.columns == ["doc_id", "n_words", "n_removed", "kept_sha256"] and empty.count() == 0
    none = remove_repeats(documents(spark, [None, "", "one two"])).collect()
    assert sorted((r.n_words, r.n_removed) for r in none) == [(0, 0), (0, 0), (2, 0)]
