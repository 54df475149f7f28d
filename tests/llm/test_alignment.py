"""Cross-tokenizer alignment against a plain walk over both tokenizers' tokens."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, documents, prose
from pyspark.sql import functions as F

from marginalia.llm import op11_alignment
from marginalia.llm.op11_alignment import align, align_tokenizers, aligned, lower_ranks
from marginalia.llm.queries import vocabulary_file

FILES = [vocabulary_file(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
TEXTS = ["", " ", "  ", "a ", "a  ", " a", "\n", "a \nb", "x▁y ok", "naïve café  don't  I'll", "東京 大阪　京都 a", "\x85 q", "<|endoftext|> <s> </s> <0x41>", "tab\t x"]
TEXTS += ["0 12 345,678.9 ", "😀 👍🏽 x", "\x00 z", "a\r\n b;\r c", "é café x", "a  b​  c", "  " * 300 + "z", "a,　 b"]


@pytest.fixture(scope="module")
def pair():
    return op11_alignment.Pair(*FILES)


def walk(pair, text):
    """Counts, digest and links of one text."""
    none = (0, 0, 0, 0, ""), []
    if not text:
        return none
    whole = (" " + text).encode()
    a, b = pair.a.encode(" " + text, add_special_tokens=False).ids, pair.b.encode(text)
    spans = []
    for ids, table in ((a, pair.a_bytes), (b, pair.b_bytes)):
        if b"".join(table[i] for i in ids) != whole:
            return none
        ends = np.cumsum([len(table[i]) for i in ids]).tolist()
        spans.append(list(zip([0, *ends[:-1]], ends)))
    both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
    groups, links, i, j = [], [], 0, 0
    for end in both:
        x = y = 0
        while i + x < len(a) and spans[0][i + x][1] <= end:
            x += 1
        while j + y < len(b) and spans[1][j + y][1] <= end:
            y += 1
        groups.append(",".join(map(str, a[i : i + x])) + "|" + ",".join(map(str, b[j : j + y])))
        touch = [(k, m) for k in range(i, i + x) for m in range(j, j + y) if max(spans[0][k][0], spans[1][m][0]) < min(spans[0][k][1], spans[1][m][1])]
        links += [(a[k], b[m]) for k, m in touch]
        i, j = i + x, j + y
    return (len(a), len(b), len(both), len(links), hashlib.sha256(";".join(groups).encode()).hexdigest()), links


def test_ranks_and_links_of_any_lists():
    rng = random.Random(4)
    for n, m in ((1, 1), (1, 500), (300, 7), (9000, 9000), (5000, 60_000)):
        end = 200_000
        x, y = (np.array(sorted({*rng.sample(range(1, end), k - 1), end})) for k in (n, m))
        assert (lower_ranks(x, y) == np.searchsorted(y, x)).all()
        a_last, b_last, a_link, b_link = align(x, y)
        assert (x[a_last] == y[b_last]).all() and set(x[a_last]) == set(x) & set(y)
        a_from, b_from = np.append(0, x[:-1]), np.append(0, y[:-1])
        first, last = np.searchsorted(y, a_from, "right"), np.searchsorted(y, x)
        assert sorted(zip(a_link.tolist(), b_link.tolist())) == [(i, j) for i in range(len(x)) for j in range(first[i], last[i] + 1)]
        assert (np.maximum(a_from[a_link], b_from[b_link]) < np.minimum(x[a_link], y[b_link])).all()


def test_units_give_what_whole_texts_give(pair):
    rng = random.Random(1)
    texts = TEXTS + ["".join(rng.choice("ab 1.'\n\té東▁   <>|s ;") for _ in range(rng.randint(1, 60))) for _ in range(600)]
    closed = [False] * len(texts)
    for text, got in zip(texts, pair.units([(" " + t).encode() for t in texts], closed)):
        counts, links = walk(pair, text)
        if text:
            assert got[:4] == (counts[0] > 0, *counts[:3])
            assert Counter(np.frombuffer(got[5], "<u4").tolist()) == Counter(a << 16 | b for a, b in links)


@pytest.mark.parametrize("most_pairs", [op11_alignment.MOST_PAIRS, 3])
def test_alignment_against_a_plain_walk(spark, pair, most_pairs):
    rng = random.Random(2)
    texts = TEXTS + ODD + [prose(i, 5 + i * 3) for i in range(40)] + ["the cat, the hat. " * 300] * 3
    texts += ["".join(rng.choice("ab 1.'\n\té東▁   <>|s") for _ in range(rng.randint(1, 80))) for _ in range(300)]
    docs = documents(spark, texts).withColumns({"row": F.lit("x"), "pair": F.lit(1), "n": F.lit(2)})
    docs = docs.withColumn("doc_id", F.when(F.col("doc_id") % 50 == 7, None).otherwise(F.floor(F.col("doc_id") / 2)))  # no ids and repeated ones
    walked = [walk(pair, t) for t in texts]
    counts = Counter(link for _, links in walked for link in links)
    most = Counter()
    for (_, b), n in counts.items():
        most[b] = max(most[b], n)
    want = Counter()
    for i, ((n_a, n_b, n_groups, n_links, digest), links) in enumerate(walked):
        best = sum(counts[x] == most[x[1]] for x in links)
        want[(None if i % 50 == 7 else i // 2, n_a, n_b, n_groups, n_links, best, sum(counts[x] for x in links), digest)] += 1
    got = align_tokenizers(docs, *FILES, most_pairs=most_pairs)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(tuple(r) for r in got.collect()) == want


def test_groups_as_text_and_empty_tables(spark):
    docs = documents(spark, ["hello there", "", None])
    got = {r.doc_id: r.groups for r in aligned(docs, *FILES, keep_groups=True).collect()}
    assert got[1] == got[2] == "" and all("|" in g for g in got[0].split(";"))
    assert align_tokenizers(docs.where("false"), *FILES).count() == 0
    assert [r.count_sum for r in align_tokenizers(docs.where("doc_id > 0"), *FILES).collect()] == [0, 0]
