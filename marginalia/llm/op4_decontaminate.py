"""Benchmark decontamination by SimHash of item-sized windows.

Items are put into size classes. For a class whose smallest item has w words, windows of two fifths of w, but of 16 words
at most, are fingerprinted: all of each item, and in a document one at every w/10 words, but at every 5 at least. So windows
are parts of an item. Similarity of 0.75 leaves at least 6/7 of an item's shingles untouched; an edit takes four or five, so
the longer an item, the more edits, but from 56 shingles on some untouched run keeps 16 shingles (20 words), and shorter items
keep half of their words: room for a grid window that is also a window of the item, word for word, wherever the edits are. A
fingerprint has 64 bits over the window's words, weighted by their counts. It is looked up in four tables by 16 bits each:
fingerprints that differ in up to three bits share one of the four blocks, so none within that radius is missed. Around each
hit, all windows of the item's own size that hold it are compared by the weighted Jaccard similarity of five-word shingles.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StructField

from .shared import SHINGLE_WORDS, Shipped, append, joined, lowered, named, run_hashes, shingle_hashes, slices, word_bounds

RADIUS = 3
BLOCKS = 4
BLOCK_BITS = 16
SIMILARITY = 0.75
ITEM_BLOCK = 5_000
GROWTH = 1.25
WINDOW = 16
STEP = 5
LONGEST_SUM = 255
CHUNK_WORDS = 60_000


class Prints:
    """SimHashes of any windows of a word sequence: a bit is set if more than half of the window's words set it.

    Lane k counts bits k, k+8, ... of all words up to a place, in eight 8-bit counters of one integer. Differences of
    these sums are exact (modulo 2^64) while a window has no more than 255 words; longer ones are counted bit by bit.
    """

    ONES = np.uint64(0x0101010101010101)

    def __init__(self, words: np.ndarray):
        self.words, zero = words, np.zeros(1, np.uint64)
        self.sums = [np.concatenate([zero, np.cumsum((words >> np.uint64(k)) & self.ONES)]) for k in range(8)]

    def of(self, starts: np.ndarray, size: int) -> np.ndarray:
        out = np.zeros(len(starts), np.uint64)
        if size > LONGEST_SUM:
            for bit in range(64):
                total = np.concatenate([[0], np.cumsum((self.words >> np.uint64(bit)) & np.uint64(1), dtype=np.int64)])
                out |= ((total[starts + size] - total[starts]) > size // 2).astype(np.uint64) << np.uint64(bit)
            return out
        # adding 127 - size // 2 to a counter below 128 carries into its top bit if it is more than half of the window
        rest, top = self.ONES * np.uint64(127), self.ONES * np.uint64(128)
        more = self.ONES * np.uint64(127 - size // 2)
        for k, total in enumerate(self.sums):
            count = total[starts + size] - total[starts]
            out |= ((((count & rest) + more) | count) & top) >> np.uint64(7 - k)
        return out


class SizeClass:
    """Items of ``least`` words or somewhat more: fingerprints of their windows in block tables."""

    def __init__(self, least: int, items: list[tuple[int, np.ndarray]]):
        self.size, self.step = min(max(1, least * 2 // 5), WINDOW), min(max(1, least // 10), STEP)
        owner, prints = [], []
        for number, words in items:
            every = Prints(words).of(np.arange(len(words) - self.size + 1), self.size)
            prints.append(every[np.sort(np.unique(every, return_index=True)[1])])  # an item's equal windows are one
            owner.append(np.full(len(prints[-1]), number))
        self.prints, self.owner = np.concatenate(prints), np.concatenate(owner)
        self.tables = []
        for b in range(BLOCKS):
            value = block(self.prints, b)
            begin = np.concatenate([[0], np.cumsum(np.bincount(value, minlength=1 << BLOCK_BITS))])
            self.tables.append((np.argsort(value, kind="stable").astype(np.int32), begin.astype(np.int32)))

    def near(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Positions of the fingerprints and of the item windows within the radius of them, each pair once."""
        found = []
        for b, (order, begin) in enumerate(self.tables):
            value = block(prints, b)
            first = begin[value]
            n = begin[value + 1] - first
            hit = np.flatnonzero(n)
            n = n[hit]
            mine = np.repeat(hit, n)
            nth = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n, n)
            other = order[first[mine] + nth]
            close = np.bitwise_count(prints[mine] ^ self.prints[other]) <= RADIUS
            found.append(mine[close] * len(self.prints) + other[close])
        pair = np.unique(np.concatenate(found))
        return pair // len(self.prints), pair % len(self.prints)


def block(prints: np.ndarray, b: int) -> np.ndarray:
    return ((prints >> np.uint64(BLOCK_BITS * b)) & np.uint64((1 << BLOCK_BITS) - 1)).astype(np.int64)


class Items:
    """Benchmark items by size class, with the shingle counts that confirm a hit."""

    def __init__(self, ids: list, texts: list[str]):
        words, per = text_words(pa.array(texts, pa.large_string()))
        ends = np.cumsum(per)
        self.ids = ids
        self.words = [words[a:b] for a, b in zip((ends - per).tolist(), ends.tolist())]
        self.counts = [shingle_counts(w) for w in self.words]
        self.known = [np.sort(np.array(list(c), np.uint64)) for c in self.counts]
        self.lengths = per
        ladder = [1]
        while ladder[-1] < min(10 * STEP, max((len(w) for w in self.words), default=0)):  # from there on, windows are the same
            ladder.append(max(ladder[-1] + 1, int(ladder[-1] * GROWTH)))
        by: dict[int, list] = {}
        for i, w in enumerate(self.words):
            if len(w):
                by.setdefault(int(np.searchsorted(ladder, len(w), "right")) - 1, []).append((i, w))
        self.classes = [SizeClass(min(len(w) for _, w in some), some) for _, some in sorted(by.items())]


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, and how many words each has."""
    data, at = joined(column)
    data = lowered(data)
    starts, ends = word_bounds(data)
    return run_hashes(data, starts, ends), np.diff(np.searchsorted(starts, at))


def shingle_counts(words: np.ndarray) -> Counter:
    return Counter(shingle_hashes(words, np.array([len(words)]), SHINGLE_WORDS)[0].tolist())


def best_window(shingles: np.ndarray, words: np.ndarray, spans: list[tuple[int, int]], size: int, known: np.ndarray, counts: Counter) -> tuple[float, int]:
    """The highest weighted Jaccard similarity of a window of ``size`` words and its first place; 0 if none can reach the threshold.

    ``shingles`` holds the hash of the five words at each place, ``known`` the item's distinct ones in order and ``counts``
    how often each stands in it. Windows start in one of ``spans`` (first and last place, in order, apart).
    """
    if size < SHINGLE_WORDS:
        return max((weighted_jaccard(shingle_counts(words[p : p + size]), counts), -p) for a, b in spans for p in range(a, b + 1))
    n = size - SHINGLE_WORDS + 1
    total = n + counts.total()
    most, place = 0, 0
    for low, high in spans:
        part = shingles[low : high + n]
        at = np.minimum(np.searchsorted(known, part), len(known) - 1)
        upto = np.concatenate([[0], np.cumsum(known[at] == part)])
        # no window has more in common with the item than it has shingles of it
        able = np.flatnonzero(upto[n:] - upto[:-n] >= SIMILARITY * total / (1 + SIMILARITY) - 1e-6)
        if not len(able):
            continue
        first, last = int(able[0]), int(able[-1])
        keys = part[first : last + n].tolist()
        have: Counter = Counter()
        both = 0
        for i, key in enumerate(keys):
            if key in counts:
                have[key] += 1
                both += have[key] <= counts[key]
            if i >= n and keys[i - n] in counts:
                both -= have[keys[i - n]] <= counts[keys[i - n]]
                have[keys[i - n]] -= 1
            if i >= n - 1 and both > most:
                most, place = both, low + first + i - n + 1
    return most / (total - most), -place


def spans_of(lows: list[int], highs: list[int]) -> list[tuple[int, int]]:
    """The union of the spans, in order and apart."""
    out: list[tuple[int, int]] = []
    for low, high in sorted(zip(lows, highs)):
        if out and low <= out[-1][1] + 1:
            out[-1] = (out[-1][0], max(out[-1][1], high))
        else:
            out.append((low, high))
    return out


def weighted_jaccard(a: Counter, b: Counter) -> float:
    both = sum(min(n, b[k]) for k, n in a.items() if k in b)
    union = a.total() + b.total() - both
    return both / union if union else 0.0


def matches(words: np.ndarray, per: np.ndarray, items: Items) -> list[tuple[int, int, int, int, float]]:
    """``(text, item, first word, words, similarity)``: the best confirmed window of each item in each text."""
    ends = np.cumsum(per)
    begins = ends - per
    tried: dict[tuple[int, int], tuple[list[int], list[int]]] = {}
    for chunk in np.array_split(np.arange(len(per)), max(1, int(per.sum()) // CHUNK_WORDS)):
        if not len(chunk) or begins[chunk[0]] == ends[chunk[-1]]:
            continue
        low = int(begins[chunk[0]])
        prints = Prints(words[low : int(ends[chunk[-1]])])
        for kind in items.classes:
            n = np.maximum((per[chunk] - kind.size) // kind.step + 1, 0)
            text = np.repeat(chunk, n)
            at = begins[text] + (np.arange(len(text)) - np.repeat(np.cumsum(n) - n, n)) * kind.step
            mine, other = kind.near(prints.of(at - low, kind.size))
            text, at, item = text[mine], at[mine], kind.owner[other]
            size = np.minimum(items.lengths[item], per[text])
            # windows that hold the hit, and one more on either side, as a hit need not be word for word
            lows = np.maximum(at + kind.size - size - 1, begins[text])
            highs = np.minimum(at + 1, ends[text] - size)
            for t, i, a, b in zip(text.tolist(), item.tolist(), lows.tolist(), highs.tolist()):
                some = tried.setdefault((t, i), ([], []))
                some[0].append(a)
                some[1].append(b)
    out = []
    shingles = shingle_hashes(words, np.array([len(words)]), SHINGLE_WORDS)[0] if tried else None
    for (t, i), (lows, highs) in sorted(tried.items()):
        size = min(len(items.words[i]), int(per[t]))
        alike, place = best_window(shingles, words, spans_of(lows, highs), size, items.known[i], items.counts[i])
        if alike >= SIMILARITY:
            out.append((t, i, int(-place - begins[t]), size, alike))
    return out


def item_blocks(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> Iterator[Items]:
    """The benchmark in blocks of about 5,000 items, so what is broadcast at a time has a bound for any benchmark.

    Items without an id, text or word match nothing; repeated rows count once.
    """
    rows = named(benchmark, item_id=item_id, text=text).where("item_id is not null and text is not null").distinct()
    n = -(-rows.count() // ITEM_BLOCK)
    for b in range(n):
        some = rows.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").toPandas()
        yield Items(some["item_id"].tolist(), some["text"].tolist())


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, item_id, first_word, n_words, similarity``: one row per document row and item found in it.

    The window is the item's number of words long (or the whole text, if that is shorter), and its weighted Jaccard
    similarity with the item is at least 0.75. Null and empty texts have no window; a null doc_id is carried along.
    """
    rows = named(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, item_id bigint, first_word int, n_words int, similarity double"
    out = None
    for block in item_blocks(benchmark):
        shipped = Shipped(docs.sparkSession, block)

        def search(batches, shipped=shipped):
            for batch in batches:
                for part in slices(batch, "text"):
                    found = matches(*text_words(part.column(1)), shipped.value)
                    t, i, first, size, alike = (list(x) for x in zip(*found)) if found else ([], [], [], [], [])
                    ids = [shipped.value.ids[x] for x in i]
                    yield pa.RecordBatch.from_arrays(
                        [part.column(0).take(pa.array(t, pa.int64())), pa.array(ids, pa.int64()), pa.array(first, pa.int32()), pa.array(size, pa.int32()), pa.array(alike, pa.float64())],
                        ["doc_id", "item_id", "first_word", "n_words", "similarity"],
                    )

        some = rows.mapInArrow(search, shape)
        out = some if out is None else out.union(some)
    return out if out is not None else docs.sparkSession.createDataFrame([], shape)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` in whose text no benchmark item is found; columns as they were."""
    name = "_leaks"
    while name in {c.lower() for c in docs.columns}:
        name += "_"
    for block in item_blocks(benchmark):
        shipped = Shipped(docs.sparkSession, block)

        def make(shipped=shipped):
            def work(column: pa.Array):
                words, per = text_words(column)
                leaks = np.zeros(len(per), bool)
                leaks[[t for t, *_ in matches(words, per, shipped.value)]] = True
                return [leaks]

            return work

        docs = append(docs, text, [StructField(name, BooleanType())], make).where(f"not `{name}`").drop(name)
    return docs
