"""Removal of repeated passages by suffix automata of reference shards.

A passage repeats if ``window`` consecutive words of a document stand, in the same order, at an earlier place of the corpus too.
Which places can share a window is settled by anchors: the five-word gram with the smallest hash in a window. Equal windows
choose the same gram at the same place, so the neighbouring windows that choose one anchor form a run, and equal windows only
ever stand in runs of one anchor. Runs of equal words are one class, whose first place stands for it; a run at another place is
removed whole. What is left are first places of different classes with one anchor, which may still share some windows. These are
the reference: anchors are dealt to shards of bounded size, a shard's runs become a suffix automaton in which each state knows
the earliest end of its words, and the runs stream through it for their matching statistics: a place whose longest match is a
whole window that ends earlier elsewhere lies in a span to remove.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import joined, mix, named, run_hashes, slices, stream, tidy, word_bounds, written

WINDOW = 20
GRAM = 5
SHARD_WORDS = 100_000
MOST_CLASSES = 1_000
LAST_ID = (1 << 63) - 1
ODD = 0x9E3779B97F4A7C15


class SuffixAutomaton:
    """All substrings of some sequences of words; every state knows the lowest rank at which its words end."""

    def __init__(self, sequences: list[list], ranks: list[list[int]]):
        follow, link, length, low = [{}], [-1], [0], [1 << 62]
        for words, places in zip(sequences, ranks):
            last = 0
            for word, rank in zip(words, places):
                at, new = last, follow[last].get(word)
                if new is not None and length[new] == length[last] + 1:  # known from an earlier sequence
                    if rank < low[new]:
                        low[new] = rank
                    last = new
                    continue
                fresh = new is None
                if fresh:
                    new = len(link)
                    follow.append({})
                    link.append(0)
                    length.append(length[last] + 1)
                    low.append(rank)
                    while at >= 0 and word not in follow[at]:
                        follow[at][word] = new
                        at = link[at]
                if at >= 0:
                    other = follow[at][word]
                    if length[other] != length[at] + 1:  # shorter endings get a state of their own
                        copy = len(link)
                        follow.append(follow[other].copy())
                        link.append(link[other])
                        length.append(length[at] + 1)
                        low.append(1 << 62)
                        link[other] = copy
                        while at >= 0 and follow[at].get(word) == other:
                            follow[at][word] = copy
                            at = link[at]
                        other = copy
                    if fresh:
                        link[new] = other
                    else:
                        new = other
                        low[new] = min(low[new], rank)
                last = new
        # longer words end where their endings end
        for state in np.argsort(-np.array(length), kind="stable")[:-1].tolist():
            if low[state] < low[link[state]]:
                low[link[state]] = low[state]
        self.follow, self.link, self.length, self.low = follow, link, length, low

    def earliest(self, words: list, most: int) -> list[int]:
        """For each word, the lowest rank at which the ``most`` words up to it end; -1 if the longest match is shorter.

        Matches are followed up to ``most`` words, so the state is the one that knows just those.
        """
        follow, link, length, low = self.follow, self.link, self.length, self.low
        state, match, out = 0, 0, []
        for word in words:
            while state and word not in follow[state]:
                state = link[state]
                match = length[state]
            if word in follow[state]:
                state = follow[state][word]
                match += 1
            if match >= most:
                match = most
                while length[link[state]] >= most:
                    state = link[state]
                out.append(low[state])
            else:
                out.append(-1)
        return out


def anchored_runs(words: np.ndarray, per: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """``text, start, n, anchor, content``: the runs of windows with one anchor, in order.

    ``n`` windows begin at the words from ``start`` on; ``content`` is a hash of all the run's words. Of equal grams the last counts.
    """
    gram = min(GRAM, window)
    n_windows = len(words) - window + 1
    if n_windows < 1:
        return (*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    factors = stream(21, gram) | np.uint64(1)
    grams = np.zeros(len(words) - gram + 1, np.uint64)
    for k in range(gram):
        grams += words[k : k + len(grams)] * factors[k]
    grams = mix(grams)
    least, place, size, room = grams, np.arange(len(grams)), 1, window - gram + 1
    while size < room:
        step = min(size, room - size)
        later = least[step:] <= least[:-step]
        place = np.where(later, place[step:], place[:-step])
        least = np.where(later, least[step:], least[:-step])
        size += step
    ends = np.cumsum(per)
    text = np.repeat(np.arange(len(per)), per)
    whole = text[:n_windows] == text[window - 1 :]
    begins = whole.copy()
    begins[1:] &= (place[1:] != place[:-1]) | ~whole[:-1]
    at = np.flatnonzero(begins)
    if not len(at):
        return (*(np.empty(0, np.int64) for _ in range(3)), *(np.empty(0, np.uint64) for _ in range(2)))
    n = np.bincount((np.cumsum(begins) - 1)[whole], minlength=len(at))
    content = range_hashes(words, at, at + n + window - 1)
    return text[at], at - (ends - per)[text[at]], n, least[at], content


def range_hashes(words: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 23) -> np.ndarray:
    """A 64-bit hash of the words of each range, the same wherever it stands: a polynomial in an odd number, by prefix sums."""
    base, inverse = np.uint64(ODD), np.uint64(pow(ODD, -1, 1 << 64))
    n = len(words) + 1
    powers, back = (np.cumprod(np.concatenate([[np.uint64(1)], np.full(n - 1, x)]), dtype=np.uint64) for x in (base, inverse))
    upto = np.concatenate([[np.uint64(0)], np.cumsum(mix(words + stream(seed, 1)) * powers[:-1], dtype=np.uint64)])
    return mix((upto[ends] - upto[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def text_words(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes, word starts, word ends and words per text."""
    data, at = joined(column)
    starts, ends = word_bounds(data)
    return data, starts, ends, np.diff(np.searchsorted(starts, at))


def find_runs(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, per = text_words(part.column(2))
                text, start, n, anchor, content = anchored_runs(run_hashes(data, starts, ends), per, window)
                own = pa.array(text)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(anchor.view(np.int64)),
                        pa.array(content.view(np.int64)),
                        part.column(0).take(own),
                        part.column(1).take(own),
                        pa.array(start.astype(np.int32)),
                        pa.array(n.astype(np.int32)),
                    ],
                    ["h", "k", "d", "t", "start", "n"],
                )

    return run


def spaced(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The bytes of the given words, a space after each (every word has a byte after it)."""
    sizes = ends - starts + 1
    upto = np.cumsum(sizes)
    out = data[np.arange(int(sizes.sum())) - np.repeat(upto - sizes - starts, sizes)]
    out[upto - 1] = 0x20
    return out


def ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """``starts[i], starts[i] + 1, ...`` (``sizes[i]`` of them), one after the other."""
    return np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes - starts, sizes)


def wanted_runs(window: int, shards: int):
    """Task function: the words of runs for the shards, and every window by itself (two hashes) of runs with ``many``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["many", "h", "k", "d", "t", "start", "words"]
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, per = text_words(part.column(2))
                first, places = np.cumsum(per) - per, part.column(3)
                row = np.repeat(np.arange(part.num_rows), np.diff(places.offsets.to_numpy()))
                start, n, h, many = (places.flatten().field(f).to_numpy(zero_copy_only=False) for f in ("start", "n", "h", "many"))
                at, n = first[row] + start, n.astype(np.int64)
                few, some = np.flatnonzero(~many), np.flatnonzero(many)
                if len(few):
                    words = ranges(at[few], n[few] + window - 1)
                    flat = spaced(data, starts[words], ends[words])
                    bounds = np.concatenate([[0], np.cumsum(ends[words] - starts[words] + 1)])[np.concatenate([[0], np.cumsum(n[few] + window - 1)])]
                    text = pa.Array.from_buffers(pa.large_string(), len(few), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(flat)])
                    yield rows_of(part, row[few], names, False, h[few] % shards, np.zeros(len(few), np.int64), start[few], text.cast(pa.string()))
                if len(some):
                    begin = ranges(at[some], n[some])
                    one, two = (range_hashes(run_hashes(data, starts, ends), begin, begin + window, seed).view(np.int64) for seed in (31, 32))
                    which = np.repeat(row[some], n[some])
                    yield rows_of(part, which, names, True, one, two, begin - first[which], pa.nulls(len(begin), pa.string()))

    return run


def rows_of(part: pa.RecordBatch, row: np.ndarray, names: list[str], many: bool, h: np.ndarray, k: np.ndarray, start: np.ndarray, words: pa.Array) -> pa.RecordBatch:
    own = pa.array(row)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(row), many)), pa.array(h), pa.array(k), part.column(0).take(own), part.column(1).take(own), pa.array(start.astype(np.int32)), words], names
    )


def in_shard(window: int):
    """Group function: the spans of a shard's runs whose windows end earlier in another of its runs."""

    def spans(table):
        rows = sorted(set(zip(*(table[c].to_pylist() for c in ("d", "start", "t", "words")))))
        known: dict[str, int] = {}
        sequences = [[known.setdefault(w, len(known)) for w in words[:-1].split(" ")] for *_, words in rows]
        # ranks follow (document, place); the same place in two texts of one id is one rank
        where = np.array([(d, start + i) for (d, start, *_), s in zip(rows, sequences) for i in range(len(s))]).reshape(-1, 2)
        order = np.lexsort((where[:, 1], where[:, 0]))
        new = np.ones(len(order), bool)
        new[1:] = (where[order[1:]] != where[order[:-1]]).any(1)
        rank = np.empty(len(order), np.int64)
        rank[order] = np.cumsum(new) - 1
        cuts = np.cumsum([len(s) for s in sequences])
        ranks = [r.tolist() for r in np.split(rank, cuts[:-1])]
        automaton = SuffixAutomaton(sequences, ranks)
        out = []
        for (d, start, t, _), words, own in zip(rows, sequences, ranks):
            end = -1
            for i, (low, rank_) in enumerate(zip(automaton.earliest(words, window), own)):
                if -1 < low < rank_:
                    begin = start + i - window + 1
                    if begin <= end:
                        out[-1] = (*out[-1][:3], start + i + 1)
                    else:
                        out.append((d, t, begin, start + i + 1))
                    end = start + i + 1
        kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32()]
        return pa.table([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * 4, kinds)], names=["d", "t", "begin", "upto"])

    return spans


def kept_words(keep_text: bool):
    """Task function: number of words, number of removed ones and the digest (and text) of the others."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                data, starts, ends, per = text_words(part.column(1))
                base = np.cumsum(per) - per
                change = np.zeros(len(starts) + 1, np.int64)
                for first, spans in zip(base.tolist(), part.column(2).to_pylist()):
                    for s in spans or ():
                        change[first + s["begin"]] += 1
                        change[first + s["upto"]] -= 1
                keep = np.cumsum(change)[:-1] == 0
                flat = spaced(data, starts[keep], ends[keep]).tobytes()
                upto = np.concatenate([[0], np.cumsum(ends[keep] - starts[keep] + 1)])[np.concatenate([[0], np.cumsum(keep)])[np.append(base, len(keep))]].tolist()
                texts = [flat[a : max(a, b - 1)] for a, b in zip(upto, upto[1:])]
                removed = per - np.diff(np.concatenate([[0], np.cumsum(keep)])[np.append(base, len(keep))])
                columns_ = [part.column(0), pa.array(per, pa.int64()), pa.array(removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in texts], pa.string())]
                names = ["doc_id", "n_words", "n_removed", "kept_sha256"]
                if keep_text:
                    columns_.append(pa.array([x.decode() for x in texts], pa.string()))
                    names.append("kept")
                yield pa.RecordBatch.from_arrays(columns_, names)

    return run


def remove_repeats(
    docs: DataFrame,
    window: int = WINDOW,
    doc_id: str = "doc_id",
    text: str = "text",
    keep_text: bool = False,
    shard_words: int = SHARD_WORDS,
    most_classes: int = MOST_CLASSES,
) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` (and ``kept``, the text that is left): one row per row of ``docs``.

    Words are runs of characters other than space and U+0009 to U+000D, as they stand. A word goes if a window of ``window``
    words that covers it also starts at an earlier place: a smaller id, or the same id and a smaller word number. Windows are
    judged on the whole input. Kept words are joined by one space. A null or empty text has no words; texts shorter than a
    window stay whole. Rows that repeat an id are one document: windows at the same place of two of them are no repeat of each
    other, at different places they are. Rows without an id come after all others, as one document.

    No group of equal things meets in one task: runs are counted and their first places found by aggregates with a map-side
    part, and brought back by joins that adaptive execution splits. A shard has about ``shard_words`` words: an anchor with
    more than ``most_classes`` different runs is not dealt to one, its windows are compared one by one as classes of their own.
    Texts are shuffled twice: to meet the runs that are wanted of them, and to meet their spans.
    """
    source = named(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    # two texts under one id are told apart by the hash; neither key is ever null
    source = source.select("doc_id", "text", F.coalesce("doc_id", F.lit(LAST_ID)).alias("d"), F.hash("text").alias("t"))
    found = source.select("d", "t", "text").mapInArrow(tidy(find_runs(window)), "h bigint, k bigint, d bigint, t int, start int, n int")
    # written, so that the join has plain exchanges on both sides and adaptive execution can split a frequent anchor
    common = written(found.groupBy("h").agg(F.count("*").alias("c")).where("c > 1").select("h"))
    runs = written(found.join(common, "h", "left_semi"))
    place = F.struct("d", "start")
    classes = written(runs.groupBy("h", "k").agg(F.min(place).alias("first")))
    several = classes.groupBy("h").agg(F.count("*").alias("c"))
    marked = runs.join(classes.join(several, "h"), ["h", "k"]).withColumn("is_first", place == F.col("first"))
    marked = written(marked.where("not is_first or c > 1").select("h", "d", "t", "start", "n", "is_first", "c"))
    spans = marked.where("not is_first").select("d", "t", F.col("start").alias("begin"), (F.col("start") + F.col("n") + (window - 1)).alias("upto"))
    shared = marked.where("is_first").select("h", "d", "t", "start", "n", (F.col("c") > most_classes).alias("many")).distinct()
    words = shared.agg(F.coalesce(F.sum(F.when(~F.col("many"), F.col("n") + (window - 1))), F.lit(0)).alias("n")).first().n
    shards = max(1, -(-int(words) // shard_words))
    places = shared.groupBy("d", "t").agg(F.sort_array(F.collect_set(F.struct("start", "n", "h", "many"))).alias("places"))
    found = source.join(places, ["d", "t"]).select("d", "t", "text", "places").mapInArrow(
        tidy(wanted_runs(window, shards)), "many boolean, h bigint, k bigint, d bigint, t int, start int, words string"
    )
    found = written(found, "many")
    spans = spans.unionByName(found.where("not many").groupBy("h").applyInArrow(in_shard(window), "d bigint, t int, begin int, upto int"))
    single = found.where("many").select("h", "k", "d", "t", "start")
    first = single.groupBy("h", "k").agg(F.min(place).alias("first"), F.count("*").alias("c")).where("c > 1")
    again = single.join(first, ["h", "k"]).where(place != F.col("first"))
    spans = spans.unionByName(again.select("d", "t", F.col("start").alias("begin"), (F.col("start") + window).alias("upto")))
    by_text = spans.groupBy("d", "t").agg(F.collect_set(F.struct("begin", "upto")).alias("spans"))
    out = source.join(by_text, ["d", "t"], "left").select("doc_id", "text", "spans")
    return out.mapInArrow(kept_words(keep_text), "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string" + (", kept string" if keep_text else ""))
