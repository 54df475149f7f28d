"""Packing by minimum bin slack: a subset-sum over the remaining lengths fills each window as far as it can be filled.

Documents are cut into whole windows and one rest each. How many pieces there are of each length is a table of at most
``window`` rows, whatever the size of the corpus. The plan is made on that table: a bitset subset-sum finds the multiset
of remaining lengths that fills a window closest to capacity, the backtracked counts become a pattern, and the pattern is
used as often as the counts allow, so each pattern uses some length up and there are at most ``window`` of them.
Pieces then find their window from their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .shared import Recent, Shipped, give_back, mix, named, run_hashes, slices, tidy, written

WINDOW = 2048
END_ID = 1
SUBS = 4096
UNITS_ROOM = 40 << 20
TOGETHER = 500

# --- fixed values: what the tokenizer's own pre-splitting does with these characters --------------------------------
# letters: a-z, A-Z and the composed Latin-1 letters; each digit alone; runs of other printable ASCII characters.
# An apostrophe can begin a contraction, and every other character may be composed or split in ways of its own:
# a word with one of those goes to the tokenizer whole.
SPACES = (0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D)
SPACE, LETTER, DIGIT, OTHER, WHOLE = range(5)
WORD_END = "</w>"  # ends the last piece of every word in the vocabulary
# --- end of fixed values --------------------------------------------------------------------------------------------


def character_classes() -> np.ndarray:
    """Class of each code point below 256; everything above is WHOLE."""
    kinds = np.full(256, WHOLE, np.uint8)
    kinds[0x21:0x7F] = OTHER
    kinds[list(SPACES)] = SPACE
    kinds[0x30:0x3A] = DIGIT
    kinds[0x41:0x5B] = kinds[0x61:0x7B] = kinds[0xC0:0x100] = LETTER
    kinds[[0xD7, 0xF7, 0x27]] = WHOLE
    return kinds


class Units:
    """Ids of text units, looked up by hash; units that were not met lately go to the tokenizer.

    Words end in ids of their own, so units that are one word each go to the tokenizer many to a string.
    """

    def __init__(self, tokenizer_path: str):
        # Spark runs a task per core already; more threads would only hold more memory
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for piece, i in vocabulary.items() if piece.endswith(WORD_END)]] = True
        del vocabulary
        give_back()
        self.store = Recent(UNITS_ROOM, lambda ids: len(ids) + 170)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, np.uint32) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def of(self, texts: list[str], single: list[bool]) -> list[bytes]:
        """Ids of each text as bytes; ``single`` says which are one word."""
        out, alone = [b""] * len(texts), [i for i, s in enumerate(single) if not s]
        joined_ = [i for i, s in enumerate(single) if s]
        for begin in range(0, len(joined_), TOGETHER):  # the tokenizer's results are large: a few at a time
            some = joined_[begin : begin + TOGETHER]
            (ids,) = self.encode([" ".join([texts[i] for i in some])])
            ends = np.flatnonzero(self.last[ids]) + 1
            if len(ends) != len(some):
                alone += some
                continue
            for i, a, b in zip(some, [0, *ends[:-1].tolist()], ends.tolist()):
                out[i] = ids[a:b].tobytes()
        for begin in range(0, len(alone), TOGETHER):
            some = alone[begin : begin + TOGETHER]
            for i, ids in zip(some, self.encode([texts[i] for i in some])):
                out[i] = ids.tobytes()
        return out


def token_ids(column: pa.Array, units: Units, kinds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All token ids of the texts, one text after the other, and the number of each text's ids."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    sizes = pc.utf8_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    whole = "\n".join(column.to_pylist()) + "\n"
    text_at = np.concatenate([[0], np.cumsum(sizes + 1)])
    codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = np.where(codes < 256, kinds[np.minimum(codes, 255)], WHOLE).astype(np.uint8)
    space = kind == SPACE
    word_no = np.cumsum(~space & np.concatenate([[True], space[:-1]])) - 1
    odd = np.unique(word_no[kind == WHOLE])
    if len(odd):
        marked = np.zeros(int(word_no[-1]) + 2, bool)
        marked[odd] = True
        kind = np.where(marked[word_no] & ~space, WHOLE, kind)
    change = np.ones(len(kind), bool)
    change[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == DIGIT)
    edges = np.append(np.flatnonzero(change), len(kind))
    used = kind[edges[:-1]] != SPACE
    starts, ends = edges[:-1][used], edges[1:][used]
    if not len(starts):
        return np.empty(0, np.uint32), np.zeros(len(column), np.int64)
    fold = np.arange(256, dtype=np.uint32)
    fold[0x41:0x5B] += 32
    fold[0xC0:0xDF] += 32
    fold[0xD7] = 0xD7
    plain = np.where(codes < 256, fold[np.minimum(codes, 255)], codes)
    del codes, space, word_no, change, edges, used  # up to 25 bytes a character, beside what the hashes take
    # a hash of (kind, characters): symbols are numbered below 1,114,112
    hashes = mix(run_hashes(plain, starts, ends, 3) + kind[starts].astype(np.uint64))
    keys, first, unit = np.unique(hashes, return_index=True, return_inverse=True)

    def made(new: list[int]) -> list[bytes]:
        a, b = starts[first[new]], ends[first[new]]
        return units.of([whole[x:y] for x, y in zip(a.tolist(), b.tolist())], (kind[a] != WHOLE).tolist())

    found = units.store.of(keys.tolist(), made)
    size = np.fromiter(map(len, found), np.int64, len(found)) // 4
    n, begin = size[unit], (np.cumsum(size) - size)[unit]
    out_first = np.cumsum(n) - n
    total = int(n.sum())
    at = np.arange(total) - np.repeat(out_first - begin, n)
    ids = np.frombuffer(b"".join(found), np.uint32)[at]
    bounds = np.append(out_first, total)[np.searchsorted(starts, text_at)]
    return ids, np.diff(bounds)


def pieces(tokenizer_path: str, window: int):
    """Task function: ``doc_id, start, length, ids_crc32, doc_tokens, number`` for the pieces of each text.

    Pieces are numbered by (task, place in it), so equal ones can be told apart.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        units, kinds, number = Units(tokenizer_path), character_classes(), TaskContext.get().partitionId() << 33
        for batch in batches:
            for part in slices(batch, "text", 1 << 19):
                ids, counts = token_ids(part.column(1), units, kinds)
                ends = np.cumsum(counts)
                row, start, length, crc = [], [], [], []
                for i, (a, b) in enumerate(zip((ends - counts).tolist(), ends.tolist())):
                    whole = np.append(ids[a:b], np.uint32(END_ID)).astype("<u4")
                    for at in range(0, len(whole), window):
                        piece = whole[at : at + window]
                        row.append(i)
                        start.append(at)
                        length.append(len(piece))
                        crc.append(zlib.crc32(piece.tobytes()))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column(0).take(pa.array(row, pa.int64())),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                        pa.array(counts + 1, pa.int64()).take(pa.array(row, pa.int64())),
                        pa.array(number + np.arange(len(row))),
                    ],
                    ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "number"],
                )
                number += len(row)

    return run


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum up to ``room``: subset-sum on a bitset, then backtracking.

    Bit s of the set stands for a reachable sum s. Copies of a length are added in groups of 1, 2, 4 ... (binary
    splitting), so a length costs a logarithm of its count; each step's set is kept for the way back. The way back takes a
    group only if the sum cannot be reached without it. Small lengths are offered last, so they are left for later windows.
    """
    mask, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], room // length)
        group = 1
        while left > 0:
            group_now = min(group, left)
            steps.append((length, group_now, reach))
            reach |= (reach << (length * group_now)) & mask
            left -= group_now
            group *= 2
    total, taken = reach.bit_length() - 1, {}
    for length, group, before in reversed(steps):
        if not before >> total & 1:
            taken[length] = taken.get(length, 0) + group
            total -= length * group
    return taken


def packing_plan(counts: dict[int, int], window: int) -> list[tuple[dict[int, int], int]]:
    """``(multiset of lengths, number of windows)`` patterns that use every piece exactly once.

    The largest remaining length opens a window and the subset-sum fills what it leaves.
    """
    left, plan = dict(counts), []
    while left:
        seed = max(left)
        left[seed] -= 1
        taken = fullest({k: v for k, v in left.items() if v}, window - seed)
        left[seed] += 1
        taken[seed] = taken.get(seed, 0) + 1
        times = min(left[k] // n for k, n in taken.items())
        plan.append((taken, times))
        left = {k: v for k in left if (v := left[k] - taken.get(k, 0) * times)}
    return plan


class Places:
    """For each length, rank ranges of its pieces and the windows they go to."""

    def __init__(self, plan: list[tuple[dict[int, int], int]]):
        rows, used, base = {}, {}, 0
        for taken, times in plan:
            offset = 0
            for length in sorted(taken, reverse=True):
                n = taken[length]
                rows.setdefault(length, []).append((used.get(length, 0), n, base, offset))
                used[length] = used.get(length, 0) + n * times
                offset += n * length
            base += times
        self.rows = {k: np.array(v, np.int64) for k, v in rows.items()}

    def of(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Window number and offset of the pieces with these lengths and ranks."""
        sequence, offset = np.empty(len(length), np.int64), np.empty(len(length), np.int64)
        for value in np.unique(length).tolist():
            at, rows = np.flatnonzero(length == value), self.rows[value]
            row = rows[np.searchsorted(rows[:, 0], rank[at], "right") - 1]
            within = rank[at] - row[:, 0]
            sequence[at] = row[:, 2] + within // row[:, 1]
            offset[at] = row[:, 3] + within % row[:, 1] * value
        return sequence, offset


def pack(docs: DataFrame, tokenizer_path: str, window: int = WINDOW, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset``: one row per piece.

    A document is its token ids and the end id, so null and empty texts are one id long. Every row of ``docs`` is packed,
    repeated rows and null ids too. The driver sees the number of pieces per length (at most ``window`` rows) and sends
    the plan back (at most ``window`` patterns). Pieces are numbered as they are written; ranks come from a window over
    (length, hash of the number) and the totals of those parts, so a common length is spread over 4,096 parts, and so are
    equal rows.
    """
    rows = named(docs, doc_id=doc_id, text=text)
    cut = written(
        rows.mapInArrow(tidy(pieces(tokenizer_path, window)), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, number bigint")
    ).withColumn("sub", F.pmod(F.xxhash64("number"), F.lit(SUBS)))
    totals = cut.groupBy("length", "sub").agg(F.count("*").alias("n"))
    counts = {int(r.length): int(r.n) for r in totals.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = Shipped(docs.sparkSession, Places(packing_plan(counts, window)))
    upto = Window.partitionBy("length").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    bases = totals.select("length", "sub", F.coalesce(F.sum("n").over(upto), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("length", "sub").orderBy("number")) - 1
    ranked = cut.withColumn("rank", rank).join(bases, ["length", "sub"]).withColumn("rank", F.col("base") + F.col("rank")).drop("sub", "base")
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sequence, offset = places.value.of(batch["length"].to_numpy(), batch["rank"].to_numpy())
            yield pa.RecordBatch.from_arrays([*[batch[c] for c in columns], pa.array(sequence), pa.array(offset)], [*columns, "sequence_id", "offset"])

    shape = ", ".join(f"`{c}` {ranked.schema[c].dataType.simpleString()}" for c in columns)
    return ranked.select(*columns, "rank").mapInArrow(tidy(place), f"{shape}, sequence_id bigint, offset bigint")
