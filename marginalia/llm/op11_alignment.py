"""Cross-tokenizer alignment by galloping intersection.

Both tokenizers cut the same bytes (a space and the text), so each gives an ascending list of byte offsets where its tokens end.
The shorter list drives: every entry is sought in the longer one by steps that double and a binary search in the last step's
range. Offsets that stand in both lists cut the tokens into groups; the ranks that the search gives, taken from one entry to the
next, are the ranges of tokens that overlap. How often two ids are linked is counted over all documents.

Both tokenizers end a token before a space that follows a visible character, whatever stands on either side. So a text is cut
there into units, equal units are tokenised and aligned once while a task remembers them, and a document's figures are sums
over its units.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Recent, Shipped, joined, named, run_hashes, slices, written

MOST_PAIRS = 2_000_000
UNITS_ROOM = 120 << 20
TOGETHER = 1 << 13
GALLOP = 4096
FLUSH = 1 << 20


def lower_ranks(short: np.ndarray, long: np.ndarray) -> np.ndarray:
    """How many entries of ``long`` are below each entry of ``short`` (both ascending), by doubling steps and binary search.

    Runs of entries are sought together, from where the run before ended.
    """
    out, n, at = np.empty(len(short), np.int64), len(long), 0
    for begin in range(0, len(short), GALLOP):
        x = short[begin : begin + GALLOP]
        low, high = np.full(len(x), at - 1), np.full(len(x), n)  # long[low] < x <= long[high]
        step, open_ = 1, np.arange(len(x))
        while len(open_):
            probe = low[open_] + step
            inside = probe < n
            below = np.zeros(len(open_), bool)
            below[inside] = long[probe[inside]] < x[open_[inside]]
            high[open_[~below]] = np.minimum(probe[~below], n)
            open_, step = open_[below], step * 2
            low[open_] = probe[below]
        while len(open_ := np.flatnonzero(high - low > 1)):
            middle = (low[open_] + high[open_]) // 2
            below = long[middle] < x[open_]
            low[open_[below]], high[open_[~below]] = middle[below], middle[~below]
        out[begin : begin + GALLOP] = high
        at = int(high[-1])
    return out


def align(a_ends: np.ndarray, b_ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Tokens of A and of B that end a group (pairwise), and the A and B tokens of all links. Both lists end at one offset."""
    swap = len(a_ends) > len(b_ends)
    short, long = (b_ends, a_ends) if swap else (a_ends, b_ends)
    rank = lower_ranks(short, long)
    common = long[rank] == short
    first = np.concatenate([[0], (rank + common)[:-1]])
    n = rank - first + 1
    mine = np.repeat(np.arange(len(short)), n)
    other = np.arange(len(mine)) - np.repeat(np.cumsum(n) - n - first, n)
    ends = (np.flatnonzero(common), rank[common])
    return (*ends[::-1], other, mine) if swap else (*ends, mine, other)


def byte_decoder() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable Latin-1 stands for itself, the other bytes for U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(0x100 + i): b for i, b in enumerate(rest)}


class Pair:
    """The two tokenizers, with the bytes of every id."""

    def __init__(self, a_file: str, b_file: str):
        from sentencepiece import SentencePieceProcessor
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(a_file)
        self.a.no_padding()
        self.a.no_truncation()
        self.a.encode_special_tokens = True
        self.b = SentencePieceProcessor(model_file=b_file)
        decoder, vocabulary = byte_decoder(), self.a.get_vocab()
        self.a_bytes = [b""] * (max(vocabulary.values()) + 1)
        for piece, i in vocabulary.items():
            self.a_bytes[i] = bytes(decoder[c] for c in piece) if all(c in decoder for c in piece) else piece.encode()
        b = self.b
        self.b_bytes = [
            bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in range(b.vocab_size())
        ]
        self.narrow = len(self.a_bytes) <= 1 << 16 and len(self.b_bytes) <= 1 << 16
        self.shift = 16 if self.narrow else 32
        self.lengths = [np.array([len(x) for x in table], np.int64) for table in (self.a_bytes, self.b_bytes)]
        # an id as text with what may follow it: another id of its side, or the end of its side of the group
        self.texts = [f"{i}{end}" for table, ends in ((self.a_bytes, ",|"), (self.b_bytes, ",;")) for end in ends for i in range(len(table))]

    def encode(self, texts: list[str]) -> list[tuple[list[int], list[int]]]:
        """Ids of both for each text, which begins with a space; B adds that space itself."""
        a = self.a.encode_batch_fast(texts, add_special_tokens=False)
        return [(x.ids, y) for x, y in zip(a, self.b.encode([t[1:] for t in texts], num_threads=1))]

    def units(self, texts: list[bytes], closed: list[bool]) -> list[tuple]:
        """What a unit adds to a document: ``(ok, n_a, n_b, n_groups, groups, pairs)``; each group ends in ``;``, pairs are ``a << shift | b``.

        Units that end in a visible character are tokenised several to a string; the others, and those of a string whose
        tokens do not give its bytes back, one by one.
        """
        out: list = [None] * len(texts)
        strings, now, size = [], [], 0
        for i, (t, c) in enumerate(zip(texts, closed)):
            if c:
                now.append(i)
                size += len(t)
            if not c or size > TOGETHER:
                strings += [now] * bool(now) + [[i]] * (not c)
                now, size = [], 0
        strings += [now] * bool(now)
        while strings:
            again = []
            wholes = [b"".join([texts[i] for i in members]) for members in strings]
            for members, whole, (a, b) in zip(strings, wholes, self.encode([w.decode() for w in wholes])):
                same = all(b"".join(map(table.__getitem__, ids)) == whole for table, ids in ((self.a_bytes, a), (self.b_bytes, b)))
                if same:
                    self.cut(members, texts, a, b, out)
                elif len(members) > 1:
                    again += [[i] for i in members]
                else:
                    out[members[0]] = (False, 0, 0, 0, "", b"")
            strings = again
        return out

    def cut(self, members: list[int], texts: list[bytes], a: list[int], b: list[int], out: list) -> None:
        a_ids, b_ids = np.array(a, np.int64), np.array(b, np.int64)
        a_ends, b_ends = np.cumsum(self.lengths[0][a_ids]), np.cumsum(self.lengths[1][b_ids])
        a_last, b_last, a_link, b_link = align(a_ends, b_ends)
        pairs = (a_ids[a_link].astype(np.uint64) << np.uint64(self.shift) | b_ids[b_link].astype(np.uint64)).astype("<u4" if self.narrow else "<u8")
        # unit ends are group ends: where each unit's groups, tokens and links end
        groups_upto = np.searchsorted(a_ends[a_last], np.cumsum([len(texts[i]) for i in members])) + 1
        a_upto, b_upto = a_last[groups_upto - 1] + 1, b_last[groups_upto - 1] + 1
        links_upto = np.searchsorted(a_link, a_upto).tolist()
        # all ids as text, group by group, first A's, then B's
        n_a, n_b = len(self.a_bytes), len(self.b_bytes)
        a_ids[a_last] += n_a
        b_ids += 2 * n_a
        b_ids[b_last] += n_b
        a_of, b_of = np.searchsorted(a_last, np.arange(len(a))), np.searchsorted(b_last, np.arange(len(b)))
        line = np.empty(len(a) + len(b), np.int64)
        line[np.arange(len(a)) + np.append(0, b_last[:-1] + 1)[a_of]] = a_ids
        line[np.arange(len(b)) + a_last[b_of] + 1] = b_ids
        pieces = list(map(self.texts.__getitem__, line.tolist()))
        whole, wide = pairs.tobytes(), pairs.itemsize
        a0 = b0 = g0 = l0 = 0
        for i, a1, b1, g1, l1 in zip(members, a_upto.tolist(), b_upto.tolist(), groups_upto.tolist(), links_upto):
            out[i] = (True, a1 - a0, b1 - b0, g1 - g0, "".join(pieces[a0 + b0 : a1 + b1]), whole[l0 * wide : l1 * wide])
            a0, b0, g0, l0 = a1, b1, g1, l1


def visible_end(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is certainly no white space (some that are none do not count)."""
    last = data[at - 1]
    out = (last > 0x20) & (last < 0x7F)
    wide = np.flatnonzero(last >= 0x80)
    back = [data[np.maximum(at[wide] - k, 0)] for k in (2, 3, 4)]
    two = back[0] >= 0xC0
    three = ~two & (back[1] >= 0xC0)
    four = ~two & ~three & (back[2] >= 0xF0)
    # U+0085 and U+00A0 begin with C2; the other wide spaces with E1, E2 or E3
    out[wide] = (two & (back[0] != 0xC2)) | (three & ((back[1] < 0xE1) | (back[1] > 0xE3))) | four
    return out


def unit_bounds(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the units of texts that each begin with a space and stand before a separator byte."""
    ends = at[1:] - 1
    space = np.flatnonzero(data == 0x20)
    space = space[space > 0]
    cut = space[visible_end(data, space)]
    cut = cut[data[cut + 1] != 0x0A]  # a last space stays with its word; before a line feed it may as well
    starts = np.union1d(at[:-1], cut)
    return starts, np.append(starts[1:], len(data)) - np.isin(np.append(starts[1:], len(data)), at)


def alignments(a_file: str, b_file: str, keep_groups: bool):
    """Task function: one row per document, with its distinct linked pairs and how often it has each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pair, store, number = Pair(a_file, b_file), Recent(UNITS_ROOM, lambda f: 2 * len(f[4]) + 320), TaskContext.get().partitionId() << 33
        word = "<u4" if pair.narrow else "<u8"
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = pc.fill_null(part.column(1).cast(pa.large_string()), "")
                many = len(texts)
                blank = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
                data, at = joined(pc.binary_join_element_wise(pa.scalar("", pa.large_string()), texts, pa.scalar(" ", pa.large_string())))
                starts, ends = unit_bounds(data, at)
                keys, first, which = np.unique(run_hashes(data, starts, ends, 3), return_index=True, return_inverse=True)

                def made(new: list[int], data=data, starts=starts[first], ends=ends[first]) -> list:
                    a, b = starts[new], ends[new]
                    return pair.units([data[x:y].tobytes() for x, y in zip(a.tolist(), b.tolist())], visible_end(data, b).tolist())

                found = store.of(keys.tolist(), made)
                doc = np.searchsorted(at, starts, "right") - 1
                begin = np.searchsorted(starts, at[:-1])
                ok = np.logical_and.reduceat(np.array([f[0] for f in found])[which], begin) & ~blank
                counts = [np.where(ok, np.add.reduceat(np.array([f[k] for f in found], np.int64)[which], begin), 0) for k in (1, 2, 3)]
                strings = np.array([f[4] for f in found], object)[which].tolist()
                groups = ["".join(strings[a:b])[:-1] if good else "" for a, b, good in zip(begin.tolist(), [*begin[1:].tolist(), len(strings)], ok.tolist())]
                sizes = np.array([len(f[5]) for f in found], np.int64) // (4 if pair.narrow else 8)
                pool = np.frombuffer(b"".join([f[5] for f in found]), word)
                values, local = np.unique(pool, return_inverse=True)
                both, times = np.unique(doc[ok[doc]] * np.int64(len(keys)) + which[ok[doc]], return_counts=True)
                owner, unit = both // len(keys), both % len(keys)
                n = sizes[unit]
                place = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n - (np.cumsum(sizes) - sizes)[unit], n)
                linked, back = np.unique(np.repeat(owner, n) * np.int64(max(len(values), 1)) + local[place], return_inverse=True)
                often = np.bincount(back, np.repeat(times, n), len(linked)).astype(np.int64)
                copies = -(-often // 255)  # a count beyond a byte takes several entries
                linked, rest = np.repeat(linked, copies), np.repeat(often, copies)
                rest = np.minimum(rest - 255 * (np.arange(len(rest)) - np.repeat(np.cumsum(copies) - copies, copies)), 255)
                upto = np.searchsorted(linked, np.arange(many + 1) * max(len(values), 1)).astype(np.int32)
                links = np.bincount(linked // max(len(values), 1), rest, many).astype(np.int64)
                blobs = [
                    pa.Array.from_buffers(pa.binary(), many, [None, pa.py_buffer(upto * wide), pa.py_buffer(x)])
                    for x, wide in ((values[linked % max(len(values), 1)].astype(word) if len(values) else values, 4 if pair.narrow else 8), (rest.astype(np.uint8), 1))
                ]
                columns = [part.column(0), pa.array(number + np.arange(many)), *map(pa.array, counts), pa.array(links)]
                columns.append(pa.array([hashlib.sha256(g.encode()).hexdigest() if good else "" for g, good in zip(groups, ok.tolist())], pa.string()))
                names = ["doc_id", "row", "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times"]
                if keep_groups:
                    blobs.append(pa.array(groups, pa.string()))
                    names.append("groups")
                yield pa.RecordBatch.from_arrays([*columns, *blobs], names)
                number += many

    return run


def aligned(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", keep_groups: bool = False) -> DataFrame:
    """One row per row of ``docs``: its counts, its distinct pairs with their numbers as bytes, and on request its groups as text."""
    rows = named(docs, doc_id=doc_id, text=text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    shape = f"doc_id {kind}, row bigint, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups_sha256 string, pairs binary, times binary"
    return rows.mapInArrow(alignments(a_file, b_file, keep_groups), shape + (", groups string" if keep_groups else ""))


def flat_pairs(batch: pa.RecordBatch, narrow: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row number in the batch, pair (``a << 32 | b``) and number of all entries."""
    blobs = [batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("pairs", "times")]
    pairs, times = np.frombuffer(b"".join(blobs[0]), "<u4" if narrow else "<u8"), np.frombuffer(b"".join(blobs[1]), np.uint8)
    pairs = pairs.astype(np.int64)
    if narrow:
        pairs = (pairs >> 16) << 32 | (pairs & 0xFFFF)
    return np.repeat(np.arange(batch.num_rows), [len(x) for x in blobs[1]]), pairs, times.astype(np.int64)


def pair_counts(rows: DataFrame, narrow: bool) -> DataFrame:
    """``pair, n, best``: how many links of the corpus hold a pair, and whether no pair with its B id has more.

    Tasks send each of their pairs once (a million entries at a time); a pair is one row from there on.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, waiting = [], 0

        def combined() -> tuple[np.ndarray, np.ndarray]:
            pairs, at = np.unique(np.concatenate([p for p, _ in held]), return_inverse=True)
            return pairs, np.bincount(at, np.concatenate([n for _, n in held]), len(pairs)).astype(np.int64)

        for batch in batches:
            _, pairs, times = flat_pairs(batch, narrow)
            held.append((pairs, times))
            waiting += len(pairs)
            if waiting > FLUSH:
                held = [combined()]
                waiting = len(held[0][0])
                if waiting > FLUSH // 2:
                    yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["pair", "n"])
                    held, waiting = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([*map(pa.array, combined())], ["pair", "n"])

    totals = written(rows.select("pairs", "times").mapInArrow(count, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n")))
    b = F.col("pair").bitwiseAND(F.lit((1 << 32) - 1))
    highest = totals.groupBy(b.alias("b")).agg(F.max("n").alias("most"))
    return totals.join(highest, b == F.col("b")).select("pair", "n", (F.col("n") == F.col("most")).alias("best"))


def align_tokenizers(docs: DataFrame, a_file: str, b_file: str, doc_id: str = "doc_id", text: str = "text", most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256``: one row per row of ``docs``.

    A is a byte-level tokenizer file, B a sentence-piece model; both cut a space and the text, specials being plain text. A text
    that is null or empty, or of which either tokenizer's bytes are not the space and the text (B takes U+2581 for a space), has
    no tokens: zeros, and ``''`` for the digest. Every row counts, rows that repeat an id or have none as well.

    The rows are tokenised once and written, with their distinct pairs (six bytes each). The table of all pairs is bounded by
    the vocabularies, not by the corpus; if it has at most ``most_pairs`` rows (17 bytes each) it is broadcast and the documents
    are summed up where they lie, beyond that documents' pairs meet it in a join that adaptive execution splits.
    """
    spark, narrow = docs.sparkSession, Pair(a_file, b_file).narrow
    rows = written(aligned(docs, a_file, b_file, doc_id, text))
    counts = written(pair_counts(rows, narrow))
    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    kind = rows.schema["doc_id"].dataType.simpleString()
    if counts.count() <= most_pairs:
        table = counts.toArrow().sort_by("pair")
        shipped = Shipped(spark, tuple(table[c].to_numpy() for c in ("pair", "n", "best")))

        def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            pair, n, best = shipped.value
            for batch in batches:
                for part in slices(batch, "pairs"):
                    row, pairs, times = flat_pairs(part, narrow)
                    at = np.searchsorted(pair, pairs)
                    best_, sum_ = (np.zeros(part.num_rows, np.int64) for _ in range(2))
                    np.add.at(best_, row, times * best[at])
                    np.add.at(sum_, row, times * n[at])
                    more = {"n_best": pa.array(best_), "count_sum": pa.array(sum_)}
                    yield pa.RecordBatch.from_arrays([more[c] if c in more else part.column(part.schema.get_field_index(c)) for c in names], names)

        shape = ", ".join(f"{c} {kind if c == 'doc_id' else 'string' if c == 'groups_sha256' else 'bigint'}" for c in names)
        return rows.select(*own, "pairs", "times").mapInArrow(sums, shape)

    def entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "pairs"):
                row, pairs, times = flat_pairs(part, narrow)
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(row)), pa.array(pairs), pa.array(times)], ["row", "pair", "times"])

    met = rows.select("row", "pairs", "times").mapInArrow(entries, "row bigint, pair bigint, times bigint").join(counts, "pair")
    summed = met.groupBy("row").agg(F.sum(F.when(F.col("best"), F.col("times")).otherwise(0)).alias("n_best"), F.sum(F.col("times") * F.col("n")).alias("count_sum"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("n_best", "count_sum")]
    return rows.select("row", *own).join(summed, "row", "left").select(*own[:-1], *zero, own[-1])
