"""Language-model scoring by subword lattice likelihood.

A word's probability is the sum over all of its segmentations into pieces of an existing subword vocabulary, by a forward
recursion in log space. Words end where white space does, pieces never cross it, so a document's marginal probability is
the product of its words' and of the end piece's. What the corpus teaches is how often each whole word occurs: a word
known from training is one more arc through its lattice, weighted by its count against the number of distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .op2_language import HashIndex
from .shared import joined, lowered, remainder, run_hashes, slices, word_bounds, written

CHUNK_BYTES = 24 << 20
BLOCK = 200_000
MARK = "▁"
MOST = 65_535


class PieceLattice:
    """All segmentations of a word into the pieces of a subword vocabulary file.

    The file's scores are merge ranks (0, -1, -2, ...), not log probabilities; the piece of rank r gets a probability in
    proportion to 1 / (r + 1), the end piece that of rank 0 and each byte piece that of the last rank. A character
    without a piece of its own is spelled in byte pieces, so every word has a segmentation.
    """

    def __init__(self, model_file: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=model_file)
        pieces = [(sp.id_to_piece(i), -sp.get_score(i)) for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i))]
        pieces = [(p, r) for p, r in pieces if r < 1e8]  # runs of spaces are marked as never produced
        last = max(r for _, r in pieces)
        weights = np.array([1 / (r + 1) for _, r in pieces])
        whole = weights.sum() + 1 + 256 / (last + 1)
        self.end, self.byte = float(np.log(1 / whole)), float(np.log(1 / (last + 1) / whole))
        self.longest = max(len(p) for p, _ in pieces)
        hashes = np.array([self.hash_of(p) for p, _ in pieces], np.uint64)
        self.index, self.log_p = HashIndex(hashes), np.append(np.log(weights / whole), -np.inf)

    @staticmethod
    def hash_of(piece: str) -> int:
        value = 0
        for c in piece:
            value = (value * 0x9E3779B97F4A7C15 + ord(c) + 1) & ((1 << 64) - 1)
        return value

    def arcs(self, codes: np.ndarray) -> np.ndarray:
        """log probability (words x positions x lengths) of the piece that begins at a position with a length."""
        n, size = codes.shape
        out = np.full((n, size, self.longest), -np.inf)
        value = np.zeros((n, size), np.uint64)
        for k in range(min(self.longest, size)):
            value = value[:, : size - k] * np.uint64(0x9E3779B97F4A7C15) + codes[:, k:].astype(np.uint64) + np.uint64(1)
            out[:, : size - k, k] = self.log_p[self.index.find(value.reshape(-1))].reshape(n, size - k)
        bytes_ = 1 + (codes > 0x7F) + (codes > 0x7FF) + (codes > 0xFFFF)
        out[:, :, 0] = np.where(np.isneginf(out[:, :, 0]), bytes_ * self.byte, out[:, :, 0])
        return out

    def same_length(self, codes: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each row of characters (the word mark included)."""
        n, size = codes.shape
        m = self.longest
        forward = np.full((n, m + 1), -np.inf)  # the last m + 1 positions, the newest last
        forward[:, -1] = 0
        step = max(m, BLOCK // n)
        lengths = np.arange(m)
        for start in range(0, size, step):
            upto = min(size, start + step)
            low = max(0, start - m + 1)
            arcs = self.arcs(codes[:, low:upto])
            for end in range(start + 1, upto + 1):
                begin = end - 1 - lengths  # where a piece of length k + 1 begins
                fits = begin >= low
                paths = forward[:, m - lengths[fits]] + arcs[:, begin[fits] - low, lengths[fits]]
                top = paths.max(1)
                forward[:, :-1] = forward[:, 1:]
                forward[:, -1] = top + np.log(np.exp(paths - top[:, None]).sum(1))
        return forward[:, -1]

    def log10_of(self, words: list[str]) -> np.ndarray:
        """log10 of the marginal probability of each word (not empty)."""
        sizes, out = np.array([len(w) for w in words], np.int64), np.empty(len(words))
        for size in np.unique(sizes).tolist():
            at = np.flatnonzero(sizes == size)
            for some in np.array_split(at, -(-len(at) * (size + 1) // BLOCK)):
                if len(some):
                    text = "".join(MARK + words[i] for i in some.tolist())
                    out[some] = self.same_length(np.frombuffer(text.encode("utf-32-le"), np.uint32).reshape(len(some), size + 1))
        return out / np.log(10)


def posting_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of documents turned round: a row per (chunk, word) with the documents it stands in, a row per document.

    A chunk is a run of a task's rows with about 24 MB of text and fewer than 65,536 rows; its number is (task, counter).
    """
    task, number = TaskContext.get().partitionId(), 0
    parts, size, held = [], 0, 0
    for batch in batches:
        for part in slices(batch, "text"):
            for at in range(0, part.num_rows, MOST):
                some = part.slice(at, MOST)
                if parts and (size + some.num_rows > MOST or held >= CHUNK_BYTES):
                    yield from one_chunk(parts, (task << 33) + number)
                    parts, size, held, number = [], 0, 0, number + 1
                parts.append(some)
                size += some.num_rows
                held += some.nbytes
    if parts:
        yield from one_chunk(parts, (task << 33) + number)


def one_chunk(parts: list[pa.RecordBatch], chunk: int) -> Iterator[pa.RecordBatch]:
    keys, texts, owners, times, per_doc, base = [], [], [], [], [], 0
    for part in parts:
        data, at = joined(part.column("text"))
        data = lowered(data)
        starts, ends = word_bounds(data)
        counts = np.diff(np.searchsorted(starts, at))
        per_doc.append(counts)
        if len(starts):
            word, first, which = np.unique(run_hashes(data, starts, ends), return_index=True, return_inverse=True)
            pair, n = np.unique(which * np.int64(part.num_rows) + np.repeat(np.arange(part.num_rows), counts), return_counts=True)
            keys.append(word[pair // part.num_rows])
            owners.append(base + pair % part.num_rows)
            times.append(n)
            texts.append((word, byte_runs(data, starts[first], ends[first])))
        base += part.num_rows
    ids, train = (pa.concat_arrays([p.column(c) for p in parts]) for c in ("doc_id", "train"))
    n_words = np.concatenate(per_doc)
    local = pa.array(np.arange(base), pa.int64())
    none = pa.nulls(base, pa.string())
    yield rows(pa.array(np.full(base, chunk)), none, pa.nulls(base, pa.int64()), pa.nulls(base, pa.binary()), pa.nulls(base, pa.binary()), local, ids, train, pa.array(n_words, pa.int64()))
    if not keys:
        return
    vocabulary, first = np.unique(np.concatenate([w for w, _ in texts]), return_index=True)
    words = pa.concat_arrays([x for _, x in texts]).take(pa.array(first))
    key = np.searchsorted(vocabulary, np.concatenate(keys))
    owner, n = np.concatenate(owners), np.concatenate(times)
    learned = np.bincount(key, n * train.to_numpy(zero_copy_only=False)[owner], len(vocabulary)).astype(np.int64)
    copies = -(-n // MOST)  # a count beyond 16 bits takes several entries
    key, owner, rest = np.repeat(key, copies), np.repeat(owner, copies), np.repeat(n, copies)
    nth = np.arange(len(key)) - np.repeat(np.cumsum(copies) - copies, copies)
    n = np.minimum(rest - nth * MOST, MOST)
    order = np.argsort(key, kind="stable")
    ends = 2 * np.concatenate([[0], np.cumsum(np.bincount(key, minlength=len(vocabulary)))]).astype(np.int32)
    blobs = [pa.Array.from_buffers(pa.binary(), len(vocabulary), [None, pa.py_buffer(ends), pa.py_buffer(x[order].astype("<u2"))]) for x in (owner, n)]
    many = len(vocabulary)
    empty = pa.nulls(many, pa.int64())
    yield rows(pa.array(np.full(many, chunk)), words, pa.array(learned), *blobs, empty, pa.nulls(many, ids.type), pa.nulls(many, pa.bool_()), empty)


def rows(*columns: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(list(columns), ["chunk", "word", "n_train", "docs", "times", "local", "doc_id", "train", "n_words"])


def byte_runs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The runs of UTF-8 bytes as strings."""
    sizes = ends - starts
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(int(offsets[-1])) - np.repeat(offsets[:-1] - starts, sizes)
    return pa.Array.from_buffers(pa.string(), len(starts), [None, pa.py_buffer(offsets.astype(np.int32)), pa.py_buffer(data[at])])


def score_texts(docs: DataFrame, train: Column, model_file: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, lattice_score``: one row per row of ``docs``.

    ``train`` says which rows teach (null: no). Tokens are the words of the text with A-Z lowered, then one end; a null
    text is empty. With c the training count of a token, N of all and V distinct ones: ``base_score`` sums
    log10((c+1) / (N+V+1)), ``score`` sums log10((c + (V+1) q) / (N+V+1)), where q is the token's lattice probability: the
    lattice of a word that training knows has one more arc, from end to end. ``lattice_score`` sums log10(q), the marginal
    probability under the vocabulary's own scores alone.

    Documents are turned into (chunk, word) rows in one pass; words meet their corpus count by an equi-join, so the
    vocabulary may be of any size, and the rows go back to their chunk, where the sums per document are made. A frequent
    word has one row per chunk, not per occurrence; the join is one that adaptive execution splits.
    """
    spark = docs.sparkSession
    source = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(train, F.lit(False)).alias("train"))
    kind = source.schema["doc_id"].dataType.simpleString()
    shape = f"chunk bigint, word string, n_train bigint, docs binary, times binary, local bigint, doc_id {kind}, train boolean, n_words bigint"
    turned = written(source.mapInArrow(posting_rows, shape).withColumn("is_word", F.col("word").isNotNull()), "is_word")
    words = turned.where("is_word").select("chunk", "word", "n_train", "docs", "times")
    texts = turned.where("not is_word").select("chunk", "local", "doc_id", "train", "n_words")

    def with_lattice(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = PieceLattice(model_file)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(lattice.log10_of(batch.column(0).to_pylist()), pa.float64())], ["word", "c", "lattice"])

    vocabulary = written(words.groupBy("word").agg(F.sum("n_train").alias("c")).mapInArrow(with_lattice, "word string, c bigint, lattice double"))
    total = vocabulary.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count_if(F.col("c") > 0).alias("v")).first()
    ends = texts.agg(F.count_if(F.col("train")).alias("n")).first().n
    n, v = int(total.n) + int(ends), int(total.v) + (ends > 0)
    end_lattice = PieceLattice(model_file).end / np.log(10)
    room = np.log10(n + v + 1)
    end_base, end_score = np.log10(ends + 1) - room, log10_sum(np.array([ends]), np.array([end_lattice]), v)[0] - room

    def sums(key, docs_: pa.Table, words_: pa.Table) -> pa.Table:
        many = docs_.num_rows
        place = np.argsort(docs_["local"].to_numpy())
        known, base, score, lattice = (np.zeros(many) for _ in range(4))
        if words_.num_rows:
            blob = words_.select(["docs", "times"]).combine_chunks()
            owner, times = (np.frombuffer(b"".join(blob[c].to_pylist()), "<u2").astype(np.int64) for c in ("docs", "times"))
            c, q = words_["c"].to_numpy(), words_["lattice"].to_numpy()
            per = np.array([len(x) // 2 for x in blob["docs"].to_pylist()])
            known = np.bincount(owner, times * np.repeat(c > 0, per), many)
            base = np.bincount(owner, times * np.repeat(np.log10(c + 1) - room, per), many)
            score = np.bincount(owner, times * np.repeat(log10_sum(c, q, v) - room, per), many)
            lattice = np.bincount(owner, times * np.repeat(q, per), many)
        ordered = docs_.take(pa.array(place))
        return pa.table(
            {
                "doc_id": ordered["doc_id"],
                "held_out": pc.invert(ordered["train"]),
                "n_tokens": pa.array(ordered["n_words"].to_numpy() + 1),
                "n_known": pa.array(known.astype(np.int64) + (ends > 0)),
                "train_tokens": pa.array(np.full(many, n, np.int64)),
                "base_score": pa.array(base + end_base),
                "score": pa.array(score + end_score),
                "lattice_score": pa.array(lattice + end_lattice),
            }
        )

    counted = words.select("chunk", "word", "docs", "times").join(vocabulary, "word").select(F.col("chunk").alias("of"), "docs", "times", "c", "lattice")
    shape = f"doc_id {kind}, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double, lattice_score double"
    return texts.groupBy("chunk").cogroup(counted.groupBy("of")).applyInArrow(sums, shape)


def log10_sum(c: np.ndarray, lattice: np.ndarray, v: int) -> np.ndarray:
    """log10(c + (v + 1) 10^lattice), also where the power is too small for a double."""
    with np.errstate(divide="ignore"):
        return np.logaddexp(np.log(c.astype(np.float64)), np.log(v + 1.0) + lattice * np.log(10)) / np.log(10)


def learnable() -> Column:
    """Rows outside the held-out seventh (by ``doc_id``)."""
    return remainder("doc_id", 7) != 2
