"""What several operators share: row keys, written tables, Arrow slices, words and shingles as numpy arrays."""

from __future__ import annotations

import ctypes
import gc
import pickle
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from ..session import scratch_folder

SHINGLE_WORDS = 5
SLICE_BYTES = 1 << 20


def remainder(doc_id: str | Column, divisor: int) -> Column:
    """crc32 of the id as text, modulo ``divisor``; a null id counts as the empty text."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % divisor


def written(df: DataFrame, *partition_by: str) -> DataFrame:
    """The table written to the shared folder and read back: its lineage ends there."""
    path = scratch_folder(df.sparkSession)
    df.write.partitionBy(*partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def named(df: DataFrame, **cols: str) -> DataFrame:
    """Only the wanted columns, under the operator's own names; other columns cannot clash with them."""
    return df.select(*[F.col(f"`{old}`").alias(new) for new, old in cols.items()])


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Runs of rows with about ``limit`` bytes of text each (one row at least, never part of a row)."""
    if not batch.num_rows:
        return
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64) + 1)
    at = 0
    while at < batch.num_rows:
        upto = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, "right")))
        yield batch.slice(at, upto - at)
        at = upto


def one_text_each(rows: DataFrame, keys: DataFrame, *on: str) -> DataFrame:
    """``on, text``: of the rows whose ``on`` is in ``keys`` (few enough to broadcast), one for each, however often it stands there.

    It is the row with the lowest hash of its text, so the order of rows does not matter. Tasks send one text of a key each.
    """
    found = rows.join(F.broadcast(keys), list(on), "left_semi").where("text is not null")
    return found.groupBy(*on).agg(F.min_by("text", F.struct(F.xxhash64("text"), F.crc32(F.col("text").cast("binary")))).alias("text"))


def append(df: DataFrame, text: str, fields: Sequence[StructField], make: Callable[[], Callable], limit: int = SLICE_BYTES) -> DataFrame:
    """``df`` with columns computed from its text column, row by row, without a shuffle.

    ``make()`` runs once per task and gives the function from a text array to one array per field. The new names must
    not occur in ``df``.
    """
    taken = {c.lower() for c in df.columns}
    if clash := [f.name for f in fields if f.name.lower() in taken]:
        raise ValueError(f"columns are there already: {clash}")
    kinds = [pa_type(f) for f in fields]
    names, place = [*df.columns, *[f.name for f in fields]], df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for batch in batches:
            batch = pa.RecordBatch.from_arrays(batch.columns, [f"c{i}" for i in range(batch.num_columns)])
            for part in slices(batch, f"c{place}", limit):
                made = [pa.array(x, type=k) for x, k in zip(work(part.column(place)), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], names)

    return df.mapInArrow(tidy(run), StructType([*df.schema.fields, *fields]))


def tidy(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """A task function that gives memory back to the system at its end.

    Workers go on to other tasks, and what one operator has freed but kept would add to what the next one needs.
    """

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        give_back()

    return whole


def give_back() -> None:
    """Give memory that is free, but kept, back to the system: at the end of a task, and on the driver after a fit."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library of most Linux systems has it
    if trim is not None:
        trim(0)


class Shipped:
    """A broadcast object of this package's classes; it is pickled with its code, like the functions that use it."""

    def __init__(self, spark: SparkSession, value: object):
        self.data, self.held = spark.sparkContext.broadcast(cloudpickle.dumps(value)), None

    def __getstate__(self) -> dict:
        return {"data": self.data, "held": None}

    @property
    def value(self):
        if self.held is None:
            self.held = (pickle.loads(self.data.value),)
            # the pickled bytes would stay in memory beside the object; who asks again reads them from the worker's file
            vars(self.data).pop("_value", None)
        return self.held[0]


class Recent:
    """What a task has worked out for the keys it met lately, in about ``room`` bytes; results never depend on what is held.

    Values go to a young half. When that is full it becomes the old half, and what was old goes; a use brings a value back to
    the young half, so what is used often stays.
    """

    def __init__(self, room: int, weigh: Callable[[object], int]):
        self.room, self.weigh, self.young, self.old, self.used = room // 2, weigh, {}, {}, 0

    def of(self, keys: list[int], make: Callable[[list[int]], list]) -> list:
        """The values of distinct keys; ``make(places)`` gives those that are not held (none is None)."""
        out = list(map(self.young.get, keys))
        new = []
        for i in [i for i, v in enumerate(out) if v is None]:
            out[i] = self.old.get(keys[i])
            if out[i] is None:
                new.append(i)
            else:
                self.keep(keys[i], out[i])
        for i, v in zip(new, make(new) if new else ()):
            out[i] = v
            self.keep(keys[i], v)
        return out

    def keep(self, key: int, value: object) -> None:
        self.young[key] = value
        self.used += self.weigh(value)
        if self.used > self.room:
            self.young, self.old, self.used = {}, self.young, 0


def pa_type(field: StructField) -> pa.DataType:
    return {"boolean": pa.bool_(), "int": pa.int32(), "bigint": pa.int64(), "double": pa.float64(), "string": pa.string(), "binary": pa.binary()}[
        field.dataType.simpleString()
    ]


def joined(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts with a line feed after each, and where each text starts (one more entry: the end).

    A null text is empty. No word of one text touches a word of the next.
    """
    column = pc.fill_null(column.cast(pa.large_string()), "")
    n = len(column)
    sizes = pc.binary_length(column).to_numpy(zero_copy_only=False).astype(np.int64)
    starts = np.concatenate([[0], np.cumsum(sizes + 1)])
    whole = pc.binary_join(pa.LargeListArray.from_arrays(pa.array([0, n], pa.int64()), column), pa.scalar("\n", pa.large_string()))
    return np.concatenate([np.frombuffer(whole[0].as_buffer(), np.uint8), np.array([10], np.uint8)]), starts


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection on 64-bit words that spreads every input bit (the finaliser of the splitmix generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def stream(seed: int, n: int) -> np.ndarray:
    """``n`` fixed pseudo-random 64-bit words."""
    return mix((np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed << 32)) * np.uint64(0x9E3779B97F4A7C15))


def lowered(data: np.ndarray) -> np.ndarray:
    """A-Z made lower case; all other bytes as they are."""
    table = np.arange(256, dtype=np.uint8)
    table[65:91] += 32
    return table[data]


def word_bounds(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of bytes other than 0x20 and 0x09-0x0D; ``data`` ends with a space byte."""
    space = np.zeros(256, bool)
    space[[32, *range(9, 14)]] = True
    inside = np.concatenate([[False], ~space[data]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    return edges[::2], edges[1::2]


def run_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, seed: int = 1) -> np.ndarray:
    """A 64-bit hash of each run of ``values`` (small integers); runs do not overlap and are in order."""
    if not len(starts):
        return np.empty(0, np.uint64)
    lengths = ends - starts
    first = np.cumsum(lengths) - lengths
    at = np.arange(int(lengths.sum()))
    at -= np.repeat(first, lengths)
    taken = values[at + np.repeat(starts, lengths)]
    symbols = stream(seed, int(taken.max()) + 1) | np.uint64(1)
    places = stream(seed + 1, int(lengths.max()))
    terms = symbols[taken]
    terms *= places[at]
    sums = np.add.reduceat(terms, first)
    return mix(sums + lengths.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingle_hashes(words: np.ndarray, per_text: np.ndarray, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the word shingles of each text in order, and how many each text has.

    A text with fewer words than ``size`` has its whole sequence as one shingle; a text without words has none.
    """
    factors = stream(7, size) | np.uint64(1)
    counts = np.where(per_text >= size, per_text - size + 1, np.minimum(per_text, 1))
    begins = np.cumsum(per_text) - per_text
    first = np.cumsum(counts) - counts
    at = np.arange(int(counts.sum())) - np.repeat(first, counts) + np.repeat(begins, counts)
    room = np.minimum(np.repeat(begins + per_text, counts) - at, size)
    padded = np.concatenate([words, np.zeros(size, np.uint64)])
    sums = room.astype(np.uint64)
    for k in range(size):
        sums = sums + np.where(room > k, padded[at + k], np.uint64(0)) * factors[k]
    return mix(sums), counts


def distinct_sorted(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct hashes in ascending order, and how many they are."""
    ends = np.cumsum(counts)
    hashes = hashes.copy()
    for a, b in zip((ends - counts).tolist(), ends.tolist()):
        if b - a > 1:
            hashes[a:b].sort()
    new = np.ones(len(hashes), bool)
    new[1:] = hashes[1:] != hashes[:-1]
    new[(ends - counts)[counts > 0]] = True
    kept = np.add.reduceat(new, (ends - counts)[counts > 0]) if len(hashes) else np.empty(0, np.int64)
    sizes = np.zeros(len(counts), np.int64)
    sizes[counts > 0] = kept
    return hashes[new], sizes


def text_shingles(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct word shingles of each text (sorted hashes, one text after the other), and their numbers."""
    data, at = joined(column)
    data = lowered(data)
    starts, ends = word_bounds(data)
    per_text = np.diff(np.searchsorted(starts, at))
    return distinct_sorted(*shingle_hashes(run_hashes(data, starts, ends), per_text))
