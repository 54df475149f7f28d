"""Near-duplicate groups by min-max hashing, with every link confirmed on full shingle sets.

Each permutation of the shingle hashes gives two signature values, the smallest and the largest image; both meet between
two texts with probability equal to their Jaccard similarity. 64 permutations give 128 values in 32 bands of 4: two texts
at the threshold of 0.75 share no band with probability (1 - 0.75^4)^32 < 6e-6, if their sets are large. The two ends of one
permutation are different shingles, so of m common shingles among u both meet with m(m-1)/(u(u-1)): in small sets two texts
are missed with 1e-4 (3 of 4), 2e-5 (6 of 8) or 9e-6 (15 of 20).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..constants import BROADCAST_ROW_BOUND
from ..operators.bounds import keep_keys
from .components import components
from .shared import mix, named, slices, stream, text_shingles, tidy, written

PERMUTATIONS = 64
ROWS = 4
BANDS = 2 * PERMUTATIONS // ROWS
PERCENT = 75


def min_max_bands(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Band keys (texts x bands) of the non-empty shingle sets that stand in ``hashes`` one after the other.

    A band holds two permutations: the minimum and the maximum of each. Its key is a hash of (band, four values).
    """
    first = np.cumsum(sizes) - sizes
    factors, shifts = stream(11, PERMUTATIONS) | np.uint64(1), stream(12, PERMUTATIONS)
    lots = stream(13, BANDS)
    keys = np.empty((len(sizes), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(sizes), lots[band])
        for p in range(band * ROWS // 2, (band + 1) * ROWS // 2):
            images = hashes * factors[p] + shifts[p]
            key = mix(key + np.minimum.reduceat(images, first))
            key = mix(key ^ np.maximum.reduceat(images, first))
        keys[:, band] = key
    return keys


def set_keys(hashes: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A 128-bit hash of each shingle set, in two words (0 for empty sets)."""
    full = sizes > 0
    k = np.zeros((2, len(sizes)), np.uint64)
    if full.any():
        first = (np.cumsum(sizes) - sizes)[full]
        for i, seed in enumerate(stream(17, 2)):
            k[i, full] = np.add.reduceat(mix(hashes ^ seed), first)
    return k


def signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``doc_id, n_shingles, k1, k2, bands``: the size and a 128-bit hash of each shingle set, and its band keys."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, sizes = text_shingles(part.column(1))
            full, k = sizes > 0, set_keys(hashes, sizes)
            bands = min_max_bands(hashes, sizes[full]) if full.any() else np.empty((0, BANDS), np.uint64)
            ends = np.concatenate([[0], np.cumsum(full * BANDS)])
            yield pa.RecordBatch.from_arrays(
                [
                    part.column(0),
                    pa.array(sizes, pa.int64()),
                    pa.array(k[0].view(np.int64)),
                    pa.array(k[1].view(np.int64)),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(bands.reshape(-1).view(np.int64))),
                ],
                ["doc_id", "n_shingles", "k1", "k2", "bands"],
            )


def shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``n_shingles, k1, k2, shingles``: each text's distinct shingle hashes and the set's hash."""
    for batch in batches:
        for part in slices(batch, "text"):
            hashes, sizes = text_shingles(part.column(1))
            ends = np.concatenate([[0], np.cumsum(sizes)])
            sets = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(hashes.view(np.int64)))
            k = set_keys(hashes, sizes).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int64()), pa.array(k[0]), pa.array(k[1]), sets], ["n_shingles", "k1", "k2", "shingles"])


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Links ``a, b`` between the documents of those pairs of classes (``a, b``, each a class and its document) whose full sets meet the threshold."""
    left = sets.select(F.col("rep").alias("ra"), F.col("shingles").alias("sa"))
    right = sets.select(F.col("rep").alias("rb"), F.col("shingles").alias("sb"))
    both = F.size(F.array_intersect("sa", "sb"))
    flat = pairs.select(F.col("a.rep").alias("ra"), F.col("b.rep").alias("rb"), F.col("a.doc").alias("a"), F.col("b.doc").alias("b"))
    tried = flat.join(left, "ra").join(right, "rb").withColumn("both", both)
    return tried.where(100 * F.col("both") >= PERCENT * (F.size("sa") + F.size("sb") - F.col("both"))).select("a", "b")


def ordered() -> list:
    """A class and the other one (``p``, of ``pd``), as ``a, b`` in the order of their numbers."""
    here, there = F.struct("rep", "doc"), F.struct(F.col("p").alias("rep"), F.col("pd").alias("doc"))
    return [F.least(here, there).alias("a"), F.greatest(here, there).alias("b")]


def similar_size(a: str, b: str):
    """Sets of sizes m <= n have a similarity of m/n at most."""
    return 100 * F.least(a, b) >= PERCENT * F.greatest(a, b)


def by_pivots(slots: DataFrame, sets: DataFrame, links: DataFrame | None, labels: DataFrame | None, smallest: bool) -> tuple:
    """Compare members (class ``rep`` of ``doc``, ``n, key, place``) with pivots of their buckets; the links, labels and slots still open.

    The pivot of a bucket is the member that shares the most buckets with others (the original of a group of edited copies
    stands out) and, with ``smallest``, the smallest set too. Confirmed links are contracted to components; a bucket whose
    members are all in one component is done.
    """
    sizes = slots.groupBy("key").agg(F.count("*").alias("m"))
    central = slots.join(sizes, "key").groupBy("rep").agg(F.sum("m").alias("shared"))
    slots = written(still_open(slots.join(central, "rep"), labels))
    lots = [F.struct(-F.col("shared"), "rep"), *([F.struct("n", "rep")] if smallest else [])]
    chosen = F.struct(F.col("rep").alias("p"), F.col("doc").alias("pd"), F.col("n").alias("pn"), F.col("label").alias("pl"))
    pivots = slots.groupBy("key").agg(F.array_distinct(F.array(*[F.min_by(chosen, lot) for lot in lots])).alias("pivots"))
    met = slots.join(pivots.select("key", F.explode("pivots").alias("pivot")).select("key", "pivot.*"), "key")
    met = met.where((F.col("label") != F.col("pl")) & similar_size("n", "pn"))
    found = written(confirmed(met.select(*ordered()).distinct(), sets))
    links = found if links is None else links.union(found)
    labels = components(links)
    return links, labels, written(still_open(slots.drop("label"), labels))


def still_open(slots: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The slots with their members' labels, of buckets with more than one label."""
    if labels is None:
        return slots.withColumn("label", F.col("doc"))
    placed = slots.join(labels.withColumnRenamed("node", "doc"), "doc", "left").withColumn("label", F.coalesce("label", "doc"))
    many = placed.groupBy("key").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("key")
    return placed.join(many, "key")


def prefix_slots(rest: DataFrame, sets: DataFrame) -> DataFrame:
    """Buckets by prefix shingle for the members of open band buckets.

    With shingles in one order, rarest first, two sets of similarity t share a shingle among the first
    n - ceil(t n) + 1 of each: no link is lost, and what many texts have in common is left out of most prefixes.
    """
    open_sets = written(sets.join(rest.select("rep", "doc").distinct(), "rep"))
    each = open_sets.select("rep", "doc", F.explode("shingles").alias("key"))
    common = each.groupBy("key").agg(F.count("*").alias("m"))
    in_order = each.join(common, "key").groupBy("rep", "doc").agg(F.sort_array(F.collect_list(F.struct("m", "key"))).alias("keys"))
    n = F.size("keys")
    prefix = F.slice("keys", F.lit(1), (n - F.ceil(PERCENT * n / 100) + 1).cast("int"))
    slots = in_order.select("rep", "doc", n.cast("bigint").alias("n"), F.posexplode(prefix).alias("place", "k"))
    return written(slots.where("k.m > 1").select("rep", "doc", "n", F.col("k.key").alias("key"), (F.col("place") + 1).alias("place")))


def pairs_across(slots: DataFrame) -> DataFrame:
    """All pairs across components of a prefix bucket that can still be similar enough.

    At the first shingle two sets share, at the places i and j, they have 1 + min(n - i, m - j) in common at most.
    """
    other = slots.select("key", F.col("rep").alias("p"), F.col("doc").alias("pd"), F.col("n").alias("pn"), F.col("label").alias("pl"), F.col("place").alias("pp"))
    most = 1 + F.least(F.col("n") - F.col("place"), F.col("pn") - F.col("pp"))
    reach = (100 + PERCENT) * most >= PERCENT * (F.col("n") + F.col("pn"))
    met = slots.join(other, "key").where((F.col("label") < F.col("pl")) & similar_size("n", "pn") & reach)
    return met.select(*ordered()).distinct()


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id, kept``: one row per row of ``docs``.

    Texts with equal shingle sets are one class, so a group of copies of any size costs one representative (partial
    aggregates on the set's hash). Representatives meet in band buckets. No bucket is expanded into all of its pairs:
    every member is compared with one pivot of its bucket, confirmed links are contracted to components, and buckets that
    lie within one component are done. Members of buckets with several components meet again by the rare shingles they
    share (an exact filter), first two pivots of each and then in those pairs across components that their sizes and places
    allow, so no link between different texts of a bucket is lost.

    A null or wordless text has no shingles, is linked with nothing and is kept. A null doc_id belongs to a component like
    any other row but never names it; without a row that has an id, its component is null and it is kept. Rows that repeat
    a doc_id and its text are one document: they get the same result. A doc_id with several texts counts as one document
    that stands in the groups of each.
    """
    source = named(docs, doc_id=doc_id, text=text).withColumn("doc_id", F.col("doc_id").cast("bigint"))
    shape = "doc_id bigint, n_shingles bigint, k1 bigint, k2 bigint, bands array<bigint>"
    rows = written(source.mapInArrow(tidy(signatures), shape))
    key = ["n_shingles", "k1", "k2"]
    # classes have numbers of their own, as a document with several texts can name several of them
    classes = written(
        rows.where("n_shingles > 0 and doc_id is not null")
        .groupBy(*key)
        .agg(F.min("doc_id").alias("doc"), F.min_by("bands", "doc_id").alias("bands"))
        .withColumn("rep", F.monotonically_increasing_id())
    )
    slots = written(
        classes.select("rep", "doc", F.col("n_shingles").alias("n"), F.posexplode("bands").alias("band", "key")).select(
            "rep", "doc", "n", F.xxhash64("band", "key").alias("key"), F.lit(0).alias("place")
        )
    )
    crowded = slots.groupBy("key").agg(F.count("*").alias("m")).where("m > 1").select("key")
    slots = written(slots.join(crowded, "key"))
    wanted = written(slots.select("rep").distinct().join(classes.select("rep", "doc", *key), "rep"))
    of = wanted.select(F.col("doc").alias("doc_id")).distinct()
    sets = written(
        keep_keys(source, of, "doc_id", wanted.count())
        .mapInArrow(tidy(shingle_sets), "n_shingles bigint, k1 bigint, k2 bigint, shingles array<bigint>")
        .groupBy(*key)
        .agg(F.any_value("shingles").alias("shingles"))
        .join(wanted.select("rep", *key), key)
        .select("rep", "shingles")
    )
    links, labels, rest = by_pivots(slots, sets, None, None, False)
    if not rest.isEmpty():
        links, labels, rest = by_pivots(prefix_slots(rest, sets), sets, links, labels, True)
        if not rest.isEmpty():
            found = confirmed(pairs_across(rest), sets)
            labels = components(links.union(written(found)))
    nodes = classes.select(*key, F.col("doc").alias("node"))
    grouped = nodes.join(labels, "node", "left").select(*key, F.coalesce("label", "node").alias("label"))
    # Empty sets and classes without an id are not in `grouped`; such rows stand alone.
    named_rows = rows.select("doc_id", *key).join(grouped, key, "left")
    component = F.coalesce("label", "doc_id")
    return named_rows.select("doc_id", "n_shingles", component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.col("label").isNull()).alias("kept"))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` without the rows of near-duplicate groups that are not their group's document; all columns stay.

    Rows with a null doc_id always stay, and so do all rows that repeat a kept doc_id.
    """
    gone = "_gone"
    while gone in {c.lower() for c in docs.columns}:
        gone += "_"
    dropped = written(near_duplicates(docs, doc_id, text).where("not kept and doc_id is not null").select(F.col("doc_id").alias(gone)).distinct())
    few = dropped.count() <= BROADCAST_ROW_BOUND
    return docs.join(F.broadcast(dropped) if few else dropped, F.col(f"`{doc_id}`") == F.col(gone), "left_anti")
