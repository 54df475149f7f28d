"""Sharding, scoring, search and packing against brute force, and the pipeline end to end."""

import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from helpers import ODD, documents, prose, words
from pyspark.sql import functions as F

from marginalia.llm import op6_sharding, op7_lattice, op8_neighbours, op9_packing
from marginalia.llm.queries import llm_queries, vocabulary_file
from marginalia.llm.shared import mix


# --- sharding -------------------------------------------------------------------------------------------------------
def test_shards_slots_and_growth(spark):
    texts = [prose(i, i % 50) for i in range(3000)] + ODD + ["same"] * 500
    docs = documents(spark, texts).withColumns({"shard": F.lit(1), "sub": F.lit(2)})
    got = op6_sharding.assign_shards(docs, 40).collect()
    assert len(got) == len(texts)
    by = defaultdict(list)
    for r in got:
        t = texts[r.doc_id] or ""
        assert (r.size, r.text_crc32, r.law) == (len(t.encode()) + 16, zlib.crc32(t.encode()), "key")
        by[r.shard].append(r.slot)
        assert r.grown_shard in (r.shard, 40)
    assert set(by) <= set(range(40)) and all(sorted(s) == list(range(len(s))) for s in by.values())
    moved = sum(r.grown_shard == 40 for r in got)
    assert 0.3 * len(got) / 41 < moved < 2.5 * len(got) / 41
    sizes = [len(s) for s in by.values()]
    assert len(sizes) == 40 and max(sizes) < 2 * min(sizes)
    plan = op6_sharding.assign_shards(docs, 40)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_one_shard_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (3, "b"), (3, "b")], "doc_id long, text string")
    assert sorted((r.shard, r.slot) for r in op6_sharding.assign_shards(docs, 1).collect()) == [(0, i) for i in range(4)]
    assert op6_sharding.assign_shards(docs.where("false"), 40).count() == 0


def test_every_step_only_moves_into_the_new_shard(spark):
    keys = spark.range(2000)
    shards = keys.select(*[op6_sharding.jump_shard(F.col("id"), n).alias(f"s{n}") for n in (1, 2, 3, 8, 9, 64, 65)]).collect()
    for a, b in ((1, 2), (2, 3), (8, 9), (64, 65)):
        assert all(r[f"s{b}"] in (r[f"s{a}"], b - 1) for r in shards)


def test_written_shards_hold_every_row(spark, tmp_path):
    docs = documents(spark, [prose(i, 5) for i in range(300)])
    op6_sharding.write_shards(docs, 4, str(tmp_path / "out"))
    assert sorted(r.doc_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == list(range(300))


# --- language-model score -------------------------------------------------------------------------------------------
def piece_scores():
    from sentencepiece import SentencePieceProcessor

    sp = SentencePieceProcessor(model_file=vocabulary_file("piece_bpe_32k.model"))
    ranks = {sp.id_to_piece(i): -sp.get_score(i) for i in range(259, sp.vocab_size()) if -sp.get_score(i) < 1e8}
    last = max(ranks.values())
    whole = sum(1 / (r + 1) for r in ranks.values()) + 1 + 256 / (last + 1)
    return {p: 1 / (r + 1) / whole for p, r in ranks.items()}, 1 / whole, 1 / (last + 1) / whole


def test_scores_equal_sums_over_all_segmentations(spark):
    pieces, end, byte = piece_scores()

    def lattice(word):
        s, total = "▁" + word, [1.0] + [0.0] * (len(word) + 1)
        for j in range(1, len(s) + 1):
            for i in range(max(0, j - 16), j):
                p = pieces.get(s[i:j]) or (byte ** len(s[i:j].encode()) if j - i == 1 else 0)
                total[j] += total[i] * p
        return total[-1]

    texts = [prose(i % 7, 20 + i) + " The the tHe" for i in range(40)] + [t for t in ODD if t is None or len(t) < 100] + ["the " * 70_000]
    docs = documents(spark, texts).withColumns({"train": F.lit("clash"), "chunk": F.lit(1)})
    got = {r.doc_id: r for r in op7_lattice.score_texts(docs, op7_lattice.learnable(), vocabulary_file("piece_bpe_32k.model")).collect()}
    held = {i: zlib.crc32(str(i).encode()) % 7 == 2 for i in range(len(texts))}
    counts = Counter(w for i, t in enumerate(texts) if not held[i] for w in words(t))
    ends = sum(not h for h in held.values())
    n, v = sum(counts.values()) + ends, len(counts) + 1
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        w = words(t)
        base = sum(math.log10((counts[x] + 1) / (n + v + 1)) for x in w) + math.log10((ends + 1) / (n + v + 1))
        score = sum(math.log10((counts[x] + (v + 1) * lattice(x)) / (n + v + 1)) for x in w) + math.log10((ends + (v + 1) * end) / (n + v + 1))
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(w) + 1, sum(counts[x] > 0 for x in w) + 1, n)
        assert math.isclose(r.base_score, base, rel_tol=1e-9) and math.isclose(r.score, score, rel_tol=1e-9)
        assert math.isclose(r.lattice_score, sum(math.log10(lattice(x)) for x in w) + math.log10(end), rel_tol=1e-9)


def test_long_words_and_nothing_to_learn_from(spark):
    lattice = op7_lattice.PieceLattice(vocabulary_file("piece_bpe_32k.model"))
    whole, split = lattice.log10_of(["ab" * 3000]), None
    op7_lattice.BLOCK, kept = 1_000, op7_lattice.BLOCK
    try:
        split = lattice.log10_of(["ab" * 3000])
    finally:
        op7_lattice.BLOCK = kept
    assert np.isfinite(whole).all() and np.allclose(whole, split)
    docs = documents(spark, ["some words", None])
    out = op7_lattice.score_texts(docs, F.lit(False), vocabulary_file("piece_bpe_32k.model")).collect()
    assert {r.n_known for r in out} == {0} and all(np.isfinite([r.score, r.base_score]).all() for r in out)
    assert op7_lattice.score_texts(docs.where("false"), F.lit(True), vocabulary_file("piece_bpe_32k.model")).count() == 0


# --- neighbours -----------------------------------------------------------------------------------------------------
def test_small_lists_and_other_lengths_give_k_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i * 10, v.tolist()) for i, v in enumerate(rng.normal(size=(140, 8)))]
    rows += [(i, (v + 1000).tolist()) for i, v in zip((5000, 5100, 10), rng.normal(size=(3, 8)))]  # a list of their own; id 10 is in both
    rows += [(100_000 + i * 50, rng.normal(size=5).tolist()) for i in range(30)]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    got = defaultdict(list)
    for r in op8_neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    assert set(got) == {i for i, _ in rows if i % 100 == 0}
    assert all(len(set(v)) == 10 for v in got.values())
    assert all((v >= 100_000) == (q >= 100_000) for q, found in got.items() for v in found)
    five = {i: np.array(v) for i, v in rows if i >= 100_000}
    for q in (i for i in five if i % 100 == 0):
        assert got[q] == sorted((i for i in five if i != q), key=lambda i: np.linalg.norm(five[i] - five[q]))[:10]


def test_neighbours_against_brute_force(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(3000, 32)).astype(np.float32)
    x[500:900] = x[500]  # a common vector
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(3000, None), (3001, [0.0] * 32), (3002, [float("nan")] * 32), (3003, [None] * 32), (3100, [1.0])]
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("list", F.lit(1)).repartition(5)
    got = defaultdict(list)
    for r in op8_neighbours.nearest(table).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    assert set(got) == set(range(0, 3000, 100))
    hit, wide = 0, x.astype(np.float64)
    for q, found in got.items():
        far = np.sqrt(((wide - wide[q]) ** 2).sum(1))
        far[q] = np.inf
        best = np.lexsort((np.arange(3000), far))[:10]
        hit += len(set(best.tolist()) & {v for _, v, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 11)) and found == sorted(found, key=lambda f: (f[2], f[1]))
        assert all(math.isclose(s, far[v], rel_tol=1e-12) for _, v, s in found)
        if 500 <= q < 900:
            assert [v for _, v, _ in found] == best.tolist()
    assert hit >= 0.9 * 10 * len(got)


def test_few_and_no_vectors(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0]), (2, [1.0, 1.0])], "vec_id long, embedding array<float>")
    assert [(r.rank, r.vec_id) for r in op8_neighbours.nearest(few).orderBy("rank").collect()] == [(1, 2), (2, 1)]
    assert op8_neighbours.nearest(few.where("false")).count() == 0


# --- packing --------------------------------------------------------------------------------------------------------
def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    path = vocabulary_file("word_bpe_49k.json")
    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = True
    texts = [prose(i, (i * 37) % 900) for i in range(150)] + ODD + ["same text"] * 40
    docs = documents(spark, texts).withColumns({"length": F.lit(1), "rank": F.lit(2)})
    got = op9_packing.pack(docs, path, 512).collect()
    ids = {i: np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4") for i, t in enumerate(texts)}
    pieces, windows = defaultdict(list), defaultdict(list)
    for r in got:
        assert r.ids_crc32 == zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) and r.doc_tokens == len(ids[r.doc_id])
        pieces[r.doc_id].append((r.start, r.length))
        windows[r.sequence_id].append((r.offset, r.length))
    for i in ids:
        at = 0
        for start, length in sorted(pieces[i]):
            assert start == at and length > 0
            at += length
        assert at == len(ids[i])
    for some in windows.values():
        at = 0
        for offset, length in sorted(some):
            assert offset == at
            at += length
        assert at <= 512
    assert sorted(windows) == list(range(len(windows)))
    assert len(windows) <= 1.01 * sum(map(len, ids.values())) / 512 + 2
    assert op9_packing.pack(docs.where("false"), path).count() == 0


def test_subset_sum_is_the_best_there_is():
    rng = np.random.default_rng(2)
    for _ in range(200):
        counts = {int(k): int(n) for k, n in zip(rng.integers(1, 30, 5), rng.integers(1, 4, 5))}
        room = int(rng.integers(0, 60))
        taken = op9_packing.fullest(counts, room)
        assert all(n <= counts[k] for k, n in taken.items())
        sums = {0}
        for k, n in counts.items():
            sums = {s + k * i for s in sums for i in range(n + 1)}
        assert sum(k * n for k, n in taken.items()) == max(s for s in sums if s <= room)


def test_plan_uses_every_piece_once():
    counts = {700: 5, 1300: 3, 48: 100, 2048: 2, 5: 7}
    plan, used = op9_packing.packing_plan(counts, 2048), Counter()
    for taken, times in plan:
        assert sum(k * n for k, n in taken.items()) <= 2048
        used.update({k: n * times for k, n in taken.items()})
    assert dict(used) == counts


def test_unit_store_that_is_emptied_gives_the_same_ids():
    import pyarrow as pa

    column, kinds = pa.array([prose(i, 300) for i in range(20)]), op9_packing.character_classes()
    whole = op9_packing.token_ids(column, op9_packing.Units(vocabulary_file("word_bpe_49k.json")), kinds)
    for room in (0, 1_000, 30_000):  # bytes
        small = op9_packing.Units(vocabulary_file("word_bpe_49k.json"))
        small.store.room = room
        parts = [op9_packing.token_ids(column[i : i + 1], small, kinds)[0] for i in range(20)]
        assert np.array_equal(np.concatenate(parts), whole[0]) and small.store.used <= room


def test_mix_is_a_bijection_on_a_sample():
    x = np.arange(100_000, dtype=np.uint64)
    assert len(np.unique(mix(x))) == len(x)


# --- registered queries and the pipeline ----------------------------------------------------------------------------
def test_queries_have_the_asked_columns(spark):
    wanted = {
        "op1_": "doc_id n_assign n_access n_hex base_sha256 spans",
        "op2_": "doc_id held_out lang_pred score",
        "op5_": "doc_id n_shingles component_id kept",
        "op6_": "doc_id size text_crc32 law shard slot grown_shard",
        "op7_": "doc_id held_out n_tokens n_known train_tokens base_score score",
        "op9_": "doc_id start length ids_crc32 doc_tokens sequence_id offset",
        "op10_": "doc_id held_out score predicted",
    }
    assert sorted(int(n[2:].split("_")[0]) for n in llm_queries()) == list(range(1, 11))
    for prefix, columns in wanted.items():
        (name,) = [n for n in llm_queries() if n.startswith(prefix)]
        out = llm_queries()[name](spark, "/root/testdata/sf0.001")
        assert set(columns.split()) <= set(out.columns)
        assert prefix == "op9_" or out.count() == 200


def test_pipeline_stage_by_stage(spark, tmp_path):
    import corpus_pipeline

    leak = prose(77, 40)
    texts = [
        *[prose(i, 60) for i in range(30)],
        edited_copy := prose(3, 60) + " tail",
        prose(500, 30) + " " + leak + " " + prose(501, 30),
        prose(502, 40) + ' token = "f33e61083db5dbdf4bd2369d2f80176e57f7fda2" ' + prose(503, 10),
        None,
        "",
        "12 34 !!",
    ]
    folder = str(tmp_path / "in")
    documents(spark, texts).withColumn("extra", F.lit("x")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder)
        assert out.columns == docs.columns
        out.write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        kept.append({r.doc_id for r in docs.collect()})
    everything = set(range(len(texts)))
    assert kept[0] == everything - {33, 34, 35}
    assert kept[1] == kept[0] - {30} and edited_copy
    assert kept[2] == kept[3] == kept[1] - {31}
    secret = docs.where("doc_id = 32").first()
    assert "f33e" not in secret.text and secret.n_chars == len(secret.text)
    packed = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in packed} == kept[3]


@pytest.mark.parametrize("name", ["op3_license_scan", "op4_decontamination", "op8_nearest", "pipeline"])
def test_other_queries_run(spark, name):
    import __spark_entry__

    assert __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001").count() > 0


# --- hot rows -------------------------------------------------------------------------------------------------------
def plain_jumps(key_uniforms, shards):
    """The walk as a loop over shards: every shard number in turn, jumping where the walk lands on it."""
    at, onwards, i = 0, 0, 0
    for shard in range(shards):
        if shard == onwards:
            at, i = shard, i + 1
            onwards = math.floor((shard + 1) / key_uniforms(i))
    return at


@pytest.mark.parametrize("shards", [1, 2, 16, 17, 40, 300])
def test_the_walk_against_a_loop_over_shards(spark, shards):
    keys = spark.range(400).select(F.when(F.col("id") == 399, None).otherwise(F.col("id") * 7919).alias("k"))
    uniforms = F.transform(F.sequence(F.lit(1), F.lit(shards + 1)), lambda i: (F.shiftrightunsigned(F.xxhash64("k", i), 33) + 1) / F.lit(float(1 << 31)))
    for r in keys.select("k", op6_sharding.jump_shard(F.col("k"), shards).alias("shard"), uniforms.alias("u")).collect():
        assert r.shard == plain_jumps(lambda i: r.u[i - 1], shards)


def test_equal_rows_are_spread(spark):
    n = 200_000
    docs = spark.range(n, numPartitions=16).select(F.lit(None).cast("long").alias("doc_id"), F.lit("").alias("text"))
    slots = op6_sharding.assign_shards(docs, 40)
    got = slots.agg(F.count("*"), F.countDistinct("slot"), F.min("slot"), F.max("slot"), F.countDistinct("shard")).first()
    assert tuple(got) == (n, n, 0, n - 1, 1)
    packed = op9_packing.pack(docs, vocabulary_file("word_bpe_49k.json"), 512)
    got = packed.groupBy("sequence_id").agg(F.countDistinct("offset").alias("d"), F.min("offset").alias("a"), F.max("offset").alias("b"), F.count("*").alias("n"))
    full, rest = divmod(n, 512)
    assert sorted((r.n, r.d, r.a, r.b) for r in got.collect()) == sorted([(512, 512, 0, 511)] * full + [(rest, rest, 0, rest - 1)] * bool(rest))
    sub = F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(op9_packing.SUBS))
    assert docs.groupBy(sub.alias("s")).count().agg(F.max("count")).first()[0] < 4 * n / op9_packing.SUBS
