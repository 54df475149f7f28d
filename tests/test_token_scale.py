"""Tokens and losses at scale: no token is sorted or shuffled, repeated keys and rare tokens included."""

import math
import random
from collections import defaultdict

from tuples import rows

from marginalia.operators import metrics as E
from marginalia.operators import tokens as TK
from marginalia.plans.evaluation import padded_batches, row_losses, token_table
from marginalia.sources.corpora import materialize


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def words(spark):
    rng = random.Random(5)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 300}" for _ in range(rng.randint(0, 30))) for _ in range(60)] + [None, "", None, ""]
    return [(None if i % 9 == 4 else i // 2, t) for i, t in enumerate(texts)]


def test_texts_that_share_their_keys_become_one_row(spark):
    data = words(spark)
    df = spark.createDataFrame(data, "ord long, text string").repartition(3)
    vocab = materialize(TK.build_vocab(df))
    known = {r["token"]: r["id"] for r in vocab.collect()}
    groups = defaultdict(list)
    for o, t in data:
        groups[o, t is not None].append(t)
    for bound in (200_000, 20):
        for ends in (False, True):
            source = TK.VocabularySource(vocab, bound=bound)
            got = sorted(rows(source.ids(df, 20, ["ord"], ends=ends), "ord", "input_ids", *(["token_ends"] if ends else [])), key=repr)
            expected = []
            for (o, some), texts in groups.items():
                # the piece of a word is the word with the space before it
                placed = sorted((i, len(w) + (i > 0) if ends else 0, known[w]) for t in texts if some for i, w in enumerate(t.split()[:20]))
                upto = [sum(n for _, n, _ in placed[: k + 1]) for k in range(len(placed))]
                row = (o, [x for *_, x in placed] if some else None)
                expected.append((*row, *([upto if some else None] if ends else [])))
            assert got == sorted(expected, key=repr)


def test_no_token_becomes_a_row(spark):
    df = spark.createDataFrame(words(spark), "ord long, text string")
    vocab = materialize(TK.build_vocab(df))
    for ends in (False, True):
        assert "Generate" not in plan_of(TK.VocabularySource(vocab).ids(df, 1536, ["ord"], ends=ends))
    rare = TK.VocabularySource(vocab, bound=20)
    assert plan_of(rare.ids(df, 1536, ["ord"])).count("Scan ExistingRDD") == 0  # texts are cut once and kept, not once per step


def test_batches_by_texts_that_do_not_move(spark):
    tag = "<|im_start|>assistant\n"
    data = [(i, "s" + str(i % 2), "no tag" if i == 8 else f"p{i % 5} {tag}a{'b ' * i}") for i in range(11)]
    df = spark.createDataFrame(data, "ord long, split string, text string").repartition(2)
    vocab = materialize(TK.build_vocab(df))
    source = TK.VocabularySource(vocab, bound=6)
    plain = {r["ord"]: r for r in token_table(df, source, ["ord"], no_tag="mask_all").collect()}
    got = {r["ord"]: r for r in padded_batches(df, source, no_tag="mask_all").collect()}
    assert set(got) == set(range(11))
    for i, r in got.items():
        pad = lambda x, n, v: x + [v] * (n - len(x))
        mates = [len(plain[j]["input_ids"]) for j, s in got.items() if (s["split"], s["batch_id"]) == (r["split"], r["batch_id"])]
        n = max(mates)
        assert r["input_ids"] == pad(plain[i]["input_ids"], n, 0) and r["labels"] == pad(plain[i]["labels"], n, -100)


def test_labels_meet_their_losses_where_they_are(spark):
    schema = "row_id long, labels array<int>"
    train = spark.createDataFrame([(i, [-100, 1, 2, 2, 30 + i % 3]) for i in range(20)], schema)
    evaluated = spark.createDataFrame([(i // 2, [-100, -100, 2, 31, 39, None][: 2 + i % 5]) for i in range(12)] + [(None, [5, 2]), (99, None)], schema)
    fit = E.fit_unigram(train, 40)
    scored = E.score_rows(evaluated, fit, (0.5, 2.0), ["row_id"])
    long = E.row_loss(E.unigram_losses(train, evaluated, 40, 0.5, ["row_id"]), ["model", "row_id"])
    for df in (scored, E.unigram_losses(train, evaluated, 40, 0.5, ["row_id"])):
        assert "SortMergeJoin" not in plan_of(df) and "ShuffledHashJoin" not in plan_of(df)
    whole = sorted(rows(scored), key=repr)
    rare = sorted(rows(E.score_rows(evaluated, E.UnigramFit(fit.counts, fit.total, 40, bound=10), (0.5, 2.0), ["row_id"])), key=repr)
    assert whole == rare and len(whole) == 8
    by_position = {r["row_id"]: r["row_loss"] for r in long.collect() if r["model"] == "unigram"}
    arrays = {r["row_id"]: r["row_loss"] for r in row_losses(train, evaluated, 40, 0.5, ["row_id"]).collect() if r["model"] == "unigram"}
    assert set(by_position) == set(arrays) and all(math.isclose(by_position[k], arrays[k], abs_tol=1e-12) for k in arrays)
