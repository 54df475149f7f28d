"""Chat rendering and parsing, token tables, batches."""

import random
import re

import pytest
from tuples import rows
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType

from marginalia.constants import ASSISTANT_TAG
from marginalia.operators import chat as C
from marginalia.operators import tokens as TK
from marginalia.operators.ordering import exact_quantiles
from marginalia.operators.columns import decode_label, encode_label, normalize_code, normalize_commit, with_text
from marginalia.sources.corpora import materialize


def test_code_chat_word_for_word(spark):
    df = spark.createDataFrame([(1, " x = 1\n", " Sets x. ", "Python")], "ord long, code string, docstring string, language string")
    expected = (
        "<|im_start|>system\nYou are a senior engineer. Summarize code for non-technical managers: plain English, "
        "1–3 sentences, no jargon, no code, start with a verb.<|im_end|>\n<|im_start|>user\nLanguage: python\n"
        "Instruction: Explain clearly and concisely what this code does.\nCode:\n```python\nx = 1\n```<|im_end|>\n"
        "<|im_start|>assistant\nSets x.<|im_end|>\n"
    )
    assert rows(C.render_code(df, "mix_code"), "text") == [(expected,)]
    raw = rows(with_text(df), "text", "language_norm")
    assert raw == [(expected.replace("x = 1\n```", " x = 1\n\n```"), "python")]


def test_commit_chats_word_for_word(spark):
    df = spark.createDataFrame([(1, "a", "b", "Change b", "Why\nso")], "ord long, old_contents string, new_contents string, subject string, message string")
    diff = rows(C.render_commit(df, "mix_commit"), "text")[0][0]
    assert "Language: code\nInstruction: Explain clearly and concisely what changed between BEFORE and AFTER.\nBEFORE:\n```diff\na\n```\n\nAFTER:\n```diff\nb\n```<|im_end|>" in diff
    assert diff.endswith("<|im_start|>assistant\nChange b Why so<|im_end|>\n")
    brief = rows(C.render_commit(df, "commit_brief"), "text")[0][0]
    assert "what changed.\n\nBEFORE:\n```python\na\n```\n\nAFTER:" in brief and brief.endswith("assistant\n<|im_end|>\n")
    tight = rows(C.render_mixed(df, "final_mixed"), "text")[0][0]
    assert "BEFORE and AFTER.\nBEFORE:\n```python\na\n```\nAFTER:\n```python\nb\n```<|im_end|>" in tight
    assert tight.endswith("assistant\nChange b Why\nso<|im_end|>\n")
    assert C.ensure_chat(df.withColumn("text", F.lit("x")), F.lit(True), "final_mixed").columns[-1] == "text"


def test_parsing(spark):
    texts = ["no tag", f"p {ASSISTANT_TAG}one {ASSISTANT_TAG}two<|im_end|>\n", f"{ASSISTANT_TAG}<|im_end|>\n", f"q{ASSISTANT_TAG} a <|im_end|> b", None]
    df = spark.createDataFrame(list(enumerate(texts)), "ord int, text string")
    got = rows(C.with_target(C.split_prompt(df)).orderBy("ord"), "prompt", "rest", "target")
    assert got == [
        (None, None, None),
        (f"p {ASSISTANT_TAG}", f"one {ASSISTANT_TAG}two<|im_end|>\n", f"one {ASSISTANT_TAG}two"),
        (ASSISTANT_TAG, "<|im_end|>\n", ""),
        (f"q{ASSISTANT_TAG}", " a <|im_end|> b", "a"),
        (None, None, None),
    ]
    assert sorted(r[0] for r in rows(C.check_chat(df), "ord")) == [0, 4]
    pairs = C.compare_pairs(spark.createDataFrame([(3, "a<|im_end|>junk"), (1, "x" * 500)], "ord int, prediction string"), df)
    assert sorted(rows(pairs, "ord", "exact")) == [(1, False), (3, True)]


def test_row_shapes(spark):
    raw = spark.createDataFrame([("c", None)], "func_code_string string, func_documentation_string string")
    assert rows(normalize_code(raw), "code", "docstring", "language") == [("c", "", "code")]
    commit = spark.createDataFrame([(" a ", None, "s ", "go")], "old_contents string, message string, subject string, lang string")
    assert rows(normalize_commit(commit), "old_code", "new_code", "message", "subject", "language") == [("a", "", "", "s", "go")]
    labels = spark.createDataFrame([("b",), ("a",), (None,), ("c",), ("a",)], "l string")
    coded = encode_label(labels, "l")
    assert sorted(rows(coded), key=repr) == sorted([(1,), (0,), (None,), (2,), (0,)], key=repr)
    assert sorted(rows(decode_label(coded, "l", ["a", "b", "c"])), key=repr) == sorted(rows(labels), key=repr)


@pytest.fixture(scope="module")
def chat(spark):
    data = [(i, f"p {'w ' * i}{ASSISTANT_TAG}good answer {i}<|im_end|>\n") for i in range(5)] + [(9, "untagged text")]
    return spark.createDataFrame(data, "ord long, text string")


def test_vocabulary_and_ids(chat):
    vocab = TK.build_vocab(chat.where("ord < 9"))
    table = {r["token"]: (r["id"], r["count"]) for r in vocab.collect()}
    distinct = {t for (ts,) in rows(chat.where("ord < 9").select(TK.token_list("text"))) for t in ts}
    assert set(table) == distinct | {"<pad>", "<unk>"} and table["<pad>"][0] == 0 and table["<unk>"][0] == 1
    ordered = sorted((t for t in table if t[0] != "<" or "im_" in t), key=lambda t: (-table[t][1], t))
    assert [table[t][0] for t in ordered] == list(range(2, len(table)))
    ids = {r["ord"]: r["input_ids"] for r in TK.tokenize(chat, TK.vocabulary_source(vocab), 100).collect()}
    tokens = {r["ord"]: r["t"] for r in chat.select("ord", TK.token_list("text").alias("t")).collect()}
    for o, ts in tokens.items():
        assert ids[o] == [table[t][0] if t in table else 1 for t in ts]


def test_prompt_tokens_are_a_prefix(chat):
    parts = C.split_prompt(chat.where("ord < 9")).select(TK.token_list("text").alias("t"), TK.token_list("prompt").alias("p"))
    assert all(t[: len(p)] == p and p[-1] == "\n" for t, p in rows(parts))


def test_mask_batch_and_pad(chat):
    source = TK.vocabulary_source(TK.build_vocab(chat))
    for max_len in (1536, 6):
        masked = TK.mask_prompt(TK.tokenize(chat, source, max_len), source, no_tag="mask_all")
        for r in masked.withColumn("p", TK.token_count(C.prompt_of("text"))).collect():
            n, cut = len(r["input_ids"]), r["p"] if r["ord"] < 9 else 10**6
            assert r["labels"] == [-100 if i < cut else x for i, x in enumerate(r["input_ids"])] and n <= max_len
    batched = TK.assign_batches(masked, 2)
    assert sorted(rows(batched, "ord", "batch_id")) == [(0, 0), (1, 0), (2, 1), (3, 1), (4, 2), (9, 2)]
    tokens = TK.arrays_only(TK.mask_prompt(TK.tokenize(chat, source), source, "mask_all"))
    padded = TK.pad_batches(TK.assign_batches(tokens, 2)).collect()
    plain = {r["ord"]: r for r in tokens.collect()}
    for r in padded:
        longest = max(len(plain[o["ord"]]["input_ids"]) for o in padded if o["batch_id"] == r["batch_id"])
        gap = longest - len(plain[r["ord"]]["input_ids"])
        assert r["input_ids"] == plain[r["ord"]]["input_ids"] + [0] * gap
        assert r["attention_mask"] == plain[r["ord"]]["attention_mask"] + [0] * gap
        assert r["labels"] == plain[r["ord"]]["labels"] + [-100] * gap
    with pytest.raises(Exception, match="assistant tag not found"):
        TK.mask_prompt(TK.tokenize(chat, source), source).select("labels").collect()


def test_own_tokenizer_as_pandas_udf(spark, chat):
    @F.pandas_udf(ArrayType(IntegerType()))
    def char_ids(texts):
        return texts.map(lambda t: [ord(c) % 7 for c in t] if t is not None else None)

    source = TK.TokenSource(lambda text, n: F.slice(char_ids(text), 1, n), lambda text: F.size(char_ids(text)))
    got = TK.mask_prompt(TK.tokenize(chat.where("ord < 3"), source), source)
    for r in got.withColumn("n", F.length(C.prompt_of("text"))).collect():
        assert r["labels"] == [-100 if i < r["n"] else x for i, x in enumerate(r["input_ids"])]
        assert len(r["input_ids"]) == len(r["text"])


def test_profile(chat):
    got = TK.token_profile(chat.withColumn("split", F.lit("a")), max_len=6).collect()[0]
    tokens = [len(t) for (t,) in rows(chat.select(TK.token_list("text")))]
    assert got["rows"] == 6 and got["max_tokens"] == max(tokens)
    assert got["share_truncated"] == sum(t > 6 for t in tokens) / 6


def test_p5_decode_answers_for_many_labels(spark, monkeypatch):
    from marginalia.queries import all_queries, registry

    many = spark.range(10_500).selectExpr("id as ord", "if(id % 1000 = 7, null, concat('l', id)) as language")
    monkeypatch.setattr(registry.I, "code_rows", lambda spark, sf: many)
    assert sorted(rows(all_queries()["p5_decode"](spark, ""), "ord", "language"), key=repr) == sorted(rows(many), key=repr)


def test_masks_by_offsets_with_tokens_across_the_tag(spark):
    """White space belongs to the word after it, so the answer's first token begins with the tag's newline."""
    answers = ["Return it", " x", "\n\nlong answer here", "", "é東 wide 😀 text", "a  b"]
    texts = ["<|im_start|>user\nsay so<|im_end|>\n" + ASSISTANT_TAG + a for a in answers] + ["no tag at all", ""]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(99, None)], "ord long, text string")
    vocab = TK.build_vocab(df, pattern=TK.LEADING_SPACE_PATTERN)
    ids = {r["token"]: r["id"] for r in vocab.collect()}
    for source, pattern in (
        (TK.VocabularySource(vocab, TK.LEADING_SPACE_PATTERN, skipped=""), r"\s*[^\s]+"),
        (TK.VocabularySource(vocab, TK.LEADING_SPACE_PATTERN, skipped="", bound=7), r"\s*[^\s]+"),  # most of the vocabulary by shuffle
        (TK.VocabularySource(vocab), None),
    ):
        got = {r["ord"]: r for r in TK.mask_by_offsets(TK.tokens_with_ends(df, source), no_tag="mask_all").collect()}
        assert set(got) == {*range(len(texts)), 99} and got[99]["input_ids"] is None
        for i, text in enumerate(texts):
            r, end = got[i], text.find(ASSISTANT_TAG) + len(ASSISTANT_TAG)
            tagged = ASSISTANT_TAG in text
            if pattern:
                found = [(m.end(), ids[m.group()]) for m in re.finditer(pattern, text)]
                assert list(zip(r["token_ends"], r["input_ids"])) == found
                assert r["labels"] == [-100 if not tagged or e <= end else x for e, x in found]
                if i == 0:  # "\nReturn" begins in the tag and is kept
                    assert r["labels"][-2] == ids["\nReturn"]
            else:
                found = [text[:e] for e in r["token_ends"]]
                assert all(not f[-1:].isspace() or f[-1] == "\n" for f in found)
                assert sum(x == -100 for x in r["labels"]) == (sum(len(f) <= end for f in found) if tagged else len(found))


def test_the_rare_tokens_join_by_shuffle(spark):
    rng = random.Random(3)
    texts = [" ".join(f"w{int(rng.paretovariate(0.4)) % 500}" for _ in range(rng.randint(0, 60))) for _ in range(200)] + [None, ""]
    df = spark.createDataFrame([(None if i == 5 else i, t) for i, t in enumerate(texts)], "ord long, text string")
    vocab = TK.build_vocab(df.where("ord < 150"))
    whole = {r["ord"]: r for r in TK.tokenize(df, TK.VocabularySource(vocab)).collect()}
    split = {r["ord"]: r for r in TK.tokenize(df, TK.VocabularySource(vocab, bound=10)).collect()}
    assert whole == split and len(whole) == 202 and whole[200]["input_ids"] is None and whole[201]["input_ids"] == []
    known = {r["token"]: r["id"] for r in vocab.collect()}
    for i, t in enumerate(texts[:200]):
        assert whole[None if i == 5 else i]["input_ids"] == [known.get(x, 1) for x in t.split()]
    plan = TK.VocabularySource(materialize(vocab)).ids(df, 1536, ["ord"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("REPARTITION_BY_COL") == 1  # the texts move once, no token does


def test_percentiles_by_a_histogram(spark):
    rng = random.Random(8)
    data = [(g, None if rng.random() < 0.05 else int(rng.paretovariate(0.3)) % 10**9) for g in ("a", "b", None) for _ in range({"a": 1, "b": 999, None: 2000}[g])]
    data += [("none", None)] * 3
    df = spark.createDataFrame(data, "g string, v long").repartition(7)
    got = {r["g"]: r for r in exact_quantiles(df, {"v": F.col("v")}, ["g"], [0, 1, 500, 900, 999, 1000]).collect()}
    assert set(got) == {"a", "b", None, "none"}
    for g, r in got.items():
        values = sorted(v for x, v in data if x == g and v is not None)
        assert r["rows"] == sum(x == g for x, _ in data)
        for p, name in ((0, "p0"), (1, "p0_1"), (500, "p50"), (900, "p90"), (999, "p99_9"), (1000, "p100")):
            assert r[name] == (values[max(-(-len(values) * p // 1000), 1) - 1] if values else None)


def test_labels_beyond_the_broadcast_bound_are_salted(spark, monkeypatch):
    from marginalia.operators import bounds

    rows_ = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, "hot").when(F.col("id") % 100 == 1, None).otherwise(F.concat(F.lit("l"), F.col("id") % 50)).alias("l"))
    plain = sorted(rows(encode_label(rows_, "l")), key=repr)
    monkeypatch.setattr(bounds, "BROADCAST_ROW_BOUND", 5)
    coded = encode_label(rows_, "l")
    assert "_salt" in coded._jdf.queryExecution().optimizedPlan().toString()
    assert sorted(rows(coded), key=repr) == plain
    names = sorted({l for _, l in rows(rows_) if l is not None})
    assert plain == sorted(((i, None if l is None else names.index(l)) for i, l in rows(rows_)), key=repr)
