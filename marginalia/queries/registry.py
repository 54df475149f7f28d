"""One query per operator, over the whole of the given tables.

Arrays are joined to text and floating results are rounded, so that the output can be compared between engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..constants import SPLITS
from ..functions import gates as G
from ..functions import text as T
from ..operators import chat as C
from ..operators import columns as P
from ..operators import dedup as D
from ..operators import filters as FL
from ..operators import metrics as E
from ..operators import runs as L
from ..operators import sampling as SA
from ..operators import sets as U
from ..operators import stats as A
from ..operators import tokens as TK
from ..plans.blend import blend, code_chats, commit_chats
from ..plans.code_corpus import clean_code, compact_code
from ..plans.commit_corpus import clean_commits, compact_commits
from ..plans.evaluation import padded_batches, row_losses, token_table, train_source
from ..session import configure, scratch_folder
from ..sources import corpora as S
from ..streaming.ingest import clean_available
from . import inputs as I

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}

SMALL_QUOTAS = {"train": 100, "validation": 10, "test": 20}
SWEEP = (0.1, 1.0, 10.0)


def query(name: str) -> Callable[[Query], Query]:
    def register(fn: Query) -> Query:
        def run(spark: SparkSession, sf: str) -> DataFrame:
            return fn(configure(spark), sf)

        run.__name__, run.__doc__ = name, fn.__doc__
        _QUERIES[name] = run
        return fn

    return register


def all_queries() -> dict[str, Query]:
    return dict(_QUERIES)


def joined(array: str | Column) -> Column:
    return F.array_join(F.col(array).cast("array<string>") if isinstance(array, str) else array.cast("array<string>"), ",")


# --- text -------------------------------------------------------------------------------------------------
def _code_text(name: str, **columns: Callable[[], Column]) -> None:
    query(name)(lambda spark, sf: I.code_rows(spark, sf).select("ord", *[make().alias(n) for n, make in columns.items()]))


def _commit_text(name: str, **columns: Callable[[], Column]) -> None:
    query(name)(lambda spark, sf: I.commit_rows(spark, sf).select("ord", *[make().alias(n) for n, make in columns.items()]))


_code_text("c1_summary", summary=lambda: T.summary("docstring"))
_code_text("c1_summary_skip_blank", summary=lambda: T.summary("docstring", skip_leading_blank=True))
_commit_text("c2_commit_target_newline", target=lambda: T.commit_target("subject", "message", "\n", collapse=False))
_commit_text("c2_commit_target_space", target=lambda: T.commit_target("subject", "message", " ", empty_as_null=False))
_code_text("c4_collapse_ws", collapsed=lambda: T.collapse_ws("docstring"))
_code_text("c5_ustrip", stripped=lambda: T.ustrip("docstring"))
_code_text("c6_line_count", lines=lambda: T.line_count("code"))
_code_text("c8_content_hash", hash=lambda: T.content_hash("code"))
_commit_text("c8_change_hash", hash=lambda: T.change_hash("old_contents", "new_contents"))
_code_text(
    "c9_preview",
    head=lambda: T.preview_text("code", 800),
    cut=lambda: T.preview_text("code", 400, ellipsis=True),
)
_commit_text("c12_eq_ci", same=lambda: T.eq_ci("subject", "message"), lowered=lambda: T.lower("subject"))


@query("c3_fallback")
def _(spark, sf):
    mixed = I.mixed_rows(I.code_rows(spark, sf), I.commit_rows(spark, sf))
    return mixed.select(
        "source",
        "ord",
        T.target_or_fallback("docstring", "new_contents", "subject", "message").alias("target"),
        T.target_or_fallback("docstring", "new_contents", "subject", "message", strip_first=True).alias("target_strip_first"),
    )


@query("c7_safe_name")
def _(spark, sf):
    label = F.concat_ws("/ ", F.upper("lang"), "source")
    return I.table(spark, sf, "documents").groupBy(T.safe_name(label).alias("folder")).agg(F.count(F.lit(1)).alias("count"))


@query("c10_format")
def _(spark, sf):
    means = I.log_rows(spark, sf).groupBy("run").agg(
        F.avg("loss").alias("ce"), F.avg("eval_loss").alias("ppl"), F.avg("learning_rate").alias("lr")
    )
    return E.format_metrics(means.withColumn("rounded", F.round("ce", 6)), ["ce"], ["ppl"], ["lr"])


@query("c11_char_tests")
def _(spark, sf):
    s = T.summary("docstring", skip_leading_blank=True)
    rows = I.code_rows(spark, sf).select("ord", s.alias("s"))
    return rows.select(
        "ord",
        T.starts_upper("s").alias("upper"),
        T.starts_alpha("s").alias("alpha"),
        T.ends_sentence("s").alias("sentence"),
        T.starts_any("s", ("The", "In", "La")).alias("prefix"),
        F.length("s").alias("chars"),
    )


# --- gates ------------------------------------------------------------------------------------------------
def _commits(spark: SparkSession, sf: str) -> DataFrame:
    """Normalised commit rows with a target, all optional fields present."""
    rows = P.normalize_commit(I.commit_rows(spark, sf)).withColumn("target", T.commit_target("subject", "message"))
    return P.with_fields(rows, P.COMMIT_FIELDS)


def _mixed(spark: SparkSession, sf: str) -> DataFrame:
    return P.with_fields(I.mixed_rows(I.code_rows(spark, sf), I.commit_rows(spark, sf)), P.COMMIT_FIELDS)


def _gate(name: str, rows: Callable[[SparkSession, str], DataFrame], gate: Callable[[], Column], *keys: str) -> None:
    query(name)(lambda spark, sf: rows(spark, sf).select(*keys, "ord", gate().alias("ok")))


_gate("g1_good_summary", I.code_rows, lambda: G.is_good_summary(T.summary("docstring")))
_gate("g2_good_commit", I.commit_rows, lambda: G.is_good_commit(T.commit_target("subject", "message")))
_gate("g3_code_length", I.code_rows, lambda: G.good_code_length("code"))
_gate("g4_change_length", I.commit_rows, lambda: G.good_change_length("old_contents", "new_contents"))
_gate("g5_code_row", I.code_rows, lambda: G.good_code_row())
_gate("g6_commit_row", _commits, lambda: G.good_commit_row())
_gate("g7_good_doc", I.code_rows, lambda: G.good_doc())
_gate("g8_good_target", _commits, lambda: G.good_commit())
_gate("g9_min_fields", _commits, lambda: G.has_min_fields())
_gate("g10_mixed_row", _mixed, lambda: G.good_example_raw(), "source")
_gate("g11_relaxed", _mixed, lambda: G.good_example_relaxed(), "source")


@query("g12_gate_or_all")
def _(spark, sf):
    gate = G.is_good_summary(T.summary("docstring")) & (F.col("split") != "test")
    return FL.gate_or_all(I.code_split(spark, sf), gate).select("ord", "split")


@query("g13_for_language")
def _(spark, sf):
    return FL.for_language(I.code_rows(spark, sf), "fr").select("ord", "language", "code")


@query("g_stream_clean")
def _(spark, sf):
    """Cleaning as the files come in; the second run goes on from the checkpoint of the first and finds nothing new."""
    # a pattern, as the table can be one file or a folder of files
    path, state, source = scratch_folder(spark), scratch_folder(spark), f"{sf}/documents.parque[t]"
    for _run in range(2):
        clean_available(spark, source, lambda docs: clean_code(I.raw_code(I.code_columns(docs))), path, state, partition_by=["language"])
    return S.read_corpus(spark, path).select("ord", "language", "code", "docstring")


@query("g14_gate_report")
def _(spark, sf):
    gates = {
        "good_summary": G.is_good_summary(T.summary("docstring")),
        "code_length": G.good_code_length("code"),
        "code_row": G.good_code_row(),
        "good_doc": G.good_doc(),
    }
    return FL.gate_report(I.code_split(spark, sf), gates)


# --- projections ------------------------------------------------------------------------------------------
@query("p1_code")
def _(spark, sf):
    return P.normalize_code(I.raw_code(I.code_rows(spark, sf)))


@query("p2_commit")
def _(spark, sf):
    return P.normalize_commit(I.commit_rows(spark, sf))


@query("p3_tag")
def _(spark, sf):
    return P.tag(I.table(spark, sf, "benchmark"), "language", "python")


@query("p4_keep")
def _(spark, sf):
    return P.keep(I.code_rows(spark, sf), ["ord", "language"])


@query("p5_encode")
def _(spark, sf):
    return P.encode_label(P.keep(I.code_rows(spark, sf), ["ord", "language"]), "language", out="code")


@query("p5_decode")
def _(spark, sf):
    rows = P.keep(I.code_rows(spark, sf), ["ord", "language"])
    labels = S.materialize(P.label_table(rows, "language"))
    return P.decode_label(P.encode_label(rows, "language", labels=labels), "language", labels=labels)


@query("p6_first_nonempty")
def _(spark, sf):
    return I.commit_rows(spark, sf).select("ord", T.first_nonempty("new_contents", "message", "subject").alias("picked"))


@query("p7_language_norm")
def _(spark, sf):
    mixed = I.mixed_rows(I.code_rows(spark, sf), I.commit_rows(spark, sf))
    shown = F.when(F.col("source") == "code", F.upper("language"))
    return mixed.select("source", "ord", T.language_norm(shown).alias("language_norm"))


@query("p8_with_text")
def _(spark, sf):
    return P.with_text(I.code_rows(spark, sf))


# --- dedup and sampling -----------------------------------------------------------------------------------
@query("d1_dedup_first")
def _(spark, sf):
    rows = I.code_split(spark, sf)
    return D.dedup_first(rows, T.content_hash("code")).select("ord", "language", "split", "code")


@query("d1_first_keys")
def _(spark, sf):
    return D.first_keys(I.code_split(spark, sf), T.content_hash("code"))


@query("d2_sample_k")
def _(spark, sf):
    rows = I.code_rows(spark, sf)
    return SA.sample_k(rows, 50, by=["language"], groups=I.language_bound(spark, sf)).select("ord", "language", "code")


def _some_null(df: DataFrame) -> DataFrame:
    """The rows with one language made null."""
    return df.withColumn("language", F.nullif(F.col("language"), F.lit("de")))


@query("d2_sample_k_null")
def _(spark, sf):
    return SA.sample_k(_some_null(I.code_rows(spark, sf)), 50, by=["language"]).select("ord", "language", "code")


@query("d3_compact_code")
def _(spark, sf):
    rows = D.compact(I.saved_code(spark, sf), "code", languages=I.language_bound(spark, sf))
    return rows.select("ord", "language", "split", "code")


@query("d3_compact_code_small")
def _(spark, sf):
    rows = D.compact(I.saved_code(spark, sf), "code", SMALL_QUOTAS, languages=I.language_bound(spark, sf))
    return rows.select("ord", "language", "split", "code")


@query("d3_compact_commit")
def _(spark, sf):
    rows = S.materialize(clean_commits(I.commit_split(spark, sf)), "split")
    return compact_commits(rows, SMALL_QUOTAS).select("ord", "language", "split", "target")


@query("d4_stratified")
def _(spark, sf):
    return I.code_split(spark, sf).select("ord", "language", "split")


@query("d4_stratified_commit")
def _(spark, sf):
    return I.commit_split(spark, sf).select("ord", "language", "split")


@query("d4_stratified_null")
def _(spark, sf):
    return SA.stratified_split(_some_null(I.code_rows(spark, sf)), "language").select("ord", "language", "split")


@query("d5_split_sizes")
def _(spark, sf):
    return I.code_split(spark, sf).groupBy("language", "split").agg(F.count(F.lit(1)).alias("count"))


@query("d6_shuffle_pos")
def _(spark, sf):
    return SA.shuffle_positions(I.code_rows(spark, sf).select("ord", "language"))


@query("d6_shuffle_rows")
def _(spark, sf):
    return SA.shuffle_rows(I.code_rows(spark, sf).select("ord", "code"))


@query("d7_sample_preview")
def _(spark, sf):
    return SA.sample_preview(I.code_rows(spark, sf).select("ord", "code", "docstring"), 3, cols=["code", "docstring"])


@query("d8_head")
def _(spark, sf):
    return SA.head_rows(I.code_rows(spark, sf), 10)


@query("d9_tiny_slice")
def _(spark, sf):
    return SA.tiny_slice(I.code_split(spark, sf), G.good_doc()).select("ord", "split", "docstring")


@query("d10_mix_50_50")
def _(spark, sf):
    return blend(I.saved_code(spark, sf), I.saved_commits(spark, sf))


@query("d10_mix_70_30")
def _(spark, sf):
    return blend(I.saved_code(spark, sf), I.saved_commits(spark, sf), SMALL_QUOTAS, {"code": 70, "commit": 30})


@query("d10_mix_three_sources")
def _(spark, sf):
    rows = I.saved_code(spark, sf).select("ord", "language", "split")
    return SA.mix({name: FL.for_language(rows, name) for name in ("en", "de", "fr")}, SMALL_QUOTAS)


# --- sets and counts --------------------------------------------------------------------------------------
@query("u1_concat")
def _(spark, sf):
    documents = I.table(spark, sf, "documents").select(F.col("doc_id").alias("id"), "text")
    return U.concat(documents, I.table(spark, sf, "benchmark").select("text", F.col("item_id").alias("id")))


@query("u2_distinct")
def _(spark, sf):
    return U.distinct_values([I.code_rows(spark, sf), I.commit_rows(spark, sf)], "language")


@query("u3_sorted")
def _(spark, sf):
    return U.sorted_values(I.table(spark, sf, "documents"), "source")


@query("a1_top")
def _(spark, sf):
    return A.language_top(I.table(spark, sf, "documents"), 10, "source")


@query("a2_counts")
def _(spark, sf):
    return A.language_counts(I.code_rows(spark, sf))


@query("a3_distribution")
def _(spark, sf):
    return A.language_distribution(I.code_split(spark, sf))


@query("a4_splits")
def _(spark, sf):
    return A.split_sizes(I.code_split(spark, sf))


@query("a5_matrix")
def _(spark, sf):
    return A.corpus_matrix(I.code_split(spark, sf))


@query("a5_matrix_totals")
def _(spark, sf):
    return A.corpus_matrix(I.code_split(spark, sf), totals=True)


@query("a6_norm_counts")
def _(spark, sf):
    return A.language_norm_counts(P.with_text(I.code_rows(spark, sf)))


# --- whole corpora ----------------------------------------------------------------------------------------
@query("code_corpus_counts")
def code_corpus_counts(spark, sf):
    """Rows each language keeps, per split, after cleaning, dedup and quotas."""
    cleaned = S.materialize(clean_code(I.raw_code(I.code_split(spark, sf))), "split")
    return A.corpus_matrix(compact_code(cleaned, languages=I.language_bound(spark, sf)))


@query("commit_corpus_counts")
def _(spark, sf):
    cleaned = S.materialize(clean_commits(I.commit_split(spark, sf)), "split")
    return A.corpus_matrix(compact_commits(cleaned))


def _mixed_path(spark: SparkSession, sf: str) -> DataFrame:
    """The whole path: clean and compact both corpora, one language of each, mix, write, read back."""
    code = S.materialize(clean_code(I.raw_code(I.code_split(spark, sf))), "split")
    commits = S.materialize(clean_commits(I.commit_split(spark, sf)), "split")
    code = FL.for_language(compact_code(code, languages=I.language_bound(spark, sf)), "en")
    commits = FL.for_language(compact_commits(commits), "python")
    path = scratch_folder(spark)
    S.write_corpus(blend(code, commits), path)
    return S.read_corpus(spark, path)


@query("pipeline_mix_counts")
def _(spark, sf):
    return _mixed_path(spark, sf).groupBy("source", "split").agg(F.count(F.lit(1)).alias("count"))


@query("pipeline_mix_rows")
def _(spark, sf):
    return _mixed_path(spark, sf).select("ord", "source", "split", "text", "shuffle_pos")


# --- chat -------------------------------------------------------------------------------------------------
CODE_PROFILES = ("mix_code", "code_by_language", "code_python_raw", "models_code", "final_code")
COMMIT_PROFILES = ("mix_commit", "commit_brief", "commit_sweep", "models_commit", "final_commit")

for _profile in CODE_PROFILES:
    query(f"r1_{_profile}")(lambda spark, sf, p=_profile: C.render_code(I.code_rows(spark, sf), p))
for _profile in COMMIT_PROFILES:
    query(f"r2_{_profile}")(lambda spark, sf, p=_profile: C.render_commit(_commits(spark, sf), p))
for _profile in ("models_mixed", "final_mixed"):
    query(f"r3_{_profile}")(lambda spark, sf, p=_profile: C.render_mixed(_mixed(spark, sf), p))


@query("r4_ensure")
def _(spark, sf):
    mixed = I.mixed_rows(I.saved_code(spark, sf), I.saved_commits(spark, sf))
    mixed = P.with_fields(mixed, P.COMMIT_FIELDS)
    return C.ensure_chat(mixed, G.good_example_relaxed() & (F.col("split") != "validation"), "final_mixed")


@query("r4_pass_through")
def _(spark, sf):
    """A table of which the train split has chat text already (here: the bare code) and the others do not."""
    mixed = P.with_fields(I.mixed_rows(I.saved_code(spark, sf), I.saved_commits(spark, sf)), P.COMMIT_FIELDS)
    ready = mixed.withColumn("text", F.when(F.col("split") == "train", F.coalesce("code", "message")))
    return C.ensure_chat(ready, G.good_example_relaxed() & (F.col("split") != "validation"), "final_mixed")


def _chat(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows of the code corpus, with split and normalised language."""
    rows = I.saved_code(spark, sf)
    return P.with_text(rows).select("ord", F.col("language_norm").alias("language"), "split", "text")


@query("r5_check")
def _(spark, sf):
    chats = C.render_code(I.code_rows(spark, sf), "mix_code").select("ord", "text")
    plain = I.code_rows(spark, sf).select((-F.col("ord") - 1).alias("ord"), F.col("docstring").alias("text"))
    return C.check_chat(chats.unionByName(plain))


@query("r6_prompt")
def _(spark, sf):
    return C.split_prompt(C.render_code(I.code_rows(spark, sf), "mix_code")).select("ord", "prompt", "rest")


@query("r7_target")
def _(spark, sf):
    return C.with_target(C.render_code(I.code_rows(spark, sf), "mix_code")).select("ord", "target")


@query("r8_pairs")
def _(spark, sf):
    rows = I.code_rows(spark, sf)
    guess = F.concat(F.split_part("code", F.lit("\n"), F.lit(1)), F.lit(" <|im_end|>\n"))
    return C.compare_pairs(rows.select("ord", guess.alias("prediction")), C.render_code(rows, "mix_code"))


@query("r8_pairs_whole")
def _(spark, sf):
    """r8_pairs with the whole code as the guess."""
    rows = I.code_rows(spark, sf)
    guess = F.concat("code", F.lit(" <|im_end|>\n"))
    return C.compare_pairs(rows.select("ord", guess.alias("prediction")), C.render_code(rows, "mix_code"))


# --- tokens -----------------------------------------------------------------------------------------------
@query("t0_vocab")
def _(spark, sf):
    return TK.build_vocab(_chat(spark, sf).where("split = 'train'"))


def _source(spark: SparkSession, sf: str) -> TK.TokenSource:
    """Token source with the vocabulary of the train split of the code corpus."""
    vocab = I.saved("vocab", spark, sf, lambda: TK.build_vocab(_chat(spark, sf).where("split = 'train'")))
    return TK.vocabulary_source(vocab)


def _tokens(spark: SparkSession, sf: str) -> DataFrame:
    return token_table(_chat(spark, sf), _source(spark, sf), ["ord", "language", "split"])


@query("t1_tokenize")
def _(spark, sf):
    chat = _chat(spark, sf)
    tokens = TK.tokenize(chat, _source(spark, sf))
    return tokens.select("ord", joined("input_ids").alias("input_ids"), joined("attention_mask").alias("attention_mask"))


@query("t2_mask")
def _(spark, sf):
    return _tokens(spark, sf).select("ord", joined("labels").alias("labels"))


@query("t2_mask_offsets")
def _(spark, sf):
    """Tokens that begin with white space: the first one of the answer begins in the tag, and keeps its label."""
    chat = _chat(spark, sf)
    vocab = TK.build_vocab(chat.where("split = 'train'"), pattern=TK.LEADING_SPACE_PATTERN)
    source = TK.VocabularySource(S.materialize(vocab), TK.LEADING_SPACE_PATTERN, skipped="")
    masked = TK.mask_by_offsets(TK.tokens_with_ends(chat, source))
    return masked.select("ord", joined("token_ends").alias("token_ends"), joined("labels").alias("labels"))


@query("t3_no_tag")
def _(spark, sf):
    chat = _chat(spark, sf)
    source = _source(spark, sf)
    mixed = chat.select("ord", "text").unionByName(I.code_rows(spark, sf).select((-F.col("ord") - 1).alias("ord"), F.col("docstring").alias("text")))
    return token_table(mixed, source, ["ord"], no_tag="mask_all").select("ord", joined("labels").alias("labels"))


@query("t4_batches")
def _(spark, sf):
    return TK.assign_batches(I.code_split(spark, sf).select("ord", "split"), by=["split"])


def _joined_batches(padded: DataFrame) -> DataFrame:
    return padded.select("ord", "split", "batch_id", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("t4_batches_null")
def _(spark, sf):
    return TK.assign_batches(_some_null(I.code_rows(spark, sf)).select("ord", "language"), by=["language"])


@query("t5_pad")
def _(spark, sf):
    batched = TK.assign_batches(_tokens(spark, sf), by=["split"])
    return _joined_batches(TK.pad_batches(batched, by=["split"]))


@query("t5_padded_batches")
def _(spark, sf):
    chat = _chat(spark, sf)
    return _joined_batches(padded_batches(chat, _source(spark, sf)))


@query("t6_arrays_only")
def _(spark, sf):
    arrays = TK.arrays_only(_tokens(spark, sf))
    return arrays.select("ord", *[joined(c).alias(c) for c in ("input_ids", "attention_mask", "labels")])


@query("t7_profile")
def _(spark, sf):
    profile = TK.token_profile(_chat(spark, sf), ["language", "split"])
    shares = [c for c in profile.columns if c.startswith(("avg", "share"))]
    return profile.withColumns({c: F.round(c, 6) for c in shares})


@query("t7_percentiles")
def _(spark, sf):
    return TK.token_percentiles(_chat(spark, sf), ["language", "split"])


# --- metrics ----------------------------------------------------------------------------------------------
def _corpora(spark: SparkSession, sf: str) -> DataFrame:
    """Chat rows of both corpora: ``dataset, language, split, row_id, text``."""
    code = code_chats(I.saved_code(spark, sf)).select(F.lit("code").alias("dataset"), "language", "split", F.col("ord").alias("row_id"), "text")
    commits = commit_chats(I.saved_commits(spark, sf)).select(
        F.lit("commit").alias("dataset"), "language", "split", F.col("ord").alias("row_id"), "text"
    )
    return code.unionByName(commits)


def _corpora_vocab(spark: SparkSession, sf: str) -> DataFrame:
    return I.saved("corpora_vocab", spark, sf, lambda: train_source(_corpora(spark, sf)).vocab)


def _ids(spark: SparkSession, sf: str) -> int:
    """How many ids the vocabulary of both corpora has."""
    return _corpora_vocab(spark, sf).count()


def _eval_tables(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    """Token tables of the train split and of the other two."""

    def tokenized() -> DataFrame:
        return token_table(_corpora(spark, sf), TK.vocabulary_source(_corpora_vocab(spark, sf)))

    tokens = I.saved("tokens", spark, sf, tokenized, "split")
    return tokens.where("split = 'train'"), tokens.where("split <> 'train'")


def _scores(spark: SparkSession, sf: str) -> DataFrame:
    return row_losses(*_eval_tables(spark, sf), _ids(spark, sf))


def _test_scores(spark: SparkSession, sf: str) -> DataFrame:
    return _scores(spark, sf).where("split = 'test'")


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


@query("e0_losses")
def _(spark, sf):
    train, evaluated = _eval_tables(spark, sf)
    return _rounded(E.unigram_losses(train, evaluated, _ids(spark, sf)), "loss")


@query("e1_shift")
def _(spark, sf):
    _, evaluated = _eval_tables(spark, sf)
    return E.shift_labels(evaluated).select("dataset", "row_id", joined("labels").alias("labels"))


@query("e2_row_loss")
def _(spark, sf):
    train, evaluated = _eval_tables(spark, sf)
    return _rounded(E.row_loss(E.unigram_losses(train, evaluated, _ids(spark, sf))), "row_loss")


@query("e2_row_loss_arrays")
def _(spark, sf):
    return _rounded(_scores(spark, sf), "row_loss")


@query("e3_ce_ppl")
def _(spark, sf):
    return _rounded(E.ce_ppl(_scores(spark, sf), ["model", "split"]), "avg_ce", "perplexity")


@query("e4_language")
def _(spark, sf):
    return _rounded(E.ce_by_language(_test_scores(spark, sf), ["model"]), "avg_ce", "perplexity")


@query("e5_dataset")
def _(spark, sf):
    return _rounded(E.ce_by_dataset(_test_scores(spark, sf), ["model"]), "avg_ce", "perplexity")


@query("e6_models")
def _(spark, sf):
    return _rounded(E.model_summary(_scores(spark, sf)), "val_ce", "val_ppl", "test_ce", "test_ppl")


@query("e7_compare")
def _(spark, sf):
    by_dataset = E.ce_by_dataset(_test_scores(spark, sf), ["model"])
    base, tuned = (by_dataset.where(F.col("model") == m) for m in ("uniform", "unigram"))
    return _rounded(E.compare_runs(base, tuned), "base_ce", "tuned_ce", "difference")


# --- logs and runs ----------------------------------------------------------------------------------------
@query("l1_curves")
def _(spark, sf):
    return L.log_curves(I.log_rows(spark, sf))


@query("l1_curves_null")
def _(spark, sf):
    return L.log_curves(I.log_rows(spark, sf).withColumn("run", F.expr("nullif(run, 1)")))


@query("l2_metric")
def _(spark, sf):
    return L.log_metric(I.log_rows(spark, sf), "eval_loss")


@query("l3_epochs")
def _(spark, sf):
    return L.epoch_marks(I.log_rows(spark, sf))


@query("l4_last")
def _(spark, sf):
    return L.last_logged(I.log_rows(spark, sf), 10)


@query("l4_last_large")
def _(spark, sf):
    return L.last_logged(I.log_rows(spark, sf), 20_000)


@query("l5_overlay")
def _(spark, sf):
    log = I.log_rows(spark, sf)
    return L.overlay({m: L.log_metric(log, m) for m in ("loss", "eval_loss", "learning_rate")})


@query("l6_grid")
def _(spark, sf):
    sizes = A.language_counts(I.code_rows(spark, sf))
    return L.with_grid(sizes, epochs=[1, 2, 3], learning_rate=[5e-5, 1e-4, 2e-4, 3e-4], batch_size=[2])


@query("l7_sweep")
def _(spark, sf):
    train, evaluated = _eval_tables(spark, sf)
    return _rounded(L.sweep(train, evaluated, _ids(spark, sf), SWEEP), "avg_ce", "perplexity")


def _run_metrics(spark: SparkSession, sf: str) -> DataFrame:
    """One row per run of the log; a run is tested if its error rows do not outnumber its sign-up rows."""
    log = I.log_rows(spark, sf)
    means = log.groupBy("run").agg(
        F.avg("loss").alias("val_ce"),
        F.avg("eval_loss").alias("mean_eval"),
        F.count("loss").alias("points"),
        F.count("eval_loss").alias("evals"),
    )
    tested = F.col("evals") >= F.col("points") * 2
    return means.select(
        F.concat(F.lit("run"), F.col("run").cast("string")).alias("key"),
        F.when(tested, F.lit("ok")).otherwise(F.lit("failed")).alias("status"),
        F.round("val_ce", 6).alias("val_ce"),
        F.when(tested, F.round("mean_eval", 6)).alias("test_ce"),
    )


@query("l8_ok")
def _(spark, sf):
    return L.ok_runs(_run_metrics(spark, sf))


@query("l9_best")
def _(spark, sf):
    return L.best(_run_metrics(spark, sf), "val_ce", ["status"])


@query("l10_ranked")
def _(spark, sf):
    return L.ranked(_run_metrics(spark, sf), "test_ce")


@query("l11_top_sort")
def _(spark, sf):
    counts = I.table(spark, sf, "documents").groupBy(F.col("source").alias("language")).agg(
        F.count(F.lit(1)).alias("count"), F.round(F.avg("n_chars"), 6).alias("perplexity")
    )
    return L.top_then_sort(counts, 15)


@query("l12_winner")
def _(spark, sf):
    return L.select_winner(_run_metrics(spark, sf))


@query("l13_rows")
def _(spark, sf):
    log = I.log_rows(spark, sf)
    means = log.groupBy(F.col("run").alias("key")).agg(F.avg("loss").alias("loss"), F.avg("eval_loss").alias("eval_loss"))
    long = means.unpivot("key", ["loss", "eval_loss"], "metric", "value")
    return _rounded(L.metrics_to_rows(long, ["loss", "eval_loss"]), "loss", "eval_loss")


# --- sources and sinks ------------------------------------------------------------------------------------
@query("s1_splits")
def _(spark, sf):
    names = dict(zip(SPLITS, ("documents", "benchmark", "conversations")))
    corpus = S.read_splits(spark, {s: f"{sf}/{t}.parquet" for s, t in names.items()})
    return corpus.groupBy("split").agg(F.count(F.lit(1)).alias("count"), F.sum(F.length("text")).alias("chars"))


@query("s1_order")
def _(spark, sf):
    names = dict(zip(SPLITS, ("documents", "benchmark", "conversations")))
    corpus = S.read_splits(spark, {s: f"{sf}/{t}.parquet" for s, t in names.items()}, order="ord")
    return corpus.select("ord", "split", "doc_id", "item_id", "conv_id", "turn")


@query("s2_tagged")
def _(spark, sf):
    tables = S.read_tagged(spark, {t: f"{sf}/{t}.parquet" for t in ("documents", "benchmark")}, "origin")
    return tables.select("origin", "doc_id", "item_id", "text")


@query("s2_file_order")
def _(spark, sf):
    return S.with_order(I.table(spark, sf, "documents")).select("ord", "doc_id")


@query("s2_order")
def _(spark, sf):
    tables = S.read_tagged(spark, {t: f"{sf}/{t}.parquet" for t in ("documents", "benchmark")}, "origin", order="ord")
    return tables.select("ord", "origin", "doc_id", "item_id")


def _saved(spark: SparkSession, sf: str) -> str:
    path = scratch_folder(spark)
    S.write_by_language(I.code_split(spark, sf), path)
    return path


@query("s3_write")
def _(spark, sf):
    path = scratch_folder(spark)
    S.write_corpus(I.code_split(spark, sf), path)
    return S.read_corpus(spark, path).select("ord", "language", "split", "code")


@query("s4_write_by_language")
def _(spark, sf):
    return S.read_corpus(spark, _saved(spark, sf)).select("lang_dir", "split", "ord", "docstring")


@query("s5_read_language")
def _(spark, sf):
    return S.read_corpus(spark, _saved(spark, sf), "FR").select("ord", "split", "code")


@query("s5_read_shared_folder")
def _(spark, sf):
    path = scratch_folder(spark)
    name = F.expr("case language when 'en' then 'F#' when 'fr' then 'F*' else language end")
    S.write_by_language(I.code_split(spark, sf).withColumn("language", name), path)
    return S.read_corpus(spark, path, "f#").select("ord", "split", "code")


@query("s6_partitions")
def _(spark, sf):
    return S.list_partitions(spark, _saved(spark, sf))


@query("s6_missing")
def _(spark, sf):
    return S.missing_partitions(spark, _saved(spark, sf), [("fr", "train"), ("fr", "holdout"), ("python", "train")])


@query("s7_verify")
def _(spark, sf):
    path = scratch_folder(spark)
    return S.verify_counts(spark, path, S.write_counted(I.code_split(spark, sf), path))


@query("s8_inline")
def _(spark, sf):
    titles = S.inline_table(spark, [("en", "English"), ("fr", "French"), ("de", "German")], "language string, title string")
    return A.language_counts(I.code_rows(spark, sf)).join(F.broadcast(titles), "language", "left")


@query("s9_missing_empty")
def _(spark, sf):
    return S.split_or_empty(I.code_split(spark, sf), "holdout").select("ord", "split")


@query("s9_missing_nth")
def _(spark, sf):
    rows = I.code_split(spark, sf).where("split <> 'validation'")
    return S.split_or_nth(rows, "validation", 1).select("ord", "split")


@query("s10_preview")
def _(spark, sf):
    return S.preview(I.code_rows(spark, sf), 5, 100)
