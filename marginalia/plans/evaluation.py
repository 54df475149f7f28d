"""Evaluation: chat text to token tables to cross-entropy and perplexity."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import EVAL_BATCH_SIZE, MAX_TOKENS
from ..functions.chat import prompt_of
from ..operators.metrics import fit_unigram, score_rows, uniform_row_loss
from ..operators.tokens import (
    TokenSource,
    VocabularySource,
    assign_batches,
    build_vocab,
    mask_prompt,
    masked_labels,
    pad_to,
    tokenize,
    vocabulary_source,
    with_attention,
)

EVAL_KEYS = ("dataset", "language", "split", "row_id")


def token_table(
    chat: DataFrame,
    source: TokenSource | VocabularySource,
    keys: Sequence[str] = EVAL_KEYS,
    max_len: int = MAX_TOKENS,
    no_tag: str = "error",
    beside: DataFrame | None = None,
    on: str = "ord",
) -> DataFrame:
    """Chat rows as ``input_ids, attention_mask, labels``; the text is dropped. ``keys`` name a row.

    Some of the keys can come from ``beside``, which the rows meet by ``on``. With a vocabulary table the text does not move: the
    prompt is counted and the text becomes ids where it is, and the ids move once.
    """
    if isinstance(source, VocabularySource):
        sized = chat.withColumn("_cut", source.count(prompt_of("text")))
        ids = with_attention(source.ids(sized, max_len, keys, ["_cut"], beside=beside, on=on))
        labels = masked_labels(F.col("_cut"), F.col("_cut").isNotNull(), no_tag)
        tokens = ids.withColumn("labels", labels)
    else:
        met = chat if beside is None else chat.join(beside.hint("shuffle_merge"), on)
        tokens = mask_prompt(tokenize(met, source, max_len, keys), source, no_tag)
    return tokens.select(*keys, "input_ids", "attention_mask", "labels")


def train_source(chat: DataFrame) -> VocabularySource:
    """Token source with the vocabulary of the train split."""
    return vocabulary_source(build_vocab(chat.where(F.col("split") == "train")))


def padded_batches(
    chat: DataFrame,
    source: TokenSource | VocabularySource,
    by: Sequence[str] = ("split",),
    size: int = EVAL_BATCH_SIZE,
    order: str = "ord",
    max_len: int = MAX_TOKENS,
    no_tag: str = "error",
) -> DataFrame:
    """Chat rows as padded batches: ``by, order, batch_id`` and the three arrays.

    Batch numbers and lengths are worked out on narrow rows (keys and token counts). The ids move once, to meet them; the other
    arrays and the padding are made there.
    """
    length = F.least(source.count(F.col("text")), F.lit(max_len)).alias("longest")
    batched = assign_batches(chat.select(*by, order, length), size, order, by)
    in_batch = W.partitionBy(*by, "batch_id")
    placed = batched.select(order, "batch_id", F.max("longest").over(in_batch).alias("longest"))
    return pad_to(token_table(chat, source, [*by, order, "batch_id", "longest"], max_len, no_tag, placed, order))


def row_losses(
    train: DataFrame, evaluated: DataFrame, vocab_size: int, alpha: float = 1.0, keys: Sequence[str] = EVAL_KEYS
) -> DataFrame:
    """Row losses of the unigram model and of the uniform one."""
    scored = score_rows(evaluated, fit_unigram(train, vocab_size), (alpha,), keys)
    models = F.array(
        F.struct(F.lit("unigram").alias("model"), F.get("losses", F.lit(0)).alias("row_loss")),
        F.struct(F.lit("uniform").alias("model"), uniform_row_loss(vocab_size, F.col("tokens")).alias("row_loss")),
    )
    return scored.select(*keys, "tokens", F.explode(models).alias("_m")).select(*keys, "tokens", "_m.model", "_m.row_loss")
