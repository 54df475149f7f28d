"""Token tables: vocabulary, ids, masked labels, batches and padding."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..constants import BROADCAST_ROW_BOUND, EVAL_BATCH_SIZE, IGNORE_LABEL, MAX_TOKENS
from ..functions.chat import has_tag, prompt_end, prompt_of
from ..functions.text import Name, col
from .ordering import exact_quantiles, kept, with_position, with_rank

# Tags, the newline, words, and any other visible character by itself. A newline is always a token of its own, so the
# tokens of a prompt (which ends with one) are a prefix of the tokens of the full text.
TOKEN_PATTERN = r"<\|im_start\|>|<\|im_end\|>|\n|[\p{L}\p{N}_]+|[^ \t\r\f\x0b\n\p{L}\p{N}_]"
PAD_ID, UNKNOWN_ID = 0, 1
RESERVED = (("<pad>", PAD_ID), ("<unk>", UNKNOWN_ID))


# What the pattern above skips. With it in front, the matches of a text lie end to end, so their lengths add up to places.
SKIPPED = r"[ \t\r\f\x0b]*"
# White space belongs to the word after it, as in byte-level subword vocabularies: such a token can begin before the end of a
# prompt and end after it.
LEADING_SPACE_PATTERN = r"\s*[^\s]+"


def token_list(text: Name, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_extract_all(col(text), F.lit(pattern), F.lit(0))


def token_count(text: Name, pattern: str = TOKEN_PATTERN) -> Column:
    return F.regexp_count(col(text), F.lit(pattern))


@dataclass(frozen=True)
class TokenSource:
    """How text becomes ids: ``ids(text, max_len)`` gives at most ``max_len`` ids, ``count(text)`` their full number.

    For a caller with a tokenizer of their own (column functions or Pandas UDFs). ``VocabularySource`` is the default.
    ``ends(text, max_len)``, if the tokenizer can tell, gives the code point after each token.
    """

    ids: Callable[[Column, int], Column]
    count: Callable[[Column], Column] = token_count
    ends: Callable[[Column, int], Column] | None = None


# The two Arrow functions below are marked as not deterministic, though they are: so the engine neither moves them into a lambda
# of a later step, where they cannot run, nor runs them once for each use.
# Tokens that the head of a vocabulary does not have are numbered in their text from here on, until the rest has been asked.
FIRST_SPARE, LAST_SPARE = -(1 << 31), -(1 << 30)


@dataclass(frozen=True)
class VocabularySource:
    """Ids from a vocabulary table of any size (``token, id``); tokens it does not have get the unknown id.

    Ids follow the count, so the tokens with an id below the broadcast bound are the frequent ones, and they are no more rows
    than that. Every task has them and looks up the tokens of its texts, so a text stays one row. Only if the vocabulary has
    more, the tokens that were not found, rare ones all of them, meet the rest in a shuffled join.
    """

    vocab: DataFrame
    pattern: str = TOKEN_PATTERN
    skipped: str = SKIPPED
    bound: int = BROADCAST_ROW_BOUND

    def count(self, text: Name) -> Column:
        return token_count(text, self.pattern)

    def ids(
        self,
        df: DataFrame,
        max_len: int,
        keys: Sequence[str],
        carried: Sequence[str] = (),
        ends: bool = False,
        beside: DataFrame | None = None,
        on: str = "ord",
    ) -> DataFrame:
        """``keys``, ``carried`` (narrow columns that follow from the keys), ``input_ids`` and, on request, ``token_ends``.

        ``keys`` name a row; texts that share them become one row, place by place. Texts are cut to ``max_len`` tokens and become
        arrays where they are, and the arrays move once, to their keys. Some of the keys can come from ``beside``, which the
        arrays meet by ``on``. ``token_ends`` are places after the tokens, in code points.
        """
        names = [*keys, *carried]
        tail = self.vocab.where(F.col("id") >= self.bound).select("token", "id")
        tail = None if tail.isEmpty() else tail
        coded = self._coded(df, max_len, [c for c in names if beside is None or c == on or c not in beside.columns], ends, tail is not None)
        if tail is not None:
            coded = kept(coded)  # two steps read it; without it every text is cut twice
        if beside is not None:
            coded = coded.join(beside.hint("shuffle_merge"), on)
        listed = F.struct("_ids", "_lengths").alias("_list")
        if tail is None:
            lists = coded if beside is not None else coded.repartition(*[F.col(k) for k in keys])
            lists = lists.groupBy(*names, "_some").agg(F.collect_list(listed).alias("_lists"))
        else:
            found = coded.select(*names, "_some", listed).unionByName(self._rest(coded, names, tail), allowMissingColumns=True)
            lists = found.groupBy(*names, "_some").agg(F.collect_list("_list").alias("_lists"), F.sort_array(F.collect_list("_entry")).alias("_rest"))

        def final(one: Column) -> Column:
            """Spare numbers are places in the rest of the text's tokens, which is in the order of the text."""
            if tail is None:
                return one["_ids"]
            place = lambda x: (x.cast("bigint") - F.lit(FIRST_SPARE)).cast("int")
            return F.transform(one["_ids"], lambda x: F.when(x < LAST_SPARE, F.get("_rest", place(x))["id"]).otherwise(x))

        def entries(one: Column) -> Column:
            made = F.transform(one["_ids"], lambda x, i: F.struct(i.alias("pos"), F.get(one["_lengths"], i).alias("length"), x.alias("id")))
            return made if tail is None else F.filter(made, lambda e: e["id"] >= LAST_SPARE)

        several = F.flatten(F.transform("_lists", entries))
        several = F.sort_array(several if tail is None else F.concat(several, "_rest"))
        first, alone = F.get("_lists", F.lit(0)), F.size("_lists") == 1

        def arrays(one: Column, field: str) -> Column:
            return F.when(F.col("_some"), F.when(alone, one).otherwise(F.transform(several, lambda e: e[field])))

        made = lists.select(*names, arrays(final(first), "id").alias("input_ids"), arrays(first["_lengths"], "length").alias("_lengths"))
        if not ends:
            return made.drop("_lengths")
        # the lengths are named twice, or their lambdas would become part of the function's argument, where they cannot run
        return made.withColumn("token_ends", F.when(F.col("_lengths").isNotNull(), _running_total()("_lengths"))).drop("_lengths")

    def _coded(self, df: DataFrame, max_len: int, names: Sequence[str], ends: bool, rare: bool) -> DataFrame:
        """``names, _some`` (is there a text), ``_ids, _missing, _lengths`` row by row; with ``rare``, missing tokens have spare numbers."""
        piece = F.regexp_extract_all("text", F.lit(f"{self.skipped}({self.pattern})"), F.lit(0)) if ends else token_list("text", self.pattern)
        token = F.regexp_extract_all("text", F.lit(f"{self.skipped}({self.pattern})"), F.lit(1)) if ends and self.skipped else piece
        cut = [F.slice(c, 1, max_len).alias(name) for c, name in ((piece, "_pieces"), (token, "_tokens"))]
        coded = df.select(*names, F.col("text").isNotNull().alias("_some"), *cut).withColumn("_found", self._look_up(rare)("_tokens", "_pieces"))
        lengths = F.col("_found.lengths") if ends else F.lit(None).cast("array<int>")
        return coded.select(*names, "_some", F.col("_found.ids").alias("_ids"), F.col("_found.missing").alias("_missing"), lengths.alias("_lengths"))

    def _look_up(self, rare: bool) -> Callable[[Column], Column]:
        """For arrays of tokens, and of tokens with what was skipped: ids by the head, tokens that it does not have, lengths."""
        # the corpus can have a token with a reserved name; its own id is the larger one
        head = self.vocab.where((F.col("id") < self.bound) & F.col("token").isNotNull()).select("token", "id")
        table = head.toArrow().sort_by([("id", "descending")]).combine_chunks()
        held = self.vocab.sparkSession.sparkContext.broadcast(table)
        first_spare, unknown = FIRST_SPARE, UNKNOWN_ID

        @F.arrow_udf("ids array<int>, missing array<string>, lengths array<int>")
        def look_up(lists, pieces):
            import numpy as np
            import pyarrow as pa
            import pyarrow.compute as pc

            tokens, ids = (pa.concat_arrays(c.chunks) if c.num_chunks else pa.array([], c.type) for c in held.value.columns)
            flat = lists.flatten()
            known = ids.cast(pa.int32()).take(pc.index_in(flat, value_set=tokens.cast(flat.type)))
            absent = known.is_null().to_numpy(zero_copy_only=False)
            starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int32)
            before = np.concatenate([[0], np.cumsum(absent)])
            number = before[:-1] - np.repeat(before[starts[:-1]], np.diff(starts)) + first_spare if rare else unknown
            values = pa.array(np.where(absent, number, pc.fill_null(known, 0).to_numpy()).astype(np.int32))
            missing = flat.filter(pa.array(absent & rare))
            none, places = lists.is_null(), before[starts].astype(np.int32) if rare else np.zeros(len(starts), np.int32)
            made = ((starts, values), (places, missing), (starts, pc.utf8_length(pieces.flatten())))
            return pa.StructArray.from_arrays([pa.ListArray.from_arrays(pa.array(at), x, mask=none) for at, x in made], ["ids", "missing", "lengths"])

        return look_up.asNondeterministic()

    def _rest(self, coded: DataFrame, names: Sequence[str], tail: DataFrame) -> DataFrame:
        """``names, _some`` and a struct ``_entry`` of place, length and id for every token that the head does not have."""
        places = F.transform("_ids", lambda x, i: F.when(x < LAST_SPARE, i))
        spared = coded.where(F.size("_missing") > 0).withColumn("_places", F.array_compact(places))
        tokens = F.transform("_missing", lambda t, i: F.struct(t.alias("token"), F.get("_places", i).alias("pos")))
        tokens = F.transform(tokens, lambda x: F.struct(x["token"].alias("token"), x["pos"].alias("pos"), F.get("_lengths", x["pos"]).alias("length")))
        met = spared.select(*names, "_some", F.explode(tokens).alias("_m")).select(*names, "_some", "_m.*").join(tail, "token", "left")
        return met.select(*names, "_some", F.struct("pos", "length", F.coalesce("id", F.lit(UNKNOWN_ID)).alias("id")).alias("_entry"))


def _running_total() -> Callable[[Column], Column]:
    """The running sums of arrays of whole numbers."""

    @F.arrow_udf("array<int>")
    def running_total(lists):
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        starts = np.concatenate([[0], np.cumsum(pc.fill_null(pc.list_value_length(lists), 0).to_numpy())]).astype(np.int32)
        upto = np.concatenate([[0], np.cumsum(lists.flatten().to_numpy(zero_copy_only=False), dtype=np.int64)])
        sums = upto[1:] - np.repeat(upto[starts[:-1]], np.diff(starts))
        return pa.ListArray.from_arrays(pa.array(starts), pa.array(sums.astype(np.int32)), mask=lists.is_null())

    return running_total.asNondeterministic()


def build_vocab(df: DataFrame, text: str = "text", pattern: str = TOKEN_PATTERN) -> DataFrame:
    """``token, id, count`` for every distinct token; ids follow count (descending), then token.

    Tokens are counted map-side first; ids come from a distributed rank. Nothing is cut off.
    """
    counts = df.select(F.explode(token_list(text, pattern)).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("count"))
    ranked = with_rank(counts, [F.desc("count"), F.asc("token")], "id")
    made = ranked.select("token", (F.col("id") + F.lit(len(RESERVED) - 1)).cast("int").alias("id"), "count")
    reserved = df.sparkSession.createDataFrame([(t, i, 0) for t, i in RESERVED], "token string, id int, count bigint")
    return made.unionByName(reserved)


def vocabulary_source(vocab: DataFrame) -> VocabularySource:
    return VocabularySource(vocab)


def tokenize(
    df: DataFrame, source: TokenSource | VocabularySource, max_len: int = MAX_TOKENS, keys: Sequence[str] = ("ord",)
) -> DataFrame:
    """Add ``input_ids``, cut to ``max_len``, and ``attention_mask``. ``keys`` name a row (for a vocabulary table).

    With a vocabulary table the other columns meet the arrays again in a join by the keys; who needs only narrow ones, takes
    them along with ``VocabularySource.ids``.
    """
    if isinstance(source, VocabularySource):
        # one struct as the key: null keys are equal inside of it, and the join finds the arrays dealt by it
        named = df.withColumn("_row", F.struct(*keys))
        ids = named.join(source.ids(named, max_len, ["_row"]), "_row").drop("_row")
    else:
        ids = df.withColumn("input_ids", source.ids(F.col("text"), max_len))
    return with_attention(ids)


def with_attention(df: DataFrame) -> DataFrame:
    return df.withColumn("attention_mask", F.array_repeat(F.lit(1), F.size("input_ids")))


def masked_labels(cut: Column, tagged: Column, no_tag: str) -> Column:
    """The ids with the first ``cut`` set to -100; where there is no tag, an error or all of them."""
    if no_tag not in ("error", "mask_all"):
        raise ValueError(f"no_tag must be 'error' or 'mask_all', not {no_tag!r}")
    size = F.size("input_ids")
    cut = F.least(cut, size)
    masked = F.concat(F.array_repeat(F.lit(IGNORE_LABEL), cut), F.slice("input_ids", cut + 1, size))
    untagged = (
        F.array_repeat(F.lit(IGNORE_LABEL), size)
        if no_tag == "mask_all"
        else F.raise_error(F.lit("assistant tag not found")).cast("array<int>")
    )
    return F.when(tagged, masked).otherwise(untagged)


def mask_prompt(df: DataFrame, source: TokenSource | VocabularySource | None = None, no_tag: str = "error") -> DataFrame:
    """Add ``labels``: the ids with everything up to and including the assistant tag set to -100.

    The prompt is tokenised by itself, and as many ids are masked as it has tokens. Text without a tag is an error, or is
    masked as a whole with ``no_tag="mask_all"``.
    """
    count = source.count if source else token_count
    return df.withColumn("labels", masked_labels(count(prompt_of("text")), has_tag("text"), no_tag))


def mask_by_offsets(df: DataFrame, no_tag: str = "error") -> DataFrame:
    """Add ``labels`` by the tokens' places (``token_ends``): -100 for every token that ends with the tag or before it.

    This holds for any tokenizer. A token that begins in the tag and ends after it carries the first of the answer and
    keeps its label. ``df`` has ``prompt_end``, the place after the tag, or null without a tag.
    """
    ends = F.size(F.filter("token_ends", lambda end: end <= F.col("prompt_end")))
    return df.withColumn("labels", masked_labels(ends, F.col("prompt_end").isNotNull(), no_tag))


def tokens_with_ends(
    df: DataFrame, source: TokenSource | VocabularySource, max_len: int = MAX_TOKENS, keys: Sequence[str] = ("ord",)
) -> DataFrame:
    """``keys, prompt_end, input_ids, token_ends``: what ``mask_by_offsets`` needs."""
    placed = df.withColumn("prompt_end", prompt_end("text"))
    if isinstance(source, VocabularySource):
        return source.ids(placed, max_len, keys, ["prompt_end"], ends=True)
    if source.ends is None:
        raise ValueError("the token source does not tell where its tokens end")
    text = F.col("text")
    return placed.select(*keys, "prompt_end", source.ids(text, max_len).alias("input_ids"), source.ends(text, max_len).alias("token_ends"))


def arrays_only(df: DataFrame, keys: Sequence[str] = ("ord",)) -> DataFrame:
    return df.select(*keys, "input_ids", "attention_mask", "labels")


def assign_batches(df: DataFrame, size: int = EVAL_BATCH_SIZE, order: str = "ord", by: Sequence[str] = ()) -> DataFrame:
    """Number the rows of each group in order and cut them into batches of ``size``."""
    return with_position(df, order, by, "_pos").withColumn("batch_id", F.expr(f"(_pos - 1) div {size}")).drop("_pos")


def pad_batches(df: DataFrame, pad_id: int = PAD_ID, by: Sequence[str] = ()) -> DataFrame:
    """Right-pad the arrays of each batch to its longest row: ids with ``pad_id``, attention 0, labels -100."""
    longest = F.max(F.size("input_ids")).over(W.partitionBy(*by, "batch_id"))
    return pad_to(df.withColumn("longest", longest), pad_id)


def pad_to(df: DataFrame, pad_id: int = PAD_ID) -> DataFrame:
    """Right-pad the arrays of each row to the length in its column ``longest``, which is dropped."""
    values = {"input_ids": pad_id, "attention_mask": 0, "labels": IGNORE_LABEL}
    return (
        df.withColumn("_fill", F.col("longest") - F.size("input_ids"))
        .withColumns({c: F.concat(c, F.array_repeat(F.lit(v), F.col("_fill"))) for c, v in values.items()})
        .drop("longest", "_fill")
    )


def token_profile(df: DataFrame, by: Sequence[str] = ("split",), max_len: int = MAX_TOKENS, source: TokenSource | VocabularySource | None = None) -> DataFrame:
    """Lengths of chat rows in tokens, the share cut at ``max_len`` and the share left without any label."""
    count = source.count if source else token_count
    sized = df.select(*by, count(F.col("text")).alias("tokens"), F.coalesce(count(prompt_of("text")), F.lit(0)).alias("prompt"))
    no_label = F.least("prompt", F.lit(max_len)) >= F.least("tokens", F.lit(max_len))
    return sized.groupBy(*by).agg(
        F.count(F.lit(1)).alias("rows"),
        F.avg("tokens").alias("avg_tokens"),
        F.max("tokens").alias("max_tokens"),
        F.avg("prompt").alias("avg_prompt_tokens"),
        F.avg(F.col("tokens") - F.col("prompt")).alias("avg_target_tokens"),
        F.avg((F.col("tokens") > max_len).cast("int")).alias("share_truncated"),
        F.avg(no_label.cast("int")).alias("share_without_label"),
    )


LENGTHS = ("tokens", "prompt", "target")
PERMILLES = (500, 900, 990, 999)


def token_percentiles(
    df: DataFrame,
    by: Sequence[str] = ("split",),
    permilles: Sequence[int] = PERMILLES,
    source: TokenSource | VocabularySource | None = None,
) -> DataFrame:
    """``by, measure, rows, p50, p90, ...``: exact percentiles of the tokens of chat rows, of their prompts and of their targets.

    They tell how much a cut loses. A text without a tag has no prompt and is all target, as in ``token_profile``.
    """
    count = source.count if source else token_count
    sized = df.select(*by, count(F.col("text")).alias("tokens"), F.coalesce(count(prompt_of("text")), F.lit(0)).alias("prompt"))
    values = {"tokens": F.col("tokens"), "prompt": F.col("prompt"), "target": F.col("tokens") - F.col("prompt")}
    return exact_quantiles(sized, values, by, permilles)
