"""The registered queries of the operators and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import configure
from . import op1_secrets, op2_language, op3_licenses, op4_decontaminate, op5_near_dedup, op6_sharding, op7_lattice, op8_neighbours, op9_packing, op10_quality, op11_alignment, op12_substrings, op13_whitening
from .shared import remainder

SHARDS = 40


def vocabulary_file(name: str) -> str:
    """Where a public tokenizer's file lies (installed on every node)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return configure(spark).read.parquet(f"{sf}/{name}.parquet")


def held_out(divisor: int, left: int) -> Column:
    return (remainder("doc_id", divisor) == left).alias("held_out")


def op1_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text")
    return op1_secrets.with_secrets(docs, op1_secrets.fit(docs)).drop("text")


def op2_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "text", "lang")
    model = op2_language.fit(op2_language.learnable(docs))
    return op2_language.with_language(docs.select("doc_id", "text"), model).select("doc_id", held_out(4, 2), "lang_pred", "score")


def op3_license_scan(spark: SparkSession, sf: str) -> DataFrame:
    return op3_licenses.find_licenses(table(spark, sf, "documents"))


def op4_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return op4_decontaminate.find_leaks(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op5_near_duplicates(spark: SparkSession, sf: str) -> DataFrame:
    return op5_near_dedup.near_duplicates(table(spark, sf, "documents"))


def op6_shards(spark: SparkSession, sf: str) -> DataFrame:
    return op6_sharding.assign_shards(table(spark, sf, "documents"), SHARDS)


def op7_lm_score(spark: SparkSession, sf: str) -> DataFrame:
    return op7_lattice.score_texts(table(spark, sf, "documents"), op7_lattice.learnable(), vocabulary_file("piece_bpe_32k.model"))


def op8_nearest(spark: SparkSession, sf: str) -> DataFrame:
    return op8_neighbours.nearest(table(spark, sf, "embeddings"))


def op9_packed(spark: SparkSession, sf: str) -> DataFrame:
    return op9_packing.pack(table(spark, sf, "documents"), vocabulary_file("word_bpe_49k.json"))


def op10_quality_score(spark: SparkSession, sf: str) -> DataFrame:
    docs, labels = table(spark, sf, "documents").select("doc_id", "text"), table(spark, sf, "labels")
    model = op10_quality.fit(op10_quality.learnable(docs), op10_quality.learnable(labels))
    return op10_quality.with_quality(docs, model).select("doc_id", held_out(5, 0), "score", "predicted")


def op11_alignment_counts(spark: SparkSession, sf: str) -> DataFrame:
    files = [vocabulary_file(name) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model")]
    return op11_alignment.align_tokenizers(table(spark, sf, "documents"), *files)


def op12_kept_words(spark: SparkSession, sf: str) -> DataFrame:
    return op12_substrings.remove_repeats(table(spark, sf, "documents"))


def op13_whitened(spark: SparkSession, sf: str) -> DataFrame:
    return op13_whitening.whiten(table(spark, sf, "embeddings"))


def llm_queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    made = (
        op1_secret_scan,
        op2_language_id,
        op3_license_scan,
        op4_decontamination,
        op5_near_duplicates,
        op6_shards,
        op7_lm_score,
        op8_nearest,
        op9_packed,
        op10_quality_score,
        op11_alignment_counts,
        op12_kept_words,
        op13_whitened,
    )
    return {f.__name__: f for f in made}


# Every window of 20 words, numbered among its equals by place; words that a later one covers are gone.
OP12_SQL = r"""with split as (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as words from documents),
  places as (select doc_id, words, unnest(words) as word, generate_subscripts(words, 1) as i from split),
  windows as (select doc_id, i, row_number() over (partition by array_to_string(words[i:i + 19], ' ') order by doc_id, i) as nth
    from places where i + 19 <= len(words)),
  gone as (select distinct doc_id, i + k as i from windows cross join (select unnest(range(20)) as k) where nth > 1),
  kept as (select p.doc_id, count(*) as n, string_agg(word, ' ' order by p.i) as rest from places p anti join gone g on p.doc_id = g.doc_id and p.i = g.i
    group by p.doc_id)
select s.doc_id, cast(len(words) as bigint) as n_words, cast(len(words) - coalesce(n, 0) as bigint) as n_removed, sha256(coalesce(rest, '')) as kept_sha256
from split s left join kept using (doc_id)"""


def llm_oracle() -> dict[str, str]:
    """Windows of words can be compared in SQL; hashes, trained models, tokenizers and searches are tested against brute force."""
    return {"op12_kept_words": OP12_SQL}
