"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import decontaminate, exact_dedup, language, line_dedup, lm_score, sentencepiece, simhash, token_counts, token_ids, toxicity
from .common import documents, id_crc


def op1_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentencepiece.digests(documents(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"))


def op2_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir))


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_score.lm_score(documents(spark, sf_dir), held_out=id_crc() % 7 == 2)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return toxicity.toxicity(documents(spark, sf_dir), labels, held_out=lambda c: id_crc(c) % 3 == 1)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.language_id(documents(spark, sf_dir), held_out=id_crc() % 4 == 2)


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return line_dedup.line_dedup(docs).select("doc_id", "n_lines", "n_deleted", "text")


def op7_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids.token_ids(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.simhash_components(documents(spark, sf_dir))


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    return token_counts.token_counts(documents(spark, sf_dir), token_counts.revision_edits(), path, pattern)


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).drop("items", "near", "hit_from", "hit_to")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_sentencepiece": op1_sentencepiece,
    "op2_exact_dedup": op2_exact_dedup,
    "op3_lm_score": op3_lm_score,
    "op4_toxicity": op4_toxicity,
    "op5_language_id": op5_language_id,
    "op6_line_dedup": op6_line_dedup,
    "op7_token_ids": op7_token_ids,
    "op8_simhash": op8_simhash,
    "op9_token_counts": op9_token_counts,
    "op10_decontamination": op10_decontamination,
}

ORACLE: dict[str, str] = {
    "op2_exact_dedup": r"""
        with t as (select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as norm from documents)
        select doc_id,
               min(doc_id) over (partition by norm) as keep_id,
               count(*) over (partition by norm) as group_size,
               doc_id = min(doc_id) over (partition by norm) as kept,
               sha256(norm) as text_sha256
        from t
    """,
    "op6_line_dedup": r"""
        with lines as (
            select doc_id, n, split[n] as line, trim(regexp_replace(split[n], '[\x20\x09-\x0D]+', ' ', 'g'), ' ') as norm
            from (select doc_id, split, unnest(generate_series(1, len(split))) as n
                  from (select doc_id, string_split(coalesce(text, ''), chr(10)) as split from documents))
        ), counted as (
            select *, case when norm = '' then 0 else len(string_split(norm, ' ')) end as words from lines
        ), summed as (
            select *, sum(words) over (partition by doc_id order by n) as upto from counted
        ), spans as (
            select a.doc_id, a.n, min(b.n) as last
            from summed a join summed b on a.doc_id = b.doc_id and b.n >= a.n and b.upto - a.upto + a.words >= 10
            group by a.doc_id, a.n
        ), backs as (
            select a.doc_id, max(b.n) as n, a.n as last
            from summed a join summed b on a.doc_id = b.doc_id and b.n <= a.n and a.upto - b.upto + b.words >= 10
            group by a.doc_id, a.n
        ), runs as (
            select s.doc_id, s.n, s.last, string_agg(l.norm, chr(10) order by l.n) as run
            from (select * from spans union select * from backs) s join lines l on l.doc_id = s.doc_id and l.n between s.n and s.last
            group by s.doc_id, s.n, s.last
        ), copies as (
            select doc_id, n, last from (select *, row_number() over (partition by run order by doc_id, n) as copy from runs) where copy > 1
        ), gone as (
            select distinct l.doc_id, l.n from lines l join copies c on l.doc_id = c.doc_id and l.n between c.n and c.last
        )
        select l.doc_id, count(*) as n_lines, count(g.n) as n_deleted,
               coalesce(string_agg(line, chr(10) order by l.n) filter (where g.n is null), '') as text
        from lines l left join gone g on l.doc_id = g.doc_id and l.n = g.n
        group by l.doc_id
    """,
    "op10_decontamination": r"""
        with words as (
            select 'd' as kind, doc_id as id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents
            union all
            select 'b', item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') from benchmark where item_id is not null
        ), windows as (
            select distinct id as item_id, least(len(w), 10) as n, array_to_string(w[k : k + least(len(w), 10) - 1], ' ') as phrase
            from (select id, w, unnest(generate_series(1, greatest(1, len(w) - 9))) as k from words where kind = 'b' and len(w) > 0)
        ), lengths as (
            select distinct n from windows
        ), places as (
            select id as doc_id, n, k, array_to_string(w[k : k + n - 1], ' ') as phrase
            from (select id, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from words, lengths where kind = 'd' and len(w) >= n)
        ), matches as (
            select doc_id, p.n, k, item_id from places p join windows w on p.n = w.n and p.phrase = w.phrase
        ), hits as (
            select doc_id, count(distinct spot) as n_hit
            from (select doc_id, unnest(generate_series(k, k + n - 1)) as spot from (select distinct doc_id, n, k from matches))
            group by doc_id
        ), found as (
            select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items
            from (select distinct doc_id, cast(item_id as varchar) as item from matches) group by doc_id
        ), shapes as (
            select item_id, n, split_part(phrase, ' ', 1) as first, split_part(phrase, ' ', -1) as last, '^' || replace(phrase, ' ', ' ([^ ]+ )*') || '( |$)' as pattern from windows
        ), starts as (
            select id as doc_id, n, k, unnest(list_distinct(w[k + n - 1 : k + n + 1])) as last, w[k] as first
            from (select id, w, n, unnest(generate_series(1, len(w) - n + 1)) as k from words, lengths where kind = 'd' and len(w) >= n)
        ), maybe as (
            select distinct doc_id, s.n, k, item_id, pattern from starts s join shapes p on s.n = p.n and s.first = p.first and s.last = p.last
        ), near as (
            select doc_id, count(distinct item_id) as n_near
            from maybe join words on id = doc_id and kind = 'd' where regexp_matches(array_to_string(w[k : k + n + 1], ' '), pattern)
            group by doc_id
        )
        select id as doc_id, cast(len(w) as bigint) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
               sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated, coalesce(n_near, 0) as n_near
        from words left join hits on id = hits.doc_id left join found on id = found.doc_id left join near on id = near.doc_id
        where kind = 'd'
    """,
}
