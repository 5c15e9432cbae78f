"""Queries of the training-data operators over the whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import chat, decontaminate, hmm, packing, quality, rabin_karp, secrets, simhash, suffix, warc


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer() -> tuple[str, str]:
    import public_tokenizers as P

    return P.path("byte_bpe_50k.json"), P.PATTERN


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), *tokenizer(), window=1024, end_id=0)


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("</s>[INST] ok [/INST]").alias("text"))
    return chat.digests(chat.format_chat(turns.unionByName(probe)))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents"))


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.score(table(spark, sf_dir, "documents"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_round_trip(table(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_rabin_karp(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rabin_karp.remove_repeats(table(spark, sf_dir, "documents"), window=35).drop("spans")


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix.remove_repeats(table(spark, sf_dir, "documents"), window=400).drop("spans")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan(table(spark, sf_dir, "documents"))


def op10_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_classes(table(spark, sf_dir, "documents"), words=3, distance=2)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pack": op1_pack,
    "op2_chat": op2_chat,
    "op3_quality": op3_quality,
    "op4_hmm": op4_hmm,
    "op5_warc": op5_warc,
    "op6_rabin_karp": op6_rabin_karp,
    "op7_decontaminate": op7_decontaminate,
    "op8_suffix_array": op8_suffix_array,
    "op9_secrets": op9_secrets,
    "op10_simhash": op10_simhash,
}

ORACLES: dict[str, str] = {
    "op2_chat": r"""
        with turns as (select conv_id, turn, role, coalesce(text, '') as text from conversations
                       union all values (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')),
        lengths as (select *, length(text) + length(text) - length(replace(text, '\', '')) + length(regexp_replace(text, '<\||<s>|</s>|\[INST\]|\[/INST\]|<<SYS>>|<</SYS>>', '\0#', 'g')) - length(text)
                    + length('<|turn|>') + length(role) + 1 + length('<|end|>') + 1 as formatted from turns)
        select cast(conv_id as bigint) as conv_id, count(*) as n_turns,
            sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
            cast(coalesce(sum(length(text)) filter (where role = 'assistant'), 0) as bigint) as loss_chars,
            sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256,
            cast(sum(formatted) as bigint) as formatted_chars
        from lengths group by conv_id""",
    "op3_quality": r"""
        with d as (select doc_id, coalesce(text, '') as text from documents),
        w as (select doc_id, text, list_filter(regexp_split_to_array(text, '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from d),
        places as (select doc_id, w, unnest(range(1, greatest(len(w) - 1, 1))) as i from w),
        tri as (select doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] as g from places),
        again as (select doc_id, i from tri qualify count(*) over (partition by doc_id, g) > 1),
        rep as (select doc_id, count(distinct p) as n from (select doc_id, unnest([i, i + 1, i + 2]) as p from again) group by doc_id),
        lines as (select doc_id, unnest(string_split(text, chr(10))) as line from d),
        full_lines as (select doc_id, line, length(line) as n, length(line) - length(regexp_replace(line, '[#*$%&|<>]', '', 'g')) as sym,
            length(line) - length(replace(line, '!', '')) as bang, length(line) - length(regexp_replace(line, '[|»›•·→]', '', 'g')) as sep
            from lines where regexp_matches(line, '[^\x20\x09-\x0D]')),
        failed as (select *, (sym >= 3 and sym * 10 >= n) or (bang >= 4 and bang * 10 >= n) or (sep >= 3 and sep * 20 >= n)
            or (regexp_matches(lower(line), 'PHRASES') and 8 * (length(lower(line)) - length(regexp_replace(lower(line), 'PHRASES', '', 'g'))) >= n) as fails from full_lines),
        by_doc as (select doc_id, count(*) - count(distinct line) as dup, sum(n) as chars, coalesce(sum(n) filter (where fails), 0) as lost from failed group by doc_id),
        m as (select w.doc_id, len(w) as n_words, length(array_to_string(w, '')) as word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
            coalesce(dup, 0) as n_dup_lines, coalesce(rep.n, 0) as n_repeat_words, coalesce(chars, 0) as chars, coalesce(lost, 0) as lost
            from w left join rep using (doc_id) left join by_doc using (doc_id))
        select doc_id, cast(n_words as bigint) as n_words, cast(word_chars as bigint) as word_chars, cast(n_symbols as bigint) as n_symbols, cast(n_dup_lines as bigint) as n_dup_lines,
            cast(n_repeat_words as bigint) as n_repeat_words, n_words < 50 or 100 * n_repeat_words > 50 * n_words as base_failed,
            not (n_words < 50 or 100 * n_repeat_words > 50 * n_words) and lost * 2 <= chars as kept from m""".replace("PHRASES", quality.PHRASES),
    "op5_warc": """
        with p as (select page_id, coalesce(html, '') as html from pages),
        d as (select page_id, cast(octet_length(encode(html)) as bigint) as payload_bytes, sha256(html) as payload_digest from p),
        g as (select payload_digest, min(page_id) as first_id from d where payload_bytes >= 100 group by payload_digest having count(*) > 1)
        select page_id, payload_bytes, payload_digest, case when first_id is not null and first_id <> page_id then 'revisit' else 'response' end as record_type,
            case when first_id <> page_id then first_id end as refers_to
        from d left join g using (payload_digest)""",
}
