"""The registered queries of this package and, where SQL can express them, the SQL to hold them against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import table


def op1_multiprobe_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.neighbours import nearest

    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op2_toxicity_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.toxicity import fit, toxicity

    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return toxicity(docs, model).select("doc_id", "severity", "grade", "p_toxic", "toxic")


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.packing import pack_documents, text_cluster

    docs = table(spark, sf_dir, "documents")
    # a byte-level model's tokens, and one that ends the document
    length = F.coalesce(F.octet_length("text"), F.lit(0)) + 1
    return pack_documents(docs, length, 16_384, F.col("source"), text_cluster(F.col("text")), per_source=2)


def op4_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.audio import audio_features

    return audio_features(table(spark, sf_dir, "documents"))


def op5_pii_disclosure(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.pii import pii_spans

    return pii_spans(table(spark, sf_dir, "documents"))


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import encode_documents

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return encode_documents(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op7_secret_grammar(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.secrets import find_secrets

    return find_secrets(table(spark, sf_dir, "documents"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.bpe import section_token_counts

    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return section_token_counts(table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN, boundary="\n", rule="first")


def op9_token_id_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from tessera.llm.simple8b import stored_documents, write_blocks

    blocks = write_blocks(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)
    return stored_documents(blocks)


def op10_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.simhash import simhash_components

    return simhash_components(table(spark, sf_dir, "documents"), ngram=3, most=2)


def op11_recurrent_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.scoring import document_scores

    return document_scores(table(spark, sf_dir, "documents"))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.spelling import spelling_variants

    return spelling_variants(table(spark, sf_dir, "documents"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tessera.llm.divergence import source_divergence

    return source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_multiprobe_neighbours": op1_multiprobe_neighbours,
    "op2_toxicity_grades": op2_toxicity_grades,
    "op3_best_fit_packing": op3_best_fit_packing,
    "op4_audio_features": op4_audio_features,
    "op5_pii_disclosure": op5_pii_disclosure,
    "op6_byte_bpe": op6_byte_bpe,
    "op7_secret_grammar": op7_secret_grammar,
    "op8_token_counts": op8_token_counts,
    "op9_token_id_blocks": op9_token_id_blocks,
    "op10_simhash_near_dedup": op10_simhash_near_dedup,
    "op11_recurrent_scores": op11_recurrent_scores,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_source_divergence": op13_source_divergence,
}

ORACLE_SQL: dict[str, str] = {
    "op12_spelling_variants": r"""
        with recursive given as (select coalesce(cast(doc_id as varchar), '') as doc, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text from documents),
        found as (select doc, unnest(regexp_extract_all(text, '[a-z\x{C0}-\x{FF}]+')) as run from given),
        runs as (select doc, run, count(*) as n, hex(doc || ':' || run) as code from found where length(run) >= 5 group by doc, run),
        hashed as (
            select run, n, xor(4294967295::ubigint, list_reduce(list_transform(range(1, length(code), 2), lambda i: cast('0x' || substr(code, i, 2) as ubigint)),
                lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda x, z: xor(x >> 1, 3988292384::ubigint * (x & 1))), 4294967295::ubigint))::bigint as h from runs),
        spelt as (select case when h % 97 = 0 then substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) else run end as word, n from hashed),
        words as (select word, sum(n)::bigint as n from spelt where length(word) >= 5 group by word having sum(n) >= 3),
        cut as (select word, n, i, substr(word, 1, i) || substr(word, i + 2) as rest from (select word, n, unnest(range(0, length(word))) as i from words)),
        pairs as (
            select a.word, b.word as form, b.n as form_n from cut a join cut b on a.rest = b.rest and a.i = b.i and a.word <> b.word
            union select a.word, b.word, b.n from cut a join words b on a.rest = b.word union select b.word, a.word, a.n from cut a join words b on a.rest = b.word),
        ranked as (select word, form, form_n, count(*) over (partition by word) as n_near, row_number() over (partition by word order by form_n desc, form) as r from pairs),
        told as (select w.word, w.n, coalesce(r.n_near, 0) as n_near, case when r.form_n >= 2 * w.n then r.form end as form, case when r.form_n >= 2 * w.n then r.form_n end as form_n from words w left join ranked r on r.word = w.word and r.r = 1),
        steps as (select word, form as goal, 1 as k from told where form is not null union all select s.word, t.form, s.k + 1 from steps s join told t on t.word = s.goal where t.form is not null),
        roots as (select word, arg_max(goal, k) as root from steps group by word)
        select t.word, t.form, coalesce(r.root, t.word) as root, t.n, t.n_near, t.form_n from told t left join roots r using (word)
    """,
    "op13_source_divergence": r"""
        with given as (select doc_id, coalesce(lang, '') as lang, coalesce(source, '') as source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as text, row_number() over () as row from documents),
        found as (select lang, source, row, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) as term from given),
        vocabulary as (select lang, term, count(*) as n from found group by lang, term having count(distinct row) >= 3),
        langs as (select lang, count(*)::hugeint as v, sum(n)::hugeint as total from vocabulary group by lang),
        counts as (select lang, source, term, count(*) as n from found semi join vocabulary using (lang, term) group by lang, source, term),
        sums as (select lang, source, sum(n)::hugeint as total from counts group by lang, source),
        groups as (select lang, source, coalesce(s.total, 0)::hugeint as total, l.v, l.total as of_lang from (select distinct lang, source from given) left join sums s using (lang, source) left join langs l using (lang)),
        shares as (
            select g.lang, g.source, t.term, coalesce(c.n, 0) as n, 1 + 1000000000::hugeint * (coalesce(c.n, 0) + 1) // (g.total + g.v) as p, 1 + 1000000000::hugeint * (t.n + 1) // (g.of_lang + g.v) as q
            from groups g join vocabulary t using (lang) left join counts c on c.lang = g.lang and c.source = g.source and c.term = t.term),
        pairs as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // b.p) as value from shares a join shares b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by a.lang, a.source, b.source),
        every as (
            select a.lang, a.source, 'pair' as part, b.source as item, coalesce(p.value, 0)::bigint as value from groups a join groups b on a.lang = b.lang and a.source <> b.source left join pairs p on p.lang = a.lang and p.source = a.source and p.item = b.source
            union all select lang, source, 'term', term, ((p - q) * (p - q) // q)::bigint from shares where n > 0 and p > q),
        ranked as (select *, row_number() over (partition by lang, source, part order by value desc, item)::integer as rank from every)
        select lang, source, part, item, value, rank from ranked where part = 'pair' or rank <= 200
    """,
}
