"""The queries of this subpackage: one for each operator, over its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, exact_dedup, language_id, lexical_search, metric_join, ngram_join, packing, span_dedup, token_counts, toxicity, vector_search, warc
from .common import table


def op1_metric_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors, linked inside their labels at a cosine of 0.98: links, component and whether the vector is its first."""
    return metric_join.near_vectors(table(spark, sf_dir, "embeddings"), 0.98)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded and decoded again: number of ids and digests of ids and text."""
    return bpe.round_trip_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its place in a sequence of at most 4096 ids."""
    return packing.pack_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, linked at 85 in 100 common 4-word shingles: size of the set and component."""
    return ngram_join.jaccard_components(table(spark, sf_dir, "documents"), 4, "0.85")


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written to archives and read back: payload digest, response or revisit."""
    back = warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the one that stays of its group of equal texts."""
    out = exact_dedup.exact_groups(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "keep_id", "group_size", "kept", "text_sha256")


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals by source, language and tokenizer version after five batches of signed changes over all documents."""
    docs = table(spark, sf_dir, "documents")
    return token_counts.corpus_rollup(docs, public_tokenizers.path("byte_bpe_50k.json"), "byte_bpe_50k", whole=True).totals()


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text scored by a model of the labels that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text by a model of the documents that are not held out."""
    docs = table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.fit(docs))


def op10_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the sentences cut that repeat an earlier run."""
    out = span_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return out.selectExpr("doc_id", "n_sentences", "n_removed", "to_json(removed) as removed", "text")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text under two tokenizers: groups of tokens that end at the same bytes, links and how frequent these are."""
    return alignment.alignment_report(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))


def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents of all that score highest for each benchmark item."""
    return lexical_search.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest found, by inner product, of each vector whose id is divisible by 20."""
    return vector_search.search(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_metric_join, op2_bpe, op3_packing, op4_ngram_join, op5_warc, op6_exact_dedup, op7_token_counts, op8_toxicity, op9_language_id, op10_span_dedup, op11_alignment, op12_lexical_search, op13_vector_search)}

_TERMS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"
_NORM = r"regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')"

ORACLE_SQL = {
    "op12_lexical_search": f"""
        with d as (select doc_id, {_TERMS} as ts from documents where text is not null),
             q as (select distinct item_id, unnest({_TERMS}) as term from benchmark where text is not null),
             size as (select count(*) as docs, sum(len(ts)) as words from d where len(ts) > 0),
             t as (select doc_id, n, term, count(*) as tf from (select doc_id, len(ts) as n, unnest(ts) as term from d) group by all),
             w as (select term, cast(floor(1000 * ln((2 * max(docs) + 2) / (2 * count(*) + 1))) as bigint) as w from t, size where term in (select term from q) group by term),
             s as (select item_id, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // words)))) as bigint) as score
                   from q join w using (term) join t using (term), size group by item_id, doc_id)
        select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
        from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 10""",
    "op6_exact_dedup": f"""
        select doc_id, min(doc_id) over g as keep_id, cast(count(*) over g as bigint) as group_size,
               doc_id = min(doc_id) over g as kept, sha256({_NORM}) as text_sha256
        from documents window g as (partition by {_NORM})""",
}
