"""Registered queries of these operators, over whole tables, and their SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from docsieve.llm.chat import format_chats, with_control_turns
from docsieve.llm.fuzzy import piecewise_hashes
from docsieve.llm.mixing import mix_sources
from docsieve.llm.packing import pack_documents
from docsieve.llm.pages import extract_main
from docsieve.llm.pieces import encode_pieces
from docsieve.llm.quality import quality_rules
from docsieve.llm.runs import find_runs, with_periodic_tails
from docsieve.llm.shared import table
from docsieve.llm.simhash import near_duplicates
from docsieve.llm.sql import quality_sql, url_sql
from docsieve.llm.substrings import remove_repeats
from docsieve.llm.toxicity import score_toxicity
from docsieve.llm.urls import UrlRule, url_filter
from docsieve.llm.whitening import component_rows, whiten_embeddings

PIECES = public_tokenizers.path("piece_bpe_32k.model")
BYTES = public_tokenizers.path("byte_bpe_50k.json")
URL_RULES = (
    UrlRule("allow", "com"),
    UrlRule("block", "example.com", "/en/"),
    UrlRule("allow", "www.example.com", "/en/"),
    UrlRule("block", "net", "/es/"),
    UrlRule("block", "net", "/fr/"),
)


def op1_sentencepiece(spark, sf_dir):
    return encode_pieces(table(spark, sf_dir, "documents"), PIECES, ids=False)


def op2_chat_formatting(spark, sf_dir):
    return format_chats(with_control_turns(table(spark, sf_dir, "conversations")), BYTES)


def op3_url_filters(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), table(spark, sf_dir, "labels"), URL_RULES).drop("purity")


def op4_suffix_array(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"), kept=False).drop("text_key")


def op5_fingerprints(spark, sf_dir):
    return piecewise_hashes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark, sf_dir):
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op7_quality_rules(spark, sf_dir):
    return quality_rules(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op8_html_extraction(spark, sf_dir):
    return extract_main(table(spark, sf_dir, "pages"))


def op9_simhash(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents")).select("doc_id", "fingerprint", "component_id")


def op10_mixing(spark, sf_dir):
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id",
        "size",
        F.get("source_sizes", F.lit(0)).alias("source_size"),
        F.get("targets", F.lit(0)).alias("target"),
        "taken",
    )


def op11_packing(spark, sf_dir):
    return pack_documents(table(spark, sf_dir, "documents"), BYTES, capacity=2048, end=0, ids=False)


def op12_whitening(spark, sf_dir):
    return component_rows(whiten_embeddings(table(spark, sf_dir, "embeddings"), components=32))


def op13_periodic_runs(spark, sf_dir):
    return find_runs(with_periodic_tails(table(spark, sf_dir, "documents")), periods=4, least=6, texts=False)


QUERIES = {
    build.__name__: build
    for build in (
        op1_sentencepiece,
        op2_chat_formatting,
        op3_url_filters,
        op4_suffix_array,
        op5_fingerprints,
        op6_toxicity,
        op7_quality_rules,
        op8_html_extraction,
        op9_simhash,
        op10_mixing,
        op11_packing,
        op12_whitening,
        op13_periodic_runs,
    )
}
SQL = {"op3_url_filters": url_sql(URL_RULES), "op7_quality_rules": quality_sql()}
