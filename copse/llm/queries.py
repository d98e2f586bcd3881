"""Registered queries of the numbered operators, with production parameters, over whole tables."""

from __future__ import annotations

from copse.llm import clustering, decontaminate, filter_audit, html_text, language, mixing, packing, pii, quality, simhash, substring_dedup, token_store, url_filter
from copse.llm.common import table
from copse.llm.oracle import ORACLE_SQL as ORACLE_SQL

#: Folder names of the public vocabularies; resolved where they are installed.
VOCABULARY, TOKENIZER, PACKING_TOKENIZER = "piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_50k.json"


def vocabulary_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_mix_sources(spark, sf_dir):
    return mixing.taken(mixing.mix(table(spark, sf_dir, "documents")))


def op2_extract_html(spark, sf_dir):
    return html_text.extract(table(spark, sf_dir, "pages"))


def op3_find_pii(spark, sf_dir):
    return pii.find(table(spark, sf_dir, "documents"))


def op4_quality_rules(spark, sf_dir):
    return quality.judge(table(spark, sf_dir, "documents"))


def op5_simhash_near_dedup(spark, sf_dir):
    return simhash.report(simhash.near_duplicates(table(spark, sf_dir, "documents")))


def op6_suffix_array_dedup(spark, sf_dir):
    return substring_dedup.report(substring_dedup.deduplicated(table(spark, sf_dir, "documents")))


def op7_filter_urls(spark, sf_dir):
    return url_filter.judge(table(spark, sf_dir, "pages"))


def op8_identify_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return language.identify(docs, language.train(language.learnable(docs), vocabulary_path(VOCABULARY)))


def op9_decontaminate(spark, sf_dir):
    return decontaminate.report(decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


def op10_token_store(spark, sf_dir):
    path = token_store.new_store(spark)
    token_store.write_store(table(spark, sf_dir, "documents"), path, vocabulary_path(TOKENIZER))
    return token_store.read_store(spark, path)


def op11_audit_filters(spark, sf_dir):
    return filter_audit.audit(filter_audit.mask_counts(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")))


def op12_pack_sequences(spark, sf_dir):
    cut = packing.pieces(table(spark, sf_dir, "documents"), vocabulary_path(PACKING_TOKENIZER))
    return packing.report(packing.packed(cut.drop("ids", "width")))


def op13_cluster_embeddings(spark, sf_dir):
    return clustering.report(*clustering.clustered(table(spark, sf_dir, "embeddings")))


QUERIES = {f.__name__: f for f in (op1_mix_sources, op2_extract_html, op3_find_pii, op4_quality_rules, op5_simhash_near_dedup, op6_suffix_array_dedup, op7_filter_urls, op8_identify_language, op9_decontaminate, op10_token_store, op11_audit_filters, op12_pack_sequences, op13_cluster_embeddings)}
