"""Queries of the training-data operators over whole tables, with their SQL where SQL can express them."""

from __future__ import annotations

from lodestone.llm import decontaminate, fingerprints, html_text, near_dedup, packing, quality, secrets, suffix_dedup, url_filter, warc
from lodestone.llm._common import read_table

TOKENIZER = "word_bpe_49k.json"


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(TOKENIZER)


def op1_warc_revisits(spark, sf_dir):
    return warc.revisit_report(read_table(spark, sf_dir, "pages"))


def op2_secret_scan(spark, sf_dir):
    return secrets.scan(read_table(spark, sf_dir, "documents"))


def op3_suffix_array_dedup(spark, sf_dir):
    return suffix_dedup.remove_repeats(read_table(spark, sf_dir, "documents"))


def op4_benchmark_decontamination(spark, sf_dir):
    return decontaminate.contaminated_pairs(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op5_html_extraction(spark, sf_dir):
    return html_text.extract(read_table(spark, sf_dir, "pages"))


def op6_quality_classifier(spark, sf_dir):
    return quality.score(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op7_best_fit_packing(spark, sf_dir):
    return packing.pack(read_table(spark, sf_dir, "documents"), tokenizer_path())


def op8_url_filter(spark, sf_dir):
    return url_filter.judge(read_table(spark, sf_dir, "pages"))


def op9_document_fingerprints(spark, sf_dir):
    return fingerprints.fingerprint(read_table(spark, sf_dir, "documents"))


def op10_minhash_near_dedup(spark, sf_dir):
    return near_dedup.near_components(read_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_warc_revisits, op2_secret_scan, op3_suffix_array_dedup, op4_benchmark_decontamination, op5_html_extraction, op6_quality_classifier, op7_best_fit_packing, op8_url_filter, op9_document_fingerprints, op10_minhash_near_dedup)}
ORACLE_SQL = {"op1_warc_revisits": warc.ORACLE_SQL}
