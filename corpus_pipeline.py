"""The corpus pipeline: stages over documents, each written as Parquet and read back as the next one's input.

Every stage but the last returns the columns of documents, extra ones included. All stages take a null text for an empty
one and texts of any length, and give no rows for no rows. Rows whose doc_id is null cannot be told apart by id, so the
stages that decide by id keep them.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_dedup, packing, quality, secrets
from lodestone.llm._common import read_table, stash
from lodestone.llm.queries import tokenizer_path


def quality_classifier(spark, docs, sf_dir):
    """Documents that the classifier rejects go.

    A document goes if any row of its doc_id is rejected; equal rows score equally, so repeated ones stay or go together.
    """
    rejected = quality.score(docs, read_table(spark, sf_dir, "labels")).where("not keep").select("doc_id").distinct()
    return docs.join(rejected, "doc_id", "left_anti").select(*docs.columns)


def minhash_near_dedup(spark, docs, sf_dir):
    """Of each group of documents linked from a similarity of 0.8 on, the one with the least doc_id stays.

    Empty texts are linked with nothing and stay. Rows with the doc_id that stays but other texts all stay; of rows that
    share doc_id and text, the one that is least as JSON stays.
    """
    gone = near_dedup.near_components(docs, percent=80).where("not kept and doc_id is not null").select("doc_id").distinct()
    rest = docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
    repeated = stash(rest.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id"))
    once = rest.join(repeated, "doc_id", "left_anti").select(*docs.columns)
    whole = F.struct(*docs.columns)
    least = F.min_by(whole, F.to_json(whole)).alias("row")
    again = rest.join(repeated, "doc_id", "left_semi").groupBy("doc_id", F.xxhash64("text"), "text").agg(least).select("row.*")
    return once.unionByName(again)


def benchmark_decontamination(spark, docs, sf_dir):
    """Documents that hold a benchmark item, an edited copy of one, or a long passage of one, go.

    A document goes if any row of its doc_id holds one; items that are null or empty are held by none.
    """
    leaks = decontaminate.contaminated_pairs(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*docs.columns)


def secret_scan(spark, docs, sf_dir):
    """Secrets are cut out of the text; the documents stay, repeated rows each, and n_chars follows the text."""
    return secrets.redact(docs)


def best_fit_packing(spark, docs, sf_dir):
    """Each piece of each document with its place in a training sequence; a null doc_id stays null, repeated rows are packed each."""
    return packing.pack(docs, tokenizer_path())


STAGES = [
    ("quality_classifier", quality_classifier),
    ("minhash_near_dedup", minhash_near_dedup),
    ("benchmark_decontamination", benchmark_decontamination),
    ("secret_scan", secret_scan),
    ("best_fit_packing", best_fit_packing),
]
ORACLE_SQL = None


def run(spark, sf_dir):
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = stash(docs)
    return docs
