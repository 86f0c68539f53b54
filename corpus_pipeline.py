"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, token ids.

Each stage is a function of (spark, docs, sf_dir); run() writes what it returns as Parquet and reads that again as the
next stage's docs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brindle.llm import bpe, decontaminate, line_dedup, quality, simhash
from brindle.llm.common import cut, table


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules keep."""
    return quality.judge(docs, carry=True).where("kept").select("doc.*")


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that repeat an earlier one, or from 20 characters on are one edit from it. n_chars follows."""
    out = line_dedup.dedup_lines(docs, carry=True)
    changed = {"text": F.col("kept_text"), "n_chars": F.when(F.col("n_removed") > 0, F.length("kept_text").cast("long")).otherwise(F.col("doc.n_chars"))}
    return out.select(*[changed[c].alias(c) if c in changed else F.col(f"doc.`{c}`") for c in docs.columns])


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of near duplicates one document: that with the smallest id (see ``simhash.deduplicate`` for ties).

    Near duplicates are texts within two bits of each other, or with 80 in 100 of their five-word shingles in common.
    """
    return simhash.deduplicate(docs, percent=80)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark window occurs."""
    out = decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark"), carry=True)
    return out.where(~F.col("contaminated")).select("doc.*")


def token_ids(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of each document, and digests of the ids and of what they decode to."""
    import public_tokenizers

    out = bpe.encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), results=("n_tokens", "ids", "ids_sha256", "decoded_sha256"), slice_bytes=2 << 20, carry=True)
    return out.select("doc_id", "doc.lang", "doc.source", "n_tokens", "ids", "ids_sha256", "decoded_sha256")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("near-dedup", near_dedup),
    ("decontamination", drop_contaminated),
    ("token ids", token_ids),
]

#: SimHash and byte-pair merges have no DuckDB SQL; tests/llm compares the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = cut(stage(spark, docs, sf_dir), "pipeline-" + name.replace(" ", "-"))
    return docs
