"""Token counts by way of a digest cache.

A cache is a folder of Parquet files (digest, version, n_tokens): the SHA-256 of the normalised content, the digest of
what counts it (tokenizer file, library and its version, normalisation), and the count. Counting joins the documents'
digests to the stored counts, encodes each distinct miss once, appends the new counts, and joins again.

Texts move at most once: tasks drop repeats of a digest before the shuffle, so a text that a third of the rows share
travels once for each task; digests that are stored already don't travel.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import carried, new_path

CACHE_SCHEMA = "digest binary, version string, n_tokens bigint"

_TOKENIZERS: dict = {}


def _counter(path: str):
    """Texts to counts, by the library that the file is for, with its defaults and no added tokens."""
    if path not in _TOKENIZERS:
        if path.endswith(".json"):
            import os

            os.environ["TOKENIZERS_PARALLELISM"] = "false"
            from tokenizers import Tokenizer

            model = Tokenizer.from_file(path)
            model.no_truncation()
            model.no_padding()
            _TOKENIZERS[path] = lambda texts: [len(x.ids) for x in model.encode_batch_fast(texts, add_special_tokens=False)]
        else:
            import sentencepiece

            piece = sentencepiece.SentencePieceProcessor(model_file=path)
            _TOKENIZERS[path] = lambda texts: [len(x) for x in piece.encode(texts, num_threads=1)]
    return _TOKENIZERS[path]


def tokenizer_version(path: str) -> str:
    """Digest of the file, the library's version and the normalisation of contents."""
    from importlib.metadata import version

    name = "tokenizers" if path.endswith(".json") else "sentencepiece"
    with open(path, "rb") as f:
        return hashlib.sha256(f"{name} {version(name)} null-as-empty ".encode() + hashlib.file_digest(f, "sha256").digest()).hexdigest()


def read_cache(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(CACHE_SCHEMA).parquet(path)


def _first_of_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops rows whose digest the task has had (it remembers a bounded number of digests; the shuffle drops the rest)."""
    seen: set[bytes] = set()
    for batch in batches:
        keep = []
        for d in batch.column(0).to_pylist():
            keep.append(d not in seen)
            if keep[-1]:
                seen.add(d)
        if len(seen) > 1_000_000:
            seen.clear()
        yield batch.filter(pa.array(keep, pa.bool_()))


def count_tokens(docs: DataFrame, tokenizer_path: str, cache_path: str, *, id_col: str = "doc_id", text_col: str = "text", slice_bytes: int = 2 << 20, carry: bool = False) -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens for each row; new counts are appended to the cache at ``cache_path``.

    Contents are normalised by taking null as the empty text and nothing else, since any other change could change
    the count. Rows with equal texts, ids or not, are counted once and each get the count. With ``carry`` also doc, a
    struct of all input columns; other extra columns are left out. An empty table appends nothing. Counts that were
    stored twice (two runs at once) are equal, and are taken once.
    """
    spark = docs.sparkSession
    version = tokenizer_version(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = carried(docs, id_col, text_col, carry)
    keyed = rows.select(*(["doc"] if carry else []), "doc_id", F.octet_length(text).cast("long").alias("n_bytes"), F.unhex(F.sha2(text, 256)).alias("digest"))
    stored = lambda: read_cache(spark, cache_path).where(F.col("version") == version).groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    texts = rows.select(F.unhex(F.sha2(text, 256)).alias("digest"), text.alias("text")).mapInArrow(_first_of_digest, "digest binary, text string")
    misses = texts.join(stored().select("digest"), "digest", "left_anti").dropDuplicates(["digest"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(tokenizer_path)
        for batch in batches:
            found: list[int] = []
            part: list[str] = []
            size = 0
            for x in batch.column(1):
                part.append(x.as_py())
                size += len(part[-1])
                if size > slice_bytes:
                    found += counter(part)
                    part, size = [], 0
            found += counter(part) if part else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([version] * len(found), pa.string()), pa.array(found, pa.int64())], names=["digest", "version", "n_tokens"])

    misses.mapInArrow(count, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    return keyed.join(stored(), "digest").select(*(["doc"] if carry else []), "doc_id", "n_bytes", "n_tokens")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = count_tokens(docs, public_tokenizers.path("byte_bpe_50k.json"), new_path(spark, "token-counts"))
    return out.withColumn("over_limit", F.col("n_tokens") > 512)
