"""Stupid-backoff scores of documents against counts of the whole corpus.

Words and pairs of words are hashed to 64 bits. Each block of documents sends its distinct n-grams with their counts to
the hash partition of the count table that owns them; the partition sums the counts of each n-gram and joins the sums
to the n-grams of each block; with these, documents sum the logarithms of their words' scores.

Counts are those of all other documents: a document's own are taken off, so that a pair which only it has backs off.
With N the number of words of all other documents (1 at least) and c their counts, a word b after a scores
c(ab) / c(a) where c(ab) > 0, or else 0.4 times its own score, which is c(b) / N where c(b) > 0, or else 0.4 / N. A
document's first word has its own score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B

BACKOFF = 0.4
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_PAIR = np.uint64(0x9E3779B97F4A7C15)


def grams(ends: np.ndarray, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of a block: each word's hash, the document of each word, pairs' hashes, and where pairs begin (word places)."""
    from xxhash import xxh64_intdigest

    lowered = text.translate(_LOWER)
    words: list[bytes] = []
    counts = []
    start = 0
    for end in ends.tolist():
        found = lowered[start:end].split()
        counts.append(len(found))
        words += found
        start = end
    coded = pa.array(words, pa.binary()).dictionary_encode()
    table = np.fromiter((xxh64_intdigest(w, 42) for w in coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    hashes = table[coded.indices.to_numpy(zero_copy_only=False)] if len(words) else np.zeros(0, np.uint64)
    docs = np.repeat(np.arange(len(counts)), counts)
    first = np.flatnonzero(docs[1:] == docs[:-1])
    pairs = B.mix(hashes[first] * _PAIR + B.mix(hashes[first + 1]))
    return B.mix(hashes), docs, pairs, first


def _keys(ids: list, ends: np.ndarray, text: bytes) -> tuple[np.ndarray, list[np.ndarray]]:
    words, _, pairs, _ = grams(ends, text)
    found, n = np.unique(np.concatenate([words, pairs]), return_counts=True)
    return found, [n.astype(np.uint32)]


def _sum(order: np.ndarray, starts: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    return np.add.reduceat(values[0][order].astype(np.int64), starts)


def _own(docs: np.ndarray, at: np.ndarray, size: int) -> np.ndarray:
    """How often the document of each place has the n-gram of that place."""
    _, back, n = np.unique(docs * np.int64(size) + at, return_inverse=True, return_counts=True)
    return n[back]


def score(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = 8 << 20) -> DataFrame:
    """doc_id, n_words, n_backed_off (pairs that no other document has), log_score (natural, summed) for each row.

    A-Z are lower-cased; words are runs of other than ASCII white space. A null or empty text has no words and scores
    0. Each row is a document of its own, rows of one id or one text too. Extra columns are left out.
    """
    blocks = B.make_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "lm", block_bytes)
    answers = B.totals(blocks, "lm", _keys, _sum, B.partitions_for(blocks), [np.uint32], np.int64)

    def words_in(ids, ends, text):
        return sum(len(text[a:b].split()) for a, b in zip(np.concatenate([[0], ends[:-1]]).tolist(), ends.tolist()))

    def sizes(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array([words_in(r["ids"], np.array(r["ends"], np.int64), B.plain(r["text"])) for r in batch.to_pylist()], pa.int64())], names=["n"])

    total = blocks.mapInArrow(sizes, "n bigint").agg(F.sum("n")).first()[0] or 0

    def finish(ids: list, ends: np.ndarray, text: bytes, counts: np.ndarray) -> pa.Table:
        words, of, pairs, first = grams(ends, text)
        found = np.unique(np.concatenate([words, pairs]))
        n_docs = len(ids)
        n_words = np.bincount(of, minlength=n_docs)
        w, p = np.searchsorted(found, words), np.searchsorted(found, pairs)
        others = counts[w] - _own(of, w, len(found))  # of each word, in other documents
        joint = counts[p] - _own(of[first], p, len(found))
        rest = np.maximum(total - n_words, 1)[of]
        alone = np.where(others > 0, others, BACKOFF) / rest
        value = np.log(alone)
        seen = joint > 0
        value[first + 1] = np.where(seen, np.log(np.where(seen, joint, 1) / np.maximum(others[first], 1)), np.log(BACKOFF * alone[first + 1]))
        sums = np.bincount(of, weights=value, minlength=n_docs)
        off = np.bincount(of[first][~seen], minlength=n_docs)
        return pa.table({"doc_id": pa.array(ids, pa.int64()), "n_words": pa.array(n_words, pa.int64()), "n_backed_off": pa.array(off, pa.int64()), "log_score": pa.array(sums, pa.float64())})

    return B.with_answers(blocks, answers, finish, np.int64, "doc_id bigint, n_words bigint, n_backed_off bigint, log_score double")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = score(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_words", "n_backed_off", F.round("log_score", 3).alias("log_score"))


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
  SELECT doc_id, k, ws[k] AS b, CASE WHEN k > 1 THEN ws[k - 1] END AS a FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS k FROM w)
), u AS (
  SELECT b, count(*) AS n FROM p GROUP BY b
), uo AS (
  SELECT doc_id, b, count(*) AS n FROM p GROUP BY doc_id, b
), g AS (
  SELECT a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY a, b
), go AS (
  SELECT doc_id, a, b, count(*) AS n FROM p WHERE a IS NOT NULL GROUP BY doc_id, a, b
), t AS (
  SELECT doc_id, len(ws) AS n_words, greatest((SELECT count(*) FROM p) - len(ws), 1) AS rest FROM w
), c AS (
  SELECT p.doc_id, p.a, u.n - uo.n AS cb, ua.n - uao.n AS ca, g.n - go.n AS cab, t.rest
  FROM p JOIN t ON p.doc_id = t.doc_id JOIN u ON p.b = u.b JOIN uo ON p.doc_id = uo.doc_id AND p.b = uo.b
  LEFT JOIN u ua ON p.a = ua.b LEFT JOIN uo uao ON p.doc_id = uao.doc_id AND p.a = uao.b
  LEFT JOIN g ON p.a = g.a AND p.b = g.b LEFT JOIN go ON p.doc_id = go.doc_id AND p.a = go.a AND p.b = go.b
), s AS (
  SELECT doc_id, sum(CASE WHEN a IS NOT NULL AND cab = 0 THEN 1 ELSE 0 END) AS off,
         sum(ln(CASE WHEN a IS NOT NULL AND cab > 0 THEN cab / ca::DOUBLE ELSE (CASE WHEN a IS NULL THEN 1::DOUBLE ELSE 0.4::DOUBLE END) * (CASE WHEN cb > 0 THEN cb::DOUBLE ELSE 0.4::DOUBLE END) / rest END)) AS x
  FROM c GROUP BY doc_id
)
SELECT t.doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(coalesce(off, 0) AS BIGINT) AS n_backed_off, round(coalesce(x, 0), 3) AS log_score FROM t LEFT JOIN s ON t.doc_id = s.doc_id
"""
