"""Benchmark decontamination by Wu-Manber multi-pattern search over words.

Benchmark windows are the patterns and words are the alphabet. For patterns of one length a shift table over
two-word blocks tells how far the search can jump, the block at a position's end selects a bucket of patterns, and
those are compared word by word. Items shorter than the window make passes of their own, by length, so that they
don't shorten the jumps of the others.

Documents never move: a search is one pass over the partitions. The patterns reach the executors in blocks of at most
``block_bytes`` of benchmark text (a proven bound for what is broadcast); a larger benchmark takes several passes over
the same rows, whose hits are merged per document.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried

#: Fixed by the contract: A-Z become lower case, other ASCII than digits and letters separates words.
_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))

SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def words_of(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class WuManber:
    """Patterns of one length (in words)."""

    def __init__(self, length: int):
        self.length, self.block = length, min(2, length)
        self.shift: dict = {}
        self.buckets: dict = {}

    def add(self, pattern: tuple, item: str) -> None:
        for end in range(self.block, self.length + 1):
            key = pattern[end - self.block : end]
            self.shift[key] = min(self.shift.get(key, self.length), self.length - end)
        self.buckets.setdefault(pattern[-self.block :], {}).setdefault(pattern, set()).add(item)

    def search(self, words: list, hits: list, items: set) -> None:
        """Append the (start, end) of every occurrence, in order, and the items that have one."""
        m, b, n = self.length, self.block, len(words)
        shift, buckets, jump = self.shift.get, self.buckets, self.length - self.block + 1
        at = m
        pairs = list(zip(words, words[1:])) if b == 2 else list(zip(words))
        while at <= n:
            step = shift(pairs[at - b], jump)
            if step:
                at += step
                continue
            owners = buckets[pairs[at - b]].get(tuple(words[at - m : at]))
            if owners:
                hits.append((at - m, at))
                items |= owners
            at += 1


def build(rows: list[tuple], window: int) -> list[WuManber]:
    by_length: dict[int, WuManber] = {}
    for item, text in rows:
        words = words_of(text)
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if size else 0):
            by_length.setdefault(size, WuManber(size)).add(tuple(words[i : i + size]), item)
    return list(by_length.values())


def merge(spans: list[tuple]) -> list[tuple]:
    out: list[list] = []
    for s, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1][1] = max(out[-1][1], e)
        else:
            out.append([s, e])
    return [tuple(x) for x in out]


def _blocks(benchmark: DataFrame, id_col: str, text_col: str, block_bytes: int) -> Iterator[list[tuple]]:
    """Items in blocks; the driver holds one block, whose text is at most ``block_bytes`` or a single item."""
    rows = benchmark.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col).cast("string").cast("binary")).where(F.col(text_col).isNotNull())
    block, size = [], 0
    for item, text in rows.toLocalIterator():
        if block and size + len(text) > block_bytes:
            yield block
            block, size = [], 0
        block.append((item, bytes(text)))
        size += len(text)
    yield block


def decontaminate(docs: DataFrame, benchmark: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", window: int = 10, block_bytes: int = 16 << 20, carry: bool = False) -> DataFrame:
    """Words of each document that benchmark windows cover.

    Returns doc_id, n_words, n_hit, spans (merged word ranges), items (ids as strings, sorted), contaminated; with
    ``carry`` also doc, a struct of all input columns. One row for each input row, repeated rows included.

    A null or empty text has no words, and neither has a null item. A null item id counts as the id ''. Rows of one
    id are one item. Extra columns, also such as are named like results, stay inside doc or are left out. An empty
    benchmark hits nothing.
    """
    spark = docs.sparkSession
    # Fields are addressed by position in what follows: n_words, spans and items are the last three.
    df = carried(docs, id_col, text_col, carry).withColumns({"n_words": F.lit(0).cast("long"), "spans": F.array().cast(SPANS), "items": F.array().cast("array<string>")})
    for block in _blocks(benchmark, item_col, item_text_col, block_bytes):
        table = spark.sparkContext.broadcast(build(block, window))

        def scan(batches: Iterator[pa.RecordBatch], table=table) -> Iterator[pa.RecordBatch]:
            passes = table.value
            for batch in batches:
                names = batch.schema.names
                texts = batch.column(names.index("text")).cast(pa.binary())
                spans, items = (batch.column(names.index(x)) for x in ("spans", "items"))
                counts, new_spans, new_items = [], [], []
                for i in range(batch.num_rows):
                    words = words_of(texts[i].as_py())
                    hits: list = []
                    found: set = set()
                    for p in passes:
                        p.search(words, hits, found)
                    counts.append(len(words))
                    old = spans[i].as_py()
                    new_spans.append([{"start": s, "end": e} for s, e in merge(hits + [(x["start"], x["end"]) for x in old])] if hits or old else [])
                    new_items.append(sorted(found.union(items[i].as_py())))
                cols = [batch.column(i) for i in range(batch.num_columns - 3)]
                yield pa.RecordBatch.from_arrays([*cols, pa.array(counts, pa.int64()), pa.array(new_spans, spans.type), pa.array(new_items, items.type)], names=names)

        df = df.mapInArrow(scan, df.schema)
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return df.select(*(["doc"] if carry else []), "doc_id", "n_words", n_hit.alias("n_hit"), "spans", "items", (F.size("spans") > 0).alias("contaminated"))


def items_digest(items: Column) -> Column:
    return F.sha2(F.array_join(F.sort_array(items), ","), 256)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = decontaminate(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), items_digest(F.col("items")).alias("items_sha256"), "contaminated")


ORACLE_SQL = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents
), i AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM benchmark
), p AS (
  SELECT DISTINCT item_id, least(len(ws), 10) AS m, array_to_string(ws[k : k + least(len(ws), 10) - 1], ' ') AS pat
  FROM (SELECT item_id, ws, unnest(range(1, greatest(len(ws) - 10, 0) + 2)) AS k FROM i WHERE len(ws) > 0)
), d AS (
  SELECT doc_id, m, k, array_to_string(ws[k : k + m - 1], ' ') AS pat
  FROM (SELECT doc_id, ws, m, unnest(range(1, len(ws) - m + 2)) AS k FROM w, (SELECT DISTINCT m FROM p) WHERE len(ws) >= m)
), h AS (
  SELECT doc_id, item_id, d.m, k FROM d JOIN p ON d.m = p.m AND d.pat = p.pat
), c AS (
  SELECT doc_id, count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(range(k, k + m)) AS x FROM h) GROUP BY doc_id
), t AS (
  SELECT doc_id, count(DISTINCT item_id) AS n, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS ids FROM h GROUP BY doc_id
)
SELECT w.doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(coalesce(c.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(t.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(t.ids, '')) AS items_sha256, coalesce(c.n, 0) > 0 AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)
"""
