"""Corpus-wide totals of hashed keys (n-grams, anchors) without a row for each occurrence.

Documents are packed into blocks of some megabytes, written once to the shared folder. A block sends each of its
distinct keys once, with a value that is combined beforehand within the block; keys travel packed, as sorted arrays cut
by hash partition, one row for each block and partition. A partition joins the arrays of all blocks, combines the
values of each key, and answers each block with the combined values in the order of the keys it sent. Answers meet
their block again by its identifier.

A key that every document has is one entry for each block, so no partition is hot. The number of partitions follows
the size of the corpus, and a task holds one block or one partition.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut

#: text is compressed; see plain().
BLOCKS = "block string, ids array<bigint>, ends array<bigint>, text binary, size bigint"
_MIX = (np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (SplitMix64), so that the upper bits can choose a partition."""
    h = (h ^ (h >> np.uint64(30))) * _MIX[0]
    h = (h ^ (h >> np.uint64(27))) * _MIX[1]
    return h ^ (h >> np.uint64(31))


def pack(values: np.ndarray, delta: bool = False) -> bytes:
    """Compressed by byte planes; sorted values by their differences."""
    import zstandard

    if delta and len(values):
        values = np.diff(values, prepend=values[:1] * 0)
    width = values.dtype.itemsize
    return bytes([width]) + zstandard.ZstdCompressor(level=1).compress(np.ascontiguousarray(values.view(np.uint8).reshape(-1, width).T).tobytes())


def unpack(data: bytes, dtype, delta: bool = False) -> np.ndarray:
    import zstandard

    width = data[0]
    planes = np.frombuffer(zstandard.ZstdDecompressor().decompress(data[1:], max_output_size=1 << 31), np.uint8).reshape(width, -1)
    values = np.ascontiguousarray(planes.T).view(dtype).reshape(-1)
    return np.cumsum(values, dtype=dtype) if delta else values


def squeeze(text: bytes) -> bytes:
    import zstandard

    return zstandard.ZstdCompressor(level=3).compress(text)


def plain(text: bytes) -> bytes:
    """The text of a block."""
    import zstandard

    return zstandard.ZstdDecompressor().decompress(text, max_output_size=1 << 31)


def make_blocks(docs: DataFrame, name: str, block_bytes: int = 8 << 20) -> DataFrame:
    """Blocks of documents (doc_id, text), as written to the shared folder: a null text is empty.

    Ids are integers. A block takes documents until it holds ``block_bytes`` of text; a longer text is a block by itself.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[bytes] = []
        size = 0

        def out() -> pa.RecordBatch:
            ends = np.cumsum([len(t) for t in texts]).tolist()
            return pa.RecordBatch.from_arrays([pa.array([uuid.uuid4().hex]), pa.array([ids], pa.list_(pa.int64())), pa.array([ends], pa.list_(pa.int64())), pa.array([squeeze(b"".join(texts))], pa.binary()), pa.array([size], pa.int64())], names=["block", "ids", "ends", "text", "size"])

        for batch in batches:
            for i, t in zip(batch.column(0), batch.column(1).cast(pa.binary())):
                t = t.as_py() or b""
                if texts and size + len(t) > block_bytes:
                    yield out()
                    ids, texts, size = [], [], 0
                ids.append(i.as_py())
                texts.append(t)
                size += len(t)
        if texts:
            yield out()

    if docs.schema["doc_id"].dataType.typeName() not in ("byte", "short", "integer", "long", "void"):
        raise TypeError("documents in blocks need integer ids")
    packed = docs.select(F.col("doc_id").cast("bigint"), F.col("text").cast("string")).mapInArrow(run, BLOCKS)
    return cut(packed, f"{name}-blocks", {"compression": "uncompressed", "parquet.block.size": 16 << 20})[0]


def partitions_for(blocks: DataFrame, bytes_each: int = 8 << 20) -> int:
    """A power of two that grows with the corpus."""
    size = blocks.agg(F.sum("size")).first()[0] or 0
    return 1 << max(3, (size // bytes_each).bit_length())


Rows = Callable[[np.ndarray, list, bytes], tuple[np.ndarray, list[np.ndarray]]]


def totals(blocks: DataFrame, name: str, keys: Callable, combine: Callable, partitions: int, value_types: list, answer_type) -> DataFrame:
    """(block, part, answer): for each block and hash partition the combined values of its keys, in the keys' order.

    ``keys(ids, ends, text)`` gives a block's distinct keys, sorted, and arrays of values (of ``value_types``) beside
    them. ``combine(order, starts, values)`` gives, for the keys of a partition, an array of answers: ``values`` are
    those of all blocks, ``order`` sorts them by key and ``starts`` are where each distinct key begins in that order.
    """
    bits = partitions.bit_length() - 1

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                found, values = keys(row["ids"], np.array(row["ends"], np.int64), plain(row["text"]))
                # Only partitions that the block has keys for: never more rows than keys.
                full, cuts = np.unique(found >> np.uint64(64 - bits), return_index=True)
                full, ends = full.tolist(), np.append(cuts[1:], len(found)).tolist()
                spans = list(zip(cuts.tolist(), ends))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([row["block"]] * len(full)), pa.array(full, pa.int32()), pa.array([pack(found[a:b], True) for a, b in spans], pa.binary()), pa.array([[pack(v[a:b]) for v in values] for a, b in spans], pa.list_(pa.binary()))],
                    names=["block", "part", "keys", "values"],
                )

    def answer(table: pa.Table) -> pa.Table:
        rows = table.select(["block", "part", "keys", "values"]).to_pylist()
        each = [unpack(r["keys"], np.uint64, True) for r in rows]
        lengths = [len(x) for x in each]
        every = np.concatenate(each)
        order = np.argsort(every, kind="stable")
        ordered = every[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        combined = combine(order, starts, [np.concatenate([unpack(r["values"][i], t) for r in rows]) for i, t in enumerate(value_types)])
        back = np.empty(len(every), answer_type)
        back[order] = np.repeat(combined.astype(answer_type), np.diff(np.append(starts, len(every))))
        ends = np.cumsum(lengths)
        return pa.table({"block": [r["block"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int32()), "answer": pa.array([pack(back[e - n : e]) for e, n in zip(ends, lengths)], pa.binary())})

    sent = blocks.mapInArrow(send, "block string, part int, keys binary, values array<binary>")
    return sent.groupBy("part").applyInArrow(answer, "block string, part int, answer binary")


def with_answers(blocks: DataFrame, answers: DataFrame, finish: Callable, answer_type, schema: str) -> DataFrame:
    """Rows that ``finish(ids, ends, text, answers)`` makes of each block and the answers to its keys, as a pa.Table."""

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        parts = sorted(zip(right["part"].to_pylist(), right["answer"].to_pylist())) if right.num_rows else []
        found = np.concatenate([unpack(a, answer_type) for _, a in parts]) if parts else np.zeros(0, answer_type)
        return finish(row["ids"], np.array(row["ends"], np.int64), plain(row["text"]), found)

    return blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(run, schema)
