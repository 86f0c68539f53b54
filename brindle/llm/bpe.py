"""Byte-level BPE encoding and decoding by DuckDB recursive queries, in each partition.

Texts are split by the tokenizer's pattern, the distinct words of a batch become token-position rows, and a recursive
query joins them with the merge table: in each step every word contracts its leftmost pair of least rank, until no
word has a pair left. An ordered aggregation gathers the ids of each word and, over the same rows joined with the
vocabulary, its decoded bytes; another one, over the words of a document by their place, decodes the document.

A word that is a token as a whole is looked up, as the library does. Words of over 64 bytes contract, in each step, all
pairs of the least rank, from the left, so that steps follow the number of different ranks rather than the length. That
is the same result: in a vocabulary that was trained by merges, a contraction makes no pair of a lower rank than its own
(the pair's parts would have met before).
Documents never move; a task holds one slice of texts, the distinct words of it and a bounded cache of words.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import carried

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
_CLASSES: list[np.ndarray] = []


def _classes() -> np.ndarray:
    """Class of each code point, by the definitions that the pattern uses."""
    if not _CLASSES:
        import regex

        out = np.zeros(0x110000, np.uint8)
        points = [*range(0xD800), *range(0xE000, 0x110000)]
        every, at = "".join(map(chr, points)), np.array(points)
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(pattern, every):
                out[at[m.start() : m.end()]] = kind
        _CLASSES.append(out)
    return _CLASSES[0]


def split(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """The words of the texts, one after another, and the number of words of each text.

    The pattern is that of public_tokenizers.PATTERN: contractions, then runs of letters, numbers or others with a
    space before them, then white space, whose last character stands by itself (or before a run) when more follows.
    """
    whole = "".join(texts)
    n = len(whole)
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    if not n:
        return pa.array([], pa.binary()), np.zeros(len(texts), np.int64)
    points = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    kind = _classes()[points]
    ends = np.cumsum(sizes)
    opens = np.zeros(n + 1, bool)  # first characters of texts, and the end of all
    opens[0] = opens[ends] = True
    edge = opens.copy()
    edge[1:n] |= kind[1:] != kind[:-1]
    space, blank = kind == _SPACE, points == 32
    start = edge[:n].copy()
    # A single blank before a run belongs to that run.
    led = np.zeros(n, bool)
    led[1:] = edge[1:n] & ~opens[1:n] & blank[:-1] & ~space[1:]
    start &= ~led
    # The last white space before a run starts a word.
    last = np.zeros(n, bool)
    last[:-1] = space[:-1] & edge[1:n] & ~opens[1:n]
    start |= last
    # Contractions: an apostrophe that is a run by itself, not after a blank, and letters that follow.
    quotes = np.flatnonzero((points == 39) & start & edge[1:] & ~opens[1:])
    if len(quotes):
        pad = np.concatenate([points, np.zeros(3, np.uint32)])
        a, b, inside = pad[quotes + 1], pad[quotes + 2], ~opens[np.minimum(quotes + 2, n)]
        one = np.isin(a, [ord(c) for c in "stmd"])
        two = inside & ((np.isin(a, [ord("r"), ord("v")]) & (b == ord("e"))) | ((a == ord("l")) & (b == ord("l"))))
        quotes, size = quotes[one | two], np.where(one, 1, 2)[one | two]
        start[quotes + 1] = False
        rest = quotes + 1 + size
        rest = rest[rest < n]
        start[rest[(kind[rest] == _LETTER) & ~opens[rest]]] = True
    at = np.flatnonzero(start)
    octets = np.zeros(n + 1, np.int64)
    np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), out=octets[1:])
    offsets = np.append(octets[at], octets[n]).astype(np.int32)
    words = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(whole.encode())])
    counts = np.diff(np.searchsorted(at, np.concatenate([[0], ends])))
    return words, counts


_ENCODE = """
WITH RECURSIVE tokens(k, w, t, live) AS (
  SELECT k, w, t, true FROM start_rows
  UNION ALL
  SELECT CASE WHEN pos < k THEN k - 1 ELSE k END, w, CASE WHEN k = pos THEN merged ELSE t END, pos IS NOT NULL
  FROM (SELECT s.k, s.w, s.t, b.best % 4294967296 AS pos, b.best // 4294967296 AS merged
        FROM tokens s LEFT JOIN (
          SELECT l.w, min(m.merged * 4294967296 + l.k) AS best
          FROM tokens l JOIN tokens r ON r.k = l.k + 1 JOIN merges m ON m.pair = l.t * 4294967296 + r.t
          GROUP BY l.w) b ON b.w = s.w
        WHERE s.live)
  WHERE pos IS NULL OR k <> pos + 1
)
SELECT w, list(t ORDER BY k) AS ids, unhex(string_agg(octets, '' ORDER BY k)) AS decoded
FROM tokens JOIN vocabulary USING (t) WHERE NOT live GROUP BY w
"""


_ENCODE_LONG = """
WITH RECURSIVE tokens(k, w, t, live) AS (
  SELECT k, w, t, true FROM start_rows
  UNION ALL
  SELECT k, w, CASE WHEN taken THEN best ELSE t END, best IS NOT NULL
  FROM (SELECT *, lag(taken, 1, false) OVER (PARTITION BY w ORDER BY k) AS gone
    FROM (SELECT k, w, t, best, coalesce(r = best, false) AND (place - coalesce(max(CASE WHEN r IS DISTINCT FROM best THEN place END) OVER (PARTITION BY w ORDER BY k ROWS UNBOUNDED PRECEDING), 0)) % 2 = 1 AS taken
      FROM (SELECT s.*, m.merged AS r, min(m.merged) OVER (PARTITION BY s.w) AS best
        FROM (SELECT k, w, t, lead(t) OVER (PARTITION BY w ORDER BY k) AS follows, row_number() OVER (PARTITION BY w ORDER BY k) AS place FROM tokens WHERE live) s
        LEFT JOIN merges m ON m.pair = s.t * 4294967296 + s.follows)))
  WHERE NOT gone
)
SELECT w, list(t ORDER BY k) AS ids, unhex(string_agg(octets, '' ORDER BY k)) AS decoded
FROM tokens JOIN vocabulary USING (t) WHERE NOT live GROUP BY w
"""

#: Words are whole code points, so their decoded bytes are text again.
_DECODE = "SELECT d, string_agg(decoded, '' ORDER BY i) AS decoded FROM places JOIN words USING (w) GROUP BY d"


class Bpe:
    """Ranks, merge table and a bounded cache of encoded words, in one worker."""

    cached_words, long_word = 300_000, 64

    def __init__(self, path: str):
        import duckdb

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.pieces = {r: t for t, r in self.ranks.items()}
        self.octets = np.array([self.ranks[bytes([i])] for i in range(256)], np.int64)
        left, right, merged = [], [], []
        for token, rank in self.ranks.items():
            for i in range(1, len(token)):
                a, b = self.ranks.get(token[:i]), self.ranks.get(token[i:])
                if a is not None and b is not None:
                    left.append(a), right.append(b), merged.append(rank)
        self.db = duckdb.connect()
        self.db.execute("SET threads = 1")
        self.db.execute("SET memory_limit = '400MB'")
        self.db.execute("SET temp_directory = ''")
        self.db.register("merges_", pa.table({"pair": np.array(left, np.int64) << 32 | np.array(right, np.int64), "merged": np.array(merged, np.int64)}))
        self.db.execute("CREATE TABLE merges AS SELECT * FROM merges_")
        self.db.register("vocabulary_", pa.table({"t": list(self.pieces), "octets": [t.hex() for t in self.pieces.values()]}))
        self.db.execute("CREATE TABLE vocabulary AS SELECT CAST(t AS BIGINT) AS t, octets FROM vocabulary_")
        self.cache: dict[bytes, tuple[bytes, bytes]] = {}

    def words(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32 bits, decoded bytes) of each."""
        found: dict[bytes, tuple[bytes, bytes]] = {}
        misses = []
        for w in words:
            known = self.cache.get(w)
            if known is not None:
                found[w] = known
            elif w in self.ranks:
                r = self.ranks[w]
                found[w] = r.to_bytes(4, "little"), self.pieces[r]
            else:
                misses.append(w)
        misses.sort(key=len)
        at = 0
        while at < len(misses):  # as many words as have some 300,000 positions
            end, size = at, 0
            while end < len(misses) and size < 300_000 and (len(misses[end]) > self.long_word) == (len(misses[at]) > self.long_word):
                size += len(misses[end])
                end += 1
            part = misses[at:end]
            at = end
            if len(self.cache) + len(part) > self.cached_words:
                self.cache.clear()
            for w, new in zip(part, self._query(part)):
                found[w] = new
                if len(w) <= 32:
                    self.cache[w] = new
        return [found[w] for w in words]

    def _query(self, words: list[bytes]) -> list[tuple[bytes, bytes]]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        owner = np.repeat(np.arange(len(words)), sizes)
        # Positions are dense within a word and leave a gap before the next one.
        rows = pa.table({"k": np.arange(len(owner)) + owner, "w": owner, "t": self.octets[np.frombuffer(b"".join(words), np.uint8)]})
        self.db.register("start_rows", rows)
        out = self.db.sql(_ENCODE_LONG if len(words[0]) > self.long_word else _ENCODE).to_arrow_table().combine_chunks()
        self.db.unregister("start_rows")
        order = np.argsort(out["w"].to_numpy())
        lists = out["ids"].combine_chunks() if isinstance(out["ids"], pa.ChunkedArray) else out["ids"]
        flat, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4").tobytes(), lists.offsets.to_numpy() * 4
        decoded = out["decoded"].cast(pa.binary()).to_pylist()
        return [(flat[ends[i] : ends[i + 1]], decoded[i]) for i in order.tolist()]

    def encode(self, texts: list[str]) -> list[tuple[np.ndarray, bytes]]:
        """(ids, decoded bytes) of each text."""
        words, counts = split(texts)
        coded = words.dictionary_encode()
        known = self.words(coded.dictionary.to_pylist())
        at = coded.indices.to_numpy()

        if not len(at):
            return [(np.zeros(0, "<u4"), b"") for _ in texts]
        flat = np.frombuffer(b"".join(k[0] for k in known), "<u4")
        sizes = np.fromiter((len(k[0]) // 4 for k in known), np.int64, len(known))
        each = sizes[at]
        offsets = np.concatenate([[0], np.cumsum(each)])
        ids = flat[np.arange(offsets[-1]) + np.repeat((np.cumsum(sizes) - sizes)[at] - offsets[:-1], each)]
        self.db.register("places", pa.table({"d": np.repeat(np.arange(len(texts)), counts), "i": np.arange(len(at)), "w": at.astype(np.int64)}))
        self.db.register("words", pa.table({"w": np.arange(len(known)), "decoded": pa.array([k[1] for k in known], pa.binary()).cast(pa.string())}))
        told = self.db.sql(_DECODE).fetchall()
        self.db.unregister("places"), self.db.unregister("words")
        decoded = {d: x.encode() for d, x in told}
        bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
        return [(ids[offsets[a] : offsets[b]], decoded.get(d, b"")) for d, (a, b) in enumerate(zip(bounds, bounds[1:]))]


_BPES: dict[str, Bpe] = {}


def bpe(path: str) -> Bpe:
    if path not in _BPES:
        _BPES[path] = Bpe(path)
    return _BPES[path]


def forget() -> None:
    """Drop what this worker keeps between tasks, for operators that need the memory; it is made again when asked for."""
    while _BPES:
        _BPES.popitem()[1].db.close()


RESULTS = {
    "n_tokens": (T.LongType(), lambda ids, octets: len(ids)),
    "ids": (T.ArrayType(T.IntegerType()), lambda ids, octets: ids.tolist()),
    "decoded": (T.StringType(), lambda ids, octets: octets.decode("utf-8", "replace")),
    "ids_sha256": (T.StringType(), lambda ids, octets: hashlib.sha256(ids.tobytes()).hexdigest()),
    "decoded_sha256": (T.StringType(), lambda ids, octets: hashlib.sha256(octets).hexdigest()),
}
_ARROW = {"n_tokens": pa.int64(), "ids": pa.list_(pa.int32()), "decoded": pa.string(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}


def encode(docs: DataFrame, ranks_path: str, *, id_col: str = "doc_id", text_col: str = "text", results: tuple[str, ...] = ("n_tokens", "ids", "decoded"), slice_bytes: int = 4 << 20, carry: bool = False) -> DataFrame:
    """Token ids of each whole text and the text decoded from them.

    ``results`` names columns of RESULTS. ``ranks_path`` is a rank file that all executors can open (it is installed
    with the tokenizers). Returns doc_id and these; with ``carry`` also doc, a struct of all input columns.

    A null text is empty: no tokens, decoded to ''. Special tokens are never made. One row for each input row; extra
    columns, also such as are named like results, stay inside doc or are left out.
    """
    df = carried(docs, id_col, text_col, carry)
    schema = T.StructType([f for f in df.schema if f.name != "text"] + [T.StructField(r, RESULTS[r][0]) for r in results])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bpe(ranks_path)
        for batch in batches:
            at = batch.schema.names.index("text")
            sizes = np.diff(np.frombuffer(batch.column(at).cast(pa.large_binary()).buffers()[1], np.int64)[batch.column(at).offset :][: batch.num_rows + 1]) if batch.num_rows else []
            begin = 0
            while begin < batch.num_rows:
                end, total = begin, 0
                while end < batch.num_rows and (end == begin or total + sizes[end] <= slice_bytes):
                    total += sizes[end]
                    end += 1
                part = batch.slice(begin, end - begin)
                begin = end
                found = model.encode([x or "" for x in part.column(at).to_pylist()])
                new = [pa.array([RESULTS[r][1](*x) for x in found], _ARROW[r]) for r in results]
                cols = [c for i, c in enumerate(part.columns) if i != at]
                yield pa.RecordBatch.from_arrays([*cols, *new], names=[n for n in part.schema.names if n != "text"] + list(results))

    return df.mapInArrow(run, schema)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return encode(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), results=("n_tokens", "ids_sha256", "decoded_sha256"))
