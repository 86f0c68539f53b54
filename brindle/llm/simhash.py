"""SimHash near-dedup by deletion-variant signatures.

Fingerprints of 64 bits are cut into two segments of 32. Fingerprints that differ by at most two bits (three, even)
have a segment that differs by at most one, so each segment is indexed by itself and by its one-wildcard variants: the
segment with one bit deleted, and which. An equality join finds the candidates, for a variant those with the other
value of the deleted bit, and the bits that differ verify them.

Where many fingerprints share an entry, pairs would grow with the square of their number. Members of such a bucket
differ by at most the deleted bit in this segment, so their links are found by deleting bits of the other segment too:
fingerprints that agree in all but two bits of the 64 are within two bits of each other, all of them, and linking each
to the smallest loses no connection. That takes at most some 3,000 rows for a fingerprint, whatever a bucket's size.

Only distinct fingerprints are compared. Components come from links between them, and documents get theirs by
fingerprint, so copies are never expanded into pairs.

Texts of a high shingle similarity can be many bits apart, so ``similarity`` adds links by the shingles themselves
(``similar``). Sets whose Jaccard similarity is at least t share one of their first n - ceil(t n) + 1
shingles in any one order of all shingles: an equality join over these finds every such pair. The order is by how many
texts have a shingle, rare ones first, as counted in cells of fixed number, so that texts seldom meet by a common phrase. Parity sketches of a bit or so for each shingle, which bound the
similarity from above, rule most of the others out, and whole sets verify what is left. Buckets of over 32 sets are taken apart by pivots: Jaccard distance is a metric, so of the sets at distance d <= 1 -
t of the pivot, which are linked to it, only those are compared with others that are at most d + 1 - t away from it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import pack, unpack
from .bpe import forget
from .common import bit_filter, carried, connected_components, cut, heavy_keys, passing, remove_path

_BITS, _HALF, _LOW = 64, 32, (1 << 32) - 1


def shingle_hashes(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of a text's shingles, repeats included."""
    from xxhash import xxh64_intdigest as digest

    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    last = ends[shingle - 1 :] if len(words) >= shingle else ends[-1:]
    return np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts.tolist(), last.tolist())), np.uint64, len(last))


def print_of(hashes: np.ndarray) -> int:
    """Signed 64-bit fingerprint: bit b is set if it is set in over half of the hashes; 0 without any."""
    total = np.zeros(_BITS, np.int64)
    for at in range(0, len(hashes), 65536):
        part = hashes[at : at + 65536].astype("<u8")
        total += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > len(hashes), bitorder="little").view("<i8")[0]) if len(hashes) else 0


def fingerprint(text: bytes, shingle: int, seed: int) -> int:
    return print_of(shingle_hashes(text, shingle, seed))


def fingerprints(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, seed: int = 42, carry: bool = False) -> DataFrame:
    """doc_id and fp (a signed long) for each row, or doc, doc_id and fp.

    A-Z are lower-cased; words are runs of other than ASCII white space, shingles are space-joined, repeats count. A
    text of fewer words than a shingle is one shingle; one without words, or null, has fingerprint 0.
    """
    df = carried(docs, id_col, text_col, carry)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.names.index("text")
            found = [fingerprint(x.as_py() or b"", shingle, seed) for x in batch.column(at).cast(pa.binary())]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(found, pa.int64())], names=[n for n in batch.schema.names if n != "text"] + ["fp"])

    return df.mapInArrow(run, T.StructType([f for f in df.schema if f.name != "text"] + [T.StructField("fp", T.LongType())]))


def shingle_set(text: bytes, shingle: int, seed: int) -> np.ndarray:
    """Hashes of the distinct shingles of a text, sorted; those that ``fingerprint`` counts."""
    return np.unique(shingle_hashes(text, shingle, seed).view(np.int64))


#: Bits of a hash that name its cell, and parts in which cells are summed.
_CELL_BITS, _CELL_PARTS = 23, 64


def _grade(counts: np.ndarray) -> np.ndarray:
    """Counts as bytes that keep their order: as they are up to 127, by eighths of a doubling from there."""
    return np.where(counts < 128, counts, np.minimum(127 + 8 * np.log2(np.maximum(counts, 127) / 127), 255)).astype(np.uint8)


def rarity(texts: DataFrame, shingle: int, seed: int) -> np.ndarray:
    """For each cell of shingle hashes a byte that grows with the number of texts (the last column) that have such a shingle."""
    cells = 1 << _CELL_BITS

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        total = np.zeros(cells, np.uint32)
        for batch in batches:
            for x in batch.column(batch.num_columns - 1).cast(pa.binary()):
                np.add.at(total, shingle_set(x.as_py() or b"", shingle, seed) & (cells - 1), 1)
        if total.any():
            packed = [pack(part) for part in np.split(total, _CELL_PARTS)]
            yield pa.RecordBatch.from_arrays([pa.array(range(_CELL_PARTS), pa.int32()), pa.array(packed, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(cells // _CELL_PARTS, np.int64)
        for x in table["counts"]:
            total += unpack(x.as_py(), np.uint32)
        return pa.table({"part": table["part"][:1], "grades": pa.array([_grade(total).tobytes()], pa.binary())})

    out = np.zeros((_CELL_PARTS, cells // _CELL_PARTS), np.uint8)
    for row in texts.mapInArrow(count, "part int, counts binary").groupBy("part").applyInArrow(add, "part int, grades binary").toLocalIterator():
        out[row.part] = np.frombuffer(row.grades, np.uint8)
    return out.reshape(-1)


def _prefix(n: int, percent: int) -> int:
    return n - -(-n * percent // 100) + 1


def parity(hashes: np.ndarray) -> np.ndarray:
    """Bit b is set if an odd number of the hashes fall on b: two sketches differ in at most as many bits as the sets in members.

    There are 1024 bits, or the power of two that the number of hashes needs. A sketch folds to half its size by XOR.
    """
    bits = 1 << max(10, (len(hashes) - 1).bit_length())
    odd = np.bincount(hashes & (bits - 1), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").view("<i8")


def _sets(docs: DataFrame, shingle: int, seed: int, percent: int | None) -> DataFrame:
    """(..., fp, sid, n, sketch, hashes) for each row of docs, whose last column is text: sid names the set of shingles, n is its size.

    hashes is the prefix for ``percent``, rare shingles first; without that it is the whole set.
    """
    from xxhash import xxh64_intdigest as digest

    grades = None if percent is None else docs.sparkSession.sparkContext.broadcast(rarity(docs, shingle, seed))

    added = [("fp", T.LongType(), pa.int64()), ("sid", T.LongType(), pa.int64()), ("n", T.IntegerType(), pa.int32())]
    added += [(name, T.ArrayType(T.LongType()), pa.list_(pa.int64())) for name in ("sketch", "hashes")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forget()
        for batch in batches:
            rows = []
            for x in batch.column(batch.num_columns - 1).cast(pa.binary()):
                every = shingle_hashes(x.as_py() or b"", shingle, seed)
                hashes = np.unique(every.view(np.int64))
                sid = np.uint64(digest(hashes.tobytes(), seed)).view(np.int64)
                sent = hashes
                if grades is not None and len(hashes):
                    sent = hashes[np.argsort(grades.value[hashes & (len(grades.value) - 1)], kind="stable")[: _prefix(len(hashes), percent)]]
                rows.append((print_of(every), sid, len(hashes), parity(hashes), sent))
            found = [pa.array([r[i] for r in rows], kind) for i, (_, _, kind) in enumerate(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], *found], names=[*batch.schema.names[:-1], *(name for name, _, _ in added)])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields[:-1], *[T.StructField(name, kind) for name, kind, _ in added]]))


def text_hash(text) -> list:
    """128 bits that tell texts apart, as two columns."""
    return [F.xxhash64(F.coalesce(text, F.lit(""))).alias("h"), F.xxhash64(F.lit(1), F.coalesce(text, F.lit(""))).alias("g")]


def _both(pairs: DataFrame, side: DataFrame, column: str) -> DataFrame:
    """``pairs`` (a, b, ...) with na, nb, _a and _b: the size and ``column`` of each of the two sets.

    The few sets b that very many pairs share, pivots mostly, are dealt to 64 tasks each.
    """
    hot, _ = cut(heavy_keys(pairs.groupBy("b").agg(F.count("*").alias("n")), 1000).where("n > 1000").select("b", F.lit(64).alias("ways")), "shingle-hubs")
    of = lambda c: side.select(F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col(column).alias(f"_{c}"))
    ways = lambda df: df.join(F.broadcast(hot), "b", "left").withColumn("ways", F.coalesce("ways", F.lit(1)))
    dealt = ways(pairs.join(of("a"), "a")).withColumn("way", F.pmod("a", "ways").cast("int")).drop("ways")
    copies = ways(of("b")).withColumn("way", F.explode(F.sequence(F.lit(0), F.col("ways") - 1))).drop("ways")
    return dealt.join(copies, ["b", "way"]).drop("way")


def _least(pairs: DataFrame, sketches: DataFrame, percent: int) -> DataFrame:
    """``pairs`` with d, at most their distance, and maybe: whether that leaves a similarity of ``percent`` open.

    Sets differ in at least as many members as their sketches in bits, so the sizes bound what both share.
    """
    both = _both(pairs, sketches, "sketch")
    words = F.least(F.size("_a"), F.size("_b"))
    word = lambda x, i: F.get(x, i).bitwiseXOR(F.when(F.size(x) > words, F.get(x, i + words)).otherwise(F.lit(0).cast("long")))
    bits = F.aggregate(F.sequence(F.lit(0), words - 1), F.lit(0), lambda t, i: t + F.bit_count(word("_a", i).bitwiseXOR(word("_b", i))))
    # Sets of which one is more than twice as large are told apart by their sizes.
    bits = F.when(F.greatest(F.size("_a"), F.size("_b")) <= 2 * words, bits).otherwise(0)
    twice, size = F.col("twice"), F.col("na") + F.col("nb")
    both = both.withColumn("twice", F.least(size - bits, 2 * F.least("na", "nb")))
    return both.select(*pairs.columns, (1 - twice / (2 * size - twice)).alias("d"), (twice * 100 >= percent * (2 * size - twice)).alias("maybe"))


def _exact(pairs: DataFrame, texts: DataFrame, once: DataFrame, shingle: int, seed: int, percent: int) -> DataFrame:
    """``pairs`` with near and d, by their whole sets; only texts of these pairs are taken apart again."""
    wanted = pairs.select("a").unionByName(pairs.select(F.col("b").alias("a"))).distinct().join(once.withColumnRenamed("sid", "a"), "a")
    wanted, _ = cut(wanted.select(F.col("a").alias("sid"), "of.h", "of.g"), "shingle-wanted")
    again = passing(texts, bit_filter(wanted.select(F.col("h").alias("no"))), F.col("h"))
    whole = _sets(again, shingle, seed, None).join(wanted, ["sid", "h", "g"], "left_semi").dropDuplicates(["sid"]).select("sid", "n", "hashes")
    sets, path = cut(whole, "shingle-sets")
    both = _both(pairs, sets, "hashes").withColumn("o", F.size(F.array_intersect("_a", "_b")))
    union = F.col("na") + F.col("nb") - F.col("o")
    out, _ = cut(both.select(*pairs.columns, (F.col("o") * 100 >= percent * union).alias("near"), (1 - F.col("o") / union).alias("d")), "shingle-exact")
    remove_path(pairs.sparkSession, path)
    return out


def similar(docs: DataFrame, *, text_col: str = "text", shingle: int = 5, seed: int = 42, percent: int = 80, bucket: int = 32, rounds: int = 8, prefixes: DataFrame | None = None) -> DataFrame:
    """(a, b), b < a: fingerprints of texts whose shingle sets have a Jaccard similarity of at least ``percent``, enough to keep every connection.

    Results mean the same for any ``bucket`` and ``rounds``: what the pivots leave in a large bucket is compared in pairs, whose number grows with its square.
    ``prefixes`` is what a pass over the texts has found already (h, g, fp, sid, n, sketch and hashes of each, of ``_sets``).
    """
    texts = docs.select(*text_hash(F.col(text_col).cast("string")), F.col(text_col).cast("string").alias("text"))
    if prefixes is None:
        prefixes, _ = cut(_sets(texts, shingle, seed, percent), "shingle-prefixes")
    prefixes = prefixes.where("n > 0")
    # Each set once, through one of its texts. A key's place tells how many shingles can still be shared after it.
    once = prefixes.groupBy("sid").agg(F.min(F.struct("h", "g")).alias("of"))
    once, _ = cut(once, "shingle-sets-once")
    first = prefixes.join(once.select("sid", "of.h", "of.g"), ["sid", "h", "g"]).dropDuplicates(["sid"])
    first, _ = cut(first.select("sid", "n", "sketch", "hashes"), "shingle-first")
    sketches = first.select("sid", "n", "sketch")
    index = first.select("sid", "n", F.posexplode("hashes").alias("at", "key"))
    hot, _ = cut(heavy_keys(first.sample(1 / 64, seed=1).select(F.explode("hashes").alias("key")).groupBy("key").agg(F.count("*").alias("n")), 1000).where("n > 32"), "shingle-hot")
    dealt = index.join(F.broadcast(hot.select("key", F.lit(True).alias("hot"))), "key", "left")
    dealt = dealt.select("key", "sid", "n", "at", F.when(F.col("hot"), F.pmod("sid", F.lit(64))).otherwise(-1).cast("byte").alias("deal"))
    dealt = dealt.repartition("key", "deal")  # the one shuffle of the index; both uses below read it
    shared = dealt.groupBy("key", "deal").agg(F.min("sid").alias("low"), F.max("sid").alias("high")).where("deal >= 0 OR low < high").select("key", "deal")
    members, _ = cut(dealt.join(shared.hint("merge"), ["key", "deal"]).select("key", "sid", "n", "at"), "shingle-shared")
    # What is found is written round by round, so that no plan grows with the rounds; they end when they take little away.
    # Both sets of a pair hold all that they share from the first shingle on that they share, so a pair is looked for at
    # places that leave enough. In the smaller set that is an early place (of one that can pair with a set as large).
    early = (F.col("n") - F.col("at")) * (100 + percent) >= 2 * percent * F.col("n")
    found, left, more, before = [], members, None, None
    for i in range(rounds + 1):
        sizes = left.groupBy("key").agg(F.count("*").alias("size"), F.count(F.when(early, 1)).alias("early"), F.min("sid").alias("pivot"))
        sized = left.join(sizes.where("size > 1 AND early > 0"), "key")
        many = F.col("early") * F.col("size") > bucket * bucket
        large = sized.where(many)
        now = large.count()
        last = i == rounds or now == 0 or before is not None and 4 * now > 3 * before
        before = now
        # Pairs by the key; those that sizes and places rule out are left out.
        small = sized if last else sized.where(~many)
        of = lambda c: small.select("key", F.col("sid").alias(c), F.col("n").alias(f"n{c}"), F.col("at").alias(f"p{c}"), early.alias(f"e{c}"))  # noqa: E731, B023
        pairs = of("a").join(of("b").where(F.col("eb")), "key").where("na > nb OR na = nb AND a > b")
        fits = F.least("na", "nb") * 100 >= percent * F.greatest("na", "nb")
        room = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
        fits = fits & (room * (100 + percent) >= percent * (F.col("na") + F.col("nb")))
        pairs = pairs.where(fits).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
        pairs, _ = cut(pairs, "shingle-pairs")
        pairs, _ = cut(_least(pairs, sketches, percent).where("maybe").select("a", "b"), "shingle-maybe")
        more = pairs if more is None else more.unionByName(pairs)
        if last:
            break
        to_pivot = large.where("sid != pivot").select(F.col("sid").alias("a"), F.col("pivot").alias("b")).distinct()
        to_pivot, _ = cut(_least(to_pivot, sketches, percent), "shingle-pivots")
        # A bound will do for the distance of those that can't be linked to the pivot.
        sure = _exact(to_pivot.where("maybe").select("a", "b"), texts, once, shingle, seed, percent)
        to_pivot = sure.unionByName(to_pivot.where("NOT maybe").select("a", "b", F.lit(False).alias("near"), "d"))
        found.append(to_pivot.where("near").select("a", "b"))
        measured = large.where("sid != pivot").join(to_pivot.select(F.col("a").alias("sid"), F.col("b").alias("pivot"), "near", "d"), ["sid", "pivot"])
        ring = measured.where(~F.col("near")).select("key", F.col("sid").alias("b"), F.col("n").alias("nb"), F.col("at").alias("pb"), F.col("d").alias("db"))
        inner = measured.where("near").select("key", F.col("sid").alias("a"), F.col("n").alias("na"), F.col("at").alias("pa"), F.col("d").alias("da"))
        crossed = inner.join(ring, "key").where(fits & (F.col("db") <= F.col("da") + (100 - percent) / 100 + 1e-9))
        crossed, _ = cut(crossed.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "shingle-crossed")
        crossed, _ = cut(_least(crossed, sketches, percent).where("maybe").select("a", "b"), "shingle-maybe")
        more = more.unionByName(crossed)
        left, _ = cut(measured.where(~F.col("near")).select("key", "sid", "n", "at"), "shingle-left")
    more, _ = cut(more.distinct(), "shingle-candidates")
    pairs = _exact(more, texts, once, shingle, seed, percent).where("near").select("a", "b")
    for x in found:
        pairs = pairs.unionByName(x)
    # Repeats count for fingerprints, so one set can have several; rows of one fingerprint are linked anyhow.
    prints = prefixes.select("fp", "sid").distinct()
    lowest = prints.groupBy("sid").agg(F.min("fp").alias("low"))
    same = prints.join(lowest, "sid").select(F.col("fp").alias("a"), F.col("low").alias("b"))
    name = lambda c: lowest.select(F.col("sid").alias(c), F.col("low").alias(f"f{c}"))
    every = same.unionByName(pairs.join(name("a"), "a").join(name("b"), "b").select(F.col("fa").alias("a"), F.col("fb").alias("b"))).where("a != b")
    return every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _halves(fp) -> tuple:
    """The two segments, with their numbers."""
    return ((0, F.shiftrightunsigned(fp, _HALF)), (1, fp.bitwiseAND(F.lit(_LOW))))


#: A packed entry: side (0 or 1, the deleted bit; 2 for a whole segment) | kind | deleted bit | what is left.
_SIDE, _KIND, _BIT = 60, 37, 32
#: Fingerprints whose entries one task makes.
_DEALT = 1 << 13


def _entries(segment, number: int) -> list:
    """The segment itself and its variants: one long each."""

    def variant(i: int):
        kept = F.shiftleft(F.shiftrightunsigned(segment, i + 1), i).bitwiseOR(segment.bitwiseAND(F.lit((1 << i) - 1)))
        side = F.shiftleft(F.shiftright(segment, i).bitwiseAND(F.lit(1).cast("long")), _SIDE)
        return F.lit((number << _KIND) | (i << _BIT)).bitwiseOR(kept).bitwiseOR(side)

    return [F.lit((2 << _SIDE) | ((2 + number) << _KIND)).bitwiseOR(segment), *[variant(i) for i in range(_HALF)]]


def links(prints: DataFrame, *, max_bits: int = 2, bucket: int = 32) -> DataFrame:
    """(a, b) between distinct fingerprints, b < a, within ``max_bits`` (0 to 2): enough of them to keep every connection.

    ``prints`` is one column of distinct longs, fp. All pairs of a bucket of up to ``bucket`` members are compared;
    larger buckets are linked by two-wildcard signatures. Results mean the same for any ``bucket``.
    """
    if not 0 <= max_bits <= 2:
        raise ValueError("two segments find up to two differing bits here")
    fp = F.col("fp")
    if max_bits == 0:
        return prints.select(fp.alias("a"), fp.alias("b")).where(F.lit(False))
    # A task makes 66 entries of each of its fingerprints and holds their counts, so tasks follow the fingerprints, not the files.
    prints = prints.repartition(prints.count() // _DEALT + 1, "fp")
    entries = F.array(*[e for number, segment in _halves(fp) for e in _entries(segment, number)])
    index = prints.select("fp", F.explode(entries).alias("e")).select("fp", F.col("e").bitwiseAND(F.lit((1 << _SIDE) - 1)).alias("key"), F.shiftright("e", _SIDE).cast("byte").alias("side"))
    sizes = index.groupBy("key").agg(F.count("*").alias("n"), F.min("side").alias("low"), F.max("side").alias("high"))
    sizes = sizes.where((F.col("n") > 1) & ((F.col("low") == 2) | (F.col("low") < F.col("high")))).select("key", "n")
    # Spark takes an exploded side for as small as what it is exploded from, and would send all entries to the driver to broadcast them.
    shared, _ = cut(index.join(sizes.hint("merge"), "key"), "simhash-shared")
    groups = shared.where(F.col("n") <= bucket).groupBy("key").agg(F.collect_list(F.struct("fp", "side")).alias("m"))
    other = lambda y: F.when(F.col("x.side") == 2, y["fp"] < F.col("x.fp")).otherwise((F.col("x.side") == 1) & (y["side"] == 0))
    pairs = groups.select("m", F.explode("m").alias("x")).select(F.col("x.fp").alias("a"), F.explode(F.transform(F.filter("m", other), lambda y: y["fp"])).alias("b"))
    pairs = pairs.where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= max_bits)

    # A large bucket's links: the deleted bit and one of the other segment, or with this segment whole two of the other.
    kind, bit = F.shiftright("key", _KIND), F.shiftright("key", _BIT).bitwiseAND(F.lit(31)).cast("int")
    large = shared.where(F.col("n") > bucket).select("fp", kind.alias("kind"), bit.alias("bit"))
    base = F.when(F.col("kind") % 2 == 0, F.lit(0)).otherwise(F.lit(32))
    hot = large.where(F.col("kind") < 2).select("fp", F.when(F.col("kind") == 0, F.col("bit") + 32).otherwise(F.col("bit")).alias("bit"), base.alias("base"))
    inner = large.where(F.col("kind") >= 2).select("fp", base.alias("base"))
    mask = lambda *bits: F.bitwise_not(_or([F.call_function("shiftleft", F.lit(1).cast("long"), b) for b in bits]))
    signature = lambda i, j: F.struct(F.least(i, j).alias("i"), F.greatest(i, j).alias("j"), fp.bitwiseAND(mask(i, j)).alias("rest"))
    crossed = hot.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: signature(F.col("bit"), F.col("base") + j))).alias("s"))
    if max_bits == 2:
        inside = F.flatten(F.transform(F.sequence(F.lit(1), F.lit(31)), lambda j: F.transform(F.sequence(F.lit(0), j - 1), lambda i: signature(F.col("base") + i, F.col("base") + j))))
        signatures = crossed.unionByName(inner.select("fp", F.explode(inside).alias("s")))
    else:  # one bit in all: deleting just that one
        signatures = hot.select("fp", signature(F.col("bit"), F.col("bit")).alias("s")).unionByName(inner.select("fp", F.explode(F.transform(F.sequence(F.lit(0), F.lit(31)), lambda j: signature(F.col("base") + j, F.col("base") + j))).alias("s")))
    signatures = signatures.select("fp", "s.*")
    lowest = signatures.groupBy("i", "j", "rest").agg(F.min("fp").alias("b"), F.max("fp").alias("top")).where("b < top").drop("top")
    stars = signatures.join(lowest.hint("merge"), ["i", "j", "rest"]).where(F.col("fp") != F.col("b")).select(F.col("fp").alias("a"), "b")
    every = pairs.unionByName(stars)
    return every.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _or(cols: list):
    out = cols[0]
    for c in cols[1:]:
        out = out.bitwiseOR(c)
    return out


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, max_bits: int = 2, seed: int = 42, bucket: int = 32, percent: int | None = None, set_bucket: int = 32, carry: bool = False) -> DataFrame:
    """doc_id, fp, component, component_id for each row.

    Rows are linked within ``max_bits``, and with ``percent`` also from that Jaccard similarity of shingles on.

    component is the component's smallest fingerprint; component_id the smallest doc_id in it, the row's own included.

    Rows with equal fingerprints, texts without words among them, are linked. A null doc_id counts as larger than any
    other; a component of null ids alone has a null component_id. Rows of one id are rows of their own. Extra columns
    stay inside doc (with ``carry``) or are left out. An empty table gives none.
    """
    text = F.col(text_col).cast("string")
    narrow = docs.select(F.col(id_col).alias("doc_id"), *text_hash(text), text.alias("text"))
    if percent is None:
        prints = fingerprints(narrow, shingle=shingle, seed=seed)
        prints, _ = cut(prints, "simhash-prints")
    else:
        prints, _ = cut(_sets(narrow, shingle, seed, percent), "simhash-prints")
    first = prints.groupBy("fp").agg(F.min("doc_id").alias("first"))
    first, _ = cut(first, "simhash-distinct")
    edges = links(first.select("fp"), max_bits=max_bits, bucket=bucket)
    if percent is not None:
        edges = edges.unionByName(similar(docs, text_col=text_col, shingle=shingle, seed=seed, percent=percent, bucket=set_bucket, prefixes=prints))
    nodes = connected_components(edges, "simhash")
    groups = first.join(nodes.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "first", F.coalesce("component", "fp").alias("component"))
    lowest = groups.groupBy("component").agg(F.min("first").alias("component_id"))
    named = groups.join(lowest, "component").select("fp", "component", "component_id")
    if not carry:
        return prints.join(named, "fp").select("doc_id", "fp", "component", "component_id", *(["h", "g"] if percent is not None else []))
    # With whole rows, fingerprints are computed again rather than written with the rows.
    rows = fingerprints(docs, id_col=id_col, text_col=text_col, shingle=shingle, seed=seed, carry=True)
    return rows.join(named, "fp").select("doc", "doc_id", "fp", "component", "component_id")


def deduplicate(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = 80, **options) -> DataFrame:
    """The rows of ``docs``, with their columns, of which each component of near duplicates keeps one.

    That is the row of the smallest id (null ids last), of rows of one id that whose text has the smallest hash, and one
    of rows that are equal in both. Options are those of ``near_duplicates``. Rows that are alone stay where they are;
    only the others are shuffled.
    """
    found, _ = cut(near_duplicates(docs, id_col=id_col, text_col=text_col, percent=percent, **options), "simhash-found")
    order = F.struct(F.col("doc_id").isNull().alias("z"), "doc_id", "h", "g")
    best = found.groupBy("component").agg(F.min(order).alias("best"), F.count("*").alias("n")).where("n > 1")
    best, _ = cut(best.select("component", "best"), "simhash-best")
    several = found.join(best.select("component"), "component", "left_semi")
    rows = docs.withColumns({"_h": text_hash(F.col(text_col).cast("string"))[0], "_g": text_hash(F.col(text_col).cast("string"))[1]})
    key = lambda i, h: F.xxhash64(i, h)
    filled = bit_filter(several.select(key("doc_id", "h").alias("no")))
    # Of rows that share an id and a text all belong to one component; the first of them stays.
    chosen = best.select(F.col("best.doc_id").alias("_i"), F.col("best.h").alias("_bh"), F.col("best.g").alias("_bg"), F.lit(True).alias("_stays")).dropDuplicates(["_i", "_bh", "_bg"])
    known = several.select(F.col("doc_id").alias("_i"), F.col("h").alias("_bh"), F.col("g").alias("_bg")).distinct().join(chosen.withColumnsRenamed({"_i": "_ci", "_bh": "_ch", "_bg": "_cg"}), F.expr("_i <=> _ci AND _bh = _ch AND _bg = _cg"), "left").select("_i", "_bh", "_bg", F.coalesce("_stays", F.lit(False)).alias("_stays"))
    at = key(id_col, "_h")
    touched = passing(rows, filled, at).join(known, F.col(id_col).eqNullSafe(F.col("_i")) & (F.col("_h") == F.col("_bh")) & (F.col("_g") == F.col("_bg")), "left")
    # What the filter lets through in vain is in no component of several rows, so no other row equals it.
    kept = touched.where(F.coalesce("_stays", F.lit(True))).dropDuplicates([id_col, "_h", "_g"])
    return passing(rows, filled, at, inside=False).select(*docs.columns).unionByName(kept.select(*docs.columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), shingle=3)
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
