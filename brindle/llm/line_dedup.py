"""Line dedup by a segment-partition edit join, by DataFrame functions alone.

Lines that are equal, or within some edits (a character replaced, inserted or deleted), form classes; of each class the
first line in order of (doc_id, line number) stays and the others go from their documents. The edits allowed grow with
the length of the shorter line, in steps (``EDITS``): short lines have to be equal.

With a threshold of k a line is cut into k + 1 segments, half of them counted from its start, the others from its end. Of
k edits, one of these two parts has fewer than it has segments, so it has a segment i that stands in the other line too,
at most i characters away from its place as counted from that end. The index has the length of a line, the number of the
segment and the segment; lines probe it for their own length and those up to k shorter, at the places where segments can
be. Candidates
are verified by a banded bit-parallel edit distance: 2k + 1 diagonals, a machine word of matches for each character.

The index travels once. An entry that many lines share would yield pairs by the square. With a threshold of one its
lines meet by cutouts of one character, in rows by the length of a line. With a larger one it is taken apart by pivots:
edit distance is a metric, so lines within k edits of the pivot are linked to it, and of the others only such can be near
them as are at most k farther from it. Those, and what pivots leave, meet by their k + 1 rarest segments. Entries that hold
a thousandth of a sample are dealt over several tasks.

Texts stay where they are: lines travel as digests and keys. Only the texts of candidates move, and at the end the
documents that lose lines; filters of fixed size tell the others before the shuffle, and what they let through in vain
drops out in the join. Lines that very many rows share are few, so they are broadcast (``HEAVY`` at most).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import anti_heavy, bit_filter, carried, connected_components, cut, heavy_keys, passing

#: Least length of a line, and edits from there on.
EDITS = ((1, 0), (20, 1))
#: At most so many lines, or index entries, count as heavy: those with more than that share of all.
HEAVY = 10_000
_SPREAD = 64
#: Longer lines aren't measured by Spark's distance.
_LONG = 4000


def line_id(line: Column) -> Column:
    """128 bits that tell lines apart: two hashes of different seeds."""
    return F.struct(F.xxhash64(line).alias("h"), F.xxhash64(F.lit(1), line).alias("g"))


def lines_of(docs: DataFrame, least: int) -> DataFrame:
    """(place, line) of each line with content and of at least ``least`` characters; docs has doc_id, digest and text."""
    found = docs.select("doc_id", "digest", F.posexplode(F.split("text", "\n", -1)).alias("line_no", "line"))
    found = found.where(F.col("line").rlike(r"[^\x20\x09-\x0D]"))
    if least > 1:
        found = found.where(F.length("line") >= least)
    return found.select(F.struct("doc_id", "digest", "line_no").alias("place"), "line")


def _allowed(n: Column, edits: tuple) -> Column:
    """The edits that lines of n characters are allowed."""
    out = F.lit(-1)
    for low, k in edits:
        out = F.when(n >= low, F.lit(k)).otherwise(out)
    return out


def within_edits(a: Column, b: Column, k: int) -> Column:
    """Whether two lines, given as arrays of characters, are within k edits (4 at most): banded and bit-parallel.

    The band is 2k + 1 diagonals. After j characters of ``b``, one word holds, for each number of edits e up to k, the
    diagonals reached with at most e edits: on diagonal d that is by j + d characters of ``a``. A word of matches holds
    which characters of ``a`` around place j equal character j of ``b``, and a few operations take all of them on.
    """
    # Bound once, so that what makes the arrays isn't run again for each character.
    return F.get(F.transform(F.array(F.struct(a.alias("a"), b.alias("b"))), lambda p: _banded(p["a"], p["b"], k)), 0)


def _banded(a: Column, b: Column, k: int) -> Column:
    n, m, width = F.size(a), F.size(b), 2 * k + 1
    every = sum(1 << (width * e) for e in range(k + 1))  # the lowest diagonal of each number of edits
    mask = lambda bits: F.lit(bits).cast("long")
    full, low, high = (1 << (width * (k + 1))) - 1, every, every << (width - 1)
    # Places from 0; null beyond the ends.
    hits = F.transform(b, lambda c, j: reduce(lambda x, y: x + y, [F.when(F.get(a, j + d) == c, mask(every << (d + k))).otherwise(mask(0)) for d in range(-k, k + 1)]))

    def step(s: Column, hit: Column) -> Column:
        # By a match; with one edit more by a replacement, or an insertion, one diagonal down.
        new = s.bitwiseAND(hit).bitwiseOR(F.shiftleft(s, width)).bitwiseOR(F.shiftleft(s.bitwiseAND(mask(full & ~low)), width - 1))
        # By deletions, one diagonal up each.
        up = lambda x, _: x.bitwiseOR(F.shiftleft(x.bitwiseAND(mask(full & ~high)), width + 1))
        return F.aggregate(F.array(*[F.lit(e) for e in range(k)]), new.bitwiseAND(mask(full)), lambda x, e: up(x, e).bitwiseAND(mask(full)))

    end = F.aggregate(hits, mask(sum(((1 << (e + 1)) - 1) << (width * e + k) for e in range(k + 1))), step)
    at = F.when(F.abs(n - m) <= k, n - m).otherwise(0)
    return (F.abs(n - m) <= k) & (F.call_function("shiftright", end, at + (width * k + k)).bitwiseAND(F.lit(1)) == 1)


def _alike(a: Column, b: Column, k: int) -> Column:
    """What lines within k edits have in common: of 3k + 2 parts of ``a`` all but k stand in ``b``, at most k places away."""
    parts = 3 * k + 2
    size = F.floor(F.length(a) / parts).cast("int")
    there = [F.contains(F.substr(b, F.greatest(size * i + 1 - k, F.lit(1)), size + 2 * k), F.substr(a, size * i + 1, size)).cast("int") for i in range(parts)]
    return reduce(lambda x, y: x + y, there) >= parts - k


def _segment_keys(line: Column, edits: tuple) -> Column:
    """(key, probe) of each index entry and probe of a line: entries for its own length, probes for it and shorter ones."""
    n, most = F.length(line), max(k for _, k in edits)
    none = F.array().cast("array<struct<key:bigint,probe:bigint>>")

    def keys(less: int, k: int) -> Column:
        """Those for lines that are ``less`` characters shorter, which are allowed k edits."""
        size, left, out = n - less, k // 2 + 1, []
        for i in range(k + 1):
            begin, end = F.floor(size * i / (k + 1)).cast("int"), F.floor(size * (i + 1) / (k + 1)).cast("int")
            around = i if i < left else k - i
            for shift in range(-around, around + 1):
                # Places count from the start of a line, those of the later segments from its end.
                at = begin + (shift if i < left else less + shift) + 1
                out.append(F.struct(F.xxhash64(size, F.lit(i), F.substr(line, at, end - begin)).alias("key"), F.lit(int(less > 0 or shift != 0)).cast("long").alias("probe")))
        return F.array(*out)

    parts = []
    for less in range(most + 1):
        found, limit = none, _allowed(n - less, edits)
        for k in sorted({k for _, k in edits if k >= max(less, 1)}):
            found = F.when(limit == k, keys(less, k)).otherwise(found)
        parts.append(found)
    return F.concat(*parts)


def _check(edits: tuple) -> None:
    for step, (low, k) in enumerate(edits):
        below = edits[step - 1] if step else (0, 0)
        if k > 4:
            raise ValueError("the band of over four edits does not fit a word")
        if low < k + 1 or k < below[1] or low < below[0]:
            raise ValueError(f"step {step} of the edits")


def _cutout_pairs(texts: DataFrame) -> DataFrame:
    """(a, b): pairs of ``texts`` (no, line, n) within one edit, enough to keep every connection, in rows by the length of a line.

    A line is cut into some sqrt(n) blocks, and each block is taken without each of its characters, with hashes of what
    stands before and after it: lines that agree in all but the character at one place are within one edit of each
    other, all of them, and each is linked to the smallest; a line that is another one with a character more has a
    cutout that is one of the other's blocks.
    """

    def blocks(n: Column, extra: int) -> Column:
        """Blocks of a line for the partition of lines of n characters; the line has ``extra`` characters more."""
        size = F.greatest(F.ceil(F.sqrt(n)).cast("int"), F.lit(1))

        def block(s: Column) -> Column:
            length = F.least(size, n - s) + extra
            return F.struct(s.alias("start"), F.xxhash64(F.substring("line", F.lit(1), s), F.substr("line", s + length + 1)).alias("around"), F.substring("line", s + 1, length).alias("block"))

        return F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), size), block)

    def cutouts(found: Column) -> Column:
        rest = lambda b, i: F.xxhash64(b["around"], F.concat(F.substring(b["block"], F.lit(1), i - 1), F.substr(b["block"], i + 1)))
        return F.flatten(F.transform(found, lambda b: F.transform(F.sequence(F.lit(1), F.length(b["block"])), lambda i: F.struct((b["start"] + i).alias("place"), rest(b, i).alias("rest")))))

    n = F.col("n")
    same = texts.select("no", F.explode(cutouts(blocks(n, 0))).alias("v")).select("no", F.xxhash64("v.place", "v.rest").alias("rest"))
    lowest = same.groupBy("rest").agg(F.min("no").alias("b"), F.max("no").alias("top")).where("b < top").drop("top")
    replaced = same.join(lowest, "rest").where(F.col("no") != F.col("b")).select(F.col("no").alias("a"), "b")
    shorter = texts.select(F.col("no").alias("b"), F.explode(F.transform(blocks(n, 0), lambda x: F.xxhash64(x["around"], x["block"]))).alias("rest"))
    longer = texts.select(F.col("no").alias("a"), F.explode(cutouts(blocks(n - 1, 1))).alias("v")).select("a", "v.rest")
    return replaced.unionByName(longer.join(shorter, "rest").select("a", "b")).where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()


def _rare_pairs(texts: DataFrame, edits: tuple) -> DataFrame:
    """(a, b): pairs of ``texts`` (no, line, n) that may be within their edits, by segments that few lines have.

    Of any k + 1 segments of a line that don't overlap, one stands in each line within k edits. Of all segments at
    multiples of a length the k + 1 rarest are taken, and the lines that hold one of them anywhere are its candidates.
    """
    steps = [(step, low, k) for step, (low, k) in enumerate(edits) if k]
    grams = held = F.array().cast("array<struct<key:bigint,k:int>>")
    n, line = F.col("n"), F.col("line")

    def length(step: int) -> int:
        return max(1, edits[step][0] // (2 * edits[step][1] + 2))

    def at(places: Column, step: int, k: int) -> Column:
        size = F.lit(length(step))
        return F.transform(places, lambda i: F.struct(F.xxhash64(F.lit(step), F.substr(line, i, size)).alias("key"), F.lit(k).alias("k")))

    for step, low, k in steps:
        size = length(step)
        own = at(F.sequence(F.lit(1), n - size + 1, F.lit(size)), step, k)
        every = at(F.sequence(F.lit(1), n - size + 1), step, k)
        for below, (_, less) in enumerate(edits[:step]):
            if less:  # shorter lines, of the step below, within its edits
                shorter = at(F.sequence(F.lit(1), n - length(below) + 1), below, k)
                every = F.when(n < edits[below + 1][0] + less, F.concat(every, shorter)).otherwise(every)
        grams, held = F.when(n >= low, own).otherwise(grams), F.when(n >= low, every).otherwise(held)
    spread, _ = cut(texts.select("no", F.explode(held).alias("e")).select("no", "e.key").distinct(), "lines-grams")
    often = spread.groupBy("key").agg(F.count("*").alias("often"))
    segments = texts.select("no", F.explode(F.array_distinct(grams)).alias("e")).select("no", "e.*").join(often, "key")
    # A segment that a line has twice counts once: then the line has fewer than k + 1, and all of them are taken.
    rare = segments.groupBy("no").agg(F.slice(F.sort_array(F.collect_list(F.struct("often", "key"))), 1, F.first("k") + 1).alias("e"))
    rare = rare.select(F.col("no").alias("x"), F.explode("e").alias("e")).select("x", "e.key")
    return rare.join(spread, "key").where("x != no").select(F.greatest("x", "no").alias("a"), F.least("x", "no").alias("b")).distinct()


def line_links(lines: DataFrame, *, edits: tuple = EDITS, bucket: int = 32, rounds: int = 4) -> DataFrame:
    """(a, b), b < a: ids of distinct lines within the edits that the shorter one's length allows, enough to keep every connection.

    ``lines`` has line; lines that repeat very often should have been taken out. ``edits`` has steps (least length,
    edits, 4 at most), neither falling; a step's least length is over its edits. Lines under the first length have no links. Results mean the same for any ``bucket`` and ``rounds``.
    """
    _check(edits)
    if not any(k for _, k in edits):
        return lines.select(line_id(F.col("line")).alias("a"), line_id(F.col("line")).alias("b")).where(F.lit(False))
    lines = lines.where(F.length("line") >= min(low for low, k in edits if k))
    number = F.xxhash64("line").bitwiseAND(F.lit(-2))  # of a line; the lowest bit tells probes
    entries_of = lambda df: df.select(number.alias("no"), F.explode(_segment_keys(F.col("line"), edits)).alias("e")).select("e.key", F.col("no").bitwiseOR(F.col("e.probe")).alias("v"))
    no, probe = F.col("v").bitwiseAND(F.lit(-2)), F.col("v").bitwiseAND(F.lit(1))
    hot, _ = cut(heavy_keys(entries_of(lines.sample(1 / 64, seed=1)).groupBy("key").agg(F.count("*").alias("n")), 1000).where("n > 32"), "lines-hot")
    # The entries of a hot key are dealt out by line; others have no deal (-1).
    dealt = entries_of(lines).join(F.broadcast(hot.select("key", F.lit(True).alias("hot"))), "key", "left")
    dealt = dealt.select("key", "v", F.when(F.col("hot"), F.pmod(F.shiftright("v", 1), F.lit(_SPREAD))).otherwise(-1).cast("byte").alias("deal"))
    dealt = dealt.repartition("key", "deal")  # the one shuffle of the index; both uses below read it
    ends = dealt.groupBy("key", "deal").agg(F.min(no).alias("low"), F.max(no).alias("high"), F.min(probe).alias("only"))
    ends = ends.where((F.col("deal") >= 0) | (F.col("low") < F.col("high")) & (F.col("only") == 0)).select("key", "deal")
    members = dealt.join(ends, ["key", "deal"]).groupBy("key", "deal", no.alias("no")).agg(F.min(probe).alias("probe"), F.count("*").alias("times"))
    members, _ = cut(members.select("key", "no", "probe", "times"), "lines-members")

    wanted = passing(lines, bit_filter(members.select("no")), number)
    texts = wanted.withColumn("no", number).join(members.select("no").distinct(), "no", "left_semi")
    texts = texts.groupBy("no", line_id(F.col("line")).alias("id")).agg(F.first("line").alias("line"))
    texts, _ = cut(texts.withColumn("n", F.length("line")), "lines-candidates")
    members, _ = cut(members.join(texts.groupBy("no").agg(F.min("n").alias("n")), "no"), "lines-measured")
    both_of = lambda pairs: pairs.join(texts.select(F.col("no").alias("a"), F.col("id").alias("ia"), F.col("line").alias("la"), F.col("n").alias("na")), "a").join(texts.select(F.col("no").alias("b"), F.col("id").alias("ib"), F.col("line").alias("lb"), F.col("n").alias("nb")), "b")
    steps = sorted({k for _, k in edits if k})
    limit = _allowed(F.least("na", "nb"), edits)

    def verified(pairs: DataFrame) -> DataFrame:
        """(a, b): ids of those ``pairs`` (a, b) that are within their edits. Cheap tests come before the words of bits."""
        out = both_of(pairs).withColumn("k", limit)
        alike, near = F.lit(False), F.lit(False)
        for k in steps:
            alike = F.when(F.col("k") == k, _alike(F.col("la"), F.col("lb"), k)).otherwise(alike)
            near = F.when(F.col("k") == k, within_edits(F.split("la", ""), F.split("lb", ""), k)).otherwise(near)
        # Spark's distance takes the square of the length, the words of bits don't.
        hopeful = F.when(F.greatest("na", "nb") <= _LONG, F.call_function("levenshtein", F.col("la"), F.col("lb"), F.col("k")) >= 0).otherwise(True)
        out = out.where((F.abs(F.col("na") - F.col("nb")) <= F.col("k")) & alike).where(hopeful).where(near)
        return out.select(F.greatest("ia", "ib").alias("a"), F.least("ia", "ib").alias("b"))

    # Large entries: the line that came most often is the pivot. What is found is written round by round.
    more, left, before = None, members, None
    for i in range(rounds + 1):
        sizes = left.groupBy("key").agg(F.count("*").alias("size"), F.max(F.struct("times", "no")).alias("pivot"), F.min("probe").alias("only"))
        sized = left.join(sizes.where((F.col("size") > 1) & (F.col("only") == 0)).select("key", "size", F.col("pivot.no").alias("pivot")), "key")
        small = sized.where(F.col("size") <= bucket)
        of = lambda c: small.select("key", F.col("no").alias(c), F.col("n").alias(f"n{c}"), F.col("probe").alias(f"p{c}"))  # noqa: E731, B023
        pairs = of("a").join(of("b"), "key").where((F.col("a") > F.col("b")) & (F.col("pa") + F.col("pb") < 2) & (F.abs(F.col("na") - F.col("nb")) <= limit)).select("a", "b")
        pairs, _ = cut(pairs.distinct(), "lines-pairs")
        more = pairs if more is None else more.unionByName(pairs)
        large = sized.where(F.col("size") > bucket)
        now = large.count()
        if now == 0:
            break
        if steps == [1]:
            more = more.unionByName(cut(_cutout_pairs(texts.join(large.select("no").distinct(), "no", "left_semi")), "lines-cutouts")[0])
            break
        if i == rounds or before is not None and 4 * now > 3 * before:
            rest = texts.join(large.select("no").distinct(), "no", "left_semi")
            more = more.unionByName(cut(_rare_pairs(rest, edits), "lines-rare")[0])
            break
        before = now
        # Distances to the pivots, up to twice the edits that any line is allowed, since rings are that wide.
        most = steps[-1]
        far = F.when(F.greatest("na", "nb") <= _LONG, F.call_function("levenshtein", F.col("la"), F.col("lb"), F.lit(2 * most)))
        to_pivot = both_of(large.where("no != pivot").select(F.col("no").alias("a"), F.col("pivot").alias("b")).distinct())
        to_pivot, _ = cut(to_pivot.select("a", "b", far.alias("d"), limit.alias("k")), "lines-pivots")
        near = (F.col("d") >= 0) & (F.col("d") <= F.col("k"))
        seen = large.where("no != pivot").join(to_pivot.select(F.col("a").alias("no"), F.col("b").alias("pivot"), "d", "k"), ["no", "pivot"])
        # A line near the pivot is linked to it, and leaves. It could still be near a line that isn't, at most so much farther away.
        inner = seen.where(near).select("key", F.col("no").alias("x"), F.col("d").alias("dx"))
        ring = seen.where(~near & (F.col("d") >= 0)).select("key", F.col("no").alias("y"), F.col("d").alias("dy"))
        crossed = inner.join(ring, "key").where(F.col("dy") <= F.col("dx") + most).select(F.col("x").alias("no")).union(inner.join(ring, "key").where(F.col("dy") <= F.col("dx") + most).select("y")).distinct()
        crossed, _ = cut(crossed.union(seen.where("d IS NULL").select("no")).distinct(), "lines-crossed")
        more = more.unionByName(to_pivot.where(near).select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")))
        more = more.unionByName(cut(_rare_pairs(texts.join(crossed, "no", "left_semi"), edits), "lines-rare")[0])
        left, _ = cut(seen.where(F.coalesce(~near, F.lit(True))).select("key", "no", "probe", "times", "n"), "lines-left")
    return verified(more.distinct()).where("a != b").distinct()


def dedup_lines(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", edits: tuple = EDITS, bucket: int = 32, carry: bool = False) -> DataFrame:
    """doc_id, n_lines, n_removed, kept_text for each row; with ``carry`` also doc, a struct of all input columns.

    Lines are separated by ``\\n``; lines of white space alone have no content and stay. Lines of a class (equal, or
    linked within ``edits``, as ``line_links`` has them) keep the first by (doc_id, line number), null ids first; where
    the ids of rows are equal, rows that are equal in text count as one document, and other rows of that id come in
    order of their texts' hashes. A null text has no lines and kept_text is null; an empty text is one empty line.
    Removed lines go with the separator that ends them; a text that loses all its lines becomes ''. Extra columns stay
    inside doc or are left out.
    """
    # A row's place in the order: its id and the hash of its text, so that rows of one id can be told apart.
    rows = carried(docs, id_col, text_col, carry).withColumn("digest", F.xxhash64(F.coalesce("text", F.lit(""))))
    lines = lines_of(rows.select("doc_id", "digest", "text"), edits[0][0])
    places, _ = cut(lines.select("place", line_id(F.col("line")).alias("id")), "lines")
    counts, _ = cut(places.groupBy("id").agg(F.min("place").alias("first"), F.count("*").alias("n")), "lines-counts")
    heavy, _ = cut(heavy_keys(counts, HEAVY).where("n > 1").select("id", "first"), "lines-heavy")
    # Of heavy lines the first one is indexed; all others as often as they come.
    once = lines.withColumn("id", line_id(F.col("line"))).join(F.broadcast(heavy), "id", "left").where(F.col("first").isNull() | (F.col("first") == F.col("place")))
    nodes = connected_components(line_links(once.select("line"), edits=edits, bucket=bucket), "lines").withColumnRenamed("node", "id")

    # Of ids that repeat or have links: their class's first place.
    classes = counts.join(nodes, "id", "left").where((F.col("n") > 1) | F.col("component").isNotNull()).select("id", "first", F.coalesce("component", "id").alias("component"))
    classes, _ = cut(classes, "lines-classes")
    kept = classes.groupBy("component").agg(F.min("first").alias("kept"))
    repeated, _ = cut(classes.join(kept, "component").select("id", "kept"), "lines-repeated")
    # Heavy lines meet their class in place; the others, at the class's key.
    often = heavy.select("id")
    near = anti_heavy(passing(places, bit_filter(repeated.select(F.col("id.h").alias("no"))), F.col("id.h")), often, "id")
    hit = places.join(F.broadcast(repeated.join(F.broadcast(often), "id", "left_semi")), "id").unionByName(near.join(anti_heavy(repeated, often, "id"), "id").select(*places.columns, "kept"), allowMissingColumns=False)
    removed = hit.where(F.col("place") != F.col("kept")).groupBy("place.doc_id", "place.digest").agg(F.collect_set("place.line_no").alias("gone"))
    removed, _ = cut(removed.select(F.col("doc_id").alias("r_id"), F.col("digest").alias("r_digest"), "gone"), "lines-removed")

    owner = lambda a, b: F.xxhash64(a, b)
    filled = bit_filter(removed.select(owner("r_id", "r_digest").alias("no")))
    touched = passing(rows, filled, owner("doc_id", "digest")).join(removed, F.col("doc_id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left").drop("r_id", "r_digest")
    untouched = passing(rows, filled, owner("doc_id", "digest"), inside=False).withColumn("gone", F.lit(None).cast("array<int>"))
    n_lines = F.greatest(F.coalesce(F.size(F.split("text", "\n", -1)), F.lit(0)), F.lit(0)).cast("long")

    def result(df: DataFrame, text: Column, n_removed: Column) -> DataFrame:
        return df.select(*(["doc"] if carry else []), "doc_id", n_lines.alias("n_lines"), n_removed.cast("long").alias("n_removed"), text.alias("kept_text"))

    stay = F.array_except(F.sequence(F.lit(0), F.size(F.col("parts")) - 1), F.col("gone"))
    shorter = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join(F.transform(stay, lambda i: F.element_at(F.col("parts"), i + 1)), "\n"))
    first = result(touched.withColumn("parts", F.split("text", "\n", -1)), shorter, F.greatest(F.coalesce(F.size("gone"), F.lit(0)), F.lit(0)))
    return first.unionByName(result(untouched, F.col("text"), F.lit(0)))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_lines", "n_removed", F.coalesce(F.length("kept_text"), F.lit(0)).cast("long").alias("kept_chars"), F.sha2(F.coalesce("kept_text", F.lit("")), 256).alias("kept_sha256"))


def _oracle(edits: tuple = EDITS) -> str:
    """DuckDB SQL: pairs of lines with a part in common, of (edits + 1) parts of the shorter, at the places it can be in
    the other; code points compared by a band of diagonals; classes by following links to the smallest."""
    most = max(k for _, k in edits)
    hit = " + ".join(f"CASE WHEN x[s[1] + {d + most + 1}] = c[1] THEN {1 << (d + most)} ELSE 0 END" for d in range(-most, most + 1))
    state = [f"s[2] & ({hit})"]
    for e in range(1, most + 1):
        state.append(f"((s[{e + 2}] & ({hit})) | s[{e + 1}] | (s[{e + 1}] >> 1) | (({state[-1]}) << 1)) & {(1 << (2 * most + 1)) - 1}")
    start = ", ".join(str(((1 << (e + 1)) - 1) << most) for e in range(most + 1))
    reached = f"list_reduce(list_prepend([0, {start}], y), lambda s, c: [s[1] + 1, {', '.join(state)}])"
    allowed = "CASE " + " ".join(f"WHEN n >= {low} THEN {k}" for low, k in reversed(edits)) + " ELSE -1 END"
    return rf"""
WITH RECURSIVE d AS (
  SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents
), l AS (
  SELECT doc_id, ls[k] AS line, k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS k FROM d)
), u AS (
  SELECT row_number() OVER (ORDER BY line) AS id, line, length(line) AS n, {allowed.replace('n >=', 'length(line) >=')} AS e
  FROM (SELECT DISTINCT line FROM l WHERE trim(line, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) <> '')
), seg AS (
  SELECT id, n, e, p, n * p // (e + 1) AS s, substr(line, n * p // (e + 1) + 1, n * (p + 1) // (e + 1) - n * p // (e + 1)) AS part
  FROM u, range(0, {max(k for _, k in edits) + 1}) t(p) WHERE e > 0 AND p <= e
), shapes AS (
  SELECT DISTINCT n, e, p, s, length(part) AS w FROM seg
), probe AS (
  SELECT u.id, h.n, h.p, substr(u.line, h.s + o + 1, h.w) AS part
  FROM shapes h JOIN u ON u.n >= h.n AND u.n <= h.n + h.e, range(-{max(k for _, k in edits)}, {max(k for _, k in edits) + 1}) t(o) WHERE abs(o) <= h.e AND h.s + o >= 0
), c0 AS (
  SELECT DISTINCT seg.id AS x, probe.id AS y FROM seg JOIN probe ON seg.n = probe.n AND seg.p = probe.p AND seg.part = probe.part AND seg.id <> probe.id
), c1 AS (
  SELECT a.id AS ia, b.id AS ib, least(a.e, b.e) AS e, a.n - b.n AS d, list_concat([{", ".join(["-1"] * most)}], list_transform(regexp_extract_all(a.line, '(?s).'), lambda z: unicode(z))) AS x, list_transform(regexp_extract_all(b.line, '(?s).'), lambda z: [unicode(z)]) AS y
  FROM c0 JOIN u a ON c0.x = a.id JOIN u b ON c0.y = b.id WHERE levenshtein(a.line, b.line) <= 4 * least(a.e, b.e) AND abs(a.n - b.n) <= least(a.e, b.e)
), e AS (
  SELECT ia AS x, ib AS y FROM (SELECT ia, ib, e, d, {reached} AS r FROM c1) WHERE (r[e + 2] & (1 << (d + {most}))) > 0
), s AS (
  SELECT x, y FROM e UNION SELECT y, x FROM e
), r AS (
  SELECT id AS x, id AS y FROM u UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x
), c AS (
  SELECT x AS id, min(y) AS class FROM r GROUP BY x
), p AS (
  SELECT l.doc_id, l.k, row_number() OVER (PARTITION BY c.class ORDER BY l.doc_id, l.k) AS nth FROM l JOIN u ON l.line = u.line JOIN c ON c.id = u.id
), k AS (
  SELECT l.doc_id, string_agg(l.line, chr(10) ORDER BY l.k) AS kept, count(*) AS n FROM l LEFT JOIN p ON p.doc_id = l.doc_id AND p.k = l.k WHERE coalesce(p.nth, 1) = 1 GROUP BY l.doc_id
)
SELECT d.doc_id, CAST(len(ls) AS BIGINT) AS n_lines, CAST(len(ls) - coalesce(n, 0) AS BIGINT) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS kept_chars, sha256(coalesce(kept, '')) AS kept_sha256
FROM d LEFT JOIN k USING (doc_id)
"""


ORACLE_SQL = _oracle()
