"""Suffix-array dedup: strings of 50 bytes that an earlier document has, found by suffix arrays from induced sorting.

Documents are packed into blocks. What can repeat is found first: a window of 50 bytes is named by the least hash of
the 24-byte strings in it, so equal windows have equal names, and a name that only one document has needs no more work.
Shorter strings than these are shared by documents that have nothing but a phrase in common.
The windows with other names, as runs of one name, go to the shard that owns the name; equal runs go once for each
block, with the least document id. A shard sorts all suffixes of its distinct runs: suffixes are classified, leftmost
smaller ones (LMS) bucketed, their substrings sorted in words and named, told apart where names repeat by doubling what
is ranked, and the whole array is induced from them in linear time. The permuted common prefixes (each suffix with its predecessor in the array, in
text order) tell where 50 bytes agree; neighbours that do form a group with a least document id, and each block gets
these ids for its windows. A window whose least id is smaller than its document's is removed.

Texts that equal the whole text of an earlier document are removed as a whole and make no runs. A passage that a third
of the documents share is one run for each block, and one in its shard.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import blocks as B
from .common import cut

_GRAM = 8
#: Answer to a key that no two documents share.
_ALONE = (1 << 63) - 1
#: A null id is smaller than any other.
_NULL = -(1 << 63)
_SUB_BITS = 16
#: Window starts that are looked at together.
_STEP = 1 << 16


# ---- induced sorting

def _types(t: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last symbol is the unique smallest."""
    n = len(t)
    step = np.sign(t[1:].astype(np.int64) - t[:-1])
    # Where symbols are equal the next step that isn't zero decides.
    at = np.where(step != 0, np.arange(n - 1), n)
    at = np.minimum.accumulate(at[::-1])[::-1]
    small = np.ones(n, bool)
    small[:-1] = np.append(step, 1)[np.minimum(at, n - 1)] > 0
    return small


def _grouped(chars: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Stable order by symbol, the place of each within its symbol, and counts."""
    order = np.argsort(chars.astype(np.uint16) if size <= 1 << 16 else chars, kind="stable")  # NumPy sorts 16 bits by radix
    counts = np.bincount(chars, minlength=size)
    within = np.arange(len(chars)) - (np.cumsum(counts) - counts)[chars[order]]
    return order, within, counts


def _induce(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> np.ndarray:
    """The array induced from LMS suffixes in the order given: larger ones from the left, smaller ones from the right.

    A bucket's suffixes are taken on in batches: all that stand there give their predecessors at once, in order; those
    that fall into the same bucket are the next batch.
    """
    n = len(t)
    sa = np.full(n, -1, np.int64)
    counts = np.bincount(t, minlength=size)
    ends = np.cumsum(counts)
    heads, tails = ends - counts, ends.copy()
    starts = heads.copy()
    order, within, found = _grouped(t[lms], size)
    first = ends - found
    sa[first[t[lms[order]]] + within] = lms[order]

    def push_larger(batch: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[~small[j]]
        if len(j) == 1:
            c = t[j[0]]
            sa[heads[c]] = j[0]
            heads[c] += 1
        elif len(j):
            o, w, k = _grouped(t[j], size)
            sa[heads[t[j[o]]] + w] = j[o]
            heads[:] += k

    for c in np.flatnonzero(counts).tolist():
        at = starts[c]
        while at < heads[c]:
            batch = sa[at : heads[c]].copy()
            at = heads[c]
            push_larger(batch)
        if found[c]:
            push_larger(sa[first[c] : ends[c]].copy())

    def push_smaller(batch: np.ndarray) -> None:
        j = batch[batch > 0] - 1
        j = j[small[j]]
        if len(j) == 1:
            c = t[j[0]]
            tails[c] -= 1
            sa[tails[c]] = j[0]
        elif len(j):
            o, w, k = _grouped(t[j], size)
            sa[tails[t[j[o]]] - 1 - w] = j[o]
            tails[:] -= k

    last = t[n - 1]
    tails[last] = ends[last] - 1  # the end of the text, which nothing precedes
    for c in np.flatnonzero(counts)[::-1].tolist():
        at = ends[c]
        while at > tails[c]:
            batch = sa[tails[c] : at][::-1].copy()
            at = tails[c]
            push_smaller(batch)
        push_smaller(sa[starts[c] : heads[c]][::-1].copy())
    return sa


def _sorted_substrings(t: np.ndarray, small: np.ndarray, lms: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """LMS suffixes in the order of their substrings, and the substrings' names by that order: equal ones have one name.

    A substring goes up to the next LMS symbol, types count, so none is the beginning of another. Symbols are compared
    some at a time, packed into words; what ties goes on to its next word.
    """
    n, width = len(t), (2 * size + 1).bit_length()
    per = max(1, 63 // width)
    length = np.ones(len(lms), np.int64)
    length[:-1] = np.diff(lms) + 1
    coded = np.zeros(n + per, np.uint64)
    coded[:n] = t.astype(np.uint64) * np.uint64(2) + small + np.uint64(1)
    words = coded[:n].copy()
    for k in range(1, per):
        words = (words << np.uint64(width)) | coded[k : n + k]

    def word(which: np.ndarray, k: int) -> np.ndarray:
        """Symbols k to k + per of these substrings, without what is beyond their ends."""
        beyond = np.maximum(k + per - length[which], 0).astype(np.uint64) * np.uint64(width)
        return words[lms[which] + k] >> beyond << beyond

    first = word(np.arange(len(lms)), 0)
    order = np.argsort(first, kind="stable")
    new = np.ones(len(lms), bool)
    new[1:] = first[order[1:]] != first[order[:-1]]
    k = per
    while True:
        group = np.cumsum(new) - 1
        alone = new & np.append(new[1:], True)
        left = np.flatnonzero(~alone & (length[order] > k))  # whole groups: ties so far are of one length, or go on
        if not len(left):
            return lms[order], group
        which, of = order[left], group[left]
        values = word(which, k)
        again = np.lexsort((values, of))
        order[left] = which[again]
        of, values = of[again], values[again]
        new[left[1:]] = (of[1:] != of[:-1]) | (values[1:] != values[:-1])
        new[left[:1]] = True
        k += per


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffix array of LMS substrings by their names, of which the last is unique: ranks by h names tell 2 h names apart.

    Only suffixes that tie are looked at again, all of them at once, so a repeat of n names takes log n rounds.
    """
    n, h = len(names), 1
    order = np.argsort(names, kind="stable")
    left, keys, rank = np.arange(n), names[order], np.empty(n, np.int64)
    while True:
        new = np.ones(len(left), bool)
        new[1:] = keys[1:] != keys[:-1]
        # A suffix ranks at the first place of those that it ties with, none of which reaches the end within h names.
        rank[order[left]] = left[np.maximum.accumulate(np.where(new, np.arange(len(left)), 0))]
        left = left[~(new & np.append(new[1:], True))]
        if not len(left):
            return order
        which = order[left]
        keys = rank[which] * n + rank[which + h]
        again = np.argsort(keys)
        order[left], keys = which[again], keys[again]
        h *= 2


def suffix_array(t: np.ndarray, size: int) -> np.ndarray:
    """Suffix array of symbols below ``size``, of which the last is smaller than all others and unique."""
    n = len(t)
    if n < 3:
        return np.argsort(t, kind="stable")
    small = _types(t)
    is_lms = np.zeros(n, bool)
    is_lms[1:] = small[1:] & ~small[:-1]
    lms = np.flatnonzero(is_lms)
    order, names = _sorted_substrings(t, small, lms, size)
    if names[-1] + 1 < len(lms):
        name_of = np.empty(n, np.int64)
        name_of[order] = names
        order = lms[_doubled(name_of[lms])]
    return _induce(t, small, order, size)


def permuted_prefixes(t: np.ndarray, sa: np.ndarray, most: int) -> np.ndarray:
    """For each place the common prefix with the suffix before it in the array, up to ``most``; 0 for the first."""
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    out = np.zeros(n, np.int64)
    # Some symbols a word. Ends differ: the padding is no symbol, and two places don't reach it together.
    width = (int(t.max()) + 1).bit_length()
    per = 63 // width
    pad = np.concatenate([t, np.full(most + 2 * per, t.max() + 1, t.dtype)]).astype(np.uint64)
    words = pad[: len(pad) - per + 1].copy()
    for k in range(1, per):
        words |= pad[k : len(pad) - per + 1 + k] << np.uint64(k * width)
    left = np.flatnonzero(before >= 0)
    other = before[left]
    for k in range(0, most, per):
        differ = words[left + k] ^ words[other + k]
        equal = differ == 0
        low = differ[~equal]
        # The lowest bit that differs tells the symbol; a power of two is exact as a float.
        out[left[~equal]] += np.log2((low & (~low + np.uint64(1))).astype(np.float64)).astype(np.int64) // width
        left, other = left[equal], other[equal]
        out[left] += per
    return np.minimum(out, most)


def least_by_window(runs: list[bytes], least: np.ndarray, width: int) -> list[np.ndarray]:
    """For each run and each window of ``width`` bytes that starts in it: the least id of all runs that hold the window."""
    sizes = np.fromiter(map(len, runs), np.int64, len(runs))
    # Symbols: 0 ends the text, 1 ends a run, bytes from 2.
    t = np.ones(int(sizes.sum()) + len(runs) + 1, np.int32)
    begins = np.cumsum(sizes + 1) - sizes - 1
    inside = np.ones(len(t), bool)
    inside[begins + sizes] = False
    inside[-1] = False
    t[inside] = np.frombuffer(b"".join(runs), np.uint8).astype(np.int32) + 2
    t[-1] = 0
    sa = suffix_array(t, 258)
    common = permuted_prefixes(t, sa, width)
    owner = np.repeat(np.arange(len(runs)), sizes + 1)
    owner = np.append(owner, len(runs) - 1)
    starts = np.flatnonzero(common[sa] < width)  # a group begins where the prefix is shorter
    low = np.minimum.reduceat(least[owner[sa]], starts)
    by_place = np.empty(len(t), np.int64)
    by_place[sa] = np.repeat(low, np.diff(np.append(starts, len(t))))
    return [by_place[b : b + max(0, s - width + 1)] for b, s in zip(begins.tolist(), sizes.tolist())]


# ---- windows

def window_runs(text: bytes, ends: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of whole windows with one name in one document of a block: first places, lengths, names and documents."""
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    last = ends - width  # the last window of each document
    words = max(1, width // 2 // _GRAM)
    found, names = [], []
    for at in range(0, max(0, len(text) - width + 1), _STEP):
        raw = text[at : at + _STEP + width - 1]
        n = len(raw)
        grams = np.empty(n - _GRAM + 1, np.uint64)
        for j in range(_GRAM):
            part = np.frombuffer(raw, "<u8", (n - j) // 8, j)
            grams[j::_GRAM] = part[: len(grams[j::_GRAM])]
        low = one = B.mix(grams ^ np.uint64(0x5851F42D4C957F2D))
        for k in range(1, words):
            low = low[:-_GRAM] * np.uint64(0x9E3779B97F4A7C15) + one[_GRAM * k :]
        if words > 1:
            low = B.mix(low)
        span, size = width - words * _GRAM + 1, 1
        while 2 * size <= span:
            low = np.minimum(low[:-size], low[size:])
            size *= 2
        if size < span:
            low = np.minimum(low[: len(low) - (span - size)], low[span - size :])
        new = np.ones(len(low), bool)
        new[1:] = low[1:] != low[:-1]
        # Documents begin anew; a run goes on into the windows across its document's end, which are cut off below.
        inner = starts[np.searchsorted(starts, at) : np.searchsorted(starts, at + len(low))] - at
        new[inner] = True
        places = np.flatnonzero(new)
        found.append(places + at)
        # Least hashes are small numbers: hashed again, they are spread evenly over shards.
        names.append(B.mix(low[places]))
    if not found:
        none = np.zeros(0, np.int64)
        return none, none, np.zeros(0, np.uint64), none
    begin, name = np.concatenate(found), np.concatenate(names)
    owner = np.searchsorted(ends, begin, side="right")
    count = np.minimum(np.append(begin[1:], len(text) - width + 1), last[owner] + 1) - begin
    whole = count > 0
    return begin[whole], count[whole], name[whole], owner[whole]


def _ids(ids: list) -> np.ndarray:
    return np.array([_NULL if i is None else i for i in ids], np.int64)


def _whole(ends: np.ndarray, text: bytes) -> np.ndarray:
    """Two 64-bit digests of each document."""
    starts = np.concatenate([[0], ends[:-1]]).tolist()
    return np.array([np.frombuffer(hashlib.md5(text[a:b]).digest(), "<u8") for a, b in zip(starts, ends.tolist())], np.uint64).reshape(-1, 2)


def _merged(keys: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)
    if not len(keys):
        return keys, low, high
    return keys[starts], np.minimum.reduceat(low[order], starts), np.maximum.reduceat(high[order], starts)


def _block_keys(numbers: np.ndarray, whole: np.ndarray, names: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Names of runs and digests of whole texts, with the least and the largest id."""
    each = np.concatenate([numbers[owner], numbers, numbers])
    return _merged(np.concatenate([names, whole[:, 0], whole[:, 1]]), each, each)


def _combine(order: np.ndarray, starts: np.ndarray, values: list[np.ndarray]) -> np.ndarray:
    """The least id of each key that several ids have, from least ids and what the largest have above them."""
    low, above = values[0][order], values[1][order]
    least = np.minimum.reduceat(low, starts)
    return np.where(least < np.maximum.reduceat(low + above, starts), least, _ALONE)


_RUNS = "block string, part int, kind int, data array<binary>"


def dedup(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", width: int = 50, block_bytes: int = 4 << 20, shard_bytes: int = 192 << 10, with_kept: bool = True) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and (with_kept) kept, the bytes that stay, for each row.

    A byte goes if a string of ``width`` bytes (_GRAM at least) that covers it, in this document's text, also starts in
    a document with a smaller id; judged on the texts as they come. Rows of one id don't remove from each other. A null
    id is smaller than any other; a null text is empty, and stays. Extra columns are left out.
    """
    if width < _GRAM:
        raise ValueError(f"width is at least {_GRAM}")
    blocks = B.make_blocks(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "suffix", block_bytes)
    parts = B.partitions_for(blocks)
    bits = parts.bit_length() - 1

    def keys(ids, ends, text):
        _, _, names, owner = window_runs(text, ends, width)
        found, low, high = _block_keys(_ids(ids), _whole(ends, text), names, owner)
        return found, [low, high - low]

    answers = B.totals(blocks, "suffix", keys, _combine, parts, [np.int64, np.int64], np.int64)

    def runs_of(left: pa.Table, right: pa.Table) -> pa.Table:
        """Runs for each shard (kind 0: texts, lengths, least ids), where they are (1) and the copies (2)."""
        row = left.to_pylist()[0]
        ids, ends, text = row["ids"], np.array(row["ends"], np.int64), B.plain(row["text"])
        got = sorted(zip(right["part"].to_pylist(), right["answer"].to_pylist()))
        least_of = np.concatenate([B.unpack(a, np.int64) for _, a in got]) if got else np.zeros(0, np.int64)
        numbers, whole = _ids(ids), _whole(ends, text)
        begin, count, name, owner = window_runs(text, ends, width)
        found = _block_keys(numbers, whole, name, owner)[0]
        first = least_of[np.searchsorted(found, whole)]
        copy = (first[:, 0] < numbers) & (first[:, 0] == first[:, 1])
        keep = ~copy[owner] & (least_of[np.searchsorted(found, name)] != _ALONE)
        begin, count, name, of = begin[keep], count[keep], name[keep], numbers[owner[keep]]
        shard = (name >> np.uint64(64 - bits)).astype(np.int64)
        sub = ((name << np.uint64(bits)) >> np.uint64(64 - _SUB_BITS)).astype(np.int64)
        index = np.empty(len(begin), np.int64)
        held: dict[int, dict[bytes, list]] = {}
        for i, (a, c, p, d, u) in enumerate(zip(begin.tolist(), count.tolist(), shard.tolist(), of.tolist(), sub.tolist())):
            known = held.setdefault(p, {})
            entry = known.setdefault(text[a : a + c + width - 1], [len(known), d, u])
            index[i] = entry[0]
            if d < entry[1]:
                entry[1] = d
        rows = []
        for p, known in held.items():
            rows.append((row["block"], p, 0, [B.squeeze(b"".join(known)), B.pack(np.array([len(k) for k in known], np.int64)), B.pack(np.array([e[1] for e in known.values()], np.int64)), B.pack(np.array([e[2] for e in known.values()], np.int64))]))
        rows.append((row["block"], -1, 1, [B.pack(x.astype(np.int64)) for x in (begin, count, shard, index)]))
        rows.append((row["block"], -1, 2, [B.pack(copy.astype(np.uint8))]))
        return pa.Table.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.string(), pa.int32(), pa.int32(), pa.list_(pa.binary())))], names=["block", "part", "kind", "data"])

    runs, _ = cut(blocks.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(runs_of, _RUNS), "suffix-runs")

    def shard_of(table: pa.Table) -> pa.Table:
        rows = table.to_pylist()
        distinct: dict[bytes, int] = {}
        least: list[int] = []
        subs: list[int] = []
        each = []
        for r in rows:
            text, sizes, low, sub = B.plain(r["data"][0]), *(B.unpack(x, np.int64) for x in r["data"][1:])
            at, places = 0, []
            for size, d, u in zip(sizes.tolist(), low.tolist(), sub.tolist()):
                k = distinct.setdefault(text[at : at + size], len(distinct))
                at += size
                if k == len(least):
                    least.append(d)
                    subs.append(u)
                elif d < least[k]:
                    least[k] = d
                places.append(k)
            each.append(places)
        # Sorted in parts by further bits of the name, so that memory doesn't follow the size of the shard.
        found: list = [None] * len(distinct)
        texts, low = list(distinct), np.array(least, np.int64)
        cut_bits = max(0, (sum(map(len, texts)) // shard_bytes).bit_length())
        part_of = np.array(subs, np.int64) >> (_SUB_BITS - min(cut_bits, _SUB_BITS))
        order = np.argsort(part_of, kind="stable")
        for group in np.split(order, np.flatnonzero(np.diff(part_of[order])) + 1):
            for k, values in zip(group.tolist(), least_by_window([texts[k] for k in group.tolist()], low[group], width)):
                found[k] = values
        return pa.table({"block": [r["block"] for r in rows], "part": pa.array([r["part"] for r in rows], pa.int32()), "kind": pa.array([0] * len(rows), pa.int32()), "data": pa.array([[B.pack(np.concatenate([found[k] for k in places])), B.pack(np.array([len(found[k]) for k in places], np.int64))] for places in each], pa.list_(pa.binary()))})

    replies = runs.where("kind = 0").groupBy("part").applyInArrow(shard_of, _RUNS)
    columns = [("doc_id", "bigint", pa.int64()), ("n_bytes", "bigint", pa.int64()), ("n_removed", "bigint", pa.int64()), ("n_spans", "bigint", pa.int64()), ("kept_sha256", "string", pa.string())] + ([("kept", "binary", pa.binary())] if with_kept else [])

    def finish(left: pa.Table, right: pa.Table) -> pa.Table:
        row = left.to_pylist()[0]
        ids, ends, text = row["ids"], np.array(row["ends"], np.int64), np.frombuffer(B.plain(row["text"]), np.uint8)
        starts = np.concatenate([[0], ends[:-1]])
        numbers = _ids(ids)
        told = {(r["part"], r["kind"]): r["data"] for r in right.to_pylist()}
        begin, count, shard, index = (B.unpack(x, np.int64) for x in told[-1, 1])
        copy = B.unpack(told[-1, 2][0], np.uint8).astype(bool)
        cover = np.zeros(len(text) + 1, np.int32)
        for p in np.unique(shard).tolist():
            values, sizes = (B.unpack(x, np.int64) for x in told[p, 0])
            offsets = np.cumsum(sizes) - sizes
            here = np.flatnonzero(shard == p)
            n = count[here]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(begin[here], n) + step
            low = values[np.repeat(offsets[index[here]], n) + step]
            gone = place[low < numbers[np.searchsorted(ends, place, side="right")]]
            np.add.at(cover, gone, 1)
            np.add.at(cover, gone + width, -1)
        removed = np.cumsum(cover, dtype=np.int32)[:-1] > 0
        for i in np.flatnonzero(copy & (ends - starts >= width)).tolist():
            removed[starts[i] : ends[i]] = True
        opens = removed.copy()
        opens[1:] &= ~removed[:-1]
        inner = starts[starts < ends]  # documents with bytes: a span never goes on from the one before
        opens[inner] = removed[inner]
        totals = lambda m: (lambda c: c[ends] - c[starts])(np.concatenate([[0], np.cumsum(m, dtype=np.int64)]))
        kept = [text[a:b][~removed[a:b]].tobytes() for a, b in zip(starts.tolist(), ends.tolist())]
        out = [ids, (ends - starts).tolist(), totals(removed).tolist(), totals(opens).tolist(), [hashlib.sha256(k).hexdigest() for k in kept], kept]
        return pa.table({name: pa.array(v, t) for (name, _, t), v in zip(columns, out)})

    right = runs.where("kind > 0").unionByName(replies)
    return blocks.groupBy("block").cogroup(right.groupBy("block")).applyInArrow(finish, ", ".join(f"{n} {t}" for n, t, _ in columns))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    return dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), with_kept=False)
