"""Quality rules: divergence of a document's character classes and common words from its language's reference.

One pass counts, for each whole text, the base figures and two histograms: characters by class, and words by the list
of common words of the document's language (all other words share one bin). The reference of a language is the sum
over all documents that pass the base rules and the minimum length; it is taken twice, the second time without those
that the first one rejects. A document is kept when the Jensen-Shannon distances (base 2, from 0 to 1) of its
histograms from the reference stay under the limits: one for each, and a lower pair for both together. Where a text
is too short for its histogram to mean anything, that distance isn't judged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut

#: Common words by language.
COMMON = {
    "en": "the and of to in for is on that by this with you it not or be are from at as your all have new an was we will can if he his they had but were which their one has been who its".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an werden aus er hat dass sie nach wird bei einer um am sind noch wie einem über".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más o pero sus le ha me si sin sobre este ya entre cuando todo esta ser son dos".split(),
    "fr": "de la le et les des en un du une que est pour qui dans a par plus pas au sur ne se ce il sont avec son cette ou mais aux ont ses sa être leur y nous".split(),
}
#: Of a language without a list, or none: all lists together.
OTHER = ""
CLASSES = ("lower", "upper", "letter", "digit", "space", "newline", "stop", "punctuation", "symbol", "other")
N_CLASSES, N_WORDS = len(CLASSES), 1 + max(map(len, COMMON.values()))

#: Contract: words are runs of other than ASCII white space; these symbols count.
SYMBOLS = b"#*$%&|<>"


def _class_of(byte: int) -> int:
    """By byte: letters beyond ASCII count once, by their first byte."""
    c = chr(byte)
    if byte >= 0xC0:
        return 2
    if byte >= 0x80:
        return -1
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 3
    if c == "\n":
        return 5
    if c in " \t\r\v\f":
        return 4
    if c in ".,":
        return 6
    if c in "!?;:'\"()-":
        return 7
    return 8 if c.isprintable() else 9


_CLASS = np.array([_class_of(b) for b in range(256)])
_IS_CLASS = np.stack([_CLASS == i for i in range(N_CLASSES)])
_SYMBOL = np.isin(np.arange(256), list(SYMBOLS))


def count(text: bytes, bins: dict[bytes, int]) -> tuple:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, classes, common."""
    by_byte = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    classes = [int(by_byte[m].sum()) for m in _IS_CLASS]
    words = text.split()
    n = len(words)
    # Characters are bytes that don't continue one; white space is one byte each.
    chars = len(text) - int(by_byte[0x80:0xC0].sum())
    word_chars = chars - int(by_byte[[32, 9, 10, 11, 12, 13]].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    dup_lines = len(lines) - len(set(lines))
    repeated = 0
    ids: dict[bytes, int] = {}
    at = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
    if n > 2:
        m = len(ids)
        windows = at[:-2] * m + at[1:-1]
        if m > 2_000_000:  # three ids don't fit 63 bits
            windows = np.unique(windows, return_inverse=True)[1]
        windows = windows * m + at[2:]
        order = np.argsort(windows, kind="stable")
        same = windows[order[1:]] == windows[order[:-1]]
        twice = np.zeros(n, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        cover = twice.copy()
        cover[1:] |= twice[:-1]
        cover[2:] |= twice[:-2]
        repeated = int(cover.sum())
    common = [0] * N_WORDS
    each = np.bincount(at, minlength=len(ids)).tolist() if n else []
    for word, k in ids.items():
        common[bins.get(word.lower().strip(b".,;:!?\"'()"), 0)] += each[k]
    return n, word_chars, int(by_byte[_SYMBOL].sum()), dup_lines, repeated, classes, common


_BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def features(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", carry: bool = False) -> DataFrame:
    """doc_id, lang (one that has a list, or ''), the base figures, classes and common (histograms as arrays)."""
    lang = docs[lang_col].cast("string") if lang_col in docs.columns else F.lit(OTHER)
    cols = [F.struct(*[docs[f"`{c}`"] for c in docs.columns]).alias("doc")] if carry else []
    df = docs.select(*cols, F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"), F.when(lang.isin(*COMMON), lang).otherwise(OTHER).alias("lang"))
    lists = {k: {w.encode(): i + 1 for i, w in enumerate(v)} for k, v in COMMON.items()}
    lists[OTHER] = {}
    for words in COMMON.values():
        for i, w in enumerate(words):
            lists[OTHER].setdefault(w.encode(), i + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = batch.schema.names
            at = names.index("text")
            found = [count(t.as_py() or b"", lists[g.as_py()]) for t, g in zip(batch.column(at).cast(pa.binary()), batch.column(names.index("lang")))]
            cols = [c for i, c in enumerate(batch.columns) if i != at]
            new = [pa.array([f[k] for f in found], pa.int64()) for k in range(5)] + [pa.array([f[k] for f in found], pa.list_(pa.int64())) for k in (5, 6)]
            yield pa.RecordBatch.from_arrays([*cols, *new], names=[n for n in names if n != "text"] + [*_BASE, "classes", "common"])

    schema = T.StructType([f for f in df.schema if f.name != "text"] + [T.StructField(c, T.LongType()) for c in _BASE] + [T.StructField(c, T.ArrayType(T.LongType())) for c in ("classes", "common")])
    return df.mapInArrow(run, schema)


def distance(a: Column, b: Column) -> Column:
    """Jensen-Shannon distance of two arrays of shares, base 2; null where one is null."""
    term = lambda p, m: F.when(p > 0, p * F.log2(p / m)).otherwise(0.0)

    def part(x: Column, y: Column) -> Column:
        return (term(x, (x + y) / 2) + term(y, (x + y) / 2)) / 2

    return F.sqrt(F.greatest(F.aggregate(F.zip_with(a, b, part), F.lit(0.0), lambda s, v: s + v), F.lit(0.0)))


def shares(counts: Column, total: Column) -> Column:
    return F.when(total > 0, F.transform(counts, lambda v: v / total))


def base_failed(min_words: int = 50, max_repeat: int = 50) -> Column:
    return (F.col("n_words") < min_words) | (100 * F.col("n_repeat_words") > max_repeat * F.col("n_words"))


def judge(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_words: int = 50, max_repeat: int = 50, min_chars: int = 200, min_common: int = 70, max_class: float = 0.30, max_word: float = 0.36, max_both: tuple[float, float] = (0.17, 0.25), carry: bool = False) -> DataFrame:
    """Base figures, distances and verdict for each row.

    Returns doc_id, lang, the base figures, base_failed, class_distance, word_distance, kept; with ``carry`` also doc,
    a struct of all input columns. A null text is empty: no words, so it fails the base rules. A null or unknown
    language, or no such column, uses all lists together. With no document to make a reference from, distances are
    null and don't count; null too where a text has under min_chars characters or min_common words. Repeated rows are
    rows of their own. Extra columns stay inside doc or are left out.

    The counts are written to the shared folder (a narrow row for each document), since references and verdict read
    them; a reference has a row for each list in COMMON and one more, so it is broadcast.
    """
    total = F.aggregate("classes", F.lit(0).cast("long"), lambda s, v: s + v)
    narrow, _ = cut(features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col), "quality")
    narrow = narrow.withColumn("n_chars", total)
    # With whole rows, counting again is cheaper than writing them once more.
    counts = features(docs, id_col=id_col, text_col=text_col, lang_col=lang_col, carry=True).withColumn("n_chars", total) if carry else narrow
    first = _reference(narrow.where(~base_failed(min_words, max_repeat) & (F.col("n_chars") >= min_chars)))
    limits = (min_chars, min_common, max_class, max_word, max_both)
    fit = _measured(narrow.where(~base_failed(min_words, max_repeat) & (F.col("n_chars") >= min_chars)), first, *limits).where(~F.col("far"))
    out = _measured(counts, _reference(fit), *limits).withColumn("base_failed", base_failed(min_words, max_repeat))
    return out.select(*(["doc"] if carry else []), "doc_id", "lang", *_BASE, "base_failed", "class_distance", "word_distance", (~F.col("base_failed") & ~F.col("far")).alias("kept"))


def _reference(counts: DataFrame) -> DataFrame:
    sums = [F.sum(F.col("classes")[i]).alias(f"c{i}") for i in range(N_CLASSES)] + [F.sum(F.col("common")[i]).alias(f"w{i}") for i in range(N_WORDS)]
    by_lang = counts.groupBy("lang").agg(F.sum("n_chars").alias("chars"), F.sum("n_words").alias("words"), *sums)
    arrays = [(F.array(*[f"{k}{i}" for i in range(n)]), total, name) for k, n, total, name in (("c", N_CLASSES, "chars", "ref_classes"), ("w", N_WORDS, "words", "ref_common"))]
    return by_lang.select("lang", *[shares(a, F.col(total)).alias(name) for a, total, name in arrays])


def _measured(counts: DataFrame, reference: DataFrame, min_chars: int, min_common: int, max_class: float, max_word: float, max_both: tuple[float, float]) -> DataFrame:
    out = counts.join(F.broadcast(reference), "lang", "left")
    out = out.withColumn("class_distance", F.when(F.col("n_chars") >= min_chars, distance(shares(F.col("classes"), F.col("n_chars")), F.col("ref_classes"))))
    out = out.withColumn("word_distance", F.when(F.col("n_words") >= min_common, distance(shares(F.col("common"), F.col("n_words")), F.col("ref_common"))))
    c, w = F.coalesce("class_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    return out.withColumn("far", (c > max_class) | (w > max_word) | ((c > max_both[0]) & (w > max_both[1])))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import table

    out = judge(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return out.select("doc_id", *_BASE, "base_failed", "kept", F.round("class_distance", 6).alias("class_distance"), F.round("word_distance", 6).alias("word_distance"))
