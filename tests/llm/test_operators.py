"""Each operator against a brute-force version, and its edge cases: nulls, empty and long texts, ties, repeats, no rows,
extra columns with names that results have."""

import base64
import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from brindle.llm import bpe, chat, decontaminate, line_dedup, lm_scoring, quality, queries, simhash, suffix_dedup, token_counts, warc
from tests.oracle import assert_same

DOCS = "doc_id bigint, text string"
LONG = "word and another one. " * 20_000
EDGES = [(1, None), (2, ""), (3, " \t\n"), (4, "same text here"), (4, "same text here"), (None, "same text here"), (5, "a"), (6, LONG), (7, "naïve café 🙂 test\r\nline")]


def docs(spark, rows=EDGES, extra=True):
    df = spark.createDataFrame(rows, DOCS)
    # Names that results have too.
    return df.withColumns({c: F.lit("x") for c in ("n_words", "kept", "doc", "fp", "n_tokens", "digest", "lang", "component_id", "n_removed")}) if extra else df


def rows_of(df, key=str):
    return sorted((tuple(r) for r in df.collect()), key=key)


# ---- whole queries

@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_against_sql(spark, sf_dir, name):
    assert_same(queries.queries()[name](spark, sf_dir), queries.oracle_sql()[name], sf_dir)


def sources(spark, sf_dir):
    return [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]


# ---- 1

def plain_print(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    import xxhash

    shingles = [" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(nodes, linked):
    parent = {n: n for n in nodes}

    def root(n):
        while parent[n] != n:
            n = parent[n]
        return n

    for a, b in linked:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {n: root(n) for n in nodes}


def test_op1_query(spark, sf_dir):
    prints = {i: plain_print(t) for i, t in sources(spark, sf_dir)}
    ids = sorted(prints)
    want = components(ids, [(a, b) for k, a in enumerate(ids) for b in ids[:k] if (prints[a] ^ prints[b]).bit_count() <= 2])
    got = queries.queries()["op1_simhash"](spark, sf_dir).collect()
    assert len(got) == len(ids) and all(r.fingerprint == f"{prints[r.doc_id]:016x}" and r.component_id == want[r.doc_id] for r in got)


@pytest.mark.parametrize("bucket", [2, 1000])
def test_simhash_links(spark, bucket):
    rnd = random.Random(3)
    base, prints = rnd.getrandbits(64), set()
    for _ in range(150):
        x = base
        for _ in range(rnd.randint(0, 4)):
            x ^= 1 << rnd.randrange(64)
        prints.add(x)
    signed = [x - (1 << 64) if x >> 63 else x for x in prints]
    distance = lambda a, b: ((a ^ b) & (1 << 64) - 1).bit_count()
    for bits in (1, 2):
        found = [(r.a, r.b) for r in simhash.links(spark.createDataFrame([(x,) for x in signed], "fp bigint"), max_bits=bits, bucket=bucket).collect()]
        assert all(b < a and distance(a, b) <= bits for a, b in found)
        assert components(signed, found) == components(signed, [(a, b) for a in signed for b in signed if b < a and distance(a, b) <= bits])
    with pytest.raises(ValueError):
        simhash.links(spark.createDataFrame([(1,)], "fp bigint"), max_bits=3)


def test_simhash_broadcasts(spark, monkeypatch, tmp_path):
    """Entries and signatures, many rows for a fingerprint, are never collected to be broadcast, however small the prints' file is."""
    plans, real = {}, simhash.cut
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(simhash, "cut", lambda df, name, *a: (plans.setdefault(name, plan(df)), real(df, name, *a))[1])
    spark.range(1000).select(F.xxhash64("id").alias("fp")).write.parquet(f"{tmp_path}/prints")
    plans["links"] = plan(simhash.links(spark.read.parquet(f"{tmp_path}/prints")))
    for name in ("simhash-shared", "links"):
        assert "SortMergeJoin" in plans[name] and "Broadcast" not in plans[name]


def test_simhash_entries_in_parts(spark, monkeypatch, tmp_path):
    """However few files the prints have, a task makes and holds the entries of so many of them."""
    plans, real = [], simhash.cut
    monkeypatch.setattr(simhash, "_DEALT", 100, raising=False)
    monkeypatch.setattr(simhash, "cut", lambda df, *a: (plans.append(df._jdf.queryExecution().executedPlan().toString()), real(df, *a))[1])
    spark.range(1000).select(F.xxhash64("id").alias("fp")).coalesce(1).write.parquet(f"{tmp_path}/prints")
    assert simhash.links(spark.read.parquet(f"{tmp_path}/prints")).count() == 0
    assert re.findall(r"Exchange hashpartitioning\(fp#\d+L, (\d+)\), REPARTITION_BY_NUM", plans[0]) == ["11", "11"]


def test_similar_common_phrase(spark, monkeypatch):
    """Texts that share a phrase, and are otherwise different, aren't compared in pairs; near copies among them are found."""
    counts, real = {}, simhash.cut

    def counted(df, name, *a):
        out = real(df, name, *a)
        counts[name] = counts.get(name, 0) + out[0].count()
        return out

    monkeypatch.setattr(simhash, "cut", counted)
    phrase = " ".join(f"common{i}" for i in range(14))
    texts = [phrase + " " + " ".join(f"w{t}x{i}" for i in range(50)) for t in range(150)]
    texts += [texts[t] + " more" for t in range(10)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    pairs = simhash.similar(rows).count()
    assert pairs == 10
    assert sum(n for name, n in counts.items() if name in ("shingle-pairs", "shingle-pivots", "shingle-crossed")) < 100


def test_simhash_edges(spark):
    got = rows_of(simhash.near_duplicates(docs(spark)).select("doc_id", "component_id"))
    assert len(got) == len(EDGES)
    assert {i: c for i, c in got if i in (1, 2, 3)} == {1: 1, 2: 1, 3: 1}
    assert [c for i, c in got if i == 4] == [4, 4] and (None, 4) in got
    assert simhash.near_duplicates(docs(spark, [])).count() == 0
    assert simhash.near_duplicates(docs(spark), carry=True).select("doc.*").columns == docs(spark).columns


def test_deduplicate_edges(spark):
    long = " ".join(f"w{i}" for i in range(200))
    rows = [*EDGES, (8, long), (9, long + " w1"), (None, long), (10, long.replace("w7 ", "")), (11, "other " + " ".join(f"v{i}" for i in range(60))), (8, long)]
    kept = simhash.deduplicate(docs(spark, rows))
    assert kept.columns == docs(spark, rows).columns
    got = sorted((r.doc_id or 0, (r.text or "")[:9]) for r in kept.collect())
    assert got == [(1, ""), (4, "same text"), (5, "a"), (6, LONG[:9]), (7, EDGES[-1][1][:9]), (8, long[:9]), (11, "other v0 ")]
    assert simhash.deduplicate(docs(spark, [])).count() == 0


def plain_jaccard(a, b):
    sets = [{tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} for w in (a.split(), b.split())]
    return len(sets[0] & sets[1]) / len(sets[0] | sets[1])


@pytest.mark.parametrize("bucket", [2, 1000])
def test_similar_by_brute_force(spark, bucket):
    rnd, texts = random.Random(5), []
    for _ in range(4):
        base = [f"w{rnd.randrange(500)}" for _ in range(rnd.randint(60, 200))]
        for _ in range(12):
            base = list(base) if rnd.random() < 0.5 else [*base[: rnd.randint(40, len(base))], *(f"w{rnd.randrange(500)}" for _ in range(rnd.randint(0, 20)))]
            base[rnd.randrange(len(base))] = f"w{rnd.randrange(500)}"
            texts.append(" ".join(base))
    prints = [plain_print(t, 5) for t in texts]
    near = [(a, b) for a in range(len(texts)) for b in range(a) if plain_jaccard(texts[a], texts[b]) >= 0.8]
    # Pairs that are too far apart in bits, so that links() alone leaves them.
    assert sum((prints[a] ^ prints[b]).bit_count() > 2 for a, b in near) > 20
    want = components(range(len(texts)), [*near, *((a, b) for a in range(len(texts)) for b in range(a) if (prints[a] ^ prints[b]).bit_count() <= 2)])
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), percent=80, set_bucket=bucket).collect()
    assert {r.doc_id: r.component_id for r in got} == want and len(set(want.values())) > 4


def test_similar_long_texts(spark):
    # 1024 shingles are the most of the smallest sketch: pairs on both sides of that, of 2048, and far apart in size.
    rnd, texts = random.Random(6), []
    for size in (1040, 2100, 4500):
        base = [f"w{rnd.randrange(3000)}" for _ in range(size)]
        for share in (1, 0.96, 0.85, 0.79, 0.5, 0.2):
            texts.append(" ".join(base[: int(size * share)]))
        texts.append(" ".join([*base[: int(size * 0.9)], *(f"x{rnd.randrange(3000)}" for _ in range(size // 9))]))
    near = [(a, b) for a in range(len(texts)) for b in range(a) if plain_jaccard(texts[a], texts[b]) >= 0.8]
    got = simhash.near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string"), percent=80).collect()
    assert {r.doc_id: r.component_id for r in got} == components(range(len(texts)), near)


def test_parity_bounds_the_difference(spark):
    rnd, rows, pairs = np.random.default_rng(7), [], []
    for i, (n, share) in enumerate([(1, 1), (30, 0), (500, 0.9), (1500, 0.7), (1500, 0.99), (5000, 0.85), (5000, 0.1)]):
        a = np.unique(rnd.integers(-(2**63), 2**63 - 1, n))
        b = np.unique(np.concatenate([a[: int(len(a) * share)], rnd.integers(-(2**63), 2**63 - 1, int(n * rnd.random() / 4) + 1)]))
        for k, x in enumerate((a, b)):
            rows.append((2 * i + k, len(x), simhash.parity(x).tolist()))
        same = len(np.intersect1d(a, b))
        pairs.append((2 * i + 1, 2 * i, 1 - same / (len(a) + len(b) - same)))
    sketches = spark.createDataFrame(rows, "sid bigint, n int, sketch array<bigint>")
    got = {r.a: r for r in simhash._least(spark.createDataFrame(pairs, "a bigint, b bigint, exact double"), sketches, 80).collect()}
    assert len(got) == len(pairs) and all(r.d <= r.exact + 1e-9 and (r.maybe or r.exact > 0.2) for r in got.values())
    assert not got[3].maybe and not got[13].maybe  # and it rules out


def test_pairs_of_a_hub_meet_once(spark):
    pairs = spark.range(1, 1202).selectExpr("id AS a", "IF(id > 1200, 1, 0) AS b").selectExpr("a", "CAST(b AS bigint) AS b")
    side = spark.range(0, 1202).selectExpr("id AS sid", "CAST(id AS int) AS n", "array(id) AS x")
    got = simhash._both(pairs, side, "x").collect()
    assert sorted((r.a, r.b, r.na, r.nb, r._a, r._b) for r in got) == [(i, int(i > 1200), i, int(i > 1200), [i], [int(i > 1200)]) for i in range(1, 1202)]


# ---- 2

def plain_base(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    triples = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    hit = {j for i, t in enumerate(triples) if triples.count(t) > 1 for j in (i, i + 1, i + 2)}
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if re.search(r"[^\x20\x09-\x0D]", line):
            dup += line in seen
            seen.add(line)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), dup, len(hit)


def test_quality_base_figures(spark):
    rnd = random.Random(2)
    rows = [(i, "".join(rnd.choice(["a", "b ", "c\n", "é", "🙂 ", "#", "|", "a b c ", "\n", "\t"]) for _ in range(rnd.randint(0, 200)))) for i in range(80)]
    got = {r.doc_id: tuple(r)[2:7] for r in quality.judge(docs(spark, rows)).collect()}
    assert got == {i: plain_base(t) for i, t in rows}


def test_quality_verdicts(spark, sf_dir):
    out = queries.queries()["op2_quality"](spark, sf_dir)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    judged = out.where("not base_failed").join(labels, "doc_id").collect()
    good, bad = [r.kept for r in judged if r.quality == 1], [r.kept for r in judged if r.quality == 0]
    assert np.mean(good) >= 0.99 and (not bad or np.mean(bad) <= 0.2)
    assert out.where("base_failed and kept").count() == 0


def test_quality_distance(spark):
    a, b = [0.5, 0.5, 0.0], [0.0, 0.5, 0.5]
    got = spark.range(1).select(quality.distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, b))).alias("d"), quality.distance(F.array(*map(F.lit, a)), F.array(*map(F.lit, a))).alias("z")).first()
    assert abs(got.d - 0.5**0.5) < 1e-12 and got.z == 0


def test_quality_edges(spark):
    got = quality.judge(docs(spark), carry=True).select("doc_id", "n_words", "base_failed", "kept").collect()
    assert len(got) == len(EDGES) and all(r.base_failed and not r.kept for r in got if r.n_words < 50)
    assert quality.judge(docs(spark, [])).count() == 0
    assert quality.judge(docs(spark, extra=False)).count() == len(EDGES)  # no language


# ---- 3

def plain_hits(text, items, window):
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    words, hit, owners = find(text), set(), set()
    for item, t in items:
        own = find(t)
        m = min(window, len(own))
        for i in range(len(own) - m + 1 if m else 0):
            for j in range(len(words) - m + 1):
                if words[j : j + m] == own[i : i + m]:
                    hit |= set(range(j, j + m))
                    owners.add(str(item) if item is not None else "")
    return len(words), len(hit), sorted(owners)


@pytest.mark.parametrize("block_bytes", [1 << 20, 40])
def test_decontaminate_by_brute_force(spark, block_bytes):
    rnd = random.Random(4)
    text = lambda n: rnd.choice([" ", ", "]).join(rnd.choice(["a", "B", "é", "x1", "-"]) for _ in range(n))
    items = [(i, text(rnd.randint(0, 7))) for i in range(12)] + [(None, "a b é a"), (20, None), (21, ""), (3, "b b b b")]
    rows = [(i, text(rnd.randint(0, 30))) for i in range(40)] + EDGES[:5]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("n_hit", F.lit(1))
    got = decontaminate.decontaminate(docs(spark, rows), bench, window=4, block_bytes=block_bytes)
    want = sorted([(i, *plain_hits(t, items, 4)) for i, t in rows], key=str)
    assert rows_of(got.select("doc_id", "n_words", "n_hit", "items")) == want
    assert all(r.contaminated == (r.n_hit > 0) for r in got.collect())


def test_decontaminate_edges(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs(spark), none).where("contaminated").count() == 0
    bench = spark.createDataFrame([(1, "word and another one word and another one word and")], "item_id bigint, text string")
    assert decontaminate.decontaminate(docs(spark), bench, carry=True).where("contaminated").select("doc.doc_id").first().doc_id == 6
    assert decontaminate.decontaminate(docs(spark, []), bench).count() == 0


# ---- 4

def tiktoken_of():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return P.path("byte_bpe_50k.tiktoken"), tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_as_the_library(spark):
    path, library = tiktoken_of()
    rnd = random.Random(1)
    pool = list("abst'''' \n\t  dmrevl LL..!?09é ß中ा́　\xa0 ½²Ⅷ🙂\x1c\x0b\x85_") + ["'s", "'re", "'ll", " '"] + [chr(c) for c in range(0x20, 0x2000, 37)]
    texts = ["", "'", "'s'll'd 'm x're", " a  b", "a \n\n b  ", "it's 'tis", "x'", "<|endoftext|>", "a" * 1000 + "b" * 500, "zq" * 700 + " " * 3000]
    texts += ["".join(rnd.choice(pool) for _ in range(rnd.randint(0, 60))) for _ in range(3000)]
    model = bpe.bpe(path)
    for text, (ids, decoded) in zip(texts, model.encode(texts)):
        assert ids.tolist() == library.encode_ordinary(text) and decoded == text.encode()
    # Words on both sides of the length where all pairs of the least rank contract in a step.
    for n in (63, 64, 65, 66, 201, 999, 20_000):
        for letters in ("ab", "aeinorst", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZé中"):
            word = "".join(rnd.choice(letters) for _ in range(n))
            ids, decoded = model._query([word.encode()])[0]
            assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(word) and decoded == word.encode()
    (ids, decoded), = model._query([b"=" * 100_000])
    assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary("=" * 100_000) and decoded == b"=" * 100_000


def test_bpe_edges(spark, sf_dir):
    path, library = tiktoken_of()
    got = bpe.encode(docs(spark), path, slice_bytes=100, carry=True).collect()
    assert len(got) == len(EDGES)
    for r in got:
        assert r.ids == library.encode_ordinary(r.doc.text or "") and r.decoded == (r.doc.text or "") and r.n_tokens == len(r.ids)
    assert bpe.encode(docs(spark, []), path).count() == 0


def test_bpe_leaves_no_model():
    """A worker's model goes when near-dedup needs the memory, and comes back with the same ids."""
    import public_tokenizers as P

    path = P.path("byte_bpe_50k.tiktoken")
    before = bpe.bpe(path)
    told = [(ids.tolist(), octets) for ids, octets in before.encode(["some words", "é 🙂"])]
    bpe.forget()
    assert not bpe._BPES
    with pytest.raises(Exception, match="closed"):
        before.db.sql("SELECT 1")
    assert [(ids.tolist(), octets) for ids, octets in bpe.bpe(path).encode(["some words", "é 🙂"])] == told


def test_op4_query(spark, sf_dir):
    _, library = tiktoken_of()
    texts = dict(sources(spark, sf_dir))
    for r in queries.queries()["op4_bpe"](spark, sf_dir).collect():
        ids = np.array(library.encode_ordinary(texts[r.doc_id]), "<u4")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), hashlib.sha256(ids.tobytes()).hexdigest(), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())


# ---- 5

@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts_and_cache(spark, tmp_path, name):
    import public_tokenizers as P

    path, cache = P.path(name), str(tmp_path / "cache")
    if name.endswith(".json"):
        from tokenizers import Tokenizer

        library = Tokenizer.from_file(path)
        count = lambda t: len(library.encode(t, add_special_tokens=False).ids)
    else:
        import sentencepiece

        library = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(library.encode(t))
    rows = EDGES + [(8, "before <|endoftext|> after")]
    want = sorted([(i, len((t or "").encode()), count(t or "")) for i, t in rows], key=str)
    assert rows_of(token_counts.count_tokens(docs(spark, rows), path, cache)) == want
    stored = token_counts.read_cache(spark, cache).count()
    assert stored == len({t or "" for _, t in rows})
    assert rows_of(token_counts.count_tokens(docs(spark, rows), path, cache)) == want
    assert token_counts.read_cache(spark, cache).count() == stored  # nothing was missing
    # What is stored is what is used.
    version = token_counts.tokenizer_version(path)
    spark.createDataFrame([(bytearray(hashlib.sha256(b"new").digest()), version, 777), (bytearray(hashlib.sha256(b"old").digest()), "other", 5)], token_counts.CACHE_SCHEMA).write.mode("append").parquet(cache)
    got = token_counts.count_tokens(docs(spark, [(1, "new"), (2, "old")]), path, cache)
    assert rows_of(got.select("doc_id", "n_tokens")) == [(1, 777), (2, count("old"))]
    assert token_counts.count_tokens(docs(spark, []), path, cache).count() == 0


def test_op5_query(spark, sf_dir):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    texts = dict(sources(spark, sf_dir))
    for r in queries.queries()["op5_token_counts"](spark, sf_dir).collect():
        n = len(library.encode(texts[r.doc_id], add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(texts[r.doc_id].encode()), n, n > 512)


# ---- 6

def test_chat_round_trip(spark):
    rnd = random.Random(6)
    bits = ["</s>", "[INST]", " [/INST]", "[OUT] ", "[ROLE x] ", " [/ROLE]", "<s>", "\\", "\\o", "[", "]", "text ", "\n", "é🙂", ""]
    rows = [(c, t, rnd.choice(["user", "assistant", "system", "to]ol[\\", ""]), "".join(rnd.choice(bits) for _ in range(rnd.randint(0, 8)))) for c in range(40) for t in range(rnd.randint(1, 5))]
    rows += [(100, None, None, None), (100, 0, "user", "x"), (100, 0, "user", "x"), (None, 1, "assistant", LONG), (None, 2, "assistant", "b</s>")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(1))
    want: dict = {}
    for c, t, role, text in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        want.setdefault(c, []).append((role or "", text or ""))
    made = chat.format_chats(df)
    for r in made.collect():
        assert "".join(s.text for s in r.segments) == r.formatted
    got = {r.conv_id: r for r in chat.read_back(made).collect()}
    assert {c: [tuple(t) for t in r.turns] for c, r in got.items()} == want
    assert {c: r.loss_text for c, r in got.items()} == {c: "".join(t for role, t in turns if role == "assistant") for c, turns in want.items()}
    assert chat.format_chats(df.limit(0)).count() == 0
    assert "PythonUDF" not in (plan := made._jdf.queryExecution().toString()) and "Python" not in plan and "Arrow" not in plan


# ---- 7

def test_warc_round_trip(spark, tmp_path):
    big = "".join(chr(32 + i % 90) for i in range(70_000)) + "\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n"
    rows = [(1, "http://a/", "<p>é🙂</p>"), (2, None, "<p>é🙂</p>"), (2, None, "<p>é🙂</p>"), (3, "u", None), (4, "u\r\nx", ""), (5, "v", big), (6, "v", big), (None, "w", "alone"), (None, "w", big), (7, "v", "0\r\n\r\n")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("payload", F.lit(1))
    warc.write_warc(df, str(tmp_path / "w"), segment_bytes=1000, chunk_bytes=300, records_per_file=3)
    got = warc.read_pages(spark, str(tmp_path / "w"))
    top: dict = {}
    for i, _, h in rows:
        top[h or ""] = max(top.get(h or "", -1), -1 if i is None else i)
    want = []
    for i, _, h in rows:
        payload, best = (h or "").encode(), top[h or ""]
        response = best == (-1 if i is None else i)
        want.append((i, "response" if response else "revisit", len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(), None if response else best, None))
    assert rows_of(got.select("page_id", "type", "payload_bytes", "payload_digest", "refers_to", "error")) == sorted(want, key=str)
    assert {bytes(r.payload).decode() for r in got.where("type = 'response'").collect()} == {h or "" for _, _, h in rows}
    warc.write_warc(df, str(tmp_path / "v"), min_revisit_bytes=1000)
    assert warc.read_pages(spark, str(tmp_path / "v")).where("type = 'revisit'").count() == 2
    warc.write_warc(df.limit(0), str(tmp_path / "e"))
    assert warc.read_pages(spark, str(tmp_path / "e")).count() == 0


def test_warc_broken_segments(spark):
    rec = [("a", "response", None, None, 1, None, None, None, b"ab"), ("a2", "continuation", None, "a", 2, 5, None, None, b"cd"), ("b", "response", None, None, 1, None, None, None, b"x"), ("b3", "continuation", None, "b", 3, 2, None, None, b"y"), ("c", "response", None, None, 1, None, None, None, b"1"), ("c2", "continuation", None, "c", 2, 3, None, None, b"23"), ("d", "response", None, None, None, None, None, None, b"whole")]
    got = {r.record_id: (r.complete, r.block and bytes(r.block)) for r in warc.reassemble(spark.createDataFrame(rec, warc._RECORDS)).collect()}
    assert got == {"a": (False, None), "b": (False, None), "c": (True, b"123"), "d": (True, b"whole")}
    for bad in (b"5\r\nab", b"zz\r\n", b"2\r\nabX"):
        with pytest.raises(ValueError):
            warc.dechunked(bad)
    assert warc.dechunked(b"2;x=y\r\nab\r\n0\r\nT: 1\r\n\r\n") == b"ab"
    import gzip

    one = warc.record([("WARC-Type", "x"), ("WARC-Record-ID", "<1>")], b"\r\n\r\n")
    assert [b for _, b in warc.parse_records(gzip.compress(one) + gzip.compress(one), piece=7)] == [b"\r\n\r\n"] * 2 == [b for _, b in warc.parse_records(one + one)]


# ---- 8

def test_suffix_array():
    rnd = random.Random(1)
    for _ in range(150):
        symbols = [rnd.randrange(rnd.choice([1, 2, 3, 250])) + 1 for _ in range(rnd.randint(1, 60))] * rnd.choice([1, 3]) + [0]
        want = sorted(range(len(symbols)), key=lambda i: symbols[i:])
        assert suffix_dedup.suffix_array(np.array(symbols), 258).tolist() == want == suffix_dedup.suffix_array(np.array(symbols), 4100).tolist()  # by lists, where it is long enough
        common = suffix_dedup.permuted_prefixes(np.array(symbols), np.array(want), 9)
        for a, b in zip(want, want[1:]):
            n = 0
            while n < 9 and a + n < len(symbols) and b + n < len(symbols) and symbols[a + n] == symbols[b + n]:
                n += 1
            assert common[b] == n


def test_suffix_array_of_repeats(monkeypatch):
    """Substrings that tie, as in copies of one text, are told apart by rounds over all of them: not level by level."""
    calls, real = [], suffix_dedup.suffix_array
    monkeypatch.setattr(suffix_dedup, "suffix_array", lambda *a: (calls.append(1), real(*a))[1])
    rnd = random.Random(5)
    for size in (2, 4, 250):
        symbols = [rnd.randrange(size) + 1 for _ in range(90)] * 9 + [0]
        assert suffix_dedup.suffix_array(np.array(symbols), 258).tolist() == sorted(range(len(symbols)), key=lambda i: symbols[i:])
    assert len(calls) == 3
    # Prefixes over the ends of words of several symbols, for narrow and wide symbols.
    for top in (1, 257, 70_000):
        for same in range(30):
            t = np.array([top] * same + [1 + (top == 1)] + [top] * same + [0])
            want = np.array(sorted(range(len(t)), key=lambda i: t[i:].tolist()))
            common = suffix_dedup.permuted_prefixes(t, want, 25)
            for a, b in zip(want, want[1:]):
                assert common[b] == next(n for n in range(26) if n == 25 or max(a, b) + n >= len(t) or t[a + n] != t[b + n])


def plain_dedup(rows, width):
    first: dict = {}
    order = sorted(((suffix_dedup._NULL if i is None else i), (t or "").encode()) for i, t in rows)
    for i, b in order:
        for p in range(len(b) - width + 1):
            first.setdefault(b[p : p + width], i)
    out = []
    for i, b in order:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - width + 1):
            if first[b[p : p + width]] < i:
                gone[p : p + width] = True
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((None if i == suffix_dedup._NULL else i, len(b), int(gone.sum()), int((gone & ~np.concatenate([[False], gone[:-1]])).sum()) if len(b) else 0, hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=str)


@pytest.mark.parametrize("width,block_bytes", [(12, 200), (20, 1 << 20)])
def test_suffix_dedup(spark, width, block_bytes):
    rnd = random.Random(8)
    passages = ["".join(rnd.choice("ab é") for _ in range(rnd.randint(5, 60))) for _ in range(6)]
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, "", "x" * rnd.randint(0, 80)]) if rnd.random() < 0.15 else "".join(rnd.choice(passages) if rnd.random() < 0.4 else "".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(1, 30))) for _ in range(rnd.randint(1, 8)))) for _ in range(60)]
    rows += rows[:5]
    got = suffix_dedup.dedup(docs(spark, rows), width=width, block_bytes=block_bytes)
    assert rows_of(got.drop("kept")) == plain_dedup(rows, width)
    assert all(hashlib.sha256(r.kept).hexdigest() == r.kept_sha256 for r in got.collect())
    assert suffix_dedup.dedup(docs(spark, [])).count() == 0


def test_op8_query(spark, sf_dir):
    assert rows_of(queries.queries()["op8_suffix_dedup"](spark, sf_dir)) == plain_dedup(sources(spark, sf_dir), 50)


# ---- 9

def near(a, b):
    if abs(len(a) - len(b)) > 1:
        return False
    a, b = sorted((a, b), key=len)
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else a[i:] == b[i + 1 :]


def xxh(x):
    import xxhash

    return int.from_bytes(xxhash.xxh64_digest(x.encode(), 42), "big", signed=True)


@pytest.mark.parametrize("bucket", [1, 1000])
def test_line_links(spark, bucket):
    rnd = random.Random(5)

    def changed(s):
        i, k, c = rnd.randrange(len(s) + 1), rnd.randrange(3), rnd.choice("abé🙂x")
        return s[:i] + c + s[i + 1 :] if k == 0 else s[:i] + c + s[i:] if k == 1 else s[:i] + s[i + 1 :]

    lines = {"the quick brown fox jumps over", "a" * 27, "lorem é dolor 🙂 sit amet", "x" * 7 + "y" * 9}
    for _ in range(150):
        lines.add(changed(rnd.choice(sorted(lines))))
    lines |= {"".join(rnd.choice("abc") for _ in range(rnd.randint(3, 12))) for _ in range(60)}
    by = {xxh(x): x for x in lines}
    found = [(by[r.a.h], by[r.b.h]) for r in line_dedup.line_links(spark.createDataFrame([(x,) for x in sorted(lines)] * 2, "line string"), edits=((2, 1),), bucket=bucket).collect()]
    assert all(a != b and near(a, b) for a, b in found)
    assert components(lines, found) == components(lines, [(a, b) for a in lines for b in lines if a < b and near(a, b)])


def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def test_within_edits(spark):
    rnd, rows = random.Random(3), []
    for _ in range(300):
        a = "".join(rnd.choice("abé") for _ in range(rnd.randint(0, 14)))
        b = list(a)
        for _ in range(rnd.randint(0, 5)):
            i = rnd.randrange(len(b) + 1)
            b[i : i + rnd.randint(0, 1)] = rnd.choice(["", "x", "a"])
        rows.append((a, "".join(b)))
    df = spark.createDataFrame(rows, "a string, b string")
    split = lambda c: F.filter(F.split(c, ""), lambda x: x != "")
    out = df.select("a", "b", *[line_dedup.within_edits(split("a"), split("b"), k).alias(f"k{k}") for k in (1, 2, 4)]).collect()
    assert all(r[f"k{k}"] == (edit_distance(r.a, r.b) <= k) for r in out for k in (1, 2, 4))


GROWING = ((1, 0), (20, 1), (36, 2), (72, 3), (144, 4))


@pytest.mark.parametrize("bucket", [1, 1000])
def test_growing_edits_by_brute_force(spark, bucket):
    rnd, lines = random.Random(9), set()

    def changed(s):
        i, k, c = rnd.randrange(len(s) + 1), rnd.randrange(3), rnd.choice("abé🙂x")
        return s[:i] + c + s[i + 1 :] if k == 0 else s[:i] + c + s[i:] if k == 1 else s[:i] + s[i + 1 :]

    for n in (18, 24, 36, 50, 73, 100, 147, 160, 290):
        base = "".join(rnd.choice("abcdefgh é") for _ in range(n))
        for _ in range(14):
            s = base
            for _ in range(rnd.randint(0, 5)):
                s = changed(s)
            lines.add(s)
    lines = sorted(lines)
    allowed = lambda n: max([k for low, k in GROWING if n >= low], default=-1)
    want = [(a, b) for a in lines for b in lines if b < a and abs(len(a) - len(b)) <= 4 and edit_distance(a, b) <= allowed(min(len(a), len(b)))]
    by = {xxh(x): x for x in lines}
    found = [(by[r.a.h], by[r.b.h]) for r in line_dedup.line_links(spark.createDataFrame([(x,) for x in lines] * 2, "line string"), edits=GROWING, bucket=bucket).collect()]
    assert components(lines, found) == components(lines, want)
    assert all(edit_distance(a, b) <= allowed(min(len(a), len(b))) for a, b in found)
    # Lines that one edit doesn't reach.
    assert any(edit_distance(a, b) == 4 for a, b in want) and components(lines, want) != components(lines, [(a, b) for a, b in want if near(a, b)])


def test_line_dedup_edges(spark):
    line = "this line is long enough"
    rows = [(2, f"{line}\nshort\nshort"), (1, f"{line}!\nother"), (3, line), (4, None), (5, ""), (3, line), (None, f"first\n{line}?"), (6, LONG), (7, LONG[:-1] + "\n")]
    got = line_dedup.dedup_lines(docs(spark, rows), carry=True)
    out = {(r.doc_id, r.n_lines, r.n_removed, r.kept_text) for r in got.collect()}
    assert (None, 2, 0, f"first\n{line}?") in out and (1, 2, 1, "other") in out and (2, 3, 2, "short") in out
    assert (3, 1, 1, "") in out and (4, 0, 0, None) in out and (5, 1, 0, "") in out and (6, 1, 0, LONG) in out
    assert (7, 2, 1, "") in out and got.count() == len(rows)
    assert line_dedup.dedup_lines(docs(spark, [])).count() == 0
    assert "Python" not in (plan := got._jdf.queryExecution().toString()) and "Arrow" not in plan


# ---- 10

def test_lm_edges(spark):
    got = {r.doc_id: r for r in lm_scoring.score(docs(spark, [(1, "A b"), (2, "a b"), (3, None), (4, ""), (5, "c a b")])).collect()}
    # Other documents of 1 have five words, two of them a; both that have a have b after it.
    assert got[1].n_words == 2 and got[1].n_backed_off == 0 and abs(got[1].log_score - np.log(2 / 5)) < 1e-9
    assert got[3].log_score == got[4].log_score == 0
    assert abs(got[5].log_score - (np.log(0.4 / 4) + np.log(0.4 * 2 / 4))) < 1e-9 and got[5].n_backed_off == 1
    assert lm_scoring.score(docs(spark)).count() == len(EDGES)
    assert lm_scoring.score(docs(spark, [])).count() == 0
