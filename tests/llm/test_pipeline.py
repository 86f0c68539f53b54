"""The pipeline's stages: what each keeps is what its operator says, and the columns are those of documents."""

import base64
import re

import corpus_pipeline
from tests.llm.test_operators import near, plain_base, plain_hits, plain_print


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "line dedup", "near-dedup", "decontamination", "token ids"]
    tables = [docs]
    for _, stage in corpus_pipeline.STAGES:
        tables.append(stage(spark, tables[-1], sf_dir).cache())
    rows = [{r.doc_id: r for r in t.collect()} for t in tables]
    assert all(t.columns == docs.columns for t in tables[:-1])
    # 1: none that fails the base rules is left, and nearly all others are.
    passes = {i for i, r in rows[0].items() if (b := plain_base(r.text))[0] >= 50 and 100 * b[4] <= 50 * b[0]}
    assert set(rows[1]) <= passes and len(rows[1]) >= 0.9 * len(passes)
    # 2: no line of 20 characters is within an edit of an earlier one (short of chains through removed lines).
    assert set(rows[2]) == set(rows[1])
    kept: list = []
    for i in sorted(rows[2]):
        assert rows[2][i].n_chars == len(rows[2][i].text)
        for line in rows[2][i].text.split("\n"):
            if len(line) >= 20:
                assert not any(near(line, k) for k in kept if abs(len(k) - len(line)) < 2)
                kept.append(line)
    # 3: one of each component of fingerprints of five words.
    prints = {i: plain_print(r.text, 5) for i, r in rows[2].items()}
    parent = {i: i for i in prints}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in prints:
        for b in prints:
            if b < a and (prints[a] ^ prints[b]).bit_count() <= 2:
                x, y = root(a), root(b)
                parent[max(x, y)] = min(x, y)
    assert set(rows[3]) == {root(i) for i in prints}
    # 4
    items = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()]
    find = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
    windows = {tuple(w[i : i + 10]) for _, t in items for w in [find(t)] for i in range(len(w) - 9)}
    suspect = {i for i, r in rows[3].items() if any(tuple(w[k : k + 10]) in windows for w in [find(r.text)] for k in range(len(w) - 9))}
    short = [x for x in items if len(find(x[1])) < 10]
    hit = {i for i in rows[3] if i in suspect or short and plain_hits(rows[3][i].text, short, 10)[1]}
    assert set(rows[4]) == set(rows[3]) - hit
    # 5
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {i: r.ids for i, r in rows[5].items()} == {i: library.encode_ordinary(r.text) for i, r in rows[4].items()}
    assert {r.doc_id for r in corpus_pipeline.run(spark, sf_dir).collect()} == set(rows[5])
