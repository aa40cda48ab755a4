"""Near copies of the pipeline against brute force over exact Jaccard similarities."""

from __future__ import annotations

import random

from quillstrata.llm import near_copies, simhash, stages


def brute_first(rows: list[tuple]) -> set:
    def shingles(text):
        words = (text or "").lower().split()
        return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))}

    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                root = [root[j] if r == root[i] else r for r in root]
    return {min(rows[k][0] for k in range(len(rows)) if root[k] == r) for r in set(root)}


def test_near_dedup_finds_all_of_similarity_0_8(spark, table):
    rng = random.Random(7)
    words = [f"w{i}" for i in range(3000)]
    texts: list = [None, "", " ", "one", "One", "a b", "a b c d e f"]
    for size in (40, 60, 150, 400):
        for _ in range(4):
            base = [rng.choice(words) for _ in range(size)]
            for k in (0, 1, 2, 3):
                copy = list(base)
                for _ in range(k * size // 150 + (k > 0)):
                    copy[rng.randrange(size)] = rng.choice(words)
                texts.append(" ".join(copy))
    ids = [(7 * i) % 1009 for i in range(len(texts))]
    docs = table(texts, ids)
    kept = stages.near_dedup(spark, docs, "")
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == brute_first(list(zip(ids, texts, strict=True)))


def test_near_dedup_on_the_given_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert {r.doc_id for r in stages.near_dedup(spark, docs, sf_dir).collect()} == brute_first([(r.doc_id, r.text) for r in docs.collect()])


def test_components_of_many_blocks(spark, table, monkeypatch):
    """A chain of copies, a cluster around one text, and texts that are only half alike, in blocks of a few texts."""
    rng = random.Random(11)
    words = [f"w{i}" for i in range(2000)]
    chain = [rng.choice(words) for _ in range(120)]
    texts = []
    for k in range(40):
        texts.append(" ".join(chain))
        chain = [*chain[2:], *(rng.choice(words) for _ in range(2))]
    base = [rng.choice(words) for _ in range(150)]
    for k in range(60):
        copy = list(base)
        for _ in range(k % 5):
            copy[rng.randrange(150)] = rng.choice(words)
        texts.append(" ".join(copy))
    rng.shuffle(texts)
    rows = list(enumerate(texts))
    want = brute_first(rows)
    assert 2 <= len(want) < 60
    for block, heavy in ((300, 1 << 60), (1500, 8)):
        monkeypatch.setattr(near_copies, "BLOCK", block)
        monkeypatch.setattr(simhash, "HEAVY", heavy)
        kept = stages.near_dedup(spark, table(texts), "")
        assert {r.doc_id for r in kept.collect()} == want
