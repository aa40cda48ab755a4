"""SimHash components and multiset fingerprints against brute force."""

from __future__ import annotations

import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillstrata.llm import multiset_hash, simhash


def brute_fingerprint(text: str | None) -> int:
    text = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = [w for w in "".join(" " if c in " \t\n\x0b\x0c\r" else c for c in text).split(" ") if w]
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows: list[tuple]) -> dict:
    fps = [brute_fingerprint(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x: int) -> int:
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    out = {}
    for i, (d, _) in enumerate(rows):
        ids = [e for k, (e, _) in enumerate(rows) if root(k) == root(i) and e is not None]
        out.setdefault(d, set()).add((f"{fps[i]:016x}", min(ids) if ids else None))
    return out


def got(rows) -> dict:
    out: dict = {}
    for r in rows:
        out.setdefault(r.doc_id, set()).add((r.fingerprint, r.component_id))
    return out


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aAbÉß \t\n  .", max_size=60))
def test_fingerprint(text):
    assert simhash.fingerprint(text) == brute_fingerprint(text)


def test_forest_joins_what_links_join():
    rng = random.Random(3)
    values = [rng.getrandbits(64) for _ in range(12)]
    for v in list(values):
        for _ in range(12):
            v ^= sum(1 << b for b in rng.sample(range(64), rng.choice([1, 2, 3])))
            values.append(v)
    values = sorted(set(values))

    def classes(edges):
        parent = list(range(len(values)))

        def root(x):
            while parent[x] != x:
                x = parent[x]
            return x

        for a, b in edges:
            parent[root(a)] = root(b)
        return [min(k for k in range(len(values)) if root(k) == root(i)) for i in range(len(values))]

    links = [(i, j) for i in range(len(values)) for j in range(i) if (values[i] ^ values[j]).bit_count() <= 3]
    found = simhash.forest(np.array(values, np.uint64))
    assert all((values[a] ^ values[b]).bit_count() <= 3 for a, b in found)
    assert classes(found) == classes(links)


def test_components(spark, table, odd_texts):
    rng = random.Random(1)
    words = [f"w{i}" for i in range(300)]
    texts = list(odd_texts)
    for _ in range(15):
        base = [rng.choice(words) for _ in range(400)]
        for _ in range(4):
            copy = list(base)
            for _ in range(rng.choice([0, 1, 2])):
                copy[rng.randrange(len(copy))] = rng.choice(words)
            texts.append(" ".join(copy))
    ids = [(7 * i) % 1009 for i in range(len(texts))]
    ids[3], ids[5] = None, ids[6]
    docs = table(texts, ids)
    assert got(simhash.near_duplicates(docs).collect()) == brute_components(list(zip(ids, texts, strict=True)))


def test_one_row_of_each_class_stays(spark, table):
    texts = ["a b", "a b", "a b", None, "", "c d e", "c d e", "f"]
    ids = [5, 2, 2, None, None, None, None, None]
    docs = table(texts, ids)
    members = docs.select("doc_id", simhash.text_hash(docs["text"]).alias("_h"), simhash.text_hash(docs["text"]).alias("root"))
    rows = simhash.first_of_each(docs, members).collect()
    assert simhash.first_of_each(docs, members).columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in rows) == [(0, ""), (0, "c d e"), (0, "f"), (2, "a b")]


def test_heavy_groups_are_dealt_again(spark, monkeypatch):
    """One huge cluster: fingerprints that differ in their free bits only; and far ones that share its keys."""
    rng = random.Random(5)
    values = {rng.getrandbits(24) for _ in range(3000)} | {rng.getrandbits(64) for _ in range(300)}
    values |= {v ^ 1 << b for v in list(values)[:200] for b in (3, 40)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    fps = spark.createDataFrame([(v,) for v in signed], "fp bigint")
    monkeypatch.setattr(simhash, "HEAVY", 1 << 60)
    want = {(r.node, r.least) for r in simhash.components(simhash.links(fps)).collect()}
    monkeypatch.setattr(simhash, "HEAVY", 40)
    assert {(r.node, r.least) for r in simhash.components(simhash.links(fps)).collect()} == want
    bits = np.array(signed, np.int64).view(np.uint64)
    near = np.bitwise_count(bits[:, None] ^ bits[None, :]) <= 3
    reached, left = {}, set(range(len(bits)))
    while left:
        queue, group = [left.pop()], []
        while queue:
            x = queue.pop()
            group.append(x)
            more = set(np.flatnonzero(near[x]).tolist()) & left
            left -= more
            queue += more
        least = min(signed[x] for x in group)
        reached |= {signed[x]: least for x in group if signed[x] != least}
    assert want == set(reached.items())


def test_hot_copies_meet_their_class_by_broadcast(spark):
    texts = ["one and the same text"] * 1500 + [f"text number {k}" for k in range(50)] + [None] * 3
    rows = list(enumerate(texts))
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    found = simhash.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r.component_id for r in found if r.doc_id < 1500} == {0} and {r.component_id for r in found if r.doc_id >= 1550} == {1550}


def test_groups_are_the_same_however_rows_come():
    rng = np.random.default_rng(2)
    rows = np.column_stack((np.sort(rng.integers(0, 6, 400)), rng.integers(-(1 << 62), 1 << 62, 400), rng.integers(0, 1 << 40, (400, 2))))
    want = None
    for size in (1, 2, 7, 50, 400):
        batches = [pa.RecordBatch.from_arrays([pa.array(c) for c in rows[i : i + size].T], names=simhash._COLUMNS) for i in range(0, 400, size)]
        out = pa.Table.from_batches(simhash._searched(30)(iter(batches))).to_pylist()
        got = sorted(tuple(-1 if v is None else v for v in r.values()) for r in out)
        assert len(got) >= 20 * 390 and (want is None or got == want)
        want = got


def test_pivot_tables_discard_and_lose_nothing(spark):
    rng = random.Random(9)
    values = np.array(sorted({rng.getrandbits(64) for _ in range(400)}), np.uint64)
    table = simhash.table_of(values)
    rows = spark.createDataFrame([(int(v),) for v in values.view(np.int64)], "fp bigint").select("fp", *(c.alias(n) for c, n in zip(simhash.pivot_distances(F.col("fp")), ("near", "far"), strict=True))).collect()
    assert np.array([[r.near, r.far] for r in rows], np.int64).view(np.int8).tolist() == table.tolist()
    apart = np.abs(table[:, None, :].astype(int) - table[None, :, :]).max(axis=2)
    bits = np.bitwise_count(values[:, None] ^ values[None, :])
    assert (apart <= bits).all() and (apart > simhash.DISTANCE).mean() > 0.95


def test_components_of_a_chain_and_of_nothing(spark, table):
    chain = [0]
    for i in range(40):
        chain.append(chain[-1] ^ (0b111 << (i % 20) * 3))
    values = sorted({c - (1 << 64) if c >> 63 else c for c in chain})
    found = simhash.components(simhash.links(spark.createDataFrame([(v,) for v in values], "fp bigint"))).collect()
    assert {r.least for r in found} == {min(values)} and {r.node for r in found} == set(values) - {min(values)}
    assert simhash.near_duplicates(table([])).collect() == []


def test_multiset_algebra():
    parts = ["one two three four", "five", "one two three four", "", "seven eight nine ten eleven"]
    whole = multiset_hash.fingerprint("\n".join(parts))
    assert whole.hex() == multiset_hash.fingerprint("\n".join(reversed(parts))).hex()
    assert whole.copy().insert(["more of it"]).delete(["more of it"]).hex() == whole.hex()
    assert whole.copy().delete(parts).hex() == multiset_hash.fingerprint("").hex() == multiset_hash.fingerprint(None).hex()
    assert multiset_hash.fingerprint("\n".join(parts[1:])).hex() != whole.hex()
    again = multiset_hash.Fingerprint.from_hex(whole.hex())
    assert again.hex() == whole.hex() and again.likeness(whole) == 1.0


def brute_multiset(text: str | None) -> str:
    """The sums of all paragraphs' vectors, one whole number for each lane."""
    exact, sketch = [0] * 4, [0] * 256
    for line in (text or "").split("\n"):
        words = re.findall(rb"[^\x20\x09-\x0D]+", line.encode())
        if not words:
            continue
        digest = hashlib.blake2b(b" ".join(words), digest_size=32, person=b"paragraph").digest()
        exact = [e + int.from_bytes(digest[8 * i : 8 * i + 8], "little") for i, e in enumerate(exact)]
        for i in range(max(1, len(words) - 2)):
            h = xxhash.xxh3_64_intdigest(b" ".join(words[i : i + 3])) % 512
            sketch[h % 256] += 1 if h < 256 else -1
    return "".join(f"{e % 2**64:016x}" for e in exact) + "".join(f"{x % 2**32:08x}" for x in sketch)


def test_fingerprint_against_sums(odd_texts):
    for text in [*odd_texts, "a b c d\n\na b c d\nx", "the " * 65_538]:
        assert multiset_hash.fingerprint(text).hex() == brute_multiset(text)


def test_lanes_do_not_wrap():
    many, fewer = (multiset_hash.fingerprint("the " * n) for n in (33_000, 20_000))
    assert any(multiset_hash.fingerprint("the " * 65_538).sketch)
    assert many.likeness(fewer) > 0.85


def test_hot_ids_are_cut(spark):
    texts = [f"text number {k} " * (k % 7) for k in range(300)]
    docs = spark.createDataFrame([(None if k % 3 == 0 else k, t) for k, t in enumerate(texts)], "doc_id bigint, text string")
    dealt, runs = multiset_hash.in_runs(docs, 16)
    sizes = [r["count"] for r in dealt.groupBy("_run").count().collect()]
    assert runs >= 8 and max(sizes) < 60
    rows = multiset_hash.compare_with_next(docs).collect()
    assert sorted(r.n_chars for r in rows) == sorted(map(len, texts))


def test_compare_with_next(spark, table, odd_texts):
    texts = [*odd_texts, "x y z\n" * 40, "final"]
    ids = [100 - 3 * i for i in range(len(texts))]
    docs = table(texts, ids)
    rows = {r.doc_id: r for r in multiset_hash.compare_with_next(docs.repartition(3)).collect()}
    order = sorted(zip(ids, texts, strict=True))
    assert len(rows) == len(texts)
    for (d, t), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        t, following = t or "", following or ""
        edited = t[: len(t) - len(t) // 2] + following[: len(t) // 2]
        r = rows[d]
        a, b, c = (multiset_hash.Fingerprint.from_hex(brute_multiset(x)) for x in (t, edited, following))
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert (r.fingerprint, r.edited_fingerprint) == (a.hex(), b.hex())
        assert abs(r.near_edited - a.likeness(b)) < 1e-12 and abs(r.near_next - a.likeness(c)) < 1e-12


def test_likeness_tells_halves_from_strangers(spark, sf_dir):
    rows = multiset_hash.compare_with_next(spark.read.parquet(f"{sf_dir}/documents.parquet")).where("n_chars > 400").collect()
    assert all(0 <= x <= 1 for r in rows for x in (r.near_edited, r.near_next))
    assert np.mean([r.near_edited > 0.25 for r in rows]) > 0.9
    assert np.mean([r.near_edited > r.near_next for r in rows if r.near_next < 1]) > 0.97
    single = spark.createDataFrame([(5, "abc")], "doc_id bigint, text string")
    assert multiset_hash.compare_with_next(single).head().near_next == 1.0
    assert multiset_hash.compare_with_next(single.limit(0)).collect() == []
