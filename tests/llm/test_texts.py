"""Tokens, quality rules, main text, mixing and the two classifiers."""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import public_tokenizers
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from quillstrata.llm import bpe, extract, langid, linear, mixing, nbsvm, queries, repetition
from quillstrata.llm.layouts import made_page

BPE = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def encoding():
    with open(BPE, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=80), st.text(alphabet="abe th'sEÉ0 \n", max_size=400), st.text(alphabet="aA", max_size=300)))
def test_bpe_is_that_of_the_library(encoding, text):
    own = bpe.coder(BPE, public_tokenizers.PATTERN)
    text = text.encode("utf-8", "replace").decode()
    ids = own.encode(text)
    assert ids == encoding.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_bpe_join_is_the_monoid(encoding):
    own = bpe.coder(BPE, public_tokenizers.PATTERN)
    data = "antidisestablishmentarianismüberraschungaaaaaaabbbbbbb".encode()
    whole = own.encode_bytes(data)
    for cut in range(len(data) + 1):
        assert own.join(own.merge(data[:cut]) if cut else [], own.merge(data[cut:]) if cut < len(data) else []) == whole == own.merge(data)


def test_bpe_query(spark, table, odd_texts, encoding):
    texts = [*odd_texts, "x" * 30_000, " " * 5000 + "end"]
    rows = bpe.encode_documents(table(texts), BPE, public_tokenizers.PATTERN, with_ids=True).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = encoding.encode_ordinary(texts[r.doc_id] or "")
        assert r.ids == ids and r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256((texts[r.doc_id] or "").encode()).hexdigest()
    assert bpe.encode_documents(table([]), BPE, public_tokenizers.PATTERN).collect() == []


def test_bpe_decodes_up_a_tree(encoding):
    own = bpe.coder(BPE, public_tokenizers.PATTERN)
    text = "Größe of many words, 12 and 東京. " * 9000
    ids = own.encode(text)
    assert len(ids) > 1 << 16 and ids == encoding.encode_ordinary(text) and own.decode(ids) == text.encode()
    assert own.decode([]) == b""


def brute_rules(text: str | None) -> tuple:
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = text.split("\n")
    dup = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) and x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 500 else None
    grams = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    inside = {i + k for i in range(len(words) - 4) if grams[tuple(words[i : i + 5])] > 1 for k in range(5)}
    n = len(words)
    return n, sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(inside), n < 10 or 100 * len(inside) > 20 * n


def test_quality_rules(spark, table, odd_texts):
    texts = [*odd_texts, "a b c d e " * 4, "a b c d e f\n" * 2 + "#x | y <z>", " ".join(map(str, range(40))) + " 1 2 3 4 5 6", "\n\n x\n x\n\tx\n x"]
    rows = repetition.quality_report(table(texts)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        want = brute_rules(texts[r.doc_id])
        have = (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines if want[3] is not None else None, r.n_repeat_words, r.base_failed)
        assert have == want
        assert not (r.kept and r.base_failed)
    assert repetition.quality_report(table([])).collect() == []


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 4), max_size=40))
def test_repeats_against_all_substrings(symbols):
    number: dict = {}
    ids = np.array([number.setdefault(s, len(number)) for s in symbols], np.int64)
    n = len(symbols)
    want = [max((k for k in range(1, n - i + 1) if any(symbols[i : i + k] == symbols[j : j + k] for j in range(n) if j != i and j + k <= n)), default=0) for i in range(n)]
    assert repetition.repeat_lengths(ids).tolist() == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60))
def test_both_ways_to_common_prefixes_agree(symbols):
    number: dict = {}
    ids = np.array([number.setdefault(s, len(number)) for s in symbols], np.int64)
    if len(ids) > 1:
        one, other = repetition.prefixes_by_tables(ids), repetition.prefixes_by_scan(ids)
        assert [x.tolist() for x in one] == [x.tolist() for x in other]


def test_the_method_rejects_what_base_rules_keep(spark, table):
    clean = " ".join(f"w{i}" for i in range(900))
    passage = " ".join(f"p{i}" for i in range(60))
    texts = [clean, f"{passage} {clean} {passage}", " ".join(f"x{i} " * 5 for i in range(12)), " ".join(f"{passage} c{k}" for k in range(1)) + clean]
    rows = {r.doc_id: r for r in repetition.quality_report(table(texts)).collect()}
    assert not any(r.base_failed for r in rows.values())
    assert [rows[k].kept for k in range(4)] == [True, False, False, True]
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").where("doc_id IN (1847, 7628)")
    assert [(r.base_failed, r.kept) for r in repetition.quality_report(docs).collect()] == [(False, False)] * 2


def test_quality_keeps_clean_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1").select("doc_id")
    rows = repetition.quality_report(docs.join(labels, "doc_id")).where("NOT base_failed").collect()
    assert sum(r.kept for r in rows) / len(rows) > 0.97
    kept = repetition.kept_documents(docs)
    assert kept.columns == docs.columns


@pytest.mark.parametrize("html,want", [
    (None, []), ("", []), ("<p>", []), ("<script>x</script>", []),
    ("<body><nav><a href=/>Home</a></nav><article><h1>T &amp; U</h1><p>One\n two<br>three</p><p>Four words are here now.</article><footer>&copy; me</footer>", ["T & U", "One two three", "Four words are here now."]),
    ("<div id=content><p>" + "Long text with words, and more of them. " * 8 + "</p></div><div class='sidebar'><ul><li><a href=x>link one</a><li><a href=y>link two</a></ul></div>", [("Long text with words, and more of them. " * 8).strip()]),
])
def test_main_text_of_small_pages(html, want):
    assert next(extract.extract_batch([html], extract.trained())) == want


def test_main_text_of_made_pages():
    pages = [made_page(10_000 + k) for k in range(150)]
    hit = missed = extra = 0
    for (_, want), found in zip(pages, extract.extract_batch([h for h, _ in pages], extract.trained()), strict=True):
        same = sum((Counter(want) & Counter(found)).values())
        hit, missed, extra = hit + same, missed + len(want) - same, extra + len(found) - same
    assert hit / (hit + missed) > 0.97 and hit / (hit + extra) > 0.97


_ARTICLE = "<h1>Title of it</h1><p>" + "Some words of an article, which go on. " * 6 + "</p><p>" + "Another paragraph; with more text in it. " * 5 + "</p>"
_BLOCKS = ["Title of it", ("Some words of an article, which go on. " * 6).strip(), ("Another paragraph; with more text in it. " * 5).strip()]


@pytest.mark.parametrize("page", [
    f"<html><head><title>x</title><meta a=b><body><nav><a href=/>Home</a></nav><article>{_ARTICLE}</article><footer>(c) me</footer>",
    f"<title>x</title><link rel=x><article>{_ARTICLE}</article><footer>(c) me</footer>",
    f"<article>{_ARTICLE.replace('</p>', '')}</article><footer>(c) me</footer>",
    f"<article>{_ARTICLE.replace('</p><p>', '<button>OK</p><p>')}</article><footer>(c) me</footer>",
    f"<article><button>Share{_ARTICLE}</article><footer>(c) me</footer>",
    f"<article>{_ARTICLE.replace('on. Some', 'on. <button>OK</button> Some')}</article><footer>(c) me</footer>",
    f'<article><div data-x="<p>no</p>{"x" * 1_000_000}">{_ARTICLE}</div></article><footer>(c) me</footer>',
    f"<article>{_ARTICLE.replace('Title', '<math><mi>Title</mi><annotation>z</annotation></math>')}</article><footer>(c) me</footer>",
    f"<article>{_ARTICLE.replace('Title', '<svg><text>no</text></svg>Title')}</article><footer>(c) me</footer>",
    f"<article><svg><path>{_ARTICLE}</article><footer>(c) me</footer>",
    f"<article><video src=x>{_ARTICLE}</article><footer>(c) me</footer>",
])
def test_main_text_loses_nothing(page):
    assert next(extract.extract_batch([page], extract.trained())) == _BLOCKS


def test_main_text_of_deep_and_wide_pages():
    deep = "<div>" * 5000 + f"<article>{_ARTICLE}</article>" + "</div>" * 5000
    assert next(extract.extract_batch([deep], extract.trained()))[:3] == _BLOCKS
    many = [f"Paragraph {i} of a long article, with some words of its own." for i in range(3000)]
    wide = "<nav><a href=/>Home</a></nav><article>" + "".join(f"<p>{p}</p>" for p in many) + "</article><footer>(c) me</footer>"
    assert next(extract.extract_batch([wide], extract.trained())) == many


def _shapes(n: int):
    """The parents of the nodes of every tree of n nodes, in document order."""
    import itertools

    return (p for p in itertools.product(*(range(i) for i in range(1, n))) if all(p[i] in _open(p[:i]) for i in range(len(p))))


def _open(parents) -> set:
    """Nodes that may get a further child in document order: the last one and those above it."""
    at, found = len(parents), set()
    while True:
        found.add(at)
        if at == 0:
            return found
        at = parents[at - 1]


@pytest.mark.parametrize("size", range(1, 7))
def test_decoding_of_every_small_tree(size):
    import itertools

    class U:
        def __init__(self):
            self.below, self.runs = [], []

    rng = np.random.default_rng(size)
    for parents in _shapes(size):
        units = [U() for _ in range(size)]
        for k, p in enumerate(parents, 1):
            units[p].below.append(k)
        leaves = [k for k, u in enumerate(units) if not u.below]
        for n, k in enumerate(leaves):
            units[k].runs = [n]
        under = [[n for n, leaf in enumerate(leaves) if _under(parents, leaf, k)] for k in range(size)]
        for _ in range(6):
            whole, some = rng.normal(size=size) * 2, rng.normal(size=size) * 2
            costs = {}
            for on in itertools.product([False, True], repeat=len(leaves)):
                every, any_of = [all(on[n] for n in u) for u in under], [any(on[n] for n in u) for u in under]
                costs[tuple(n for n, x in enumerate(on) if x)] = sum(np.logaddexp(0, -w if e else w) + np.logaddexp(0, -s if a else s) for w, s, e, a in zip(whole, some, every, any_of, strict=True))
            assert tuple(extract.decode(units, whole, some)) == min(costs, key=costs.get)


def _under(parents, node: int, top: int) -> bool:
    while node > top:
        node = parents[node - 1]
    return node == top


def test_decoding_is_consistent_and_best():
    """Against all labellings of small trees."""
    import itertools

    from quillstrata.llm.dom import parse

    nodes, _ = parse("<div><p>a</p><div><p>b</p><p>c</p></div></div><p>d</p>")
    units = extract.units_of(nodes[0])
    leaves = [u.runs[0] for u in units if not u.below]
    rng = np.random.default_rng(0)
    for _ in range(40):
        whole, some = rng.normal(size=len(units)) * 2, rng.normal(size=len(units)) * 2
        best, kept = None, None
        for chosen in itertools.product([0, 1], repeat=len(leaves)):
            on = dict(zip(leaves, chosen, strict=True))
            cost = 0.0
            for i, u in enumerate(units):
                below = [i]
                runs = []
                while below:
                    v = units[below.pop()]
                    below += v.below
                    runs += [] if v.below else v.runs
                w, s = all(on[r] for r in runs), any(on[r] for r in runs)
                cost += np.logaddexp(0, -whole[i] if w else whole[i]) + np.logaddexp(0, -some[i] if s else some[i])
            if best is None or cost < best:
                best, kept = cost, [r for r in leaves if on[r]]
        assert extract.decode(units, whole, some) == sorted(kept)


def test_main_text_query(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").selectExpr("page_id", "url", "html", "'x' AS text", "1 AS n_chars")
    more = spark.createDataFrame([(None, None, None, "", 1), (-1, "u", "", "", 1)], "page_id bigint, url string, html string, text string, n_chars int")
    rows = extract.extract_pages(pages.unionByName(more)).collect()
    assert len(rows) == pages.count() + 2
    source = {r.page_id: r.html for r in pages.collect()}
    for r in rows:
        assert r.n_chars == len(r.text)
        if r.page_id not in source:
            assert r.text == ""
            continue
        article = re.search("<article>(.*)</article>", source[r.page_id], re.S)[1]
        import html

        blocks = [" ".join(html.unescape(re.sub("<[^>]*>", " ", b)).split()) for b in re.split("</?(?:p|h1)>", article)]
        assert r.text == "\n\n".join(b for b in blocks if b)
    assert extract.extract_pages(pages.limit(0)).collect() == []


def in_duckdb(docs) -> dict:
    documents = docs.toPandas()  # noqa: F841
    con = duckdb.connect()
    con.register("documents", documents)
    return {r[0]: r[1:] for r in con.execute(f"SELECT doc_id, size, source_size, target, taken FROM ({queries.OP6_SQL})").fetchall()}


def test_mixing(spark, table, odd_texts):
    texts = [*odd_texts, *("w " * (k % 40 + 1) for k in range(400))]
    sources = [["a", "b", None, "c", "é", ""][k % 6 if k % 3 else 0] for k in range(len(texts))]
    docs = table(texts, sources=sources)
    rows = mixing.mix_report(docs).collect()
    want = in_duckdb(docs.select("doc_id", "text", "source"))
    assert len(rows) == len(texts)
    taken: dict = {}
    for r in rows:
        assert (r["size"], r.source_size, r.taken) == (want[r.doc_id][0], want[r.doc_id][1], want[r.doc_id][3])
        assert abs(r.target - want[r.doc_id][2]) < 1e-6 and r.taken <= 2 * r["size"]
        taken.setdefault(sources[r.doc_id], [0, r.target, 0])[0] += r.taken
        taken[sources[r.doc_id]][2] = max(taken[sources[r.doc_id]][2], r["size"])
    for total, target, largest in taken.values():
        assert abs(total - target) <= 2 * largest + 1
    assert sum(t for _, t, _ in taken.values()) == pytest.approx(1.5 * sum(r["size"] for r in rows))
    again = {r.doc_id: r.taken for r in mixing.mix_report(docs.repartition(7)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}
    copies = Counter(r.doc_id for r in mixing.mixed_documents(docs).collect())
    assert all(copies[r.doc_id] * r["size"] == r.taken for r in rows)
    assert mixing.mixed_documents(docs).columns == docs.columns
    assert mixing.mix_report(table([])).collect() == [] and mixing.mix_report(table([None, ""], sources=[None, None])).count() == 2


def test_mixing_keeps_columns_that_have_its_own_names(spark):
    rows = [(k, "a b c " * (k % 5), "s", k, "n", k, f"c{k}", 1.0) for k in range(40)] + [(None, None, None, 0, None, 0, None, None)] * 3
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, _source bigint, _null string, size bigint, _row string, target double")
    mixed = mixing.mixed_documents(docs)
    assert mixed.columns == docs.columns
    taken = {r.doc_id: r.taken for r in mixing.mix_report(docs).collect() if r.doc_id is not None}
    found = [tuple(r) for r in mixed.collect()]
    assert set(found) <= set(rows) and all(found.count(row) * len(row[1].split()) == taken[row[0]] for row in rows[:40])


def test_equal_rows_are_rows_of_their_own(spark):
    docs = spark.createDataFrame([(1, "a b", "s")] * 101 + [(None, "c d e", "t")] * 50, "doc_id bigint, text string, source string")
    report = mixing.mix_report(docs).collect()
    assert len(report) == 151
    for source, size in (("s", 2), ("t", 3)):
        own = [r for r in report if r["size"] == size]
        assert abs(sum(r.taken for r in own) - own[0].target) <= 2 * size
    assert mixing.mixed_documents(docs).count() == sum(r.taken // r["size"] for r in report)


def brute_dual(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """The hinge-loss optimum by projected gradient steps on the dual, with the bias as a constant feature."""
    z = np.column_stack((x, np.ones(len(x)))) * y[:, None]
    gram, alpha = z @ z.T, np.zeros(len(y))
    step = 1 / np.linalg.eigvalsh(gram)[-1]
    for _ in range(200_000):
        alpha = np.clip(alpha - step * (gram @ alpha - 1), 0, cost)
    return z.T @ alpha


def test_coordinate_descent_finds_the_dual_optimum():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 4))
    y = np.where(x[:, 0] + 0.5 * rng.normal(size=30) > 0, 1.0, -1.0)
    cost = np.where(y > 0, 0.5, 1.5)
    w = linear.fit_hinge([(np.arange(4), v) for v in x], y, 4, cost, passes=20_000, tol=1e-10)
    assert np.allclose(w, brute_dual(x, y, cost), atol=1e-4)


def test_quality_weights_are_log_count_ratios_times_the_machines(monkeypatch):
    """The whole model against counts in a dictionary and the dual by projected gradient."""
    texts = [("good plain words here", 1), ("good words and more", 1), ("plain good text", 1), ("bad # words", 0), ("bad ## text here", 0)]
    sets = [set(np.concatenate([np.asarray(p) for p in nbsvm.ngrams(t)]).tolist()) for t, _ in texts]
    ratio = {}
    for g in set().union(*sets):
        p, q = (sum(g in s for s, (_, v) in zip(sets, texts, strict=True) if v == label) for label in (1, 0))
        ratio[g] = np.log((p + 1) / (3 + 2)) - np.log((q + 1) / (2 + 2))
    names = sorted(g for g in ratio if ratio[g] != 0)
    x = np.array([[ratio[g] * (g in s) for g in names] for s in sets])
    y = np.array([1.0 if v else -1.0 for _, v in texts])
    cost = np.where(y > 0, 5 / (2 * 3), 5 / (2 * 2)) / 100
    want = brute_dual(x, y, cost)
    exact = linear.fit_hinge
    monkeypatch.setattr(nbsvm, "fit_hinge", lambda rows, sign, width, c: exact(rows, sign, width, c, passes=20_000, tol=1e-12))
    model = nbsvm.fit(texts, least=1)
    for s, (t, _) in zip(sets, texts, strict=True):
        index = nbsvm.distinct(t, model.known, len(model.weights))
        have = float(model.weights[index].sum()) + model.bias
        assert abs(have - (sum(want[i] * ratio[g] for i, g in enumerate(names) if g in s) + want[-1])) < 1e-4


def test_long_texts_are_one_text_to_the_classifier(monkeypatch):
    text = "some words that, after a while, are repeated repeated. é東 " * 60 + "word " * 50
    whole = set(np.concatenate([np.asarray(p) for p in nbsvm.ngrams(text)]).tolist())
    for size in (7, 64, 1000):
        monkeypatch.setattr(nbsvm, "CHUNK", size)
        assert set(np.concatenate([np.asarray(p) for p in nbsvm.ngrams(text)]).tolist()) == whole


def test_language_machines_against_the_dual():
    texts = [("the cat and the dog", "en"), ("the big house there", "en"), ("der Hund und die Katze", "de"), ("das große Haus dort", "de"), ("le chat et le chien", "fr"), ("la maison est grande", "fr")]
    model = langid.fit(texts)
    assert model.families == ["germanic", "romance"] and model.pairs == [("de", "en")]
    cells = [langid.features(t) for t, _ in texts]
    used = sorted(set(np.concatenate([i for i, _ in cells]).tolist()))

    def dense(rows):
        x = np.zeros((len(rows), len(used)))
        for k, (index, value) in enumerate(rows):
            x[k, np.searchsorted(used, index)] = value
        return x

    for column, (rows, labels) in enumerate([
        (cells, [1.0 if lang in ("en", "de") else -1.0 for _, lang in texts]), (cells, [1.0 if lang == "fr" else -1.0 for _, lang in texts]), (cells[:4], [-1.0, -1.0, 1.0, 1.0]),
    ]):
        y = np.array(labels)
        cost = 10.0 * np.array([len(y) / (2 * (y == v).sum()) for v in y])
        want = brute_dual(dense(rows), y, cost)
        have = np.array([float(model.weights[i, column] @ v) + model.bias[column] for i, v in rows])
        assert np.allclose(have, dense(rows) @ want[:-1] + want[-1], atol=0.05)


def test_every_language_is_learnt(spark, table):
    texts = [f"{lang} text number {k} of " + "words " * 8 for lang in range(80) for k in range(6)] + ["ab"] * 12 + ["long words " * 600] * 12
    langs = [f"l{lang}" for lang in range(80) for _ in range(6)] + ["short"] * 12 + ["long"] * 12
    taken = langid.sample(table(texts, langs=langs), per_lang=3)
    assert {lang for _, lang in taken} == set(langs)
    assert max(Counter(lang for _, lang in taken).values()) <= 3
    mixed = langid.sample(table(["x" * 10, "proper words " * 5] * 30, langs=["a"] * 60), per_lang=4)
    assert all(len(t) >= 40 for t, _ in mixed)


def test_hinge_separates():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(300, 5))
    y = np.where(x @ np.array([1, -2, 0.5, 0, 0]) + 0.3 > 0, 1.0, -1.0)
    rows = [(np.arange(5), v) for v in x]
    w = linear.fit_hinge(rows, y, 5, cost=10.0, passes=200)
    assert (np.sign(linear.margins(rows, w)) == y).mean() > 0.98
    assert linear.fit_hinge([], np.array([]), 4).tolist() == [0.0] * 5


def test_quality_classifier(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op2_quality_nbsvm(spark, sf).collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows)
    own = [r for r in rows if r.held_out and r.doc_id in labels]
    assert np.mean([r.predicted == labels[r.doc_id] for r in own]) > 0.8


def test_quality_classifier_edges(spark, table, odd_texts):
    none = nbsvm.fit([])
    assert none.score("x") == 0.5 and nbsvm.fit([("a", 1)]).score(None) > 0.99
    labels = spark.createDataFrame([(3, 1), (4, None), (None, 0)], "doc_id bigint, quality int")
    docs = table(odd_texts)
    model = nbsvm.fit(nbsvm.sample(docs, labels))
    assert nbsvm.classify(docs, model).count() == len(odd_texts)
    real = nbsvm.fit([("good words in a sentence.", 1)] * 8 + [("$$$ ### |||", 0)] * 8)
    assert real.score("more good words here.") > real.score("### $$$")
    assert nbsvm.sample(docs, labels.limit(0)) == [] and nbsvm.classify(table([]), real).collect() == []


def test_language(spark):
    sf = "/root/testdata/sf0.01"
    rows = queries.op10_language(spark, sf).collect()
    docs = {r.doc_id: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    own = [r for r in rows if r.held_out and docs[r.doc_id].lang]
    assert np.mean([r.lang_pred == docs[r.doc_id].lang for r in own]) > 0.95


def test_language_edges(spark, table, odd_texts):
    model = langid.fit([("the cat and the dog", "en"), ("der Hund und die Katze", "de"), ("le chat et le chien", "fr"), ("el gato y el perro", "es")] * 3)
    assert model.predict(None) == model.predict("12 !?") == ("und", 0.0)
    assert model.predict("the dog")[0] == "en" and model.predict("die Katze")[0] == "de"
    assert langid.fit([]).predict("text") == ("und", 0.0) and langid.fit([("one", "xx")]).predict("two")[0] == "xx"
    rows = langid.identify(table(odd_texts), model).collect()
    assert len(rows) == len(odd_texts) and {r.lang_pred for r in rows if r.doc_id < 3} == {"und"}
    assert langid.sample(table(odd_texts, langs=[None] * len(odd_texts))) == [] and langid.identify(table([]), model).collect() == []


def test_folds_are_never_learnt(spark, table):
    texts = [f"common words number{k} in a longer sentence of its own" for k in range(60)]
    taken = {t for t, _ in langid.sample(table(texts))}
    assert all((t in taken) == (zlib.crc32(str(k).encode()) % 4 != 2) for k, t in enumerate(texts))
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)], "doc_id bigint, quality int")
    taken = {t for t, _ in nbsvm.sample(table(texts), labels)}
    assert all((t in taken) == (zlib.crc32(str(k).encode()) % 5 != 0) for k, t in enumerate(texts))
