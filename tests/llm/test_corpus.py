"""Phrases, source divergence and near vectors against plain Python on odd rows."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cadenza.llm import common, divergence, phrases, vector_join

LOWER = str.maketrans({chr(k): chr(k + 32) for k in range(65, 91)})


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def odd_corpus(seed=5, many=160):
    """Few words, so phrases repeat; nulls, empty texts, breaks, a long text, repeated rows and words beyond ASCII."""
    r = random.Random(seed)
    vocab = ["the", "The", "New", "york", "new", "café", "über", "a1", "x-y", "日本", "the."]
    rows = [(k, "".join(r.choice(vocab) + r.choice([" ", " ", "  ", "\t", ", ", "\n", " . "]) for _ in range(r.randint(0, 60))), r.choice(["en", "de", None, "und", ""]), r.choice(["s0", "s0", "s1", None, "s2", "ß"])) for k in range(many)]
    rows += [(900, None, "en", "s0"), (901, "", "xx", "s9"), (902, "new york " * 20_000, "en", "s1"), (903, " \t\n", None, None), (904, "1 2 3", "fr", "only"), (905, "Solo solo word", "en", "s9"), *rows[:5]]
    return rows


def corpus(spark, rows):
    """With columns whose names the operators use inside."""
    return spark.createDataFrame([(*x, "v", 1) for x in rows], "doc_id long, text string, lang string, source string, score string, n long")


def brute_phrases(rows, least, num, den, first):
    f = collections.Counter()
    n = collections.Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\n-\r]", (text or "").translate(LOWER)):
            w = re.findall("[^ \t]+", piece)
            n[lang] += len(w)
            f.update((lang, tuple(w[i : i + k])) for k in range(1, 5) for i in range(len(w) - k + 1))
    f = {k: v for k, v in f.items() if v >= least}
    kept = {k: a for k, a in f.items() if len(k[1]) > 1}
    for (lang, w), a in [x for x in kept.items()]:
        if any(g[0] == lang and len(g[1]) > len(w) and any(g[1][i : i + len(w)] == w for i in range(len(g[1]))) and den * b >= num * a for g, b in f.items()):
            del kept[lang, w]
    out = []
    for lang in {k[0] for k in kept}:
        own = []
        for (g, w), a in kept.items():
            if g == lang:
                score, _, l, r = min((2_000_000 * a // (f[g, w[:k]] + f[g, w[k:]]), k, f[g, w[:k]], f[g, w[k:]]) for k in range(1, len(w)))
                own.append((-score, -a, " ".join(w).encode(), l, r))
        out += [(lang, k, p.decode(), -a, l, r, n[lang], -s) for k, (s, a, p, l, r) in enumerate(sorted(own)[:first], 1)]
    return sorted(out, key=repr)


@pytest.mark.parametrize("width", [phrases.BLOCKS, 1 << 12])  # of 32 counters, which let everything through, and of enough
def test_phrases_of_odd_rows(spark, width):
    rows = odd_corpus()
    found = phrases.collocations(corpus(spark, rows), least=12, first=40, width=width)
    expected = brute_phrases(rows, 12, 80, 100, 40)
    assert rows_of(found) == expected and len(expected) > 40


def test_phrases_of_many_stretches(spark, monkeypatch):
    """Phrases over the ends of stretches and slices are counted once, in this process."""
    rows = odd_corpus(6, 60)
    source = corpus(spark, rows).select("text", F.coalesce("lang", F.lit("und")).alias("lang"))
    import pyarrow as pa

    batch = pa.RecordBatch.from_pylist([r.asDict() for r in source.collect()])
    monkeypatch.setattr(phrases, "STRETCH", 7)
    many = collections.Counter()
    for langs, w, lang, hashed, begin, end in phrases._stretches(batch):
        for n, (h, whole) in enumerate(phrases._hashed(w, lang, phrases._salts(langs), hashed, begin, end), 1):
            many.update((n, x) for x in h[whole].tolist())
    monkeypatch.setattr(phrases, "STRETCH", 10**9)
    once = collections.Counter()
    for langs, w, lang, hashed, begin, end in phrases._stretches(batch):
        for n, (h, whole) in enumerate(phrases._hashed(w, lang, phrases._salts(langs), hashed, begin, end), 1):
            once.update((n, x) for x in h[whole].tolist())
    assert many == once


def test_sketch_never_counts_too_little(spark):
    rows = odd_corpus(7, 80)
    docs = corpus(spark, rows)
    exact = {(r.lang, r.phrase): r.f for r in phrases.counted(docs, 1, np.ones((phrases.DEPTH, phrases.BLOCKS), np.uint8)).collect()}
    table = phrases.sketch(docs, 200, 1 << 12)
    for least in (5, 200):
        found = {(r.lang, r.phrase): r.f for r in phrases.counted(docs, least, table).collect()}
        assert found == {k: v for k, v in exact.items() if v >= least or not k[1]}
    assert table.dtype == np.uint8 and table.max() == 200


def test_phrases_of_no_rows(spark):
    none = corpus(spark, odd_corpus()).limit(0)
    assert phrases.collocations(none).collect() == []
    assert phrases.collocations(corpus(spark, [(1, None, None, None)]), least=1).collect() == []


def brute_audit(rows, least, first):
    count, docs, groups = collections.Counter(), collections.Counter(), set()
    for _, text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", (text or "").translate(LOWER))
        count.update((lang, source, t) for t in terms)
        docs.update((lang, t) for t in set(terms))
    out = []
    for lang, source in groups:
        kept = [t for (g, t), d in docs.items() if g == lang and d >= least]
        sources = [s for g, s in groups if g == lang]

        def shares(*own, lang=lang, kept=kept):
            c = {t: sum(count[lang, s, t] for s in own) for t in kept}
            return {t: 1 + 10**9 * (c[t] + 5) // (sum(c.values()) + 5 * len(kept)) for t in kept}

        p, q = shares(source), shares(*sources)
        pairs = [(sum(abs(p[t] - x) for t, x in shares(s).items()), s) for s in sources if s != source]
        terms = [(p[t] - q[t], t) for t in kept if count[lang, source, t] and p[t] > q[t]]
        for part, found in (("pair", pairs), ("term", terms)):
            found.sort(key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, source, part, item, v, k) for k, (v, item) in enumerate(found, 1) if part == "pair" or k <= first]
    return sorted(out, key=repr)


@pytest.mark.parametrize("least", [1, 20, 10_000])
def test_audit_of_odd_rows(spark, least):
    rows = odd_corpus()
    assert rows_of(divergence.audit(corpus(spark, rows), least, 4)) == brute_audit(rows, least, 4)
    assert divergence.audit(corpus(spark, rows).limit(0)).collect() == []


def test_joint_histograms_hold_every_term_once(spark, monkeypatch):
    rows = odd_corpus(8)
    counts = divergence.term_counts(corpus(spark, rows)).where("term != ''")
    terms = counts.groupBy("lang", "term").agg(F.sort_array(F.collect_list(F.struct("source", "count"))).alias("cells"))
    groups = counts.select("lang", "source").distinct()
    pairs = groups.toDF("lang", "a").join(groups.toDF("lang", "b"), "lang").where("a < b")
    found = {tuple(r)[:5]: r.n for r in divergence.joint_histograms(terms, pairs).collect()}
    have = {(r.lang, r.source, r.term): r["count"] for r in counts.collect()}
    expected = collections.Counter()
    for r in pairs.collect():
        expected.update((r.lang, r.a, r.b, have.get((r.lang, r.a, t), 0), have.get((r.lang, r.b, t), 0)) for g, t in {(k[0], k[2]) for k in have} if g == r.lang)
    assert found == dict(expected) and any(k[3:] == (0, 0) for k in found)


def brute_links(rows, cosine):
    ok = {k: np.array(e, float) for k, (_, label, e) in enumerate(rows) if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e)}
    links, root = collections.Counter(), list(range(len(rows)))

    def top(k):
        while root[k] != k:
            k = root[k]
        return k

    for i, j in itertools.combinations(ok, 2):
        x, y = ok[i], ok[j]
        if rows[i][1] == rows[j][1] and len(x) == len(y):
            x, y = x / np.abs(x).max(), y / np.abs(y).max()
            if x @ y / math.sqrt(x @ x) / math.sqrt(y @ y) >= cosine:
                links[i] += 1
                links[j] += 1
                root[max(top(i), top(j))] = min(top(i), top(j))
    least = {}
    for k, row in enumerate(rows):
        if row[0] is not None:
            least[top(k)] = min(row[0], least.get(top(k), row[0]))
    return sorted([(row[0], links[k], least.get(top(k)), row[0] is not None and row[0] == least[top(k)]) for k, row in enumerate(rows)], key=repr)


def odd_vectors(seed=1, dim=8):
    r = np.random.default_rng(seed)
    base = r.normal(size=(12, dim))
    rows = [(k, int(r.integers(2)), (base[r.integers(12)] + r.normal(size=dim) * 0.08).tolist()) for k in range(150)]
    rows += [(200, 0, [0.0] * dim), (201, 0, None), (202, None, base[0].tolist()), (203, 1, [float("nan")] + [1.0] * (dim - 1)), (204, 1, [float("inf")] * dim), (205, 0, [])]
    rows += [(206, 0, [None] + [1.0] * (dim - 1)), (207, 0, [1.0, 0.0]), (208, 0, [1.0, 0.001]), (209, 1, [1.0, 0.0]), (None, 0, base[1].tolist()), (None, 1, [9.0] * 3), (210, 0, [1e-300] * dim), (211, 0, [1e300] * dim)]
    return [*rows, *rows[:4], (3, 1, base[2].tolist())]


@pytest.mark.parametrize("block, chunk", [(4_096, 512), (5, 2)])
def test_vectors_of_odd_rows(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(vector_join, "BLOCK", block)
    rows = odd_vectors()
    df = spark.createDataFrame([(*x, 7, "b") for x in rows], "vec_id long, label int, embedding array<double>, cid long, block string")
    found = vector_join.near_vectors(df, 0.98, 1.0).collect()
    assert sorted(map(tuple, found), key=repr) == brute_links(rows, 0.98)


def test_blocks_in_one_process():
    """A block against further rows in small chunks: links and components as by all pairs."""
    r = np.random.default_rng(2)
    raw = np.repeat(r.normal(size=(5, 6)), 12, axis=0) + r.normal(size=(60, 6)) * 0.05
    cid, copies = np.arange(60) * 3 + 1, r.integers(1, 4, 60)
    vector_join.CHUNK, old = 7, vector_join.CHUNK
    try:
        cell = vector_join._Cell(6, 0.98)
        order = r.permutation(60)
        cell.add(cid[order[:20]], copies[order[:20]], raw[order[:20]])
        cell.add(cid[order[20:35]], copies[order[20:35]], raw[order[20:35]])
        out = [*cell.close(), *cell.against(cid[order[35:]], copies[order[35:]], raw[order[35:]]), *cell.finish()]
    finally:
        vector_join.CHUNK = old
    got = [x for b in out for x in zip(*(c.to_pylist() for c in b.columns))]
    near = vector_join.units(raw) @ vector_join.units(raw).T >= 0.98
    np.fill_diagonal(near, False)
    late = order[35:]
    near[np.ix_(late, late)] = False
    links = collections.Counter()
    for u, v, n in got:
        if v is None:
            links[u] += n
    assert dict(links) == {int(c): int(n) for c, n in zip(cid, near @ copies) if n}

    def parts(edges):
        root = {int(c): int(c) for c in cid}
        for _ in range(60):
            for u, v in edges:
                root[u] = root[v] = min(root[u], root[v])
        return root

    assert parts([(u, v) for u, v, _ in got if v is not None]) == parts([(int(cid[i]), int(cid[j])) for i, j in zip(*np.nonzero(near))])


def test_visits_go_from_near_to_far_and_stop_at_the_reach():
    r = np.random.default_rng(4)
    x = vector_join.units(r.normal(size=(400, 16)))
    index = vector_join.Index(x, 8, 0.98, 0.99)
    (a, u), (b, v) = index._borders(x)
    own = a * 8 + b
    seen = collections.defaultdict(list)
    for row, cell in index.visits(x):
        for k, c in zip(row.tolist(), cell.tolist()):
            seen[k].append(c)
    for k in range(400):
        cost = u[k][:, None] + v[k][None, :]
        assert sorted(seen[k]) == sorted({int(own[k])} | {int(c) for c in np.flatnonzero(cost.ravel() <= index.reach) if c > own[k]})
    turned = r.normal(size=x.shape)
    turned -= (turned * x).sum(1, keepdims=True) * x
    y = 0.98 * x + math.sqrt(1 - 0.98**2) * vector_join.units(turned)
    c, d = index.cells(y)
    rows = np.arange(400)
    assert ((u[rows, c] + v[rows, d]) <= index.reach).mean() >= 0.95


def test_recall_on_planted_vectors(spark):
    """Vectors turned in random directions to cosines just above the threshold; no link is made up."""
    r = np.random.default_rng(9)
    base = vector_join.units(r.normal(size=(3_000, 64)))
    turn = r.normal(size=(3_000, 64))
    turn = vector_join.units(turn - (turn * base).sum(1, keepdims=True) * base)
    cosine = r.uniform(0.9801, 0.99, (3_000, 1))
    both = np.concatenate([base, cosine * base + np.sqrt(1 - cosine**2) * turn])
    label = np.tile(r.integers(2, size=3_000), 2)
    rows = [(k, int(x), e.tolist()) for k, (x, e) in enumerate(zip(label, both))]
    found = vector_join.near_vectors(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(4)).collect()
    near = (both @ both.T >= 0.98) & (label[:, None] == label)
    np.fill_diagonal(near, False)
    links = {r.vec_id: r.n_links for r in found}
    assert all(links[k] <= n for k, n in enumerate(near.sum(1)))
    assert sum(links.values()) >= 0.995 * near.sum() and near.sum() >= 6_000


def test_vectors_of_no_rows(spark):
    schema = "vec_id long, label int, embedding array<float>"
    assert vector_join.near_vectors(spark.createDataFrame([], schema)).collect() == []
    assert [tuple(r) for r in vector_join.near_vectors(spark.createDataFrame([(1, None, [1.0]), (2, 0, [0.0])], schema)).orderBy("vec_id").collect()] == [(1, 0, 1, True), (2, 0, 2, True)]
