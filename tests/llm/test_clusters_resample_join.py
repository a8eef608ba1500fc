"""Operators 11 to 13 against brute-force versions, on random input and on awkward rows."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from tracewell.llm import clusters, jaccard_join, resample
from tracewell.llm.common import WordHash
from tracewell.llm.queries import ORACLE_SQL, QUERIES


@pytest.mark.parametrize("name", ["op11_centroid_clusters", "op12_resample", "op13_jaccard_join"])
def test_query_against_its_sql(spark, duck, small, name):
    got = QUERIES[name](spark, small)
    want = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in want.description]
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(names) == sorted(got.columns)
    assert sorted((tuple(r) for r in got.select(*names).collect()), key=key) == sorted(want.fetchall(), key=key)


# ---- 11 ----


def brute_clusters(rows, k, rounds, seed):
    """By the definition, with Python's integers."""
    kept = [(i, [math.floor(256 * float(x)) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and math.isfinite(x) for x in v)]
    order = sorted((hashlib.sha256(f"{seed}:{i}".encode()).hexdigest(), v) for i, v in kept if i is not None)
    centroids = [v for _, v in order[:k]]

    def near(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c, strict=True)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(near(v)[1], []).append(v)
        centroids = [[sum(x) // len(held[n]) for x in zip(*held[n], strict=True)] if n in held else c for n, c in enumerate(centroids)]
    out = [(i, *near(v)[::-1]) for i, v in kept]
    each = Counter()
    for _, c, d in out:
        each[c] += d
    said = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    return sorted(((i, c, d, each[c], sum(each.values()), said[c]) for i, c, d in out), key=str)


VECTORS = "vec_id long, embedding array<double>, label string, cluster string"


def test_clusters_against_brute_force(spark):
    r = random.Random(5)
    middle = [[r.gauss(0, 1) for _ in range(64)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.3) for x in r.choice(middle)]) for i in range(150)]
    rows += [(7, rows[7][1]), (500, [0.0] * 64), (501, [0.0] * 64), (None, rows[3][1]), (502, rows[4][1][:63]), (503, None), (504, [None] + rows[5][1][1:]), (505, [float("nan")] + rows[5][1][1:]), (506, [float("inf")] * 64), (507, [])]
    frame = spark.createDataFrame([(i, v, "x", None) for i, v in rows], VECTORS).repartition(3)
    got = sorted((tuple(x) for x in clusters.clusters(frame, k=9, rounds=3, seed=4).collect()), key=str)
    assert got == brute_clusters(rows, 9, 3, 4)


def test_clusters_of_huge_components(spark):
    r = random.Random(6)
    rows = [(i, [r.choice([1.0, -1.0]) * 2.0**k for k in range(64)]) for i in range(8)] + [(9, [r.random() for _ in range(64)])]
    frame = spark.createDataFrame([(i, v, None, None) for i, v in rows], VECTORS)
    want = brute_clusters(rows, 4, 2, 2)
    got = sorted((tuple(x) for x in clusters.clusters(frame, k=4, rounds=2).collect()), key=str)
    fits = lambda x: x if x < 1 << 63 else None
    assert [(i, c, d, s) for i, c, d, _, _, s in got] == [(i, c, fits(d), s) for i, c, d, _, _, s in want]


def test_clusters_of_nothing_and_of_few(spark):
    empty = spark.createDataFrame([], VECTORS)
    assert clusters.clusters(empty).collect() == []
    nameless = spark.createDataFrame([(None, [0.5] * 64, None, None)], VECTORS)
    assert [(r.cluster, r.distance, r.inertia) for r in clusters.clusters(nameless).collect()] == [(None, None, None)]
    two = spark.createDataFrame([(1, [0.5] * 64, None, None), (2, [0.25] * 64, None, None)], VECTORS)
    assert sorted((r.vec_id, r.distance, r.inertia) for r in clusters.clusters(two).collect()) == [(1, 0, 0), (2, 0, 0)]


@pytest.mark.parametrize("kind", [np.int64, object])
def test_partial_distances_are_exact_and_ties_go_down(kind):
    r = np.random.default_rng(1)
    v, c = r.integers(-3, 4, (400, 64)).astype(kind), r.integers(-3, 4, (12, 64)).astype(kind)
    c[7], v[:50] = c[2], c[2]
    best, least = clusters.nearest(v, c)
    far = ((v[:, None, :] - c[None]) ** 2).sum(axis=2)
    assert best.tolist() == [min(range(12), key=lambda k: (row[k], k)) for row in far.tolist()] and least.tolist() == far.min(axis=1).tolist()
    assert set(best[:50].tolist()) == {2}


def test_limbs_give_the_number_back():
    for x in (0, 1, -1, 10**18, -(10**18) - 7, 3**200, -(3**200)):
        assert sum(d * clusters.BASE**p for p, d in clusters.limbs(x)) == x


# ---- 12 ----


def brute_resample(docs, target, n, buckets, seed, percent, least):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    grams = lambda w: [" ".join(w[k : k + s]) for s in range(1, n + 1) for k in range(len(w) - s + 1)]
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    raw = Counter(bucket(f) for _, t in docs for f in grams(words(t)))
    want = Counter(bucket(f) for t in target for f in grams(words(t)))
    s, t = sum(raw.values()), sum(want.values())
    gain = lambda b: math.floor(1000 * math.log((want[b] + 1.0) * (s + buckets) / ((raw[b] + 1.0) * (t + buckets))))
    out = []
    for i, text in docs:
        w = words(text)
        f = grams(w)
        weight = sum(gain(bucket(x)) for x in f)
        score = None
        if i is not None:
            h = int(hashlib.sha256(f"{seed}:{i}".encode()).hexdigest()[:8], 16)
            score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, len(w), len(f), weight, score))
    order = sorted((x for x in out if x[1] >= least and x[0] is not None), key=lambda x: (-x[4], x[0], x[2], x[3]))
    ranks = {k: r for r, k in enumerate(range(percent * len(order) // 100), 1)}
    drawn = [(*x[:1], *x[2:], ranks.get(k)) for k, x in enumerate(order)]
    return sorted(drawn + [(x[0], *x[2:], None) for x in out if x[1] < least or x[0] is None], key=str)


@pytest.mark.parametrize(("n", "percent"), [(1, 10), (2, 35), (3, 100)])
def test_resample_against_brute_force(spark, awkward, n, percent):
    r = random.Random(n)
    vocab = [f"w{k}" for k in range(80)] + ["Ünïq", "été", "日本", "x2y"]
    docs = [(k, " ".join(r.choices(vocab, k=r.randrange(60)))) for k in range(120)] + [(x.doc_id, x.text) for x in awkward.collect()]
    target = [" ".join(r.choices(vocab[:20], k=30)) for _ in range(10)] + [None, ""]
    frame = spark.createDataFrame([(i, t, 1, "a") for i, t in docs], "doc_id long, text string, `rank` long, part string").repartition(5)
    wanted = spark.createDataFrame([(k, t) for k, t in enumerate(target)], "item_id long, text string")
    got = resample.resample(frame, wanted, n=n, buckets=500, seed=9, percent=percent, least_words=12)
    assert sorted((tuple(x) for x in got.collect()), key=str) == brute_resample(docs, target, n, 500, 9, percent, 12)


def test_resample_of_nothing_and_bad_parameters(spark, empty):
    none = empty.select("text")
    assert resample.resample(empty, none).collect() == []
    one = spark.createDataFrame([(1, "a b c"), (None, "a " * 30)], "doc_id long, text string")
    assert sorted((x.doc_id or 0, x["rank"], x.score is None) for x in resample.resample(one, none, percent=100, least_words=1).collect()) == [(0, None, True), (1, 1, False)]
    with pytest.raises(ValueError):
        resample.streams(one, "doc_id", "text", buckets=1 << 17)


def test_runs_are_counts():
    x = np.random.default_rng(3).integers(0, 50, 5000).astype("<u2")
    values, lengths = resample.merged(*map(np.concatenate, zip(*(resample.runs_of(x[a : a + 700]) for a in range(0, 5000, 700)), strict=True)))
    assert dict(zip(values.tolist(), lengths.tolist(), strict=True)) == Counter(x.tolist())


# ---- 13 ----


def brute_join(docs):
    sets = []
    for _, t in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = {}
    for k, (i, _) in enumerate(docs):
        if i is not None:
            least[root(k)] = min(i, least.get(root(k), i))
    return sorted(((i, len(s), least.get(root(k))) for k, ((i, _), s) in enumerate(zip(docs, sets, strict=True))), key=str)


def texts(r, n):
    """Originals, copies with edits around the limit of 0.8, chains, shared passages, short texts."""
    vocab = [f"w{k}" for k in range(3000)]
    passage = " ".join(r.choices(vocab, k=60))
    out = []
    while len(out) < n:
        base = r.choices(vocab, k=r.choice([3, 5, 8, 40, 120, 400]))
        out.append(" ".join(base))
        for _ in range(r.choice([0, 0, 1, 4, 12])):
            copy = list(base)
            for _ in range(r.randrange(1 + len(base) // 40 + 2)):
                copy[r.randrange(len(copy))] = r.choice(vocab)
            if r.random() < 0.4:
                base = copy
            out.append(" ".join(copy) if r.random() < 0.7 else " ".join(copy).upper())
        if r.random() < 0.3:
            out.append(passage + " " + " ".join(r.choices(vocab, k=r.choice([5, 12, 40]))))
    return out[:n]


@pytest.mark.parametrize(("hot", "tile", "seed"), [(128, 2048, 1), (3, 2048, 2), (128, 4, 3), (2, 3, 4), (10**9, 7, 5)])
def test_join_against_brute_force(spark, awkward, monkeypatch, hot, tile, seed):
    """Also with nearly all shingles hot, and with groups cut into small tiles."""
    monkeypatch.setattr(jaccard_join, "LEAST_HOT", hot)
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "SHARD", 2000)
    r = random.Random(seed)
    docs = list(enumerate(texts(r, 300), 100)) + [(x.doc_id, x.text) for x in awkward.collect()]
    frame = spark.createDataFrame([(i, t, 1, "a", "b") for i, t in docs], "doc_id long, text string, node long, g string, fp string").repartition(4)
    got = jaccard_join.join(frame).collect()
    assert sorted((tuple(x) for x in got), key=str) == brute_join(docs)
    assert len({x.component_id for x in got}) < len(docs) - 30


def test_join_of_nothing(spark, empty):
    assert jaccard_join.join(empty).collect() == []


def test_prefixes_of_linked_sets_meet():
    r = random.Random(8)
    words = WordHash()
    for _ in range(200):
        base = [f"a{r.randrange(10**6)}" for _ in range(r.randrange(6, 90))]
        other = list(base)
        for _ in range(r.randrange(4)):
            other[r.randrange(len(other))] = "x"
        pair = [jaccard_join.shingles(" ".join(t).encode(), words) for t in (base, other)]
        hot = np.sort(np.array(r.sample(pair[0].tolist(), pair[0].size // 2), dtype=np.uint64))
        token, owner, _ = jaccard_join.prefixes(pair, hot)
        if jaccard_join.linked_by(jaccard_join.overlap(*pair), *(s.size for s in pair)):
            assert set(token[owner == 0].tolist()) & set(token[owner == 1].tolist())


@pytest.mark.parametrize("each", [1, 4])
def test_traversal_drops_no_pair(each):
    """What a tree's bounds rule out has less than the overlap it needs; pairs in one component are not asked."""
    r = random.Random(9)
    words = WordHash()
    sets = [s for t in texts(r, 150) if (s := jaccard_join.shingles(t.lower().encode(), words)).size]
    n = np.array([s.size for s in sets])
    least, root = np.array([s[0] >> np.uint64(1) for s in sets], dtype=np.int64), np.arange(len(sets))
    bitmaps = [jaccard_join.bitmap_of(s, each) for s in sets]
    run = np.zeros(len(sets), dtype=np.int64)
    crossing, second = run > 0, np.zeros(len(sets), dtype=bool)
    met = {tuple(sorted((int(at[x]), int(at[y])))) for at, trees, i, j in jaccard_join.trees_of(run, crossing, second, n, least, root, bitmaps) for a, b in trees.traverse(i, j) for x, y in zip(a, b, strict=True)}
    want = {(a, b) for b in range(len(sets)) for a in range(b) if jaccard_join.linked_by(jaccard_join.overlap(sets[a], sets[b]), n[a], n[b])}
    assert want and want <= met and len(met) < len(sets) * (len(sets) - 1) / 2
    again = [p for at, trees, i, j in jaccard_join.trees_of(run, crossing, second, n, least, run, bitmaps) for p in trees.traverse(i, j)]
    assert again == []
