"""Operators against brute-force versions on the smallest tables, and pieces of theirs on random input."""

from __future__ import annotations

import hashlib
import io
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from tracewell.llm import bundles, decontaminate, html_extract, langid, lm_score, quality, secrets, simhash, substring_dedup, token_store
from tracewell.llm.queries import QUERIES


@pytest.fixture(scope="module")
def docs(duck):
    return dict(duck.execute("select doc_id, text from documents order by 1").fetchall())


def rows(spark, small, name):
    return {r.doc_id: r for r in QUERIES[name](spark, small).collect()}


def test_all_are_registered():
    names = __spark_entry__.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


# ---- 1 ----


def test_op1_finds_shared_passages(spark, small, duck, docs):
    grams = {}
    for item, text in duck.execute("select item_id, text from benchmark").fetchall():
        w = decontaminate.tokens(text)
        for k in range(len(w) - 12):
            grams.setdefault(tuple(w[k : k + 13]), set()).add(item)
    want = set()
    for d, t in docs.items():
        w = decontaminate.tokens(t)
        want |= {(d, i) for k in range(len(w) - 12) for i in grams.get(tuple(w[k : k + 13]), ())}
    assert {(r.doc_id, r.item_id) for r in QUERIES["op1_decontaminate"](spark, small).collect()} == want


@pytest.mark.parametrize("every", [6, 8, 12])
def test_substitutions_are_tolerated(every):
    item = [f"tok{k}" for k in range(40)]
    b = decontaminate.Benchmark.of([(7, " ".join(item))])
    changed = ["other" if k % every == every - 1 else w for k, w in enumerate(item)]
    text = " ".join(["lead"] * 30 + changed + ["tail"] * 30)
    (hit,) = b.matches([text, "clean text " * 20], decontaminate.WordHash())
    assert hit[0] == 0 and hit[2] >= 40 * (1 - 1 / every) - every
    shuffled = item[:]
    random.Random(1).shuffle(shuffled)
    assert b.matches([" ".join(shuffled)], decontaminate.WordHash()) == []


# ---- 2 ----


def test_op2_articles(spark, small, duck):
    from html import unescape

    got = {r.page_id: r for r in QUERIES["op2_html_extract"](spark, small).collect()}
    for page, url, html in duck.execute("select page_id, url, html from pages").fetchall():
        body = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", html, re.DOTALL)[1]
        want = " ".join(unescape(re.sub(r"</?(?:p|h1|br)>", "\n", body).replace("<b>", "").replace("</b>", "")).split())
        assert (got[page].text, got[page].url, got[page].n_chars) == (want, url, len(want))


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("", ""), ("plain", "plain"), ("<article>a<br>b&nbsp;&amp c<script>var x='</article>'</script><b>d</b>e</article><footer>f</footer>", "a b & cde"),
        ("<main><h1>T</h1><aside>no</aside><form>no</form><div class='cookie-notice'>no</div><p>yes<p>also</main>", "T yes also"), ("<article><header><h1>Head</h1>by me</header><p>x</p><section class=comments><article>c</article></section></article>", "Head x"),
        ("<div class='has-sidebar'><article>t</article></div>", "t"), ("<article>cut <b", "cut"), ("<article>a<!-- <p>no --> b</article", "a b"), ("<article><p hidden>no</p>y</article>", "y"),
    ],
)
def test_main_text(html, want):
    assert html_extract.main_text(html) == want


def test_two_passes_without_a_marked_article():
    long = "This is a long paragraph of the text and it has many of the words that are in the list of stop words, so that it is decided by the first pass of the rules and not by the second one of them, as it should be for this one. "
    html = f"<div><a href=1>Home</a> <a href=2>News</a></div><h2>Title</h2><div>{long}</div><div>Short.</div><div>{long}</div><div><a href=3>Imprint of the site</a></div><div>Copyright</div>"
    assert html_extract.main_text(html) == f"Title {long}Short. {long}".strip()


# ---- 3 ----


@pytest.mark.parametrize("mode", ["bit", "byte"])
@pytest.mark.parametrize("n", [0, 1, 7, 65536, 150_000])
def test_files_round_trip(mode, n):
    f = io.BytesIO()
    f.close = lambda: None
    ids = np.random.default_rng(n).integers(0, 49408, n).astype("<u2")
    w = token_store.PlaneWriter(f, 16, mode)
    w.add(5, ids)
    w.add(None, ids[:3])
    w.close()
    r = token_store.PlaneReader(f.getvalue())
    assert np.array_equal(r.ids(), np.r_[ids, ids[:3]]) and r.documents()[0] == [5, None]
    with pytest.raises(ValueError):
        token_store.PlaneReader(f.getvalue()[:-1])


def test_op3_against_the_library(spark, small, docs):
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    got, start = rows(spark, small, "op3_token_store"), 0
    for d in sorted(docs):
        ids = [*library.encode(docs[d], add_special_tokens=False).ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))
        start += len(ids)


# ---- 4 ----


def test_op4_held_out_accuracy(spark, small, duck):
    lang = dict(duck.execute("select doc_id, lang from documents").fetchall())
    got = rows(spark, small, "op4_language_id")
    held = [d for d in lang if zlib.crc32(str(d).encode()) % 4 == 2]
    assert {d for d, r in got.items() if r.held_out} == set(held)
    assert sum(got[d].lang_pred == lang[d] for d in held) >= 0.9 * len(held)
    assert all(0 <= r.score <= 1 for r in got.values())


def test_kernel_is_the_mean_cosine_of_gram_sets():
    texts = [("abc abd", "x"), ("xyz xyy zz", "y"), ("abz", "x")]
    m = langid.fit(texts, landmarks=4)
    k = m.kernel(["abc abd", "qqq"])

    def sets(t):
        return [{tuple(g) for g in zip(*[t[j:] for j in range(n)], strict=False)} for n in (1, 2, 3)]

    def kernel(a, b):
        return sum(len(x & y) / math.sqrt(max(1, len(x)) * max(1, len(y))) for x, y in zip(sets(a), sets(b), strict=True)) / 3

    assert k[0, 0] == pytest.approx(1, abs=1e-5) and k[0, 1] == pytest.approx(kernel("abc abd", "abz"), abs=1e-5)
    assert m.predict([None, "12", "abc"])[0][:2] == ["und", "und"]


# ---- 5 ----


def test_op5(spark, small, docs):
    first, words = {}, {d: t.encode().split() for d, t in docs.items()}
    for d in sorted(docs):
        for k in range(len(words[d]) - 12):
            first.setdefault(b" ".join(words[d][k : k + 13]), d)
    got = rows(spark, small, "op5_substring_dedup")
    for d, w in words.items():
        gone = set()
        for k in range(len(w) - 12):
            if first[b" ".join(w[k : k + 13])] < d:
                gone |= set(range(k, k + 13))
        kept = b" ".join(x for k, x in enumerate(w) if k not in gone)
        assert (got[d].n_words, got[d].n_removed, got[d].kept_sha256) == (len(w), len(gone), hashlib.sha256(kept).hexdigest())


@pytest.mark.parametrize("n", [1, 2, 7, 400])
def test_packing(n):
    rng = np.random.default_rng(n)
    keys = np.unique(rng.integers(0, 2**63, 500, dtype=np.uint64) * 2)
    small = rng.integers(0, 3, keys.size).astype(np.uint64)
    for size in (0, 1, 5, keys.size):
        a, b = bundles.unpack_sorted(bundles.pack_sorted(keys[:size], small[:size]))
        assert np.array_equal(a, keys[:size]) and np.array_equal(b, small[:size])
    assert [x.size for x in bundles.unpack(bundles.pack(keys[:0], small[:1]))] == [0, 1]
    assert bundles.shard_of(keys, n).tolist() == [(int(k) >> 32) * n >> 32 for k in keys]


def test_op5_matches_are_maximal_repeats(spark):
    rnd = random.Random(5)
    word = lambda: f"w{rnd.randrange(60)}"
    passages = [[word() for _ in range(n)] for n in (12, 13, 20, 70)]
    rows = []
    for d in range(40):
        text = [word() for _ in range(rnd.randrange(30))]
        for _ in range(rnd.randrange(3)):
            text += rnd.choice(passages) + [word() for _ in range(rnd.randrange(10))]
        rows.append((d, " ".join(text)))
    got = {r.doc_id: r for r in substring_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), bundle_bytes=2000).collect()}
    first = {}
    for d, t in rows:
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), d)
    for d, t in rows:
        w, gone, spans = t.split(), set(), []
        for k in range(len(w) - 12):
            if (least := first[tuple(w[k : k + 13])]) < d:
                gone |= set(range(k, k + 13))
                if spans and spans[-1][0] + spans[-1][1] == k + 12:
                    spans[-1][1] += 1
                else:
                    spans.append([k, 13, least])
        assert got[d].kept == " ".join(x for k, x in enumerate(w) if k not in gone) and [list(x) for x in got[d].repeats] == spans


def test_windows_with_equal_keys_are_told_apart():
    w = substring_dedup.Windows([b" ".join(b"%d" % k for k in range(20))])
    key, second = w.hashes(np.arange(2))
    key[1] = key[0]
    blocks = [[key, second, np.array([5, 6], np.uint64), np.zeros(2, np.uint64)], [key[1:], second[1:], np.array([3], np.uint64), np.zeros(1, np.uint64)]]
    (steps, checks, first), other = substring_dedup.first_documents(blocks)
    assert checks.tolist() == [second[1]] and first.tolist() == [3] and steps.tolist() == [key[0]] and other[0].size == 0


# ---- 6 ----


def test_op6_base(spark, small, docs):
    assign = re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD])|(?:[pP][aA][sS][sS][wW][dD])|(?:[sS][eE][cC][rR][eE][tT])|(?:[tT][oO][kK][eE][nN])|(?:[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
    got = rows(spark, small, "op6_secret_scan")
    for d, t in docs.items():
        found = [(m.start(), 0, m.end()) for m in assign.finditer(t) if len(m[2]) >= 6]
        found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20]
        found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in sorted(found))
        r = got[d]
        assert (r.n_assign, r.n_access, r.n_hex, r.base_sha256) == (*(sum(k == j for _, k, _ in found) for j in range(3)), hashlib.sha256(text.encode()).hexdigest())
        assert set(text.split(",")) - {""} <= set(r.spans.split(","))


@pytest.mark.parametrize(
    ("text", "values"),
    [
        ('DB_PASS = "hunter2-Xy9"\nconnect(password=DB_PASS)', ["hunter2-Xy9"]), ('{"api-key": "abC123xyz9"}', ["abC123xyz9"]), ("export AWS_SECRET_ACCESS_KEY=wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz", ["wJalrXUtnFEMI/K7MDENG/bPxRfiCYzz"]),
        ('k = "sk_live_" + "9aZ3kQ"\nclient.secretKey = k', ["sk_live_", "9aZ3kQ"]), ('password_file = "/etc/x1.txt"', []), ("token: ${TOKEN}", []), ('secret = "changeme"', []), ("The password: remember it", []), ("naïve ſecret = abc123defg", []),
    ],
)
def test_lexed_values(text, values):
    assert [text[a:b] for a, _, b in secrets.lexed_spans(text)] == values


def test_redaction_joins_overlaps():
    text = "x token=abcdef0123456789abcdef01 y"
    out = secrets.redact(text, secrets.all_spans(text)[1])
    assert out == "x [SECRET] y" and secrets.all_spans(out)[1] == []


# ---- 7 ----


def test_op7_against_the_library(spark, small, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    got = rows(spark, small, "op7_bpe")
    for d, t in docs.items():
        ids = library.encode(t, add_special_tokens=False).ids
        want = (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest())
        assert (got[d].n_tokens, got[d].ids_sha256, got[d].decoded_sha256) == want


# ---- 8 ----


def lm_brute(texts, trained, order, k):
    """Counts by order, N, V and the log10 probability of a token list, by the definition of the model."""
    counts = [Counter() for _ in range(order)]
    for w in (w for w, t in zip(texts, trained, strict=True) if t):
        for m in range(order):
            counts[m].update(tuple(w[i : i + m + 1]) for i in range(len(w) - m))
    n = sum(c for g, c in counts[0].items() if g != ("start",))
    v = len(counts[0]) - (("start",) in counts[0])

    def p(h, w):
        if not h:
            return (counts[0][(w,)] + 1) / (n + v + 1)
        shorter, seen, weight = p(h[1:], w), counts[len(h) - 1][h], k[min(len(h), len(k)) - 1]
        return (counts[len(h)][(*h, w)] + weight * shorter) / (seen + weight) if seen else shorter

    return counts, n, v, lambda w: sum(math.log10(p(tuple(w[max(0, i - order + 1) : i]), w[i])) for i in range(1, len(w)))


def test_op8(spark, small, docs):
    tokens = {d: ["start", *t.encode().lower().split(), "end"] for d, t in docs.items()}
    trained = {d: zlib.crc32(str(d).encode()) % 7 != 2 for d in tokens}
    counts, n, v, total = lm_brute(tokens.values(), trained.values(), lm_score.ORDER, lm_score.K)
    got = rows(spark, small, "op8_lm_score")
    better = 0.0
    for d, w in tokens.items():
        base = sum(math.log10((counts[0][(x,)] + 1) / (n + v + 1)) for x in w[1:])
        r = got[d]
        assert (r.n_tokens, r.n_known, r.train_tokens, r.held_out) == (len(w) - 1, sum((x,) in counts[0] for x in w[1:]), n, not trained[d])
        assert r.base_score == pytest.approx(base, rel=1e-9) and r.score == pytest.approx(total(w), rel=1e-9)
        better += (r.score - base) * r.held_out
    assert better > 0


@pytest.mark.parametrize("order", [1, 2, 3, 4])
def test_automaton_walks_as_the_model_says(order, monkeypatch):
    """Whole texts and texts in pieces; held-out ones among them."""
    rnd = random.Random(order)
    texts = [" ".join(rnd.choice("abcd") for _ in range(rnd.randrange(40))).encode() for _ in range(12)]
    trained, k = np.array([i % 3 != 0 for i in range(12)]), (5.0, 2.0, 1.0)
    lists = [["start", *t.split(), "end"] for t in texts]
    _, n, v, total = lm_brute(lists, trained, order, k)
    g = lm_score.Grams(texts, order)
    a = lm_score.Automaton(g, g.training_counts(trained), v, n, k)
    for piece in (512, 3, 1):
        monkeypatch.setattr(lm_score, "PIECE", piece)
        assert a.traverse()[1] == pytest.approx([total(w) for w in lists], rel=1e-12)


def test_automaton_is_a_distribution():
    texts, vocabulary = [b"a b a b c", b"b a", b"c"], [b"a", b"b", b"c"]
    # p(w | a b) over the vocabulary, the end and one unknown word
    total = 0.0
    for w in [*vocabulary, None, b"zzz"]:
        asked = [b"a b", b"a b" + (b"" if w is None else b" " + w)]
        g = lm_score.Grams([*texts, *asked], 3)
        a = lm_score.Automaton(g, g.training_counts(np.array([True] * 3 + [False] * 2)), 4, 11, (2.0, 2.0))
        level, state, p = np.array([1]), g.tokens[g.starts[4:]], 0.0
        for k in range(1, 4):
            p = a.step(level, state, g.tokens[g.starts[4:] + k])[0]
        total += 10**p
    assert total == pytest.approx(1.0)


# ---- 9 ----


def test_suffix_array_repeats():
    rng = random.Random(1)
    for _ in range(120):
        texts = [[rng.choice([b"a", b"b", b"c"][: rng.randint(1, 3)]) for _ in range(rng.choice([0, 1, 2, 5, 30]))] for _ in range(rng.randint(1, 4))]
        want = []
        for d in texts:
            for i in range(len(d)):
                best = 0
                for j in range(len(d)):
                    m = 0
                    while i != j and max(i, j) + m < len(d) and d[i + m] == d[j + m]:
                        m += 1
                    best = max(best, m)
                want.append(best)
        assert quality.repeats(texts)[0].tolist() == want


def test_op9(spark, small, docs):
    got = rows(spark, small, "op9_quality_rules")
    for d, t in docs.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        n = Counter(tuple(w[k : k + 8]) for k in range(len(w) - 7))
        again = {j for k in range(len(w) - 7) if n[tuple(w[k : k + 8])] > 1 for j in range(k, k + 8)}
        lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        failed = len(w) < 20 or 100 * len(again) > 30 * len(w)
        r = got[d]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), failed)
        assert not (failed and r.kept)


# ---- 10 ----


def test_bit_sliced_links():
    rng = np.random.default_rng(1)
    for _ in range(25):
        n = int(rng.integers(1, 300))
        base = rng.integers(0, 2**63, size=max(1, n // 6), dtype=np.uint64)
        f = base[rng.integers(0, base.size, n)].copy()
        for i in range(n):
            for _ in range(rng.integers(0, 4)):
                f[i] ^= np.uint64(1) << np.uint64(rng.integers(0, 64))
        g = np.sort(rng.integers(0, 3, n))
        second = rng.integers(0, 2, n).astype(bool)
        for mark in (None, second):
            parent = list(range(n))

            def find(x, parent=parent):
                while parent[x] != x:
                    x = parent[x]
                return x

            for i in range(n):
                for j in range(i + 1, n):
                    if g[i] == g[j] and int(f[i] ^ f[j]).bit_count() <= 2 and (mark is None or mark[i] != mark[j]):
                        parent[max(find(i), find(j))] = min(find(i), find(j))
            assert [find(i) for i in range(n)] == simhash.links(g, f, mark).tolist()


@pytest.mark.parametrize("tile", [8192, 3])
def test_op10(spark, small, docs, tile, monkeypatch):
    monkeypatch.setattr(simhash, "TILE", tile)
    ids = sorted(docs)
    prints = [simhash.fingerprint_of(docs[d].encode().lower().split()) for d in ids]
    parent = list(range(len(ids)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i + 1, len(ids)):
            if (prints[i] ^ prints[j]).bit_count() <= 2:
                parent[max(find(i), find(j))] = min(find(i), find(j))
    got = rows(spark, small, "op10_simhash_groups")
    assert {d: (r.fingerprint, r.component_id) for d, r in got.items()} == {d: (f"{prints[k]:016x}", ids[find(k)]) for k, d in enumerate(ids)}


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(3).shuffle(order)
    edges = spark.createDataFrame([(a, b) for a, b in zip(order, order[1:], strict=False)] + [(500, 501)], "a long, b long")
    assert {(r.node, r.root) for r in simhash.components(edges).collect()} == {(k, 0) for k in range(1, 200)} | {(501, 500)}


# ---- pipeline ----


def test_pipeline_against_its_parts(spark, small, duck):
    out = corpus_pipeline.run(spark, small)
    got = {r.doc_id: r for r in out.collect()}
    table = {r[0]: r for r in duck.execute("select doc_id, text, lang, source from documents order by 1").fetchall()}
    model = langid.train(spark.read.parquet(f"{small}/documents.parquet"))
    known = model.known([t for _, t, *_x in table.values()])
    kept = {d: t for (d, t, *_x), k in zip(table.values(), known, strict=True) if k}
    sets = {}
    for d, t in kept.items():
        w = t.encode().lower().split()
        sets[d] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids, parent = sorted(kept), {d: d for d in kept}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    items = [t for (t,) in duck.execute("select text from benchmark").fetchall()]
    block = decontaminate.Benchmark.of(list(enumerate(items)))
    left = {d: kept[d] for d in ids if find(d) == d and not block.matches([kept[d]], decontaminate.WordHash())}
    assert set(got) == set(left)
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for d, t in left.items():
        text = secrets.redact(t, secrets.all_spans(t)[1])
        assert got[d].token_ids == library.encode(text, add_special_tokens=False).ids and got[d].n_tokens == len(got[d].token_ids) and got[d].n_chars == len(text)
        assert (got[d].lang, got[d].source) == table[d][2:]
