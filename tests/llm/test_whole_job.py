"""Cases that the operators once did in part only."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import bpe, common, decontaminate, html_extract, langid, near_dedup, quality, secrets, simhash, token_store

# ---- 4 and the first stage ----

UNLEARNED = {
    "ru": "Все люди рождаются свободными и равными в своем достоинстве и правах. Они наделены разумом и совестью и должны поступать в отношении друг друга в духе братства.",
    "ar": "يولد جميع الناس أحرارًا متساوين في الكرامة والحقوق. وقد وهبوا عقلاً وضميرًا وعليهم أن يعامل بعضهم بعضًا بروح الإخاء.",
    "zh": "人人生而自由，在尊严和权利上一律平等。他们赋有理性和良心，并应以兄弟关系的精神相对待。",
    "pl": "Wszyscy ludzie rodzą się wolni i równi pod względem swej godności i swych praw. Są oni obdarzeni rozumem i sumieniem i powinni postępować wobec innych w duchu braterstwa.",
    "fi": "Kaikki ihmiset syntyvät vapaina ja tasavertaisina arvoltaan ja oikeuksiltaan. Heille on annettu järki ja omatunto, ja heidän on toimittava toisiaan kohtaan veljeyden hengessä.",
    "gibberish": " ".join("".join(random.Random(k).choices("bcdfghjklmnpqrstvwxz", k=3 + k % 6)) for k in range(120)),
}


def test_unlearned_languages_go(spark, small):
    docs = spark.read.parquet(f"{small}/documents.parquet").select("doc_id", "text", "lang")
    model = langid.train(docs)
    assert model.known(list(UNLEARNED.values())) == [False] * len(UNLEARNED)
    assert langid.keep_known(docs.limit(5).withColumn("text", F.lit(UNLEARNED["ru"])), model).count() == 0
    learned = [r.text for r in docs.where("lang is not null").collect()]
    assert sum(model.known(learned)) >= 0.99 * sum(x != "und" for x in model.predict(learned)[0])
    # a short text has few 3-grams, and words with digits are not held against it
    assert model.known([" ".join(learned[0].split()[:3]), None, "12 34"]) == [True, False, False]


# ---- near-dedup stage ----


def components_of(texts, least=0.8):
    """Smallest row of each row's component of 5-word Jaccard links, by brute force."""
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    parent = list(range(len(texts)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] == sets[j] or len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return [find(k) for k in range(len(texts))]


@pytest.mark.parametrize("tile", [2048, 3])
def test_near_copies_go(spark, small, duck, tile, monkeypatch):
    monkeypatch.setattr(near_dedup, "TILE", tile)
    rows = duck.execute("select doc_id, text from documents order by 1").fetchall()
    rnd, base = random.Random(2), [f"w{k}" for k in range(400)]
    edited = [" ".join(w if rnd.random() > share else "x" + w for w in base) for share in (0, 0.005, 0.01, 0.015, 0.02, 0.03, 0.1, 0.2)]
    rows += [(10_000 + k, t) for k, t in enumerate([*edited, "a b", "A  b", "a c", "", None, " "])]
    want = [d for k, ((d, _), root) in enumerate(zip(rows, components_of([t for _, t in rows]), strict=True)) if k == root]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, small).collect()) == want
    assert 177 not in want and 145 not in want  # 11 and 7 bits from their originals


def test_links_of_a_bucket():
    rnd = np.random.default_rng(3)
    for _ in range(20):
        base = rnd.choice(10_000, 60, replace=False)
        sets = [np.unique(np.r_[rnd.permutation(base)[: rnd.integers(45, 61)], rnd.integers(0, 10_000, rnd.integers(0, 6))]).astype(np.uint32) for _ in range(rnd.integers(1, 40))]
        for second in (None, rnd.integers(0, 2, len(sets)).astype(bool)):
            root = list(range(len(sets)))
            for i in range(len(sets)):
                for j in range(i):
                    if (second is None or second[i] != second[j]) and np.intersect1d(sets[i], sets[j]).size >= 0.8 * np.union1d(sets[i], sets[j]).size:
                        a, b = sorted((root[i], root[j]))
                        root = [a if x == b else x for x in root]
            assert near_dedup.links(sets, second).tolist() == root


# ---- 6 ----


def values(text):
    return [text[a:b] for a, _, b in secrets.lexed_spans(text)]


def test_nothing_of_a_secret_is_bounded():
    rnd = random.Random(4)
    key = "".join(rnd.choices("abcdefXYZ0123456789", k=10_000))
    assert values(f'db_private_key{" " * 30}={" " * 30}"{key[:20]}"') == [key[:20]]
    assert values(f'private_key = "{key}"') == [key] and values(f"private_key='{key}'") == [key]
    assert values(f"credential={key}") == [key] and secrets.redact(f"credential={key} x", secrets.all_spans(f"credential={key} x")[1]) == "credential=[SECRET] x"
    assert values("a" * 300 + f'_private_key = "{key[:20]}"') == [key[:20]]
    terms = [key[k : k + 12] for k in range(0, 480, 12)]
    joined = " + ".join(f'"{t}"' for t in terms)
    assert values(f"private_key = {joined}") == terms and values(f"k = {joined}\nprivate_key = k") == terms
    # constants that name each other twice do not grow without end
    assert values(f'c0 = "{key[:20]}"\n' + "".join(f"c{k} = c{k - 1} + c{k - 1}\n" for k in range(1, 3000)) + "private_key = c2999") == [key[:20]]


# ---- 2 ----

LONG = "This is a long paragraph of the text and it has many of the words that are in the list of stop words, so that it is decided by the first pass of the rules and not by the second one of them, as it should be for this one. "


def test_a_marked_article_is_a_prior():
    body = f"<div><h2>Title</h2><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div>"
    teaser = "<article class=card><h3>Other story</h3><p>Read on</p></article><div><a href=1>Imprint of the site</a></div>"
    assert html_extract.main_text(body + teaser).startswith(f"Title {LONG}Short. {LONG}".strip())
    # a continuation outside the mark stays, short text outside and link lists inside go
    page = f"<article><p>{LONG}</p><p>Short.</p><ul><li><a href=1>More</a></ul><p>{LONG}</p></article><div>{LONG}</div><div>Copyright</div>"
    assert html_extract.main_text(page) == f"{LONG}Short. {LONG}{LONG}".strip()
    assert html_extract.main_text("<article><p>a</p><p><a href=1>b</a></p><p>c</p></article>") == "a b c"


# ---- 1 ----


def test_scattered_phrases_are_no_passage():
    item = [f"tok{k}" for k in range(40)]
    b = decontaminate.Benchmark.of([(7, " ".join(item))])
    phrases = [" ".join(item[k : k + 8]) for k in (0, 12, 24)]
    far, close = (" " + " ".join(f"{c}{k}" for k in range(n)) + " " for c, n in (("far", 1000), ("close", 5)))
    assert b.matches([far.join(phrases)], decontaminate.WordHash()) == []
    assert [h[:2] for h in b.matches([close.join(phrases)], decontaminate.WordHash())] == [(0, 0)]


@pytest.mark.parametrize("gap", [(12, 15), (8, 11), (13, 16)])
def test_runs_beyond_substitutions_count(gap):
    item = [f"tok{k}" for k in range(24)]
    b = decontaminate.Benchmark.of([(7, " ".join(item))])
    changed = [f"new{k}" if gap[0] <= k < gap[1] else w for k, w in enumerate(item)]
    (hit,) = b.matches([" ".join([*["lead"] * 9, *changed, *["tail"] * 9])], decontaminate.WordHash())
    assert hit[:4] == (0, 0, 21, 21)


def test_decontamination_against_all_diagonals():
    """Every pair with a segment of 13 equal tokens in 16 is found, by brute force over all diagonals."""
    rnd = random.Random(11)
    items = [[f"v{rnd.randrange(400)}" for _ in range(rnd.randrange(13, 50))] for _ in range(30)]
    texts = []
    for _ in range(60):
        item = rnd.choice(items)
        part = item[(a := rnd.randrange(len(item))) : a + rnd.randrange(8, 50)]
        rate = rnd.choice([0, 0, 0.05, 0.1, 0.3])
        part = [w if rnd.random() > rate else "sub" for w in part]
        texts.append([*(f"v{rnd.randrange(400)}" for _ in range(20)), *part, *(f"v{rnd.randrange(400)}" for _ in range(20))])
    b = decontaminate.Benchmark.of([(k, " ".join(i)) for k, i in enumerate(items)])
    got = {h[:2] for h in b.matches([" ".join(t) for t in texts], decontaminate.WordHash())}
    for d, t in enumerate(texts):
        for i, item in enumerate(items):
            best = 0
            for shift in range(-len(item) + 1, len(t)):
                same = [t[k + shift] == item[k] if 0 <= k + shift < len(t) else False for k in range(len(item))]
                best = max([best, *(sum(same[k : k + 16]) for k in range(len(same)))])
            if best >= 14:
                assert (d, i) in got
            elif best < 8:
                assert (d, i) not in got


def test_short_and_repeated_items():
    b = decontaminate.Benchmark.of([(1, "what is this"), (2, "What is, this?"), (3, " ".join(f"t{k}" for k in range(13)))])
    assert b.ids == [[1, 2], [3]]
    found = b.matches(["what is this", "say what is this", " ".join(f"t{k}" for k in range(11)), None], decontaminate.WordHash())
    assert [(h[0], b.ids[h[1]]) for h in found] == [(0, [1, 2])]


def test_benchmark_in_blocks(spark, monkeypatch):
    items = spark.createDataFrame([(k, " ".join(f"i{k}w{j}" for j in range(20))) for k in range(30)], "item_id long, text string")
    docs = spark.createDataFrame([(k, "lead " * 5 + " ".join(f"i{k}w{j}" for j in range(20))) for k in range(0, 40, 3)], "doc_id long, text string")
    want = [(k, k) for k in range(0, 30, 3)]
    monkeypatch.setattr(decontaminate, "BLOCK_BYTES", 500)
    assert sorted((r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()) == want
    assert sorted(r.doc_id for r in decontaminate.keep_clean(docs, items).collect()) == [30, 33, 36, 39]


# ---- more of 6 ----


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ('secret_key = """abC123xyz9QQ"""', ["abC123xyz9QQ"]), ("x = '''aZ91kQ77zz'''\nclient_secret = x", ["aZ91kQ77zz"]), ("DB_PASSWORD=$(cat <<EOF\nhunter2-Xy9zz\nEOF\n)", ["hunter2-Xy9zz"]),
        ("signing_key: |\n  MIIEpQIBAAKCAQEA7x9Zq\n\n  abcDEF123456\nother: 1", ["MIIEpQIBAAKCAQEA7x9Zq\n\n  abcDEF123456"]), ('# signing_key = "Zq9xT7aa1"', ["Zq9xT7aa1"]), ("<db-password>Zq9xT7aa1</db-password>", ["Zq9xT7aa1"]),
        ("run --client-secret Zq9xT7aa1 now", ["Zq9xT7aa1"]), ('client_secret = ("Zq9x77" +\n  "T7aa1x")', ["Zq9x77", "T7aa1x"]), ('auth["token"] = "Zq9xT7aa1"', ["Zq9xT7aa1"]), ('const SIGNING_KEY: string = "Zq9xT7aa1"', ["Zq9xT7aa1"]),
        ('signing_key = b"Zq9xT7aa1"', ["Zq9xT7aa1"]), ('signing_key = "Zq9\\"xT7aa1"', ['Zq9\\"xT7aa1']), ('signing_key = "never closed', []), ("key: |\nother: 1", []), ("secret = <<EOF\nnever ends", []),
    ],
)
def test_syntax_of_literals(text, want):
    assert values(text) == want


def test_a_long_secret_goes_whole():
    key = "".join(random.Random(8).choices("abcdefXYZ0123456789", k=100_000))
    for text in (f"signing_key = {key}", f'signing_key = "{key}"', f'signing_key = """{key}"""', f"signing_key: |\n  {key}\n"):
        assert values(text) == [key] and key[-20:] not in secrets.redact(text, secrets.all_spans(text)[1])


# ---- more of 2 ----


def test_what_belongs_to_the_article():
    assert html_extract.main_text("<article><p>Let <math><mi>x</mi><annotation>x</annotation></math> be. Click <button>Save</button> now.</p></article>") == "Let x be. Click Save now."
    assert html_extract.main_text("<article><header><h1>Head</h1>by me<p>What it says.</p></header><p>x</p></article>") == "Head What it says. x"


@pytest.mark.parametrize("unit", ["<div>", "<b>", "<div><p>a", "<svg/>", "<li>x", "<p><b>"])
def test_deep_markup_takes_time_in_proportion(unit):
    import time

    began = time.time()
    html_extract.main_text(unit * 100_000)
    assert time.time() - began < 30


# ---- more of 3, 4, 7, 9, 10 ----


def test_every_language_is_learned_from(spark):
    rows = [(k, f"word{chr(97 + k % 26)} " * 5, f"l{k % 1500:04d}") for k in range(6000)]
    got = langid.training_sample(spark.createDataFrame(rows, "doc_id long, text string, lang string"), per_lang=2, rows=1600)
    held = {y for k, _, y in rows} - {y for _, y in got}
    assert len(got) == 1600 and len({y for _, y in got}) >= 1480 and len(held) <= 20
    hot = spark.createDataFrame([(1, f"text {k}", "en") for k in range(500)], "doc_id long, text string, lang string")
    assert len(langid.training_sample(hot, per_lang=3)) in (0, 3)


def test_other_tokenizers_are_encoded_whole_or_refused(tmp_path):
    import json

    import public_tokenizers
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    spec = json.load(open(path, encoding="utf-8"))
    spec["normalizer"]["normalizers"].pop(1)
    other = tmp_path / "other.json"
    other.write_text(json.dumps(spec), encoding="utf-8")
    texts = ["Two  words\n here", "", "naïve café"]
    library = Tokenizer.from_file(str(other))
    assert [list(x) for x in token_store.WordEncoder(str(other)).encode([t.encode() for t in texts])] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert not token_store.WordEncoder(path).whole
    spec = json.load(open(public_tokenizers.path("byte_bpe_50k.json"), encoding="utf-8"))
    spec["pre_tokenizer"]["add_prefix_space"] = True
    other.write_text(json.dumps(spec), encoding="utf-8")
    with pytest.raises(ValueError):
        bpe.ByteBpe(str(other))


def test_columns_of_the_same_names(spark):
    import public_tokenizers

    docs = spark.createDataFrame([(1, "a b", 9, "x", "y")], "doc_id long, text string, n_tokens long, token_ids string, row string")
    out = bpe.token_rows(docs, public_tokenizers.path("byte_bpe_50k.json"))
    (row,) = out.collect()
    assert out.columns == ["doc_id", "row", "token_ids", "n_tokens"] and row.n_tokens == len(row.token_ids) == 2 and row.row == "y"
    clash = docs.selectExpr("doc_id", "text", "row", "1 as fp", "2 as component_id", "3 as root", "4 as h", "5 as bundle")
    assert near_dedup.keep_one(clash).columns == clash.columns and near_dedup.keep_one(clash).count() == 1
    assert simhash.keep_one(clash).columns == clash.columns


def test_texts_beyond_a_kernel_batch():
    words = " ".join(f"w{k % 5003}" for k in range(900_000)).encode()
    assert len(words) > simhash.LONG_BYTES
    assert simhash.fingerprints_of([b"a b c d", words, b""]).tolist() == [simhash.fingerprint_of(w) for w in ([b"a", b"b", b"c", b"d"], words.split(), [])]
    got = quality.judge([words, b"x" * 5_000_000])
    assert got["n_words"].tolist() == [900_000, 1] and got["n_repeat_words"].tolist() == [900_000, 0] and got["longest_repeat"].tolist() == [900_000 - 5003, 0]


def test_where_shared_folders_are(spark):
    assert common.shared_folder(spark, "x") != common.shared_folder(spark, "x")
    with pytest.raises(ValueError):
        common.shared_folder(type("Far", (), {"conf": type("C", (), {"get": lambda self, k, d=None: None})(), "sparkContext": type("S", (), {"master": "yarn", "getConf": lambda self: {}})()})(), "x")


def test_numerals_are_no_letters():
    model = langid.fit([("the cat sat", "en"), ("der Hund lief", "de")], landmarks=2)
    assert model.predict(["², ½ Ⅷ 12", "a²", "²b"])[0][0] == "und" and "und" not in model.predict(["a²", "²b"])[0]


def test_hot_keys_are_spread(spark):
    rows = spark.createDataFrame([(1, k, k if k % 3 else None) for k in range(400)] + [(2, 7, None), (3, 9, 5), (3, 9, 5)], "k int, by int, v int")
    got = [(r.k, r.m) for r in simhash.with_least(rows, "k", "v", "by").collect()]
    assert sorted(got, key=str) == sorted([(1, 1)] * 400 + [(2, None), (3, 5), (3, 5)], key=str)
    table = spark.createDataFrame([(1, "a"), (3, "c"), (4, "d")], "k int, name string")
    assert sorted((r.k, r.name) for r in simhash.spread(table, rows, "k", "by").collect()) == [(1, "a")] * 400 + [(3, "c")] * 2
    assert simhash.spread(table, rows.limit(0), "k", "by").count() == simhash.with_least(rows.limit(0), "k", "v", "by").count() == 0


def test_null_and_repeated_ids_keep_one_of_each(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (None, "x y z w v u"), (1, "one two three"), (1, "other words here now"), (1, "one two three"), (2, "one two three")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.text) for r in simhash.keep_one(docs).collect())
    assert got == [("1", "one two three"), ("1", "other words here now"), ("None", "a b c"), ("None", "x y z w v u")]
