"""Every operator and stage on awkward rows and on an empty table: no failure, one defined row each."""

from __future__ import annotations

import hashlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tracewell.llm import bpe, decontaminate, html_extract, langid, lm_score, quality, secrets, simhash, substring_dedup, token_store

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
NOTHING = hashlib.sha256(b"").hexdigest()


def bench(spark):
    return spark.createDataFrame([(1, "the cat sat on the mat and the dog sat on the rug by the fire"), (2, None), (None, "too short"), (3, "")], "item_id long, text string")


OPERATORS = {
    "secrets": lambda s, d: secrets.scan(d), "bpe": lambda s, d: bpe.digests(d, BYTE), "encode": lambda s, d: bpe.encode(d, BYTE), "quality": lambda s, d: quality.rules(d), "lm": lambda s, d: lm_score.score(d, bundle_bytes=20_000), "dedup": lambda s, d: substring_dedup.dedup(d, bundle_bytes=20_000),
    "simhash": lambda s, d: simhash.near_duplicates(d), "langid": lambda s, d: langid.identify(d, langid.train(d)), "tokens": lambda s, d: token_store.round_trip(s, d, WORD),
    "html": lambda s, d: html_extract.extract(d.withColumn("url", F.lit(None).cast("string")), "doc_id", "url", "text"),
}


@pytest.mark.parametrize("name", sorted(OPERATORS))
def test_a_row_for_each_row(spark, awkward, empty, name):
    assert OPERATORS[name](spark, empty).collect() == []
    rows = OPERATORS[name](spark, awkward).collect()
    assert len(rows) == awkward.count()


def test_defined_results(spark, awkward):
    by = lambda df: {r.doc_id: r for r in df.collect()}
    q = by(quality.rules(awkward))
    assert (q[2].n_words, q[2].kept, q[5].n_words, q[7].n_words, q[7].word_chars) == (0, False, 0, 5, 23)
    s = by(simhash.near_duplicates(awkward))
    assert s[2].fingerprint == s[5].fingerprint == "0" * 16 and s[2].component_id == s[3].component_id == s[5].component_id == 2
    assert s[8].component_id == 1
    d = by(substring_dedup.dedup(awkward))
    assert (d[1].n_removed, d[8].n_removed, d[8].kept, d[3].kept) == (0, 19, "", "")
    assert [tuple(x) for x in d[8].repeats] == [(0, 19, 1)] and d[1].repeats == []
    t = token_store.round_trip(spark, awkward, WORD).orderBy("start").collect()
    assert [r.doc_id for r in t][:2] == [None, None] and [r.start for r in t] == [sum(x.n_tokens for x in t[:k]) for k in range(len(t))]
    b = by(bpe.digests(awkward, BYTE))
    assert (b[2].n_tokens, b[2].ids_sha256, b[2].decoded_sha256) == (0, NOTHING, NOTHING)
    lid = by(langid.identify(awkward, langid.train(awkward)))
    assert [lid[k].lang_pred for k in (2, 3, 5, 6)] == ["und"] * 4 and lid[2].score == 0.0
    lm = by(lm_score.score(awkward))
    assert (lm[2].n_tokens, lm[3].n_tokens) == (1, 1) and lm[2].score <= 0


def test_decontamination_rows(spark, awkward, empty):
    found = decontaminate.find(awkward, bench(spark)).collect()
    assert sorted(r.doc_id for r in found) == [1, 1, 8] and {r.item_id for r in found} == {1}
    assert decontaminate.find(empty, bench(spark)).count() == 0
    assert decontaminate.find(awkward, bench(spark).where("false")).count() == 0
    assert decontaminate.keep_clean(awkward, bench(spark)).count() == awkward.count() - 3


@pytest.mark.parametrize("k", range(5))
def test_stages(spark, awkward, empty, tmp_path, k):
    bench(spark).write.parquet(f"{tmp_path}/benchmark.parquet")
    name, stage = corpus_pipeline.STAGES[k]
    for docs in (awkward, empty):
        out = stage(spark, docs, str(tmp_path))
        if k < 4:
            assert out.columns == docs.columns and out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}-{docs is empty}")


def test_near_dedup_keeps_one_row_of_each_component(spark, awkward):
    docs = awkward.where("n_chars is null or n_chars != 5 or doc_id is null").unionByName(awkward.where("n_chars = 5")).unionByName(awkward.where("doc_id = 7").withColumn("text", F.lit("other text under the id seven")))
    got = sorted((r.doc_id is not None, r.doc_id or 0, r.text or "") for r in simhash.keep_one(docs).collect())
    ids = [(a, b) for a, b, _ in got]
    assert ids.count((True, 1)) == 1 and (True, 8) not in ids and (True, 3) not in ids and (True, 5) not in ids
    assert ids.count((True, 2)) == 1 and ids.count((True, 7)) == 2 and (False, 0, "no id here but words") in got and ids.count((False, 0)) == 1
    assert simhash.keep_one(docs).columns == docs.columns
