"""The registered queries of the corpus operators: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read_table

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontaminate import find

    return find(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op2_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .html_extract import extract

    return extract(read_table(spark, sf_dir, "pages"))


def op3_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_store import round_trip

    return round_trip(spark, read_table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify, train

    docs = read_table(spark, sf_dir, "documents")
    return identify(docs, train(docs))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .substring_dedup import dedup

    got = dedup(read_table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .secrets import scan

    return scan(read_table(spark, sf_dir, "documents")).drop("n_lexed")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bpe import digests

    return digests(read_table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op8_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .lm_score import score

    return score(read_table(spark, sf_dir, "documents"))


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import rules

    return rules(read_table(spark, sf_dir, "documents")).drop("covered_words", "longest_repeat")


def op10_simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .simhash import near_duplicates

    return near_duplicates(read_table(spark, sf_dir, "documents"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .clusters import clusters

    return clusters(read_table(spark, sf_dir, "embeddings"))


def op12_resample(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .resample import resample

    return resample(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op13_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .jaccard_join import join

    return join(read_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontaminate, op2_html_extract, op3_token_store, op4_language_id, op5_substring_dedup, op6_secret_scan, op7_bpe, op8_lm_score, op9_quality_rules, op10_simhash_groups,
        op11_centroid_clusters, op12_resample, op13_jaccard_join,
    )
}

WORDS_SQL = r"""w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    words AS (SELECT doc_id, unnest(ws) AS x, generate_subscripts(ws, 1) AS p, len(ws) AS n FROM w)"""

OP5_SQL = f"""WITH {WORDS_SQL},
    windows AS (SELECT doc_id, p, g FROM (SELECT doc_id, p, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 12 FOLLOWING) AS g FROM words) WHERE p + 12 <= n),
    firsts AS (SELECT g, min(doc_id) AS least FROM windows GROUP BY g),
    gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM windows JOIN firsts USING (g) WHERE least < doc_id),
    kept AS (SELECT words.doc_id, count(gone.p) AS n_removed, string_agg(x, ' ' ORDER BY words.p) FILTER (WHERE gone.p IS NULL) AS t FROM words LEFT JOIN gone ON gone.doc_id = words.doc_id AND gone.p = words.p GROUP BY 1)
    SELECT w.doc_id, len(ws) AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM w LEFT JOIN kept ON kept.doc_id = w.doc_id"""


def _repeated(size: int) -> str:
    """Places where a window of ``size`` words begins that its document has twice."""
    return f"""r{size} AS (SELECT doc_id, p FROM (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS c FROM (SELECT doc_id, p, n, string_agg(x, ' ') OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND {size - 1} FOLLOWING) AS g FROM words) WHERE p + {size - 1} <= n) WHERE c > 1),
    c{size} AS (SELECT doc_id, count(DISTINCT q) AS covered FROM (SELECT doc_id, unnest(range(p, p + {size})) AS q FROM r{size}) GROUP BY 1)"""


#: A repeat of 20 words or more covers what windows of 20 cover; one longer than 100 has a window of 101.
OP9_SQL = f"""WITH {WORDS_SQL}, {_repeated(8)}, {_repeated(20)}, {_repeated(101)},
    chars AS (SELECT doc_id, sum(length(x)) AS word_chars FROM words GROUP BY 1),
    lines AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM documents) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY 1),
    base AS (SELECT w.doc_id, len(ws) AS n_words, CAST(coalesce(word_chars, 0) AS BIGINT) AS word_chars, length(coalesce(text, '')) - length(regexp_replace(coalesce(text, ''), '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines, coalesce(c8.covered, 0) AS n_repeat_words, coalesce(c20.covered, 0) AS covered, coalesce(c101.covered, 0) > 0 AS too_long
        FROM w JOIN documents d ON d.doc_id = w.doc_id LEFT JOIN chars ON chars.doc_id = w.doc_id LEFT JOIN lines ON lines.doc_id = w.doc_id LEFT JOIN c8 ON c8.doc_id = w.doc_id LEFT JOIN c20 ON c20.doc_id = w.doc_id LEFT JOIN c101 ON c101.doc_id = w.doc_id),
    judged AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM base)
    SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND covered <= 0.2 * n_words AND NOT too_long AS kept FROM judged"""



def _op11_sql(rounds: int = 5) -> str:
    """Rounds of assignment and exact means, unrolled; pairs of vectors and centroids are compared in full."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""a{k} AS MATERIALIZED (SELECT r, arg_min(c, (dist, c)) AS c, min(dist) AS dist FROM (SELECT r, c, CAST(sum((v.x - m.x) * (v.x - m.x)) AS BIGINT) AS dist FROM flat v JOIN m{k} m USING (d) GROUP BY r, c) GROUP BY r)""")
        if k < rounds:
            steps.append(f"""m{k + 1} AS MATERIALIZED (SELECT c, d, coalesce(n.x, o.x) AS x FROM m{k} o LEFT JOIN (SELECT c, d, CAST(floor(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS x FROM flat JOIN a{k} USING (r) GROUP BY c, d) n USING (c, d))""")
    return f"""WITH kept AS (SELECT vec_id, embedding, row_number() OVER () AS r FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
    flat AS MATERIALIZED (SELECT r, d, CAST(floor(256 * CAST(embedding[d] AS DOUBLE)) AS BIGINT) AS x FROM kept, range(1, 65) t(d)),
    m0 AS MATERIALIZED (SELECT c, d, x FROM (SELECT r, row_number() OVER (ORDER BY sha256('2:' || vec_id)) - 1 AS c FROM kept WHERE vec_id IS NOT NULL QUALIFY c < 40) JOIN flat USING (r)),
    {", ".join(steps)},
    said AS (SELECT c, sha256(string_agg(x, ',' ORDER BY d)) AS centroid_sha256 FROM m{rounds} GROUP BY c)
    SELECT vec_id, CAST(c AS INTEGER) AS cluster, dist AS distance, CAST(sum(dist) OVER (PARTITION BY c) AS BIGINT) AS cluster_inertia, CAST(sum(dist) OVER () AS BIGINT) AS inertia, centroid_sha256 FROM kept JOIN a{rounds} USING (r) JOIN said USING (c)"""


#: crc32 by its table, which is made by the rule of its polynomial, folded over the bytes of a word.
OP12_SQL = r"""WITH tbl AS (SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: xor(c >> 1, (c & 1) * 3988292384)) AS v FROM range(256) r(i))),
    texts AS (SELECT doc_id, NULL AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM documents),
    target AS (SELECT unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM benchmark),
    words AS (SELECT doc_id, unnest(ws) AS w FROM texts),
    hashed AS MATERIALIZED (SELECT w, CAST(xor(list_reduce(list_prepend(4294967295, list_transform(range(length(hex(encode(w))) // 2), lambda k: CAST('0x' || substr(hex(encode(w)), 2 * k + 1, 2) AS BIGINT))), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) AS BIGINT) % 10000 AS b FROM (SELECT DISTINCT w FROM words UNION SELECT w FROM target), tbl),
    s AS (SELECT b, count(*) AS n FROM words JOIN hashed USING (w) GROUP BY b), t AS (SELECT b, count(*) AS n FROM target JOIN hashed USING (w) GROUP BY b),
    sums AS (SELECT (SELECT coalesce(sum(n), 0) FROM s) AS ss, (SELECT coalesce(sum(n), 0) FROM t) AS tt),
    gain AS (SELECT b, CAST(floor(1000 * ln((CAST(coalesce(t.n, 0) AS DOUBLE) + 1) * (CAST(ss AS DOUBLE) + 10000) / ((CAST(s.n AS DOUBLE) + 1) * (CAST(tt AS DOUBLE) + 10000)))) AS BIGINT) AS g FROM s LEFT JOIN t USING (b), sums),
    weights AS (SELECT doc_id, CAST(sum(g) AS BIGINT) AS weight FROM words JOIN hashed USING (w) JOIN gain USING (b) GROUP BY doc_id),
    scored AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight, coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296))) AS BIGINT) AS score FROM texts LEFT JOIN weights USING (doc_id)),
    ranked AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () AS n FROM scored WHERE n_features >= 20)
    SELECT doc_id, n_features, weight, score, CASE WHEN r <= 10 * n // 100 THEN r END AS rank FROM scored LEFT JOIN ranked USING (doc_id)"""

#: All pairs that share a shingle, and who is reached by links.
OP13_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
    sh AS MATERIALIZED (SELECT DISTINCT doc_id, g FROM (SELECT doc_id, array_to_string(ws[p:p + 4], ' ') AS g FROM (SELECT doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) AS p FROM w WHERE len(ws) > 0))),
    sizes AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
    links AS MATERIALIZED (SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sh x JOIN sh y USING (g) WHERE x.doc_id != y.doc_id GROUP BY 1, 2) JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b WHERE 180 * shared >= 80 * (p.n + q.n)),
    reach AS (SELECT doc_id, doc_id AS seen FROM sizes UNION SELECT reach.doc_id, b FROM reach JOIN links ON a = seen)
    SELECT w.doc_id, coalesce(n, 0) AS n_shingles, coalesce(lowest, w.doc_id) AS component_id FROM w LEFT JOIN sizes USING (doc_id) LEFT JOIN (SELECT doc_id, min(seen) AS lowest FROM reach GROUP BY doc_id) USING (doc_id)"""

#: The others have no SQL form: hashes, kernels, merges or files that it lacks. Tests hold them against brute force.
ORACLE_SQL: dict[str, str] = {"op5_substring_dedup": OP5_SQL, "op9_quality_rules": OP9_SQL, "op11_centroid_clusters": _op11_sql(), "op12_resample": OP12_SQL, "op13_jaccard_join": OP13_SQL}
