"""Retention, sharing and identity audits (inventory rows U5, Q1-Q6, SC3-SC5, F22, X8, X9, X13)."""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def unreferenced(candidates: DataFrame, key: str, references: Sequence[DataFrame]) -> DataFrame:
    """Candidates that no reference set has. The sets are put together first: one anti-join instead of a chain."""
    used = None
    for r in references:
        r = r.select(F.col(r.columns[0]).alias(key)).where(F.col(key).isNotNull())
        used = r if used is None else used.union(r)
    return candidates if used is None else candidates.join(used.distinct(), key, "left_anti")


def blob_table(rows: DataFrame, content: str) -> DataFrame:
    """One row a distinct content: its hash, its size in bytes and how many rows share it."""
    return rows.groupBy(F.sha2(F.col(content), 256).alias("sha256")).agg(F.min(F.octet_length(content)).cast("long").alias("size"), F.count("*").alias("rows"))


def new_blobs(rows: DataFrame, content: str, existing: DataFrame) -> DataFrame:
    """Contents to be written: each once, those that are stored already left out."""
    keyed = rows.select(F.sha2(F.col(content), 256).alias("sha256"), F.col(content).alias("content"))
    return keyed.dropDuplicates(["sha256"]).join(existing.select("sha256"), "sha256", "left_anti")


def read_blobs(rows: DataFrame, blobs: DataFrame) -> DataFrame:
    """Rows with their content; null where the blob is missing."""
    return rows.join(blobs.select("sha256", "content"), "sha256", "left")


#: Bytes of unpacked content that a task hands on at a time.
UNPACKED = 2 << 20


def unpacked(data: bytes | None, most: int) -> tuple[bytes | None, str]:
    """Content of gzip data and its state."""
    if data is None:
        return None, "missing"
    out, rest = bytearray(), data
    try:
        while rest or not out:
            member = zlib.decompressobj(31)
            out += member.decompress(rest, most + 1 - len(out))
            if len(out) > most:
                return None, "too_large"
            if not member.eof:
                return None, "corrupt"
            rest = member.unused_data
            if not rest:
                break
    except zlib.error:
        return None, "corrupt"
    return bytes(out), "stored"


def gunzipped(rows: DataFrame, packed: str, most: int = 64 << 20) -> DataFrame:
    """``rows`` with content and blob_state of the gzip data in ``packed``, which goes: stored, missing for null, corrupt, or
    too_large where there are more than ``most`` bytes. Columns of these names are replaced.

    Rows leave the task once they hold ``UNPACKED`` bytes, so that a batch of small files can't fill it."""
    kept = [c for c in rows.columns if c not in (packed, "content", "blob_state")]
    schema = rows.select(*kept).schema.add("content", "binary").add("blob_state", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            begin, out, size = 0, [], 0
            for k, x in enumerate(batch.column(len(kept)), 1):
                out.append(unpacked(x.as_py(), most))
                size += len(out[-1][0] or b"")
                if size >= UNPACKED or k == batch.num_rows:
                    columns = [batch.column(i).slice(begin, k - begin) for i in range(len(kept))]
                    yield pa.RecordBatch.from_arrays([*columns, pa.array([c for c, _ in out], pa.binary()), pa.array([s for _, s in out], pa.string())], names=[*kept, "content", "blob_state"])
                    begin, out, size = k, [], 0

    return rows.select(*kept, F.col(packed).cast("binary")).mapInArrow(run, schema)


def missing_artifacts(blobs: DataFrame, artifacts: DataFrame, keys: Sequence[str] = ("sha256",)) -> DataFrame:
    """Blobs without a current artifact for the key."""
    return blobs.join(artifacts.select(*keys).distinct(), list(keys), "left_anti")


def shared_by(rows: DataFrame, key: str, owner: str) -> DataFrame:
    """Per owner: keys that only it uses, and keys it shares."""
    per_key = rows.select(key, owner).distinct().groupBy(key).agg(F.count("*").alias("owners"), F.min(owner).alias("a"))
    pairs = rows.select(key, owner).distinct().join(per_key.select(key, "owners"), key)
    return pairs.groupBy(owner).agg(F.count_if(F.col("owners") == 1).alias("unique_keys"), F.count_if(F.col("owners") > 1).alias("shared_keys"))


def deletion_impact(snapshots: DataFrame, occurrences: DataFrame, scan_id: int) -> DataFrame:
    """What deleting a scan removes: its rows, and resources that no other scan knows."""
    own = snapshots.where(F.col("scan_id") == scan_id)
    others = snapshots.where(F.col("scan_id") != scan_id).select("resource_id").union(occurrences.where(F.col("scan_id") != scan_id).select("target_resource_id"))
    only = unreferenced(own.select("resource_id").distinct(), "resource_id", [others])
    kinds = {"snapshots": own, "occurrences": occurrences.where(F.col("scan_id") == scan_id), "resources_released": only}
    rows = None
    for name, df in kinds.items():
        n = df.agg(F.count("*").alias(name))
        rows = n if rows is None else rows.unionByName(n, allowMissingColumns=True)
    return rows.agg(*[F.max(name).alias(name) for name in kinds])


def deletion_preview(snapshots: DataFrame, occurrences: DataFrame, comparisons: DataFrame, blobs: DataFrame, scan_id: int, pinned: Sequence[DataFrame] = ()) -> DataFrame:
    """One row: what deleting a scan would remove, blobs that it alone refers to included, with their bytes.

    ``snapshots`` has scan_id, resource_id and sha256, ``blobs`` sha256 and size, ``comparisons`` both scans' ids. Resources
    count that no other scan, no link of one and nothing in ``pinned`` (tables of one column of ids) knows."""
    own, others = snapshots.where(F.col("scan_id") == scan_id), snapshots.where(~F.col("scan_id").eqNullSafe(F.lit(scan_id)))
    own_links, other_links = occurrences.where(F.col("scan_id") == scan_id), occurrences.where(~F.col("scan_id").eqNullSafe(F.lit(scan_id)))
    known = own.select("resource_id").union(own_links.select("target_resource_id")).where("resource_id is not null").distinct()
    released = unreferenced(known, "resource_id", [others.select("resource_id").union(other_links.select("target_resource_id")), *pinned])
    used = own.select("sha256").where("sha256 is not null").distinct().join(blobs, "sha256")
    shared = others.select("sha256").distinct().withColumn("shared", F.lit(True))
    used = used.join(shared, "sha256", "left").withColumn("shared", F.coalesce("shared", F.lit(False)))
    sums = used.agg(F.count_if(~F.col("shared")).alias("blobs_released"), F.coalesce(F.sum(F.when(~F.col("shared"), F.col("size"))), F.lit(0)).alias("bytes_released"), F.count_if("shared").alias("blobs_shared"))
    pairs = comparisons.where((F.col("baseline_scan_id") == scan_id) | (F.col("target_scan_id") == scan_id))
    for name, df in (("snapshots", own), ("occurrences", own_links), ("comparisons", pairs), ("resources_released", released)):
        sums = sums.unionByName(df.agg(F.count("*").alias(name)), allowMissingColumns=True)
    names = ("snapshots", "occurrences", "comparisons", "resources_released", "blobs_released", "bytes_released", "blobs_shared")
    return sums.agg(*[F.max(n).alias(n) for n in names])



def delete_scan(snapshots: DataFrame, occurrences: DataFrame, comparisons: DataFrame, resources: DataFrame, blobs: DataFrame, scan_id: int, pinned: Sequence[DataFrame] = ()) -> dict[str, DataFrame]:
    """What is left of each table without a scan. Blobs go that only it used, and resources that it alone knew and that
    nothing in ``pinned`` (tables of one column of resource ids) refers to. Rows without a scan stay."""

    def rest(df: DataFrame, *columns: str) -> DataFrame:
        for c in columns:
            df = df.where(~F.col(c).eqNullSafe(F.lit(scan_id)))
        return df

    own, own_links = snapshots.where(F.col("scan_id") == scan_id), occurrences.where(F.col("scan_id") == scan_id)
    left = {"snapshots": rest(snapshots, "scan_id"), "occurrences": rest(occurrences, "scan_id"), "comparisons": rest(comparisons, "baseline_scan_id", "target_scan_id")}
    known = own.select(F.col("resource_id").alias("id")).union(own_links.select("target_resource_id")).distinct()
    gone = unreferenced(known, "id", [left["snapshots"].select("resource_id"), left["occurrences"].select("target_resource_id"), *pinned])
    dead = unreferenced(own.select("sha256").distinct(), "sha256", [left["snapshots"].select("sha256")])
    return left | {"resources": resources.join(gone, "id", "left_anti"), "blobs": blobs.join(dead, "sha256", "left_anti")}


def deleted_counts(before: dict[str, DataFrame], left: dict[str, DataFrame]) -> DataFrame:
    """table, rows deleted: the report of a deletion."""
    out = None
    for name in sorted(left):
        n = left[name].select(F.lit(-1).alias("n")).union(before[name].select(F.lit(1).alias("n"))).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("deleted")).select(F.lit(name).alias("table"), "deleted")
        out = n if out is None else out.union(n)
    return out


class BlobStore:
    """Contents of one kind (pages, documents, rendered artifacts, audit payloads) by their hash, under a folder.

    Files are never changed: ``add`` appends what is new, ``sweep`` writes what is still referred to into the folder of
    the next generation."""

    SCHEMA = "sha256 string, content binary, size long"

    def __init__(self, spark: SparkSession, folder: str, kind: str):
        self.spark, self.folder, self.kind = spark, folder.rstrip("/"), kind
        self.path = f"{self.folder}/{kind}"

    def all(self) -> DataFrame:
        try:
            return self.spark.read.schema(self.SCHEMA).parquet(self.path)
        except Exception as e:  # nothing stored yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return self.spark.createDataFrame([], self.SCHEMA)

    def add(self, rows: DataFrame, content: str) -> None:
        fresh = new_blobs(rows.where(F.col(content).isNotNull()).select(F.col(content).cast("binary").alias("content")), "content", self.all())
        fresh.withColumn("size", F.octet_length("content").cast("long")).write.mode("append").option("compression", "zstd").parquet(self.path)

    def read(self, rows: DataFrame) -> DataFrame:
        """Rows (sha256) with ``content`` and ``blob_state``: stored or missing."""
        return read_blobs(rows, self.all()).withColumn("blob_state", F.when(F.col("content").isNull(), "missing").otherwise("stored"))

    def sweep(self, referenced: DataFrame, generation: str) -> BlobStore:
        after = BlobStore(self.spark, f"{self.folder}/{generation}", self.kind)
        self.all().join(referenced.select("sha256"), "sha256", "left_semi").write.option("compression", "zstd").parquet(after.path)
        return after


#: What an identity audit says of a resource.
MERGE, OVER_COLLAPSE, NO_PROVENANCE, RE_KEY, UNCHANGED = "candidate_v2_merge", "current_over_collapse_candidate", "insufficient_provenance", "re_key_only", "unchanged"


def identity_classes(resources: DataFrame, evidence: DataFrame) -> DataFrame:
    """Each resource (id, url, candidate) with its class under a candidate identity, from the recorded spellings
    (``evidence``: resource_id, candidate; a null candidate is a spelling that has no identity).

    Spellings are counted before they are joined; only their number and one of them is needed, never a list."""
    seen = evidence.groupBy(F.col("resource_id").alias("id")).agg(F.countDistinct("candidate").alias("identities"), F.min("candidate").alias("seen"), F.count_if(F.col("candidate").isNull()).alias("errors"))
    shared = resources.where(F.col("candidate").isNotNull()).groupBy("candidate").agg(F.count("*").alias("sharing"))
    out = resources.join(shared, "candidate", "left").join(seen, "id", "left").fillna(0, subset=["sharing", "identities", "errors"])
    none = F.col("identities") == 0
    has_query = F.coalesce(F.length(F.parse_url("url", F.lit("QUERY"))), F.lit(0)) > 0
    label = (
        F.when(F.col("sharing") > 1, MERGE).when(F.col("identities") > 1, OVER_COLLAPSE).when(F.col("candidate").isNull() | none & (F.col("errors") > 0), NO_PROVENANCE)
        .when((F.col("candidate") != F.col("url")) | ~none & (F.col("seen") != F.col("candidate")), RE_KEY).when(none & has_query, NO_PROVENANCE).otherwise(UNCHANGED)
    )
    return out.select("id", "url", "candidate", "identities", "errors", label.alias("identity_class"))


def audit_severity(classes: DataFrame, ambiguous_pages: int = 0) -> DataFrame:
    """One row: the classes' numbers (identity_class) and how grave a change of identity would be."""
    n = {c: F.count_if(F.col("identity_class") == c) for c in (UNCHANGED, RE_KEY, OVER_COLLAPSE, MERGE, NO_PROVENANCE)}
    split = "SPLIT_WITH_AMBIGUOUS_WORKSPACE_STATE" if ambiguous_pages else "SPLIT_MECHANICALLY_RECOVERABLE"
    grave = F.when(n[MERGE] > 0, "CANDIDATE_MERGE_REQUIRES_REVIEW").when(n[OVER_COLLAPSE] > 0, split).when(n[NO_PROVENANCE] > 0, "INSUFFICIENT_PROVENANCE").otherwise("SAFE_TO_REKEY")
    return classes.agg(*[c.alias(name) for name, c in n.items()], grave.alias("severity"))


def _path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^:/?#]+://[^/?#]*([^?#]*)", 1), F.lit(""))


def _query(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1), F.lit(""))


#: Patterns of an encoded dot segment, and of encoded reserved characters in a query.
DOT_SEGMENT, RESERVED_IN_QUERY = r"(?i)/(?:%2e)(?:%2e)?(?:/|$)", r"(?i)%(?:2f|3f|23|26|2c|2a|3b|3a|40|3d)"


def collision_reasons(evidence: DataFrame) -> DataFrame:
    """reason, resources: how the candidate identities (resource_id, candidate) of resources that have several differ.

    A resource may have several reasons. Parts differ if their least and greatest value do, so that all is one partial
    aggregate and no resource's spellings are collected."""
    path, query = _path(F.col("candidate")), _query(F.col("candidate"))
    rows = evidence.where("candidate is not null").select("resource_id", "candidate", path.alias("p"), query.alias("q"))
    rows = rows.withColumn("parts", F.array_join(F.array_sort(F.split("q", "&")), "&"))
    some = lambda c: F.bool_or(c)
    differ = lambda c: F.min(c) != F.max(c)
    p, q = F.col("p"), F.col("q")
    facts = rows.groupBy("resource_id").agg(
        differ("candidate").alias("several"), differ("p").alias("paths"), differ("q").alias("queries"), differ("parts").alias("parts"), differ(p.endswith("/")).alias("ends"), some(F.lower(p).contains("%2f")).alias("slash"), some(p.contains("//")).alias("double"),
        some(p.rlike(DOT_SEGMENT)).alias("dot"), some(p.rlike("(?i)%3f|%23")).alias("reserved"), some(q.contains("+")).alias("plus"), some(F.lower(q).contains("%20")).alias("space"), some(q.rlike(RESERVED_IN_QUERY)).alias("encoded"),
    ).where("several")
    c = F.col
    of_path = {"encoded_slash_path": c("slash"), "repeated_slash_path": c("double"), "trailing_slash_path": c("ends"), "encoded_dot_path": c("dot"), "other_encoded_reserved_path": c("reserved")}
    of_query = {"query_component_order": ~c("parts"), "query_plus_percent_space": c("plus") & c("space"), "query_encoded_reserved": c("encoded")}

    def named(reasons: dict[str, Column], where: str, other: str) -> Column:
        found = F.filter(F.array(*[F.when(hit, F.lit(name)) for name, hit in reasons.items()]), lambda x: x.isNotNull())
        return F.when(~c(where), F.array().cast("array<string>")).when(F.size(found) == 0, F.array(F.lit(other))).otherwise(found)

    reasons = F.concat(named(of_path, "paths", "other_path_difference"), named(of_query, "queries", "other_query_difference"))
    reasons = F.when(F.size(reasons) == 0, F.array(F.lit("unknown"))).otherwise(reasons)
    return facts.select(F.explode(reasons).alias("reason")).groupBy("reason").agg(F.count("*").alias("resources"))


#: Spellings of a URL that may change its identity.
SIGNALS = {
    "encoded_slash": r"(?i)%2f", "encoded_question_mark": r"(?i)%3f", "encoded_fragment_delimiter": r"(?i)%23", "encoded_dot_segment": DOT_SEGMENT, "key_only_query_parameter": r"[?&][^&=]+(?:&|$)", "plus_in_query": r"\?[^#]*\+",
    "percent_space_in_query": r"(?i)\?[^#]*%20", "explicit_default_port": r"(?i)^http://[^/]+:80(?:/|$)|^https://[^/]+:443(?:/|$)", "idna_host": r"(?i)^https?://(?:[^/@]+@)?[^/]*xn--",
}
ENCODED = {"encoded_slash": "%2f", "encoded_question_mark": "%3f", "encoded_fragment_delimiter": "%23"}


def signal_counts(evidence: DataFrame, url: str = "url") -> DataFrame:
    """signal, rows, distinct_spellings: recorded URLs whose spelling may change their identity. Spellings are counted first,
    then all signals are sums of one pass. A parameter is repeated if two of a query have one name, in either case."""
    spelled = evidence.where(F.col(url).isNotNull()).groupBy(F.col(url).alias("u")).agg(F.count("*").alias("n"))
    u = F.col("u")
    given = F.transform(F.filter(F.split(_query(u), "&"), lambda x: x.contains("=")), lambda x: F.lower(F.substring_index(x, "=", 1)))
    flags = {name: u.rlike(pattern) for name, pattern in SIGNALS.items()} | {"repeated_query_parameter": F.size(F.array_distinct(given)) < F.size(given)}
    for name, code in ENCODED.items():
        flags |= {f"{name}_in_path": F.lower(_path(u)).contains(code), f"{name}_in_query": F.lower(_query(u)).contains(code)}
    sums = spelled.agg(*[x for name, hit in flags.items() for x in (F.coalesce(F.sum(F.when(hit, F.col("n"))), F.lit(0)).alias(f"{name}_rows"), F.count_if(hit).alias(f"{name}_urls"))])
    each = [F.struct(F.lit(name).alias("signal"), F.col(f"{name}_rows").alias("rows"), F.col(f"{name}_urls").alias("distinct_spellings")) for name in flags]
    both = F.struct(F.lit("plus_space_ambiguity").alias("signal"), *[(F.col(f"plus_in_query_{k}") + F.col(f"percent_space_in_query_{k}")).alias(n) for k, n in (("rows", "rows"), ("urls", "distinct_spellings"))])
    return sums.select(F.inline(F.array(*each, both)))


def distinction_counts(resources: DataFrame, url: str = "url") -> DataFrame:
    """kind, groups: sets of URLs that differ in the case of the path, in a trailing slash or in the order of the query only."""
    part = lambda name: F.coalesce(F.parse_url(F.col(url), F.lit(name)), F.lit(""))
    p = resources.select(F.concat_ws("\x1f", part("PROTOCOL"), part("AUTHORITY")).alias("site"), part("PATH").alias("path"), part("QUERY").alias("query"))
    slash = F.col("path").endswith("/")
    kinds = {
        "path_case": (p, [F.lower("path"), F.col("query")], F.countDistinct("path")),
        "trailing_slash": (p, [F.regexp_replace("path", "/+$", ""), F.col("query")], F.countDistinct(slash)),
        "query_order": (p.where(F.col("query") != ""), [F.col("path"), F.array_join(F.array_sort(F.split("query", "&")), "&")], F.count("*")),
    }
    out = None
    for kind, (rows, keys, several) in kinds.items():
        n = rows.groupBy("site", *[k.alias(f"k{i}") for i, k in enumerate(keys)]).agg(several.alias("n")).agg(F.count_if(F.col("n") > 1).alias("groups")).select(F.lit(kind).alias("kind"), "groups")
        out = n if out is None else out.union(n)
    return out


def identity_collisions(urls: DataFrame, url: str, candidate: Column) -> DataFrame:
    """Candidate keys that put several recorded URLs together, with how they differ."""
    u = F.col(url)
    out = urls.select(u.alias("url"), candidate.alias("candidate")).distinct()
    n = out.groupBy("candidate").agg(
        F.count("*").alias("urls"),
        F.countDistinct(F.parse_url("url", F.lit("PROTOCOL"))).alias("schemes"),
        F.countDistinct(F.parse_url("url", F.lit("QUERY"))).alias("queries"),
        F.countDistinct(F.parse_url("url", F.lit("REF"))).alias("fragments"),
        F.min("url").alias("first_url"),
    )
    severity = F.when(F.col("schemes") > 1, "high").when(F.col("queries") > 1, "medium").otherwise("low")
    return n.where("urls > 1").withColumn("severity", severity)


def dependents(resources: DataFrame, tables: dict[str, tuple[DataFrame, str]]) -> DataFrame:
    """How many rows of each table refer to the given resources (id)."""
    out = None
    ids = resources.select("id").distinct()
    for name, (df, key) in sorted(tables.items()):
        n = df.join(ids, F.col(key) == F.col("id"), "left_semi").agg(F.count("*").alias("rows")).select(F.lit(name).alias("table"), "rows")
        out = n if out is None else out.union(n)
    return out


def resolve_alias(ids: DataFrame, aliases: DataFrame, resources: DataFrame) -> DataFrame:
    """Resource of each id: itself if it is one, else where its alias leads (one hop), else null."""
    direct = resources.select(F.col("id").alias("direct_id"))
    hop = aliases.select("legacy_id", F.col("resource_id").alias("hop_id"))
    out = ids.join(direct, F.col("id") == F.col("direct_id"), "left").join(hop, F.col("id") == F.col("legacy_id"), "left")
    return out.select("id", F.coalesce("direct_id", "hop_id").alias("resource_id"))


def stable_id(*parts: Column) -> Column:
    """An id that any task gives the same key."""
    return F.xxhash64(*parts)
