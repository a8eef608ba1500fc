"""Document sources: sitemaps, robots.txt, gzip, Markdown indexes, URL lists, provider JSON (inventory rows SC6-SC13, T6)."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable
from urllib.parse import urljoin
from xml.etree import ElementTree

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.classify import json_hash

MAX_INFLATED = 50 << 20


class BadDocument(ValueError):
    pass


def inflated(data: bytes, name: str = "", content_type: str = "", most: int = MAX_INFLATED) -> bytes:
    """The content of a gzip body by name, type or first bytes; other bodies as they are. More than ``most`` bytes fail."""
    magic = data[:2] == b"\x1f\x8b"
    if not (magic or name.lower().partition("?")[0].endswith(".gz") or "gzip" in content_type.lower()):
        return data
    if not magic:
        raise BadDocument("not gzip")
    unpack = zlib.decompressobj(31)
    try:
        out = unpack.decompress(data, most + 1)
    except zlib.error as e:
        raise BadDocument(str(e)) from e
    if len(out) > most:
        raise BadDocument("too large")
    if not unpack.eof:
        raise BadDocument("cut off")
    return out


def sitemap(data: bytes) -> tuple[str, list[dict]]:
    """``urlset`` or ``sitemapindex`` and its entries that have a location, whatever the namespace. Document type
    declarations are refused, so no entity can be defined."""
    if re.search(rb"<!\s*(?:DOCTYPE|ENTITY)", data, re.IGNORECASE):
        raise BadDocument("document type declaration")
    try:
        root = ElementTree.fromstring(data)
    except ElementTree.ParseError as e:
        raise BadDocument(str(e)) from e
    kind = root.tag.rpartition("}")[2].lower()
    item = {"urlset": "url", "sitemapindex": "sitemap"}.get(kind)
    if item is None:
        raise BadDocument(f"unknown root {kind}")
    out = []
    for node in root:
        if isinstance(node.tag, str) and node.tag.rpartition("}")[2].lower() == item:
            values = {c.tag.rpartition("}")[2].lower(): (c.text or "").strip() or None for c in node if isinstance(c.tag, str)}
            if values.get("loc"):
                out.append({k: values.get(k) for k in ("loc", "lastmod", "changefreq", "priority")})
    return kind, out


SITEMAP_SCHEMA = "struct<kind:string,error:string,entries:array<struct<loc:string,lastmod:string,changefreq:string,priority:string>>>"


def sitemap_column(data: Column, name: Column) -> Column:
    """A sitemap body (gzip or not) as kind, entries and error."""

    @F.udf(SITEMAP_SCHEMA, useArrow=True)
    def run(data: bytes | None, name: str | None):
        try:
            kind, entries = sitemap(inflated(bytes(data or b""), name or ""))
            return {"kind": kind, "error": None, "entries": entries}
        except BadDocument as e:
            return {"kind": None, "error": str(e), "entries": []}

    return run(data, name)


def robots_sitemaps(text: Column) -> Column:
    """Values of the sitemap lines of a robots.txt in order, each once, comments stripped."""
    lines = F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(F.substring_index(x, "#", 1)))
    named = F.filter(lines, lambda x: x.rlike(r"(?i)^sitemap\s*:\s*\S"))
    return F.array_distinct(F.transform(named, lambda x: F.trim(F.regexp_replace(x, r"(?i)^sitemap\s*:", ""))))


def url_lines(text: Column) -> Column:
    """Trimmed lines that aren't blank."""
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.trim(x)), lambda x: x != "")


_LINK = re.compile(r"\[([^\]]*)\]\(\s*<?([^)\s>]+)>?[^)]*\)")
_ITEM = re.compile(r"^\s*[-*+]\s+")


def ai_index(data: bytes, base: str) -> dict:
    """Title, quoted summary, introduction, links by section and warnings of a Markdown index."""
    warnings: list[str] = []
    try:
        text = data.decode("utf-8-sig")
    except UnicodeDecodeError:
        text = data.decode("utf-8", "replace")
        warnings.append("invalid_utf8")
    title = section = None
    summary: list[str] = []
    intro: list[str] = []
    links: list[dict] = []
    fenced = False
    for line in text.splitlines():
        if line.lstrip().startswith(("```", "~~~")):
            fenced = not fenced
        if fenced:
            continue
        if m := re.match(r"^(#{1,6})\s+(.*?)\s*#*\s*$", line):
            if len(m[1]) == 1 and title is None:
                title = m[2]
            elif len(m[1]) == 2:
                section = m[2]
            continue
        if line.startswith(">") and section is None:
            summary.append(line.lstrip("> ").strip())
            continue
        found = _LINK.search(line)
        if found and _ITEM.match(line):
            note = line[found.end() :].lstrip(" :-–—").strip() or None
            links.append({"position": len(links), "section": section, "title": found[1].strip() or None, "url": urljoin(base, found[2]), "note": note, "optional": (section or "").lower() == "optional"})
        elif section is None and title is not None and line.strip():
            intro.append(line.strip())
    if title is None:
        warnings.append("missing_title")
    if not links:
        warnings.append("no_references")
    return {"title": title, "summary": " ".join(summary) or None, "intro": "\n".join(intro) or None, "links": links, "warnings": warnings}


INDEX_SCHEMA = "struct<title:string,summary:string,intro:string,links:array<struct<position:int,section:string,title:string,url:string,note:string,optional:boolean>>,warnings:array<string>>"


def ai_index_column(data: Column, base: Column) -> Column:
    """``ai_index`` of a body (binary) at its URL; null without a body."""

    @F.udf(INDEX_SCHEMA, useArrow=True)
    def run(data: bytes | None, base: str | None):
        return None if data is None else ai_index(bytes(data), base or "")

    return run(data, base)


#: Audits of a page report that are metrics, and their units.
PAGESPEED = {"first-contentful-paint": "millisecond", "largest-contentful-paint": "millisecond", "total-blocking-time": "millisecond", "cumulative-layout-shift": "unitless", "speed-index": "millisecond", "interactive": "millisecond"}
FIELD_METRICS = ("largest_contentful_paint", "interaction_to_next_paint", "cumulative_layout_shift", "first_contentful_paint", "experimental_time_to_first_byte")


def pagespeed_metrics(doc: Column) -> Column:
    """Metric name -> value and unit of a lab report's JSON."""
    v = F.try_parse_json(doc)
    pairs = [F.struct(F.lit(k).alias("key"), F.struct(F.try_variant_get(v, f'$.lighthouseResult.audits["{k}"].numericValue', "double").alias("value"), F.lit(u).alias("unit")).alias("value")) for k, u in PAGESPEED.items()]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["value"]["value"].isNotNull()))


def field_metrics(doc: Column) -> Column:
    """Metric name -> 75th percentile of a field record's JSON, for metrics with a histogram."""
    v = F.try_parse_json(doc)
    pairs = [
        F.when(F.try_variant_get(v, f"$.record.metrics.{k}.histogram", "array<variant>").isNotNull(), F.struct(F.lit(k).alias("key"), F.coalesce(F.try_variant_get(v, f"$.record.metrics.{k}.percentiles.p75", "double"), F.try_variant_get(v, f"$.record.metrics.{k}.percentiles.p75", "string").try_cast("double")).alias("value")))
        for k in FIELD_METRICS
    ]
    return F.map_from_entries(F.filter(F.array(*pairs), lambda x: x.isNotNull() & x["value"].isNotNull()))


AXE = "struct<violations:array<struct<id:string,impact:string,nodes:array<struct<target:array<string>,html:string,failureSummary:string>>>>,incomplete:array<struct<id:string,impact:string,nodes:array<struct<target:array<string>,html:string,failureSummary:string>>>>>"


def axe_rules(doc: Column, max_nodes: int = 100) -> Column:
    """Rules of an accessibility report: type, id, impact, nodes found and the first of them by position, with a hash."""
    v = F.from_json(doc, AXE)

    def of(kind: str) -> Column:
        return F.transform(
            F.coalesce(v[kind], F.array()),
            lambda r: F.struct(F.lit(kind).alias("result_type"), r["id"].alias("rule_id"), r["impact"].alias("impact"), F.size(r["nodes"]).alias("node_count"), F.slice(F.transform(r["nodes"], lambda n: F.struct(F.array_join(n["target"], " ").alias("target"), F.substring(n["html"], 1, 2000).alias("html"), F.sha2(F.to_json(n), 256).alias("hash"))), 1, max_nodes).alias("nodes")),
        )

    return F.array_sort(F.concat(of("violations"), of("incomplete")))


#: Characters of a node's markup and of its failure summary that are kept.
MAX_SNIPPET, MAX_FAILURE = 4096, 16_000
NODE_FIELDS = ("position", "impact", "target", "html", "html_original_length", "html_truncated", "failure_summary")
RULE_FIELDS = ("position", "rule_id", "result_type", "impact", "description", "help", "help_url", "tags", "nodes")
_AXE_RULES = "array<struct<id:string,impact:string,description:string,help:string,helpUrl:string,tags:array<string>,nodes:array<struct<impact:string,target:array<string>,html:string,failureSummary:string>>>>"
#: The field for the text of a document that could not be read, or not as these types.
_FAULT = "fault"
AXE_REPORT = f"struct<violations:{_AXE_RULES},incomplete:{_AXE_RULES},passes:array<string>,inapplicable:array<string>,{_FAULT}:string>"
_STRICT = {"columnNameOfCorruptRecord": _FAULT, "allowSingleQuotes": "false", "allowNonNumericNumbers": "false"}


def axe_report(doc: Column, rule_fields: tuple[str, ...] = (*RULE_FIELDS, "sha256"), node_fields: tuple[str, ...] = (*NODE_FIELDS, "sha256"), hashed_nodes: Callable[[Column], Column] | None = None) -> Column:
    """An accessibility report's JSON in a fixed form: state, six counts, and all rules with all their nodes.

    Violations come before incomplete rules, each by id with positions from 1. Markup and failure summaries are cut, and a
    node says so and how long its markup was. Rules and nodes have a hash of their canonical JSON. The state is ``malformed``
    for text that is no JSON object, else ``ready``; null is ``missing``. What has the wrong type counts as absent; of a name
    that an object repeats the last value counts.

    Rules and nodes have the fields asked for, and no others are made, since Spark drops no unread fields of structs in
    arrays; nodes that ``hashed_nodes`` is not true of (before they are cut) have a null hash. A rule's hash covers its
    nodes, so with it they are whole and all have theirs."""
    text = lambda x: F.coalesce(x, F.lit(""))
    listed = lambda x: F.coalesce(x, F.array())
    hashes_rules = "sha256" in rule_fields

    def picked(values: dict[str, Column], names: tuple[str, ...], hashed: tuple[str, ...], asked: Column | None = None) -> Column:
        def value(name: str) -> Column:
            if name != "sha256":
                return values[name]
            got = json_hash({k: values[k] for k in hashed})
            return got if asked is None else F.when(asked, got)

        return F.struct(*[value(n).alias(n) for n in names])

    # Values are made in one pass and hashed in the next: in one expression they would be made again for the hash, and
    # those of nodes once more for each rule's.
    def node(n: Column, i: Column) -> Column:
        html = text(n["html"])
        values = {"position": i + 1, "impact": F.substring(n["impact"], 1, 32), "target": listed(n["target"]), "html": html, "html_original_length": code_points(html), "failure_summary": _cut(text(n["failureSummary"]), MAX_FAILURE)}
        return F.struct(*[v.alias(k) for k, v in values.items()])

    def nodes(found: Column) -> Column:
        def made(x: Column) -> Column:
            n = x["html_original_length"]
            cut = {"html": _cut(x["html"], MAX_SNIPPET, n), "html_truncated": n > MAX_SNIPPET}
            values = {k: cut[k] if k in cut else x[k] for k in NODE_FIELDS}
            if hashes_rules:
                return picked(values, (*NODE_FIELDS, "sha256"), NODE_FIELDS)
            return picked(values, node_fields, NODE_FIELDS, None if hashed_nodes is None else hashed_nodes(x))

        return F.transform(F.transform(listed(found), node), made)

    def rule(r: Column, i: Column, kind: str) -> Column:
        url = F.when(F.startswith(r["helpUrl"], F.lit("https://")), r["helpUrl"])
        values = {
            "position": i + 1, "rule_id": F.substring(text(r["id"]), 1, 128), "result_type": F.lit(kind), "impact": F.substring(r["impact"], 1, 32), "description": text(r["description"]), "help": text(r["help"]),
            "help_url": url, "tags": F.array_sort(listed(r["tags"])), "nodes": nodes(r["nodes"]),
        }
        return picked(values, RULE_FIELDS if hashes_rules else rule_fields, ())

    def rules(found: Column, kind: str) -> Column:
        by_id = F.array_sort(listed(found), lambda a, b: F.when(text(a["id"]) < text(b["id"]), -1).when(text(a["id"]) > text(b["id"]), 1).otherwise(0))
        made = F.transform(by_id, lambda r, i: rule(r, i, kind))
        return F.transform(made, lambda x: picked({k: x[k] for k in RULE_FIELDS}, rule_fields, RULE_FIELDS)) if hashes_rules else made

    def fields(parsed: Column) -> Column:
        # Text that starts an object and was read without a fault is one; any other is parsed again to tell what it is.
        read = F.startswith(doc, F.lit("{")) & parsed.isNotNull() & parsed[_FAULT].isNull()
        is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(doc)).startswith("OBJECT"), F.lit(False))
        state = F.when(doc.isNull(), "missing").when(read, "ready").when(is_object, "ready").otherwise("malformed")
        kinds = {"violation": parsed["violations"], "incomplete": parsed["incomplete"]}
        counts = [x for k, v in kinds.items() for x in (F.size(listed(v)).alias(f"{k}_rule_count"), F.aggregate(listed(v), F.lit(0), lambda n, r: n + F.size(listed(r["nodes"]))).alias(f"{k}_node_count"))]
        counts += [F.size(listed(parsed[k])).alias(f"{n}_rule_count") for k, n in (("passes", "pass"), ("inapplicable", "inapplicable"))]
        return F.struct(state.alias("state"), *counts, F.concat(*[rules(v, k) for k, v in kinds.items()]).alias("rules"))

    # Bound to a name, the text is parsed once, not once for each field and use of it.
    return F.transform(F.array(F.from_json(doc, AXE_REPORT, _STRICT)), fields)[0]


def code_points(text: Column) -> Column:
    """``length``, which goes from character to character. As Latin-1, text of ASCII alone has as many bytes as before, and they are its length."""
    size = F.octet_length(text)
    return F.when(F.octet_length(F.decode(text.cast("binary"), "ISO-8859-1")) == size, size).otherwise(F.length(text))


def _cut(text: Column, most: int, length: Column | None = None) -> Column:
    """The first ``most`` characters; ``substring`` goes through them one by one, so it is asked only where bytes don't tell."""
    cut = F.when(F.octet_length(text) <= most, text)
    if length is not None:
        cut = cut.when(F.octet_length(text) == length, F.substring(text.cast("binary"), 1, most).cast("string"))
    return cut.otherwise(F.substring(text, 1, most))


def expand_sitemaps(bodies: DataFrame, roots: DataFrame, max_depth: int = 5, max_children: int = 500) -> tuple[DataFrame, DataFrame]:
    """Sitemaps reached from ``roots`` (url) over recorded ``bodies`` (url, body), level by level, and their entries.

    The first frame has url, depth, state and truncated: ``urlset`` or ``sitemapindex``, ``invalid`` for a body that can't be
    read, ``not_recorded`` without one, ``depth_limit`` beyond ``max_depth``, and ``cycle`` for a sitemap that an index names
    again although it reaches that index (at the depth that it would have there). Of an index the first ``max_children``
    are followed. The second frame has sitemap_url, depth, loc, lastmod, changefreq and priority. A sitemap that several
    indexes name without a cycle is no error here: it is read once, at its first level. Bodies are parsed once; a level
    is a join, and what is to be read next is written out, so that the plan does not grow with the depth."""
    from ..operators.frontier import closing
    from ..operators.projection import stored

    parsed = bodies.select("url", sitemap_column(F.col("body"), F.col("url")).alias("s"))
    parsed = stored(parsed, "sitemaps")
    frontier = stored(roots.where("url is not null").select("url").distinct(), "sitemap-level")
    maps, entries, links, seen = None, None, None, frontier
    for depth in range(max_depth + 1):
        got = stored(frontier.join(parsed, "url", "left"), "sitemap-level")
        state = F.when(F.col("s").isNull(), "not_recorded").when(F.col("s.error").isNotNull(), "invalid").otherwise(F.col("s.kind"))
        index = got.where(F.col("s.kind") == "sitemapindex")
        named = index.select(F.col("url").alias("parent"), F.explode(F.slice("s.entries", 1, max_children)).alias("e")).select("parent", F.col("e.loc").alias("child"), F.lit(depth).alias("depth")).where("child is not null").distinct()
        level = got.select("url", F.lit(depth).alias("depth"), state.alias("state"), F.coalesce((F.col("s.kind") == "sitemapindex") & (F.size("s.entries") > max_children), F.lit(False)).alias("truncated"))
        rows = got.where(F.col("s.kind") == "urlset").select(F.col("url").alias("sitemap_url"), F.lit(depth).alias("depth"), F.explode("s.entries").alias("e")).select("sitemap_url", "depth", "e.*")
        maps, entries, links = (level, rows, named) if maps is None else (maps.unionByName(level), entries.unionByName(rows), links.unionByName(named))
        frontier = stored(named.select(F.col("child").alias("url")).distinct().join(seen, "url", "left_anti"), "sitemap-level")
        seen = seen.union(frontier)
        if frontier.isEmpty():
            break
    loops = closing(links, maps.select(F.col("url").alias("id"), "depth"), "parent", "child").where("closes_loop")
    note = lambda rows, depth, state: rows.select("url", depth.alias("depth"), F.lit(state).alias("state"), F.lit(False).alias("truncated"))
    maps = maps.unionByName(note(loops.select(F.col("child").alias("url"), "depth").distinct(), F.col("depth") + 1, "cycle"))
    return maps.unionByName(note(frontier, F.lit(max_depth + 1), "depth_limit")), entries
