"""Breadth-first expansion with order, budgets and cycles (inventory rows T3-T6).

A queue that a crawler works through one item at a time is replayed level by level: the items of a level are numbered in
the order in which they were queued (parent's number, then place in the parent), budgets are running sums in that order,
and what a budget cuts off is not expanded. Each level is one join and is written out, so that plans don't grow with
the depth and lost executors cost no level twice.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordering import numbered
from .projection import stored

#: Steps along the edges between two tables that are written out.
HOPS = 3

# ---- cycles ----


def strong_components(edges: DataFrame) -> DataFrame:
    """(node, component) of the nodes of ``edges`` (a, b) that lie on a cycle: two have the same component if each
    reaches the other. A node that only refers to itself is a component too.

    Nodes without a way in or out are trimmed. Then every node takes the greatest name that reaches it; the nodes that
    have their own name are roots, and whatever reaches a root among the nodes with its name is its component. Components
    leave the graph, and the rest goes on until no edge is left."""
    edges = stored(edges.where("a is not null and b is not null").select("a", "b").distinct(), "edges")
    found = None
    while True:
        n = edges.count()
        while n:
            for _ in range(HOPS):
                ends = edges.select(F.col("b").alias("a")).distinct().join(edges.select("a").distinct(), "a", "left_semi")
                edges = edges.join(ends, "a", "left_semi").join(ends.withColumnRenamed("a", "b"), "b", "left_semi").select("a", "b")
            edges = stored(edges, "edges")
            now = edges.count()
            if now == n:
                break
            n = now
        if not n:
            break
        color = edges.select(F.col("a").alias("node")).distinct().withColumn("color", F.col("node"))
        while True:
            new = color.withColumn("old", F.col("color"))
            for _ in range(HOPS):
                reached = edges.join(new.select(F.col("node").alias("a"), "color"), "a").groupBy(F.col("b").alias("node")).agg(F.max("color").alias("other"))
                new = new.join(reached, "node", "left").select("node", F.greatest("color", "other").alias("color"), "old")
            new = stored(new, "colors")
            color = new.select("node", "color")
            if new.where("color != old").isEmpty():
                break
        same = edges.join(color.withColumnRenamed("node", "a"), "a").join(color.select(F.col("node").alias("b"), F.col("color").alias("other")), "b").where("color = other").select("a", "b")
        same = stored(same, "component")
        part = color.where("node = color")
        n = part.count()
        while True:
            for _ in range(HOPS):
                part = part.unionByName(same.join(part.withColumnRenamed("node", "b"), "b").select(F.col("a").alias("node"), "color")).distinct()
            part = stored(part, "component")
            now = part.count()
            if now == n:
                break
            n = now
        found = part if found is None else found.unionByName(part)
        gone = part.select("node")
        edges = stored(edges.join(gone.withColumnRenamed("node", "a"), "a", "left_anti").join(gone.withColumnRenamed("node", "b"), "b", "left_anti").select("a", "b"), "edges")
    rows = edges.select(F.col("a").alias("node"), F.col("a").alias("color")) if found is None else found
    return rows.withColumnRenamed("color", "component")


def closing(references: DataFrame, nodes: DataFrame, parent: str = "parent_id", child: str = "child_id") -> DataFrame:
    """``references`` with ``closes_loop``: the target reaches the parent again, and stands no deeper than it. Every
    cycle among ``nodes`` (id, depth) has such a reference, whichever way it was first met."""
    at = lambda end, name: nodes.select(F.col("id").alias(end), F.col("depth").alias(name))
    rows = references.join(at(parent, "__p"), parent, "left").join(at(child, "__c"), child, "left")
    inside = rows.where("__p is not null and __c is not null")
    up = F.col("__c") <= F.col("__p")
    if inside.where(up).isEmpty():
        return references.withColumn("closes_loop", F.lit(False))
    parts = stored(strong_components(inside.select(F.col(parent).alias("a"), F.col(child).alias("b"))), "components")
    side = lambda end, name: parts.select(F.col("node").alias(end), F.col("component").alias(name))
    rows = rows.join(side(parent, "__x"), parent, "left").join(side(child, "__y"), child, "left")
    return rows.withColumn("closes_loop", F.coalesce(up & (F.col("__x") == F.col("__y")), F.lit(False))).select(*references.columns, "closes_loop")


# ---- document trees ----


@dataclass
class Tree:
    """What an expansion gave: documents (id, depth, number, bytes, total_bytes, state, path), references (parent_id,
    position, child_id, depth, forms_cycle, followed, closes_loop), and why it stopped, null if nothing was left."""

    documents: DataFrame
    references: DataFrame
    stop_reason: str | None


def document_tree(references: DataFrame, recorded: DataFrame, roots: DataFrame, max_depth: int = 5, max_documents: int = 1000, max_bytes: int = 1 << 30, max_indexes: int = 100) -> Tree:
    """Documents reached from ``roots`` (id, position) over ``references`` (parent_id, position, child_id) of the index
    documents in ``recorded`` (id, bytes, is_index), in the order of a queue.

    * A document is read once, by the reference that was queued first; it counts even if it is not recorded (state
      ``not_recorded``, no bytes). ``path`` is the way to it, itself last.
    * ``forms_cycle``: the reference names its own document or one on the path to it; it is not followed. ``closes_loop``
      also sees cycles over a document that was first met another way (B and C below A, which name each other).
    * References of index documents above ``max_depth`` are followed while fewer than ``max_indexes`` indexes were read,
      the document itself counted.
    * Reading stops with document ``max_documents``, and before the one that brings the bytes over ``max_bytes``."""
    files = recorded.select("id", "bytes", "is_index").dropDuplicates(["id"])
    named = references.where("child_id is not null").select("parent_id", "position", "child_id")
    queue = roots.groupBy("id").agg(F.min("position").alias("second")).select("id", F.lit(0).cast("long").alias("first"), "second", F.array("id").alias("path"))
    read, size, indexes, depth, reason = 0, 0, 0, 0, None
    documents, links = None, None
    while True:
        rows = queue.join(files, "id", "left").withColumn("index", F.coalesce(F.col("is_index"), F.lit(False)).cast("long"))
        rows = numbered(rows, [F.asc("first"), F.asc("second"), F.asc("id")], {"total_bytes": "bytes", "indexes": "index"})
        rows = rows.withColumns({"number": F.col("number") + read, "total_bytes": F.col("total_bytes") + size, "indexes": F.col("indexes") + indexes, "depth": F.lit(depth)})
        within = (F.col("number") <= max_documents) & (F.col("total_bytes") <= max_bytes)
        counted = F.col("number") <= max_documents
        over = rows.agg(F.count_if(counted & (F.col("total_bytes") > max_bytes)).alias("bytes"), F.count_if(~counted).alias("documents")).first()
        state = F.when(F.col("is_index").isNull(), "not_recorded").when(F.col("is_index"), "index").otherwise("document")
        level = stored(rows.where(within).withColumn("state", state), "tree-level")
        shown = level.select("id", "depth", "number", F.coalesce("bytes", F.lit(0)).alias("bytes"), "total_bytes", "state", "path")
        documents = shown if documents is None else documents.unionByName(shown)
        expands = (F.lit(depth) < max_depth) & (F.col("indexes") < max_indexes)
        found = level.where("is_index").select(F.col("id").alias("parent_id"), F.col("number").alias("first"), "path", expands.alias("expands")).join(named, "parent_id")
        cycle = F.array_contains("path", F.col("child_id"))
        found = stored(found.withColumns({"forms_cycle": cycle, "followed": F.col("expands") & ~cycle, "depth": F.lit(depth + 1)}), "tree-references")
        part = found.select("parent_id", "position", "child_id", "depth", "forms_cycle", "followed")
        links = part if links is None else links.unionByName(part)
        last = level.agg(F.max("number"), F.max("total_bytes"), F.max("indexes")).first()
        read, size, indexes = (x if x is not None else y for x, y in zip(last, (read, size, indexes), strict=True))
        if over.bytes or over.documents:
            reason = "max_total_bytes" if over.bytes else "max_total_documents"
            break
        fresh = found.where("followed").groupBy(F.col("child_id").alias("id")).agg(F.min_by(F.struct("first", F.col("position").alias("second"), "path"), F.struct("first", "position")).alias("r"))
        fresh = fresh.join(documents.select("id"), "id", "left_anti")
        queue = stored(fresh.select("id", "r.first", "r.second", F.concat("r.path", F.array("id")).alias("path")), "tree-queue")
        if queue.isEmpty():
            break
        if read >= max_documents:
            reason = "max_total_documents"
            break
        depth += 1
    return Tree(documents, closing(links, documents), reason)


def tree_rows(tree: Tree) -> DataFrame:
    """Documents of a tree with how many references name them and whether one of these forms a cycle."""
    into = tree.references.groupBy(F.col("child_id").alias("id")).agg(F.count("*").alias("parents"), F.max("forms_cycle").alias("in_cycle"), F.max("closes_loop").alias("closes_loop"))
    return tree.documents.join(into, "id", "left").fillna(0, subset=["parents"]).fillna(False, subset=["in_cycle", "closes_loop"])


# ---- crawls ----


def crawl(links: DataFrame, attempts: DataFrame, seeds: DataFrame, max_depth: int, max_pages: int, max_attempts: int = 3) -> tuple[DataFrame, str]:
    """The order in which a crawler with one queue would fetch pages, replayed over what was recorded.

    ``links`` (a, b, position): page a names the page with policy key b; ``attempts`` (id, attempt, outcome): outcome is ok,
    failed or retryable, and ok where nothing is recorded; ``seeds`` (id, position). Gives id, depth, number (of the first
    fetch), attempts, outcome for each page, and why the crawl ended: queue_exhausted, or page_limit_reached if seeds are left.

    A key is queued once, by the first link that names it, if its depth is at most ``max_depth`` and fewer than ``max_pages``
    keys are known (seeds always are, but no more than ``max_pages`` pages are fetched). Only pages fetched well name others.
    A retryable page goes to a second queue, which is served when the first is empty, until ``max_attempts``; all that wait
    there are tried in their order, and the pages that they name come next."""
    named = links.where("b is not null").groupBy("a", "b").agg(F.min("position").alias("position"))
    tries = attempts.groupBy("id", "attempt").agg(F.min("outcome").alias("outcome"))
    seeds = seeds.groupBy("id").agg(F.min("position").alias("second"))
    known = seeds.count()
    reason = "page_limit_reached" if known > max_pages else "queue_exhausted"
    queue = numbered(seeds, [F.asc("second"), F.asc("id")]).where(F.col("number") <= max_pages).select("id", "number", F.lit(0).alias("depth"))
    queue = stored(queue, "crawl-queue")
    seen, waiting, done = seeds.select("id"), None, None
    attempt, fetched = 1, min(known, max_pages)

    def settle(rows: DataFrame, attempt: int) -> DataFrame:
        """The outcome of an attempt of each row."""
        now = tries.where(F.col("attempt") == attempt).select("id", "outcome")
        return rows.join(now, "id", "left").withColumns({"outcome": F.coalesce("outcome", F.lit("ok")), "attempts": F.lit(attempt)})

    while True:
        tried = stored(settle(queue, attempt), "crawl-level")
        again = tried.where((F.col("outcome") == "retryable") & (F.lit(attempt) < max_attempts)).select("id", "number", "depth", (F.lit(attempt) + 1).alias("next"))
        waiting = again if waiting is None else waiting.unionByName(again)
        over = tried.join(again, "id", "left_anti")
        done = over if done is None else done.unionByName(over)
        step = tried.where((F.col("outcome") == "ok") & (F.col("depth") < max_depth)).select(F.col("id").alias("a"), "number", "depth").join(named, "a")
        fresh = step.groupBy(F.col("b").alias("id")).agg(F.min_by(F.struct("number", "position", "depth"), F.struct("number", "position")).alias("r")).join(seen, "id", "left_anti")
        fresh = numbered(fresh.select("id", F.col("r.number").alias("first"), F.col("r.position").alias("second"), (F.col("r.depth") + 1).alias("depth")), [F.asc("first"), F.asc("second"), F.asc("id")])
        found = fresh.count()
        room = max(0, max_pages - known)
        queue = stored(fresh.where(F.col("number") <= room).select("id", (F.col("number") + fetched).alias("number"), "depth"), "crawl-queue")
        known, fetched, attempt = known + min(found, room), fetched + min(found, room), 1
        seen = seen.unionByName(queue.select("id"))
        if found and room:
            continue
        # The queue is empty: the pages that wait are tried again, those with the fewest attempts first.
        waiting = stored(waiting, "crawl-waiting")
        turn = waiting.agg(F.min("next")).first()[0]
        if turn is None:
            return done.select("id", "depth", "number", "attempts", "outcome"), reason
        queue = waiting.where(F.col("next") == turn).select("id", "number", "depth")
        waiting, attempt = waiting.where(F.col("next") > turn), turn
