"""Category rules over pages: conditions, matches, reconciliation, previews (inventory rows R1-R9, J10, J15, J23, U6, A21)."""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TARGETS = ("normalized_url", "host", "path", "query", "filename")
OPERATORS = ("equals", "starts_with", "ends_with", "contains", "glob", "regex")
MAX_LENGTH = 8192
#: A repeated group that holds a repetition can take exponential time; Spark has no time limit a row.
NESTED = re.compile(r"\([^()]*[+*}][^()]*\)[+*{]")
#: So can a repeated choice, if its branches match the same text.
CHOICE = re.compile(r"\([^()]*\|[^()]*\)[+*{]")


@dataclass(frozen=True)
class Condition:
    target: str
    operator: str
    value: str
    negate: bool = False
    case_sensitive: bool = False


@dataclass(frozen=True)
class Rule:
    rule_id: int
    category_id: int
    conditions: Sequence[Condition] = field(default_factory=tuple)
    mode: str = "all"
    active: bool = True


def glob_pattern(glob: str) -> str:
    """A glob as an anchored Java pattern: ``*``, ``?`` and ``[...]`` classes, ``[!...]`` negated."""
    out, k = [], 0
    while k < len(glob):
        c = glob[k]
        end = glob.find("]", k + 2) if c == "[" else -1
        if c == "*":
            out.append(".*")
        elif c == "?":
            out.append(".")
        elif end > 0:
            inner = glob[k + 1 : end].replace("\\", "\\\\")
            out.append("[" + ("^" + inner[1:] if inner[0] == "!" else inner) + "]")
            k = end
        else:
            out.append(re.escape(c))
        k += 1
    return r"(?s)\A" + "".join(out) + r"\z"


def target_value(target: str) -> Column:
    if target not in TARGETS:
        raise ValueError(f"unknown target: {target}")
    if target == "filename":
        value = F.substring_index(F.coalesce(F.col("path"), F.lit("")), "/", -1)
    else:
        value = F.coalesce(F.col(target), F.lit(""))
    return F.substring(value, 1, MAX_LENGTH)


def condition_column(c: Condition) -> Column:
    """A condition over page columns as an expression; hosts never mind the case."""
    if c.operator not in OPERATORS:
        raise ValueError(f"unknown operator: {c.operator}")
    exact = c.case_sensitive and c.target != "host"
    value = target_value(c.target)
    text, wanted = (value, c.value) if exact else (F.lower(value), c.value.lower())
    if c.operator == "equals":
        hit = text == wanted
    elif c.operator in ("starts_with", "ends_with", "contains"):
        hit = {"starts_with": F.startswith, "ends_with": F.endswith, "contains": F.contains}[c.operator](text, F.lit(wanted))
    else:
        if c.operator == "regex":
            re.compile(c.value)
            if NESTED.search(c.value):
                raise ValueError("nested repetition in a pattern")
        pattern = c.value if c.operator == "regex" else glob_pattern(c.value)
        hit = value.rlike(pattern if exact else "(?iu)" + pattern)
    return ~hit if c.negate else hit


def rule_column(rule: Rule) -> Column:
    """all: every condition, also none at all; any: at least one."""
    parts = [condition_column(c) for c in rule.conditions]
    if rule.mode == "all":
        return reduce(lambda a, b: a & b, parts, F.lit(True))
    return reduce(lambda a, b: a | b, parts, F.lit(False))


def matches(pages: DataFrame, rules: Sequence[Rule]) -> DataFrame:
    """(site_page_id, rule_id, category_id) of every active rule that a page meets.

    Rules are part of the plan, not a table: one pass over the pages evaluates them all and explodes the hits."""
    active = [r for r in rules if r.active]
    if not active:
        return pages.select("site_page_id", F.lit(0).cast("long").alias("rule_id"), F.lit(0).cast("long").alias("category_id")).where("false")
    hits = F.array(*[F.when(rule_column(r), F.struct(F.lit(r.rule_id).cast("long").alias("rule_id"), F.lit(r.category_id).cast("long").alias("category_id"))) for r in active])
    return pages.select("site_page_id", F.explode(F.filter(hits, lambda x: x.isNotNull())).alias("m")).select("site_page_id", "m.rule_id", "m.category_id")


def needs_limit(c: Condition, jvm) -> bool:
    """Whether a pattern may take exponential time, or uses what Java's patterns lack."""
    if c.operator != "regex":
        return False
    if NESTED.search(c.value) or CHOICE.search(c.value):
        return True
    try:
        jvm.java.util.regex.Pattern.compile(c.value)
        return False
    except Exception:
        return True


def evaluate(pages: DataFrame, rules: Sequence[Rule], limit_seconds: float = 0.02) -> DataFrame:
    """(site_page_id, rule_id, category_id, error) of every active rule that a page meets, whatever its patterns.

    Rules of plain conditions stay one expression in the JVM. Those with a pattern that needs a limit go through an Arrow
    pass in which each match may take ``limit_seconds``; a pattern that takes longer, a wrong one included, is no match, and
    its row says so in ``error`` (null otherwise), so that one page can't stop or distort a run unseen."""
    import regex

    jvm = pages.sparkSession.sparkContext._jvm
    active = [r for r in rules if r.active]
    slow = [r for r in active if any(needs_limit(c, jvm) for c in r.conditions)]
    plain = matches(pages, [r for r in active if r not in slow]).withColumn("error", F.lit(None).cast("string"))
    if not slow:
        return plain
    for c in (c for r in slow for c in r.conditions):
        if c.operator not in OPERATORS or c.target not in TARGETS:
            raise ValueError(f"unknown operator or target: {c.operator}, {c.target}")

    def outcome(c: Condition, text: str, compiled: dict) -> bool:
        exact = c.case_sensitive and c.target != "host"
        if c.operator in ("regex", "glob"):
            if c not in compiled:
                # A glob is translated to a pattern of Java, whose end is called \\z; here that is \\Z.
                pattern = c.value if c.operator == "regex" else glob_pattern(c.value)[:-2] + r"\Z"
                compiled[c] = regex.compile(pattern, 0 if exact else regex.IGNORECASE)
            hit = compiled[c].search(text, timeout=limit_seconds) is not None
        else:
            text, wanted = (text, c.value) if exact else (text.lower(), c.value.lower())
            hit = {"equals": text == wanted, "starts_with": text.startswith(wanted), "ends_with": text.endswith(wanted), "contains": wanted in text}[c.operator]
        return hit != c.negate

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled: dict = {}
        for batch in batches:
            found = []
            for page, *values in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                texts = dict(zip(TARGETS, values, strict=True))
                for r in slow:
                    try:
                        hits = (outcome(c, texts[c.target], compiled) for c in r.conditions)
                        if all(hits) if r.mode == "all" else any(hits):
                            found.append((page, r.rule_id, r.category_id, None))
                    except TimeoutError:
                        found.append((page, r.rule_id, r.category_id, "pattern took too long"))
                    except regex.error as e:
                        found.append((page, r.rule_id, r.category_id, f"invalid pattern: {e}"))
            columns = list(zip(*found, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["site_page_id", "rule_id", "category_id", "error"])

    values = pages.select(F.col("site_page_id").cast("long"), *[target_value(t).alias(t) for t in TARGETS])
    return plain.unionByName(values.mapInArrow(run, "site_page_id long, rule_id long, category_id long, error string"))


def reconcile(desired: DataFrame, existing: DataFrame, exclusions: DataFrame | None = None) -> DataFrame:
    """Supports (site_page_id, category_id, rule_id) with what is to be done: add, remove, keep or suppressed.

    An exclusion (site_page_id, category_id) keeps rules from supporting a category of a page."""
    keys = ["site_page_id", "category_id", "rule_id"]
    d = desired.select(*keys).distinct().withColumn("wanted", F.lit(True))
    e = existing.select(*keys).distinct().withColumn("there", F.lit(True))
    out = d.join(e, keys, "full")
    if exclusions is not None:
        out = out.join(exclusions.select("site_page_id", "category_id").distinct().withColumn("excluded", F.lit(True)), ["site_page_id", "category_id"], "left")
    else:
        out = out.withColumn("excluded", F.lit(None).cast("boolean"))
    barred, wanted, there = (F.coalesce(c, F.lit(False)) for c in ("excluded", "wanted", "there"))
    return out.select(*keys, F.when(there & (~wanted | barred), "remove").when(there, "keep").when(barred, "suppressed").otherwise("add").alias("action"))


def after(actions: DataFrame) -> DataFrame:
    """The supports that stand once ``actions`` are done."""
    return actions.where("action in ('add', 'keep')").drop("action")


def assignments(supports: DataFrame) -> DataFrame:
    """Assignments that any support holds, with their number of supports."""
    return supports.groupBy("site_page_id", "category_id").agg(F.count("*").alias("supports"))


def orphans(assigned: DataFrame, supports: DataFrame) -> DataFrame:
    return assigned.join(supports.select("site_page_id", "category_id").distinct(), ["site_page_id", "category_id"], "left_anti")


def preview(actions: DataFrame, samples: int = 10) -> tuple[DataFrame, DataFrame]:
    """Numbers of pages by action, and the first pages of each."""
    from pyspark.sql import Window

    n = actions.groupBy("action").agg(F.countDistinct("site_page_id").alias("pages"))
    rank = F.row_number().over(Window.partitionBy("action").orderBy("site_page_id", "rule_id"))
    return n, actions.withColumn("rank", rank).where(F.col("rank") <= samples)


def rule_preview(pages: DataFrame, rule: Rule, assigned: DataFrame, supports: DataFrame, exclusions: DataFrame, matching: int = 10, others: int = 5) -> tuple[DataFrame, DataFrame]:
    """What a rule would do to the ``pages`` of a site before it is saved, active or not: one row of numbers, and the first
    pages, by id, that match and that don't (site_page_id, normalized_url, matched).

    ``assigned`` and ``exclusions`` have site_page_id and category_id, ``supports`` site_page_id and rule_id; a rule that is new
    has no supports. An excluded match gains nothing, and a support that it has is lost."""
    own = {"assigned": assigned.where(F.col("category_id") == rule.category_id), "supported": supports.where(F.col("rule_id") == rule.rule_id), "excluded": exclusions.where(F.col("category_id") == rule.category_id)}
    judged = pages.select("site_page_id", "normalized_url", F.coalesce(rule_column(rule), F.lit(False)).alias("matched"))
    rows = judged
    for name, df in own.items():
        rows = rows.join(df.select("site_page_id").distinct().withColumn(name, F.lit(True)), "site_page_id", "left")
    is_ = lambda name: F.coalesce(F.col(name), F.lit(False))
    desired = F.col("matched") & ~is_("excluded")
    numbers = {
        "matching_pages": F.col("matched"), "currently_assigned": is_("assigned"), "would_gain": desired & ~is_("supported"), "would_lose": is_("supported") & ~desired, "excluded_matches": F.col("matched") & is_("excluded"),
    }
    counts = rows.agg(F.count("*").alias("total_pages"), *[F.count_if(c).alias(n) for n, c in numbers.items()])
    first = [judged.where(c).orderBy("site_page_id").limit(n) for c, n in ((F.col("matched"), matching), (~F.col("matched"), others))]
    return counts, first[0].union(first[1])


def deletion_preview(supports: DataFrame, rule_id: int) -> DataFrame:
    """What deleting a rule removes: its supports, and assignments that nothing else holds."""
    held = supports.groupBy("site_page_id", "category_id").agg(F.count_if(F.col("rule_id") == rule_id).alias("own"), F.count_if(F.col("rule_id") != rule_id).alias("others")).where("own > 0")
    return held.agg(F.coalesce(F.sum("own"), F.lit(0)).alias("supports_removed"), F.count_if(F.col("others") == 0).alias("assignments_removed"), F.count_if(F.col("others") > 0).alias("assignments_retained"))


def provenance(supports: DataFrame, manual: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Per page and category: manual, automatic, both or excluded."""
    keys = ["site_page_id", "category_id"]
    out = assignments(supports).join(manual.select(*keys).distinct().withColumn("manual", F.lit(True)), keys, "full").join(exclusions.select(*keys).distinct().withColumn("excluded", F.lit(True)), keys, "full")
    auto = F.coalesce("supports", F.lit(0)) > 0
    label = F.when(F.col("manual") & auto, "manual_and_automatic").when(F.col("manual"), "manual").when(F.col("excluded"), "excluded").otherwise("automatic")
    return out.select(*keys, label.alias("provenance"), F.coalesce("supports", F.lit(0)).cast("long").alias("supports"))


def category_counts(categories: DataFrame, supports: DataFrame) -> DataFrame:
    """Categories with distinct pages in all and by support type (``supports``: page_id, category_id, support_type)."""
    n = supports.groupBy("category_id").agg(F.countDistinct("page_id").alias("pages"), *[F.countDistinct(F.when(F.col("support_type") == t, F.col("page_id"))).alias(f"{t}_pages") for t in ("manual", "automatic")])
    return categories.join(n, "category_id", "left").fillna(0, subset=["pages", "manual_pages", "automatic_pages"])


def category_overview(categories: DataFrame, assigned: DataFrame, supports: DataFrame, exclusions: DataFrame, rule_rows: DataFrame) -> DataFrame:
    """Categories (category_id and others) with five numbers, zero where there is none: assignments, assignments that hand
    work (``manual``) or rules (``automatic``) support, exclusions and rules.

    ``assigned`` has id and category_id, ``supports`` assignment_id and support_type (manual or rule). Each table is
    counted by category before it is joined, so that no category's rows meet each other."""
    kinds = {"manual_count": "manual", "automatic_count": "rule"}
    flags = supports.groupBy(F.col("assignment_id").alias("id")).agg(*[F.bool_or(F.col("support_type") == t).alias(n) for n, t in kinds.items()])
    by_kind = assigned.join(flags, "id").groupBy("category_id").agg(*[F.count_if(n).alias(n) for n in kinds])
    numbers = [n.groupBy("category_id").agg(F.count("*").alias(c)) for n, c in ((assigned, "assignment_count"), (exclusions, "exclusion_count"), (rule_rows, "rule_count"))]
    out = categories
    for n in (numbers[0], by_kind, *numbers[1:]):
        out = out.join(n, "category_id", "left")
    return out.fillna(0, subset=["assignment_count", *kinds, "exclusion_count", "rule_count"])


def bulk_assign(assigned: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """Manual assignments (site_page_id, category_id) with what a bulk edit does: added, kept or removed.

    Doing it again changes nothing; what is both to be added and to be removed is added."""
    keys = ["site_page_id", "category_id"]
    out = assigned.select(*keys).distinct().withColumn("there", F.lit(True))
    for name, df in (("wanted", add), ("unwanted", remove)):
        if df is None:
            out = out.withColumn(name, F.lit(None).cast("boolean"))
        else:
            out = out.join(df.select(*keys).distinct().withColumn(name, F.lit(True)), keys, "full")
    there, wanted, unwanted = (F.coalesce(c, F.lit(False)) for c in ("there", "wanted", "unwanted"))
    action = F.when(there & unwanted & ~wanted, "removed").when(there, "kept").when(wanted, "added")
    return out.select(*keys, action.alias("action")).where("action is not null")


def set_exclusions(exclusions: DataFrame, add: DataFrame | None = None, remove: DataFrame | None = None) -> DataFrame:
    """The exclusions (site_page_id, category_id) that stand after some are set and some removed."""
    return bulk_assign(exclusions, add, remove).where("action != 'removed'").drop("action")


def revisions(history: DataFrame, rule: DataFrame) -> DataFrame:
    """``history`` (rule_id, revision, definition) with a further revision for each of ``rule`` (rule_id, definition)
    whose definition differs from the rule's last one; nothing that stands is changed."""
    last = history.groupBy("rule_id").agg(F.max("revision").alias("revision"), F.max_by("definition", "revision").alias("old"))
    new = rule.select("rule_id", "definition").join(last, "rule_id", "left").where(~F.col("definition").eqNullSafe(F.col("old")) | F.col("revision").isNull())
    return history.select("rule_id", "revision", "definition").unionByName(new.select("rule_id", (F.coalesce("revision", F.lit(0)) + 1).alias("revision"), "definition"))
