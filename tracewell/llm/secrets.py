"""Secret scan: base patterns plus assignment-aware lexing of name-literal pairs.

Two passes over each whole text. The first finds the three base kinds (``assign``, ``access``, ``hex``) and never
loses one. The second reads source and configuration syntax and lexes pairs of a name and a value: ``name = value``
with the operators ``=``, ``:``, ``:=``, ``=>`` (quoted keys, subscripts, ``export``, ``set``, flags), ``--name value``
and ``<name>value</name>``. A value is a term or several joined by ``+``; a term is a string in single, double, triple or
back quotes (escapes count as what they stand for), a bare word, a here-document or an indented YAML block. Constants
seen before are kept by their whole name, so that a name or concatenation that uses them leads to their literals.
Comments are read like code. Each value is scored by how sensitive the target name is and how random the value looks;
those at or above ``SCORE`` become spans of kind ``lexed`` over the literals themselves.

Defined results: a null or empty text has no spans; order of rows and repeated rows do not matter, each row is scanned
by itself; offsets count code points, ends are exclusive; of spans that start together the kind listed first comes
first; a quote that never closes is no literal; an empty table gives no rows; no length is bounded and time grows with
the length of a text; other columns stay as they are in ``redacted`` and are not read by ``scan``.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import sub_batches

KINDS = ("assign", "access", "hex", "lexed")
#: The base patterns. Only A-Z and a-z are matched in either case.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
MIN_ASSIGN, MIN_ACCESS = 6, 20

#: A value is reported from this score on.
SCORE = 3.0
#: What words of a target name are worth.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "passphrase": 3.0, "pwd": 2.5, "pass": 2.0, "secret": 3.0, "token": 2.5, "apikey": 3.0, "credential": 2.5, "credentials": 2.5,
    "bearer": 2.0, "jwt": 2.0, "auth": 1.5, "authorization": 2.0, "private": 1.5, "access": 1.0, "api": 1.0, "client": 0.5, "key": 1.5, "signing": 1.0, "salt": 1.0, "dsn": 1.5, "cookie": 1.0, "session": 1.0,
}
#: Words of names that hold no secret themselves.
HARMLESS = {"file", "path", "url", "uri", "name", "length", "len", "count", "type", "id", "hint", "policy", "field", "label", "min", "max", "expiry", "ttl", "public"}
PLACEHOLDER = re.compile(r"(?i)^(?:x{3,}|\*{3,}|\.{3,}|<.*>|\$\{?.*\}?|%.*%|\{\{.*\}\}|change_?me|example.*|your[-_ ].*|none|null|nil|true|false|undefined|todo|dummy|test|placeholder)$")
NAME_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")

# No bound on any length; possessive quantifiers keep matching linear.
_NAME = r"[A-Za-z_$][A-Za-z0-9_$.-]*+"
_LONG = r"\"\"\"(?:[^\"\\]++|\\.|\"(?!\"\"))*+\"\"\"|'''(?:[^'\\]++|\\.|'(?!''))*+'''"
_QUOTED = r"\"(?:[^\"\\\n]++|\\.)*+\"|'(?:[^'\\\n]++|\\.)*+'|`[^`]*+`"
_HERE = r"(?:\$\([ \t]*+cat[ \t]++)?<<[-~]?[ \t]*+[\"']?(?P<here>[A-Za-z_]\w*+)[\"']?[^\n]*+\n"
_BLOCK = r"[|>][-+0-9]{0,2}[ \t]*+\n"
_TERM = rf"(?:(?:[rRbBuUfF]{{1,2}}(?=[\"']))?+(?:{_LONG}|{_QUOTED})|[A-Za-z0-9_$+/.~-][A-Za-z0-9_$+/.=~-]*+)"
_TERMS = rf"{_TERM}(?:[ \t]*+\+\s*+{_TERM})*+"
_TYPE = r"(?::[ \t]*+[A-Za-z_][\w.]*+(?=[ \t]*+=))?+"
PAIR = re.compile(
    rf"(?<![A-Za-z0-9_$.-])(?P<name>{_NAME})(?P<close>[\"'\]]{{0,2}}){_TYPE}[ \t]*+(?P<op>:=|=>|=(?!=)|:(?!:))[ \t]*+(?:{_HERE}|{_BLOCK}|(?:\(\s*+)?(?P<value>{_TERMS}))"
    rf"|(?<![A-Za-z0-9_-])--?(?P<flag>[A-Za-z][A-Za-z0-9_-]*+)[ \t]++(?P<argument>{_TERM})"
    rf"|<(?P<element>[A-Za-z][\w.-]*+)>(?P<content>[^<>]++)</(?P=element)>",
    re.DOTALL,
)
TERM = re.compile(_TERM, re.DOTALL)
OPENING = re.compile(r"""[rRbBuUfF]{0,2}(\"\"\"|'''|"|'|`)""")
ESCAPE = re.compile(r"\\(?:u([0-9A-Fa-f]{4})|x([0-9A-Fa-f]{2})|(.))", re.DOTALL)
ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "0": "\0"}

SpanT = tuple[int, int, int]


def base_spans(text: str) -> list[SpanT]:
    """(start, kind index, end) of the base kinds; leftmost, non-overlapping within a kind."""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= MIN_ASSIGN] if ":" in text or "=" in text else []
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def name_score(name: str) -> float:
    parts = [p.lower() for p in NAME_PART.findall(name.rpartition(".")[2] or name)]
    joined = {a + b for a, b in zip(parts, parts[1:], strict=False)}
    if parts and parts[-1] in HARMLESS:
        return 0.0
    return sum(SENSITIVE.get(p, 0.0) for p in {*parts, *joined})


def value_score(value: str) -> float:
    """Randomness of a literal: entropy a character, mixed character classes; below zero for placeholders and prose."""
    if len(value) < MIN_ASSIGN or PLACEHOLDER.match(value) or value.count(" ") > 2:
        return -10.0
    n = len(value)
    bits = -sum(c / n * math.log2(c / n) for c in Counter(value).values())
    classes = any(c.isdigit() for c in value) + any(c.islower() for c in value) + any(c.isupper() for c in value) + any(not c.isalnum() for c in value)
    return (bits - 2.5) * 0.5 + (classes - 1) * 0.5


def literals(parts: list) -> list[tuple[str, int, int]]:
    """The literals of a value in order, constants in it followed; a constant that comes again counts once."""
    out, seen, todo = [], set(), [iter(parts)]
    while todo:
        for p in todo[-1]:
            if isinstance(p, tuple):
                out.append(p)
            elif id(p) not in seen:
                seen.add(id(p))
                todo.append(iter(p))
                break
        else:
            todo.pop()
    return out


def unescaped(literal: str) -> str:
    """What a literal stands for."""
    return ESCAPE.sub(lambda m: chr(int(m[1] or m[2], 16)) if m[1] or m[2] else ESCAPED.get(m[3], m[3]), literal) if "\\" in literal else literal


def here_end(text: str, at: int, tag: str) -> int | None:
    """Where the body of a here-document that begins at ``at`` ends, its last line break excluded; None if it never does."""
    end = re.compile(rf"^[ \t]*{tag}\b", re.MULTILINE).search(text, at)
    return max(at, end.start() - 1) if end else None


def block_end(text: str, name: int, at: int) -> int:
    """Where the lines from ``at`` on stop that are indented deeper than the line of the name, or blank."""
    line = text.rfind("\n", 0, name) + 1
    indent = len(text[line:name]) - len(text[line:name].lstrip(" "))
    end = at
    while at < len(text):
        to = text.find("\n", at)
        to = len(text) if to < 0 else to
        if stripped := text[at:to].lstrip(" "):
            if to - at - len(stripped) <= indent:
                break
            end = to
        at = to + 1
    return end


def pairs(text: str) -> Iterator[tuple[str, list[tuple[str, int, int]], bool]]:
    """(name, terms with start and end, whether bare words count as literals) of each pair in order; a quoted term has
    its quotes. The body of a here-document or block is one term, and is read for pairs of its own as well."""
    at = 0
    no_end: set[str] = set()  # tags of here-documents that nothing ends from here on
    while m := PAIR.search(text, at):
        at = m.end()
        if m["element"]:
            yield m["element"], [(m["content"], *m.span("content"))], True
        elif m["flag"]:
            yield m["flag"], [(m["argument"], *m.span("argument"))], True
            at = m.start("argument")  # the argument may be a pair itself
        elif m["value"] is not None:
            code = m["op"] != ":" or bool(m["close"])
            yield m["name"], [(t[0], t.start(), t.end()) for t in TERM.finditer(text, *m.span("value"))], code or "=" in text[m.end("name") : m.start("value")]
        elif tag := m["here"]:
            end = None if tag in no_end else here_end(text, at, tag)
            if end is None:
                no_end.add(tag)
            elif end > at:
                yield m["name"], [(text[at:end], at, end)], True
        else:
            end = block_end(text, m.start("name"), at)
            first = at + len(text[at:end]) - len(text[at:end].lstrip())
            if end > first:
                yield m["name"], [(text[first:end], first, end)], True


def lexed_spans(text: str) -> list[SpanT]:
    """Literals that flow into sensitive names: directly, through a constant, or as part of a concatenation."""
    if not any(c in text for c in "=:<") and "--" not in text:
        return []
    constants: dict[str, list] = {}  # literals, and the lists of the constants that a value names
    found: set[SpanT] = set()
    for name, terms, code in pairs(text):
        parts: list = []
        for word, start, end in terms:
            if quote := OPENING.match(word):
                a, b = start + quote.end(), end - len(quote[1])
                parts.append((unescaped(text[a:b]), a, b))
            elif word in constants:
                parts.append(constants[word])
            elif code and any(c.isdigit() for c in word):
                parts.append((word, start, end))
        if not parts:
            continue
        constants[name] = parts
        if (score := name_score(name)) < 1.5:
            continue
        parts = literals(parts)
        if score + value_score("".join(p for p, _, _ in parts)) >= SCORE:
            found |= {(a, 3, b) for p, a, b in parts if b - a >= MIN_ASSIGN and value_score(p) > -10}
    return sorted(found)


def all_spans(text: str) -> tuple[list[SpanT], list[SpanT]]:
    base = base_spans(text)
    return base, sorted([*base, *lexed_spans(text)])


def written(spans: list[SpanT]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def redact(text: str, spans: list[SpanT], mark: str = "[SECRET]") -> str:
    """The text with every span (overlapping ones joined) replaced by ``mark``."""
    out, at = [], 0
    for a, _, b in spans:
        if a >= at:
            out += [text[at:a], mark]
        at = max(at, b)
    return "".join(out) + text[at:]


def scan(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each row of ``docs``: counts and spans by kind. Other columns are not read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sub_batches(whole, whole.schema.names[1])):
            rows = []
            for value in batch.column(1).to_pylist():
                base, spans = all_spans(value or "")
                kinds = Counter(k for _, k, _ in spans)
                rows.append((kinds[0], kinds[1], kinds[2], hashlib.sha256(written(base).encode()).hexdigest(), written(spans), kinds[3]))
            n = [list(x) for x in zip(*rows, strict=True)] if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), *(pa.array(x, pa.int64()) for x in n[:3]), pa.array(n[3], pa.string()), pa.array(n[4], pa.string()), pa.array(n[5], pa.int64())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_lexed"],
            )

    return docs.select(doc_id, text).mapInArrow(run, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string, n_lexed long")


def redacted(docs: DataFrame, text: str = "text", n_chars: str | None = "n_chars") -> DataFrame:
    """``docs`` with each found secret replaced in ``text`` (and ``n_chars`` kept true); all rows and columns stay."""
    names = docs.columns
    at, size = names.index(text), names.index(n_chars) if n_chars in names else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (part for whole in batches for part in sub_batches(whole, text)):
            texts = batch.column(at).to_pylist()
            sizes = batch.column(size).to_pylist() if size >= 0 else None
            for i, value in enumerate(texts):
                if value and (spans := all_spans(value)[1]):
                    texts[i] = redact(value, spans)
                    if sizes is not None:
                        sizes[i] = len(texts[i])
            columns = list(batch.columns)
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            if sizes is not None:
                columns[size] = pa.array(sizes, batch.schema.field(size).type)
            yield pa.RecordBatch.from_arrays(columns, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
