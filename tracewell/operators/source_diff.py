"""Differences of sources, many pairs at once (inventory rows D18, D19)."""

from __future__ import annotations

import difflib
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import markup

STATES = ("baseline_missing", "target_missing", "too_large", "decoding_failed", "identical", "truncated", "available")
#: Bytes of a source and of a difference, and lines of a difference, that are shown.
MAX_INPUT, MAX_OUTPUT, MAX_LINES = 1 << 20, 1 << 20, 5000


def difference(before: bytes | None, after: bytes | None, meaningful: bool, encoding: str | None = None, max_input: int = MAX_INPUT, max_output: int = MAX_OUTPUT, max_lines: int = MAX_LINES) -> tuple[str, str, int, int]:
    """State, unified difference, and how many lines of it are new and gone (of the whole, also where it is cut)."""
    if before is None or after is None:
        return ("baseline_missing" if before is None else "target_missing"), "", 0, 0
    if max(len(before), len(after)) > max_input:
        return "too_large", "", 0, 0
    try:
        texts = [x.decode(encoding or "utf-8") for x in (before, after)]
    except (LookupError, UnicodeDecodeError):
        return "decoding_failed", "", 0, 0
    if meaningful:
        texts = [markup.without_volatile(t)[0] for t in texts]
    if texts[0] == texts[1]:
        return "identical", "", 0, 0
    lines = list(difflib.unified_diff(*(t.splitlines() for t in texts), "Baseline", "Target", lineterm=""))
    added, gone = (sum(x.startswith(sign) for x in lines[2:]) for sign in "+-")
    shown = "\n".join(lines[:max_lines]).encode()
    state = "truncated" if len(lines) > max_lines or len(shown) > max_output else "available"
    return state, shown[:max_output].decode(errors="ignore"), added, gone


def source_diffs(pairs: DataFrame, keys: list[str], before: str = "before", after: str = "after", encoding: str | None = None, meaningful: bool = False, max_input: int | Column = MAX_INPUT, max_output: int = MAX_OUTPUT, max_lines: int = MAX_LINES) -> DataFrame:
    """``keys``, state, diff_text, lines_added, lines_removed of each pair of sources (bytes, null where there is none).

    With ``meaningful``, values that only defeat caches are masked first. ``max_input`` may be a column: each pair's own
    limit. Pairs that are too large are told apart before Python sees them; the others go through in Arrow batches, in
    partitions as they come."""
    b, t = F.col(before).cast("binary"), F.col(after).cast("binary")
    large = F.coalesce(F.greatest(F.octet_length(b), F.octet_length(t)) > max_input, F.lit(False)) & b.isNotNull() & t.isNotNull()
    rows = pairs.select(*keys, F.when(~large, b).alias("__b"), F.when(~large, t).alias("__t"), (F.col(encoding) if encoding else F.lit(None).cast("string")).alias("__e"), large.alias("__large"))
    out = rows.select(*keys).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(keys)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                columns = [part.column(k).to_pylist() for k in range(n, n + 4)]
                found = [("too_large", "", 0, 0) if big else difference(x, y, meaningful, e, sys.maxsize, max_output, max_lines) for x, y, e, big in zip(*columns, strict=True)]
                kinds = (pa.string(), pa.string(), pa.int64(), pa.int64())
                yield pa.RecordBatch.from_arrays([*part.columns[:n], *(pa.array(x, k) for x, k in zip(zip(*found, strict=True), kinds, strict=True))], names=[*keys, "state", "diff_text", "lines_added", "lines_removed"])

    ddl = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in out.fields), "state string", "diff_text string", "lines_added long", "lines_removed long"])
    return rows.mapInArrow(run, ddl)
