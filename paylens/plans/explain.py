"""Plan inspection helpers (used by tests and when tuning operators).

They capture what ``DataFrame.explain`` prints, so the text is exactly what a
user sees in the console.
"""

from __future__ import annotations

import contextlib
import io
import re

from pyspark.sql import DataFrame


def _explain(df: DataFrame, mode: str) -> str:
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode=mode)
    return buf.getvalue()


def plan_text(df: DataFrame, final: bool = False) -> str:
    """The physical plan as text.

    ``final=False`` gives the plan before adaptive re-optimization (no query
    runs). ``final=True`` first collects ``df`` (small results only) so the
    text shows the plan AQE settled on.
    """
    if final:
        df.collect()
    return _explain(df, "simple")


def formatted(df: DataFrame) -> str:
    """``explain("formatted")`` output as a string."""
    return _explain(df, "formatted")


def shuffle_profile(text: str) -> dict[str, object]:
    """Counts from a plan's text: Parquet scans, hash exchanges moving rows
    (``raw_shuffles``) or partial aggregates (``agg_shuffles``), range
    exchanges (global sorts), broadcasts, join strategies, windows, top-k."""
    lines = [ln.lstrip(" :+-") for ln in text.splitlines()]
    raw = agg = 0
    for i, ln in enumerate(lines):
        if ln.startswith("Exchange hashpartitioning"):
            child = lines[i + 1] if i + 1 < len(lines) else ""
            if child.startswith("HashAggregate"):
                agg += 1
            else:
                raw += 1
    joins = sorted({m.group(1) for ln in lines for m in [re.match(r"(\w*Join)\b", ln)] if m})
    return {
        "scans": sum(ln.startswith("FileScan parquet") for ln in lines),
        "raw_shuffles": raw,
        "agg_shuffles": agg,
        "range": sum(ln.startswith("Exchange rangepartitioning") for ln in lines),
        "broadcast": sum(ln.startswith("BroadcastExchange") for ln in lines),
        "joins": ", ".join(joins) or "-",
        "windows": sum(ln.startswith("Window ") for ln in lines),
        "topk": "yes" if any(ln.startswith("TakeOrderedAndProject") for ln in lines) else "",
    }
