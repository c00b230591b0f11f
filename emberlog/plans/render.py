"""Reports as JSON, Markdown and terminal text; a table of counters."""

from __future__ import annotations

import json
import os
import re
from datetime import datetime

#: Terminal colours of the levels.
COLOURS = {"FATAL": "\x1b[1;31m", "ERROR": "\x1b[31m", "WARN": "\x1b[33m", "INFO": "\x1b[36m"}
BOLD, OFF = "\x1b[1m", "\x1b[0m"


def comma(n: int) -> str:
    return f"{n:,}"


def _plain(x):
    return x.isoformat() if isinstance(x, datetime) else str(x)


def as_json(summary: str, stats: dict, analysis: str = "") -> str:
    report = {"stats": stats, "summary": summary, "file_count": 0, "bytes_processed": 0} | ({"analysis": analysis} if analysis else {})
    return json.dumps(report, indent=2, default=_plain, ensure_ascii=False)


def as_markdown(summary: str, stats: dict, analysis: str = "") -> str:
    rows = [("Ingested", stats["ingested"]), ("Dropped", stats["dropped"]), ("Survived", stats["survived"]), ("Unique signatures", stats["unique_signatures"])]
    table = "\n".join(f"| {k} | {comma(v)} |" for k, v in rows)
    return "# Log Analysis\n\n" + (f"## Analysis\n\n{analysis}\n\n" if analysis else "") + f"{summary}\n## Statistics\n\n| Metric | Value |\n|---|---|\n{table}\n"


def as_text(summary: str, colour: bool | None = None) -> str:
    """Headings bold, level names coloured; plain where NO_COLOR is set or colour is off."""
    if colour is False or colour is None and os.environ.get("NO_COLOR"):
        return summary
    out = re.sub(r"^## (.*)$", rf"{BOLD}\1{OFF}", summary, flags=re.M)
    return re.sub(r"\[(FATAL|ERROR|WARN|INFO)\]", lambda m: f"[{COLOURS[m[1]]}{m[1]}{OFF}]", out)


def stats_table(stats: dict) -> str:
    lines = [f"{k.replace('_', ' ')}: {comma(v)}" for k, v in stats.items() if isinstance(v, int)]
    lines += [f"  dropped by {k}: {comma(v)}" for k, v in sorted(stats["drops"].items())]
    lines += [f"  {k}: {comma(v)}" for k, v in sorted(stats["source_breakdown"].items())]
    return "\n".join(lines)
