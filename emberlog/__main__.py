"""``python -m emberlog [options] [sources]``: the analysis of log files, or of standard input, as a report."""

from __future__ import annotations

import argparse
import os
import sys
from pathlib import Path
from typing import TextIO

from pyspark.sql import SparkSession

from .plans import providers, render
from .plans.analyze import Result, analyze
from .plans.config import FORMATS, Config

VERSION = "0.2.0"


def arguments(argv: list[str]) -> argparse.Namespace:
    p = argparse.ArgumentParser("emberlog", description="What went wrong, out of log files: plain, .gz, .tar.gz, folders, patterns, or standard input (-).")
    p.add_argument("sources", nargs="*")
    p.add_argument("--level", help="least level: trace, debug, info, warn, error, fatal")
    p.add_argument("--since", help="a time, or a duration before now such as 2h")
    p.add_argument("--until", help="a time, or a duration before now")
    p.add_argument("--noise-file", help="further noise patterns, one in a line")
    p.add_argument("--format", help=f"one of {', '.join(FORMATS)}")
    p.add_argument("--output", help="file for the report")
    p.add_argument("--ai-provider", help="anthropic, openai, gemini or ollama: have the summary explained")
    p.add_argument("--model")
    p.add_argument("--ai-timeout", help="such as 30s or 2m; 5m if not given")
    p.add_argument("--budget", type=int, help="tokens of the summary")
    p.add_argument("--config", default=str(Path.home() / ".emberlog" / "config.toml"), help="a TOML file")
    p.add_argument("--no-color", action="store_true", default=None)
    p.add_argument("-v", "--verbose", action="store_true", default=None)
    p.add_argument("--version", action="version", version=VERSION)
    return p.parse_args(argv)


def report(result: Result, config: Config, analysis: str, colour: bool) -> str:
    if config.format == "json":
        return render.as_json(result.summary, result.stats, analysis) + "\n"
    if config.format == "markdown":
        return render.as_markdown(result.summary, result.stats, analysis)
    return (f"{analysis}\n\n" if analysis else "") + render.as_text(result.summary, colour)


def explained(summary: str, config: Config, live: TextIO | None) -> str:
    """The provider's text; ``live`` gets it piece by piece as well."""
    out = []
    provider = providers.provider(config.ai_provider, config.model, timeout=config.timeout_seconds)
    for piece in providers.explain(provider, summary, config.system_prompt or providers.PROMPT):
        out.append(piece)
        if live:
            live.write(piece)
            live.flush()
    if live:
        live.write("\n")
    return "".join(out)


def main(argv: list[str] | None = None, spark: SparkSession | None = None, out: TextIO | None = None) -> int:
    """0 if a report was written, 2 for options that can't be read."""
    flags, out = vars(arguments(sys.argv[1:] if argv is None else argv)), out or sys.stdout
    path, sources = flags.pop("config"), flags.pop("sources")
    try:
        config = Config.load(flags, path)
        opts = config.options()
        if config.ai_provider:
            providers.provider(config.ai_provider, config.model, timeout=config.timeout_seconds)
    except (ValueError, OSError) as e:
        print(f"emberlog: {e}", file=sys.stderr)
        return 2
    spark = spark or SparkSession.builder.appName("emberlog").config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    result = analyze(spark, sources, opts)
    live = out if config.format == "text" and not config.output else None
    analysis = explained(result.summary, config, live) if config.ai_provider else ""
    # colours only where a terminal shows them
    colour = not config.output and not config.no_color and not os.environ.get("NO_COLOR") and getattr(out, "isatty", lambda: False)()
    text = report(result, config, "" if live else analysis, colour)
    if config.output:
        Path(config.output).write_text(text, encoding="utf-8")
    else:
        out.write(text)
    if config.format == "text":
        print(render.stats_table(result.stats), file=sys.stderr)
    result.release()
    return 0


if __name__ == "__main__":
    sys.exit(main())
