"""Settings of a run: flags over environment over a TOML file over defaults."""

from __future__ import annotations

import os
import re
import tomllib
from dataclasses import dataclass, field, fields
from datetime import datetime, timedelta, timezone
from pathlib import Path

from ..functions import levels as L
from ..operators.filters import FilterOptions, noise_patterns
from .analyze import Options

_UNITS = {"ns": 1e-9, "us": 1e-6, "µs": 1e-6, "ms": 1e-3, "s": 1, "m": 60, "h": 3600}


def duration(text: str) -> timedelta:
    """``1h30m`` and the like; bare numbers are refused."""
    parts = re.findall(r"(\d+(?:\.\d+)?)(ns|us|µs|ms|s|m|h)", text)
    if not parts or "".join(a + b for a, b in parts) != text:
        raise ValueError(f"not a duration: {text!r}")
    return timedelta(seconds=sum(float(a) * _UNITS[b] for a, b in parts))


def moment(text: str, now: datetime | None = None) -> datetime:
    """A duration before now, an RFC 3339 time, or a local time."""
    try:
        return (now or datetime.now(timezone.utc)) - duration(text)
    except ValueError:
        pass
    t = datetime.fromisoformat(text.replace("Z", "+00:00"))
    return t if t.tzinfo else t.astimezone()


#: Report formats.
FORMATS = ("text", "json", "markdown")


@dataclass
class Config:
    level: str = "warn"
    since: str = ""
    until: str = ""
    noise_file: str = ""
    format: str = "text"
    output: str = ""
    budget: int = 8192
    dedup_keep: int = 5
    spike_multiplier: float = 10.0
    auto_window: bool = True
    correlation_seconds: float = 0.0
    ai_provider: str = ""
    model: str = ""
    ai_timeout: str = "5m"
    system_prompt: str = ""
    no_color: bool = False
    verbose: bool = False
    sources: list[str] = field(default_factory=list)

    @classmethod
    def load(cls, flags: dict | None = None, path: str | None = None, env: dict | None = None) -> Config:
        env = os.environ if env is None else env
        kinds = {f.name: type(f.default) for f in fields(cls) if f.name != "sources"}
        found: dict = {}
        if path and Path(path).exists():
            found |= {k: v for k, v in tomllib.loads(Path(path).read_text()).items() if k in kinds}
        for k, kind in kinds.items():
            v = env.get(f"EMBERLOG_{k.upper()}")
            if v:
                found[k] = v.lower() in ("1", "true", "yes") if kind is bool else kind(v)
        found |= {k: v for k, v in (flags or {}).items() if v is not None}
        return cls(**found)

    @property
    def min_level(self) -> int:
        """The level's rank; a word that names none is refused."""
        word = self.level.strip().upper()
        rank = next((k for k, names in L.SPELLINGS.items() if word in names), L.UNKNOWN)
        if rank == L.UNKNOWN:
            raise ValueError(f"not a log level: {self.level!r}")
        return rank

    @property
    def timeout_seconds(self) -> float:
        seconds = duration(self.ai_timeout or "5m").total_seconds()
        if seconds <= 0:
            raise ValueError("the provider's timeout must be positive")
        return seconds

    def options(self, now: datetime | None = None) -> Options:
        """What the analysis is told. Anything that can't be read is a ValueError before any work."""
        if self.format not in FORMATS:
            raise ValueError(f"not an output format: {self.format!r} (one of {', '.join(FORMATS)})")
        at = lambda text: moment(text, now) if text else None
        noise = noise_patterns(Path(self.noise_file).read_text()) if self.noise_file else []
        kept = FilterOptions(self.min_level, at(self.since), at(self.until), noise, [], self.dedup_keep, self.spike_multiplier, self.auto_window)
        return Options(kept, self.correlation_seconds, self.budget)
