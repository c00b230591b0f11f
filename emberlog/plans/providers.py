"""Language-model providers for a summary: driver side, streamed, and never part of a Spark plan.

No network is needed to import this; a provider is anything with ``stream(system, prompt)``.
"""

from __future__ import annotations

import json
import os
import urllib.request
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Protocol

PROMPT = "You are an engineer on call. From the log summary say what failed first, what followed from it, and what to check next."


class Provider(Protocol):
    def stream(self, system: str, prompt: str) -> Iterator[str]: ...


def sse(lines: Iterable[str]) -> Iterator[tuple[str, str]]:
    """(event, data) of a server-sent event stream: a blank line ends an event, a line from a colon is a comment."""
    event, data = "", []
    for line in lines:
        line = line.rstrip("\r\n")
        if not line:
            if data:
                yield event or "message", "\n".join(data)
            event, data = "", []
        elif not line.startswith(":"):
            name, _, value = line.partition(":")
            value = value.removeprefix(" ")
            if name == "event":
                event = value
            elif name == "data":
                data.append(value)
    if data:
        yield event or "message", "\n".join(data)


@dataclass
class Http:
    """One provider's request and the place of text in what it streams."""

    url: str
    headers: dict
    body: dict
    pick: tuple
    timeout: float = 300.0
    ndjson: bool = False

    def stream(self, system: str, prompt: str) -> Iterator[str]:
        body = json.dumps(_filled(self.body, system, prompt)).encode()
        request = urllib.request.Request(self.url, body, {"content-type": "application/json"} | self.headers)
        with urllib.request.urlopen(request, timeout=self.timeout) as answer:
            lines = (x.decode() for x in answer)
            yield from self.texts(lines)

    def texts(self, lines: Iterable[str]) -> Iterator[str]:
        for data in (x for x in lines if x.strip()) if self.ndjson else (d for _, d in sse(lines)):
            if data.strip() == "[DONE]":
                return
            at = json.loads(data)
            for key in self.pick:
                try:
                    at = at[key]
                except (KeyError, IndexError, TypeError):
                    at = None
                    break
            if isinstance(at, str) and at:
                yield at


def _filled(x, system, prompt):
    if isinstance(x, dict):
        return {k: _filled(v, system, prompt) for k, v in x.items()}
    if isinstance(x, list):
        return [_filled(v, system, prompt) for v in x]
    return {"$system": system, "$prompt": prompt}.get(x, x) if isinstance(x, str) else x


def provider(name: str, model: str, key: str | None = None, base: str | None = None, timeout: float = 300.0) -> Http:
    """A provider by name; keys come from its usual environment variable."""
    chat = [{"role": "system", "content": "$system"}, {"role": "user", "content": "$prompt"}]
    if name == "anthropic":
        head = {"x-api-key": key or os.environ.get("ANTHROPIC_API_KEY", ""), "anthropic-version": "2023-06-01"}
        return Http((base or "https://api.anthropic.com") + "/v1/messages", head, {"model": model, "max_tokens": 4096, "stream": True, "system": "$system", "messages": chat[1:]}, ("delta", "text"), timeout)
    if name == "openai":
        head = {"authorization": f"Bearer {key or os.environ.get('OPENAI_API_KEY', '')}"}
        return Http((base or "https://api.openai.com") + "/v1/chat/completions", head, {"model": model, "stream": True, "messages": chat}, ("choices", 0, "delta", "content"), timeout)
    if name == "gemini":
        head = {"x-goog-api-key": key or os.environ.get("GEMINI_API_KEY", "")}
        body = {"systemInstruction": {"parts": [{"text": "$system"}]}, "contents": [{"role": "user", "parts": [{"text": "$prompt"}]}]}
        return Http((base or "https://generativelanguage.googleapis.com") + f"/v1beta/models/{model}:streamGenerateContent?alt=sse", head, body, ("candidates", 0, "content", "parts", 0, "text"), timeout)
    if name == "ollama":
        return Http((base or "http://localhost:11434") + "/api/chat", {}, {"model": model, "stream": True, "messages": chat}, ("message", "content"), timeout, ndjson=True)
    raise ValueError(f"no such provider: {name}")


def explain(p: Provider, summary: str, system: str = PROMPT) -> Iterator[str]:
    """The provider's text about a summary, piece by piece."""
    return p.stream(system, summary)
