"""A language model behind an HTTP server, as a function that models.answers() can call in its tasks."""

from __future__ import annotations

import json
import time
import urllib.error
import urllib.request
from dataclasses import dataclass

from cairn.operators.models import endpoint

#: The paths of the two kinds of servers.
PATHS = {"openai": "/v1/chat/completions", "ollama": "/api/chat"}


def body(kind: str, model: str, prompt: str, system: str = "") -> bytes:
    turns = ([{"role": "system", "content": system}] if system else []) + [{"role": "user", "content": prompt}]
    return json.dumps({"model": model, "messages": turns, "stream": False}).encode()


def reply(text: str) -> str:
    """The answer in a server's body: one message, or lines of parts. ValueError for a server's error or a body without an answer."""
    parts, lines = [], [text]
    try:
        json.loads(text)
    except ValueError:
        lines = text.splitlines()
    for line in lines:
        if not line.strip():
            continue
        try:
            got = json.loads(line)
        except ValueError:
            continue
        if not isinstance(got, dict):
            continue
        if error := got.get("error"):
            raise ValueError(error.get("message") if isinstance(error, dict) else str(error))
        for choice in got.get("choices") or [got]:
            message = choice.get("message") or choice.get("delta") or {}
            part = message.get("content", choice.get("response"))
            if part is not None:
                parts.append(part)
    if not parts:
        raise ValueError("the body holds no answer")
    return "".join(parts)


@dataclass(frozen=True)
class HttpModel:
    """Asks a server for each prompt, again after a pause where it cannot be reached. One bad prompt fails no task: as a function it gives an empty text
    for an answer that cannot be had, asked() tells why. What a server itself refuses is not asked again."""

    base: str
    model: str
    kind: str = "ollama"
    timeout: float = 120.0
    tries: int = 3
    pause: float = 0.5

    def __call__(self, prompts: list[str]) -> list[str]:
        return [answer or "" for answer, _ in self.asked(prompts)]

    def asked(self, prompts: list[str]) -> list[tuple[str | None, str | None]]:
        """(answer, error) of each prompt, one of them null."""
        return [self.one(p) for p in prompts]

    def one(self, prompt: str) -> tuple[str | None, str | None]:
        error = None
        for k in range(self.tries):
            try:
                asked = urllib.request.Request(endpoint(self.base, PATHS[self.kind]), body(self.kind, self.model, prompt), {"Content-Type": "application/json"})
                with urllib.request.urlopen(asked, timeout=self.timeout) as got:
                    return reply(got.read().decode()), None
            except ValueError as e:
                return None, f"refused: {e}"
            except urllib.error.HTTPError as e:
                error = f"status {e.code}"
                if e.code < 500 and e.code != 429:
                    return None, error
            except OSError as e:
                error = f"not reached: {e}"
            time.sleep(self.pause * (k + 1))
        return None, error
