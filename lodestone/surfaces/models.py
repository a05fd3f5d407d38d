"""Completion by a model service: two request formats behind one call."""

from __future__ import annotations

import json
import urllib.request
from dataclasses import dataclass

from ..config import EngineConfig

# fixed values: model services
URLS = {"anthropic": "https://api.anthropic.com/v1", "openai": "https://api.openai.com/v1"}
MAX_TOKENS = 16_000


@dataclass(frozen=True)
class Model:
    """A model of a service; ``complete`` sends instructions and a question and returns the answer's text."""

    provider: str
    name: str
    key: str = ""
    base_url: str = ""

    @classmethod
    def of(cls, config: EngineConfig, provider: str = "", model: str = "") -> Model:
        chosen = config.resolved_provider(provider, model)
        name = model or config.model
        if not name:
            raise ValueError("no model is named")
        if chosen != "local" and not config.key:
            raise ValueError(f"no key for {chosen}")
        return cls(chosen, name, config.key, config.base_url or URLS.get(chosen, ""))

    def request(self, system: str, user: str) -> urllib.request.Request:
        base = self.base_url.rstrip("/")
        question = {"role": "user", "content": user}
        if self.provider == "anthropic":
            url, headers = f"{base}/messages", {"x-api-key": self.key, "anthropic-version": "2023-06-01"}
            body = {"model": self.name, "max_tokens": MAX_TOKENS, "system": system, "messages": [question]}
        else:
            url, headers = f"{base}/chat/completions", {"Authorization": f"Bearer {self.key or 'local'}"}
            body = {"model": self.name, "temperature": 0, "messages": [{"role": "system", "content": system}, question]}
        return urllib.request.Request(url, json.dumps(body).encode(), headers | {"Content-Type": "application/json"})

    def complete(self, system: str, user: str) -> str:
        with urllib.request.urlopen(self.request(system, user), timeout=300) as response:
            said = json.load(response)
        if self.provider == "anthropic":
            return next(part["text"] for part in said["content"] if part["type"] == "text")
        return said["choices"][0]["message"]["content"]
