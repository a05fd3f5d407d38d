"""Settings of the engine, from arguments or the environment."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from .functions import fixed_values as V


@dataclass(frozen=True)
class EngineConfig:
    """Where indexes lie and which model service answers; blank entries of lists are dropped."""

    index_dir: str = "index"
    extra_dirs: tuple[str, ...] = ()
    digest: str = ""
    provider: str = ""
    model: str = ""
    base_url: str = ""
    has_key: bool = field(default=False)
    key: str = field(default="", repr=False)
    product: str = ""

    @classmethod
    def from_env(cls, env: dict[str, str] | None = None, prefix: str = "LODESTONE_") -> EngineConfig:
        e = os.environ if env is None else env
        get = lambda name: e.get(prefix + name, "").strip()
        return cls(
            index_dir=os.path.abspath(get("INDEX") or "index"),
            extra_dirs=tuple(os.path.abspath(d.strip()) for d in get("EXTRA_INDEXES").split(os.pathsep) if d.strip()),
            digest=get("DIGEST"), provider=get("PROVIDER").lower(), model=get("MODEL"), base_url=get("BASE_URL"), has_key=bool(get("API_KEY")), key=get("API_KEY"), product=get("PRODUCT").lower(),
        )

    def indexes(self) -> list[str]:
        return [self.index_dir, *self.extra_dirs]

    def resolved_provider(self, provider: str = "", model: str = "") -> str:
        """The service for a call: the first that is named by argument, setting, base URL, model asked for, key or default."""
        low = model.strip().lower()
        by_model = next((p for p, starts in V.MODEL_PREFIXES.items() if low.startswith(starts)), "")
        named = (provider.strip().lower(), self.provider, "local" if self.base_url else "", by_model, "anthropic" if self.has_key else "", "openai")
        chosen = next(filter(None, named))
        if chosen not in V.PROVIDERS:
            raise ValueError(f"unsupported provider {chosen!r}")
        if chosen == "local" and not self.base_url:
            raise ValueError("a local provider needs a base URL")
        return chosen

    @property
    def profile(self) -> V.Profile:
        return V.Profile(self.product)
