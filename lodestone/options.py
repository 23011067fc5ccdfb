"""All options in one frozen value; environment variables of the same names, in capitals behind a prefix, override the defaults."""

from __future__ import annotations

import os
from collections.abc import Mapping
from dataclasses import dataclass, fields

CHOICES = {"strategy": ("fixed", "recursive", "section"), "mode": ("dense", "bm25", "hybrid"), "reranker": ("none", "lexical", "model")}


class MissingKey(RuntimeError):
    """A provider without a key was asked for."""


@dataclass(frozen=True)
class Options:
    strategy: str = "section"
    chunk_tokens: int = 400
    chunk_overlap: int = 60
    section_tokens: int = 150
    embedder: str = "hashing"
    mode: str = "hybrid"
    candidates: int = 30
    final: int = 5
    reranker: str = "none"
    rewriting: bool = True
    rewrites: int = 2
    provider: str = "local"
    model: str = "offline"
    fallback_model: str = ""
    judge_provider: str = "local"
    judge_model: str = "offline-judge"
    temperature: float = 0.0
    reply_tokens: int = 1500
    attempts: int = 11
    cache_size: int = 256
    cache_hours: float = 24.0
    per_minute: int = 10
    log_bytes: int = 5_000_000
    providers: tuple[str, ...] = ("local",)

    def __post_init__(self):
        for name, allowed in CHOICES.items():
            if getattr(self, name) not in allowed:
                raise ValueError(f"{name} must be one of {', '.join(allowed)}, not {getattr(self, name)!r}")
        for name in ("provider", "judge_provider"):
            if getattr(self, name) not in self.providers:
                raise ValueError(f"{name} must be one of {', '.join(self.providers)}, not {getattr(self, name)!r}")

    @classmethod
    def read(cls, env: Mapping[str, str] | None = None, prefix: str = "LODESTONE_") -> Options:
        """Defaults, then the environment."""
        env, given = os.environ if env is None else env, {}
        for f in fields(cls):
            text = env.get(prefix + f.name.upper())
            if text is not None:
                kind = type(f.default)
                given[f.name] = text.lower() in ("1", "true", "yes", "on") if kind is bool else tuple(x.strip() for x in text.split(",")) if kind is tuple else kind(text)
        return cls(**given)

    def route(self, role: str = "answer", name: str | None = None) -> tuple[str, str]:
        """(provider, model) of a role; ``name`` overrides the model, and the provider too if it begins with a known one and a colon."""
        provider, model = (self.provider, self.model) if role == "answer" else (self.judge_provider, self.judge_model)
        head, colon, rest = (name or model).partition(":")
        return (head, rest) if colon and head in self.providers else (provider, name or model)

    def key(self, provider: str, env: Mapping[str, str] | None = None) -> str:
        """The provider's key, from ``<PROVIDER>_API_KEY``; read where the call is made, so that no plan carries it. Local ones need none."""
        found = (os.environ if env is None else env).get(f"{provider.upper()}_API_KEY", "")
        if not found and provider != "local":
            raise MissingKey(f"no key for {provider}: set {provider.upper()}_API_KEY")
        return found

    def configured(self, env: Mapping[str, str] | None = None) -> bool:
        try:
            self.key(self.provider, env)
        except MissingKey:
            return False
        return bool(self.model)
