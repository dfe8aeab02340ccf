"""Settings: the environment before a TOML file before defaults."""

from __future__ import annotations

import logging
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field, fields

from graphloom.operators.ingest import Resolution
from graphloom.operators.scoring import QueryOptions


@dataclass
class QuerySettings:
    k: int = 20
    depth: int = 2
    max_nodes: int = 500
    top_n: int = 50
    min_score: float = 0.3

    def options(self, mode: str | None = None, **given: object) -> QueryOptions:
        own = {f.name: getattr(self, f.name) for f in fields(self)}
        return QueryOptions.of_mode(mode, **own | given)


@dataclass
class IngestSettings:
    mode: str = "embedding"
    threshold: float = 0.92
    match_type: bool = False

    def resolution(self) -> Resolution:
        return Resolution(self.mode, self.threshold, self.match_type)


@dataclass
class CacheSettings:
    embeddings: int = 50_000
    queries: int = 10_000
    ttl_seconds: int = 300


@dataclass
class ServiceSettings:
    merge_threshold: int = 500
    instance: int = 0
    per_minute: int = 60
    burst: int = 20
    public_per_minute: int = 120
    auto_store_images: bool = False


@dataclass
class Settings:
    query: QuerySettings = field(default_factory=QuerySettings)
    ingest: IngestSettings = field(default_factory=IngestSettings)
    cache: CacheSettings = field(default_factory=CacheSettings)
    service: ServiceSettings = field(default_factory=ServiceSettings)


#: Where else a setting may be named: in the environment, GRAPHLOOM_<SECTION>_<NAME>.
PREFIX = "GRAPHLOOM"


def _as(kind: type, text: object) -> object:
    if kind is bool:
        return {"true": True, "false": False}[str(text).lower()]
    return kind(text)  # type: ignore[call-arg]


def load(path: str | None = None, env: Mapping[str, str] = os.environ) -> Settings:
    """A file that can't be read counts as empty and is logged; a value that doesn't parse falls to the next source."""
    given: dict = {}
    if path is not None:
        try:
            with open(path, "rb") as f:
                given = tomllib.load(f)
        except FileNotFoundError:
            pass
        except tomllib.TOMLDecodeError as e:
            logging.getLogger(__name__).error("settings file %s: %s; using defaults", path, e)
    out = Settings()
    for section in fields(out):
        part = getattr(out, section.name)
        for f in fields(part):
            kind = type(getattr(part, f.name))
            for value in (given.get(section.name, {}).get(f.name), env.get(f"{PREFIX}_{section.name}_{f.name}".upper())):
                try:
                    if value is not None:
                        setattr(part, f.name, _as(kind, value))
                except (ValueError, KeyError):
                    continue
    out.service.instance = out.service.instance if 0 <= out.service.instance <= 255 else 0
    return out
