"""Defaults of the engine and their reader."""

from __future__ import annotations

from dataclasses import dataclass, field, fields, is_dataclass, replace


@dataclass(frozen=True)
class RecallConfig:
    max_injected: int = 3
    budget_tokens: int = 1500
    min_similarity: float = 0.34
    min_keyword: float = 0.55
    min_keyword_fallback: float = 0.30
    semantic_weight: float = 0.75
    relative_cutoff: float = 0.8
    search_min_similarity: float = 0.25
    search_episodes: int = 5
    rerank: str | None = None
    time_chains: bool = False
    entity_hops: bool = False
    k1: float = 1.2
    b: float = 0.75

    def keyword_floor(self, inject: bool, vectors: bool) -> float:
        return self.min_keyword if inject and vectors else self.min_keyword_fallback


@dataclass(frozen=True)
class ExtractionConfig:
    enabled: bool = True
    idle_minutes: int = 10
    daily_llm_calls: int = 100
    global_scope: bool = True
    reflection: bool = False
    known_entities: bool = False
    contradictions: bool = True
    turn_notes: bool = False
    dossiers: bool = True
    narratives: bool = False
    dossier_overviews: bool = False


@dataclass(frozen=True)
class ExperimentalConfig:
    gate_enabled: bool = False
    gate_mode: str = "auto"
    abstain_threshold: float = 0.35
    action_guard: str = "off"
    eviction_enabled: bool = False
    evict_threshold_tokens: int = 20_000
    tool_result_min_tokens: int = 500
    maintenance_enabled: bool = False


@dataclass(frozen=True)
class Config:
    recall: RecallConfig = field(default_factory=RecallConfig)
    extraction: ExtractionConfig = field(default_factory=ExtractionConfig)
    experimental: ExperimentalConfig = field(default_factory=ExperimentalConfig)


def _over(base, values):
    """``base`` with the fields that ``values`` names; unknown names are ignored, a wrong type is an error."""
    known = {}
    for f in fields(base):
        if not isinstance(values, dict) or f.name not in values:
            continue
        now, v = getattr(base, f.name), values[f.name]
        if is_dataclass(now):
            known[f.name] = _over(now, v)
        elif v is None or now is None or isinstance(v, type(now)) or (isinstance(now, float) and isinstance(v, int)):
            known[f.name] = v if v is not None else now
        else:
            raise ValueError(f"{f.name}: {v!r} is no {type(now).__name__}")
    return replace(base, **known)


def read(text: str) -> Config:
    """The configuration of a YAML text over the defaults. Experimental settings that stand at the top, as in old files, move to their section."""
    import yaml

    raw = yaml.safe_load(text) or {}
    old = {k: v for k, v in raw.items() if k in {f.name for f in fields(ExperimentalConfig)}}
    if old:
        raw = raw | {"experimental": old | (raw.get("experimental") or {})}
    return _over(Config(), raw)
