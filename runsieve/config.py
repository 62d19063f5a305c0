"""Thresholds as frozen dataclasses, optionally read from a TOML file."""

from __future__ import annotations

import os
import tomllib
from dataclasses import dataclass, field, fields, replace
from pathlib import Path

#: Phrases of platform failures that count for no test.
INFRA_PHRASES = (
    "no space left on device",
    "error pulling image",
    "imagepullbackoff",
    "manifest unknown",
    "the runner has received a shutdown signal",
    "the operation was canceled",
    "lost communication with the server",
    "received sigkill",
    "exited with code 137",
    "spot instance interruption",
    "worker was preempted",
)


@dataclass(frozen=True)
class Detect:
    window_executions: int = 50
    min_observations: int = 10
    flake_rate_threshold: float = 0.05
    ewma_alpha: float = 0.3
    regression_pass_streak: int = 3
    regression_fail_streak: int = 2
    main_branch: str = "main"
    infra_error_patterns: tuple[str, ...] = INFRA_PHRASES


@dataclass(frozen=True)
class Identity:
    alias_max_distance: float = 0.25
    alias_certain_distance: float = 0.03
    name_weight: float = 0.5
    path_weight: float = 0.5
    compare_chars: int = 512
    rank_digits: int = 9


@dataclass(frozen=True)
class Cause:
    gate_model: str = "gate"
    model: str = "keywords"
    confidence_floor: float = 0.55
    budget_usd: float = 0.50
    max_tests: int = 25
    trace_budget_chars: int = 2000
    head_share: float = 0.6
    gate_budget_chars: int = 600
    gate_enabled: bool = True
    #: model prefix -> USD per million input and output tokens
    prices: dict[str, tuple[float, float]] = field(default_factory=dict)


@dataclass(frozen=True)
class Policy:
    quarantine_flake_rate: float = 0.05
    quarantine_min_observations: int = 10
    quarantine_ttl_days: int = 14
    dequarantine_clean_runs: int = 20
    expiring_days: int = 3


@dataclass(frozen=True)
class Report:
    comment_rows: int = 10


@dataclass(frozen=True)
class Config:
    detect: Detect = Detect()
    identity: Identity = Identity()
    cause: Cause = field(default_factory=Cause)
    policy: Policy = Policy()
    report: Report = Report()


_SHARES = {"flake_rate_threshold", "ewma_alpha", "alias_max_distance", "alias_certain_distance", "confidence_floor", "quarantine_flake_rate"}


def _section(default, given: dict):
    known = {f.name for f in fields(default)}
    if unknown := sorted(set(given) - known):
        raise ValueError(f"unknown settings: {', '.join(unknown)}")
    for name, value in given.items():
        if name in _SHARES and not 0 <= value <= 1:
            raise ValueError(f"{name} must lie between 0 and 1")
        if isinstance(getattr(default, name), int) and not isinstance(getattr(default, name), bool) and value < 1:
            raise ValueError(f"{name} must be at least 1")
    return replace(default, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items()})


def load(path: str | None = None, name: str = "runsieve.toml") -> Config:
    """The settings of a TOML file, by default of `name` in the folder or the nearest above it.

    RUNSIEVE_MODEL and RUNSIEVE_GATE_MODEL override the model ids; unknown keys raise.
    """
    if path is None:
        here = Path.cwd()
        path = next((str(d / name) for d in (here, *here.parents) if (d / name).is_file()), None)
    given = tomllib.loads(Path(path).read_text(encoding="utf-8")) if path else {}
    base = Config()
    if unknown := sorted(set(given) - {f.name for f in fields(base)}):
        raise ValueError(f"unknown sections: {', '.join(unknown)}")
    out = replace(base, **{k: _section(getattr(base, k), v) for k, v in given.items()})
    over = {k: os.environ[v] for k, v in (("model", "RUNSIEVE_MODEL"), ("gate_model", "RUNSIEVE_GATE_MODEL")) if os.environ.get(v)}
    return replace(out, cause=replace(out.cause, **over)) if over else out
