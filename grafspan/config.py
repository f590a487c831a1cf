"""Settings with their origin, and overrides that a project declares about its own code."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field
from pathlib import Path

#: name: (type, default)
SETTINGS = {
    "index_dir": (str, ".grafspan"),
    "absent_floor": (float, 0.40),
    "close_threshold": (float, 0.85),
    "candidate_count": (int, 5),
    "ngram_q": (int, 3),
    "expansion_cap": (int, 50),
    "debounce_ms": (int, 2000),
    "hints": (bool, True),
}


@dataclass(frozen=True)
class Setting:
    value: object
    source: str  # flag, env, file or default


def _cast(kind: type, value: object) -> object:
    if kind is bool and isinstance(value, str):
        return value.strip().lower() in ("1", "true", "yes", "on")
    return kind(value)


def settings(flags: dict | None = None, file: str | Path | None = None, env: dict | None = None) -> dict[str, Setting]:
    """Every setting by flag, else environment (GRAFSPAN_NAME), else JSON file, else default. Values that don't parse are passed over."""
    flags, env = flags or {}, os.environ if env is None else env
    text = json.loads(Path(file).read_text()) if file and Path(file).exists() else {}
    out = {}
    for name, (kind, default) in SETTINGS.items():
        out[name] = Setting(default, "default")
        for source, value in (("flag", flags.get(name)), ("env", env.get(f"GRAFSPAN_{name.upper()}")), ("file", text.get(name))):
            if value is None:
                continue
            try:
                out[name] = Setting(_cast(kind, value), source)
                break
            except (TypeError, ValueError):
                continue
    return out


@dataclass(frozen=True)
class Overrides:
    """What a project says about its code, before anything is inferred: by type, then by annotation.

    roles_by_fqn and roles_by_annotation name a role; capabilities add to those found; microservices gives
    path prefixes a service; generated lists type fqns that count as generated.
    """

    roles_by_fqn: dict[str, str] = field(default_factory=dict)
    roles_by_annotation: dict[str, str] = field(default_factory=dict)
    capabilities_by_fqn: dict[str, list[str]] = field(default_factory=dict)
    capabilities_by_annotation: dict[str, list[str]] = field(default_factory=dict)
    microservices: dict[str, str] = field(default_factory=dict)

    @classmethod
    def load(cls, path: str | Path) -> Overrides:
        """From a JSON file; a missing one is empty, unknown keys are refused."""
        if not Path(path).exists():
            return cls()
        given = json.loads(Path(path).read_text())
        if unknown := set(given) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown overrides: {', '.join(sorted(unknown))}")
        return cls(**given)
