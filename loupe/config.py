"""Configuration: defaults, then a file, then the environment, then a profile; plain dictionaries on the driver."""

from __future__ import annotations

import copy
import json
import os
from collections.abc import Callable
from pathlib import Path
from typing import Any

from loupe.model import SEVERITIES

ANALYZERS = ["security", "circular", "deadcode", "docs", "duplicates", "visitors"]
ALIASES = {
    "imports": "circular", "circular_imports": "circular", "circular-import": "circular", "dead_code": "deadcode", "dead-code": "deadcode", "documentation": "docs",
    "doc_quality": "docs", "duplicate_code": "duplicates", "duplicate": "duplicates", "advanced_security": "security", "style": "visitors", "complexity": "visitors",
}

DEFAULTS: dict[str, Any] = {
    "global": {"max_findings_per_file": 20, "severity_filter": None, "rule_severity": {}},
    "output": {"format": "console", "colors": True},
    "exclude": {
        "dirs": sorted("__pycache__ .git .pytest_cache .mypy_cache venv env .env node_modules build dist .vscode .idea htmlcov coverage".split()),
        "files": sorted("*.pyc *.pyo *.pyd *.so *.dll *.exe *.log *.tmp *.cache *.lock *.pid *.min.js *.min.css *.bundle.js *.bundle.css".split()),
        "patterns": [],
    },
    "max_file_size": 1 << 20,
    "rules": {},
    "analyzers": {
        "security": {"enabled": True, "min_severity": None, "all_files": False, "entropy": True, "min_entropy": 4.5, "min_string_length": 20, "skip_test_data": True,
                     "allow": ["admin@example.com", "test@example.com", "user@example.com", "555-555-5555", "123-456-7890", "000-000-0000"]},
        "circular": {"enabled": True, "include_external": False},
        "deadcode": {"enabled": True, "exclude_public_api": True, "include_tests": False, "aggressive": False, "track_attribute_names": False},
        "docs": {"enabled": True, "require_module_docstring": True, "check_private_methods": False, "check_special_methods": False, "min_docstring_length": 10,
                 "enforce_style": False, "preferred_style": "google", "require_parameter_docs": True, "require_return_docs": True, "check_type_consistency": True, "validate_examples": True},
        "duplicates": {"enabled": True, "min_lines": 6, "threshold": 0.8, "k": 17, "w": 4, "exact": True, "structural": True, "partial": False, "min_tokens": 0},
        "visitors": {"enabled": True, "max_complexity": 10, "max_depth": 4},
    },
}

_MINOR = {"global": {"max_findings_per_file": 10}, "analyzers": {"security": {"min_severity": "High"}, "docs": {"require_parameter_docs": False, "check_private_methods": False}}}
PROFILES: dict[str, dict[str, Any]] = {
    "relaxed": _MINOR,
    "standard": {"global": {"max_findings_per_file": 20}, "analyzers": {"docs": {"require_parameter_docs": True}, "security": {"min_severity": "Medium"}}},
    "strict": {
        "global": {"max_findings_per_file": 50},
        "analyzers": {"deadcode": {"exclude_public_api": False}, "docs": dict.fromkeys(["require_return_docs", "require_parameter_docs", "enforce_style"], True), "security": {"min_severity": "Medium"}},
    },
}


def _flag(x: str) -> bool:
    return x.strip().lower() in ("1", "true", "yes", "on")


#: Environment variables: where their value goes and how it is read.
ENVIRONMENT: dict[str, tuple[str, Callable[[str], Any]]] = {
    "LOUPE_OUTPUT_FORMAT": ("output.format", str),
    "LOUPE_COLORS": ("output.colors", _flag),
    "LOUPE_MIN_SEVERITY": ("global.severity_filter", str),
    "LOUPE_MAX_FINDINGS": ("global.max_findings_per_file", int),
    "LOUPE_MAX_FILE_SIZE": ("max_file_size", int),
    "LOUPE_MIN_ENTROPY": ("analyzers.security.min_entropy", float),
    "LOUPE_MAX_COMPLEXITY": ("analyzers.visitors.max_complexity", int),
    "LOUPE_DUPLICATE_THRESHOLD": ("analyzers.duplicates.threshold", float),
}


def merge(base: dict[str, Any], over: dict[str, Any]) -> dict[str, Any]:
    """A deep merge; analyzers go by their own names."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def canonical(config: dict[str, Any]) -> dict[str, Any]:
    out = {k: v for k, v in config.items() if k != "analyzers"}
    for name, section in config.get("analyzers", {}).items():
        out.setdefault("analyzers", {}).setdefault(ALIASES.get(name, name), {}).update(section)
    return out


def get(config: dict[str, Any], path: str, default: object = None) -> Any:
    at: Any = config
    for part in path.split("."):
        if not isinstance(at, dict) or part not in at:
            return default
        at = at[part]
    return at


def put(config: dict[str, Any], path: str, value: object) -> None:
    *parents, last = path.split(".")
    for part in parents:
        config = config.setdefault(part, {})
    config[last] = value


def load_file(path: str) -> dict[str, Any]:
    text = Path(path).read_text(encoding="utf-8")
    if path.endswith((".yml", ".yaml")):
        import yaml

        return yaml.safe_load(text) or {}
    return json.loads(text)


def load(path: str | None = None, profile: str | None = None, env: dict[str, str] | None = None, **over: object) -> dict[str, Any]:
    """Defaults < file < environment < profile < over (dotted paths with __ for dots)."""
    out = merge(DEFAULTS, canonical(load_file(path))) if path else copy.deepcopy(DEFAULTS)
    for name, (at, read) in ENVIRONMENT.items():
        raw = (os.environ if env is None else env).get(name)
        if raw is not None:
            put(out, at, read(raw))
    if profile:
        if profile not in PROFILES:
            raise ValueError(f"no profile {profile}; there are {', '.join(PROFILES)}")
        out = merge(out, PROFILES[profile])
    for k, v in over.items():
        put(out, k.replace("__", "."), v)
    return out


def validate(config: dict[str, Any]) -> list[str]:
    """What is wrong with it."""
    bad = []
    for at in ("global.severity_filter", "analyzers.security.min_severity"):
        s = get(config, at)
        if s is not None and s.capitalize() not in SEVERITIES:
            bad.append(f"{at}: no severity {s}")
    if get(config, "output.format") not in ("console", "json", "xml", "sarif", "ide", "html"):
        bad.append("output.format: unknown")
    for at, low, high in (("analyzers.visitors.max_complexity", 1, 100), ("analyzers.duplicates.threshold", 0, 1), ("analyzers.security.min_entropy", 0, 8), ("max_file_size", 1, 1 << 40), ("global.max_findings_per_file", 1, 1 << 31), ("analyzers.duplicates.min_lines", 1, 10_000)):
        v = get(config, at)
        if not isinstance(v, int | float) or not low <= v <= high:
            bad.append(f"{at}: not from {low} to {high}")
    return bad


def analyzer_on(config: dict[str, Any], name: str) -> bool:
    return bool(get(config, f"analyzers.{ALIASES.get(name, name)}.enabled", True))


def rule_on(config: dict[str, Any], rule: str) -> bool:
    r = config.get("rules", {}).get(rule, True)
    return bool(r.get("enabled", True) if isinstance(r, dict) else r)


def select(names: str | list[str] | None = None, exclude: list[str] | None = None, security_only: bool = False) -> list[str]:
    """Analyzer names from a list or a string with commas, less the excluded ones."""
    if security_only:
        return ["security"]
    given = names.split(",") if isinstance(names, str) else names
    want = ANALYZERS if not given or given == ["all"] else [ALIASES.get(n.strip(), n.strip()) for n in given]
    unknown = [n for n in want if n not in ANALYZERS]
    if unknown:
        raise ValueError(f"no analyzer {', '.join(unknown)}")
    out = {ALIASES.get(n, n) for n in exclude or []}
    return [n for n in want if n not in out]


def settings(defaults: dict[str, Any], *layers: dict[str, Any]) -> dict[str, Any]:
    """Workspace, then editor, then environment settings: a shallow update each, keys as they are."""
    out = dict(defaults)
    for layer in layers:
        out.update(layer)
    return out


def changed(config: dict[str, Any], base: dict[str, Any] | None = None) -> dict[str, Any]:
    """Only what differs from the defaults."""
    base = DEFAULTS if base is None else base
    out = {}
    for k, v in config.items():
        if isinstance(v, dict) and isinstance(base.get(k), dict):
            if d := changed(v, base[k]):
                out[k] = d
        elif base.get(k, ...) != v:
            out[k] = v
    return out


def save(config: dict[str, Any], path: str, only_changed: bool = False) -> None:
    data = changed(config) if only_changed else config
    if path.endswith((".yml", ".yaml")):
        import yaml

        Path(path).write_text(yaml.safe_dump(data), encoding="utf-8")
    else:
        Path(path).write_text(json.dumps(data, indent=2, sort_keys=True), encoding="utf-8")


def reset_to_defaults(config: dict[str, Any]) -> None:
    config.clear()
    config.update(copy.deepcopy(DEFAULTS))


def add_exclude(config: dict[str, Any], pattern: str) -> None:
    if pattern not in config["exclude"]["patterns"]:
        config["exclude"]["patterns"].append(pattern)


def remove_exclude(config: dict[str, Any], pattern: str) -> None:
    config["exclude"]["patterns"] = [p for p in config["exclude"]["patterns"] if p != pattern]
