"""Configuration: a YAML document, validated as a whole."""

from __future__ import annotations

import hashlib
import json
from dataclasses import dataclass
from pathlib import Path

from weftgraph.functions import constants as K


class ConfigError(Exception):
    """Names the key at fault."""


@dataclass(frozen=True)
class Options:
    """Of session reports; a value of the wrong kind falls back alone."""

    globs: tuple[str, ...] = ("src/**/*.ts",)
    top: int = 5
    budget_chars: int = 1500
    heuristics: bool = False
    inject: bool = True
    log_dir: str = ".coupling"
    timeout_ms: int = 120_000

    @staticmethod
    def parse(raw: dict | None) -> Options:
        raw, given = raw or {}, {}
        if isinstance(raw.get("globs"), list) and (globs := [g for g in raw["globs"] if isinstance(g, str) and g]):
            given["globs"] = tuple(globs)
        for name in ("top", "budget_chars", "timeout_ms"):
            v = raw.get(name)
            if isinstance(v, int | float) and not isinstance(v, bool) and v > 0 and v == v and v != float("inf"):
                given[name] = int(v)
        given |= {n: raw[n] for n in ("heuristics", "inject") if isinstance(raw.get(n), bool)}
        if isinstance(raw.get("log_dir"), str) and raw["log_dir"]:
            given["log_dir"] = raw["log_dir"]
        return Options(**given)


def _mapping(value, where: str, allowed: tuple[str, ...]) -> dict:
    if not isinstance(value, dict):
        raise ConfigError(f"{where}: must be a mapping")
    for key in value:
        if key not in allowed:
            raise ConfigError(f"{where}.{key}: unknown key (one of {', '.join(sorted(allowed))})")
    return value


def _integer(value, where: str, least: int, most: int | None = None) -> None:
    if isinstance(value, bool) or not isinstance(value, int) or value < least:
        raise ConfigError(f"{where}: must be an integer of {least} or more")
    if most is not None and value > most:
        raise ConfigError(f"{where}: must be {most} or less")


_TOP = ("thresholds", "ignore", "gate", "heuristicFindings", "architecture", "coChange")
_ARCHITECTURE = ("maxTangles", "maxCycles", "maxMismatches", "maxLevelizationDepth")
_COCHANGE = ("enabled", "minSupport", "minRatio", "maxCommits", "maxFilesPerCommit")


def validate(config, where: str = "config") -> dict:
    """config, or ConfigError with the path of the first bad key."""
    config = _mapping(config if config is not None else {}, where, _TOP)
    for t, v in _mapping(config.get("thresholds", {}), f"{where}.thresholds", tuple(K.STRENGTH)).items():
        _integer(v, f"{where}.thresholds.{t}", 0)
    ignore = config.get("ignore", [])
    if not isinstance(ignore, list):
        raise ConfigError(f"{where}.ignore: must be a list of globs")
    for i, g in enumerate(ignore):
        if not isinstance(g, str) or not g:
            raise ConfigError(f"{where}.ignore[{i}]: must be a string that isn't empty")
    if "gate" in config:
        gate = _mapping(config["gate"], f"{where}.gate", ("minStrength", "minLocality"))
        for key, most in (("minStrength", 9), ("minLocality", 5)):
            if key not in gate:
                raise ConfigError(f"{where}.gate: {key} is missing")
            _integer(gate[key], f"{where}.gate.{key}", 1, most)
    if config.get("heuristicFindings", "include") not in ("include", "exclude"):
        raise ConfigError(f"{where}.heuristicFindings: must be include or exclude")
    for key, v in _mapping(config.get("architecture", {}), f"{where}.architecture", _ARCHITECTURE).items():
        _integer(v, f"{where}.architecture.{key}", 0)
    for key, v in _mapping(config.get("coChange", {}), f"{where}.coChange", _COCHANGE).items():
        at = f"{where}.coChange.{key}"
        if key == "enabled":
            if not isinstance(v, bool):
                raise ConfigError(f"{at}: must be true or false")
        elif key == "minRatio":
            if isinstance(v, bool) or not isinstance(v, int | float) or not 0 <= v <= 1:
                raise ConfigError(f"{at}: must be a number from 0 to 1")
        else:
            _integer(v, at, 1)
    return config


def load(path: str | None = None, default: str = ".coupling.yml") -> dict:
    """The default file may be missing; a named one may not."""
    import yaml

    file = Path(path or default)
    if not file.exists():
        if path:
            raise ConfigError(f"{path}: no such file")
        return {}
    try:
        raw = yaml.safe_load(file.read_text())
    except yaml.YAMLError as e:
        raise ConfigError(f"{file}: {e}") from e
    return validate(raw, str(file))


def config_hash(config: dict) -> str:
    """16 hex digits that don't depend on the order of keys; unset keys don't count."""

    def clean(v):
        return {k: clean(x) for k, x in v.items() if x is not None} if isinstance(v, dict) else [clean(x) for x in v] if isinstance(v, list) else v

    text = json.dumps(clean(config), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    return hashlib.sha256(text.encode()).hexdigest()[:16]


def cochange_options(config: dict, given: dict | None = None) -> dict | None:
    """The given ones first, then the configuration's, then defaults; None if off."""
    own, given = config.get("coChange", {}), given or {}
    if not own.get("enabled", True) or given.get("min_support") == 0:
        return None
    names = {"min_support": "minSupport", "min_ratio": "minRatio", "max_commits": "maxCommits", "max_files": "maxFilesPerCommit"}
    return {k: given[k] if given.get(k) is not None else own.get(n, K.COCHANGE[k]) for k, n in names.items()}


def architecture_violations(counts: dict[str, int], config: dict) -> list[tuple[str, str]]:
    """(kind, message) of counts tangles, cycles, mismatches and depth over their bounds."""
    bounds = config.get("architecture", {})
    keys = {"tangles": "maxTangles", "cycles": "maxCycles", "mismatches": "maxMismatches", "depth": "maxLevelizationDepth"}
    return [("architecture", f"{counts[k]} {k}, of which {bounds[b]} are allowed") for k, b in keys.items() if b in bounds and counts.get(k, 0) > bounds[b]]
