"""Settings in layers: pyproject.toml, own TOML, own JSON, environment, overrides; the last that sets one wins."""

from __future__ import annotations

import difflib
import json
import os
import tomllib
from collections.abc import Mapping
from dataclasses import dataclass, field
from pathlib import Path
from typing import Any

from .. import fixed as X

LAYERS = ("default", "pyproject", "toml", "json", "environment", "overrides")
ENV_PREFIX = "VEILSIFT_"
MOST_BYTES = 1 << 20


@dataclass(frozen=True)
class Setting:
    """kind: int, optional int, number, bool, list or severity; with bounds."""

    kind: str
    default: Any
    low: float | None = None
    high: float | None = None


SETTINGS: dict[str, Setting] = {
    "entropy.enabled": Setting("bool", True),
    "entropy.min_length": Setting("int", X.MIN_LENGTH, 1, X.MAX_TOKEN),
    "entropy.max_prose_words": Setting("int", X.MAX_PROSE_WORDS, 0),
    "entropy.min_entropy": Setting("number", X.MIN_ENTROPY, 0, 8),
    "entropy.max_entropy": Setting("number", X.MAX_ENTROPY, 0, 8),
    "entropy.min_normalized": Setting("number", X.MIN_NORMALIZED, 0, 1),
    "entropy.severity": Setting("severity", "medium"),
    "patterns.enabled": Setting("bool", True),
    "patterns.disabled": Setting("list", ()),
    "scan.ignored_paths": Setting("list", ()),
    "scan.ignored_directories": Setting("list", X.IGNORED_DIRECTORIES),
    "scan.ignored_filenames": Setting("list", X.IGNORED_FILENAMES),
    "scan.ignored_extensions": Setting("list", X.IGNORED_EXTENSIONS),
    "scan.follow_symlinks": Setting("bool", False),
    "scan.max_depth": Setting("optional int", None, 0),
    "scan.max_bytes": Setting("int", X.MAX_FILE_BYTES, 1),
    "scan.max_files": Setting("int", X.MAX_FILES, 1),
    "scan.line_cap": Setting("optional int", X.LINE_CAP, 1),
    "scan.jobs": Setting("int", 1, 1, 64),
}


class ConfigError(ValueError):
    """A setting that can't be used; the message names its layer."""


@dataclass(frozen=True)
class Config:
    values: Mapping[str, Any]
    sources: Mapping[str, str] = field(default_factory=dict)

    def __getitem__(self, name: str) -> Any:
        return self.values[name]

    def source_of(self, name: str) -> str:
        return self.sources.get(name, "default")

    def is_default(self, name: str) -> bool:
        return self.source_of(name) == "default"


def _value(name: str, raw: Any, layer: str) -> Any:
    s = SETTINGS[name]
    text = layer == "environment"
    fail = ConfigError(f"{layer}: {name} can't be {type(raw).__name__ if not text else 'that text'}")
    if s.kind == "optional int" and (raw is None or text and raw.strip().lower() in ("", "none", "null")):
        return None
    if s.kind == "bool":
        if text:
            words = {"1": True, "true": True, "yes": True, "on": True, "0": False, "false": False, "no": False, "off": False}
            if raw.strip().lower() not in words:
                raise fail
            return words[raw.strip().lower()]
        if not isinstance(raw, bool):
            raise fail
        return raw
    if s.kind == "list":
        items = [x.strip() for x in raw.split(",") if x.strip()] if text else raw
        if not isinstance(items, (list, tuple)) or not all(isinstance(x, str) for x in items):
            raise fail
        return tuple(items)
    if s.kind == "severity":
        if not isinstance(raw, str) or raw.strip().lower() not in X.SEVERITIES:
            raise fail
        return raw.strip().lower()
    try:
        number = (float(raw) if s.kind == "number" else int(raw)) if text else raw
    except ValueError:
        raise fail from None
    if isinstance(number, bool) or not isinstance(number, (int, float)) or s.kind != "number" and not isinstance(number, int):
        raise fail
    if s.low is not None and number < s.low or s.high is not None and number > s.high:
        raise ConfigError(f"{layer}: {name} is out of bounds")
    return float(number) if s.kind == "number" else number


def _flat(data: Any, layer: str, prefix: str = "") -> dict[str, Any]:
    if not isinstance(data, Mapping):
        raise ConfigError(f"{layer}: not a table of settings")
    out: dict[str, Any] = {}
    for k, v in data.items():
        name = f"{prefix}{k}"
        new = _flat(v, layer, name + ".") if isinstance(v, Mapping) else {name: v}
        twice = sorted(set(new) & set(out))
        if twice:
            raise ConfigError(f"{layer}: set twice: {twice[0]}")
        out |= new
    return out


def _pairs(pairs: list[tuple[str, Any]]) -> dict[str, Any]:
    out = dict(pairs)
    if len(out) < len(pairs):
        raise ConfigError("json: a key is given twice")
    return out


def _read(path: Path, layer: str) -> dict[str, Any]:
    raw = path.read_bytes()
    if len(raw) > MOST_BYTES:
        raise ConfigError(f"{layer}: the file is too large")
    try:
        if path.suffix == ".json":
            return json.loads(raw, object_pairs_hook=_pairs)
        return tomllib.loads(raw.decode())
    except (UnicodeDecodeError, tomllib.TOMLDecodeError, json.JSONDecodeError) as e:
        raise ConfigError(f"{layer}: the file can't be read") from e


def load(root: str | Path = ".", overrides: Mapping[str, Any] | None = None, environ: Mapping[str, str] | None = None) -> Config:
    """All settings, each from the last layer that has it."""
    root = Path(root)
    layers: list[tuple[str, dict[str, Any]]] = []
    if (root / "pyproject.toml").is_file():
        layers.append(("pyproject", _flat(_read(root / "pyproject.toml", "pyproject").get("tool", {}).get("veilsift", {}), "pyproject")))
    for name, layer in (("veilsift.toml", "toml"), ("veilsift.json", "json")):
        if (root / name).is_file():
            layers.append((layer, _flat(_read(root / name, layer), layer)))
    env = os.environ if environ is None else environ
    by_env = {ENV_PREFIX + n.replace(".", "_").upper(): n for n in SETTINGS}
    layers.append(("environment", {by_env[k]: v for k, v in env.items() if k in by_env}))
    layers.append(("overrides", dict(overrides or {})))
    values, sources = {n: s.default for n, s in SETTINGS.items()}, {}
    for layer, own in layers:
        for name, raw in own.items():
            if name not in SETTINGS:
                near = difflib.get_close_matches(name, SETTINGS, 1)
                raise ConfigError(f"{layer}: no setting {name}" + (f"; did you mean {near[0]}?" if near else ""))
            values[name], sources[name] = _value(name, raw, layer), layer
    return Config(values, sources)
