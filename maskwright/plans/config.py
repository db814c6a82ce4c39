"""Configuration, from JSON or TOML, and how it meets explicit options and presets."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, fields, replace
from typing import Any

DEFAULT_NAMES = (".maskwright.json", ".maskwright.toml")


@dataclass(frozen=True)
class Config:
    min_confidence: float = 0.7
    placeholder_template: str = "[{type}_{n}]"
    disabled_detectors: tuple[str, ...] = ()
    enabled_detectors: tuple[str, ...] = ()
    allowlist: tuple[str, ...] = ()
    custom_patterns: tuple[dict[str, Any], ...] = ()
    strategy: str = "placeholder"
    pseudonym_key: str = ""
    reversible: bool = False
    preset: str = ""
    min_severity: str = ""
    normalize: bool = False
    fold_homoglyphs: bool = False
    max_input_size: int = 0


def find_config(folder: str | None = None) -> str | None:
    """The first default configuration file of a folder."""
    paths = (os.path.join(folder or os.getcwd(), n) for n in DEFAULT_NAMES)
    return next((p for p in paths if os.path.isfile(p)), None)


def load_config(path: str | None = None) -> Config:
    """Configuration of a file, or of the working folder's default file, or the defaults."""
    path = path or find_config()
    if not path:
        return Config()
    with open(path, "rb") as f:
        data = tomllib.load(f) if path.endswith(".toml") else json.load(f)
    if not isinstance(data, dict):
        raise ValueError("a configuration is an object")
    kinds = {f.name: type(getattr(Config(), f.name)) for f in fields(Config)}
    return replace(Config(), **{k: kinds[k](v) for k, v in data.items() if k in kinds})
