"""Configuration: defaults, a YAML file, the environment, and compact saving."""

from __future__ import annotations

import os
import re
from copy import deepcopy
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame, SparkSession

#: Choices, defaults and ranges of the settings.
POLICIES = ("fill-empty", "overwrite-ours", "overwrite-all")
KINDS = ("author", "narrator", "series", "genre", "tag")

DEFAULTS: dict[str, Any] = {
    "logLevel": "info",
    "server": {"host": "127.0.0.1", "port": 8480},
    "paths": {"data": "./data", "staging": "./staging", "absLibrary": ""},
    "source": {"baseUrl": "https://catalogue.example.org", "minIntervalMs": 5000, "maxIntervalMs": 120_000, "challengeCooldownMs": 600_000, "requestTimeoutMs": 45_000},
    "library": {"url": "", "apiKey": "", "libraryIds": [], "pathMappings": [], "triggerScan": True, "embedIntoAudioFiles": False},
    "audio": {"playlistTimeoutMs": 30_000, "trackTimeoutMs": 3_600_000, "trackConcurrency": 5, "minFileBytes": 1024},
    "sync": {"writePolicy": "overwrite-ours", "folderTemplate": "{author}/{series}/{title}", "linkMode": "hardlink", "onCrossDevice": "copy", "language": "ukr", "tagPrefix": "shelfmark", "matchThreshold": 0.86},
    "narrators": {"prefer": [], "block": []},
    "subscriptions": [],
    "schedule": {"incrementalMinutes": 60, "backfillEnabled": True, "backfillBatch": 25, "syncMinutes": 180},
}
_CHOICES = {("logLevel",): ("debug", "info", "warn", "error"), ("sync", "writePolicy"): POLICIES, ("sync", "linkMode"): ("hardlink", "copy"), ("sync", "onCrossDevice"): ("copy", "error")}
_RANGES = {("server", "port"): (1, 65535), ("audio", "trackConcurrency"): (1, 32), ("sync", "matchThreshold"): (0, 1), ("audio", "minFileBytes"): (1, None), ("source", "minIntervalMs"): (0, None), ("source", "maxIntervalMs"): (0, None)}
#: Environment variables that win over the file.
ENVIRONMENT = {"LOG_LEVEL": ("logLevel",), "HOST": ("server", "host"), "PORT": ("server", "port"), "DATA_DIR": ("paths", "data"), "STAGING_DIR": ("paths", "staging"), "LIBRARY_URL": ("library", "url"), "LIBRARY_API_KEY": ("library", "apiKey"), "AUDIO_TRACK_CONCURRENCY": ("audio", "trackConcurrency"), "WRITE_POLICY": ("sync", "writePolicy")}


def _fill(given: Any, default: Any, where: str) -> Any:
    if isinstance(default, dict):
        if given is None:
            given = {}
        if not isinstance(given, dict):
            raise ValueError(f"{where or 'configuration'}: a mapping is wanted")
        return {k: _fill(given[k], v, f"{where}.{k}".strip(".")) if k in given else deepcopy(v) for k, v in default.items()}
    if isinstance(default, bool):
        ok = isinstance(given, bool)
    elif isinstance(default, int):
        ok = isinstance(given, int) and not isinstance(given, bool)
    elif isinstance(default, float):
        ok = isinstance(given, (int, float)) and not isinstance(given, bool)
    else:
        ok = isinstance(given, type(default))
    if not ok:
        raise ValueError(f"{where}: {type(default).__name__} is wanted")
    return given


def _at(config: dict, path: tuple[str, ...]) -> Any:
    for part in path:
        config = config[part]
    return config


def validated(given: dict | None) -> dict:
    """The configuration with defaults filled in; raises ValueError where a value isn't allowed."""
    config = _fill(given, DEFAULTS, "")
    for path, choices in _CHOICES.items():
        if _at(config, path) not in choices:
            raise ValueError(f"{'.'.join(path)}: one of {', '.join(choices)}")
    for path, (low, high) in _RANGES.items():
        if _at(config, path) < low or (high is not None and _at(config, path) > high):
            raise ValueError(f"{'.'.join(path)}: out of range")
    subscriptions = []
    for s in config["subscriptions"]:
        if not isinstance(s, dict) or s.get("type") not in KINDS or not str(s.get("value", "")).strip():
            raise ValueError("subscriptions: type and value are wanted")
        subscriptions.append({"type": s["type"], "value": str(s["value"]), "note": str(s.get("note", "")), "enabled": bool(s.get("enabled", True))})
    for mapping in config["library"]["pathMappings"]:
        if not isinstance(mapping, dict) or not mapping.get("from") or not mapping.get("to"):
            raise ValueError("library.pathMappings: from and to are wanted")
    return config | {"subscriptions": subscriptions}


def parse(text: str) -> dict:
    import yaml

    return validated(yaml.safe_load(text))


def load(path: str, environment: dict[str, str] | None = None) -> dict:
    """A file's configuration (defaults if there is none), overlaid by the environment."""
    config = parse(Path(path).read_text(encoding="utf-8")) if Path(path).exists() else validated(None)
    return overlay(config, dict(os.environ) if environment is None else environment)


def overlay(config: dict, environment: dict[str, str]) -> dict:
    """Environment values win; empty ones and integers that aren't don't count."""
    out = deepcopy(config)
    for name, path in ENVIRONMENT.items():
        value: Any = environment.get(name, "").strip()
        if not value:
            continue
        if isinstance(_at(DEFAULTS, path), bool):
            value = value.lower() in ("1", "true", "yes", "on")
        elif isinstance(_at(DEFAULTS, path), int):
            if not re.fullmatch(r"[+-]?\d+", value):
                continue
            value = int(value)
        _at(out, path[:-1])[path[-1]] = value
    return validated(out)


def compact(config: dict, defaults: Any = None) -> Any:
    """The parts of a configuration that differ from the defaults."""
    defaults = DEFAULTS if defaults is None else defaults
    out = {}
    for key, value in config.items():
        known = defaults.get(key)
        if isinstance(value, dict) and isinstance(known, dict):
            if inner := compact(value, known):
                out[key] = inner
        elif key == "subscriptions":
            if value:
                out[key] = [{k: v for k, v in s.items() if not (k == "note" and not v) and not (k == "enabled" and v)} for s in value]
        elif value != known:
            out[key] = value
    return out


def save(config: dict, path: str) -> None:
    """Validate, then write what differs from the defaults, atomically."""
    import yaml

    text = yaml.safe_dump(compact(validated(config)), allow_unicode=True, sort_keys=False)
    partial = Path(f"{path}.part")
    partial.write_text(text, encoding="utf-8")
    partial.replace(path)


def subscriptions(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(s["type"], s["value"], s.get("note", ""), s.get("enabled", True)) for s in config["subscriptions"]]
    return spark.createDataFrame(rows, "type string, value string, note string, enabled boolean")


def mappings(spark: SparkSession, config: dict) -> DataFrame:
    rows = [(k, m["from"], m["to"]) for k, m in enumerate(config["library"]["pathMappings"])]
    return spark.createDataFrame(rows, "pos int, from string, to string")
