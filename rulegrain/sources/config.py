"""Configuration: where it comes from, its checks, and its rows."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from rulegrain.schema import DEFAULT_LOG_LEVEL, OVERRIDES, parse_log_level, parse_severity

#: Looked for in the current folder, the first that is there.
NAMES = ("rulegrain.yaml", "rulegrain.yml")


@dataclass
class Config:
    config_root: str | None = None
    log_folder: str | None = None
    log_level: int = DEFAULT_LOG_LEVEL
    rules: dict = field(default_factory=dict)
    engines: dict = field(default_factory=dict)
    supplied: frozenset = frozenset()

    def disabled(self) -> list[str]:
        return [e for e, props in self.engines.items() if (props or {}).get("disable_engine")]

    def only_disabling(self) -> Config:
        """The defaults, with the engines this configuration disables still disabled."""
        return Config(engines={e: {"disable_engine": True} for e in self.disabled()})


def find(explicit: str | None = None, folder: str = ".") -> str | None:
    """An explicit path, else the first default name that exists, else none."""
    if explicit:
        return explicit
    return next((p for n in NAMES if os.path.isfile(p := os.path.join(folder, n))), None)


def parse(text: str) -> dict:
    """JSON, or YAML where its library is installed."""
    try:
        return json.loads(text or "{}") or {}
    except ValueError:
        try:
            import yaml
        except ImportError:
            raise ValueError("the configuration is no JSON, and no YAML library is installed") from None
        return yaml.safe_load(text) or {}


def checked(raw: dict) -> Config:
    """Severities and log levels by number or name; a log folder must exist."""
    out = Config(raw.get("config_root"), raw.get("log_folder"), parse_log_level(raw.get("log_level", DEFAULT_LOG_LEVEL)), raw.get("rules") or {}, raw.get("engines") or {}, frozenset(raw))
    if out.log_folder and not os.path.isdir(out.log_folder):
        raise ValueError(f"log_folder {out.log_folder!r} is no folder")
    for engine, rules in out.rules.items():
        for rule, change in (rules or {}).items():
            if "severity" in (change or {}):
                try:
                    change["severity"] = parse_severity(change["severity"])
                except ValueError as e:
                    raise ValueError(f"rules.{engine}.{rule}.severity: {e}") from None
    return out


def load(explicit: str | None = None, folder: str = ".") -> Config:
    path = find(explicit, folder)
    if path is None:
        return Config()
    with open(path, encoding="utf-8") as f:
        return checked(parse(f.read()))


def overrides(spark: SparkSession, config: Config) -> DataFrame:
    """engine, rule, severity, tags; null where not overridden, [] where overridden to nothing."""
    rows = [(e, r, (c or {}).get("severity"), (c or {}).get("tags")) for e, rules in config.rules.items() for r, c in (rules or {}).items()]
    return spark.createDataFrame(rows, OVERRIDES)


def settings(spark: SparkSession, config: Config) -> DataFrame:
    """engine, field, value_json."""
    rows = [(e, k, json.dumps(v)) for e, props in config.engines.items() for k, v in (props or {}).items()]
    return spark.createDataFrame(rows, "engine string, field string, value_json string")
