"""Parameters of analyses and where they come from (SRC-20, UDF-1, UDF-3, UDF-5)."""

from __future__ import annotations

import json
import os
import tomllib
from dataclasses import dataclass, field, fields, is_dataclass
from typing import Any, Protocol

from pyspark.sql import DataFrame


class Analysis(Protocol):
    """UDF-1: anything that turns tables into one result; precomputed tables are passed like others (UDF-5)."""

    name: str
    needs_history: bool

    def run(self, tables: dict[str, DataFrame], params: Any) -> DataFrame: ...


@dataclass
class Churn:
    since_days: int = 180
    top: int = 20


@dataclass
class Temporal:
    since_days: int = 30
    least_cochanges: int = 3
    most_files: int = 100
    strong: float = 0.5


@dataclass
class Clones:
    least_tokens: int = 50
    threshold: float = 0.9
    shingle: int = 5


@dataclass
class Flags:
    providers: list[str] = field(default_factory=list)
    custom: dict[str, str] = field(default_factory=dict)
    ttl_days: int = 14


@dataclass
class Complexity:
    most_cyclomatic: int = 10
    most_cognitive: int = 15


@dataclass
class Config:
    exclude: list[str] = field(default_factory=list)
    churn: Churn = field(default_factory=Churn)
    temporal: Temporal = field(default_factory=Temporal)
    clones: Clones = field(default_factory=Clones)
    flags: Flags = field(default_factory=Flags)
    complexity: Complexity = field(default_factory=Complexity)


def _fill(target: Any, values: dict, where: str = "") -> None:
    known = {f.name for f in fields(target)}
    for k, v in values.items():
        if k not in known:
            raise ValueError(f"unknown key {where}{k}")
        if is_dataclass(getattr(target, k)):
            _fill(getattr(target, k), v, f"{where}{k}.")
        else:
            setattr(target, k, v)


def load(path: str | None = None, env: dict[str, str] | None = None, prefix: str = "CODELENS_") -> Config:
    """Defaults, then a TOML or JSON file, then environment variables PREFIX_SECTION__KEY (JSON values); unknown keys are rejected."""
    c = Config()
    if path:
        with open(path, "rb") as f:
            _fill(c, json.load(f) if path.endswith(".json") else tomllib.load(f))
    for k, v in sorted((os.environ if env is None else env).items()):
        if k.startswith(prefix):
            keys = k.removeprefix(prefix).lower().split("__")
            try:
                v = json.loads(v)
            except ValueError:
                pass
            for key in reversed(keys[1:]):
                v = {key: v}
            _fill(c, {keys[0]: v})
    return c


def days_of(window: str) -> int | None:
    """A window such as 30 days, 6m, 1y or all in days: months have 30, years 365; None for all."""
    import re

    s = window.strip().lower()
    if s == "all":
        return None
    m = re.fullmatch(r"(\d+)\s*(d|days?|w|weeks?|m|months?|y|years?)", s)
    if not m:
        raise ValueError(f"no window: {window}")
    return int(m.group(1)) * {"d": 1, "w": 7, "m": 30, "y": 365}[m.group(2)[0]]
