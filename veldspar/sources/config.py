"""Configured roots: a mapping (from YAML or JSON) to root rows and their rules."""

from __future__ import annotations

import json
import os
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from veldspar.operators.matching import PathRules


@dataclass
class Root:
    """One root: where its files are and which count."""

    name: str
    path: str
    include: list[str] = field(default_factory=list)
    exclude: list[str] = field(default_factory=list)
    max_size_bytes: int = 0

    def rules(self) -> PathRules:
        """The root's path rules, defaults included."""
        return PathRules.for_root(self.include, self.exclude, self.max_size_bytes)


def expand(path: str) -> str:
    """A path with ``~`` replaced by the home folder, also behind ``file:``."""
    scheme, sep, rest = path.partition("file:")
    return f"file:{os.path.expanduser(rest)}" if sep and not scheme else os.path.expanduser(path)


def load(text: str) -> dict:
    """A configuration in JSON, or in YAML where a YAML reader is installed."""
    try:
        return json.loads(text)
    except json.JSONDecodeError:
        try:
            import yaml
        except ImportError as error:
            raise RuntimeError("YAML configuration needs PyYAML; JSON is read without it") from error
        return yaml.safe_load(text) or {}


def roots_of(config: dict) -> list[Root]:
    """Roots by name. Each is a mapping with ``path``, or just its path."""
    out = []
    for name, spec in sorted((config.get("roots") or {}).items()):
        spec = {"path": spec} if isinstance(spec, str) else dict(spec)
        out.append(Root(name, expand(spec["path"]), list(spec.get("include") or []), list(spec.get("exclude") or []), int(spec.get("max_size_bytes") or 0)))
    return out


def resolve(config: dict, name: str | None = None) -> list[Root]:
    """The named root, or all by name; none is an error."""
    found = [r for r in roots_of(config) if name in (None, r.name)]
    if not found:
        raise ValueError(f"no root {name}" if name else "no roots")
    return found


def config_table(spark: SparkSession, roots: list[Root]) -> DataFrame:
    """``emb_root_config`` rows of the roots."""
    rows = [(r.name, json.dumps(r.include), json.dumps(r.exclude), r.max_size_bytes) for r in roots]
    return spark.createDataFrame(rows, "dataset_id string, include_globs string, exclude_globs string, max_size_bytes long")
