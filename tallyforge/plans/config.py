"""Configuration trees on the driver: merge and interpolation."""

from __future__ import annotations

import re
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

_REFERENCE = re.compile(r"\$\{([\w.]+)\}")


def merge(*trees: dict) -> dict:
    """Later trees win; mappings merge, everything else, lists too, is replaced."""
    out: dict = {}
    for tree in trees:
        for k, v in (tree or {}).items():
            out[k] = merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else v
    return out


def select(tree: dict, path: str, default: Any = None) -> Any:
    for part in path.split("."):
        if not isinstance(tree, dict) or part not in tree:
            return default
        tree = tree[part]
    return tree


def resolve(tree: Any, root: dict | None = None, seen: tuple[str, ...] = ()) -> Any:
    """Every ${a.b} replaced by what it names; a value that is one reference keeps its type."""
    root = tree if root is None else root
    if isinstance(tree, dict):
        return {k: resolve(v, root, seen) for k, v in tree.items()}
    if isinstance(tree, list):
        return [resolve(v, root, seen) for v in tree]
    if not isinstance(tree, str):
        return tree

    def value(path: str) -> Any:
        if path in seen:
            raise ValueError(f"circular reference {path}")
        found = select(root, path, KeyError)
        if found is KeyError:
            raise KeyError(path)
        return resolve(found, root, (*seen, path))

    whole = _REFERENCE.fullmatch(tree)
    return value(whole[1]) if whole else _REFERENCE.sub(lambda m: str(value(m[1])), tree)


def load(*paths: str) -> dict:
    import yaml

    trees = []
    for path in paths:
        with open(path) as file:
            trees.append(yaml.safe_load(file) or {})
    return resolve(merge(*trees))


def run_grid(spark: SparkSession, runs: list[dict]) -> DataFrame:
    """Runs as a table, numbered; columns are the union of keys."""
    keys = list(dict.fromkeys(k for r in runs for k in r))
    kind = {k: pa.float64() if any(isinstance(r.get(k), float) for r in runs) else pa.int64() if all(isinstance(r.get(k, 0), int) for r in runs) else pa.string() for k in keys}
    cast = {pa.float64(): float, pa.int64(): int, pa.string(): str}
    columns = [pa.array([None if r.get(k) is None else cast[kind[k]](r[k]) for r in runs], kind[k]) for k in keys]
    return spark.createDataFrame(pa.table([pa.array(range(len(runs)), pa.int32()), *columns], names=["run", *keys]))
