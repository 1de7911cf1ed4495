"""Operators for training-data pipelines. Nothing outside this folder imports it."""

from importlib import import_module

MODULES = ["token_output", "packing", "quality", "token_counts", "licenses", "secrets", "decontaminate", "suffix_array", "suffix_trees", "near_dedup"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f".{m}", __name__).QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: s for m in MODULES for k, s in import_module(f".{m}", __name__).ORACLES.items()}
