"""Operators for preparing training data at scale; one module per operator.

Nothing else in the library imports this package.  Each module ends with its registered
query (``QUERIES``) and, where SQL can express it, its check statement (``ORACLE``).
"""

from __future__ import annotations

from importlib import import_module

from pagelore.session import ship_package, tune

MODULES = ("mixing", "perplexity", "url_rules", "topk", "wrapper", "shuffling", "packing", "order_minhash", "toxicity",
           "fuzzy_lines", "language_cnn", "merkle", "conversations")


def _ready(run):
    def query(spark, sf_dir):
        tune(spark)
        ship_package(spark)
        return run(spark, sf_dir)

    return query


def queries() -> dict:
    found = {}
    for name in MODULES:
        found.update(import_module(f"pagelore.llm.{name}").QUERIES)
    return {key: _ready(run) for key, run in found.items()}


def oracle_sql() -> dict[str, str]:
    found: dict[str, str] = {}
    for name in MODULES:
        found.update(getattr(import_module(f"pagelore.llm.{name}"), "ORACLE", {}))
    return found
