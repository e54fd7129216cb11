"""Operators for large text corpora: one query for each operator.

Nothing else in the package imports this subpackage. Every module holds one
operator and its query; `queries()` and `oracle_sql()` gather them.
"""

from __future__ import annotations

from importlib import import_module

MODULES = ("separator_scan", "column_packing", "warc_index", "weighted_minhash", "url_cascade",
           "pii_crf", "jump_shards", "decontaminate", "toxicity_cnn", "simhash_pivots",
           "source_schedule", "mask_search", "cross_alignment")


def queries() -> dict:
    """Query name -> function of (spark, sf_dir)."""
    found: dict = {}
    for name in MODULES:
        found |= import_module(f"{__name__}.{name}").QUERIES
    return found


def oracle_sql() -> dict[str, str]:
    """Query name -> DuckDB SQL, for the queries that SQL can express."""
    found: dict[str, str] = {}
    for name in MODULES:
        found |= getattr(import_module(f"{__name__}.{name}"), "ORACLE", {})
    return found
