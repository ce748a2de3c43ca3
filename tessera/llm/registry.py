"""All queries and SQL of this subpackage."""

from __future__ import annotations

from tessera.llm import bpe, codes, exact, licenses, packing, pii, shards, simhash, sketches, spelling, suffix_tree, suffixes, toxicity

MODULES = (simhash, pii, toxicity, suffix_tree, bpe, sketches, packing, suffixes, exact, shards, codes, spelling, licenses)


def queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.ORACLES.items()}
