"""What the driver contract adds for this subpackage."""

from __future__ import annotations

import corpus_pipeline
from foreglass.llm import oracles, queries as applied


def queries() -> dict:
    return {**applied.QUERIES, "pipeline": corpus_pipeline.run}


def oracle_sql() -> dict[str, str]:
    found = dict(oracles.SQL)
    if corpus_pipeline.ORACLE_SQL is not None:
        found["pipeline"] = corpus_pipeline.ORACLE_SQL
    return found
