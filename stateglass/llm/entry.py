"""All queries of the subpackage and of the pipeline."""

from __future__ import annotations

import corpus_pipeline
from stateglass.llm import queries, queries_structure  # noqa: F401, they register
from stateglass.llm.registry import ORACLES, QUERIES

QUERIES = {**QUERIES, "pipeline": corpus_pipeline.run}
if corpus_pipeline.ORACLE_SQL is not None:
    ORACLES = {**ORACLES, "pipeline": corpus_pipeline.ORACLE_SQL}

__all__ = ["ORACLES", "QUERIES"]
