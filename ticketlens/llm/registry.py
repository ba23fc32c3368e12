"""Queries and SQL counterparts of this folder and of the pipeline built on it."""

from __future__ import annotations

import corpus_pipeline
from ticketlens.llm.oracles import ORACLE as OPERATOR_SQL
from ticketlens.llm.queries import QUERIES as OPERATORS

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}
ORACLE = {**OPERATOR_SQL, **(
    {"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
