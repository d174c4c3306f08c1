"""Queries and SQL of this package and of the pipeline."""

from __future__ import annotations

import corpus_pipeline

from .oracles import ORACLES
from .queries import QUERIES as OPERATORS

QUERIES = {**OPERATORS, "pipeline": corpus_pipeline.run}
ORACLE = {**ORACLES, **({"pipeline": corpus_pipeline.ORACLE_SQL} if corpus_pipeline.ORACLE_SQL else {})}
