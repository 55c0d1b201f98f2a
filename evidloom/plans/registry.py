"""All registered queries and their SQL."""
from __future__ import annotations

from evidloom.plans import (
    commerce_queries, corpus_queries, evidence_queries, intake_queries, learning_queries, lookup_queries, stream_queries,
)

_PARTS = [evidence_queries, corpus_queries, intake_queries, lookup_queries, commerce_queries, learning_queries,
          stream_queries]

QUERIES = {k: v for p in _PARTS for k, v in p.QUERIES.items()}
ORACLE = {k: v for p in _PARTS for k, v in p.ORACLE.items()}
