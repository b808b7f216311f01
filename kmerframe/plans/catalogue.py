"""Everything the core registers."""

from __future__ import annotations

from kmerframe.plans import graphs, joins, reads, training, typed, vectors
from kmerframe.plans.registry import QUERIES, SQL

FLAGSHIP = "subgraph_candidates"

__all__ = ["FLAGSHIP", "QUERIES", "SQL", "graphs", "joins", "reads", "training", "typed", "vectors"]
