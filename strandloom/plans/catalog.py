"""All registered queries of the library, and their SQL."""

from strandloom.plans import file_queries, genome_queries  # noqa: F401  (register their queries)
from strandloom.plans.queries import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
