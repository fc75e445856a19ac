"""All registered queries and their SQL."""

from tagtrail.plans import document_queries, evidence_queries, knowledge_queries, series_queries, training_queries
from tagtrail.plans.registry import ORACLES, QUERIES
from tagtrail.plans.series_queries import flagship

__all__ = ["ORACLES", "QUERIES", "document_queries", "evidence_queries", "flagship", "knowledge_queries", "series_queries", "training_queries"]
